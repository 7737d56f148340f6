"""URL filters: a trie over reversed host labels and path segments, broadcast.

The rule with the most host labels wins, and among those with one host the one
with the longest path; of two rules with the same host and path, block wins. A
rule's last segment may be part of one: it fits where the url's path goes on
with it.

The trie is broadcast while the rules have at most MAX_CHARS characters.
Beyond, it takes the rules with few labels and segments, as many as fit, for
these are the ones that very many urls share; the others are joined by host and
whole segments with each url's own suffixes and prefixes, salted against busy
hosts, and the longer match is picked.

Results for odd input: a null url or one without :// has an empty host and path
and no rule; an empty host fits no rule; an empty path fits only rules without a
path; repeated rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import LOWER, UPPER, fields, load, map_rows, shared, staged, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
#: Characters of rules in one broadcast.
MAX_CHARS = 16_000_000
MAX_DEPTHS, SALTS = 1000, 8
#: More than a path's length, so that longer hosts come first.
RANK = 1 << 32

HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


class Trie:
    """Nodes of host labels, from the last one on, each with a trie of path segments."""

    def __init__(self, rules):
        self.root: tuple[dict, dict] = ({}, {})
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, ({}, {}))
            *whole, part = path.split("/")
            at = node[1]
            for segment in whole:
                at = at.setdefault("/" + segment, {})
            held = at.setdefault(None, [])  # the key None holds the parts of segments, longest first
            held.append((part, verdict, host + path))
            held.sort(key=lambda x: (-len(x[0]), x[1] != "block"))

    def path_rule(self, at: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            best = next(((verdict, rule) for part, verdict, rule in at.get(None, ()) if segment.startswith(part)), best)
            if (at := at.get("/" + segment)) is None or i == len(segments) - 1:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        best, node = None, self.root
        for label in reversed(host.split(".")) if host else ():
            if (node := node[0].get(label)) is None:
                break
            if node[1]:
                best = self.path_rule(node[1], path) or best
        return best


def size(host: Column, path: Column) -> Column:
    return F.length(host) + F.length(path) + 8


def match(df: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, max_chars: int = MAX_CHARS) -> DataFrame:
    """id, host, path, rule and verdict for each row. rules: a list, or a table (verdict, host, path)."""
    spark = df.sparkSession
    parted = df.select(F.col(f"`{id_col}`").alias(id_col), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    if not isinstance(rules, DataFrame):
        if sum(len(h) + len(p) + 8 for _, h, p in rules) <= max_chars:
            return match_by_trie(parted, list(rules), id_col).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path").where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    depth = F.size(F.split("host", r"\.")) + F.size(F.split("path", "/"))
    by_depth = rules.groupBy(depth.alias("depth")).agg(F.sum(size(F.col("host"), F.col("path"))).alias("n")).orderBy("depth").limit(MAX_DEPTHS).collect()
    upto = held = 0
    for r in by_depth:
        held += r["n"]
        if held > max_chars:
            break
        upto = r["depth"]
    short = [(r["verdict"], r["host"], r["path"]) for r in rules.where(depth <= upto).collect()] if upto else []
    found = match_by_trie(parted, short, id_col)
    if held > max_chars or len(by_depth) == MAX_DEPTHS:
        found = match_by_join(found, rules.where(depth > upto), id_col)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def match_by_trie(parted: DataFrame, rules: list[tuple[str, str, str]], id_col: str) -> DataFrame:
    """parted with rule and verdict, both null where no rule fits."""
    trie = shared(parted.sparkSession, Trie(rules))

    def start():
        find = load(trie).find

        def batch(rows: dict) -> dict:
            got = [find(h, p) or (None, None) for h, p in zip(rows["host"], rows["path"])]
            return rows | {"rule": [x[1] for x in got], "verdict": [x[0] for x in got]}

        return batch

    return map_rows(parted, [id_col, "host", "path"], start, fields(parted, [id_col], "host string, path string, rule string, verdict string"))


def fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row (__row, host, path) with the rules that fit it, and no others: it is joined by its host's suffixes and those of its path's prefixes that a rule can have.

    A rule ends within a segment after so many characters, or at its begin. The
    lengths that occur, no more than the longest rule has characters, say where a
    path is cut, so that rules with one host and many beginnings of a segment
    don't share a key.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    keyed = rules.select(F.col("verdict").alias("__verdict"), F.col("host").alias("__h"), F.col("path").alias("__path"), salts)
    lengths = F.array(*(F.lit(r[0]) for r in rules.select(F.length(F.regexp_extract("path", "[^/]*$", 0))).distinct().collect())).cast("array<int>")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    whole = lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))).otherwise("")
    cut = lambda segment, i: F.transform(F.filter(lengths, lambda n: n <= F.length(segment)), lambda n: F.concat(whole(i), F.substring(segment, F.lit(1), n)))
    tried = rows.where("host <> ''").select("__row", F.explode(F.array_distinct(F.flatten(F.transform(segments, cut)))).alias("__path"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int").alias("__salt"), hosts.alias("__hosts"))
    return tried.select("__row", "__path", "__salt", F.explode("__hosts").alias("__h")).join(keyed, ["__h", "__path", "__salt"])


def match_by_join(found: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """found with longer rules of any number."""
    rows = staged(found.withColumn("__row", F.monotonically_increasing_id()), "urls")
    fits = fitting(rows, rules)
    rank = lambda host, path, verdict: F.struct((F.length(host) * RANK + F.length(path)).alias("n"), F.col(verdict).alias("verdict"), F.concat(host, path).alias("rule"))
    best = fits.groupBy("__row").agg(F.max(rank("__h", "__path", "__verdict")).alias("best"))
    got = rows.join(best, "__row", "left")
    # Of a rule from the trie only the text is known: it begins with a suffix of the host, which ends before its first slash.
    old = F.when(F.col("rule").isNotNull(), rank(F.regexp_extract("rule", "^[^/]*", 0), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1), "verdict"))
    pick = F.greatest(F.col("best"), old)
    return got.select(id_col, "host", "path", pick["rule"].alias("rule"), pick["verdict"].alias("verdict"))


def op2_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost) * 100000 + length(rpath)) AS b
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""
