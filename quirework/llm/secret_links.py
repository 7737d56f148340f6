"""Secret scans with multipart credential linking, in DataFrame functions alone.

Three kinds are reported wherever they stand (assign, access, hex). Three more
are weak by themselves: an identifier (weak_id), a secret key (weak_key) and an
endpoint. They are candidates only, and an interval join within a scope decides:
a candidate's interval, widened by SCOPE code points on both sides, has to meet
that of a part that completes it. An identifier or endpoint needs a secret (a
weak_key or an assign); a weak_key needs an identifier (weak_id or access) or an
endpoint. The join asks for the nearest part of each role before and after, by
running extremes in order of place, so its work is that of a sort and no pairs
are made. A candidate inside a base span isn't reported again.

Most texts hold no part of any kind. Plain searches tell so before a pattern is
tried: a kind's words, or a run of signs as long as its shortest match. And where
a text holds no secret, its identifiers and endpoints aren't looked for, as they
would complete nothing.

Results for odd input: a null text is an empty one, without spans; repeated rows
and null ids are scanned each for itself; places are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import table

KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order in which spans with one start are listed. Runs that are long enough are found as such: the base rule drops a
#: shorter run whole, and no part of one could match either. An assign's value is measured afterwards, for a short one takes its place.
KINDS = {
    "assign": KEYWORD + r"[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    "weak_id": r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,32}(?![A-Za-z0-9])",
    "weak_key": r"(?<![A-Za-z0-9+/=_-])(?=[^a-z]{0,39}[a-z])(?=[^A-Z]{0,39}[A-Z])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+""",
}
NAMES = list(KINDS)
MIN_VALUE, SCOPE, MARK = 12, 256, "[SECRET]"


def hints(text: Column) -> dict[str, Column]:
    """What a text has to hold if it holds a part of a kind; a text may well hold it without."""
    lower = F.lower(text)
    return {
        "assign": reduce(Column.__or__, (F.contains(lower, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.rlike(text, F.lit("[0-9a-f]{16}")),
        "weak_key": F.rlike(text, F.lit("[A-Za-z0-9+/]{40}")),
        "endpoint": F.contains(text, F.lit("://")),
    }


def parts(df: DataFrame, text_col: str) -> DataFrame:
    """df with all matches of all kinds in __parts: (kind, i, gap, len, good), gap being the distance from the match before; good is false for a match that is dropped."""
    text = F.col(text_col)
    for name, hint in hints(text).items():
        df = df.withColumn(f"__{name}", hint)
    secret = F.col("__assign") | F.col("__weak_key")
    wanted = {k: F.col(f"__{k}") for k in ("assign", "access", "hex", "weak_key")} | {"weak_id": secret, "endpoint": secret & F.col("__endpoint")}

    def of(number: int, name: str, pattern: str) -> Column:
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = lambda h: F.length(F.regexp_replace(h, "^" + KEYWORD, "")) >= MIN_VALUE
        every = F.transform(hits, lambda h, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("len"), (value(h) if number == 0 else F.lit(True)).alias("good")))
        none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,len:int,good:boolean>>)")
        return F.when(wanted[name] & F.rlike(text, F.lit(pattern)), every).otherwise(none)

    found = df.withColumn("__parts", F.concat(*(of(i, k, p) for i, (k, p) in enumerate(KINDS.items()))))
    return found.drop(*(f"__{k}" for k in hints(text)))


def spans(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """A row (__row, pos, first, kind, s, e, reported) for each match, or one without kind; first holds columns on one row of each text.

    One shuffle, by row; it carries what columns ask for once.
    """
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(f"`{c}`" for c in columns)).alias("first"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    each = parts(rows, "__text").select("__row", "first", F.posexplode_outer("__parts").alias("pos", "x"))
    each = each.select("__row", "pos", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("first")).alias("first"), "x.*").repartition("__row")
    same = W.partitionBy("__row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    at = F.sum("gap").over(same) + F.sum("len").over(same)
    each = each.select("*", at.cast("long").alias("e")).withColumn("s", F.col("e") - F.col("len"))
    kind = lambda *names: F.col("good") & F.col("kind").isin(*map(NAMES.index, names))
    secret, completes = kind("weak_key", "assign"), kind("weak_id", "access", "endpoint")
    before = W.partitionBy("__row").orderBy("s", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("__row").orderBy(F.desc("s"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    near = lambda role: F.coalesce(F.col("s") - F.max(F.when(role, F.col("e"))).over(before) <= SCOPE, F.lit(False)) | F.coalesce(F.min(F.when(role, F.col("s"))).over(after) - F.col("e") <= SCOPE, F.lit(False))
    inside = F.coalesce(F.max(F.when(kind("assign", "access", "hex"), F.col("e"))).over(before.rowsBetween(W.unboundedPreceding, 0)) > F.col("s"), F.lit(False))
    linked = (kind("weak_id", "endpoint") & near(secret)) | (kind("weak_key") & near(completes))
    return each.select("__row", "pos", "first", "kind", "s", "e", (kind("assign", "access", "hex") | (linked & ~inside)).alias("reported"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, counts of base kinds, the digest of the base spans, and all spans."""
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("kind"))
    told = F.struct("s", "kind", F.concat_ws(":", name, "s", "e").alias("text"))
    base = F.col("kind") <= 2
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, told))), lambda x: x["text"]), ",")
    count = lambda k: F.count(F.when(F.col("reported") & (F.col("kind") == NAMES.index(k)), 1)).alias(f"n_{k}")
    got = spans(df, [id_col], text_col).groupBy("__row").agg(
        F.first("first", ignorenulls=True).getField(id_col).alias(id_col),
        *map(count, ("assign", "access", "hex")),
        F.sha2(listed(F.col("reported") & base), 256).alias("base_sha256"),
        listed(F.col("reported")).alias("spans"),
    )
    return got.drop("__row")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = MARK) -> DataFrame:
    """df with the reported spans of its texts replaced by mark; length_col, if there is one, gets the new length. Null texts stay null.

    Texts without a hint of a secret go by without a shuffle. Columns may have any names.
    """
    numbers = [f"c{i}" for i in range(len(df.columns))]
    names = dict(zip(df.columns, numbers))
    rows, text_col = df.toDF(*numbers), names[text_col]
    kinds = hints(F.coalesce(F.col(text_col), F.lit("")))
    hint = reduce(Column.__or__, (kinds[k] for k in ("access", "assign", "hex", "weak_key")))  # without a secret an endpoint isn't told
    got = cut(rows.where(hint), text_col, mark)
    if length_col in names:
        length = F.coalesce(F.length(text_col).cast(df.schema[length_col].dataType), F.col(names[length_col]))
        got = got.withColumn(names[length_col], length)
        rows = rows.withColumn(names[length_col], length)
    return rows.where(~hint).unionByName(got).toDF(*df.columns)


def cut(df: DataFrame, text_col: str, mark: str) -> DataFrame:
    found = spans(df, df.columns, text_col)
    before = W.partitionBy("__row").orderBy("s", "kind").rowsBetween(W.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.when(F.col("reported"), F.col("e"))).over(before), F.lit(0))
    cuts = found.withColumn("cut", F.when(F.col("reported"), F.struct("s", "e", end.cast("long").alias("end"))))
    got = cuts.groupBy("__row").agg(F.first("first", ignorenulls=True).alias("first"), F.array_sort(F.collect_list("cut")).alias("cuts"))
    text = F.col(f"first.{text_col}")
    pieces = F.transform(F.filter("cuts", lambda c: c["s"] >= c["end"]), lambda c: F.concat(F.substring(text, c["end"].cast("int") + 1, (c["s"] - c["end"]).cast("int")), F.lit(mark)))
    rest = F.expr(f"substring(first.`{text_col}`, cast(array_max(transform(cuts, c -> c.e)) as int) + 1)")
    clean = F.when(F.size("cuts") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return got.select(*(clean.alias(c) if c == text_col else F.col(f"first.`{c}`").alias(c) for c in df.columns))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
