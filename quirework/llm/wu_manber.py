"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or a shorter
item whole. Patterns of one length make one searcher: a table tells for a block
of two words how far the search may move on, as no pattern can end sooner; where
it may not move, a bucket under the hash of the block lists the patterns that end
so, and direct comparison confirms. Each word of a document inside a confirmed
occurrence is hit.

The tables are broadcast. Their size is checked first: beyond SHARD_WINDOWS
patterns, items are dealt by hash into shards, each broadcast and searched in
turn over rows that are written first, and the hits joined by row number.

Results for odd input: null texts and texts without words have no hits; items
without words are never found; items with a null id count as one item, which is
not listed, for it has no name; repeated items with one id count once, and
repeated documents each for itself.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import FOLD, fields, filter_rows, load, map_rows, shared, staged, table

WINDOW = 13
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Patterns in one broadcast, each of about half a kilobyte.
SHARD_WINDOWS = 250_000


class Searcher:
    """Wu-Manber over patterns that all have the same number of words. Words are numbers, and a block is one number made of two."""

    def __init__(self, size: int, patterns: dict[tuple[int, ...], list[str | None]], numbers: dict[str, int]):
        self.size, self.numbers = size, numbers
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], list[str | None]]]] = {}
        self.base = len(numbers) if size > 1 else 0
        for words, items in patterns.items():
            for j in range(min(1, size - 1), size):
                b = words[j - 1] * self.base + words[j]
                self.shift[b] = min(self.shift.get(b, size), size - 1 - j)
            self.buckets.setdefault(words[-2:][0] * self.base + words[-1], []).append((words, items))

    def find(self, words: list[str]) -> list[tuple[int, list[str | None]]]:
        """(start, items) of each occurrence, in order."""
        out, m, n, i = [], self.size, len(words), self.size - 1
        number, move, base, far = self.numbers.get, self.shift.get, self.base, max(1, self.size - 1)
        while i < n:
            if (last := number(words[i])) is None:  # no pattern holds this word
                i += m
                continue
            b = last
            if base:
                if (before := number(words[i - 1])) is None:
                    i += far
                    continue
                b += before * base
            if step := move(b, far):
                i += step
                continue
            found = tuple(map(number, words[i - m + 1 : i + 1]))
            for pattern, items in self.buckets[b]:
                if pattern == found:
                    out.append((i - m + 1, items))
                    break
            i += 1
        return out


def searchers(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Searcher]:
    find = re.compile(WORDS).findall
    numbers: dict[str, int] = {}
    by_size: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
    for key, text in items:
        if words := [numbers.setdefault(w, len(numbers)) for w in find((text or "").translate(FOLD))]:
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                by_size.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(key)
    return [Searcher(m, {w: list(k) for w, k in p.items()}, numbers) for m, p in sorted(by_size.items())]


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def scan(df: DataFrame, tables, columns: list[str], text_col: str) -> DataFrame:
    """columns of df with n_words, the merged hit spans (in words) and the ids of the items found, all as text."""

    def start():
        find, finders = re.compile(WORDS).findall, load(tables)

        def one(text: str | None) -> tuple:
            words = find((text or "").translate(FOLD))
            hits = [(i, i + s.size, k) for s in finders for i, k in s.find(words)]
            return len(words), merged([h[:2] for h in hits]), sorted({k for h in hits for k in h[2]}, key=lambda k: (k is None, k))

        def batch(rows: dict) -> dict:
            got = list(zip(*map(one, rows["__text"])))
            return {c: rows[c] for c in columns} | dict(zip(("n_words", "spans", "items"), got))

        return batch

    picked = df.select(*(F.col(f"`{c}`").alias(c) for c in columns), F.col(f"`{text_col}`").alias("__text"))
    return map_rows(picked, [*columns, "__text"], start, fields(picked, columns, "n_words long, spans array<struct<a:int,b:int>>, items array<string>"))


def shards_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, shard_windows: int) -> list:
    """Broadcast searchers for all items, each with a bounded number of patterns (or those of a single item)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).alias("t"))
    n = items.agg(F.sum(F.greatest(F.lit(1), F.size(F.split("t", WORDS)) - window))).first()[0] or 0
    shards = max(1, -(-n // shard_windows))
    of = F.pmod(F.xxhash64("k", "t"), F.lit(shards))
    return [shared(benchmark.sparkSession, searchers([tuple(r) for r in items.where(of == s).collect()], window)) for s in range(shards)]


def hits(df: DataFrame, benchmark: DataFrame, column: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """column, n_words, spans and items for each row of df."""
    tables = shards_of(benchmark, item_id, item_text, window, shard_windows)
    if len(tables) == 1:
        return scan(df, tables[0], [column], text_col)
    rows = staged(df.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{column}`").alias("__key"), F.col(f"`{text_col}`").alias("__text")), "texts")
    found = reduce(DataFrame.unionByName, [scan(rows, t, ["__row", "__key"], "__text") for t in tables])
    flat = lambda c: F.flatten(F.collect_list(c))
    merged = found.groupBy("__row").agg(F.first("__key").alias(column), F.max("n_words").alias("n_words"), flat("spans").alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    return merged.drop("__row")


def n_hit(spans: Column) -> Column:
    """How many words lie in any of the spans, which may overlap."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"].cast("long"), s["end"]))).alias("n"), F.greatest(s["end"], x["b"].cast("long")).alias("end"))
    return F.aggregate(F.array_sort(spans), begin, step, lambda s: s["n"])


def contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (20 * hit >= words)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row for each row of df: its id, words, hit words, items found and whether it is contaminated."""
    counted = hits(df, benchmark, id_col, text_col, shard_windows=shard_windows).withColumn("n_hit", n_hit(F.col("spans")))
    return counted.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """The rows of df that are not contaminated. Columns may have any names and types."""
    tables = shards_of(benchmark, "item_id", "text", WINDOW, shard_windows)

    def start():
        find, finders = re.compile(WORDS).findall, [s for t in tables for s in load(t)]

        def clean(text: str | None) -> bool:
            words = find((text or "").translate(FOLD))
            hit = sum(x["b"] - x["a"] for x in merged([(i, i + s.size) for s in finders for i, _ in s.find(words)]))
            return not (hit and 20 * hit >= len(words))

        return lambda texts: list(map(clean, texts))

    if len(tables) == 1:
        return filter_rows(df, text_col, start)
    numbers = [f"__{i}" for i in range(len(df.columns))]
    rows = staged(df.toDF(*numbers).withColumn("__row", F.monotonically_increasing_id()), "rows")
    text = numbers[df.columns.index(text_col)]
    found = reduce(DataFrame.unionByName, [scan(rows, t, ["__row"], text) for t in tables]).where(F.size("spans") > 0)
    bad = found.groupBy("__row").agg(F.max("n_words").alias("n"), n_hit(F.flatten(F.collect_list("spans"))).alias("hit")).where(contaminated(F.col("hit"), F.col("n")))
    return rows.join(bad, "__row", "left_anti").select(*numbers).toDF(*df.columns)


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM d CROSS JOIN (SELECT DISTINCT m FROM bw), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), hit AS (
  SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, win)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
