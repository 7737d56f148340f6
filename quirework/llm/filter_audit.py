"""Filter interaction audit: what each filter of a cleaning recipe removes, in every order of the filters.

Exact copies are found by sorting. Rows are dealt into ranges of (text
fingerprint, id) and sorted there by fingerprint, full text and id, so that a
copy stands behind its predecessor, and the copies of one text, however many,
spread over ranges. A range knows of a row whether its own earlier rows hold the
text under a smaller id. At its borders it can't: so each range tells the texts
of its first and its last fingerprint with their smallest id, these few are
brought together by fingerprint and text, and the rows of such fingerprints are
judged again by what all ranges know. (The ranges are cut without the text, as
Spark brings a sample of what it cuts by to the driver.)

What a row fails is a mask of bits. Masks are counted by part, with the labels
of the documents, and these additive counters, 32 masks a part, hold all that
the orders need: a filter at a step removes the rows whose mask has its bit and
none of the bits before.

Results for odd input: a null text is empty; a null part and an empty one are
one; a null id is larger than any other, and nothing is smaller than itself, so
equal ids with equal texts are no copies of each other; a document is labelled
if any row of its id in the labels is, and a row without id never; labels of no
document are passed over; texts are taken whole; an empty table gives no part
and no row; other columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.llm.common import fields, join_unique, slices, staged, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|"
COPY = 1 << FILTERS.index("E")


def text_mask(text: str) -> int:
    """The bits of A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at the white space of ASCII
    n = len(words)
    out = n < MIN_WORDS
    out |= (100 * len(set(words)) < MIN_DISTINCT * n) << 1
    out |= (100 * (len(raw) - len(raw.translate(None, UPPER))) > MAX_UPPER * len(text)) << 2
    return out | any(c in text for c in SIGNS) << 3


def less(a, b) -> bool:
    """Whether id a is smaller than id b; null is the largest."""
    return a is not None and (b is None or a < b)


def sorted_rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Rows (edge is null) with their mask as far as their range knows it, and the texts at the edges of ranges with their smallest ids."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("fp", F.xxhash64("text"))
    by = F.col("id").asc_nulls_last()
    ranged = rows.repartitionByRange("fp", by).sortWithinPartitions("fp", "text", by)
    kind = fields(ranged, ["id", "part", "fp"], "slot int, mask int, edge string, range int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        first = fp = None
        group: list[list] = []  # the texts of the fingerprint at hand and their smallest ids

        def edges() -> Iterator[tuple]:
            return ((least, None, fp, slot, None, text, here) for slot, (text, least) in enumerate(group))

        def put(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in slices(batches):
            out = []
            for key, part, text, now in zip(*(c.to_pylist() for c in batch.columns)):
                if now != fp or not group:
                    if group and fp == first:
                        out += edges()
                    first = now if first is None else first
                    fp, group = now, [[text, key]]
                    copy = False
                elif text == group[-1][0]:
                    copy = less(group[-1][1], key)
                else:
                    group.append([text, key])
                    copy = False
                out.append((key, part, now, len(group) - 1, text_mask(text) | COPY * copy, None, here))
            yield put(out)
        if group:
            yield put(list(edges()))

    return ranged.mapInArrow(run, kind)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and the mask of failed filters of each row."""
    rows = staged(sorted_rows(docs, id_col, text_col, part_col), "ranges")
    edges = rows.where(F.col("edge").isNotNull())
    nulls = F.min("id").alias("least")  # of ids; null only where all are
    least = edges.groupBy("fp", "edge").agg(nulls).withColumnRenamed("edge", "text")
    here = edges.select("range", "fp", "slot", F.col("edge").alias("text")).distinct().join(least, ["fp", "text"]).select("range", "fp", "slot", "least")
    known = staged(here, "edges")
    judged = rows.where(F.col("edge").isNull()).join(known, ["range", "fp", "slot"], "left")
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("least") < F.col("id")))
    return judged.select(F.col("id").alias(id_col), "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents, good ones and toxic ones by part and mask."""
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    ids = staged(failed.groupBy(F.col(id_col).alias("id"), "part", "mask").agg(F.count("*").alias("n")), "masks")
    per_id = ids.groupBy("id").agg(F.count("*").alias("rows")).join(told, "id")
    labelled = join_unique(ids, per_id, "id", "rows", ids.count()).groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    plain = ids.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return plain.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders() -> Column:
    """An array of every order and step: the filter's bit, and the bits before it."""
    steps = [(o, i + 1, 1 << FILTERS.index(c), sum(1 << FILTERS.index(x) for x in o[:i])) for o in map("".join, permutations(FILTERS)) for i, c in enumerate(o)]
    return F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<o:string,s:int,b:int,e:int>>")


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step."""
    per = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")).select("part", "masks", F.explode(orders()).alias("x"))
    bit, earlier = F.col("x.b"), F.col("x.e")

    def total(field: str, test) -> Column:
        return F.aggregate(F.filter("masks", test), F.lit(0).cast("long"), lambda acc, m: acc + m[field])

    failing = lambda m: m["mask"].bitwiseAND(bit) != 0
    before = lambda m: m["mask"].bitwiseAND(earlier) != 0
    removed = lambda m: failing(m) & ~before(m)
    # of the 120 orders, a mask of k bits has each of its filters first in 120 / k
    share = F.aggregate(F.filter("masks", failing), F.lit(0).cast("long"), lambda acc, m: acc + (m["n"] * 120 / F.bit_count(m["mask"])).cast("long"))
    return per.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        total("n", lambda m: m["mask"].bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: failing(m) & before(m)).alias("redundant"),
        total("n", lambda m: m["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counters(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (earlier + bit)::BIGINT = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & earlier::BIGINT = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & earlier::BIGINT > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & earlier::BIGINT = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & earlier::BIGINT = 0) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
