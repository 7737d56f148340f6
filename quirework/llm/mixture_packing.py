"""Mixture-controlled packing: deficit round-robin over the token queues of sources.

Each source has a queue: its documents in the order of the table, as one stream
of ids with an end id after each. A round fills one window: every queue has
its share of the window added to its deficit, sends as many whole grains as the
deficit covers, and carries the rest on. Queues start with a deficit by hash, so
that small ones don't take their turns all at once. A queue that is empty sends
nothing more, and the others go on in their proportions. Rounds follow each
other without a gap and are cut at the capacity, so only the last sequence of
all is padded.

A deficit depends on the number of the round alone, not on what others sent. So
each piece's round comes from its place in its queue, in whole numbers, and no
task waits for another: deficits carry over from partition to partition through
the places, which are running sums over partitions. Where a round begins is a
running sum over rounds. No queue and no stream is ever in one task; a source
with a third of all rows is spread like the others, and a round holds about a
window of tokens.

Targets are shares of all tokens by source. Without them, or for a source that
has none, the share is what the source has of the corpus, so that all queues end
together.

Results for odd input: a null or empty text is the end id alone; a null source
is a queue like others, and one with the empty name; a null id is kept; repeated
rows are packed each for itself; very long texts are cut by rounds and
sequences; an empty table gives an empty result; other columns of any name are
not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.llm.common import fields, map_rows, slices, staged, table
from quirework.llm.packing_gga import END_ID
from quirework.llm.tokens import ENCODE_ROWS, encoder

CAPACITY = 2048
#: Tokens of a window, and of a grain: a queue sends whole grains only.
WINDOW, GRAIN = 2048, 16
#: Rows that are summed up in one window of a running sum, at most.
SPAN = 4096


def running(df: DataFrame, keys: list[str], at: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """df with the sum of value over the smaller at of the same keys. at is a whole number from 0 on, once for each of the keys.

    Blocks of span numbers are summed up, these blocks in blocks again, until there is one.
    """
    most = df.agg(F.max(at)).first()[0] or 0

    def level(rows: DataFrame, most: int) -> DataFrame:
        before = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        inner = F.coalesce(F.sum(value).over(before.partitionBy(*keys, "__block")), F.lit(0))
        blocked = rows.withColumn("__block", F.expr(f"`{at}` div {span}"))
        here = blocked.withColumn(out, inner)
        if most < span:
            return here.drop("__block")
        sums = blocked.groupBy(*keys, "__block").agg(F.sum(value).alias(value)).withColumnRenamed("__block", at)
        above = level(sums, most // span).select(*keys, F.col(at).alias("__block"), F.col(out).alias("__above"))
        return here.join(above, [*keys, "__block"]).withColumn(out, F.col(out) + F.col("__above")).drop("__block", "__above")

    return level(df, most)


def coded(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str | None) -> DataFrame:
    """Each row's ids, two bytes each where that will do, its number, partition and queue, and the tokens of its queue before it in the partition."""

    def start():
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        upto: dict[str, int] = {}
        seen = 0

        def batch(rows: dict) -> dict:
            nonlocal seen
            out = []
            for key, queue, raw in zip(rows[id_col], rows["__queue"], encode(rows["__text"])):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(END_ID))
                at = upto.get(queue, 0)
                upto[queue] = at + len(ids)
                out.append((key, (part << 33) + seen, part, queue, at, len(ids), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()))
                seen += 1
            return dict(zip((id_col, "row", "part", "queue", "at", "n", "ids"), zip(*out)))

        return batch

    picked = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("__queue"), F.col(f"`{text_col}`").alias("__text"))
    return map_rows(picked, [id_col, "__queue", "__text"], start, fields(picked, [id_col], "row long, part long, queue string, at long, n long, ids binary"), ENCODE_ROWS)


class Queue:
    """The rounds of a queue whose share of a window is weight of whole."""

    def __init__(self, name: str, weight: int, whole: int, window: int, grain: int):
        early = zlib.crc32(name.encode()) * whole * grain  # the deficit it starts with, below one grain
        self.grain, self.early, self.step, self.unit = grain, early, window * weight << 32, grain * whole << 32

    def round(self, at: int) -> int:
        """The round that sends the token at this place: the first after which the deficits so far cover its grain."""
        return -((self.early - (at // self.grain + 1) * self.unit) // self.step) - 1

    def end(self, k: int) -> int:
        """How many tokens all rounds up to k have sent, if there were so many."""
        return ((k + 1) * self.step + self.early) // self.unit * self.grain

    def pieces(self, at: int, n: int) -> list[tuple[int, int, int]]:
        """(round, tokens before, length) of the pieces of n tokens from this place on."""
        out, here = [], at
        while here < at + n:
            k = self.round(here)
            to = min(at + n, self.end(k))
            out.append((k, here - at, to - here))
            here = to
        return out


def weighted(sums: DataFrame, targets: dict[str, float] | None) -> tuple[DataFrame, int]:
    """The weight of each queue, a whole number, and the sum of weights."""
    totals = sums.groupBy("queue").agg(F.sum("tokens").alias("weight"))
    if targets:
        if min(targets.values()) <= 0:
            raise ValueError("a target share has to be more than zero")
        every = totals.agg(F.sum("weight")).first()[0] or 0
        given = F.create_map(*(F.lit(x) for pair in targets.items() for x in pair))
        totals = totals.withColumn("weight", F.greatest(F.lit(1), F.coalesce(F.round(given[F.col("queue")] * every).cast("long"), "weight")))
    return totals, totals.agg(F.sum("weight")).first()[0] or 1


def rounds(rows: DataFrame, targets: dict[str, float] | None, window: int, grain: int) -> DataFrame:
    """The pieces of each row by round: (row, queue, round, start, length)."""
    sums = staged(rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "sums")
    weights, whole = weighted(sums, targets)
    bases = staged(running(sums, ["queue"], "part", "tokens", "base").join(weights, "queue").select("queue", "part", "base", "weight"), "bases")
    placed = rows.select("row", "part", "queue", "at", "n").join(bases, ["queue", "part"]).select("row", "queue", "weight", (F.col("base") + F.col("at")).alias("at"), "n")

    def start():
        known: dict[str, Queue] = {}

        def batch(columns: dict) -> dict:
            out = []
            for row, queue, weight, at, n in zip(*(columns[c] for c in placed_columns)):
                if queue not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[queue] = Queue(queue, weight, whole, window, grain)
                out += [(row, queue, *p) for p in known[queue].pieces(at, n)]
            return dict(zip(("row", "queue", "round", "start", "length"), zip(*out)))

        return batch

    placed_columns = placed.columns
    return map_rows(placed, placed_columns, start, "row long, queue string, round long, start long, length long")


def cut(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with a place in the stream (begin), cut at the ends of sequences."""
    first, last = F.expr(f"begin div {capacity}"), F.expr(f"(begin + length - 1) div {capacity}")
    each = pieces.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    bottom: Column = F.greatest(F.col("begin"), F.col("sequence_id") * capacity)
    top = F.least(F.col("begin") + F.col("length"), (F.col("sequence_id") + 1) * capacity)
    return each.select("row", (F.col("start") + bottom - F.col("begin")).alias("start"), (top - bottom).alias("length"), "sequence_id", (bottom - F.col("sequence_id") * capacity).alias("offset"))


def sequences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str, float] | None = None,
    capacity: int = CAPACITY,
    window: int = WINDOW,
    grain: int = GRAIN,
    with_ids: bool = False,
    path: str | None = None,
) -> DataFrame:
    """The pieces of each text with their sequence and place in it; with_ids adds the ids that go there."""
    rows = staged(coded(docs, id_col, text_col, source_col, path), "coded")
    pieces = staged(rounds(rows, targets, window, grain), "rounds")
    begins = running(pieces.groupBy("round").agg(F.sum("length").alias("tokens")), [], "round", "tokens", "begin").select("round", "begin")
    turn = W.partitionBy("round").orderBy("queue", "row", "start").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn("place", F.coalesce(F.sum("length").over(turn), F.lit(0))).join(begins, "round").withColumn("begin", F.col("begin") + F.col("place"))
    cuts = cut(placed, capacity).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))

    whole = rows.join(cuts, "row").select(id_col, "queue", "n", "ids", "cuts")
    more = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    kind = fields(whole, [id_col], more + ", ids array<int>" * with_ids)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, queues, n, raws, cuts = batch.columns
            parents, flat = pc.list_parent_indices(cuts), pc.list_flatten(cuts)
            start, length, sequence, offset = flat.flatten()
            texts = [np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * m else "<u4").astype("<u4") for raw, m in zip(raws, n.to_pylist())]
            views = [memoryview(t).cast("B") for t in texts]
            places = list(zip(parents.to_pylist(), start.to_pylist(), length.to_pylist()))
            crcs = pa.array([zlib.crc32(views[i][4 * a : 4 * (a + m)]) for i, a, m in places], pa.int64())
            out = [keys.take(parents), start, length, crcs, n.take(parents), sequence, offset, queues.take(parents)]
            if with_ids:
                out.append(pa.array([texts[i][a : a + m] for i, a, m in places], arrow.field("ids").type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    return whole.mapInArrow(run, kind)


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))
