"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most the capacity. The pieces
are dealt into blocks of bounded size by hash. Each block is evolved by several
islands apart: a crossover injects whole well-filled bins of one parent into
another, takes out the bins that hold a piece twice then, and puts the pieces
that lost their bin back by best fit. After an epoch each island receives the
elite of its neighbour, and evolves on. An island ends early at a packing that
the sum of lengths shows to be the best there is.

The bins of a block that are not well filled are opened again, and their pieces
go to the next level, with fewer blocks, until one block is left; so the loss at
the edges of blocks doesn't grow with their number. Where that would open more
than half of a level's pieces, as no bin of such lengths can be well filled,
only bins less than half full are opened: best fit leaves one in a block at
most, as two of them would have been one.

Results for odd input: a null or empty text is one piece, the end id alone; a
null id is kept; repeated rows are packed each for itself; an empty table gives
an empty result.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import fields, map_rows, staged, table
from quirework.llm.tokens import ENCODE_ROWS, encoder

CAPACITY, END_ID = 4096, 1
BLOCK, ISLANDS, EPOCHS = 2048, 2, 2
POPULATION, GENERATIONS = 4, 6
#: Bins filled less than the first are opened again for the next level, or less than the second where those are too many.
OPENED = (0.995, 0.5)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """The pieces of each text with their place in it and the checksum of their ids; with_ids adds the ids."""

    def start():
        encode = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()

        def batch(rows: dict) -> dict:
            out = []
            for key, raw in zip(rows[id_col], encode(rows["__text"])):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None))
            return dict(zip((id_col, "piece", "start", "length", "ids_crc32", "ids"), zip(*out)))

        return batch

    picked = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    schema = fields(picked, [id_col], "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return map_rows(picked, [id_col, "__text"], start, schema, ENCODE_ROWS)


class Packing:
    """Bins over pieces 0 to n - 1 of given lengths."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bins, self.fill = lengths, capacity, [], []

    def best_fit(self, items: list[int]) -> Packing:
        """Puts each item, in the order given, where it leaves least room."""
        room = sorted((self.capacity - f, i) for i, f in enumerate(self.fill) if f < self.capacity)
        for x in items:
            size = self.lengths[x]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
                self.bins[b].append(x)
                self.fill[b] += size
            else:
                left, b = self.capacity, len(self.bins)
                self.bins.append([x])
                self.fill.append(size)
            if left > size:
                insort(room, (left - size, b))
        return self

    def fitness(self) -> tuple[int, float]:
        """Less is better: the bins, then how evenly they are filled."""
        return len(self.bins), -sum((f / self.capacity) ** 2 for f in self.fill)

    def cross(self, other: Packing, rng: random.Random) -> Packing:
        """A child of self with whole well-filled bins of other."""
        rank = sorted(range(len(other.bins)), key=lambda i: (-other.fill[i], i))[: max(1, len(other.bins) // 2)]
        given = rng.sample(rank, max(1, len(rank) // 2))
        taken = {x for i in given for x in other.bins[i]}
        child, loose = Packing(self.lengths, self.capacity), []
        for b, f in zip(self.bins, self.fill):
            if taken.isdisjoint(b):
                child.bins.append(list(b))
                child.fill.append(f)
            else:
                loose += [x for x in b if x not in taken]
        for i in given:
            child.bins.append(list(other.bins[i]))
            child.fill.append(other.fill[i])
        return child.best_fit(sorted(loose, key=lambda x: (-self.lengths[x], x)))

    def assignment(self) -> list[int]:
        out = [0] * len(self.lengths)
        for i, b in enumerate(self.bins):
            for x in b:
                out[x] = i
        return out

    @classmethod
    def of(cls, lengths: list[int], capacity: int, assignment: list[int]) -> Packing:
        out = cls(lengths, capacity)
        n = max(assignment, default=-1) + 1
        out.bins, out.fill = [[] for _ in range(n)], [0] * n
        for x, b in enumerate(assignment):
            out.bins[b].append(x)
            out.fill[b] += lengths[x]
        return out


def evolve(lengths: list[int], capacity: int, seeds: list[list[int]], rng: random.Random) -> list[int]:
    """The best assignment that an island finds. Lengths come in descending order."""
    least = -(-sum(lengths) // capacity)
    pool = [Packing.of(lengths, capacity, s) for s in seeds]
    if not pool:
        pool.append(Packing(lengths, capacity).best_fit(list(range(len(lengths)))))
    best = min(pool, key=Packing.fitness)
    if len(best.bins) <= least:
        return best.assignment()
    while len(pool) < POPULATION:
        spread = 1 + rng.random() / 4
        order = sorted(range(len(lengths)), key=lambda x: -lengths[x] * rng.uniform(1, spread))
        pool.append(Packing(lengths, capacity).best_fit(order))
    for _ in range(GENERATIONS):
        pool.sort(key=Packing.fitness)
        if len(pool[0].bins) <= least:
            break
        children = [pool[i].cross(pool[j], rng) for i in range(2) for j in range(len(pool)) if i != j]
        pool = sorted([*pool, *children], key=Packing.fitness)[:POPULATION]
    return min(pool, key=Packing.fitness).assignment()


def pack_blocks(items: DataFrame, n_blocks: int, capacity: int, level: int) -> DataFrame:
    """items, dealt into n_blocks, with sequence_id, offset and fill of the bin of each."""
    names = items.columns
    block = F.pmod(F.xxhash64(*names, F.lit(level)), F.lit(n_blocks)).alias("block")
    first = F.struct((-F.col("length")).alias("__order"), *names)
    state = items.groupBy(block).agg(F.array_sort(F.collect_list(first)).alias("items")).withColumn("elites", F.expr("cast(array() as array<array<int>>)"))
    kind = dict(state.dtypes)["items"]

    def start():
        def batch(rows: dict) -> dict:
            out = []
            for block, island, items, elites in zip(rows["block"], rows["island"], rows["items"], rows["elites"]):
                lengths = [x["length"] for x in items]
                near = [elites[island], elites[island - 1]] if elites else []
                out.append(evolve(lengths, capacity, near, random.Random(f"{block} {island} {len(near)} {level}")))
            return {"block": rows["block"], "island": rows["island"], "items": rows["items"], "bins": out}

        return batch

    for _ in range(EPOCHS):
        isles = state.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", "elites")
        grown = map_rows(isles, isles.columns, start, f"block long, island int, items {kind}, bins array<int>")
        state = grown.groupBy("block").agg(F.min_by("items", "island").alias("items"), F.transform(F.array_sort(F.collect_list(F.struct("island", "bins"))), lambda x: x["bins"]).alias("elites"))
    best = F.array_min(F.transform("elites", lambda b: F.struct((F.array_max(b) + 1).alias("n"), b.alias("bins"))))["bins"]

    def place():
        def batch(rows: dict) -> dict:
            out = []
            for items, bins in zip(rows["items"], rows["bins"]):
                fill = [0] * (max(bins, default=-1) + 1)
                at = []
                for x, b in zip(items, bins):
                    at.append(fill[b])
                    fill[b] += x["length"]
                out.append([{"bin": b, "offset": o, "fill": fill[b]} for b, o in zip(bins, at)])
            return {"block": rows["block"], "items": rows["items"], "places": out}

        return batch

    placed = map_rows(state.select("block", "items", best.alias("bins")), ["block", "items", "bins"], place, f"block long, items {kind}, places array<struct<bin:int,offset:long,fill:long>>")
    each = placed.select("block", F.explode(F.arrays_zip("items", "places")).alias("x"))
    number = F.lit(level << 56).cast("long") + F.col("block") * (1 << 24) + F.col("x.places.bin")
    return each.select(*(F.col(f"x.items.{n}").alias(n) for n in names), number.alias("sequence_id"), F.col("x.places.offset").alias("offset"), F.col("x.places.fill").alias("__fill"))


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """items (with a column length, 1 to capacity) with the sequence_id and offset of each."""
    done, level = [], 0
    items = items.withColumn("__row", F.monotonically_increasing_id())  # parts repeated rows, which would all meet in one block
    while True:
        items = staged(items, "pieces")
        n = items.count()
        n_blocks = max(1, -(-n // block))
        packed = pack_blocks(items, n_blocks, capacity, level)
        if n_blocks == 1:
            return reduce(DataFrame.unionByName, [*done, packed.drop("__fill", "__row")])
        packed = staged(packed, "packed")
        sure = [F.col("__fill") >= share * capacity for share in OPENED]
        opened = packed.agg(*(F.count(F.when(~x, 1)) for x in sure)).first()
        good, left = next(((x, m) for x, m in zip(sure, opened) if 2 * m <= n), (F.lit(True), 0))
        done.append(packed.where(good).drop("__fill", "__row"))
        if not left:
            return reduce(DataFrame.unionByName, done)
        items = packed.where(~good).drop("sequence_id", "offset", "__fill")
        level += 1


def sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of df's texts, packed. With with_ids, each row holds the ids that go at offset in its sequence."""
    return pack(pieces(df, id_col, text_col, capacity, with_ids), capacity)


def op8_packing_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))
