"""SimHash near-duplicates, found with BK-trees.

Each distinct fingerprint is a node. To bring fingerprints within the radius r
together, their bits are dealt into r + 1 bands: two that differ in r bits or
fewer agree in one band at least. Each band value makes a shard with a BK-tree
of its own, whose children are keyed by Hamming distance to their parent; a
search follows only the edges within the radius. A shard of more than
SHARD_LIMIT fingerprints is dealt again by r + 1 bands of its remaining bits,
which keeps every link, until it is small or REFINE rounds have fixed so many
bits that its distinct members are few. Trees thus travel with the
fingerprints that search them and none is broadcast: the trees of a whole corpus
have no size bound, and a broadcast would bring all fingerprints to the driver.
The README has figures.

A shard yields a spanning forest of its links, never its pairs, and alternating
stars join the forests. Exact copies share a node, however many they are, and
fingerprints that very many rows have, or components of very many fingerprints,
are joined by broadcast of their few labels.

Results for odd input: null and wordless texts have fingerprint zero and link
like others; a null id takes the component of its text and names none; a
component of null ids alone has a null component_id; repeated rows stay.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import FOLD, WORD, fields, join_unique, map_rows, staged, table
from quirework.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
SHARD_LIMIT, REFINE = 1024, 4


def simhash(text: str | None, find, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = find((text or "").translate(FOLD))
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(p).encode(), SEED) for p in parts), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # bounds the unpacked bits of a very long text
        total += np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def start():
        find = re.compile(WORD).findall
        return lambda rows: {id_col: rows[id_col], "fp": [simhash(t, find) for t in rows["__text"]]}

    picked = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    return map_rows(picked, [id_col, "__text"], start, fields(picked, [id_col], "fp long"))


class BKTree:
    """A tree over integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self, root: int):
        self.nodes, self.children = [root], [{}]

    def add(self, x: int) -> None:
        at = 0
        while d := (self.nodes[at] ^ x).bit_count():
            if (to := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.nodes)
                self.nodes.append(x)
                self.children.append({})
                return
            at = to

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            if (d := (self.nodes[at] ^ x).bit_count()) <= radius:
                found.append(self.nodes[at])
            for key, to in self.children[at].items():
                if -radius <= d - key <= radius:
                    todo.append(to)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard of distinct unsigned values.

    Neighbours in order of value are linked first. What is then the largest
    group of linked values searches nothing: others find it.
    """
    up = {x: x for x in values}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out: list[tuple[int, int]] = []

    def link(a: int, b: int) -> None:
        if (p := top(a)) != (q := top(b)):
            up[p] = q
            out.append((a, b))

    values = sorted(values)
    for a, b in zip(values, values[1:]):
        if (a ^ b).bit_count() <= radius:
            link(a, b)
    if len(out) == len(values) - 1:
        return out
    groups: dict[int, list[int]] = {}
    for x in values:
        groups.setdefault(top(x), []).append(x)
    largest = max(groups, key=lambda k: len(groups[k]))
    tree = BKTree(values[0])
    for x in values[1:]:
        tree.add(x)
    for key, members in groups.items():
        if key != largest:
            for x in members:
                for y in tree.within(x, radius):
                    link(x, y)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_free(mask: int, parts: int) -> list[int]:
    """mask with one of so many equal shares of its free bits added, each in turn."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in share) for share in np.array_split(free, parts)]


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, refine: int = REFINE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp that together connect all within the radius."""
    masks = split_free(0, radius + 1)
    shard = lambda df, m: df.select("fp", F.explode(m).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    array = lambda ms: F.array(*(F.lit(signed(m)).cast("long") for m in ms))
    dealt, small = shard(nodes.select("fp"), array(masks)), []
    for _ in range(refine):
        big = staged(dealt.groupBy("mask", "key").count().where(F.col("count") > limit).drop("count"), "shards")
        if big.isEmpty():
            break
        small.append(dealt.join(big, ["mask", "key"], "left_anti"))
        finer = {m: split_free(m, radius + 1) for m in masks}
        chosen = F.create_map(*(x for m, ms in finer.items() for x in (F.lit(signed(m)).cast("long"), array(ms))))
        dealt = shard(dealt.join(big, ["mask", "key"], "left_semi"), chosen[F.col("mask")])
        masks = sorted({m for ms in finer.values() for m in ms})
    every = reduce(DataFrame.unionByName, [*small, dealt])
    shards = every.groupBy("mask", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def start():
        def batch(rows: dict) -> dict:
            got = [e for fps in rows["fps"] for e in forest([x & (1 << 64) - 1 for x in fps], radius)]
            return {"u": [signed(a) for a, _ in got], "v": [signed(b) for _, b in got]}

        return batch

    return map_rows(shards, ["fps"], start, "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, least_hot: int = 10_000) -> DataFrame:
    """For each row: its id, fingerprint, and component_id, the least id that links reach."""
    rows = staged(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, radius), least_hot=least_hot)
    linked = staged(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "low", "n"), "linked")
    n_rows, n_linked = rows.count(), linked.count()
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    of_linked = join_unique(linked, lows, "root", "members", n_linked, least=least_hot).select("fp", "component_id", "n")
    alone = nodes.join(of_linked, "fp", "left_anti").select("fp", F.col("low").alias("component_id"), "n")
    labels = staged(of_linked.unionByName(alone), "labels")
    return join_unique(rows, labels, "fp", "n", n_rows, least=least_hot).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df less all but one of each component: that with the least id.

    Rows with a null id stay, for no component names them; of rows with one and
    the same id that stays, one is kept. Columns may have any names.
    """
    numbers = [f"c{i}" for i in range(len(df.columns))]
    rows, key, text = df.toDF(*numbers), numbers[df.columns.index(id_col)], numbers[df.columns.index(text_col)]
    found = near_duplicates(rows, key, text)
    stay = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = rows.join(stay, key, "left_semi").select(*numbers).dropDuplicates([key])
    return named.unionByName(rows.where(F.col(key).isNull())).toDF(*df.columns)


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
