"""Overlap by a grid of cells.

Without a key, an overlap predicate makes Spark try each pair. overlap_join()
deals both sides into blocks of cells of one size instead, joins on the page and
the block, and keeps pairs that share several blocks at their first.

Within a page, which is one row, Grid does the same in memory. Rectangles that
take more than a quarter of their page stand in one extra cell that every record
visits, for else they would be dealt into hundreds. An overlap is found whichever
way; the order of candidates is part of the meaning, as the first hit wins: large
ones first, then by first shared cell in rows, then by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL, BIG_SHARE = 48.0, 0.25
#: A block is so many cells wide and high. Copies of a rectangle are shuffled by block, of which it touches fewer.
BLOCK = 4


def rect_area(r: dict) -> float:
    return max(0.0, r["right"] - r["x"]) * max(0.0, r["bottom"] - r["top"])


class Grid:
    """Rectangles of a page by the cells that they touch; what lies outside counts to the cells at the edge."""

    def __init__(self, rects: list[dict], vw: float | None, vh: float | None, cell: float = CELL, big_share: float = BIG_SHARE):
        self.cell, self.across, self.down = cell, max(1, ceil((vw or 1.0) / cell)), max(1, ceil((vh or 1.0) / cell))
        self.big: list[dict] = []
        self.held: dict[tuple[int, int], list[tuple[int, dict]]] = {}
        for i, r in enumerate(rects):
            if rect_area(r) > big_share * max(1.0, (vw or 1.0) * (vh or 1.0)):
                self.big.append(r)
            else:
                for at in self.cells(r):
                    self.held.setdefault(at, []).append((i, r))

    def cells(self, r: dict) -> Iterator[tuple[int, int]]:
        """Row by row."""
        place = lambda v, n: max(0, min(n - 1, floor(v / self.cell)))
        (c0, c1), (r0, r1) = sorted((place(r["x"], self.across), place(r["right"], self.across))), sorted((place(r["top"], self.down), place(r["bottom"], self.down)))
        return ((row, col) for row in range(r0, r1 + 1) for col in range(c0, c1 + 1))

    def near(self, r: dict) -> Iterator[dict]:
        """Rectangles in a cell that r touches, each once, in the order in which they are tried."""
        yield from self.big
        seen: set[int] = set()
        if self.held:
            for at in self.cells(r):
                for i, other in self.held.get(at, ()):
                    if i not in seen:
                        seen.add(i)
                        yield other


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """All pairs (keys, l, r) of rectangles that share more than an edge.

    Both sides: keys, id, x, top, right, bottom. A pair counts in the block of
    the upper left corner of its common part only, so no pair comes twice and
    none has to be taken out.
    """
    cell *= BLOCK
    grid = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))

    def dealt(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*keys, *(F.col(c).alias(p + c) for c in ("id", "x", "top", "right", "bottom")))
        return named.select("*", F.explode(grid(p + "x", p + "right")).alias("__cx")).select("*", F.explode(grid(p + "top", p + "bottom")).alias("__cy"))

    x0, y0 = F.greatest("lx", "rx"), F.greatest("ltop", "rtop")
    meet = (x0 < F.least("lright", "rright")) & (y0 < F.least("lbottom", "rbottom"))
    here = (F.floor(x0 / cell) == F.col("__cx")) & (F.floor(y0 / cell) == F.col("__cy"))
    return dealt(left, "l").join(dealt(right, "r"), [*keys, "__cx", "__cy"]).where(meet & here).select(*keys, F.col("lid").alias("l"), F.col("rid").alias("r"))
