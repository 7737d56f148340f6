"""Statistics and repair of page rasters, with numpy, a page at a time.

A raster is (w, h, luma), one byte for each pixel. Pages are independent, so
this is a narrow map; nothing of a page leaves its task but a few numbers or the
new raster. Copies for analysis are averaged over areas.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SPREAD_SIDE, SPREAD_CELLS, PAPER = 96, 8, 0.9
FIELD_SIDE, SAUVOLA_K, SAUVOLA_R = 1400, 0.2, 128.0
SKEW_SIDE, SKEW_INK, SKEW_PIXELS, SKEW_MAX, SKEW_STEP, SKEW_LEAST = 320, 150, 200, 5.0, 0.25, 0.007
BUCKETS, COLUMN_INK, COLUMN_FLOOR = 80, 200, 0.05
SHADOW = 25
BASE_DPI, LEAST_DPI, TARGET_DPI, LOW_DPI = 72, 200, 300, 200


def luma_of(rgb: np.ndarray) -> np.ndarray:
    """(h, w, 3) or (h, w, 4) to (h, w), cut to whole numbers."""
    c = rgb[..., :3].astype(np.uint32)
    return ((299 * c[..., 0] + 587 * c[..., 1] + 114 * c[..., 2]) // 1000).astype(np.uint8)


def shrink(a: np.ndarray, side: int) -> np.ndarray:
    """A copy whose longer side is side at most, each pixel the mean of those it stands for."""
    h, w = a.shape
    scale = min(1.0, side / max(h, w))
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    if (nh, nw) == (h, w):
        return a
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = a.astype(float).cumsum(0).cumsum(1)
    ys, xs = np.linspace(0, h, nh + 1).astype(int), np.linspace(0, w, nw + 1).astype(int)
    box = sums[np.ix_(ys, xs)]
    n = np.outer(np.diff(ys), np.diff(xs))
    return np.rint((box[1:, 1:] - box[:-1, 1:] - box[1:, :-1] + box[:-1, :-1]) / n).astype(np.uint8)


@lru_cache(8)
def spread_cells(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of each cell that has any, filled up with one past the last, and which of them in order of brightness counts."""
    at = np.arange(h * w).reshape(h, w)
    cuts = lambda n: [(i * n // SPREAD_CELLS, (i + 1) * n // SPREAD_CELLS) for i in range(SPREAD_CELLS)]
    cells = [c for p, q in cuts(h) for r, s in cuts(w) if len(c := at[p:q, r:s].ravel())]
    pixels = np.full((len(cells), max(map(len, cells), default=0)), h * w)
    for row, c in zip(pixels, cells):
        row[: len(c)] = c
    return pixels, np.array([[min(len(c) - 1, int(len(c) * PAPER))] for c in cells], int).reshape(-1, 1)


def illumination_spread(a: np.ndarray) -> int:
    """How much the paper's brightness differs over the page: its 90th percentile in 8 by 8 cells, greatest less least."""
    small = shrink(a, SPREAD_SIDE)
    pixels, rank = spread_cells(*small.shape)
    if not len(pixels):
        return 0
    levels = np.take_along_axis(np.sort(np.append(small, np.uint8(255))[pixels], axis=1), rank, 1)
    return int(levels.max()) - int(levels.min())


def sauvola_field(a: np.ndarray) -> np.ndarray:
    """Local thresholds from the mean and deviation in a window, on a smaller copy, by sums over areas."""
    small = shrink(a, FIELD_SIDE).astype(float)
    h, w = small.shape
    size = max(7, round(max(h, w) / 24)) | 1
    r = size // 2
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)

    def window(v: np.ndarray) -> np.ndarray:
        s = np.zeros((h + 1, w + 1))
        s[1:, 1:] = v.cumsum(0).cumsum(1)
        rows = s[y1] - s[y0]  # sums of whole numbers, exact in any order
        return rows[:, x1] - rows[:, x0]

    n = np.outer(y1 - y0, x1 - x0)
    mean = window(small) / n
    deviation = np.sqrt(np.maximum(window(small**2) / n - mean**2, 0))
    return (mean * (1 + SAUVOLA_K * (deviation / SAUVOLA_R - 1))).astype(np.float32)


def apply_field(a: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Black where a pixel is no brighter than the field there, which is read between its points."""
    h, w = a.shape
    fh, fw = field.shape
    if (fh, fw) == (h, w):
        return np.where(a <= field, 0, 255).astype(np.uint8)
    y, x = np.clip((np.arange(h) + 0.5) * fh / h - 0.5, 0, fh - 1), np.clip((np.arange(w) + 0.5) * fw / w - 0.5, 0, fw - 1)
    i, j = np.minimum(y.astype(int), max(fh - 2, 0)), np.minimum(x.astype(int), max(fw - 2, 0))
    i1, j1 = np.minimum(i + 1, fh - 1), np.minimum(j + 1, fw - 1)
    v, u = (y - i)[:, None], (x - j)[None, :]
    t = (field[np.ix_(i, j)] * (1 - u) + field[np.ix_(i, j1)] * u) * (1 - v) + (field[np.ix_(i1, j)] * (1 - u) + field[np.ix_(i1, j1)] * u) * v
    return np.where(a <= t, 0, 255).astype(np.uint8)


@lru_cache(2)
def skew_rows(h: int, w: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The angles, the row of each pixel at each of them, and by how much those of one angle are set off from those before."""
    angles = np.deg2rad(-SKEW_MAX + np.arange(round(2 * SKEW_MAX / SKEW_STEP) + 1) * SKEW_STEP)
    y, x = (v.ravel() for v in np.mgrid[0:h, 0:w])
    rows = np.array([np.rint((y - h / 2) * np.cos(angle) - (x - w / 2) * np.sin(angle)) for angle in angles], np.int32)
    rows -= rows.min()
    apart = int(rows.max()) + 1
    return angles, rows + np.arange(len(angles), dtype=np.int32)[:, None] * apart, apart


def estimate_skew(a: np.ndarray) -> float:
    """The angle, in radians, at which the ink's rows vary most; zero where there is little ink or little skew. Of equals the first."""
    small = shrink(a, SKEW_SIDE)
    ink = np.flatnonzero(small < SKEW_INK)
    if len(ink) < SKEW_PIXELS:
        return 0.0
    angles, rows, apart = skew_rows(*small.shape)
    counts = np.bincount(rows.take(ink, axis=1).ravel(), minlength=len(angles) * apart).reshape(-1, apart)
    has = counts > 0
    begin, end = has.argmax(1), apart - has[:, ::-1].argmax(1)
    squares = np.einsum("ij,ij->i", counts, counts) / (end - begin)
    near = squares - (len(ink) / (end - begin)) ** 2
    best, found = -1.0, 0.0
    for k in np.flatnonzero(near >= (near - 1e-9 * squares).max() - 1e-9 * squares):  # the greatest, but for rounding
        variance = counts[k, begin[k] : end[k]].var()
        if variance > best:
            best, found = variance, float(angles[k])
    return found if abs(found) > SKEW_LEAST else 0.0


def rotate(a: np.ndarray, angle: float) -> np.ndarray:
    """Turned about the middle by -angle; paper comes in at the corners."""
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w]
    c, s = np.cos(angle), np.sin(angle)
    dy, dx = y - h / 2, x - w / 2
    i, j = np.rint(dx * s + dy * c + h / 2).astype(int), np.rint(dx * c - dy * s + w / 2).astype(int)
    inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
    return np.where(inside, a[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)], 255).astype(np.uint8)


def multi_column(a: np.ndarray) -> bool:
    """Whether the middle of the page has a gutter: a dip in the ink that is deep, and neither thin nor wide."""
    h, w = a.shape
    ink = (a[:: max(1, h // 300)] < COLUMN_INK).mean(axis=0)
    edges = (np.arange(BUCKETS + 1) * w / BUCKETS).astype(int)
    bucket = np.array([ink[p:q].mean() if q > p else 0.0 for p, q in zip(edges, edges[1:])]) if w % BUCKETS else ink.reshape(BUCKETS, -1).mean(axis=1)
    full = np.flatnonzero(bucket > COLUMN_FLOOR)
    if not len(full):
        return False
    left, right = full[0], full[-1]
    width = right - left + 1
    low, high = left + int(width * 0.25), min(BUCKETS - 1, left + int(np.ceil(width * 0.75)))
    at = low + int(np.argmin(bucket[low : high + 1]))
    typical = np.sort(bucket[left : right + 1])[width // 2]
    if typical <= 0:
        return False
    begin = end = at
    while begin > low and bucket[begin - 1] < typical * 0.4:
        begin -= 1
    while end < high and bucket[end + 1] < typical * 0.4:
        end += 1
    return bool(bucket[at] / typical < 0.35 and 0.015 <= (end - begin + 1) / width <= 0.30)


def prepare(a: np.ndarray, binarise: bool = True, deskew: bool = True, force: bool = False, with_raster: bool = True) -> tuple[np.ndarray | None, dict]:
    """A page made ready for recognition, if wanted, and what was done to it. The input is left as it is."""
    spread = illumination_spread(a)
    done = binarise and (force or spread >= SHADOW)
    out = apply_field(a, sauvola_field(a)) if done else a
    angle = estimate_skew(out) if deskew else 0.0
    made = None if not with_raster else rotate(out, angle) if angle else out
    return made, {"spread": spread, "binarised": bool(done), "skew": float(np.rad2deg(angle)), "columns": multi_column(a)}


def unmap(x: Column, y: Column, skew: Column, w: Column, h: Column) -> Column:
    """A place in a prepared raster back in the one it came from: turned about the middle by skew, in radians; as it is without skew or where that is null."""
    dx, dy, angle = x - w / 2, y - h / 2, F.coalesce(skew, F.lit(0.0))
    at = F.struct((w / 2 + dx * F.cos(angle) - dy * F.sin(angle)).alias("x"), (h / 2 + dx * F.sin(angle) + dy * F.cos(angle)).alias("y"))
    return F.when(angle != 0, at).otherwise(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


#: Steps of preparation, and that each is done unless told otherwise.
SWITCHES = ("upscale", "binarize", "deskew")


def switches(*given: Column) -> Column:
    """The setting of each step from maps of text to text, later ones first: true or false, or force, of binarize alone. What is neither counts as not given."""

    def setting(name: str) -> Column:
        valid = ("true", "false", "force") if name == "binarize" else ("true", "false")
        said = [F.when(v.isin(*valid), v) for g in reversed(given) for v in [F.get(F.map_values(F.map_filter(g, lambda k, _: k == name)), F.lit(0))]]
        return F.coalesce(*said, F.lit("true")).alias(name)

    return F.struct(*map(setting, SWITCHES))


def memory_capped(mode: Column, low_memory: Column, mobile: Column) -> Column:
    """Whether a plan's rasters must not grow: by its mode, by a sign of little memory, or on a phone. Nulls are no sign."""
    return F.coalesce(mode.isin("low-memory", "selected-pages"), F.lit(False)) | F.coalesce(low_memory, F.lit(False)) | F.coalesce(mobile, F.lit(False))


def pick_scale(base: Column, low_memory: Column, w: Column, h: Column, max_area: Column) -> Column:
    """(scale, applied, capped): towards 300 dpi, 200 where memory is low, within the area; five percent more at least."""
    want = F.when(low_memory, F.lit(LOW_DPI / BASE_DPI)).otherwise(F.lit(TARGET_DPI / BASE_DPI))
    most = F.when((w > 0) & (h > 0) & (w * h * want * want > max_area), F.sqrt(max_area / (w * h)))
    got = F.coalesce(most, want)
    asked = F.floor(base * BASE_DPI + 0.5) < LEAST_DPI
    applied = asked & (got > base * 1.05)
    return F.struct(F.when(applied, got).otherwise(base).alias("scale"), applied.alias("applied"), F.coalesce(asked & most.isNotNull(), F.lit(False)).alias("capped"))


STATS = "spread int, binarised boolean, skew double, columns boolean"


def prepare_pages(rasters: DataFrame, keys: list[str], with_raster: bool = False) -> DataFrame:
    """keys and the statistics of each raster; with_raster adds the prepared one. One page in memory at a time."""
    kinds = ", ".join(f"`{k}` {rasters.schema[k].dataType.simpleString()}" for k in keys)
    kind = _parse_datatype_string(f"{kinds}, {STATS}" + ", w int, h int, luma binary" * with_raster)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for i, (w, h, luma) in enumerate(zip(batch["w"].to_pylist(), batch["h"].to_pylist(), batch["luma"])):
                out, stats = prepare(np.frombuffer(luma.as_buffer(), np.uint8).reshape(h, w), with_raster=with_raster)
                done.append(stats | ({"w": w, "h": h, "luma": out.tobytes()} if with_raster else {}))
                if with_raster or i + 1 == batch.num_rows:
                    own = batch.slice(i + 1 - len(done), len(done)).select(keys).columns
                    yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(own, arrow)] + [pa.array([d[f.name] for d in done], f.type) for f in list(arrow)[len(keys) :]], schema=arrow)
                    done = []

    return rasters.select(*keys, "w", "h", "luma").mapInArrow(run, kind)


def whole_document(stats: DataFrame, key: str) -> DataFrame:
    """The column decision of each document's first page holds for all its pages."""
    first = stats.groupBy(key).agg(F.min_by("columns", "page").alias("multi_column"))
    return stats.join(first, key)
