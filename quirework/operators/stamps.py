"""Stamps: blocks of lines at one of nine places of a page, as its reader sees it.

A block is laid out upright in a frame of its own, turned as a whole, put in its
place of the visible page, and taken back to the coordinates of the page, which
may itself be turned. All of it is column arithmetic, a row for each line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.geometry import block_origin, norm_angle, visible_frame, visible_to_user

GAP_SHARE = 0.25


def block_extent(widths: Column, size: Column, gap: Column) -> Column:
    """(w, h) of lines one above the other; of none, zero by zero."""
    n = F.size(widths)
    return F.struct(F.coalesce(F.array_max(widths), F.lit(0.0)).alias("w"), (n * size + F.greatest(n - 1, F.lit(0)) * gap).alias("h"))


def turned(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Column:
    """A place of a block of w by h after the block is turned to the left by quarters, counted from its new lower left corner."""
    return F.struct(
        F.when(angle == 90, h - y).when(angle == 180, w - x).when(angle == 270, y).otherwise(x).alias("x"),
        F.when(angle == 90, x).when(angle == 180, h - y).when(angle == 270, w - x).otherwise(y).alias("y"),
    )


def stamp_lines(df: DataFrame, lines: Column, width: Callable[[Column], Column], size: Column, position: Column, margin: Column, angle: Column, box: Column, rotate: Column, align: Column | None = None, gap: Column | None = None) -> DataFrame:
    """df's columns with line_no, line, its baseline's begin (x, y) on the page, turn in degrees, and the block's visible box.

    lines: an array of texts, the top one first; null and empty ones are left
    out, and a row without any other gives no row. width: of a text, in points.
    align: left, center or right, by default that of the position.
    """
    shown = F.filter(lines, lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))
    gap = size * GAP_SHARE if gap is None else gap
    quarter = norm_angle(angle)
    made = df.withColumn("__lines", shown).withColumn("__widths", F.transform("__lines", width)).withColumn("__block", block_extent(F.col("__widths"), size, gap))
    w, h = F.col("__block.w"), F.col("__block.h")
    sideways = quarter.isin(90, 270)
    box_w, box_h = F.when(sideways, h).otherwise(w), F.when(sideways, w).otherwise(h)
    frame = visible_frame(box["w"], box["h"], rotate)
    made = made.withColumn("__origin", block_origin(position, frame["w"], frame["h"], box_w, box_h, margin)).select("*", F.posexplode("__lines").alias("line_no", "line"))
    side = F.substring_index(position, "-", -1) if align is None else align
    slack = w - F.get("__widths", F.col("line_no"))
    along = F.when(side == "left", F.lit(0.0)).when(side == "right", slack).otherwise(slack / 2)
    at = turned(along, h - F.col("line_no") * (size + gap) - size, w, h, quarter)
    placed = made.withColumn("__at", at)
    user = visible_to_user(F.col("__origin.x") + F.col("__at.x"), F.col("__origin.y") + F.col("__at.y"), box, rotate)
    block = F.struct(F.col("__origin.x").alias("x"), F.col("__origin.y").alias("y"), box_w.alias("w"), box_h.alias("h"))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), "line_no", "line", user["x"].alias("x"), user["y"].alias("y"), F.pmod(quarter + norm_angle(rotate), F.lit(360)).alias("turn"), block.alias("block"))
