"""Scalar functions on rectangles, page coordinates and colour, as column expressions.

A rectangle is a struct (x, top, right, bottom) with top above bottom in number,
that is, y grows downwards. Page boxes are structs (x, y, w, h) with y upwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def mat_mul(m: Column, n: Column) -> Column:
    """The affine map that applies m first, then n; each is an array of six."""
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    p, q, r, s, t, u = (F.get(n, F.lit(i)) for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(ZERO), right - left) * F.greatest(F.lit(ZERO), bottom - top)


def rect_area(r: Column) -> Column:
    return area(r["x"], r["top"], r["right"], r["bottom"])


def intersect_area(a: Column, b: Column) -> Column:
    return area(F.greatest(a["x"], b["x"]), F.greatest(a["top"], b["top"]), F.least(a["right"], b["right"]), F.least(a["bottom"], b["bottom"]))


def to_viewport_bottom_up(x: Column, y: Column, box: Column, rotate: Column) -> Column:
    """Page space to the rotated view, origin below left."""
    u, v = x - box["x"], y - box["y"]
    return (
        F.when(rotate == 90, F.struct(v.alias("x"), (box["w"] - u).alias("y")))
        .when(rotate == 180, F.struct((box["w"] - u).alias("x"), (box["h"] - v).alias("y")))
        .when(rotate == 270, F.struct((box["h"] - v).alias("x"), u.alias("y")))
        .otherwise(F.struct(u.alias("x"), v.alias("y")))
    )


def to_viewport(x: Column, y: Column, box: Column, rotate: Column) -> Column:
    """Page space to the rotated view, origin above left."""
    u, v = x - box["x"], y - box["y"]
    return (
        F.when(rotate == 90, F.struct(v.alias("x"), u.alias("y")))
        .when(rotate == 180, F.struct((box["w"] - u).alias("x"), v.alias("y")))
        .when(rotate == 270, F.struct((box["h"] - v).alias("x"), (box["w"] - u).alias("y")))
        .otherwise(F.struct(u.alias("x"), (box["h"] - v).alias("y")))
    )


def view_upright(a: Column, b: Column, c: Column, d: Column, rotate: Column) -> Column:
    """Whether text with this matrix stands upright in the rotated view: within 2 % of the glyphs' scale, or 0.001 on a page that isn't turned."""
    scale = F.sqrt(c * c + d * d)
    near = lambda *v: F.greatest(*(F.abs(x) for x in v)) < 0.02 * scale
    turned = (
        F.when(rotate == 90, near(a, d) & (b > 0) & (c < 0))
        .when(rotate == 180, near(b, c) & (a < 0) & (d < 0))
        .when(rotate == 270, near(a, d) & (b < 0) & (c > 0))
        .otherwise((F.abs(b) <= 0.001) & (F.abs(c) <= 0.001))
    )
    return (scale > 0) & turned


def gray_of(space: Column, comps: Column) -> Column:
    """Luminance from 0 to 1 of a fill colour; null where it can't be told, as for patterns."""
    c = [F.get(comps, F.lit(i)).cast("double") for i in range(4)]
    luma = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b
    one = F.lit(1.0)
    return (
        F.when(space == "gray", c[0])
        .when(space == "rgb", luma(c[0], c[1], c[2]))
        .when(space == "cmyk", luma(*(one - F.least(one, x + c[3]) for x in c[:3])))
    )


def norm_angle(angle: Column) -> Column:
    """The nearest quarter turn, from 0 to 270."""
    return F.pmod(F.floor(angle / 90 + 0.5) * 90, F.lit(360)).cast("int")


def visible_frame(w: Column, h: Column, rotate: Column) -> Column:
    turned = norm_angle(rotate) % 180 == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def visible_to_user(x: Column, y: Column, box: Column, rotate: Column) -> Column:
    """From the rotated view, origin below left, back to page space: the inverse of to_viewport_bottom_up."""
    r = norm_angle(rotate)
    u = F.when(r == 90, box["w"] - y).when(r == 180, box["w"] - x).when(r == 270, y).otherwise(x)
    v = F.when(r == 90, x).when(r == 180, box["h"] - y).when(r == 270, box["h"] - x).otherwise(y)
    return F.struct((box["x"] + u).alias("x"), (box["y"] + v).alias("y"))


#: The nine places: top, middle or bottom, a hyphen, and left, center or right.
PLACES = [f"{v}-{h}" for v in ("top", "middle", "bottom") for h in ("left", "center", "right")]


def block_origin(position: Column, frame_w: Column, frame_h: Column, w: Column, h: Column, margin_x: Column, margin_y: Column | None = None) -> Column:
    """Lower left corner of a block at one of nine places; any other is bottom-center. margin_y is margin_x if it is not given."""
    margin_y = margin_x if margin_y is None else margin_y
    at = F.when(position.isin(PLACES), position).otherwise("bottom-center")
    x = F.when(F.endswith(at, F.lit("left")), margin_x).when(F.endswith(at, F.lit("right")), frame_w - margin_x - w).otherwise((frame_w - w) / 2)
    y = F.when(F.startswith(at, F.lit("top")), frame_h - margin_y - h).when(F.startswith(at, F.lit("middle")), (frame_h - h) / 2).otherwise(margin_y)
    return F.struct(x.alias("x"), y.alias("y"))


def line_anchor(origin: Column, block_h: Column, line: Column, size: Column, leading: Column) -> Column:
    """Baseline of a line of a block, counted from 0 at its top."""
    return F.struct(origin["x"].alias("x"), (origin["y"] + block_h - size - line * size * leading).alias("y"))


def viewport_to_matrix(x: Column, y: Column, size: Column, box: Column, rotate: Column) -> Column:
    """The text matrix that puts upright text of a size at a place of the view, origin above left."""
    r = norm_angle(rotate)
    frame = visible_frame(box["w"], box["h"], rotate)
    at = visible_to_user(x, frame["h"] - y, box, rotate)
    zero = F.lit(ZERO)
    turned = F.when(r == 90, F.array(zero, size, -size, zero)).when(r == 180, F.array(-size, zero, zero, -size)).when(r == 270, F.array(zero, -size, size, zero)).otherwise(F.array(size, zero, zero, size))
    return F.concat(turned, F.array(at["x"], at["y"]))


def clamp_scale(scale: Column, w: Column, h: Column, max_area: Column) -> Column:
    """The scale at which a drawn page has max_area at most."""
    drawn = w * h * scale * scale
    return F.when(drawn > max_area, scale * F.sqrt(max_area / drawn)).otherwise(scale)


def translatable(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Neither rotated nor skewed, so that a move along y is a move of one number."""
    return (F.abs(b) < 1e-6) & (F.abs(c) < 1e-6)
