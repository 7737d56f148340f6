"""Cuts that move what lies below them, within a column band, and what forbids it.

A cut of a page has a line (below_y), a distance (dy) and maybe a band (x0, x1).
Text and graphics below the line move if they lie within the band, stay if they
lie beside it, and are a floor if they span its edge: what moves may come down to
a floor, not beyond. A page whose cut can't be made safely is refused, for the
first reason in the order of REFUSALS, by the first cut that has one.

Everything is a relation by page: objects meet the few cuts of their page in one
join, their zones are expressions, and floors and lowest edges are conditional
extremes, summed up before any shuffle of their own. So a page with any number
of objects is no single row, and pages are dealt freely.

cuts: keys, cut (their order), below_y, dy, x0, x1 (null: no edge).
objects: keys, id (order on the page, each once), kind (text, image, path or clip), x, top,
right, bottom, movable, shared (text shares an image's transform), clip_bottom
(lower edge of the clip around a path, null: none).

Results for odd input: a cut of a page without objects moves nothing; objects of
a page without a cut give no row; a null movable or shared is false; objects
without place (null) are below no cut; a null distance moves nothing and is never
too far; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How far an edge of the band may be missed, and how far a graphic may reach below a line or a floor.
EDGE, SLACK = 2.0, 0.5
#: Why a cut can't be made, by number.
REFUSALS = {
    1: "text across the band's edge crosses the cut",
    2: "text below the cut can't be moved",
    3: "graphics across the band's edge cross the cut",
    4: "an image lies across the cut",
    5: "text shares the image's transform",
    6: "a line or box lies across the cut",
    7: "a line or box would leave its clip",
    8: "graphics below the cut can't be moved",
    9: "what moves reaches the floor already",
    10: "no room is left above the floor",
}


def classified(cuts: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Each object below a cut of its page with its zone (inside, outside, spanning), whether it moves, and the number of what forbids it."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pair = cuts.join(objects, keys)
    text, banded = F.col("kind") == "text", F.col("x0").isNotNull() | F.col("x1").isNotNull()
    low, high = F.coalesce("x0", F.lit(float("-inf"))), F.coalesce("x1", F.lit(float("inf")))
    inside = (F.col("x") >= low - EDGE) & (F.col("right") <= high + EDGE)
    outside = (F.col("right") < low + EDGE) | (F.col("x") > high - EDGE)
    # text that is both, in a narrow band, is inside; a graphic outside
    zone = F.when(text, F.when(inside, "inside").when(outside, "outside").otherwise("spanning")).otherwise(F.when(banded & outside, "outside").when(banded & ~inside, "spanning").otherwise("inside"))
    below = F.when(text, (F.col("top") + F.col("bottom")) / 2 > F.col("below_y")).otherwise((F.col("kind") != "clip") & (F.col("bottom") > F.col("below_y") + SLACK))
    pair = pair.where(below).withColumn("zone", zone)
    goes = (F.col("zone") == "inside") & yes("movable")
    # what earlier cuts have moved a path by counts against its clip
    total = F.sum(F.when(goes, F.col("dy")).otherwise(0)).over(W.partitionBy(*keys, "id").orderBy("cut").rowsBetween(W.unboundedPreceding, 0))
    across = F.col("top") < F.col("below_y") - SLACK
    spanning = (F.col("zone") == "spanning") & (F.col("top") < F.col("below_y"))
    rule = (
        F.when(text, F.when(spanning, 1).when((F.col("zone") == "inside") & ~yes("movable"), 2))
        .when(spanning, 3)
        .when(F.col("zone") == "inside", F.when(~yes("movable"), 8).when(F.col("kind") == "image", F.when(across, 4).when(yes("shared"), 5)).when(across, 6).when(F.col("bottom") + total > F.col("clip_bottom") + SLACK, 7))
    )
    return pair.withColumn("moves", goes).withColumn("rule", rule)


def extents(cuts: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each cut with how many objects move, stay beside and span, its floor, the lowest edge of what moves, and its first refusal."""
    count = lambda zone: F.count(F.when(F.col("zone") == zone, 1))
    step = F.when(F.col("rule").isin(1, 2), F.col("rule")).otherwise(3)  # all text is looked at before graphics, which come one by one
    first = F.min(F.when(F.col("rule").isNotNull(), F.struct(step.alias("step"), "id", "rule")))["rule"]
    held = pairs.groupBy(*keys, "cut").agg(
        F.count(F.when(F.col("moves"), 1)).alias("n_moved"),
        count("outside").alias("n_outside"),
        count("spanning").alias("n_spanning"),
        F.min(F.when(F.col("zone") == "spanning", F.col("top"))).alias("floor"),
        F.max(F.when(F.col("moves") | ((F.col("kind") == "text") & (F.col("zone") == "inside")), F.col("bottom"))).alias("lowest"),
        first.alias("object_rule"),
    )
    each = cuts.select(*keys, "cut", "dy").join(held, [*keys, "cut"], "left")
    room = F.col("floor") - SLACK
    rule = F.coalesce("object_rule", F.when(F.col("lowest") > room, 9).when(F.col("lowest") + F.col("dy") > room, 10))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return each.select(*keys, "cut", zero("n_moved"), zero("n_outside"), zero("n_spanning"), "floor", "lowest", rule.cast("int").alias("rule"))


def reason(rule: Column) -> Column:
    return F.get(F.array(F.lit(None).cast("string"), *(F.lit(REFUSALS[i]) for i in range(1, len(REFUSALS) + 1))), F.coalesce(rule, F.lit(0)))


def page_verdicts(extended: DataFrame, keys: list[str]) -> DataFrame:
    """Each page with cuts: whether all can be made, else the first cut that can't, and why."""
    first = F.min(F.when(F.col("rule").isNotNull(), F.struct("cut", "rule"))).alias("f")
    return extended.groupBy(*keys).agg(first).select(*keys, F.col("f").isNull().alias("ok"), F.col("f.cut").alias("refused_cut"), reason(F.col("f.rule")).alias("reason"))


def moved(pairs: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The objects that move, of pages all of whose cuts can be made, and by how much in all."""
    sums = pairs.where("moves").groupBy(*keys, "id", "kind").agg(F.sum("dy").alias("dy"), F.min("top").alias("top"))
    return sums.join(verdicts.where("ok").select(*keys), keys, "left_semi").select(*keys, "id", "kind", "dy", (F.col("top") + F.col("dy")).alias("new_top"))
