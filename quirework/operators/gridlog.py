"""Edits of page grids: a log of moves, drops, removals, turns, selections and undos, replayed for each grid.

The log of a grid is put in order and folded twice, both times as expressions
over one row: first undos take back what they undo, then what is left is applied
to the grid from its beginning. Grids are dealt freely; the log and pages of one
grid, which a person made, are one row.

log: keys, seq (its order), op, item (a page by its first place, from 0), arg
and items. Operations: `move` by arg places, which does nothing beyond an end;
`drop` onto the page arg, whose place it takes; `remove`, `restore`; `rotate` to
arg degrees; `select` of exactly the pages in items; `undo` of the last operation
that isn't undone yet. Removed pages keep their place and get no number.

Results for odd input: an unknown operation, a page that isn't there and an undo
of nothing change nothing, but unknown operations can be undone as well; a null
arg is 0, null items are none; equal seq are ordered by the other columns;
a grid without log is as it began; one without pages gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "seq", "op", "item", "arg", "items"


def standing(log: Column) -> Column:
    """The operations that no undo takes back, in order."""

    def step(acc, x):
        return F.when(x["op"] == "undo", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(log, F.filter(log, lambda x: F.lit(False)), step)


def page(item: Column, rotate: Column, removed: Column, selected: Column) -> Column:
    return F.struct(item.alias("item"), rotate.alias("rotate"), removed.alias("removed"), selected.alias("selected"))


def applied(pages: Column, x: Column) -> Column:
    """The pages after one operation."""
    place = lambda item: F.array_position(F.transform(pages, lambda p: p["item"]), item).cast("int")
    at, n = place(x["item"]), F.size(pages)
    to = F.when(x["op"] == "move", at + x["arg"]).otherwise(place(x["arg"]))
    rest = F.filter(pages, lambda p: p["item"] != x["item"])
    shifted = F.concat(F.slice(rest, F.lit(1), F.greatest(to - 1, F.lit(0))), F.filter(pages, lambda p: p["item"] == x["item"]), F.slice(rest, F.greatest(to, F.lit(1)), n))
    here = lambda p: p["item"] == x["item"]
    removed = F.transform(pages, lambda p: page(p["item"], p["rotate"], F.when(here(p), x["op"] == "remove").otherwise(p["removed"]), p["selected"]))
    turned = F.transform(pages, lambda p: page(p["item"], F.when(here(p), F.pmod(x["arg"], F.lit(360))).otherwise(p["rotate"]), p["removed"], p["selected"]))
    chosen = F.transform(pages, lambda p: page(p["item"], p["rotate"], p["removed"], F.array_contains(x["items"], p["item"])))
    return (
        F.when(x["op"].isin("move", "drop") & (at > 0) & (to >= 1) & (to <= n), shifted)
        .when(x["op"].isin("remove", "restore"), removed)
        .when(x["op"] == "rotate", turned)
        .when(x["op"] == "select", chosen)
        .otherwise(pages)
    )


def replay(grids: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Each page of each grid (keys, n pages) after its log: its place from 0, item, rotate, removed, selected, its number and label."""
    integer = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    entry = F.struct("seq", "op", F.col("item").cast("int").alias("item"), integer("arg"), F.coalesce(F.col("items").cast("array<int>"), F.array().cast("array<int>")).alias("items"))
    logs = log.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("log"))
    first = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: page(i, F.lit(0), F.lit(False), F.lit(False)))
    met = grids.where("n > 0").select(*keys, first.alias("pages")).join(logs, keys, "left")
    done = F.when(F.col("log").isNull(), F.col("pages")).otherwise(F.aggregate(standing(F.col("log")), F.col("pages"), applied))
    each = met.select(*keys, done.alias("pages")).select(*keys, "pages", F.posexplode("pages").alias("place", "p"))
    before = F.size(F.filter(F.slice("pages", F.lit(1), F.col("place")), lambda p: ~p["removed"]))
    label = F.concat(F.lit("Page "), F.col("p.item") + 1, F.when(F.col("place") != F.col("p.item"), F.concat(F.lit(" → "), F.col("place") + 1)).otherwise(""))
    return each.select(*keys, "place", "p.item", "p.rotate", "p.removed", "p.selected", F.when(~F.col("p.removed"), before + 1).alias("number"), label.alias("label"))
