"""Text that an edit pushes off its page, and on to the pages that follow: the plan, before anything is written.

What leaves a page lands at the top of the next, whose text makes room for it
and may leave in turn, up to DEPTH pages on, or past the last on to a new one. If
any page on the way can't take part, the whole edit is refused.

How much leaves a page depends on its records and on how far they are pushed
alone: the lowest go first, and the further the push the more go. So a page is
one row with the tops and bottoms of its records. Edits meet pages by blocks of
DEPTH pages, and an edit folds those behind its own, DEPTH at most, in one
expression; a document is never one group, however many pages it has, and its
edits are planned side by side. Where each record lands is a join on pages.

Who has the records of a page in one row (lines) plans with planned_lines and
landed_lines, where no record is dealt by itself; planned and landed take tables
of records and gather them first.

pages: keys, page (without gaps), vw, vh, rotate, refusal (why its text can't be
moved down as a whole, null: it can), graphics_bottom (lowest edge of graphics
other than clips, null: none).
records: keys, page, id (each once a page), top, bottom, flows (whether it can be
written on another page).
edits: keys, edit, page. moves: keys, edit, id, dy (records of that page).
sheets: pages with lines, an array of (id, top, bottom, flows) in any order.
own: edits with lines, the records of their page as (id, top, bottom, flows, dy).

Results for odd input: an edit without moves, or of a page that isn't there,
pushes nothing off and is planned as it is; records without place (null) stay,
as do those of a following page whose middle is above it; a null in flows counts
as true; a null rotate as 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pages that a cascade may reach, what is carried with a record whose top is so little higher, and how far sizes may differ.
DEPTH, SLACK, SIZE = 64, 0.5, 1.0
ROTATED, RESIZED, STUCK, GRAPHICS, DEEP = "the page is rotated", "the page has another size", "text that would leave can't be written elsewhere", "graphics would have to leave", "the cascade is too deep"
HOP = "page: int, push: double, cutoff: double, lead: double, fresh: boolean"


def lined(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, lines) of the pages that have records."""
    return records.groupBy(*keys, "page").agg(F.collect_list(F.struct("id", "top", "bottom", "flows")).alias("lines"))


def moved(edits: DataFrame, moves: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """edits with lines (null: none), the records of their page with dy (null: not moved)."""
    mine = edits.select(*keys, "edit", "page")
    on = mine.join(records, [*keys, "page"]).join(moves.select(*keys, "edit", "id", "dy"), [*keys, "edit", "id"], "left")
    return mine.join(on.groupBy(*keys, "edit").agg(F.collect_list(F.struct("id", "top", "bottom", "flows", "dy")).alias("lines")), [*keys, "edit"], "left")


def started(own: DataFrame, keys: list[str], bottom_y: float) -> DataFrame:
    """Each edit with cutoff, lead and lowest of what leaves (null: nothing), how much that is (leaving), and whether some of it is stuck."""
    dy = lambda r: F.coalesce(r["dy"], F.lit(0.0))
    over = F.filter("lines", lambda r: r["dy"].isNotNull() & (r["bottom"] + r["dy"] > bottom_y))
    cut = own.select(*keys, "edit", "page", "lines", (F.array_min(F.transform(over, lambda r: r["top"])) - SLACK).alias("cutoff"))
    gone = cut.select(*keys, "edit", "page", "cutoff", F.filter("lines", lambda r: r["top"] >= F.col("cutoff")).alias("__gone"))
    ends = [F.array_min(F.transform("__gone", lambda r: r["top"] + dy(r))).alias("lead"), F.array_max(F.transform("__gone", lambda r: r["bottom"] + dy(r))).alias("lowest")]
    return gone.select(*keys, "edit", "page", "cutoff", *ends, F.coalesce(F.size("__gone"), F.lit(0)).alias("leaving"), F.exists("__gone", lambda r: ~F.coalesce(r["flows"], F.lit(True))).alias("stuck"))


def folded(follow: Column, carry: Column, vw: Column, vh: Column, bottom_y: float, gap: float) -> Column:
    """(carry, reason, refused_page, hops) after the pages of follow, in their order."""
    none = lambda kind: F.lit(None).cast(kind)
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    made = lambda carry, reason, refused, hops: F.struct(carry.alias("carry"), reason.alias("reason"), refused.alias("refused_page"), hops.alias("hops"))

    def hop(at, push, cutoff, lead):
        return F.struct(at.cast("int").alias("page"), push.alias("push"), cutoff.alias("cutoff"), lead.alias("lead"), F.lit(False).alias("fresh"))

    def judged(done: Column, p: Column, push: Column, cutoff: Column) -> Column:
        why = (
            F.when(F.coalesce(p["rotate"], F.lit(0)) != 0, ROTATED)
            .when((F.abs(p["vw"] - vw) > SIZE) | (F.abs(p["vh"] - vh) > SIZE), RESIZED)
            .when(p["refusal"].isNotNull(), p["refusal"])
            .when(p["stuck"] >= cutoff, STUCK)
            .when(p["graphics_bottom"] > cutoff, GRAPHICS)
        )
        refused = made(none("double"), why, p["page"].cast("int"), done["hops"])

        def onward(lead: Column) -> Column:
            return made(F.array_max(p["bottoms"]) - lead, none("string"), none("int"), F.concat(done["hops"], F.array(hop(p["page"], push, cutoff, lead))))

        return F.when(why.isNotNull(), refused).otherwise(let(F.array_min(F.filter(p["tops"], lambda top: top >= cutoff)), onward))

    def step(done: Column, p: Column) -> Column:
        push = done["carry"] + gap
        over = F.zip_with(p["tops"], p["bottoms"], lambda top, bottom: F.when(bottom + push > bottom_y, top))
        return F.when(done["carry"].isNull(), done).otherwise(let(F.array_min(over) - SLACK, lambda cutoff: judged(done, p, push, cutoff)))

    start = made(carry, none("string"), none("int"), F.expr(f"cast(array() as array<struct<{HOP}>>)"))
    return F.aggregate(follow, start, step)


def met(first: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """first, a row for each edit, with __met: its page and the DEPTH pages behind it, in their order."""
    placed = sheets.withColumn("__placed", F.filter("lines", lambda r: (r["top"] + r["bottom"]) / 2 > 0))
    each = lambda f: F.transform("__placed", f)
    stuck = F.array_max(each(lambda r: F.when(~F.coalesce(r["flows"], F.lit(True)), r["top"])))
    page = placed.select(
        *(F.col(k).alias(f"__of_{k}") for k in keys), F.col("page").alias("__at"), F.floor(F.col("page") / DEPTH).alias("__in"),
        F.struct(F.col("page").cast("int").alias("page"), "rotate", "vw", "vh", "refusal", "graphics_bottom", each(lambda r: r["top"]).alias("tops"), each(lambda r: r["bottom"]).alias("bottoms"), stuck.alias("stuck")).alias("__page"),
    )
    # DEPTH + 1 pages lie in two blocks, whichever the first is; an edit that nothing leaves needs none
    blocks = F.when(F.col("cutoff").isNotNull(), F.array(*(F.floor(p / DEPTH) for p in (F.col("page"), F.col("page") + DEPTH))))
    wanted = first.select(*keys, "edit", "page", F.struct(*(c for c in first.columns if c not in (*keys, "edit", "page"))).alias("__first"), F.posexplode_outer(blocks).alias("__k", "__block"))
    on = (F.col("__block") == F.col("__in")) & F.col("__at").between(F.col("page"), F.col("page") + DEPTH)
    for k in keys:
        on &= F.col(k) == F.col(f"__of_{k}")
    # an edit without any page keeps the row of its first block
    found = wanted.join(page, on, "left").where("__at IS NOT NULL OR coalesce(__k, 0) = 0")
    rows = found.groupBy(*keys, "edit", "page").agg(F.first("__first").alias("__first"), F.array_sort(F.collect_list(F.when(F.col("__at").isNotNull(), F.col("__page")))).alias("__met"))
    return rows.select(*keys, "edit", "page", "__first.*", "__met")


def planned_lines(own: DataFrame, sheets: DataFrame, keys: list[str], bottom_y: float, gap: float = 12.0) -> DataFrame:
    """Each edit with ok, reason, refused_page, leaving (records that leave its page), flowed_pages, and the pages it reaches (hops, the edit's own not among them)."""
    rows = met(started(own, keys, bottom_y), sheets, keys)
    at = F.get("__met", F.lit(0))
    known = rows.withColumns({"__mine": F.when(at["page"] == F.col("page"), at), "__follow": F.filter("__met", lambda p: p["page"] > F.col("page"))}).drop("__met")
    mine = lambda c: F.col(f"__mine.{c}")
    leaves = F.col("cutoff").isNotNull()
    why = F.when(leaves, F.when(F.coalesce(mine("rotate"), F.lit(0)) != 0, ROTATED).when(F.col("stuck"), STUCK).when(mine("graphics_bottom") > F.col("cutoff"), GRAPHICS))
    first = known.withColumn("__why", why).withColumn("carry", F.when(leaves & F.col("__why").isNull(), F.col("lowest") - F.col("lead")).cast("double"))
    got = first.withColumns({"__there": F.size("__follow"), "__end": folded(F.col("__follow"), F.col("carry"), mine("vw"), mine("vh"), bottom_y, gap)})
    # what no page has taken in goes on to a new one, if the document ends before the depth
    rest = F.col("__end.carry").isNotNull()
    fresh, deep = rest & (F.col("__there") < DEPTH), rest & (F.col("__there") >= DEPTH)
    reason = F.coalesce("__why", "__end.reason", F.when(deep, F.lit(DEEP)))
    where = F.when(F.col("__why").isNotNull(), F.col("page")).when(deep, F.col("page") + DEPTH + 1).otherwise(F.col("__end.refused_page")).cast("int")
    empty = F.expr(f"cast(array() as array<struct<{HOP}>>)")
    new = F.struct((F.col("page") + F.col("__there") + 1).cast("int").alias("page"), *(F.lit(None).cast("double").alias(c) for c in ("push", "cutoff", "lead")), F.lit(True).alias("fresh"))
    ok = reason.isNull()
    hops = F.when(ok, F.concat("__end.hops", F.when(fresh, F.array(new)).otherwise(empty)))
    return got.select(*keys, "edit", F.col("page").cast("int").alias("page"), ok.alias("ok"), reason.alias("reason"), where.alias("refused_page"), F.col("leaving").cast("long").alias("leaving"), F.coalesce(F.size(hops), F.lit(0)).alias("flowed_pages"), "cutoff", "lead", hops.alias("hops"))


def planned(edits: DataFrame, moves: DataFrame, pages: DataFrame, records: DataFrame, keys: list[str], bottom_y: float, gap: float = 12.0) -> DataFrame:
    """planned_lines of tables of records."""
    sheets = pages.join(lined(records, keys), [*keys, "page"], "left")
    return planned_lines(moved(edits, moves, records, keys), sheets, keys, bottom_y, gap)


def landed_lines(plan: DataFrame, own: DataFrame, sheets: DataFrame, keys: list[str], top_y: float) -> DataFrame:
    """(keys, edit, page, id, to_page, new_top) of each record of the pages that a planned edit touches."""
    middle = lambda r: F.coalesce((r["top"] + r["bottom"]) / 2 > 0, F.lit(False))
    line = lambda r, push, goes: F.struct(r["id"].alias("id"), r["top"].alias("top"), push.alias("push"), goes.alias("goes"))
    at_home = F.transform(F.filter("lines", lambda r: r["top"].isNotNull()), lambda r: line(r, F.coalesce(r["dy"], F.lit(0.0)), F.lit(True)))
    hop = lambda page, push, cutoff, lead, home: F.struct(page.alias("page"), push.alias("push"), cutoff.alias("cutoff"), lead.alias("lead"), F.lit(home).alias("home"))
    away = F.transform(F.filter("hops", lambda h: ~h["fresh"]), lambda h: hop(h["page"], h["push"], h["cutoff"], h["lead"] + h["push"], False))
    home = hop(F.col("page"), F.lit(None).cast("double"), F.col("cutoff"), F.col("lead"), True)
    # the plan is made once: its own page is one more page that an edit touches, whose lines it brings along
    each = plan.join(own.select(*keys, "edit", at_home.alias("__lines")), [*keys, "edit"], "left").select(*keys, "edit", "__lines", F.explode(F.when(F.col("ok"), F.concat(F.array(home), away))).alias("__h"))
    touched = each.select(*keys, "edit", F.when(F.col("__h.home"), F.col("__lines")).alias("__lines"), "__h.*")
    part = lambda c: F.transform(F.filter("lines", lambda r: r["top"].isNotNull()), lambda r: r[c])
    held = sheets.select(*keys, "page", *(part(c).alias(f"__{c}") for c in ("id", "top", "bottom")))
    found = F.transform(F.arrays_zip(F.col("__id").alias("id"), F.col("__top").alias("top"), F.col("__bottom").alias("bottom")), lambda r: line(r, F.when(middle(r), F.col("push")).otherwise(0.0), middle(r)))
    every = touched.join(held, [*keys, "page"], "left").select(*keys, "edit", "page", "cutoff", "lead", F.explode(F.when(F.col("home"), F.col("__lines")).otherwise(found)).alias("r"))
    leaves = F.col("r.goes") & F.coalesce(F.col("r.top") >= F.col("cutoff"), F.lit(False))
    at = F.col("r.top") + F.col("r.push")
    new_top = F.when(leaves, top_y + (at - F.col("lead"))).otherwise(at)
    return every.select(*keys, "edit", F.col("page").cast("int").alias("page"), "r.id", (F.col("page") + leaves.cast("int")).cast("int").alias("to_page"), new_top.alias("new_top"))


def landed(plan: DataFrame, moves: DataFrame, records: DataFrame, keys: list[str], top_y: float) -> DataFrame:
    """landed_lines of tables of records."""
    return landed_lines(plan, moved(plan, moves, records, keys), lined(records, keys), keys, top_y)
