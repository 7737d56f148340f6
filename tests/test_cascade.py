"""Overflow cascades against a plain walk over the pages."""

import random

import duckdb
import pytest

from quirework.operators import cascade
from quirework.plans.queries import ORACLES, QUERIES

BOTTOM, TOP, GAP = 650.0, 40.0, 12.0
PAGES = "doc long, page int, vw double, vh double, rotate int, refusal string, graphics_bottom double"
RECORDS = "doc long, page int, id int, top double, bottom double, flows boolean"


def walk(doc, edit, page, pages, records, moves):
    """(verdict, {(page, id): (to_page, new_top)}) of one edit, page by page."""
    place, at, push, depth, reached, leaving = {}, page, None, 0, 0, 0
    mine = pages[doc, page]
    while True:
        held = records.get((doc, at), [])
        dy = {r[0]: moves.get((doc, edit, r[0])) if push is None else push if (r[1] + r[2]) / 2 > 0 else None for r in held}
        over = [r for r in held if dy[r[0]] is not None and r[2] + dy[r[0]] > BOTTOM]
        gone = [r for r in held if over and r[1] >= min(o[1] for o in over) - 0.5 and (push is None or dy[r[0]] is not None)]
        p = pages[doc, at]
        if gone:
            cutoff = min(o[1] for o in over) - 0.5
            why = cascade.ROTATED if p[2] else cascade.STUCK if any(r[3] is False for r in gone) else cascade.GRAPHICS if p[4] is not None and p[4] > cutoff else None
            if why:
                return (False, why, at), {}
        lead = min((r[1] + (dy[r[0]] or 0) for r in gone), default=0)
        for r in held:
            place[at, r[0]] = (at + 1, TOP + (r[1] + (dy[r[0]] or 0) - lead)) if r in gone else (at, r[1] + (dy[r[0]] or 0))
        leaving = leaving or (len(gone) if push is None else 0)
        if not gone:
            return (True, None, None, reached, leaving), place
        push, at, depth = max(r[2] + (dy[r[0]] or 0) for r in gone) - lead + GAP, at + 1, depth + 1
        if depth > cascade.DEPTH:
            return (False, cascade.DEEP, at), {}
        reached += 1
        if (doc, at) not in pages:
            return (True, None, None, reached, leaving), place
        n = pages[doc, at]
        why = cascade.ROTATED if n[2] else cascade.RESIZED if abs(n[0] - mine[0]) > 1 or abs(n[1] - mine[1]) > 1 else n[3]
        if why:
            return (False, why, at), {}


def compare(spark, pages, records, edits, moves):
    p = spark.createDataFrame([(*k, *v) for k, v in pages.items()], PAGES)
    r = spark.createDataFrame([(*k, *x) for k, v in records.items() for x in v], RECORDS)
    e, m = spark.createDataFrame(edits, "doc long, edit int, page int"), spark.createDataFrame([(*k, v) for k, v in moves.items()], "doc long, edit int, id int, dy double")
    plan = cascade.planned(e, m, p, r, ["doc"], BOTTOM, GAP)
    got = {(x["doc"], x["edit"]): x for x in plan.collect()}
    landed = {(x["doc"], x["edit"], x["page"], x["id"]): (x["to_page"], round(x["new_top"], 6)) for x in cascade.landed(plan, m, r, ["doc"], TOP).collect()}
    seen, want = set(), {}
    for doc, edit, page in edits:
        told, place = walk(doc, edit, page, pages, records, moves)
        x = got.pop((doc, edit))
        assert (x["ok"], x["reason"], x["refused_page"]) == told[:3]
        if told[0]:
            assert (x["flowed_pages"], x["leaving"]) == told[3:]
        seen.add(told[1])
        want |= {(doc, edit, *k): (a, round(b, 6)) for k, (a, b) in place.items()}
    assert not got and landed == want
    return seen


def test_random_documents(spark):
    rng = random.Random(5)
    pages, records, edits, moves = {}, {}, [], {}
    for doc in range(200):
        n = rng.choice([1, 2, 4, 9])
        for page in range(n):
            odd = rng.random() < 0.2 and rng.randrange(1, 4)
            pages[doc, page] = (600.0 if odd == 1 else 612.0, 792.0, 90 if odd == 2 else rng.choice([0, None]), "locked" if odd == 3 else None, rng.choice([None, 100.0, 100.0, 640.0]) if rng.random() < 0.3 else None)
            held = []
            for i in range(rng.choice([0, 3, 20, 30])):
                top = rng.choice([rng.uniform(-20, 640), 20.0 * i, 20.0 * i + 0.4])
                held.append((i, top, top + rng.choice([8.0, 10.0, 10.0, 30.0]), None if rng.random() < 0.5 else rng.random() > 0.03))
            records[doc, page] = held
        for edit in range(rng.choice([1, 2])):
            page = rng.randrange(n)
            edits.append((doc, edit, page))
            line, dy = rng.uniform(0, 640), rng.choice([5.0, 20.0, 90.0])
            moves |= {(doc, edit, r[0]): dy for r in records[doc, page] if (r[1] + r[2]) / 2 > line}
    assert compare(spark, pages, records, edits, moves) >= {None, cascade.ROTATED, cascade.RESIZED, cascade.STUCK, cascade.GRAPHICS, "locked"}


def test_a_thousand_pages_and_the_depth(spark):
    full = [(i, 40.0 * i + 28.0, 40.0 * i + 40.0, True) for i in range(1, 16)]
    pages = {(1, p): (612.0, 792.0, 0, None, None) for p in range(1000)}
    records = {(1, p): full if p % 100 < 70 or p >= 930 else full[:9] for p in range(1000)}
    edits = [(1, e, p) for e, p in enumerate([0, 5, 6, 7, 60, 69, 935, 936, 999])]
    moves = {(1, e, i): 40.0 for _, e, _ in edits for i in range(9, 16)}
    assert compare(spark, pages, records, edits, moves) == {None, cascade.DEEP}


def test_nothing(spark):
    p, r = spark.createDataFrame([], PAGES), spark.createDataFrame([], RECORDS)
    e, m = spark.createDataFrame([(1, 1, 3)], "doc long, edit int, page int"), spark.createDataFrame([], "doc long, edit int, id int, dy double")
    plan = cascade.planned(e, m, p, r, ["doc"], BOTTOM)
    assert [(x["ok"], x["flowed_pages"], x["leaving"]) for x in plan.collect()] == [(True, 0, 0)]
    assert cascade.landed(plan, m, r, ["doc"], TOP).count() == 0 and cascade.planned(e.where("doc > 1"), m, p, r, ["doc"], BOTTOM).count() == 0


def shuffled(spark, frame):
    """Rows that the shuffles of a run write, with no table sent around whole."""
    sc, store = spark.sparkContext._jsc.sc(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("shuffled", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = set(spark.sparkContext.statusTracker().getJobIdsForGroup("shuffled"))
        frame.write.format("noop").mode("overwrite").save()
        sc.listenerBus().waitUntilEmpty()
        jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("shuffled")) - known
        stages = {i for j in jobs for i in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
        return sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def documents(path, texts):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    con.sql(f"COPY documents TO '{path}/documents.parquet'")
    return con


def test_verdicts_deal_pages_and_no_lines(spark, tmp_path):
    """300 texts of three pages and 45 lines: an edit meets its pages by two blocks, not page by page to the depth."""
    documents(tmp_path, [(i, "a line of text. " * 168) for i in range(300)])
    # pages, an edit's two blocks, and what an edit has met: its group and the pages in it
    assert shuffled(spark, QUERIES["flow_verdicts"](spark, str(tmp_path))) <= 300 * (3 + 2 + 3)


def test_landing_deals_pages_and_no_lines(spark, tmp_path):
    documents(tmp_path, [(i, "a line of text. " * 168) for i in range(300)])
    # besides the plan: an edit's own page, the pages that it reaches, and all pages
    assert shuffled(spark, QUERIES["flowed_records"](spark, str(tmp_path))) <= 300 * (3 + 2 + 3 + 2 + 3 + 3)


@pytest.mark.parametrize("name", ["flow_verdicts", "flowed_records"])
def test_odd_texts(spark, tmp_path, name):
    """Texts that end with a line or page, long ones, wide characters, line ends, nothing."""
    texts = ["", None, "x", "x" * 60, "x" * 899, "x" * 900, "x" * 901, "é😀\r\n" * 700, " " * 1800, "\n" * 2000, "ab cd" * 12_000, "z" * 58_500, "z" * 57_600]
    con = documents(tmp_path, [*((i * 20 + k, t) for i, t in enumerate(texts) for k in range(20)), (None, "nobody's")])
    plain = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert plain(got.select(want.columns).collect()) == plain(want.fetchall())


def test_lines_that_are_not_there(spark):
    """Edits and pages without lines, a page that isn't there, tops and moves that are null."""
    own = spark.createDataFrame([(1, 0, 0, None), (1, 1, 5, []), (2, 0, 0, [(0, 600.0, 640.0, None, 20.0), (1, None, 640.0, False, 20.0), (2, 10.0, 20.0, False, None)])], "doc long, edit int, page int, lines array<struct<id: int, top: double, bottom: double, flows: boolean, dy: double>>")
    sheets = spark.createDataFrame([(1, 0, 612.0, 792.0, 0, None, None, None), (2, 0, 612.0, 792.0, None, None, 100.0, None), (2, 1, 612.0, 792.0, 0, None, None, [(7, 600.0, None, True), (8, -40.0, 30.0, True)])], "doc long, page int, vw double, vh double, rotate int, refusal string, graphics_bottom double, lines array<struct<id: int, top: double, bottom: double, flows: boolean>>")
    plan = cascade.planned_lines(own, sheets, ["doc"], BOTTOM, GAP)
    assert sorted((x["doc"], x["edit"], x["ok"], x["leaving"], x["flowed_pages"]) for x in plan.collect()) == [(1, 0, True, 0, 0), (1, 1, True, 0, 0), (2, 0, True, 1, 1)]
    assert sorted(tuple(x) for x in cascade.landed_lines(plan, own, sheets, ["doc"], TOP).collect()) == [(2, 0, 0, 0, 1, 40.0), (2, 0, 0, 2, 0, 10.0), (2, 0, 1, 7, 1, 600.0), (2, 0, 1, 8, 1, -40.0)]
