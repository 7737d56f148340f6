"""Column bands, floors and refusals of cuts against a plain walk over a page."""

import random
from collections import Counter

from quirework.operators import bands
from quirework.plans.queries import QUERIES

CUTS = "page long, cut int, below_y double, dy double, x0 double, x1 double"
OBJECTS = "page long, id long, kind string, x double, top double, right double, bottom double, movable boolean, shared boolean, clip_bottom double"
INF = float("inf")


def walk(cuts, objects):
    """(refused cut, rule) or the sums of dy by id."""
    moves = Counter()
    for _, cut, line, dy, x0, x1 in cuts:
        low, high = -INF if x0 is None else x0, INF if x1 is None else x1
        inside = lambda o: o[3] >= low - 2 and o[5] <= high + 2  # noqa: B023, E731
        outside = lambda o: o[5] < low + 2 or o[3] > high - 2  # noqa: B023, E731
        goes, floor = [], INF
        for o in (o for o in objects if o[2] == "text" and (o[4] + o[6]) / 2 > line):
            if inside(o):
                goes.append(o)
            elif not outside(o):
                if o[4] < line:
                    return cut, 1
                floor = min(floor, o[4])
        if any(not o[7] for o in goes):
            return cut, 2
        for o in (o for o in objects if o[2] in ("image", "path") and o[6] > line + 0.5):
            if x0 is not None or x1 is not None:
                if outside(o):
                    continue
                if not inside(o):
                    if o[4] < line:
                        return cut, 3
                    floor = min(floor, o[4])
                    continue
            if not o[7]:
                return cut, 8
            if o[4] < line - 0.5:
                return cut, 4 if o[2] == "image" else 6
            if o[2] == "image" and o[8]:
                return cut, 5
            if o[2] == "path" and o[9] is not None and o[6] + moves[o[1]] + dy > o[9] + 0.5:
                return cut, 7
            goes.append(o)
        lowest = max((o[6] for o in goes), default=-INF)
        if lowest > floor - 0.5:
            return cut, 9
        if lowest + dy > floor - 0.5:
            return cut, 10
        for o in goes:
            moves[o[1]] += dy
    return dict(moves)


def test_bands_against_a_plain_walk(spark):
    rng = random.Random(1)
    cuts, objects = [], []
    for page in range(700):
        for cut in range(rng.randint(1, 3)):
            x0, x1 = rng.choice([(None, None), (None, 50.0), (40.0, None), (20.0, 60.0), (30.0, 31.0)])
            cuts.append((page, cut, float(rng.randint(0, 80)), rng.choice([2.0, 10.0]), x0, x1))
        for i in range(rng.randint(0, 5)):
            x, top = rng.randint(0, 80), rng.randint(0, 100)
            bottom = top + rng.choice([0.5, 5.0, 20.0])
            objects.append((page, i, rng.choice(["text", "text", "image", "path", "clip"]), float(x), float(top), float(x + rng.randint(0, 40)), bottom, rng.random() < 0.9, rng.random() < 0.2, rng.choice([None, bottom + 3, bottom + 15])))
    c, o = spark.createDataFrame(cuts, CUTS), spark.createDataFrame(objects, OBJECTS)
    pairs = bands.classified(c, o, ["page"])
    extents = bands.extents(c, pairs, ["page"])
    verdicts = bands.page_verdicts(extents, ["page"])
    got = {r["page"]: (r["refused_cut"], r["reason"]) for r in verdicts.collect() if not r["ok"]}
    moved = {(r["page"], r["id"]): r["dy"] for r in bands.moved(pairs, verdicts, ["page"]).collect()}
    want = {p: walk([x for x in cuts if x[0] == p], [x for x in objects if x[0] == p]) for p in range(700)}
    assert got == {p: (w[0], bands.REFUSALS[w[1]]) for p, w in want.items() if isinstance(w, tuple)}
    assert moved == {(p, i): dy for p, w in want.items() if isinstance(w, dict) for i, dy in w.items()}
    assert {w[1] for w in want.values() if isinstance(w, tuple)} == set(bands.REFUSALS) and moved
    assert extents.count() == len(cuts)


def test_odd_rows(spark):
    c = spark.createDataFrame([(1, 0, 10.0, 5.0, None, None), (2, 0, 10.0, None, 0.0, 9.0)], CUTS)
    o = spark.createDataFrame([(2, 1, "text", None, None, None, None, True, False, None), (3, 1, "path", 0.0, 20.0, 5.0, 25.0, True, False, None), (2, 2, "image", 1.0, 20.0, 5.0, 25.0, None, None, None)], OBJECTS)
    got = {r["page"]: (r["n_moved"], r["rule"]) for r in bands.extents(c, bands.classified(c, o, ["page"]), ["page"]).collect()}
    assert got == {1: (0, None), 2: (0, 8)}
    for empty in (c.limit(0), c):
        assert bands.extents(empty, bands.classified(empty, o.limit(0), ["page"]), ["page"]).count() == empty.count()


def test_every_refusal_occurs_in_the_query(spark):
    sf = "/root/testdata/sf0.01"
    assert {r["rule"] for r in QUERIES["band_extents"](spark, sf).select("rule").distinct().collect()} == {None, *bands.REFUSALS}
