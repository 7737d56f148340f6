"""Logs of page grids against lists that are spliced, quantile cuts of orders, and settings that stay."""

import random
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from quirework.operators import gridlog, merge
from quirework.operators.raster import prepare_pages
from quirework.plans.queries import QUERIES
from quirework.sources.archives import read_zip
from quirework.sources.pdf import read_pages, write_pdf

LOG = "grid string, seq long, op string, item int, arg int, items array<int>"


def plain(n, log):
    past = [[{"item": i, "rotate": 0, "removed": False, "selected": False} for i in range(n)]]
    for _, _, op, item, arg, items in log:
        if op == "undo":
            past = past[:-1] or past
            continue
        now = [dict(p) for p in past[-1]]
        at = {p["item"]: k for k, p in enumerate(now)}
        if op in ("move", "drop") and item in at:
            to = at[item] + (arg or 0) if op == "move" else at.get(arg or 0, -1)
            if 0 <= to < n:
                now.insert(to, now.pop(at[item]))
        for p in now:
            if p["item"] == item and op in ("remove", "restore"):
                p["removed"] = op == "remove"
            if p["item"] == item and op == "rotate":
                p["rotate"] = (arg or 0) % 360
            if op == "select":
                p["selected"] = p["item"] in (items or [])
        past.append(now)
    return past[-1]


def test_logs_are_replayed_as_lists_are_spliced(spark):
    rng = random.Random(2)
    grids = [(f"g{i}", rng.randint(1, 9)) for i in range(60)] + [("none", 0), ("still", 3)]
    logs = {g: [(g, k, rng.choice(["move", "move", "drop", "drop", "remove", "restore", "rotate", "select", "undo", "what"]), rng.choice([*range(n + 1), None]), rng.choice([1, -1, 2, 90, -450, 0, None]), rng.choice([None, [], [0, 1]])) for k in range(rng.randint(0, 25))] for g, n in grids[:60]}
    rows = [r for log in logs.values() for r in log]
    rng.shuffle(rows)
    got = gridlog.replay(spark.createDataFrame(grids, "grid string, n int"), spark.createDataFrame(rows, LOG), ["grid"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["grid"], r["place"])):
        by.setdefault(r["grid"], []).append(r)
    assert by.keys() == {g for g, n in grids if n}
    for g, n in grids:
        want = plain(n, logs.get(g, [])) if n else []
        mine = by.get(g, [])
        assert [{k: r[k] for k in ("item", "rotate", "removed", "selected")} for r in mine] == want, g
        numbers = iter(range(1, n + 1))
        assert [r["number"] for r in mine] == [None if p["removed"] else next(numbers) for p in want]
        assert [r["label"] for r in mine] == [f"Page {p['item'] + 1}" + (f" → {k + 1}" if k != p["item"] else "") for k, p in enumerate(want)]


def test_a_far_off_order_leaves_the_parts_even(spark):
    rows = [("k", i % 5000, f"f{i}", 1 + i % 3) for i in range(6000)] + [("k", 10**15, "far", 2), ("other", -(10**12), "near", 1), ("k", None, "unplaced", 4)]
    df = spark.createDataFrame(rows, "key string, ord long, name string, pages int")
    cuts = df.agg(F.percentile_approx("ord", [i / 256 for i in range(1, 256)], 2560)).first()[0]
    parts = df.select(F.coalesce(merge.part_of(F.col("ord"), sorted(set(cuts))), F.lit(-1)).alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 200
    got = {(r["key"], r["name"]): r["n"] for r in merge.before(df, ["key"], "ord", F.col("pages"), "n", ("name",)).collect()}
    want, total = {}, {}
    for key, _, name, pages in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want[key, name] = total.get(key, 0)
        total[key] = want[key, name] + pages
    assert got == want


def test_equal_orders_are_numbered_by_name(spark):
    files = spark.createDataFrame([("k", 1, n, 1, False) for n in "dbca"], "key string, ord long, name string, pages int, bad boolean").withColumn("loading", F.lit(False))
    for n in (1, 3):
        assert [r["name"] for r in merge.manifest(files.repartition(n), ["key"]).orderBy("page").collect()] == list("abcd")


def test_settings_stay_when_plans_are_built_and_archives_are_read(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    prepare_pages(spark.createDataFrame([(1, 1, 1, bytearray(b"\x00"))], "page int, w int, h int, luma binary"), ["page"])
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x")
        z.writestr("b/c.txt", "yy")
    zips = spark.createDataFrame([("z", bytearray(out.getvalue())), ("bad", bytearray(b"no archive")), ("null", None)], "doc_id string, data binary")
    assert sorted((r["doc_id"], r["entry"] or 0, r["name"] or "", bytes(r["data"] or b"")) for r in read_zip(zips).collect()) == [("bad", 0, "", b""), ("null", 0, "", b""), ("z", 0, "a.txt", b"x"), ("z", 1, "b/c.txt", b"yy")]
    pdfs = spark.createDataFrame([("p", bytearray(write_pdf([{"w": 10, "h": 10, "content": b""}] * 3)))], "doc_id string, data binary")
    assert read_pages(pdfs).count() == 3
    for query in ("raster_statistics", "merge_manifest"):
        QUERIES[query](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(name) == before
