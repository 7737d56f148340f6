"""The fold, the audit and what it rests on, each kind with a negative twin."""

import pytest
from pyspark.sql import functions as F

from quirework.operators.audit import Audit
from quirework.operators.pagefold import PAGE, Page, View, tokens
from quirework.sources.fonts import Font, parse_to_unicode
from quirework.sources.pdf import open_pdf, page_count, read_pages, write_pdf

FONT = [("F1", {"subtype": "Type1", "base_font": "Helvetica"})]
TEXT = "BT /F1 10 Tf 1 0 0 1 100 700 Tm (secret word) Tj ET\n"
COVER = "0 g 100 697.8 30 11 re f\n"


def page(content, **more):
    return {"doc_id": 1, "page": 0, "box": {"x": 0.0, "y": 0.0, "w": 612.0, "h": 792.0}, "rotate": 0, "content": content.encode("latin-1"), "fonts": FONT, "gs_alpha": [("Faint", 0.49), ("Half", 0.5)], "hidden_names": ["Off"], "images": [], "annots": []} | more


def relation(spark, *rows):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(f"doc_id long, page int, {PAGE}"))
    return spark.createDataFrame(pa.Table.from_pylist([dict(r, page=i) for i, r in enumerate(rows)], schema=schema))


def audit(spark, *rows, **options):
    return Audit(relation(spark, *rows), **options)


CASES = [
    (TEXT + COVER, "text-under-cover", "secret"),
    (COVER + TEXT, None, None),
    (TEXT + "/Faint gs " + COVER, None, None),
    (TEXT + "/Half gs " + COVER, "text-under-cover", "secret"),
    (TEXT + "100 697.8 30 11 re S\n", None, None),
    (TEXT + "130 697.8 5 11 re f\n", None, None),
    (TEXT + "100 697.8 1 1 re f\n", None, None),
    (TEXT + "0 0 612 792 re f\n", "text-under-cover", "secret word"),
    (TEXT.replace("10 Tf", "10 Tf 3 Tr"), "invisible-text", "secret word"),
    ("/OC /Off BDC " + TEXT + "EMC\n", "hidden-layer-text", "secret word"),
    ("/OC /On BDC " + TEXT + "EMC\n", None, None),
]


def test_each_kind_and_its_twin(spark):
    a = audit(spark, *(page(c) for c, _, _ in CASES))
    got = {r["page"]: (r["kind"], r["text"]) for r in a.findings().collect()}
    assert got == {i: (k, t) for i, (_, k, t) in enumerate(CASES) if k}
    brute = audit(spark, *(page(c) for c, _, _ in CASES), use_grid=False)
    assert got == {r["page"]: (r["kind"], r["text"]) for r in brute.findings().collect()}


def test_annotation_comes_last_and_forms_are_never_clean(spark):
    note = [{"subtype": "Square", "x": 99.0, "top": 80.0, "right": 131.0, "bottom": 96.0}]
    a = audit(spark, page(TEXT, annots=note), page(TEXT + COVER, annots=note), page("/X Do"), dict(page(""), content=None), page(TEXT))
    assert {r["page"]: r["kind"] for r in a.findings().collect()} == {0: "annotation-cover", 1: "text-under-cover"}
    assert {r["page"]: r["verdict"] for r in a.page_verdicts().collect()} == {0: "text-found", 1: "text-found", 2: "cannot-check", 3: "cannot-check", 4: "no-findings"}
    assert a.document_verdicts().first()["verdict"] == "text-found"


def test_budget_ends_the_page(spark):
    lines = "".join(TEXT.replace("700", str(700 - 20 * i)) + COVER.replace("697.8", f"{697.8 - 20 * i:.1f}") for i in range(4))
    full = audit(spark, page(lines)).page_verdicts().first()
    cut = audit(spark, page(lines), budget=full["comparisons"] - 1).page_verdicts().first()
    assert full["n_findings"] == 4 and not full["incomplete"]
    assert cut["n_findings"] == 3 and cut["incomplete"] and cut["comparisons"] == full["comparisons"]


def test_tokens():
    got = [(t.kind, t.value) for t in tokens(rb"/A#20b (x\(\)\101(y)\n) <4a4> [1 -.5] << /K true >> % no" + b"\nBI /W 1 ID xx EI Q")]
    assert got == [("name", "A b"), ("str", b"x()A(y)\n"), ("str", b"J@"), ("arrayopen", None), ("num", 1.0), ("num", -0.5), ("arrayclose", None), ("dictopen", None), ("name", "K"), ("op", "true"), ("dictclose", None), ("op", "BI..EI"), ("op", "Q")]


@pytest.mark.parametrize("rotate", [0, 90, 180, 270])
def test_view_keeps_areas(rotate):
    r = View(5, 7, 600, 800, rotate).rect([(15, 27), (45, 67)])
    assert round((r["right"] - r["x"]) * (r["bottom"] - r["top"])) == 1200


def test_text_state_outlives_restore():
    p = Page(View(0, 0, 612, 792, 0), {"F1": Font("F1")}).run(b"q 1 0 0 rg BT /F1 10 Tf (a) Tj ET Q BT (b) Tj ET 0 0 9 9 re f")
    assert [r["text"] for r in p.records] == ["a", "b"]
    assert p.covers[0]["color_space"] == "gray"


def test_character_map():
    assert parse_to_unicode("beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <0062> <04> <05> [<0078> <0079>] endbfrange") == {1: "A", 2: "b", 3: "c", 4: "x", 5: "y"}


def test_pdf_round_trip(spark):
    data = write_pdf([{"w": 612, "h": 792, "content": (TEXT + COVER).encode()}, {"w": 612, "h": 792, "content": TEXT.encode()}])
    assert page_count(data) == 2 and open_pdf(b"nothing")[1] == "damaged"
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"%PDF-1.4"))], "doc_id long, data binary")
    pages = read_pages(files)
    assert {(r["doc_id"], r["page"], r["err"]) for r in pages.select("doc_id", "page", "err").collect()} == {(1, 0, None), (1, 1, None), (2, None, "damaged")}
    assert [r["text"] for r in Audit(pages.where("page IS NOT NULL")).findings().collect()] == ["secret"]


def test_ranges(spark):
    from quirework.functions.ranges import parse_ranges

    rows = spark.createDataFrame([("3-1, 2,2",), ("",), ("0",), ("9",), ("x",), (None,)], "s string").select(parse_ranges(F.col("s"), F.lit(5)).alias("r")).collect()
    assert rows[0]["r"]["pages"] == [2, 1, 0, 1, 1]
    assert [r["r"]["error"] for r in rows[1:]] == ["no pages given", "pages start at 1", "page out of range", "not a page or range", "no pages given"]


def test_rasters():
    import numpy as np

    from quirework.operators import raster

    flat = np.full((200, 200), 250, np.uint8)
    assert raster.illumination_spread(flat) == 0 and raster.estimate_skew(flat) == 0 and not raster.multi_column(flat)
    lines = flat.copy()
    lines[::8, 10:190] = lines[1::8, 10:190] = 0
    assert not raster.multi_column(lines)
    two = lines.copy()
    two[:, 95:105] = 250
    assert raster.multi_column(two)
    shade = np.linspace(120, 250, 200).astype(np.uint8)[None, :].repeat(200, 0)
    assert raster.illumination_spread(shade) >= 25 and raster.prepare(shade)[1]["binarised"]
    y, x = np.mgrid[0:300, 0:300]
    slant = np.where(((y - np.tan(np.deg2rad(2)) * x) % 12 < 3) & (x > 20) & (x < 280), 0, 255).astype(np.uint8)
    assert abs(np.rad2deg(raster.estimate_skew(slant)) - 2) <= 0.5


def test_raster_query_draws_every_page_in_many_tasks(spark):
    import numpy as np

    from quirework.operators import raster
    from quirework.plans.queries import QUERIES

    got = QUERIES["raster_statistics"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    y, x = np.mgrid[0:60, 0:80]

    def stats(k):
        paper = 255 - x if k % 2 == 0 else np.full((60, 80), 250)
        return raster.prepare(np.where((y % 8 < 3) & ~((k % 3 == 1) & (x >= 36) & (x <= 43)), 40, paper).astype(np.uint8))[1]

    keys = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey").collect()]
    assert {r["p_partkey"]: (r["spread"], r["binarised"], r["skew"], r["columns"]) for r in got.collect()} == {k: tuple(stats(k).values()) for k in keys}


def test_statistics_over_all_angles_and_cells_at_once():
    import numpy as np

    from quirework.operators import raster

    rng = np.random.default_rng(3)
    for h, w in ((60, 80), (7, 200), (300, 90), (3, 5)):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        a[::6] = 0
        small = raster.shrink(a, raster.SKEW_SIDE)
        (sh, sw), (y, x) = small.shape, np.nonzero(small < raster.SKEW_INK)
        angles = [np.deg2rad(-5 + k * 0.25) for k in range(41)]
        rows = [np.rint((y - sh / 2) * np.cos(t) - (x - sw / 2) * np.sin(t)).astype(int) for t in angles]
        plain = float(angles[int(np.argmax([np.bincount(r - r.min()).var() for r in rows]))])
        assert raster.estimate_skew(a) == (plain if len(y) >= raster.SKEW_PIXELS and abs(plain) > raster.SKEW_LEAST else 0.0)
        small = raster.shrink(a, raster.SPREAD_SIDE)
        sh, sw = small.shape
        cells = [np.sort(c, axis=None) for i in range(8) for j in range(8) if (c := small[i * sh // 8 : (i + 1) * sh // 8, j * sw // 8 : (j + 1) * sw // 8]).size]
        levels = [int(c[min(len(c) - 1, int(len(c) * 0.9))]) for c in cells]
        assert raster.illumination_spread(a) == max(levels) - min(levels)
        assert raster.prepare(a, with_raster=False) == (None, raster.prepare(a)[1])


ODD = (
    rb"BT /F1 10 Tf 1 0 0 1 9 700 Tm (a\(b\)\101 (c)) Tj ET", rb"/F1 8 Tf(a)Tj(b)'1 2(c)" + b'"' + rb" [(d)-20<65>] TJ % (no) Tj" + b"\n(e) Tj", b"q 1 0 0 rg\r0 0 9 9 re\rf Q BI /W 1 ID (x EI /F1 9 Tf (f) Tj",
    b"/F1 9 Tf 3\nTr (g)\nTj /OC /Off BDC (h) Tj EMC nope << /A (b) >> what (i) Tj 1 2", b"/F1 9 Tf (never closed", b"} ) > (j) /F1 9 Tf (k) Tj -.5.5 TL 1e400 0 Td (l) Tj", b"/F1 9 Tf " + b"1 0 0 1 0 5 cm " * 40 + b"(m) Tj", b"",
)


@pytest.mark.parametrize("content", ODD)
def test_pieces_are_read_as_tokens_are(content):
    whole, each = (Page(View(0, 0, 612, 792, 0), {"F1": Font.of("F1", {"base_font": "Helvetica"})}, hidden=frozenset(["Off"])) for _ in range(2))
    whole.run(content)
    each.base, args = 0, []
    for token in tokens(content):
        if token.kind == "op":
            each.step(token.value, tuple(args), tuple(a.number for a in args), token.s, token.e)
            args = []
        else:
            args.append(token)
    told = lambda p: repr([[(k, v) for r in p.records for k, v in r.items() if k != "chars"], [r["chars"].unis for r in p.records], p.covers, p.spans, p.graphics, p.unknown, p.forms])
    assert told(whole) == told(each)


@pytest.mark.parametrize("name", ["text_records", "used_codes", "standard_widths", "edit_refusals", "audit_counters", "audit_budget", "audit_report"])
def test_a_page_is_drawn_and_folded_in_one_pass(spark, name):
    from quirework.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_overlaps_are_joined_by_blocks_of_cells(spark):
    import random

    from quirework.operators.spatial import BLOCK, overlap_join

    random.seed(3)
    made = [[(i % 2, i, x, y, x + random.choice((0.0, 3.0, 90.0)), y + random.choice((1.0, 70.0))) for i in range(60) for x, y in [(random.uniform(-150, 150), random.choice((-64.0, 0.0, 64.0, 17.5)))]] for _ in "lr"]
    left, right = (spark.createDataFrame(rows, "k int, id int, x double, top double, right double, bottom double") for rows in made)
    got = overlap_join(left, right, ["k"], 16.0)
    want = [(a[0], a[1], b[1]) for a in made[0] for b in made[1] if a[0] == b[0] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    assert f"/ {16.0 * BLOCK}" in got._jdf.queryExecution().optimizedPlan().toString() and BLOCK > 1
