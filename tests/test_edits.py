"""Rewriting of page content, by what the fold reads afterwards."""

import pytest
from pyspark.sql import functions as F

from quirework.operators.edits import EDIT, Anchored, Refused, edit_page, edit_pages, matched_runs, numeral, splice, wrap
from quirework.operators.pagefold import PAGE, View
from quirework.sources.fonts import Font
from tests.test_pages import FONT, page

LINES = b"BT /F1 10 Tf 100 700 Td (one) Tj ( two) Tj 0 -20 TD (three) Tj T* (four) Tj (five) ' ET\n"


def records(content):
    return Anchored(View(0.0, 0.0, 612.0, 792.0, 0), {"F1": Font.of("F1", dict(FONT)["F1"])}).run(content).records


def edited(content, *edits):
    r = records(content)
    full = [{"edit": i, "x": 90.0, "right": 300.0, "bottom": r[e["recs"][-1]]["bottom"] if e["recs"] else 0.0, "replacement": None, "push": None} | e for i, e in enumerate(edits)]
    return records(edit_page(page(content.decode()) | {"content": content, "edits": full}))


def places(rows):
    return {r["text"]: (round(r["x"], 3), round(r["baseline"], 3)) for r in rows if r["text"]}


def test_what_stays_keeps_its_place():
    was = places(records(LINES))
    for i, gone in enumerate(("one", " two", "three", "four", "five")):
        assert places(edited(LINES, {"recs": [i]})) == {k: v for k, v in was.items() if k != gone}


def test_new_text_stands_where_the_old_stood():
    was = places(records(LINES))
    now = places(edited(LINES, {"recs": [2], "replacement": "neu (3)\nzwei"}))
    assert now["neu (3)"] == was["three"] and now["zwei"] == (was["three"][0], was["three"][1] + 12)
    assert {k: now[k] for k in ("one", "four", "five")} == {k: was[k] for k in ("one", "four", "five")}


def test_lines_below_move_and_those_beside_do_not():
    was = places(records(LINES))
    now = places(edited(LINES, {"recs": [2], "push": 5.0}))
    assert now == {k: (x, y + 5 * (k in ("four", "five"))) for k, (x, y) in was.items() if k != "three"}
    beside = LINES + b"BT /F1 10 Tf 400 600 Td (far) Tj ET\n"
    assert places(edited(beside, {"recs": [2], "push": 5.0}))["far"] == places(records(beside))["far"]


@pytest.mark.parametrize(
    ("content", "edit", "why"),
    [
        (LINES, {"recs": None}, "spell"),
        (LINES + b"1 0 0 rg 80 20 100 2 re f\n", {"recs": [2], "push": 5.0}, "graphics below"),
        (LINES, {"recs": [2], "push": 5000.0}, "leave the page"),
        (LINES, {"recs": [3], "push": 5.0}, "operator of its own"),
        (LINES + b"BT /F1 10 Tf 1 0.2 0 1 100 600 Tm (far) Tj ET\n", {"recs": [2], "push": 5.0}, "turned or skewed"),
        (LINES, {"recs": [2], "replacement": "日本"}, r"U\+65E5"),
    ],
)
def test_refusals(content, edit, why):
    with pytest.raises(Refused, match=why):
        edited(content, edit | {"bottom": 110.0})
    with pytest.raises(Refused, match="same text"):
        edited(LINES, {"recs": [1]}, {"recs": [1, 2]})


def test_splice_and_numerals():
    assert splice(b"abcdef", [(4, 5, b""), (1, 3, b"--")]) == b"a--df"
    assert splice(b"abc", []) == b"abc"
    with pytest.raises(Refused):
        splice(b"abcdef", [(0, 3, b""), (2, 4, b"")])
    assert [numeral(x) for x in (-1e-9, 10.0, 0.5, -2.25, 100.0)] == ["0", "10", "0.5", "-2.25", "100"]


def test_wrap():
    assert wrap("aa bb cc", len, 5) == ["aa bb", "cc"]
    assert wrap("abcdefgh ij\n\n x", len, 3) == ["abc", "def", "gh", "ij", "", "x"]
    assert wrap("", len, 3) == [""] and wrap("ab", len, 0) == ["a", "b"]


def test_runs_are_the_first_that_spell_the_text(spark):
    texts = ["The", " ", "cat ", "sat", "cat", "sat", "d�g"]
    rows = [(1, 0, e, want, i, t) for e, want in enumerate(("catsat", "CAT sat", "ats", "", None, "dog", "the cat")) for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "doc_id long, page int, edit int, expected string, rec int, text string")
    got = {r["edit"]: r["recs"] for r in matched_runs(found).collect()}
    assert got == {0: [1, 2, 3], 1: [1, 2, 3], 2: None, 3: None, 4: None, 5: [6], 6: [0, 1, 2]}


def test_pages_are_edited_whole_or_not_at_all(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from quirework.operators.pagefold import fold_pages

    schema = to_arrow_schema(_parse_datatype_string(f"doc_id long, page int, {PAGE}"))
    made = spark.createDataFrame(pa.Table.from_pylist([page(LINES.decode()) | {"page": i} for i in range(3)], schema=schema))
    asked = spark.createDataFrame(
        [(1, 0, 0, 90.0, 80.0, 300.0, 95.0, "One two", "1", None), (1, 1, 0, 90.0, 80.0, 300.0, 95.0, "one two", None, None), (1, 1, 1, 90.0, 80.0, 300.0, 95.0, "other", None, None)],
        f"doc_id long, page int, {EDIT}",
    )
    got = {r["page"]: r for r in edit_pages(made, fold_pages(made), asked).collect()}
    assert sorted(got) == [0, 1] and got[0]["ok"] and not got[1]["ok"]
    assert bytes(got[1]["content"]) == LINES and "spell" in got[1]["reason"]
    assert places(records(bytes(got[0]["content"])))["1"] == places(records(LINES))["one"]
    assert edit_pages(made, fold_pages(made), asked.where(F.lit(False))).count() == 0


def test_stamps_without_lines_and_by_default_alignment(spark):
    from quirework.operators.stamps import stamp_lines

    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x", 0.0), ("y", 0.0), ("w", 200.0), ("h", 100.0))))
    df = spark.createDataFrame([(1, ["ab", None, "", "abcd"]), (2, []), (3, None)], "id int, lines array<string>")
    got = stamp_lines(df, F.col("lines"), lambda s: F.length(s) * 5.0, F.lit(10.0), F.lit("bottom-right"), F.lit(8.0), F.lit(0), box, F.lit(0)).collect()
    assert [(r["id"], r["line"], r["x"], r["y"], r["turn"]) for r in got] == [(1, "ab", 182.0, 20.5, 0), (1, "abcd", 172.0, 8.0, 0)]


def test_a_page_finds_the_runs_that_the_relations_find(spark):
    from quirework.operators.edits import in_rect, run_of

    texts = ["The", " ", "cat ", "s­at", "cat", "sat", "d�g", "ﬁsh "]
    rows = [{"x": 10.0 * i, "right": 10.0 * i + 8, "top": 5.0, "bottom": 15.0, "text": t} for i, t in enumerate(texts)]
    asked = [{"edit": e, "x": x, "top": 5.0, "right": 90.0, "bottom": 15.0, "expected": want} for e, (x, want) in enumerate((x, want) for x in (0.0, 25.0, 200.0, None) for want in ("catsat", "CAT sat", "ats", "", None, "dog", "the cat", "FISH"))]
    records = spark.createDataFrame([(1, 0, i, r["text"], True, None, r["x"], r["top"], r["right"], r["bottom"]) for i, r in enumerate(rows)], "doc_id long, page int, rec int, text string, editable boolean, reason string, x double, top double, right double, bottom double")
    edits = spark.createDataFrame([(1, 0, e["edit"], e["x"], e["top"], e["right"], e["bottom"], e["expected"], None, None) for e in asked], f"doc_id long, page int, {EDIT}")
    want = {r["edit"]: r["recs"] for r in matched_runs(in_rect(records, edits)).collect()}
    got = {e["edit"]: run_of(rows, e) for e in asked}
    assert got == {e: want.get(e) for e in got} and sum(v is not None for v in got.values()) > 6


def test_pages_that_tell_their_own_edits(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from quirework.operators.edits import edit_each

    schema = to_arrow_schema(_parse_datatype_string(f"doc_id long, page int, {PAGE}"))
    made = spark.createDataFrame(pa.Table.from_pylist([page(LINES.decode()) | {"page": i} | ({"content": None} if i == 3 else {}) for i in range(4)], schema=schema))

    def ask(doc_id, page, records):
        side = {k: records[0][k] for k in ("x", "top", "right", "bottom")}
        return [side | {"edit": 0, "expected": ("one", "other")[page], "replacement": "1", "push": None}] if page < 2 else []

    got = {r["page"]: r for r in edit_each(made, ask).collect()}
    assert sorted(got) == [0, 1, 3] and [got[i]["ok"] for i in (0, 1, 3)] == [True, False, False]
    assert places(records(bytes(got[0]["content"])))["1"] == places(records(LINES))["one"]
    assert bytes(got[1]["content"]) == LINES and "spell" in got[1]["reason"] and got[3]["content"] is None and "readable" in got[3]["reason"]
    assert edit_each(made.where("page = 2"), ask).count() == 0


def test_the_query_of_edits_moves_texts_once_and_folds_a_page_twice(spark):
    from quirework.plans.queries import QUERIES

    plan = QUERIES["edited_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Repartition") == 1 and plan.count("MapInArrow") == 3
