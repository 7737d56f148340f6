"""The redaction audit: which text is still there under what hides it.

Four kinds of finding, the first that holds for a record wins: text under a
fill that was painted later, invisible text, text in a layer that is off, and
text under an annotation. A page on which something is found is text-found; one
that could not be checked in full is cannot-check and never clean; a document
takes the worst of its pages.

A page is folded and judged in one pass, as one row: its records are held against
its own fills and annotations by a grid in memory, so no pairs and no characters
leave the pass, nothing is kept between queries, and nothing is shuffled.

The budget counts overlap tests in record order. The test that exceeds it ends
the page: its record and those after it yield nothing. It is part of what is
computed, not a guard, so it is the same at every scale.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quirework.functions.text import BLANK, mask
from quirework.operators.pagefold import FOLDS, Draw, fold_page
from quirework.operators.spatial import Grid, rect_area

PAGE = ["doc_id", "page"]
RECT = ("x", "top", "right", "bottom")
FINDING = "rec int, kind string, text string, full_record string, char_from int, char_to int, precise boolean, x double, top double, right double, bottom double, cover int, gray double, alpha double, color_space string, subtype string, dark boolean"
JUDGED = "n_covers long, n_records long, n_real long, n_findings long, comparisons long, incomplete boolean, form_xobjects int, unknown_ops map<string,int>, error string, verdict string"
ROWS_AT_ONCE = 64
NOT_BLANK = re.compile(f"[^{BLANK}]")


def findings_of(finding: str) -> str:
    """The column of a page's findings, with these fields."""
    return f"findings array<struct<{finding.replace(' ', ':').replace(',:', ',')}>>"


FOUND = findings_of(FINDING)
KINDS = ("text-under-cover", "invisible-text", "hidden-layer-text", "annotation-cover")
LIMITATIONS = (
    "The audit finds text that is hidden. It can't tell whether text that was meant to go has been removed.",
    "Text inside form objects is not read; a page with such objects is never reported clean.",
    "Pictures of text are not text.",
    "Documents that can't be opened are not checked.",
)


def by_characters(record: dict, cover: dict) -> dict | None:
    """The characters whose middle a cover takes in, unless all are blank."""
    unis, edges = record["chars"].unis, record["chars"].edges
    under = [i for i in range(len(unis)) if cover["x"] <= (edges[i] + edges[i + 1]) / 2 <= cover["right"]]
    text = "".join(unis[i] for i in under)
    return {"text": text, "char_from": under[0], "char_to": under[-1], "precise": True, "x": edges[under[0]], "right": edges[under[-1] + 1]} if NOT_BLANK.search(text) else None


@dataclass(frozen=True)
class Judge:
    """What decides about a page."""

    cover_ratio: float
    min_alpha: float
    dark_below: float
    budget: int
    use_grid: bool

    def hit(self, record: dict, cover: dict, painted: int | None) -> dict | None:
        """What of a record a cover hides; painted is where the cover was painted, if that counts. Null unless half the record's height is under it."""
        if min(record["bottom"], cover["bottom"]) - max(record["top"], cover["top"]) < 0.5 * (record["bottom"] - record["top"]):
            return None
        if cover["x"] > record["right"] or record["x"] > cover["right"] or painted is not None and painted <= record["e"]:
            return None
        if record["editable"] and record["chars"].unis and record["advance"] != 0 and record["right"] > record["x"]:
            return by_characters(record, cover)
        common = {"x": max(record["x"], cover["x"]), "top": max(record["top"], cover["top"]), "right": min(record["right"], cover["right"]), "bottom": min(record["bottom"], cover["bottom"])}
        if rect_area(common) / rect_area(record) < self.cover_ratio:
            return None
        return {"text": record["text"], "char_from": 0, "char_to": len(record["text"]) - 1, "precise": False, "x": record["x"], "right": record["right"]}

    def page(self, folded: dict, annots: list[dict]) -> dict:
        """The findings of a folded page, and what its verdict rests on."""
        covers = [c | {"cover": i} for i, c in enumerate(folded["covers"]) if c["alpha"] >= self.min_alpha and rect_area(c) > 1]
        notes = [a | {"cover": i} for i, a in enumerate(annots or ())]
        near = (lambda rects: Grid(rects, folded["vw"], folded["vh"]).near) if self.use_grid else (lambda rects: lambda record: rects)
        near_covers, near_notes = near(covers), near(notes)
        findings, tests, n_real, incomplete = [], 0, 0, False
        for rec, record in enumerate(folded["records"]):
            if not NOT_BLANK.search(record["text"]) or rect_area(record) <= 0:
                continue
            n_real += 1
            if incomplete:
                continue
            kind = hit = cover = None
            for cover in near_covers(record):
                tests += 1
                if tests > self.budget or (hit := self.hit(record, cover, cover["op_offset"])):
                    break
            if tests <= self.budget:
                if hit:
                    kind = KINDS[0]
                elif record["render_mode"] == 3:
                    kind = KINDS[1]
                elif any(record["s"] >= h["s"] and record["e"] <= h["e"] for h in folded["spans"]):
                    kind = KINDS[2]
                else:
                    for cover in near_notes(record):
                        tests += 1
                        if tests > self.budget or (hit := self.hit(record, cover, None)):
                            break
                    kind = KINDS[3] if hit else None
            if tests > self.budget:
                incomplete = True
            elif kind:
                findings.append(self.finding(rec, record, kind, hit, cover if hit else None))
        error, forms = folded["error"], folded["form_xobjects"]
        verdict = "text-found" if findings else "cannot-check" if error is not None or incomplete or forms else "no-findings"
        counts = {"n_covers": len(covers), "n_records": len(folded["records"]), "n_real": n_real, "n_findings": len(findings), "comparisons": tests}
        return {"findings": findings, **counts, "incomplete": incomplete, "form_xobjects": forms, "unknown_ops": list(folded["unknown_ops"].items()), "error": error, "verdict": verdict}

    def finding(self, rec: int, record: dict, kind: str, hit: dict | None, cover: dict | None) -> dict:
        fill = cover if kind == KINDS[0] else None
        gray = fill and fill["gray"]
        told = {"rec": rec, "kind": kind, "full_record": record["text"]} | {k: record[k] for k in ("text", *RECT)} | {"char_from": None, "char_to": None, "precise": None} | (hit or {})
        told |= {"cover": cover and cover["cover"], "subtype": cover["subtype"] if kind == KINDS[3] else None, "dark": None if fill is None else gray is not None and gray <= self.dark_below}
        return told | {k: fill and fill[k] for k in ("gray", "alpha", "color_space")}


@dataclass
class Audit:
    """Relations of one audit, each lazy."""

    pages: DataFrame
    #: Makes the page of a row, if pages are rows of another kind.
    draw: Draw | None = None
    cover_ratio: float = 0.6
    min_alpha: float = 0.5
    dark_below: float = 0.35
    budget: int = 400_000
    use_grid: bool = True

    def page_rows(self, fields: str = f"{FOUND}, {JUDGED}") -> DataFrame:
        """One row for each page, with its findings in order; fields tells what of it, as a schema."""
        judge, draw = Judge(self.cover_ratio, self.min_alpha, self.dark_below, self.budget, self.use_grid), self.draw
        kind = StructType([StructField("doc_id", self.pages.schema["doc_id"].dataType), *_parse_datatype_string(f"page int, {fields}")])
        arrow = to_arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                    rows = batch.slice(i, ROWS_AT_ONCE).to_pylist()
                    judged = [{k: r[k] for k in PAGE} | judge.page(fold_page(r), r["annots"]) for r in (map(draw, rows) if draw else rows) if r]
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in judged], f.type) for f in arrow], schema=arrow)

        return (self.pages if draw else self.pages.select(*FOLDS)).mapInArrow(run, kind)

    def described(self, finding: str = FINDING) -> DataFrame:
        """Findings with what hides them: a fill's colour, and whether it is dark; an annotation's subtype."""
        return self.page_rows(findings_of(finding)).select(*PAGE, F.explode("findings").alias("f")).select(*PAGE, "f.*")

    def findings(self) -> DataFrame:
        """One row for each finding."""
        return self.described().drop("gray", "alpha", "color_space", "subtype", "dark")

    def page_verdicts(self) -> DataFrame:
        return self.page_rows(JUDGED)

    def document_verdicts(self) -> DataFrame:
        checked = (F.col("verdict") != "cannot-check") | (F.col("n_records") > 0)
        return self.page_verdicts().groupBy("doc_id").agg(
            F.when(F.max(F.col("verdict") == "text-found"), "text-found").when(F.max(F.col("verdict") == "cannot-check"), "cannot-check").otherwise("no-findings").alias("verdict"),
            F.count("*").alias("n_pages"), F.count(F.when(checked, 1)).alias("pages_checked"), F.sum("n_findings").alias("n_findings"), F.sum("n_covers").alias("n_covers"),
        )

    def counters(self) -> DataFrame:
        """Findings of each kind by document."""
        return self.described("kind string").groupBy("doc_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k.replace("-", "_")) for k in KINDS))

    def unknown_operators(self) -> DataFrame:
        """How often each operator that the fold doesn't know occurs."""
        return self.page_rows("unknown_ops map<string,int>").select(F.explode("unknown_ops").alias("op", "n")).groupBy("op").agg(F.sum("n").alias("n"))

    def said(self) -> Column:
        """What a reader has to be told about a page, in order."""
        unknown = F.slice(F.map_keys("unknown_ops"), 1, 6)
        return F.array_compact(
            F.array(
                F.col("error"),
                F.when(F.col("form_xobjects") > 0, F.concat(F.lit("Draws through "), F.col("form_xobjects").cast("string"), F.lit(" form object(s), whose text is not read."))),
                F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown operators: "), F.array_join(unknown, ", "), F.lit("."))),
                F.when(F.col("incomplete"), F.concat(F.lit("Not checked in full: the limit of "), F.lit(str(self.budget)), F.lit(" overlap tests was reached."))),
            )
        )

    def notes(self) -> DataFrame:
        return self.page_verdicts().select(*PAGE, F.posexplode(self.said()).alias("seq", "note"))

    def report_rows(self, reveal: bool = False) -> DataFrame:
        """Rows of the report: for each page its findings and then its notes, or that nothing was found where it has neither; the limitations last.

        section and seq put the rows of a page in order; x and top are points with one decimal.
        """
        row = lambda section, seq, kind, x, top, text, note: F.struct(F.lit(section).alias("section"), seq.cast("int").alias("seq"), kind.alias("kind"), x.alias("x"), top.alias("top"), text.alias("text"), note.alias("note"))
        empty, point = F.lit(""), lambda v: F.format_string("%.1f", v)
        found = F.transform("findings", lambda f: row(1, f["rec"], f["kind"], point(f["x"]), point(f["top"]), f["text"] if reveal else mask(f["text"]), empty))
        notes = F.transform("notes", lambda n, i: row(2, i, F.lit("note"), empty, empty, empty, n))
        both = F.concat(found, notes)
        none = F.array(row(0, F.lit(0), F.lit("nothing found"), empty, empty, empty, empty))
        columns = findings_of("rec int, kind string, text string, x double, top double")
        pages = self.page_rows(f"{columns}, {JUDGED}").withColumn("notes", self.said()).select(*PAGE, F.inline(F.when(F.size(both) > 0, both).otherwise(none)))
        last = F.transform(F.array(*map(F.lit, LIMITATIONS)), lambda t, i: row(3, i, F.lit("limitation"), empty, empty, empty, t))
        return pages.unionByName(self.pages.select("doc_id").distinct().select("doc_id", F.lit(None).cast("int").alias("page"), F.inline(last)))
