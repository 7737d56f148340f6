"""Pages made from a table of texts, with places that arithmetic can tell.

Each text is laid out whole: LINE characters a line, LINES lines a page, in a
font without widths, where each character is half the size wide. What a line
carries (a fill over it, one beneath it, a faint one, invisible text, a layer that is off, an
annotation) and where follows from the document's id and the line's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quirework.operators.pagefold import PAGE

LINE, LINES = 80, 50
SIZE, LEFT, FIRST, STEP = 10, 72, 740, 14
WIDTH, HEIGHT = 612, 792
#: Half the size: the advance of a character.
ADVANCE = SIZE // 2


CONTROL, BEYOND = re.compile("[\\x00-\\x1F\\x7F-\\x9F]"), re.compile("[^\\x00-\\xFF]")


def line_code(text: str, role: int, a: int, b: int, y: int) -> str:
    spelled = re.sub(r"([\\()])", r"\\\1", text)
    shown = f"BT /F1 {SIZE} Tf {3 if role == 1 else 0} Tr 1 0 0 1 {LEFT} {y} Tm ({spelled}) Tj ET\n"
    fill = f"0 g {LEFT + ADVANCE * a} {y - 2.2:.1f} {ADVANCE * (b - a)} {1.1 * SIZE:.1f} re f Q\n"
    return {0: f"{shown}q {fill}", 2: f"/OC /Off BDC\n{shown}EMC\n", 4: f"{shown}q /Faint gs {fill}", 5: f"q {fill}{shown}"}.get(role, shown)


def page_row(doc_id: int | None, page: int, text: str) -> dict:
    """A page of a text. Roles: 0 a fill over characters a to b, painted after them; 1 invisible; 2 in a layer that is off; 3 an annotation over characters a to b; 4 a fill that is too faint; 5 a fill painted before; 6 nothing."""
    text, key = BEYOND.sub("?", CONTROL.sub(" ", text)), doc_id or 0
    code, notes = [], []
    for j, line in enumerate([text[i : i + LINE] for i in range(0, len(text), LINE)] or [""]):
        role, a = (key * 31 + page * 17 + j * 7) % 7, (key + j) % 20
        b, y = a + 5 + (page + j) % 30, FIRST - STEP * j
        code.append(line_code(line, role, a, b, y))
        if role == 3:
            top = HEIGHT - y - 0.88 * SIZE
            notes.append({"subtype": "Square", "x": float(LEFT + ADVANCE * a), "top": top, "right": float(LEFT + ADVANCE * b), "bottom": top + 1.1 * SIZE})
    return {"doc_id": doc_id, "page": page, "box": {"x": 0.0, "y": 0.0, "w": float(WIDTH), "h": float(HEIGHT)}, "rotate": 0, "content": "".join(code).encode("latin-1"), "fonts": [("F1", {"subtype": "Type1", "base_font": "Helvetica"})],
            "gs_alpha": [("Faint", 0.49)], "hidden_names": ["Off"], "images": [], "annots": notes}


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut into pages, dealt by page, for one text may have any number of them and one file any number of texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LINE * LINES}}}"), F.lit(0)))
    cuts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(cut).alias("page", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that they aren't made fewer by their bytes: drawing and folding take time, not room
    return cuts.repartition(parts, "doc_id", "page")


def drawn(row: dict) -> dict:
    """The page of a row of dealt()."""
    return page_row(row["doc_id"], row["page"], row["text"])


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page relation, ready for the fold. What folds each page once takes dealt() and drawn instead, in one pass."""
    kind = _parse_datatype_string(f"doc_id long, page int, {PAGE}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([page_row(*r) for r in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns))], schema=arrow)

    return dealt(docs, id_col, text_col).mapInArrow(run, kind)


#: The same layout for SQL: one row for each line.
LINES_SQL = f"""
texts AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g'), '[^\\x00-\\x{{FF}}]', '?', 'g') AS t FROM documents
), numbered AS (
  SELECT doc_id, t, unnest(range(greatest(1, CAST(ceil(length(t) / {LINE}.0) AS BIGINT)))) AS n FROM texts
), placed AS (
  SELECT doc_id, n, n // {LINES} AS page, n % {LINES} AS rec0, substr(t, n * {LINE} + 1, {LINE}) AS line FROM numbered
), lines AS (
  SELECT doc_id, n, page, rec0, line, (doc_id * 31 + page * 17 + rec0 * 7) % 7 AS role, (doc_id + rec0) % 20 AS a, (doc_id + rec0) % 20 + 5 + (page + rec0) % 30 AS b FROM placed
), numbered_records AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) - 1 AS rec FROM lines
)
"""
