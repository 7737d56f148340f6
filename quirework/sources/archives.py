"""ZIP and DOCX: archives in and out, a file for each row or group."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

FIXED_DATE = (1980, 1, 1, 0, 0, 0)
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def read_zip(files: DataFrame) -> DataFrame:
    """(doc_id, entry, name, data, err) of each entry; an archive that can't be read is one row with err."""
    kind = _parse_datatype_string(f"doc_id {files.schema['doc_id'].dataType.simpleString()}, entry int, name string, data binary, err string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                try:
                    with zipfile.ZipFile(io.BytesIO(row["data"] or b"")) as z:
                        for i, info in enumerate(z.infolist()):
                            yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "entry": i, "name": info.filename, "data": z.read(info)}], schema=arrow)
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "err": str(e)}], schema=arrow)

    return files.select("doc_id", "data").mapInArrow(run, kind)


def pack_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """A stored archive; the same bytes for the same entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, FIXED_DATE), data)
    return out.getvalue()


def write_zip(entries: DataFrame, key: str) -> DataFrame:
    """(key, data): an archive for each key from rows (key, ord, name, data)."""

    def make(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("ord")
        return pd.DataFrame({key: [group[0]], "data": [pack_zip([(n, bytes(d)) for n, d in zip(rows["name"], rows["data"])])]})

    return entries.select(key, "ord", "name", "data").groupBy(key).applyInPandas(make, f"`{key}` {entries.schema[key].dataType.simpleString()}, data binary")


def escape(text: str) -> str:
    ok = re.sub("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]", "", text)
    return ok.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def run_xml(run: dict) -> str:
    style = "".join(f"<w:{t}/>" for k, t in (("bold", "b"), ("italic", "i"), ("underline", 'u w:val="single"')) if run.get(k))
    size = f'<w:sz w:val="{round(2 * run["size"])}"/>' if run.get("size") else ""
    return f'<w:r><w:rPr>{style}{size}</w:rPr><w:t xml:space="preserve">{escape(run["text"])}</w:t></w:r>'


def block_xml(block: dict) -> str:
    """A paragraph from runs, or a table from rows of cells, which may span columns and continue the one above."""
    if "rows" not in block:
        return f"<w:p>{''.join(map(run_xml, block.get('runs', ())))}</w:p>"
    n = max((sum(c.get("span", 1) for c in row) for row in block["rows"]), default=0)
    grid = "".join(f'<w:gridCol w:w="{9000 // max(1, n)}"/>' for _ in range(n))
    rows = ""
    for row in block["rows"]:
        cells = ""
        for c in row:
            merge = {"start": '<w:vMerge w:val="restart"/>', "more": "<w:vMerge/>"}.get(c.get("merge"), "")
            inner = "".join(map(block_xml, c.get("blocks", ()))) or "<w:p/>"
            cells += f'<w:tc><w:tcPr><w:gridSpan w:val="{c.get("span", 1)}"/>{merge}</w:tcPr>{inner}</w:tc>'
        rows += f"<w:tr>{cells}</w:tr>"
    return f"<w:tbl><w:tblGrid>{grid}</w:tblGrid>{rows}</w:tbl>"


def pack_docx(blocks: list[dict]) -> bytes:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    types = f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}" Target="word/document.xml"/></Relationships>'
    body = f'{head}<w:document xmlns:w="{W}"><w:body>{"".join(map(block_xml, blocks))}<w:sectPr/></w:body></w:document>'
    return pack_zip([("[Content_Types].xml", types.encode()), ("_rels/.rels", rels.encode()), ("word/document.xml", body.encode())])


def write_docx(lines: DataFrame, key: str) -> DataFrame:
    """(key, data): a document for each key, a paragraph for each row (key, ord, text)."""

    def make(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [{"runs": [{"text": t}]} for t in frame.sort_values("ord")["text"]]
        return pd.DataFrame({key: [group[0]], "data": [pack_docx(blocks)]})

    return lines.select(key, "ord", "text").groupBy(key).applyInPandas(make, f"`{key}` {lines.schema[key].dataType.simpleString()}, data binary")
