"""A reader for PDF objects, enough to make page relations, and a plain writer.

Files come through Spark's binaryFile source. The reader takes objects from
where they stand in the file, so a broken cross-reference does no harm, and
unpacks object streams. An encrypted file that opens without a password is read
if its cipher is RC4; others are told to be locked. A file that can't be read is
a row with err, never a failed job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quirework.operators.pagefold import PAGE, Token, View, tokens
from quirework.sources.ciphers import empty_password_key, object_key, rc4
from quirework.sources.fonts import parse_to_unicode

COVER_NOTES = ("Square", "Redact", "Highlight", "FreeText", "Ink", "Stamp", "Polygon")


class Ref(int):
    """A reference to an object by its number."""


class Name(str):
    pass


def build(stream: Iterator[Token], until: str | None = None) -> list:
    """Values of a token stream: dicts, lists, names, numbers, strings and references."""
    out: list = []
    for t in stream:
        if t.kind == until:
            break
        if t.kind == "dictopen":
            flat = build(stream, "dictclose")
            out.append(dict(zip(flat[::2], flat[1::2])))
        elif t.kind == "arrayopen":
            out.append(build(stream, "arrayclose"))
        elif t.kind == "name":
            out.append(Name(t.value))
        elif t.kind in ("num", "str"):
            out.append(t.value)
        elif t.kind == "op":
            if t.value == "R" and len(out) >= 2:
                out[-2:] = [Ref(out[-2])]
            elif t.value in ("true", "false", "null"):
                out.append({"true": True, "false": False, "null": None}[t.value])
            else:
                break
    return out


class Pdf:
    """The objects of one file."""

    OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
    STREAM = re.compile(rb"stream(\r\n|\n|\r)")

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        self.data, self.at, self.generation, self.cache, self.key = data, {}, {}, {}, None
        for m in self.OBJECT.finditer(data):
            self.at[int(m[1])], self.generation[int(m[1])] = m.end(), int(m[2])
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", data):
            got = build(tokens(data[m.end() : m.end() + 65_536]))
            if got and isinstance(got[0], dict):
                self.trailer |= got[0]
        for number in list(self.at):
            head = self.get(Ref(number))
            if isinstance(head, dict) and head.get("Type") == "XRef":
                self.trailer = {k: v for k, v in head.items() if k in ("Root", "Encrypt", "Info", "ID")} | self.trailer
        self.locked = "Encrypt" in self.trailer
        if self.locked and (key := self.unlocking(self.get(self.trailer["Encrypt"]))):
            self.locked, self.key, self.cache = False, key, {}
        if not self.locked:
            for number in list(self.at):
                head = self.get(Ref(number))
                if isinstance(head, dict) and head.get("Type") == "ObjStm":
                    self.unpack(number, head)
        self.root = self.get(self.trailer.get("Root")) or next((o for n in self.at if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(self.root, dict):
            raise ValueError("no catalog")

    def get(self, x):
        """What x refers to; x itself if it is no reference."""
        for _ in range(64):
            if not isinstance(x, Ref):
                return x
            if x not in self.cache:
                got = build(tokens(self.data[self.at[x] : self.ends(self.at[x])])) if x in self.at else []
                self.cache[x] = self.plain(got[0], x) if got else None
            x = self.cache[x]
        return None

    def unlocking(self, rules) -> bytes | None:
        """The key of a file that opens with an empty password, if its cipher is RC4."""
        if not isinstance(rules, dict) or rules.get("Filter") != "Standard":
            return None
        value = lambda k, default=None: self.get(rules.get(k, default))
        version, bits = int(value("V", 0.0)), int(value("Length", 40.0))
        if version == 4:
            used = self.get((value("CF") or {}).get(value("StmF"))) or {}
            if self.get(used.get("CFM")) != "V2" or value("StrF") != value("StmF"):
                return None
            bits = 128
        elif version not in (1, 2):
            return None
        given = self.get((self.get(self.trailer.get("ID")) or [b""])[0])
        return empty_password_key(version, int(value("R", 0.0)), bits, value("O", b""), value("U", b""), int(value("P", 0.0)), given, value("EncryptMetadata", True) is not False)

    def plain(self, x, number: int):
        """x, which stands in an object of that number, with its strings deciphered."""
        if self.key is None or Ref(number) == self.trailer.get("Encrypt"):
            return x
        if isinstance(x, bytes):
            return rc4(object_key(self.key, number, self.generation[number]), x)
        if isinstance(x, list):
            return [self.plain(v, number) for v in x]
        return {k: self.plain(v, number) for k, v in x.items()} if isinstance(x, dict) else x

    def ends(self, start: int) -> int:
        found = self.data.find(b"endobj", start)
        stream = self.STREAM.search(self.data, start, found if found >= 0 else len(self.data))
        return stream.start() if stream else found if found >= 0 else len(self.data)

    def stream(self, ref) -> bytes:
        """The decoded bytes of a stream object."""
        head = self.get(ref)
        if not isinstance(head, dict) or ref not in self.at:
            raise ValueError("not a stream")
        m = self.STREAM.search(self.data, self.at[ref])
        if not m:
            raise ValueError("a stream has no data")
        length = self.get(head.get("Length"))
        end = m.end() + int(length) if isinstance(length, float) else -1
        if end < 0 or not self.data[end : end + 16].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", m.end())
        raw = self.data[m.end() : end]
        if self.key is not None and head.get("Type") != "XRef":
            raw = rc4(object_key(self.key, int(ref), self.generation[int(ref)]), raw)
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("FlateDecode", "Fl"):
                raw = zlib.decompressobj().decompress(raw)
            elif f in ("ASCIIHexDecode", "AHx"):
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode())
            else:
                raise ValueError(f"filter {f}")
        parms = self.get(head.get("DecodeParms"))
        parms = parms if isinstance(parms, dict) else {}
        return undo_predictor(raw, int(parms.get("Columns", 1))) if parms.get("Predictor", 1) >= 10 else raw

    def unpack(self, number: int, head: dict) -> None:
        data = self.stream(Ref(number))
        n, first = int(self.get(head["N"])), int(self.get(head["First"]))
        table = [int(x) for x in data[:first].split()[: 2 * n]]
        for key, at in zip(table[::2], table[1::2]):
            if key not in self.at:
                got = build(tokens(data[first + at :]))
                self.cache[Ref(key)] = got[0] if got else None

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out, seen = [], set()
        todo = [(self.root.get("Pages"), {})]
        while todo:
            ref, given = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref)
            own = given | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(node | own)
        return out

    def hidden_groups(self) -> set[int]:
        """Optional-content groups that are off by default."""
        default = self.get((self.get(self.root.get("OCProperties")) or {}).get("D")) or {}
        return {int(x) for x in self.get(default.get("OFF")) or [] if isinstance(x, Ref)}

    def font(self, ref) -> dict:
        f = self.get(ref) or {}
        two = f.get("Subtype") == "Type0"
        widths: dict[int, float] = {}
        default = None
        if two:
            inner = self.get((self.get(f.get("DescendantFonts")) or [None])[0]) or {}
            default = self.get(inner.get("DW", 1000.0))
            w = self.get(inner.get("W")) or []
            while w:
                first, second, *w = w
                second = self.get(second)
                if isinstance(second, list):
                    widths |= {int(first) + i: float(self.get(x)) for i, x in enumerate(second)}
                elif w:
                    widths |= dict.fromkeys(range(int(first), int(second) + 1), float(self.get(w[0])))
                    w = w[1:]
        else:
            start = int(self.get(f.get("FirstChar", 0.0)))
            widths = {start + i: float(self.get(x)) for i, x in enumerate(self.get(f.get("Widths")) or [])}
        try:
            cmap = self.stream(f["ToUnicode"]).decode("latin-1") if isinstance(f.get("ToUnicode"), Ref) else ""
        except (ValueError, zlib.error):
            cmap = ""
        encoding = self.get(f.get("Encoding"))
        listed = encoding if isinstance(encoding, dict) else {}
        named = self.get(listed.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        return {
            "subtype": f.get("Subtype"), "base_font": f.get("BaseFont"), "widths": list(widths.items()), "to_unicode": list(parse_to_unicode(cmap).items()), "default_width": default,
            "encoding": str(named) if isinstance(named, Name) else None, "differences": list(self.differences(self.get(listed.get("Differences")) or []).items()),
        }

    def differences(self, listed: list) -> dict[int, str]:
        """Codes to glyph names: a number sets the code, each name takes it and goes on to the next."""
        out, code = {}, 0
        for item in map(self.get, listed):
            if isinstance(item, float):
                code = int(item)
            elif isinstance(item, Name):
                out[code] = str(item)
                code += 1
        return out

    def page(self, page: dict, hidden: set[int]) -> dict:
        """A row of the page relation."""
        box = [float(self.get(x)) for x in self.get(page.get("CropBox") or page.get("MediaBox")) or [0, 0, 612, 792]]
        x, y, w, h = min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]), abs(box[3] - box[1])
        rotate = int(self.get(page.get("Rotate", 0.0)) or 0) % 360
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page["Contents"]] if isinstance(page.get("Contents"), Ref) else []
        res = self.get(page.get("Resources")) or {}
        part = lambda k: self.get(res.get(k)) or {}
        alphas = {k: self.get((self.get(v) or {}).get("ca")) for k, v in part("ExtGState").items()}
        view, notes = View(x, y, w, h, rotate), []
        for a in self.get(page.get("Annots")) or []:
            note = self.get(a)
            rect = self.get(note.get("Rect")) if isinstance(note, dict) else None
            if rect and len(rect) == 4 and note.get("Subtype") in COVER_NOTES:
                r = [float(self.get(v)) for v in rect]
                notes.append({"subtype": str(note["Subtype"]), **view.rect([(r[0], r[1]), (r[2], r[3])])})
        return {
            "box": {"x": x, "y": y, "w": w, "h": h},
            "rotate": rotate,
            "content": b"".join(self.stream(r) + b"\n" for r in refs),
            "fonts": [(k, self.font(v)) for k, v in part("Font").items()],
            "gs_alpha": [(k, v) for k, v in alphas.items() if isinstance(v, float)],
            "hidden_names": [k for k, v in part("Properties").items() if isinstance(v, Ref) and int(v) in hidden],
            "images": [k for k, v in part("XObject").items() if (self.get(v) or {}).get("Subtype") == "Image"],
            "annots": notes,
        }


def undo_predictor(raw: bytes, columns: int) -> bytes:
    """PNG rows with no filter, or with the one that adds what is above."""
    out, above = bytearray(), bytes(columns)
    for i in range(0, len(raw), columns + 1):
        row = raw[i + 1 : i + 1 + columns]
        if raw[i] == 2:
            row = bytes((p + q) & 255 for p, q in zip(row, above))
        elif raw[i]:
            raise ValueError("predictor")
        out += row
        above = row.ljust(columns, b"\0")
    return bytes(out)


def open_pdf(data: bytes) -> tuple[Pdf | None, str | None]:
    """The file, or why it can't be read: locked or damaged."""
    try:
        pdf = Pdf(data)
    except (ValueError, KeyError, IndexError, TypeError, zlib.error, RecursionError):
        return None, "damaged"
    return (None, "locked") if pdf.locked else (pdf, None)


def page_count(data: bytes) -> int | None:
    pdf, _ = open_pdf(data)
    return len(pdf.pages()) if pdf else None


def piece_info(pdf: Pdf, page: dict, owner: str) -> str | None:
    """Private data, as text, that an application left on a page."""
    own = pdf.get((pdf.get(page.get("PieceInfo")) or {}).get(owner)) or {}
    private = pdf.get(own.get("Private"))
    return private.decode("utf-8", "replace") if isinstance(private, bytes) else None


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, content) of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).selectExpr("path AS doc_id", "length AS size", "content AS data")


def read_pages(files: DataFrame) -> DataFrame:
    """Files (doc_id, data) to page relations with err: a file that can't be read is one row with page null."""
    kind = _parse_datatype_string(f"doc_id {files.schema['doc_id'].dataType.simpleString()}, page int, {PAGE}, err string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                pdf, err = open_pdf(row["data"] or b"")
                if not pdf:
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "err": err}], schema=arrow)
                    continue
                hidden = pdf.hidden_groups()
                for number, page in enumerate(pdf.pages()):
                    try:
                        made = pdf.page(page, hidden) | {"err": None}
                    except (ValueError, KeyError, IndexError, TypeError, zlib.error) as e:
                        made = {"box": {"x": 0.0, "y": 0.0, "w": 612.0, "h": 792.0}, "rotate": 0, "annots": [], "err": f"page: {e}"}
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "page": number} | made], schema=arrow)

    return files.select("doc_id", "data").mapInArrow(run, kind)


def write_pdf(pages: list[dict]) -> bytes:
    """A file from pages (w, h, content), each with one standard font F1; the same bytes for the same pages."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    for i, p in enumerate(pages):
        body = zlib.compress(p["content"], 6)
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %g %g]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (p["w"], p["h"], 5 + 2 * i))
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
