"""Edits of page content: text is taken out, put in and moved down within the bytes of the stream.

An edit names a rectangle of the view, the text expected there and what goes in
its place. Matching is relational: records whose centre lies in the rectangle,
in stream order, have to hold a run of neighbours that spells the expected text.
Rewriting is a second fold of the pages that have edits, a page at a time.

A page is rewritten whole or not at all; the reason tells why not. Text alone is
moved: a page is refused where a graphic lies below what is pushed down, or text
would leave the page. What stays keeps its place: a show that is taken out leaves its advance behind where others
follow on its line, and a line that moves gets a matrix of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quirework.functions.text import cmp_key, cmp_key_of, same_text
from quirework.operators.bands import REFUSALS, SLACK
from quirework.operators.pagefold import IDENTITY, PAGE, Draw, Matrix, Page, View, times
from quirework.sources.fonts import UNKNOWN, Font

#: How far beyond its rectangle an edit reaches, and the step between lines of new text as a share of the size.
PAD, LEADING = 2.0, 1.2
ROWS_AT_ONCE = 64
EDIT = "edit int, x double, top double, right double, bottom double, expected string, replacement string, push double"
KEYS = ["doc_id", "page"]


class Refused(ValueError):
    """Why a page stays as it is."""


def numeral(x: float) -> str:
    return f"{round(x, 6) + 0.0:.6f}".rstrip("0").rstrip(".")


def in_rect(records: DataFrame, edits: DataFrame, pad: float = PAD) -> DataFrame:
    """Each edit with the records whose centre lies in its rectangle. Joined by page."""
    cx, cy = (F.col("r.x") + F.col("r.right")) / 2, (F.col("r.top") + F.col("r.bottom")) / 2
    r = records.select(*KEYS, "rec", F.struct("text", "editable", "reason", "x", "top", "right", "bottom").alias("r"))
    e = edits.select(*KEYS, "edit", "expected", F.struct("x", "top", "right", "bottom").alias("q"))
    near = cx.between(F.col("q.x") - pad, F.col("q.right") + pad) & cy.between(F.col("q.top") - pad, F.col("q.bottom") + pad)
    return r.join(e, KEYS).where(near).select(*KEYS, "edit", "expected", "rec", "r.text", "r.editable", "r.reason")


def matched_runs(found: DataFrame, same: Callable[[Column, Column], Column] = same_text) -> DataFrame:
    """For each edit the first run of neighbours that spells what is expected: recs, null if there is none.

    found has a row for each record of an edit. Keys are laid end to end; a run
    begins and ends at their bounds, and its length is known, so that each
    record is looked at once as a beginning.
    """
    keyed = found.select(*KEYS, "edit", "rec", cmp_key(F.col("text")).alias("key"), cmp_key(F.col("expected")).alias("want"))
    order = W.partitionBy(*KEYS, "edit").orderBy("rec")
    placed = keyed.withColumn("end", F.sum(F.length("key")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.length("key"))
    pages = placed.groupBy(*KEYS, "edit").agg(F.first("want").alias("want"), F.array_sort(F.collect_list(F.struct("rec", "begin", "end", "key"))).alias("each"))
    line = pages.withColumn("line", F.array_join(F.transform("each", lambda x: x["key"]), "")).withColumn("size", F.length("want"))
    starts = F.filter("each", lambda x: same(F.substring(F.col("line"), x["begin"].cast("int") + 1, F.col("size")), F.col("want")) & F.exists("each", lambda y: y["end"] == x["begin"] + F.col("size")))
    first = line.withColumn("first", F.get(starts, F.lit(0)))
    last = F.array_min(F.transform(F.filter("each", lambda y: (y["end"] == F.col("first.begin") + F.col("size")) & (y["rec"] >= F.col("first.rec"))), lambda y: y["rec"]))
    recs = F.transform(F.filter("each", lambda y: y["rec"].between(F.col("first.rec"), last)), lambda y: y["rec"])
    return first.select(*KEYS, "edit", F.when((F.col("size") > 0) & F.col("first").isNotNull(), recs).alias("recs"))


def run_of(records: list[dict], edit: dict, pad: float = PAD) -> list[int] | None:
    """in_rect and matched_runs for one edit of a page whose records are at hand."""
    want, sides = cmp_key_of(edit["expected"]), [edit[k] for k in ("x", "top", "right", "bottom")]
    if not want or None in sides:
        return None
    x, top, right, bottom = sides
    each, line = [], ""
    for i, r in enumerate(records):
        if x - pad <= (r["x"] + r["right"]) / 2 <= right + pad and top - pad <= (r["top"] + r["bottom"]) / 2 <= bottom + pad:
            begin, line = len(line), line + cmp_key_of(r["text"])
            each.append((i, begin, len(line)))
    ends = {end for *_, end in each}
    for first, begin, _ in each:
        end = begin + len(want)
        if end in ends and all(p in (UNKNOWN, q) for p, q in zip(line[begin:end], want)):
            last = next(i for i, _, e in each if e == end and i >= first)
            return [i for i, *_ in each if first <= i <= last]
    return None


@dataclass(frozen=True)
class Anchor:
    """The operator that placed a line, and where the line then began."""

    op: str
    s: int
    e: int
    line: Matrix
    leading: float

    def lower(self, dy: float) -> bytes:
        *rest, y = self.line
        return (" ".join(map(numeral, (*rest, y - dy))) + " Tm" + (f" {numeral(self.leading)} TL" if self.op == "TD" else "")).encode()


#: How many operands they take.
ANCHORS = {"Tm": 6, "Td": 2, "TD": 2, "T*": 0}


class Anchored(Page):
    """A fold that keeps, for each record, its line's anchor, its matrices and the operator that showed it."""

    def __post_init__(self):
        super().__post_init__()
        self.anchor: Anchor | None = None
        self.kept: list[tuple[Anchor | None, Matrix, Matrix, str, float, float, float]] = []

    def step(self, op, args, n, s, e):
        self.op = op
        if op in ("'", '"') and args:
            self.anchor = Anchor(op, self.base + args[0].s, e, IDENTITY, self.leading)
        super().step(op, args, n, s, e)
        need = ANCHORS.get(op)
        if op == "BT":
            self.anchor = None
        elif need is not None and len(args) >= need:
            self.anchor = Anchor(op, self.base + args[-need].s if need else s, e, self.tlm, self.leading)

    def emit(self, parts, start, end):
        n, state = len(self.records), (self.anchor, self.tm, self.ctm, self.op, self.stretch, self.word, self.spacing)
        super().emit(parts, start, end)
        self.kept += [state] * (len(self.records) - n)


def splice(content: bytes, cuts: list[tuple[int, int, bytes]]) -> bytes:
    """content with each range replaced; ranges may not overlap."""
    out, at = [], 0
    for s, e, put in sorted(cuts):
        if s < at:
            raise Refused("two changes overlap")
        out += [content[at:s], put]
        at = e
    return b"".join([*out, content[at:]])


def gone(page: Anchored, i: int) -> bytes:
    """What stands in for a show that is taken out: its step to a new line, and its advance if others follow on the line."""
    anchor, _, _, op, stretch, word, spacing = page.kept[i]
    left = {"'": "T*", '"': f"{numeral(word)} Tw {numeral(spacing)} Tc T*"}.get(op, "")
    record = page.records[i]
    follows = i + 1 < len(page.records) and page.kept[i + 1][0] is anchor and page.records[i + 1]["chain"] == record["chain"]
    unit = record["size"] * stretch / 100
    return (left + (f" [{numeral(-1000 * record['advance'] / unit)}] TJ" if follows and unit else "") + " ").encode()


def rewrite(page: Anchored, content: bytes, removed: set[int], shifts: dict[int, float]) -> bytes:
    """content without the removed records and with others moved down by their shift, in points of the view."""
    cuts = [(page.records[i]["s"], page.records[i]["e"], gone(page, i)) for i in removed]
    stay = [i for i in range(len(page.records)) if i not in removed]
    for _, members in groupby(stay, key=lambda i: page.records[i]["chain"]):
        shift, last = 0.0, None
        for i in members:
            anchor, tm, ctm, *_ = page.kept[i]
            dy = shifts.get(i, 0.0)
            if dy != shift:
                if page.view.rotate or max(map(abs, (tm[1], tm[2], ctm[1], ctm[2]))) >= 0.001 or not ctm[3]:
                    raise Refused("turned or skewed text can't be moved down")
                if anchor is None or anchor.op in ("'", '"'):
                    raise Refused("a line at the cut has no operator of its own to place it")
                if anchor is last:
                    raise Refused("the cut would part a line")
                cuts.append((anchor.s, anchor.e, anchor.lower(dy / ctm[3])))
            shift, last = dy, anchor
    return splice(content, cuts)


def wrap(text: str, width: Callable[[str], float], most: float) -> list[str]:
    """Lines of words that fit; a word that fits no line is cut. A line feed always begins a line, and a blank line stays one."""
    out = []
    for raw in text.replace("\t", "    ").split("\n"):
        line = ""
        for word in raw.split():
            if width(joined := f"{line} {word}" if line else word) <= most:
                line = joined
                continue
            if line:
                out.append(line)
            while len(word) > 1 and (w := width(word)) > most:
                cut = max(1, int(len(word) * most / w))
                out.append(word[:cut])
                word = word[cut:]
            line = word
        out.append(line)
    return out


def new_text(page: Anchored, recs: list[int], text: str, most: float) -> bytes:
    """Operators that show text where the first of recs stood, in the font of most of their characters."""
    share: dict[str, int] = {}
    for i in recs:
        share[page.records[i]["font"]] = share.get(page.records[i]["font"], 0) + len(page.records[i]["text"])
    font = page.fonts[max(share, key=lambda k: share[k])]
    codes = font.inverse()
    if missing := sorted({c for c in text if c not in codes and not c.isspace()}):
        raise Refused("the font can't show " + " ".join(f"{c} (U+{ord(c):04X})" for c in missing))
    first, (_, tm, ctm, *_) = page.records[recs[0]], page.kept[recs[0]]
    size, m, bytes_each = first["size"], times(tm, ctm), 2 if font.two_byte else 1
    width = lambda s: sum((font.width(codes[c]) if c in codes else None) or 500 for c in s) / 1000 * size
    out = [f"BT {first['color']} /{font.name} {numeral(size)} Tf 0 Tr 0 Tc 0 Tw 100 Tz 0 Ts"]
    for k, line in enumerate(wrap(text, width, most)):
        spelled = b"".join(codes[c].to_bytes(bytes_each) for c in line if c in codes).hex()
        out.append(" ".join(map(numeral, times((1.0, 0.0, 0.0, 1.0, 0.0, -LEADING * size * k), m))) + f" Tm <{spelled}> Tj")
    return ("\n".join([*out, "ET\n"])).encode("latin-1")


def anchored(row: dict) -> Anchored:
    box = row["box"]
    if row["content"] is None:
        raise Refused("the page has no readable content")
    fonts = {name: Font.of(name, f) for name, f in dict(row["fonts"] or ()).items()}
    return Anchored(View(box["x"], box["y"], box["w"], box["h"], (row["rotate"] or 0) % 360), fonts, characters=False).run(row["content"])


def edit_page(row: dict) -> bytes:
    return edited(anchored(row), row["content"], row["edits"])


def edited(page: Anchored, content: bytes, edits: list[dict]) -> bytes:
    """content with all edits, whose recs are known."""
    removed: set[int] = set()
    for edit in edits:
        if not edit["recs"]:
            raise Refused("what is there doesn't spell the expected text")
        if why := [page.records[i]["reason"] or "this text can't be written again" for i in edit["recs"] if not page.records[i]["editable"]]:
            raise Refused(why[0])
        if removed & set(edit["recs"]):
            raise Refused("two edits take the same text")
        removed |= set(edit["recs"])
        if edit["push"] and any(g["type"] != "clip" and g["bottom"] > edit["bottom"] + SLACK and g["right"] > edit["x"] and g["x"] < edit["right"] for g in page.graphics):
            raise Refused(REFUSALS[8])
    shifts = {i: d for i, r in enumerate(page.records) if i not in removed and (d := sum(e["push"] or 0.0 for e in edits if r["top"] >= e["bottom"] - PAD and r["right"] > e["x"] and r["x"] < e["right"]))}
    if any(page.records[i]["bottom"] + d > page.view.size[1] for i, d in shifts.items()):
        raise Refused("text would leave the page")
    out = rewrite(page, content, removed, shifts)
    shown = b"".join(new_text(page, e["recs"], e["replacement"], e["right"] - page.records[e["recs"][0]]["x"] + PAD) for e in edits if e["replacement"])
    return b"q\n" + out + b"\nQ\n" + shown if shown else out


def edit_pages(pages: DataFrame, folded: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, page, content, ok and reason of each page that has edits (see EDIT; push moves what is below down by so much).

    folded is the fold of pages. An edit without expected text, or beside any
    text, is refused like one that doesn't match; a page that isn't there gives
    no row; a null page content is refused.
    """
    each = folded.join(edits.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, F.posexplode("records").alias("rec", "r")).select(*KEYS, "rec", "r.*")
    runs = matched_runs(in_rect(each, edits))
    told = edits.join(runs, [*KEYS, "edit"], "left").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("edit", "x", "right", "bottom", "replacement", "push", "recs"))).alias("edits"))
    kind = _parse_datatype_string("doc_id long, page int, content binary, ok boolean, reason string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({"content": edit_page(row), "ok": True, "reason": None})
                except (ValueError, ArithmeticError, IndexError) as e:
                    out.append({"content": row["content"], "ok": False, "reason": str(e)})
                out[-1] |= {k: row[k] for k in KEYS}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.join(told, KEYS).select(*KEYS, "box", "rotate", "content", "fonts", "edits").mapInArrow(run, kind)


#: What is asked of a page, from its doc_id, page and records: edits without recs.
Ask = Callable[[int, int, list[dict]], list[dict]]


def edited_row(row: dict, ask: Ask) -> tuple[bytes | None, bool, str | None] | None:
    """content, ok and reason of a page, of one fold. Null if it is asked nothing."""
    try:
        page = anchored(row)
        asked = ask(row["doc_id"], row["page"], page.records)
        return (edited(page, row["content"], [e | {"recs": run_of(page.records, e)} for e in asked]), True, None) if asked else None
    except (ValueError, ArithmeticError, IndexError) as e:
        return row["content"], False, str(e)


def edit_each(pages: DataFrame, ask: Ask, draw: Draw | None = None, contents: bool = True) -> DataFrame:
    """pages with content as edits make it, and ok and reason. What is asked of a page follows from the page itself.

    A page is folded once: what it is asked, the runs that match and its new
    bytes all come of that fold, in a narrow map without a shuffle. A page that
    is asked nothing gives no row; one that can't be read is refused. draw makes
    the page of a row that isn't one. Without contents only ok and reason come.
    """
    kind = _parse_datatype_string(f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page int, {f'{PAGE}, ' if contents else ''}ok boolean, reason string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(i, ROWS_AT_ONCE).to_pylist()
                made = [r | dict(zip(("content", "ok", "reason"), new)) for r in (map(draw, rows) if draw else rows) if r and (new := edited_row(r, ask))]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in made], f.type) for f in arrow], schema=arrow)

    return (pages if draw else pages.select(*KEYS, *(f.name for f in _parse_datatype_string(PAGE)))).mapInArrow(run, kind)
