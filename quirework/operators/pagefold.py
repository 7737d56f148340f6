"""From page content to relations: text records, fill covers, hidden spans, graphics.

A content stream is a program for a stack machine, so one fold reads it, once,
and keeps two graphics states side by side: that of text, where saving and
restoring touch the transformation and the clip alone, and that of fills, where
they touch colour and alpha as well. Everything after the fold is relational.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import accumulate, chain, repeat
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quirework.sources.fonts import Font

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

BLANKS, DELIMITERS = b"\\x00\\t\\n\\x0c\\r\\x20", b"()<>\\[\\]{}/%"
REGULAR = b"[^" + BLANKS + DELIMITERS + b"]"
LEXER = re.compile(
    b"(?:[" + BLANKS + b"]++|%[^\\r\\n]*+)*+(?:"
    b"(?P<name>/" + REGULAR + b"*)"
    b"|(?P<open>\\()"
    b"|(?P<dict><<|>>)"
    b"|(?P<hex><[^>]*>?)"
    b"|(?P<array>[\\[\\]])"
    b"|(?P<num>[0-9+\\-.]" + REGULAR + b"*)"
    b"|(?P<op>" + REGULAR + b"+)"
    b"|(?P<stray>.))",
    re.S,
)
#: A line of numbers, names and operators, or what of it stands before a string, and the string. Where none begins, the stream is read token by token.
PIECE = re.compile(b"([^()<>\\[\\]{}%\\r\\n]*+[\\r\\n]?)(\\((?:[^\\\\()]++|\\\\.)*+\\))?", re.S)
#: Longer pieces hardly recur and aren't kept.
KEPT = 256
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r\n": b"", b"\n": b"", b"\r": b""}
STRING_PART = re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|([^\\()]+)|(\\)", re.S)
IMAGE_END = re.compile(b"[" + BLANKS + b"]EI(?=[" + BLANKS + DELIMITERS + b"]|$)")


class Token(NamedTuple):
    kind: str  # name, num, str, op, dictopen, dictclose, arrayopen, arrayclose
    value: object
    s: int
    e: int

    @property
    def number(self) -> float:
        return self.value if self.kind == "num" else 0.0


def read_string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its opening bracket, and where it ends. One that never closes ends with the data."""
    out, depth = bytearray(), 1
    for m in STRING_PART.finditer(data, at):
        if m[3] is not None:
            out += m[3]
        elif m[2] is not None:
            depth += 1 if m[2] == b"(" else -1
            if not depth:
                return bytes(out), m.end()
            out += m[2]
        elif m[1] is not None:
            out += ESCAPES[m[1]] if m[1] in ESCAPES else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else m[1]
    return bytes(out), len(data)


@lru_cache(1 << 14)
def number(raw: bytes) -> float:
    found = NUMBER.match(raw)
    return float(found[0]) if found else 0.0


@lru_cache(1 << 14)
def name_of(raw: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw[1:]).decode("latin-1")


@lru_cache(1 << 14)
def operator_of(raw: bytes) -> str:
    return raw.decode("latin-1")


def tokens(data: bytes, at: int = 0) -> Iterator[Token]:
    """The tokens of a content stream from a place on; s and e are byte offsets. Keywords such as true count as operators; an inline image is one."""
    match = LEXER.match
    while m := match(data, at):
        kind, at = m.lastgroup, m.end()
        raw = m[kind]
        start = at - len(raw)
        if kind == "num":
            yield Token("num", number(raw), start, at)
        elif kind == "name":
            yield Token("name", name_of(raw), start, at)
        elif kind == "open":
            text, at = read_string(data, at)
            yield Token("str", text, start, at)
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            yield Token("str", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), start, at)
        elif kind == "dict":
            yield Token("dictopen" if raw == b"<<" else "dictclose", None, start, at)
        elif kind == "array":
            yield Token("arrayopen" if raw == b"[" else "arrayclose", None, start, at)
        elif kind == "op":
            if raw == b"BI":
                end = IMAGE_END.search(data, at)
                at = end.end() if end else len(data)
                yield Token("op", "BI..EI", start, at)
            else:
                yield Token("op", operator_of(raw), start, at)


#: An operator with its operands, the bytes of the operands' numbering, and its own bytes.
Operation = tuple[str, tuple[Token, ...], tuple[float, ...], int, int]


@lru_cache(1 << 14)
def operations(raw: bytes) -> tuple[tuple[Operation, ...], tuple[Token, ...]] | None:
    """The operators of a piece without strings, and the operands left after the last. Pieces recur from line to line and page to page. Null: an inline image begins in it."""
    out, args = [], []
    for token in tokens(raw):
        if token.value == "BI..EI":
            return None
        if token.kind != "op":
            args.append(token)
            continue
        if not out or token.value not in PASSIVE or token.value in HANDLERS:
            out.append((token.value, tuple(args), tuple(a.number for a in args), token.s, token.e))
        args = []
    return tuple(out), tuple(args)


@lru_cache(1 << 14)
def colour(args: tuple[Token, ...], op: str) -> str:
    return " ".join(f"{round(a.number, 4):g}" if a.kind == "num" else str(a.value) for a in args) + f" {op}"


@lru_cache(1 << 12)
def evenly(step: float, n: int) -> float:
    """n steps, added one after another."""
    return reduce(add, repeat(step, n), 0.0)


class Glyphs:
    """The characters of a record, and the edges between them, which are told when asked for: most never are."""

    __slots__ = ("texts", "steps", "scale", "x")

    def __init__(self, texts: list, steps: list[float], scale: float, x: float):
        self.texts, self.steps, self.scale, self.x = texts, steps, scale, x

    @property
    def unis(self) -> list[str]:
        return list(chain.from_iterable(self.texts))

    @property
    def edges(self) -> list[float]:
        scale = self.scale
        return list(accumulate([step * scale for step in self.steps], initial=self.x))


def times(m: Matrix, n: Matrix) -> Matrix:
    """m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass
class View:
    """The rotated view of a page box; places in it count from above left."""

    x: float
    y: float
    w: float
    h: float
    rotate: int

    @property
    def size(self) -> tuple[float, float]:
        return (self.h, self.w) if self.rotate in (90, 270) else (self.w, self.h)

    def place(self, x: float, y: float) -> tuple[float, float]:
        u, v = x - self.x, y - self.y
        if not self.rotate:
            return u, self.h - v
        return {90: (v, u), 180: (self.w - u, v), 270: (self.h - v, self.w - u)}.get(self.rotate, (u, self.h - v))

    def rect(self, points: list[tuple[float, float]]) -> dict:
        """What bounds points of page space, in the view."""
        xs, ys = zip(*points)
        if not self.rotate:
            return {"x": min(xs) - self.x, "top": self.h - (max(ys) - self.y), "right": max(xs) - self.x, "bottom": self.h - (min(ys) - self.y)}
        a, b = self.place(min(xs), min(ys)), self.place(max(xs), max(ys))
        return {"x": min(a[0], b[0]), "top": min(a[1], b[1]), "right": max(a[0], b[0]), "bottom": max(a[1], b[1])}

    def upright(self, m: Matrix) -> bool:
        return upright(self.rotate, *m[:4])


@lru_cache(1 << 12)
def upright(rotate: int, a: float, b: float, c: float, d: float) -> bool:
    """Whether text with this matrix stands upright in the rotated view."""
    scale = (c**2 + d**2) ** 0.5
    near = lambda *v: all(abs(x) < 0.02 * scale for x in v)
    match rotate:
        case _ if not scale:
            return False
        case 90:
            return near(a, d) and b > 0 > c
        case 180:
            return near(b, c) and a < 0 and d < 0
        case 270:
            return near(a, d) and b < 0 < c
    return abs(b) <= 0.001 and abs(c) <= 0.001


def luminance(space: str, c: list[float]) -> float | None:
    if space == "cmyk":
        c, space = [1 - min(1, x + c[3]) for x in c[:3]], "rgb"
    return c[0] if space == "gray" else 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2] if space == "rgb" else None


SPACES = {1: "gray", 3: "rgb", 4: "cmyk"}
#: How many numbers a path operator takes, and which of them are points' first coordinates.
PATHS = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4}
PASSIVE = frozenset("w J j M d ri i gs cs CS SC SCN G RG K BMC BDC EMC MP DP d0 d1 Tr h q Q ET".split())


@dataclass
class Page:
    """One page's fold. Call run(), then read the lists."""

    view: View
    fonts: dict[str, Font]
    alphas: dict[str, float] = field(default_factory=dict)
    hidden: frozenset[str] = frozenset()
    images: frozenset[str] = frozenset()
    #: Widths of characters by standard font, for glyphs without one.
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Whether records have their characters, with their places.
    characters: bool = True

    def __post_init__(self):
        self.records: list[dict] = []
        self.covers: list[dict] = []
        self.spans: list[dict] = []
        self.graphics: list[dict] = []
        self.unknown: dict[str, int] = {}
        self.forms = self.type0 = 0
        # The state of text and of fills: each has a stack of its own.
        self.ctm, self.saved = IDENTITY, []
        self.fill, self.fills = ("gray", [0.0], 1.0), []
        self.tm = self.tlm = IDENTITY
        self.font: Font | None = None
        self.size = self.leading = self.spacing = self.word = self.rise = self.mode = 0.0
        self.stretch = 100.0
        self.clip: list[tuple[float, float]] | None = None
        self.path: list[tuple[float, float]] = []
        self.drawn: list[tuple[float, float]] = []
        self.marked: list[tuple[str | None, str | None, int]] = []
        self.color, self.chain = "0 0 0 rg", 0

    def run(self, content: bytes) -> Page:
        at, match, end, held = 0, PIECE.match, len(content), ()
        while at < end:
            m = match(content, at)
            plain, string = m.groups()
            found = (operations if len(plain) <= KEPT else operations.__wrapped__)(plain) if plain else None
            if found:
                done, left = found
                if held and done:
                    op, args, n, s, e = done[0]
                    self.base = 0
                    args = (*held, *(a._replace(s=at + a.s, e=at + a.e) for a in args))
                    self.step(op, args, tuple(a.number for a in args), at + s, at + e)
                    held, done = (), done[1:]
                self.base = at
                for op, args, n, s, e in done:
                    self.step(op, args, n, at + s, at + e)
                held = (*held, *(a._replace(s=at + a.s, e=at + a.e) for a in left)) if left else held
            if string and (found or not plain):
                a, at = m.span(2)
                held = (*held, Token("str", read_string(content, a + 1)[0] if b"\\" in string else string[1:-1], a, at))
            elif found:
                at = m.end(1)
            else:
                self.base = 0
                for token in tokens(content, at):
                    if token.kind == "op":
                        break
                    held = (*held, token)
                else:
                    return self
                at = token.e
                self.step(token.value, held, tuple(a.number for a in held), token.s, at)
                held = ()
        return self

    def step(self, op: str, args: tuple[Token, ...], n: tuple[float, ...], s: int, e: int) -> None:
        """An operator at bytes s to e, with its operands, whose bytes count from base, and the operands' numbers."""
        handler = HANDLERS.get(op)
        if handler:
            handler(self, op, args, n, s, e)
        elif op not in PASSIVE:
            self.unknown[op] = self.unknown.get(op, 0) + 1

    # Graphics state

    def save(self, op, args, n, s, e):
        self.saved.append((self.ctm, self.clip))
        self.fills.append(self.fill)

    def restore(self, op, args, n, s, e):
        self.ctm, self.clip = self.saved.pop() if self.saved else (IDENTITY, None)
        if self.fills:
            self.fill = self.fills.pop()

    def concat(self, op, args, n, s, e):
        if len(n) >= 6:
            self.ctm = times(tuple(n[-6:]), self.ctm)

    def alpha(self, op, args, n, s, e):
        name = args[-1].value if args else None
        if name in self.alphas:
            self.fill = (*self.fill[:2], self.alphas[name])

    def paint_in(self, op, args, n, s, e):
        """Colour operators; a pattern's luminance is unknown."""
        self.color = colour(args, op)
        need = {"g": 1, "rg": 3, "k": 4}.get(op)
        if need:
            if len(args) >= need:
                self.fill = (SPACES[need], n[-need:], self.fill[2])
            return
        comps = [a.number for a in args if a.kind == "num"]
        if args and args[-1].kind == "name":
            self.fill = ("pattern", [], self.fill[2])
        else:
            self.fill = (SPACES.get(len(comps), "pattern"), comps, self.fill[2])

    # Paths

    def reach(self, *points: tuple[float, float]) -> None:
        self.path += (done := [moved(self.ctm, *p) for p in points])
        self.drawn += done

    def draw(self, op, args, n, s, e):
        if len(n) >= (k := PATHS[op]):
            v = n[-k:]
            self.reach(*zip(v[::2], v[1::2]))

    def rectangle(self, op, args, n, s, e):
        if len(n) >= 4:
            x, y, w, h = n[-4:]
            self.reach((x, y), (x + w, y), (x + w, y + h), (x, y + h))

    def filled(self, op, args, n, s, e):
        if self.path:
            space, comps, alpha = self.fill
            self.covers.append({"op_offset": s, **self.view.rect(self.path), "gray": luminance(space, comps), "alpha": alpha, "color_space": space, "comps": list(comps)})
        self.path = []
        self.outline("path")

    def dropped(self, op, args, n, s, e):
        self.path = []
        self.outline("clip" if op == "n" else "path")

    def clipped(self, op, args, n, s, e):
        if self.drawn:
            xs, ys = zip(*self.drawn)
            low, high = (min(xs), min(ys)), (max(xs), max(ys))
            self.clip = [low, high] if not self.clip else [tuple(map(max, self.clip[0], low)), tuple(map(min, self.clip[1], high))]

    def outline(self, kind: str) -> None:
        if self.drawn:
            clip = self.view.rect(self.clip) if self.clip else {}
            self.graphics.append({"type": kind, **self.view.rect(self.drawn), "clip_top": clip.get("top"), "clip_bottom": clip.get("bottom")})
        self.drawn = []

    def unit(self, kind: str) -> None:
        corners = [moved(self.ctm, *p) for p in ((0, 0), (1, 0), (0, 1), (1, 1))]
        self.graphics.append({"type": kind, **self.view.rect(corners), "clip_top": None, "clip_bottom": None})

    def placed(self, op, args, n, s, e):
        if op == "Do":
            image = bool(args) and args[-1].value in self.images
            self.forms += not image
            self.unit("image" if image else "xobject")
        else:
            self.unit("shading" if op == "sh" else "image")

    # Marked content

    def begin_marked(self, op, args, n, s, e):
        names = [a.value for a in args if a.kind == "name"]
        self.marked.append((names[0] if names else None, names[-1] if len(names) > 1 else None, e))

    def end_marked(self, op, args, n, s, e):
        tag, prop, start = self.marked.pop() if self.marked else (None, None, 0)
        if tag == "OC" and prop in self.hidden:
            self.spans.append({"s": start, "e": s, "name": prop})

    # Text

    def begin_text(self, op, args, n, s, e):
        self.tm = self.tlm = IDENTITY
        self.chain += 1

    def select_font(self, op, args, n, s, e):
        if len(args) >= 2:
            self.font, self.size = self.fonts.get(args[-2].value), n[-1]

    def set_number(self, op, args, n, s, e):
        if n:
            setattr(self, {"TL": "leading", "Tr": "mode", "Tc": "spacing", "Tw": "word", "Tz": "stretch", "Ts": "rise"}[op], n[-1])

    def set_matrix(self, op, args, n, s, e):
        if len(n) >= 6:
            self.tm = self.tlm = tuple(n[-6:])
            self.chain += 1

    def shift(self, x: float, y: float) -> None:
        self.tm = self.tlm = times((1.0, 0.0, 0.0, 1.0, x, y), self.tlm)

    def move_text(self, op, args, n, s, e):
        if len(n) >= 2:
            if op == "TD":
                self.leading = -n[-1]
            self.shift(n[-2], n[-1])

    def next_line(self, op, args, n, s, e):
        self.shift(0.0, -self.leading)

    def show(self, op, args, n, s, e):
        start = self.base + args[-1].s if args else s
        if op == '"':
            if len(args) < 3:
                return
            self.word, self.spacing, start = n[-3], n[-2], self.base + args[-3].s
        if op in "'\"":
            self.shift(0.0, -self.leading)
        if args and args[-1].kind == "str":
            self.emit([args[-1].value], start, e)

    def show_array(self, op, args, n, s, e):
        if not args or args[-1].kind != "arrayclose":
            return
        depth, parts, start = 0, [], s
        for a in reversed(args[:-1]):
            if a.kind == "arrayopen":
                if not depth:
                    start = self.base + a.s
                    break
                depth -= 1
            elif a.kind == "arrayclose":
                depth += 1
            elif a.kind in ("str", "num"):
                parts.append(a.value)
        self.emit(parts[::-1], start, e)

    def emit(self, parts: list, start: int, end: int) -> None:
        """A record for one show: glyph by glyph, a missing width counts as half the size."""
        if not self.font or not self.size:
            return
        font, size, stretch, rise = self.font, self.size, self.stretch / 100, self.rise
        advance, pending = 0.0, False
        texts: list = []
        single = True
        steps: list[float] = []
        shown: list = []
        even = font.even_step(size, self.spacing, stretch)
        for part in parts:
            if not isinstance(part, bytes):
                advance -= part / 1000 * size * stretch
                continue
            codes = font.codes(part)
            if not codes:
                continue
            texts.append(text := font.read(codes))
            single = single and isinstance(text, str)
            shown.append(codes)
            pending = pending or font.lacks(codes)
            if even is not None and not (self.word and 32 in codes):
                advance = reduce(add, repeat(even, len(codes)), advance) if advance else evenly(even, len(codes))
                each = [even] * len(codes) if self.characters else ()
            else:
                made = font.steps(size, self.spacing, self.word, stretch)
                each = [made[c] for c in codes]
                advance = reduce(add, each, advance)
            if self.characters:
                steps += each
        m = times(self.tm, self.ctm)
        a, b, c, d, x, y = m
        low, high, at_x, at_y = rise - 0.22 * size, rise + 0.88 * size, a * 0 + c * rise + x, b * 0 + d * rise + y
        rect = self.view.rect([(at_x, at_y), (a * advance + c * rise + x, b * advance + d * rise + y), (a * 0 + c * high + x, b * 0 + d * high + y), (a * 0 + c * low + x, b * 0 + d * low + y)])
        scale = (rect["right"] - rect["x"]) / advance if advance else 0.0
        whole = self.view.upright(m)
        text = "".join(texts if single else chain.from_iterable(texts))
        self.records.append(
            {
                "s": start, "e": end, "chain": self.chain, "text": text, **rect, "baseline": self.view.place(at_x, at_y)[1], "advance": advance, "font": font.name, "size": size,
                "size_dev": size * (c**2 + d**2) ** 0.5, "render_mode": int(self.mode), "editable": font.editable and whole,
                "reason": font.reason if not font.editable else None if whole else "rotated or skewed text", "color": self.color, "pending_widths": pending, "chars": Glyphs(texts if self.characters else [], steps, scale, rect["x"]),
            }
        )
        if pending and (known := self.metrics.get(font.standard)):
            self.settle(self.records[-1], list(chain.from_iterable(shown)), known, m)
        self.type0 += font.two_byte
        self.tm = times((1.0, 0.0, 0.0, 1.0, advance, 0.0), self.tm)

    def settle(self, record: dict, shown: list[int], known: dict[str, float], m: Matrix) -> None:
        """Gives glyphs without a width the one of the standard font. What follows stays where it was put; kerning doesn't count, and turned text keeps its place."""
        made = self.font.settled(known, self.size, self.spacing, self.word, self.stretch)
        steps = [made[code] for code in shown]
        record |= {"advance": sum(steps), "pending_widths": False}
        if self.view.rotate or max(abs(self.tm[1]), abs(self.tm[2])) >= 0.001:
            return
        ends = [moved(m, x, 0.0)[0] - self.view.x for x in (0.0, record["advance"])]
        record |= {"x": min(ends), "right": max(ends)}
        scale = (record["right"] - record["x"]) / record["advance"] if record["advance"] else 0.0
        if self.characters:
            record["chars"] = Glyphs(record["chars"].texts, steps, scale, record["x"])


HANDLERS = {
    **dict.fromkeys(("g", "rg", "k", "sc", "scn"), Page.paint_in),
    **dict.fromkeys(PATHS, Page.draw),
    **dict.fromkeys(("f", "F", "f*", "B", "B*", "b", "b*"), Page.filled),
    **dict.fromkeys(("S", "s", "n"), Page.dropped),
    **dict.fromkeys(("W", "W*"), Page.clipped),
    **dict.fromkeys(("Do", "BI..EI", "sh"), Page.placed),
    **dict.fromkeys(("BDC", "BMC"), Page.begin_marked),
    **dict.fromkeys(("TL", "Tr", "Tc", "Tw", "Tz", "Ts"), Page.set_number),
    **dict.fromkeys(("Td", "TD"), Page.move_text),
    **dict.fromkeys(("Tj", "'", '"'), Page.show),
    "q": Page.save, "Q": Page.restore, "cm": Page.concat, "gs": Page.alpha, "re": Page.rectangle, "EMC": Page.end_marked, "BT": Page.begin_text,
    "Tf": Page.select_font, "Tm": Page.set_matrix, "T*": Page.next_line, "TJ": Page.show_array,
}

RECT = "x:double,top:double,right:double,bottom:double"
RECORD = f"s:int,e:int,chain:int,text:string,{RECT},baseline:double,advance:double,font:string,size:double,size_dev:double,render_mode:int,editable:boolean,reason:string,color:string,pending_widths:boolean,chars:array<struct<uni:string,x0:double,x1:double>>"
COVER = f"op_offset:int,{RECT},gray:double,alpha:double,color_space:string,comps:array<double>"
GRAPHIC = f"type:string,{RECT},clip_top:double,clip_bottom:double"
FOLDED = (
    f"vw double, vh double, records array<struct<{RECORD}>>, covers array<struct<{COVER}>>, spans array<struct<s:int,e:int,name:string>>, graphics array<struct<{GRAPHIC}>>, "
    "unknown_ops map<string,int>, used_codes map<string,map<int,string>>, form_xobjects int, type0_runs int, error string"
)
#: What a page relation holds besides doc_id and page.
PAGE = (
    "box struct<x:double,y:double,w:double,h:double>, rotate int, content binary, fonts map<string,struct<subtype:string,base_font:string,widths:map<int,double>,to_unicode:map<int,string>,default_width:double,encoding:string,differences:map<int,string>>>, "
    "gs_alpha map<string,double>, hidden_names array<string>, images array<string>, annots array<struct<subtype:string,x:double,top:double,right:double,bottom:double>>"
)


#: What a fold reads of it.
FOLDS = ("doc_id", "page", "box", "rotate", "content", "fonts", "gs_alpha", "hidden_names", "images", "annots")


def fold_page(row: dict, metrics: dict[str, dict[str, float]] | None = None, characters: bool = True) -> dict:
    box, rotate = row["box"], (row["rotate"] or 0) % 360
    view = View(box["x"], box["y"], box["w"], box["h"], rotate)
    vw, vh = view.size
    out = {"vw": vw, "vh": vh, "records": [], "covers": [], "spans": [], "graphics": [], "unknown_ops": {}, "used_codes": {}, "form_xobjects": 0, "type0_runs": 0, "error": None}
    if row["content"] is None:
        return out | {"error": "the page has no readable content"}
    fonts = {name: Font.of(name, f) for name, f in dict(row["fonts"] or ()).items()}
    try:
        page = Page(view, fonts, dict(row["gs_alpha"] or ()), frozenset(row["hidden_names"] or ()), frozenset(row["images"] or ()), metrics or {}, characters).run(row["content"])
    except (ValueError, ArithmeticError, IndexError) as e:
        return out | {"error": f"the page's content could not be read: {e}"}
    return out | {"records": page.records, "covers": page.covers, "spans": page.spans, "graphics": page.graphics, "unknown_ops": page.unknown, "used_codes": {name: list(used.items()) for name, f in fonts.items() if (used := f.used())}, "form_xobjects": page.forms, "type0_runs": page.type0}


def offsets(lists: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def chars_array(glyphs: list[Glyphs], kind: pa.ListType) -> pa.Array:
    """The characters of many records, column by column: a page has thousands, too many for a dict each."""
    unis, each = [g.unis for g in glyphs], [g.edges for g in glyphs]
    edges = np.fromiter(chain.from_iterable(each), float)
    last = np.cumsum([len(e) for e in each], dtype=np.int64) - 1
    starts, ends = np.ones(len(edges), bool), np.ones(len(edges), bool)
    starts[last] = False
    ends[np.append(0, last[:-1] + 1)[: len(each)]] = False
    columns = pa.array(list(chain.from_iterable(unis)), pa.string()), pa.array(edges[starts]), pa.array(edges[ends])
    return pa.ListArray.from_arrays(offsets(unis), pa.StructArray.from_arrays(list(columns), fields=list(kind.value_type)))


def folded_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in schema:
        values = [r[f.name] for r in rows]
        if f.name == "records":
            flat = list(chain.from_iterable(values))
            parts = list(f.type.value_type)
            made = [chars_array([r["chars"] for r in flat], p.type) if p.name == "chars" else pa.array([r[p.name] for r in flat], p.type) for p in parts]
            columns.append(pa.ListArray.from_arrays(offsets(values), pa.StructArray.from_arrays(made, fields=parts)))
        else:
            columns.append(pa.array([list(v.items()) for v in values] if f.name in ("unknown_ops", "used_codes") else values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


#: Makes the page of a row that isn't one yet, where it is folded; null: there is none.
Draw = Callable[[dict], dict | None]


def fold_pages(pages: DataFrame, characters: bool = True, rows_at_once: int = 64, metrics: dict[str, dict[str, float]] | None = None, draw: Draw | None = None, fields: str = f"annots array<struct<subtype:string,{RECT}>>, {FOLDED}") -> DataFrame:
    """doc_id, page, annots, and what the fold of each page found. A page that can't be read has error set. No shuffle.

    Without characters, records have none: they are most of what a fold puts out.
    With metrics, glyphs of standard fonts that have no width get theirs. With
    draw, pages are rows of any kind with doc_id and page, and no page leaves
    the pass that folds it. fields tells what is put out, as a schema: less
    than all, of pages and of records.
    """
    kind = _parse_datatype_string(f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page int, {fields}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(i, rows_at_once).to_pylist()
                drawn = map(draw, rows) if draw else rows
                yield folded_batch([{k: r[k] for k in ("doc_id", "page", "annots")} | fold_page(r, metrics, characters) for r in drawn if r], arrow)

    return (pages if draw else pages.select(*FOLDS)).mapInArrow(run, kind)
