"""Font models: from bytes to characters and widths."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

UNKNOWN = "�"


def winansi(code: int) -> str:
    """Code page 1252; its five holes are unknown."""
    return bytes([code]).decode("cp1252", "replace") if 0 <= code < 256 else UNKNOWN


def glyph_char(name: str) -> str:
    """The character of a glyph name: uniXXXX, uXXXXX, or a name of one sign; else unknown."""
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 else UNKNOWN
    base = name.split(".")[0]
    if m := re.fullmatch(r"([A-Za-z])([a-z]+)", base):
        made = unicodedata.normalize("NFC", m[1] + MARKS.get(m[2], ""))
        if m[2] in MARKS and len(made) == 1:
            return made
    return base if len(base) == 1 else GLYPHS.get(base, UNKNOWN)


# Names of glyphs beyond single letters, from the public glyph list.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•",
    "ellipsis": "…", "Euro": "€", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "nbspace": " ",
    "dagger": "†", "daggerdbl": "‡", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "plusminus": "±", "section": "§", "paragraph": "¶", "middot": "·", "periodcentered": "·", "sterling": "£",
    "yen": "¥", "cent": "¢", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "guillemotleft": "«", "guillemotright": "»", "quotesinglbase": "‚", "quotedblbase": "„", "exclamdown": "¡", "questiondown": "¿",
}

# Glyph names of marks on letters, as combining characters.
MARKS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030A", "hungarumlaut": "\u030B", "caron": "\u030C", "cedilla": "\u0327", "ogonek": "\u0328"}

# Base fonts that are one of the fourteen that every reader has, and its name.
STANDARD = {
    "Helvetica": "Helvetica", "Helvetica-Bold": "HelveticaBold", "Helvetica-Oblique": "HelveticaOblique", "Helvetica-BoldOblique": "HelveticaBoldOblique",
    "Courier": "Courier", "Courier-Bold": "CourierBold", "Courier-Oblique": "CourierOblique", "Courier-BoldOblique": "CourierBoldOblique",
    "Times-Roman": "TimesRoman", "Times-Bold": "TimesRomanBold", "Times-Italic": "TimesRomanItalic", "Times-BoldItalic": "TimesRomanBoldItalic", "Symbol": "Symbol", "ZapfDingbats": "ZapfDingbats",
    "Arial": "Helvetica", "Arial-Bold": "HelveticaBold", "Arial,Bold": "HelveticaBold", "ArialMT": "Helvetica", "Arial-BoldMT": "HelveticaBold",
    "TimesNewRoman": "TimesRoman", "TimesNewRomanPSMT": "TimesRoman", "CourierNew": "Courier",
}

# Published widths of Helvetica, and the characters that have them, in thousandths.
HELVETICA = {
    278: " !,./:;I[\\]ft", 355: '"', 556: "#$0123456789?L_abdeghnopqu", 889: "%", 667: "&ABEKPSVXY", 191: "'", 333: "()-`r", 389: "*", 584: "+<=>~", 1015: "@",
    722: "CDHNRUw", 611: "FTZ", 778: "GOQ", 500: "Jcksvxyz", 833: "Mm", 944: "W", 469: "^", 222: "ijl", 334: "{}", 260: "|",
}

#: Widths by standard font. What is not in here keeps waiting for its width.
METRICS: dict[str, dict[str, float]] = {
    **dict.fromkeys(("Courier", "CourierBold", "CourierOblique", "CourierBoldOblique"), dict.fromkeys(map(chr, (*range(0x20, 0x7F), *range(0xA0, 0x100))), 600.0)),
    **dict.fromkeys(("Helvetica", "HelveticaOblique"), {c: float(w) for w, chars in HELVETICA.items() for c in chars}),
}

#: Ranges of a character map name so many codes at most.
RANGE_CAP = 65_536


def utf16(hexed: str) -> str:
    return bytes.fromhex(hexed + "0" * (-len(hexed) % 4)).decode("utf-16-be", "replace")


def parse_to_unicode(cmap: str) -> dict[int, str]:
    """Codes to text from the bfchar and bfrange sections of a character map."""
    out: dict[int, str] = {}
    cell = r"<\s*([0-9A-Fa-f\s]+)>"
    squeeze = lambda s: re.sub(r"\s", "", s)
    for kind, body in re.findall(r"beginbf(char|range)(.*?)endbf\1", cmap, re.S):
        if kind == "char":
            for code, text in re.findall(rf"{cell}\s*{cell}", body):
                out[int(squeeze(code), 16)] = utf16(squeeze(text))
            continue
        for low, high, first, listed in re.findall(rf"{cell}\s*{cell}\s*(?:{cell}|\[(.*?)\])", body, re.S):
            a, b = int(squeeze(low), 16), int(squeeze(high), 16)
            codes = range(a, min(b, a + RANGE_CAP - 1) + 1)
            if listed:
                out |= {c: utf16(squeeze(t)) for c, t in zip(codes, re.findall(cell, listed))}
            elif first:
                text = utf16(squeeze(first))
                out |= {c: text[:-1] + chr(min(ord(text[-1]) + i, 0x10FFFF)) for i, c in enumerate(codes)}
    return out


def base_name(name: str | None) -> str:
    """A base font's name without the tag of a subset."""
    return re.sub(r"^[A-Z]{6}\+", "", (name or "").removeprefix("/"))


class Told(dict):
    """What a function says of a code, once asked for."""

    def __init__(self, tell: Callable[[int], float]):
        self.tell = tell

    def __missing__(self, code: int) -> float:
        made = self[code] = self.tell(code)
        return made


@lru_cache(256)
def one_byte_texts(plain: bool, to_unicode: tuple, differences: tuple) -> tuple[tuple[str, ...], str | None]:
    """The text of each code, and all in one string if each is one character."""
    font = Font("", to_unicode=dict(to_unicode), differences=dict(differences), plain=plain)
    texts = tuple(map(font.char, range(256)))
    return texts, "".join(texts) if all(len(x) == 1 for x in texts) else None


@dataclass
class Font:
    name: str
    base: str = ""
    two_byte: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default: float | None = None
    to_unicode: dict[int, str] = field(default_factory=dict)
    differences: dict[int, str] = field(default_factory=dict)
    editable: bool = True
    reason: str | None = None
    plain: bool = False
    #: Codes that the page has shown, with their text and width.
    decoded: dict[int, tuple[int, str, float | None]] = field(default_factory=dict, repr=False)
    #: Those of a one-byte font; steps by what they depend on.
    seen: bytes = field(default=b"", repr=False)
    made: dict[tuple, dict[int, float]] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, name: str, row: dict | None) -> Font:
        """The font of a row of the page relation.

        A two-byte font can be written again if it has a character map and its
        codes are glyphs as they stand (Identity-H). Of one-byte fonts, those
        with the encoding of Macintosh or the standard one show their codes
        plainly, all others code page 1252, both but for named differences.
        """
        row = row or {}
        two = row.get("subtype") == "Type0"
        known, encoding = dict(row.get("to_unicode") or ()), row.get("encoding") or ""
        writable = not two or bool(known) and "Identity-H" in encoding
        default = (1000.0 if row.get("default_width") is None else row["default_width"]) if two else None
        differences = {} if two else dict(row.get("differences") or ())
        return cls(name, base_name(row.get("base_font")), two, dict(row.get("widths") or ()), default, known, differences, writable, None if writable else "a two-byte font without Identity-H and a character map", any(e in encoding for e in ("MacRoman", "Standard")))

    @property
    def standard(self) -> str | None:
        return None if self.two_byte else STANDARD.get(self.base)

    def char(self, code: int) -> str:
        if (text := self.to_unicode.get(code)) is not None:
            return text
        if self.two_byte:
            return UNKNOWN
        if glyph := self.differences.get(code):
            return glyph_char(glyph)
        return chr(code) if self.plain else winansi(code)

    def width(self, code: int) -> float | None:
        """In thousandths. A one-byte font's zero counts as missing; a two-byte font has a default."""
        return self.widths.get(code, self.default) if self.two_byte else self.widths.get(code) or None

    def codes(self, data: bytes) -> Sequence[int]:
        """A last odd byte of a two-byte font shows nothing."""
        return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)] if self.two_byte else data

    def note(self, codes: Sequence[int]) -> None:
        """Keeps what codes that are shown stand for."""
        if self.two_byte or codes.translate(None, self.seen):
            for c in set(codes).difference(self.decoded):
                self.decoded[c] = c, self.char(c), self.width(c)
            self.seen = b"" if self.two_byte else bytes(self.decoded)

    def decode(self, data: bytes):
        """(code, text, width or None) of each glyph."""
        codes = self.codes(data)
        self.note(codes)
        return [self.decoded[c] for c in codes]

    def read(self, codes: Sequence[int]) -> str | list[str]:
        """The texts of codes that are shown, as a string if each is one character."""
        self.note(codes)
        if self.two_byte:
            return [self.decoded[c][1] for c in codes]
        texts, table = self.texts
        return codecs.charmap_decode(codes, "strict", table)[0] if table else [texts[c] for c in codes]

    @cached_property
    def texts(self) -> tuple[tuple[str, ...], str | None]:
        return one_byte_texts(self.plain, tuple(self.to_unicode.items()), tuple(self.differences.items()))

    @cached_property
    def bare(self) -> bool:
        """Whether no code has a width."""
        return not self.two_byte and not any(self.widths.values())

    def lacks(self, codes: Sequence[int]) -> bool:
        """Whether a code that is shown has no width."""
        return self.bare or None in {self.decoded[c][2] for c in set(codes)}

    def even_step(self, size: float, spacing: float, stretch: float) -> float | None:
        """How far any glyph advances, blanks with word spacing aside, if all advance as far."""
        return (0.5 * size + spacing) * stretch if self.bare else None

    def steps(self, size: float, spacing: float, word: float, stretch: float) -> dict[int, float]:
        """How far each code advances; a missing width counts as half the size."""

        if made := self.made.get((size, spacing, word, stretch)):
            return made

        def step(code: int) -> float:
            width = self.width(code)
            made = ((500 if width is None else width) / 1000 * size + spacing) * stretch
            return made + word * stretch if word and code == 32 else made

        return self.made.setdefault((size, spacing, word, stretch), Told(step))

    def settled(self, known: dict[str, float], size: float, spacing: float, word: float, stretch: float) -> dict[int, float]:
        """The same with a standard font's widths; stretch in hundredths."""

        if made := self.made.get((id(known), size, spacing, word, stretch)):
            return made

        def step(code: int) -> float:
            width = self.width(code)
            return ((known.get(self.char(code), 500.0) if width is None else width) / 1000 * size + spacing + (word if code == 32 else 0.0)) * stretch / 100

        return self.made.setdefault((id(known), size, spacing, word, stretch), Told(step))

    def used(self) -> dict[int, str]:
        """The codes that have been shown, with their text."""
        return {c: text for c, text, _ in self.decoded.values()}

    def inverse(self) -> dict[str, int]:
        """Texts to codes that the font is sure to show.

        A two-byte font shows what its character map names. A one-byte code
        needs a width, or a standard font if there are no widths at all, or to
        have been shown; shown codes go first, then the least, and of shown
        ones the last.
        """
        if self.two_byte:
            return {text: c for c, text in sorted(self.to_unicode.items(), reverse=True) if text} if self.editable else {}
        out: dict[str, int] = {}
        for c in range(256):
            named = c in self.to_unicode or self.differences.get(c)
            text = self.char(c)
            if text == UNKNOWN or self.plain and not named and not 32 <= c <= 126:
                continue
            if c not in self.decoded and not (self.width(c) if self.widths else self.standard):
                continue
            if text not in out or c in self.decoded:
                out[text] = c
        return out
