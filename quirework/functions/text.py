"""Scalar functions on text, as column expressions.

Lengths that a document tool reports count UTF-16 units; Spark's count code
points. White space is spelled out, for neither Java's nor SQL's notion of it
takes in the no-break space. Rounding is half up, towards positive infinity.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Characters that count as blank.
BLANK = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

# The code points above U+00FF that code page 1252 has.
CP1252_EXTRA = "\\u20AC\\u201A\\u0192\\u201E\\u2026\\u2020\\u2021\\u02C6\\u2030\\u0160\\u2039\\u0152\\u017D\\u2018\\u2019\\u201C\\u201D\\u2022\\u2013\\u2014\\u02DC\\u2122\\u0161\\u203A\\u0153\\u017E\\u0178"
EXTRA = CP1252_EXTRA.encode().decode("unicode_escape")


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{BLANK}]+|[{BLANK}]+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(js_trim(x), F.lit("")) == ""


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, as text, without separators of thousands."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def mask(x: Column) -> Column:
    """Bullets in place of a text, 24 at most, and how many characters it has."""
    n = utf16_length(x)
    return F.concat(F.repeat(F.lit("•"), F.least(n, F.lit(24))), F.when(n > 24, "…").otherwise(""), F.lit(" ("), n.cast("string"), F.when(n == 1, " character)").otherwise(" characters)"))


def csv_cell(x: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: those signs get an apostrophe first; then it is quoted where need be."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    s = F.when(F.rlike(s, F.lit("^[=+\\-@\\t\\r]")), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(F.rlike(s, F.lit('[",\\n\\r]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_cell_plain(x: Column) -> Column:
    """A cell of the plain dialect: quoted where need be, and left alone otherwise."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(F.rlike(s, F.lit('[",\\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(cells: list[Column], plain: bool = False) -> Column:
    return F.concat_ws(",", *((csv_cell_plain if plain else csv_cell)(c) for c in cells))


def sanitize_winansi(x: Column) -> Column:
    """What code page 1252 can't show becomes a question mark for each UTF-16 unit."""
    two = F.regexp_replace(x, "[\\x{10000}-\\x{10FFFF}]", "??")
    return F.regexp_replace(two, f"[^\\x{{0}}-\\x{{FF}}{CP1252_EXTRA}]", "?")


def dropped_characters(x: Column) -> Column:
    """The characters that sanitize_winansi takes out, each once, in order of their first place; null has none.

    One range is looked for, and the few others are taken off what is found: a
    class of many ranges is tried one by one at each character.
    """
    beyond = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[^\\x{0}-\\x{FF}]"), F.lit(0))
    return F.array_except(beyond, F.array(*map(F.lit, EXTRA)))


@F.pandas_udf(ArrayType(StructType().add("char", StringType()).add("code", StringType()).add("index", IntegerType())))
def offenders(x: pd.Series) -> pd.Series:
    """Units of UTF-16 by a table of all of them."""
    fine = np.zeros(1 << 16, bool)
    fine[0x20:0x7F] = fine[0xA0:0x100] = True
    fine[[*map(ord, EXTRA)]] = True

    def found(text: str | None) -> list[dict]:
        units = np.frombuffer((text or "").encode("utf-16-be", "surrogatepass"), ">u2")
        places = np.flatnonzero(~fine[units])
        return [{"char": "\uFFFD" if 0xD800 <= u < 0xE000 else chr(u), "code": f"U+{u:04X}", "index": i} for i, u in zip(places.tolist(), units[places].tolist())]

    return x.map(found)


def winansi_offenders(x: Column) -> Column:
    """What can't be shown, as an array of (char, code, index), by UTF-16 unit, counted from 0. Every control character offends.

    Half of a pair is no character that a Spark string can hold: its char is U+FFFD.
    """
    return offenders(F.coalesce(x, F.lit("")))


def winansi_encodable(x: Column) -> Column:
    return F.rlike(x, F.lit(f"^[\\t\\n\\r\\x20-\\x7E\\xA0-\\xFF{CP1252_EXTRA}]*$"))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


#: (what, its plain form), in order.
FOLDS = (
    ("[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", ""),
    ("[\\u2018\\u2019\\u201A\\u2032]", "'"),
    ("[\\u201C\\u201D\\u201E\\u2033]", '"'),
    ("[\\u2010-\\u2015\\u2212]", "-"),
)


def fold_text(x: Column) -> Column:
    """Soft hyphens and zero-width characters go; quotes and dashes take their plain form."""
    for what, plain in FOLDS:
        x = F.regexp_replace(x, what, plain)
    return x


def norm_text(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return js_trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{BLANK}]+", " "))


def cmp_key(x: Column) -> Column:
    """What two texts have in common if they read alike: composed, folded, without white space, in lower case."""
    return F.lower(F.regexp_replace(fold_text(nfkc(x)), f"[{BLANK}]", ""))


def cmp_key_of(s: str | None) -> str | None:
    """cmp_key of one text, where a page is at hand."""
    if s is None:
        return None
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        for what, plain in FOLDS:
            s = re.sub(what, plain, s)
    return re.sub(f"[{BLANK}]", "", s).lower()


def same_text(ours: Column, theirs: Column) -> Column:
    """Equal place by place; where ours could not be read (U+FFFD), anything will do."""
    a, b = F.split(ours, ""), F.split(theirs, "")
    return (F.length(ours) == F.length(theirs)) & F.forall(F.zip_with(a, b, lambda p, q: (p == "�") | (p == q)), lambda x: x)


def pad_left(x: Column, width: int) -> Column:
    """Zeros in front up to width; longer values stay whole."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def bates_label(prefix: Column, number: Column, digits: int, suffix: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), pad_left(number, digits), F.coalesce(suffix, F.lit("")))


def bates_overflows(first: Column, count: Column, digits: int) -> Column:
    return F.length((first + count - 1).cast("string")) > digits


def number_to_letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: base 26 without zero. Below 1: empty."""
    letter = lambda v: F.char(F.lit(65) + F.pmod(v, F.lit(26)).cast("int"))
    begin = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(acc["n"] <= 0, acc).otherwise(F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(letter(acc["n"] - 1), acc["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), begin, step, lambda acc: acc["s"])


def letters_to_number(s: Column) -> Column:
    """The inverse; zero where a character is no letter, or there is none."""
    chars = F.filter(F.split(F.upper(s), ""), lambda c: c != "")
    value = F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(F.rlike(s, F.lit("^[A-Za-z]+$")), value).otherwise(0)


def exhibit_label(style: Column, start: Column, index: Column, prefix: Column) -> Column:
    """Letters or numbers, counted on from start."""
    n = start + index
    return F.concat(prefix, F.when(style == "letters", number_to_letters(n)).otherwise(n.cast("string")))


def expand_template(template: Column, tokens: dict[str, Column]) -> Column:
    """{name} becomes the value of its token, in one pass: what a value holds is not expanded again. Unknown and null tokens stay."""
    parts = F.split(template, "\\{", -1)
    head = F.get(parts, F.lit(0))
    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(part: Column) -> Column:
        out = F.concat(F.lit("{"), part)
        for name, value in tokens.items():
            given = F.concat(value.cast("string"), F.substring(part, F.lit(len(name) + 2), F.length(part)))
            out = F.when(F.startswith(part, F.lit(name + "}")) & value.isNotNull(), given).otherwise(out)
        return out

    return F.concat(head, F.array_join(F.transform(tail, one), ""))


def iso_date(ts: Column) -> Column:
    """The date in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def fmt_bytes(n: Column) -> Column:
    """B below 1024, KB with one decimal below 100, else MB with one decimal."""
    kb, mb = n / 1024, n / 1048576
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.when(kb < 100, fixed(kb, 1)).otherwise(fixed(kb, 0)), F.lit(" KB")))
        .otherwise(F.concat(fixed(mb, 1), F.lit(" MB")))
    )


def plural_pages(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " page").otherwise(" pages"))


def base_name(name: Column) -> Column:
    return F.regexp_replace(F.when(F.coalesce(name, F.lit("")) == "", "document").otherwise(name), "(?i)\\.[a-z0-9]+$", "")


def looks_like_pdf(name: Column, mime: Column | None = None) -> Column:
    typed = F.lit(False) if mime is None else F.coalesce(mime == "application/pdf", F.lit(False))
    return typed | F.coalesce(F.rlike(name, F.lit("(?i)\\.pdf$")), F.lit(False))


def xml_safe(x: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(x, "[^\\t\\n\\r\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "")


def escape_xml(x: Column) -> Column:
    s = xml_safe(x)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(name))
    return s


# The ranges that count as ideographic, and the signs that never have a blank before them.
CJK = "\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF\\u3040-\\u30FF\\uAC00-\\uD7A3\\u3000-\\u303F\\uFF00-\\uFFEF"
CLOSING = "[,.;:!?)\\]}%\u2019\u201D]"


def is_cjk(char: Column) -> Column:
    return F.rlike(char, F.lit(f"^[{CJK}]"))


def is_closing(char: Column) -> Column:
    return F.rlike(char, F.lit("^" + CLOSING))


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def hex_rgb(colour: Column) -> Column:
    """(r, g, b) from 0 to 1; three digits are doubled; null where it is no colour."""
    c = F.regexp_replace(colour, "^#", "")
    c = F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c)
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("double") / 255
    return F.when(F.rlike(c, F.lit("^[0-9A-Fa-f]{6}$")), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def language_list(codes: Column) -> Column:
    """Chosen codes joined by plus signs; eng where none is chosen."""
    return F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.array_join(codes, "+")).otherwise("eng")


# What runtimes say when memory runs out, and what is told apart from it.
ENCRYPTED = "(?i)encrypt|password"
ALLOCATION = "(?i)out of memory|array buffer allocation failed|invalid (typed )?array (buffer )?length|invalid string length|allocation failed|failed to allocate|cannot allocate|OOM"
NO_ALLOCATION = "(?i)Maximum call stack"
#: (kind, pattern), the first that fits.
ERRORS = (
    ("cancelled", "(?i)cancelled"),
    ("allocation", ALLOCATION),
    ("render-timeout", "(?i)timed out"),
    ("encrypted", ENCRYPTED),
    ("damaged", "(?i)failed to parse pdf|invalid pdf|expected instance of pdfdict|damaged"),
    ("detached", "(?i)detached arraybuffer"),
)


def is_encrypted_error(message: Column) -> Column:
    return F.coalesce(F.rlike(message, F.lit(ENCRYPTED)), F.lit(False))


def is_allocation_error(message: Column) -> Column:
    """Out of memory, as an exception's name and message tell it; a recursion that is too deep is something else."""
    has = lambda p: F.rlike(message, F.lit(p))
    told = has(ALLOCATION) | (has("RangeError") & has("(?i)length|size|allocat")) | (has("(?i)getContext") & has("(?i)null|undefined")) | has("(?i)failed to construct 'Blob'")
    return F.coalesce(told & ~has(NO_ALLOCATION), F.lit(False))


def classify_error(message: Column) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(ERRORS):
        fits = is_allocation_error(message) if kind == "allocation" else F.rlike(message, F.lit(pattern))
        out = F.when(fits, kind).otherwise(out)
    return out


ADVICE = {
    "cancelled": "Stopped on request.",
    "allocation": "This machine ran out of memory. Try fewer pages at a time.",
    "render-timeout": "A page took too long to draw.",
    "encrypted": "The file is protected by a password.",
    "damaged": "The file could not be read; it may be damaged.",
    "detached": "The file's bytes were already handed on. Open it again.",
    "unknown": "Something went wrong.",
}


def human_error(message: Column) -> Column:
    kind = classify_error(message)
    return F.create_map(*(F.lit(x) for k, v in ADVICE.items() for x in (k, v)))[kind]
