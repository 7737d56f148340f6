"""Quality rules: zstandard ratios over whole documents and fixed chunks.

A document is held against word rules first (too few words; too many words
within repeated three-word windows), then against bands of the ratio of
compressed to raw size. Each band holds for a range of lengths, for short
texts carry the frame's overhead and long ones find more to refer back to.

Results for odd input: a null text is an empty one, with no words, and so
fails the word rules. A text shorter than the first band's start is not judged
by ratio. Repeated rows are judged each for itself. Lone surrogates can't
occur in Spark strings. Columns of the input other than those asked for are
not touched.
"""

from __future__ import annotations

import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import WORD, fields, filter_rows, map_rows, table

#: From this many UTF-8 bytes on, up to the next entry: least and greatest ratio of compressed to raw size.
BANDS = ((0, 0.0, 9.0), (128, 0.35, 1.0), (256, 0.32, 0.86), (512, 0.30, 0.80), (1024, 0.27, 0.72), (4096, 0.25, 0.66), (16384, 0.20, 0.64))
CHUNK, LEVEL = 4096, 3
#: The share of a document's chunks that may lie outside their band.
BAD_CHUNKS = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double, reason string"


def within(size: int, ratio: float, bands: tuple = BANDS) -> str | None:
    """None, or which side of its band a ratio lies on."""
    low, high = next((lo, hi) for at, lo, hi in reversed(bands) if size >= at)
    return "repetitive" if ratio < low else "incompressible" if ratio > high else None


def word_counts(text: str, find) -> tuple[int, int, int, int, int]:
    words = find(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated, end = 0, 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        full = [x for x in lines if find(x)]
        dup = len(full) - len(set(full))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated


def ratios(raw: bytes, compressor, chunk: int = CHUNK, bands: tuple = BANDS) -> tuple[float, float, str | None]:
    """Ratio of the whole, share of chunks out of band, and the reason to reject, if any."""
    if not raw:
        return 0.0, 0.0, None
    whole = len(compressor.compress(raw)) / len(raw)
    if why := within(len(raw), whole, bands):
        return whole, 0.0, f"whole text {why}"
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    odd = [x for p in parts if (x := within(len(p), len(compressor.compress(p)) / len(p), bands))]
    share = len(odd) / len(parts) if parts else 0.0
    return whole, share, f"chunks {Counter(odd).most_common(1)[0][0]}" if share > BAD_CHUNKS else None


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """One row for each row of df: its id, the counts, and whether it is kept."""

    def start():
        find, compressor = re.compile(WORD).findall, zstandard.ZstdCompressor(level=level)

        def one(text: str | None) -> tuple:
            text = text or ""
            counts = word_counts(text, find)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]
            whole, share, why = ratios(text.encode(), compressor, chunk, bands)
            return *counts, failed, not (failed or why), whole, share, "too few words" if counts[0] < MIN_WORDS else "repeated windows" if failed else why

        def batch(rows: dict) -> dict:
            got = list(zip(*map(one, rows["__text"])))
            return {id_col: rows[id_col]} | dict(zip(names, got))

        return batch

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    picked = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    return map_rows(picked, [id_col, "__text"], start, fields(picked, [id_col], SCHEMA))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that judge() keeps, with their columns of any names and types, in one pass and without a shuffle."""

    def start():
        find, compressor = re.compile(WORD).findall, zstandard.ZstdCompressor(level=LEVEL)

        def one(text: str | None) -> bool:
            counts = word_counts(text or "", find)
            return not (counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0] or ratios((text or "").encode(), compressor)[2])

        return lambda texts: list(map(one, texts))

    return filter_rows(df, text_col, start)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
