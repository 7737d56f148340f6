"""Recognised words: reading-order text, telemetry and placement on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions.geometry import norm_angle, visible_frame, visible_to_user
from quirework.functions.text import is_blank, is_cjk, is_closing, js_trim, sanitize_winansi, utf16_length
from quirework.operators.raster import unmap

LINE = ["page_id", "block", "par", "line"]
#: Part of the line's median glyph width from which on words of different scripts are parted.
TRANSITION_GAP = 0.10


def real_words(words: DataFrame) -> DataFrame:
    """Words with text and a box."""
    return words.where(~is_blank(F.col("text")) & F.col("x0").isNotNull() & F.col("x1").isNotNull())


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted values: of an even number, the upper one."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def index_percentile(values: Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values, the last at most."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * share).cast("int")))


def glyph_width() -> Column:
    """A word's width by UTF-16 unit; null where it has no box or no width."""
    width = ((F.col("x1") - F.col("x0")) / utf16_length(F.col("text"))).cast("double")
    return F.when((F.col("text") != "") & (width > 0), width)


def median_glyph_width(words: DataFrame, keys: list[str]) -> DataFrame:
    """The upper median of the glyph widths of a key, where there is one.

    By rank, not by a list: a key may hold any number of words.
    """
    each = W.partitionBy(*keys)
    ranked = words.select(*keys, glyph_width().alias("glyph")).where("glyph IS NOT NULL").withColumn("__r", F.row_number().over(each.orderBy("glyph"))).withColumn("__n", F.count("*").over(each))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*keys, "glyph")


def separator(before: Column, after: Column, gap: Column, glyph: Column) -> Column:
    """What stands between two words of a line.

    Closing punctuation never has a blank before it. Words of one kind of script
    have one unless both are ideographic; at a change of script the gap decides,
    and there is a blank where it is not known.
    """
    last, first = is_cjk(F.substring(before, -1, 1)), is_cjk(F.substring(after, 1, 1))
    apart = F.coalesce(gap >= TRANSITION_GAP * glyph, F.lit(True))
    return F.when(is_closing(after), "").when(last & first, "").when(last == first, " ").otherwise(F.when(apart, " ").otherwise(""))


def line_texts(words: DataFrame) -> DataFrame:
    """The text of each line, words in order; words without text are left out.

    A line is a group that its page bounds: its words are put in order in one
    array, by one shuffle, which the whole page's text goes on with.
    """
    word = F.struct("word", "text", "x0", "x1", glyph_width().alias("glyph"))
    lines = words.where("text <> ''").groupBy(*LINE).agg(F.array_sort(F.collect_list(word)).alias("w"))
    glyph = upper_median(F.filter(F.transform("w", lambda x: x["glyph"]), lambda g: g.isNotNull()))

    def piece(x: Column, i: Column) -> Column:
        p = F.get(F.col("w"), i - 1)
        return F.concat(F.when(i == 0, "").otherwise(separator(p["text"], x["text"], x["x0"] - p["x1"], F.col("glyph"))), x["text"])

    return lines.withColumn("glyph", glyph).select(*LINE, F.array_join(F.transform("w", piece), "").alias("text"))


def page_texts(words: DataFrame) -> DataFrame:
    """The text of each page: a line break after a line, a blank line between paragraphs and blocks."""
    listed = lambda order, text: F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    dealt = words.repartition("page_id")  # words, paragraphs and blocks of a page then meet without another shuffle
    paragraphs = line_texts(dealt).groupBy("page_id", "block", "par").agg(F.array_join(listed("line", "text"), "\n").alias("text"))
    blocks = paragraphs.groupBy("page_id", "block").agg(F.array_join(listed("par", "text"), "\n\n").alias("text"))
    whole = F.regexp_replace(F.array_join(listed("block", "text"), "\n\n"), "\\n{3,}", "\n\n")
    return blocks.groupBy("page_id").agg(F.regexp_replace(whole, "^\\n+|\\n+$", "").alias("text"))


def document_text(pages: DataFrame, key: str, mark: str = "\n\n----- page break -----\n\n") -> DataFrame:
    """The pages of each document in order, parted by a mark."""
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), mark).alias("text"))


def hocr_page(html: Column, page: Column) -> Column:
    """One page's body with its ids renumbered to the page."""
    body = F.regexp_extract(html, "(?s)<body[^>]*>(.*)</body>", 1)
    body = F.when(body == "", html).otherwise(body)
    n = page.cast("string")
    parts = F.split(body, "page_1\\b", -1)
    body = F.call_function("array_join", parts, F.concat(F.lit("page_"), n))
    parts = F.split(body, "(?<=\\b(?:word|line|par|block)_)1(?=_)", -1)
    body = F.call_function("array_join", parts, n)
    return F.call_function("array_join", F.split(body, "ppageno [0-9]+", -1), F.concat(F.lit("ppageno "), (page - 1).cast("string")))


def hocr_document(pages: DataFrame, key: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", hocr_page(F.col("html"), F.col("page")).alias("h")))), lambda x: x["h"]), "\n")
    return pages.groupBy(key).agg(F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), body, F.lit("\n</body></html>\n")).alias("html"))


def mean_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the numbers among the confidences; null where there are none."""
    number = F.when(~F.isnan("confidence"), F.col("confidence"))
    return words.groupBy(*keys).agg(F.avg(number).alias("confidence"))


def layer_size(top: Column, bottom: Column, scale: Column) -> Column:
    """The size of a word's letters from its box; 4 at least."""
    return F.greatest(F.lit(4.0), F.abs(bottom - top) / scale * 0.85)


def placeable(words: DataFrame) -> DataFrame:
    return words.where(~is_blank(F.col("text")) & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull())


def text_layer(words: DataFrame, box: Column, rotate: Column, scale: Column, skew: Column, w: Column, h: Column) -> DataFrame:
    """Where each word of the invisible layer goes on its own page: shown, x, y, size and turn.

    Boxes are in a prepared raster of w by h that may have been set straight by
    skew, drawn with the page as it is seen, at scale. The lower left corner
    goes back through both to page space; the text lies turned as the page is.
    """
    top, low = unmap(F.col("x0"), F.col("y0"), skew, w, h), unmap(F.col("x0"), F.col("y1"), skew, w, h)
    at = visible_to_user(low["x"] / scale, visible_frame(box["w"], box["h"], rotate)["h"] - low["y"] / scale, box, rotate)
    placed = placeable(words).withColumn("__at", at)
    return placed.select("*", sanitize_winansi(F.col("text")).alias("shown"), F.col("__at")["x"].alias("x"), F.col("__at")["y"].alias("y"), layer_size(top["y"], low["y"], scale).alias("size"), norm_angle(rotate).alias("turn")).drop("__at")


def fallback_layer(words: DataFrame, page_h: Column, scale: Column, skew: Column, w: Column, h: Column) -> DataFrame:
    """Where each word goes on a page that was drawn anew from its raster, page_h high: shown, x, y and size; never turned."""
    top, low = unmap(F.col("x0"), F.col("y0"), skew, w, h), unmap(F.col("x0"), F.col("y1"), skew, w, h)
    y = page_h - F.least(top["y"], low["y"]) / scale - F.abs(low["y"] - top["y"]) / scale
    return placeable(words).select("*", sanitize_winansi(F.col("text")).alias("shown"), (top["x"] / scale).alias("x"), y.alias("y"), layer_size(top["y"], low["y"], scale).alias("size"))
