"""Page ranges: from text to an ordered list of pages, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions.text import js_trim

PART = "^([0-9]+)(?:\\s*-\\s*([0-9]+))?$"


def parse_ranges(spec: Column, total: Column) -> Column:
    """(pages, error). Pages count from 0, in the order given: repeats stay, and 3-1 counts down.

    Empty parts between commas are passed over. The first part that is
    no page or range within the total is an error, as is a text without parts.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), js_trim), lambda p: p != "")
    first = lambda p: F.regexp_extract(p, PART, 1)
    last = lambda p: F.when(F.regexp_extract(p, PART, 2) != "", F.regexp_extract(p, PART, 2)).otherwise(first(p))
    number = lambda s: s.try_cast("bigint")
    low, high = (lambda p: F.least(number(first(p)), number(last(p)))), (lambda p: F.greatest(number(first(p)), number(last(p))))
    wrong = lambda p: F.when(~F.rlike(p, F.lit(PART)), "not a page or range").when(low(p) < 1, "pages start at 1").when(high(p).isNull() | low(p).isNull() | (high(p) > total), "page out of range")
    error = F.when(F.size(parts) == 0, "no pages given").otherwise(F.get(F.array_compact(F.transform(parts, wrong)), F.lit(0)))
    pages = F.flatten(F.transform(parts, lambda p: F.sequence(number(first(p)) - 1, number(last(p)) - 1)))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def select_pages(df: DataFrame, spec: str, total: str) -> DataFrame:
    """A row for each selected page: df with pos (from 0) and page (from 0). Rows with an error give none."""
    return df.select("*", F.posexplode(parse_ranges(F.col(spec), F.col(total))["pages"]).alias("pos", "page"))


def compact_ranges(df: DataFrame, keys: list[str], page: str, out: str = "ranges") -> DataFrame:
    """For each key, its pages (from 0) in order as text, runs joined: 1-3, 5.

    A page that occurs twice breaks the run: 0, 0, 1 gives 1, 1-2.
    """
    order = W.partitionBy(*keys).orderBy(page)
    begins = F.coalesce(F.col(page) - F.lag(page).over(order) != 1, F.lit(True))
    runs = df.withColumn("__run", F.sum(begins.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = runs.groupBy(*keys, "__run").agg(F.min(page).alias("__a"), F.max(page).alias("__b"))
    text = F.when(F.col("__a") == F.col("__b"), (F.col("__a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("__a") + 1, F.col("__b") + 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__run", text.alias("t")))), lambda x: x["t"])
    return ends.groupBy(*keys).agg(F.array_join(listed, ", ").alias(out))
