"""Merging: files in order, pages in order, one manifest and a receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable_files(files: DataFrame) -> DataFrame:
    """Files that can be merged: neither bad nor still loading."""
    return files.where(~F.coalesce("bad", F.lit(False)) & ~F.coalesce("loading", F.lit(False)))


def can_merge(files: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more usable files."""
    return usable_files(files).groupBy(*keys).agg(F.count("*").alias("inputs")).where("inputs >= 2")


def merge_totals(files: DataFrame, keys: list[str]) -> DataFrame:
    return usable_files(files).groupBy(*keys).agg(F.count("*").alias("inputs"), F.sum("size").alias("bytes"), F.sum("pages").alias("pages"))


def part_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most value, by halving."""
    low, high = 0, len(bounds)

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(bounds[mid]), half(low, mid)).otherwise(half(mid + 1, high))

    return half(low, high)


def before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: tuple[str, ...] = (), parts: int = 256) -> DataFrame:
    """df with the sum of value over the rows that come before in order, and then in order of ties, within each key.

    A key may hold any share of all rows: its order, a number, is cut at
    quantiles first, so that parts have about equally many rows however far some
    lie off. Parts are summed, with partial sums before the shuffle, and their few
    sums run on; the rows run on within a part alone. Rows of one key with one
    order are in one part. Nulls come first.
    """
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    part = F.when(F.col(order).isNull(), -1).otherwise(part_of(F.col(order), sorted(set(cuts))))
    cut = df.withColumn("__value", value.cast("long")).withColumn("__part", part)
    sums = cut.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum"))
    earlier = F.sum("__sum").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = cut.join(sums, [*same, F.col("__part") == F.col("__p")])
    inside = F.sum("__value").over(W.partitionBy(*keys, "__part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1))
    return met.withColumn(name, (F.col("__earlier") + F.coalesce(inside, F.lit(0))).cast("long")).drop("__value", "__part", "__p", "__earlier", *(f"__{k}" for k in keys))


def ties_of(files: DataFrame) -> tuple[str, ...]:
    """Columns that order files of one place."""
    return tuple(c for c in ("name", "size", "pages") if c in files.columns)


def manifest(files: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each page of the merged file: where it comes from and its number from 1.

    Numbers come from running sums over files, not over pages.
    """
    usable = usable_files(files).where("pages > 0")
    placed = before(usable, keys, "ord", F.col("pages"), "__before", ties_of(usable))
    pages = placed.select(*keys, "ord", "name", "__before", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("source_page"))
    return pages.select(*keys, "ord", "name", "source_page", (F.col("__before") + F.col("source_page")).cast("long").alias("page"))


#: Lines of a manifest that are hashed together.
RECEIPT_LINES = 1000


def receipts(manifests: DataFrame, keys: list[str], line: Column, lines: int = RECEIPT_LINES) -> DataFrame:
    """For each merged file: inputs, pages, bytes of its lines, and the SHA-256 of the digests of so many lines each, in order of page.

    So no more than a thousand lines, or the digests of a file's thousands, meet in one row.
    """
    joined = lambda order, text, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), by)
    part = F.floor((F.col("page") - 1) / lines).alias("__part")
    parts = manifests.groupBy(*keys, part).agg(joined("page", line, "\n").alias("__text"), F.count("*").alias("__n"), F.count(F.when(F.col("source_page") == 1, 1)).alias("__inputs"))
    hashed = parts.select(*keys, "__part", "__n", "__inputs", (F.octet_length("__text") + 1).cast("long").alias("__bytes"), F.sha2("__text", 256).alias("__digest"))
    got = hashed.groupBy(*keys).agg(F.sum("__inputs").alias("inputs"), F.sum("__n").alias("pages"), (F.sum("__bytes") - 1).alias("bytes"), joined("__part", F.col("__digest"), "\n").alias("__digests"))
    return got.select(*keys, "inputs", "pages", "bytes", F.sha2("__digests", 256).alias("sha256"))


def moved(files: DataFrame, keys: list[str], move: Column, by: Column) -> DataFrame:
    """New order after moving each file for which move holds by so many places; ties keep their order."""
    at = (F.col("__n") + 1).cast("double")
    target = F.when(move, at + by + F.when(by > 0, 0.5).otherwise(-0.5)).otherwise(at)
    ranked = before(files, keys, "ord", F.lit(1), "__n", ties_of(files)).withColumn("__at", at).withColumn("__to", target).drop("__n")
    return before(ranked, keys, "__to", F.lit(1), "__n", ("__at",)).withColumn("ord", (F.col("__n") + 1).cast("int")).drop("__at", "__to", "__n")


def preview(rows: DataFrame, keys: list[str], order: str, show: int) -> DataFrame:
    """The first few rows of each key, and how many more there are. A preview's limit is what it is for."""
    every = W.partitionBy(*keys)
    ranked = rows.withColumn("__n", F.row_number().over(every.orderBy(order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(every) - show))
    return ranked.where(F.col("__n") <= show).drop("__n")
