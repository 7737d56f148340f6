"""A training corpus from documents, stage by stage. Each stage works on all that the one before kept.

Results for odd input: documents with a null or empty text, or fewer than 50
words, fail the quality rules and go; a null id is kept as one; repeated rows
meet in one group of near-duplicates, of which one stays; very long texts are
judged, searched and packed whole; extra columns, of any type and with names that
clash, come through all stages but the last, which gives its own; an empty table
gives an empty result with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import compression_bands, packing_gga, secret_links, simhash_bktree, wu_manber
from quirework.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands keep."""
    return compression_bands.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_bktree.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of benchmark items."""
    return wu_manber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secret_links.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing_gga.sequences(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Compression, fingerprint trees and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
