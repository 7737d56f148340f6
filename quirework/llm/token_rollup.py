"""Token counts as rollups that are maintained by deltas.

A batch holds signed changes: an insert adds a document and its tokens to the
totals of its source, language and tokenizer version, a delete takes them away,
and a revised count does both. Totals are additive, so a batch is summed by key
first (partially before the shuffle, so that a large source is no burden), and
only sums are kept.

Commits are idempotent: a batch's sums are written to a folder of their own, and
count from when a marker under the batch's id names that folder. The marker is
written aside and renamed, which fails where there is one: of two deliveries at
once the first to rename counts, on any file system whose rename fails on an
existing name. (A local one looks first, so there only one process may commit.)
A batch that comes again is left out; one that broke off left no marker.

compact() sums all that is committed into one folder, and publishes it by one
marker more, which lists the batches it covers. Whoever reads takes the newest of
these and the batches that it doesn't cover, so a compaction that broke off, or
that another overtook, changes nothing; ids stay known for ever.

Results for odd input: null sources, languages and versions are keys like any
other; a null text has no tokens; a null count adds none, but its document
counts; an empty batch is committed; totals of zero documents and tokens are
left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import drop_path, fields, file_system, fresh_path, map_rows, staged, table
from quirework.llm.tokens import ENCODE_ROWS, VOCABULARY, encoder

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
WORD_RULE = r"[^\x20\x09-\x0D]+"
#: The rule counts words between white space; its successor counts the ids of a public tokenizer.
WORDS_V1, IDS_V2 = "words-1", VOCABULARY.removesuffix(".json") + "-2"


def token_counts(df: DataFrame, columns: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """columns of df with n_tokens, the number of ids of the whole text."""

    def start():
        encode = encoder(path)
        return lambda rows: {c: rows[c] for c in columns} | {"n_tokens": [len(x) // 4 for x in encode(rows["__text"])]}

    picked = df.select(*(F.col(f"`{c}`").alias(c) for c in columns), F.col(f"`{text_col}`").alias("__text"))
    return map_rows(picked, [*columns, "__text"], start, fields(picked, columns, "n_tokens long"), ENCODE_ROWS)


def change(df: DataFrame, sign: int, version: str, count: Column) -> DataFrame:
    """Signed changes from rows with source and lang: 1 to insert, -1 to delete."""
    return df.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(count.cast("long"), F.lit(0))).alias("n_tokens"))


def summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """A maintained rollup in a folder that driver and executors share. Ids may hold any characters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def marker(self, batch_id: str) -> str:
        return f"{self.path}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def exists(self, path: str) -> bool:
        fs, at = file_system(self.spark, path)
        return fs.exists(at)

    def publish(self, path: str, said: dict) -> bool:
        """A small file, whole or not at all; false if it is there already."""
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/_{uuid.uuid4().hex}"
        fs, at = file_system(self.spark, aside)
        fs.mkdirs(at.getParent())
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if not self.exists(path) and fs.rename(at, file_system(self.spark, path)[1]):
            return True
        fs.delete(at, False)
        return False

    def said(self, folder: str) -> list[tuple[str, dict]]:
        """Name and content of the files that were published in a folder."""
        if not self.exists(f"{self.path}/{folder}"):
            return []
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/{folder}").select(F.col("_metadata.file_name").alias("name"), "value")
        return sorted((r["name"], json.loads(r["value"])) for r in rows.collect())

    def store(self, changes: DataFrame) -> str:
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        summed(changes).write.parquet(data)
        return data

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch, unless one with its id has been added. Fit for foreachBatch."""
        if self.exists(self.marker(batch_id)):
            return False
        data = self.store(changes)
        if self.publish(self.marker(batch_id), {"id": batch_id, "data": data}):
            return True
        drop_path(self.spark, data)
        return False

    def state(self) -> tuple[int, list[str], list[str]]:
        """The number of compactions, the folders that make up the totals, and the markers they stand for."""
        commits, sums = dict(self.said("commits")), self.said("sums")
        last = sums[-1][1] if sums else {"data": None, "covers": []}
        open_ = [x["data"] for name, x in commits.items() if name not in set(last["covers"])]
        return len(sums), [last["data"]] * bool(sums) + open_, sorted({*commits, *last["covers"]})

    def totals(self) -> DataFrame:
        return self.total(self.state()[1])

    def total(self, folders: list[str]) -> DataFrame:
        every = self.spark.read.schema(TOTALS).parquet(*folders) if folders else self.spark.createDataFrame([], TOTALS)
        return summed(every).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Brings all that is committed into one folder; false if another compaction was quicker. The folders it replaces stay for their readers."""
        n, folders, covers = self.state()
        data = self.store(self.total(folders))
        if self.publish(f"{self.path}/sums/{n:012d}", {"data": data, "covers": covers}):
            return True
        drop_path(self.spark, data)
        return False


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents under the first rule's counts, revises all to the second's, delivers both again, and deletes what has no text."""
    documents = table(spark, sf_dir, "documents").withColumn("words", F.size(F.regexp_extract_all("text", F.lit(WORD_RULE), F.lit(0)))).withColumn("blank", F.coalesce(F.col("text"), F.lit("")) == "")
    counted = staged(token_counts(documents, ["source", "lang", "words", "blank"]), "counts")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    words, ids = F.greatest("words", F.lit(0)), F.col("n_tokens")
    batches = {
        "insert": change(counted, 1, WORDS_V1, words),
        "revise": change(counted, -1, WORDS_V1, words).union(change(counted, 1, IDS_V2, ids)),
        "delete": change(counted.where("blank"), -1, IDS_V2, ids),
    }
    for batch_id in (*batches, *batches):
        rollup.commit(batch_id, batches[batch_id])
    return rollup.totals()
