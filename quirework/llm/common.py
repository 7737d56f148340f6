"""Shared plumbing: table access, staged tables, Arrow-batched maps, n-gram hashing."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Python works on this many rows, and about this many bytes, of an Arrow batch at a time.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

#: ASCII white space, as the word rules of the contracts have it.
SPACE = " \t-\r"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets a new folder; any other is refused."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the application ends."""
    home = f"{shared_dir(spark)}/quirework-{spark.sparkContext.applicationId}"
    if home not in homes:
        fs, at = file_system(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


homes: set[str] = set()


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def shared(spark: SparkSession, value):
    """A broadcast of value; give what its .value holds to load(). It travels by value, so workers needn't import this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def load(broadcast):
    return pickle.loads(broadcast.value)


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: int = 1000, least: int = 10_000) -> DataFrame:
    """left joined with right, in which each key occurs once, with the number of its rows in left as count.

    Of total rows, a key with more than one in share is hot, and there are fewer
    than share such keys: they are broadcast, so that the rows of one key stay
    where they are. The others are joined by shuffle. Under least rows no key counts as hot.
    """
    limit = max(total // share, least)
    if total <= limit:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col(count) > limit))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) <= limit), key)
    return left.join(hot, key).unionByName(rest)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bounded(counted: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """A broadcast of some rows of counted, whose __n together are at most max_rows: those with small __n first, and then by hash of id."""
    some = counted.orderBy("__n", F.xxhash64(id_col), id_col).limit(max_rows)
    upto = F.sum("__n").over(W.orderBy("__n", F.xxhash64(id_col), id_col).rowsBetween(W.unboundedPreceding, 0))
    return F.broadcast(some.withColumn("__upto", upto).where(F.col("__upto") <= max_rows).drop("__upto", "__n"))


def fields(df: DataFrame, columns: list[str], more: str = "") -> StructType:
    """A schema of columns of df, of any type and name, and then more, as DDL."""
    rest = _parse_datatype_string(more) if more else StructType()
    return StructType([StructField(c, df.schema[c].dataType) for c in columns] + list(rest))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most so many rows, and of about so many bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[[dict], dict]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Rows by way of Arrow batches of bounded size.

    start() runs once in each task; the function that it returns takes a batch
    as a dict of lists and returns the columns of schema as a dict of lists.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slices(batches, rows):
            out = work(dict(zip(columns, (c.to_pylist() for c in batch.columns))))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, kind)


def filter_rows(df: DataFrame, text_col: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of df for which the function that start() returns says true of the text. All columns, of any name and type, stay as they are."""
    numbers = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*numbers)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slices(batches):
            yield batch.filter(pa.array(work(batch.column(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


def ngram_hashes(text: str, orders: tuple[int, ...]) -> np.ndarray:
    """32-bit hashes of the character n-grams of a whole text, one for each place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, h = [np.empty(0, np.uint32)], points * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(points) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in orders:
            parts.append((h ^ (h >> np.uint32(16))) * np.uint32(0x9E3779B1))
    return np.concatenate(parts)
