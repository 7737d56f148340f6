"""CSV files as sinks that appear whole or not at all.

Cells are expressions (functions.text); the sink takes finished lines and writes
bytes. Each task writes one part into a staging folder of the job and tells the
driver its name, rows, bytes and digest. The commit throws away what no
message names (attempts that were lost or came second), moves the folder into
place, and then replaces one small file, the manifest, in one step: a reader that
goes by the manifest sees the old parts or the new ones. An aborted job leaves
the old ones and nothing of its own.

Parts in the order of the manifest, one after another, are the file; they follow
the order of the partitions, so rows sorted by orderBy() come sorted. In the
dialect `report` each line ends in CRLF, the last one too; in `plain` lines are
parted by LF and the last has none.

The folder is one of a file system that all executors mount. Results for odd
input: an empty table gives a manifest of its header alone, or of no part; a null
cell is empty; cells with line breaks are quoted; rows without cells are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from quirework.functions import text as T

FORMAT, MANIFEST = "line_parts", "_manifest.json"
ENDS = {"report": b"\r\n", "plain": b"\n"}


def local(path: str) -> str:
    """The path of a mounted folder; schemes of object stores are refused."""
    at = urlsplit(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"a folder of a mounted file system is needed, not {at.scheme}")
    return at.path


@dataclass
class Part(WriterCommitMessage):
    """What a task has written."""

    partition: int
    name: str
    rows: int
    size: int
    sha256: str
    sha256_ended: str  # with one more end after it


class LineWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, dialect: str, header: str | None, overwrite: bool):
        self.folder, self.end, self.last, self.header, self.overwrite = folder, ENDS[dialect], dialect == "report", header, overwrite
        self.job = uuid.uuid4().hex
        self.staging = os.path.join(folder, f"_staging-{self.job}")

    def store(self, partition: int, blocks: Iterator[list]) -> Part:
        """Lines with an end between them; the end of the last is the commit's to add."""
        name = f"part-{max(partition, 0):06d}-{uuid.uuid4().hex}.csv" if partition >= 0 else f"header-{uuid.uuid4().hex}.csv"
        os.makedirs(self.staging, exist_ok=True)
        rows, size, digest = 0, 0, hashlib.sha256()
        with open(os.path.join(self.staging, name), "xb") as out:
            for lines in blocks:
                if lines:
                    data = (self.end if rows else b"") + self.end.join(x.encode("utf-8", "surrogatepass") for x in lines)
                    out.write(data)
                    digest.update(data)
                    rows, size = rows + len(lines), size + len(data)
            if rows and self.last:
                out.write(self.end)
                digest.update(self.end)
                size += len(self.end)
            out.flush()
            os.fsync(out.fileno())
        ended = digest.copy()
        ended.update(self.end)
        return Part(partition, name, rows, size, digest.hexdigest(), ended.hexdigest())

    def write(self, iterator) -> Part:
        return self.store(TaskContext.get().partitionId(), (batch.column(0).to_pylist() for batch in iterator))

    def commit(self, messages: list) -> None:
        """Runs once, on the driver, when every task has told its part."""
        manifest = os.path.join(self.folder, MANIFEST)
        if os.path.exists(manifest) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder} holds a file already")
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        if self.header is not None:
            parts.insert(0, self.store(-1, iter([[self.header]])))
        os.makedirs(self.staging, exist_ok=True)
        named = {p.name for p in parts}
        for name in os.listdir(self.staging):
            if name not in named:
                os.remove(os.path.join(self.staging, name))
        if not self.last:  # an end between parts; one byte to each part but the last
            for p in parts[:-1]:
                with open(os.path.join(self.staging, p.name), "ab") as out:
                    out.write(self.end)
                p.size, p.sha256 = p.size + len(self.end), p.sha256_ended
        folder = f"data-{self.job}"
        os.rename(self.staging, os.path.join(self.folder, folder))
        told = {"rows": sum(p.rows for p in parts), "bytes": sum(p.size for p in parts), "parts": [{"path": f"{folder}/{p.name}", "rows": p.rows, "bytes": p.size, "sha256": p.sha256} for p in parts]}
        with open(f"{manifest}-{self.job}", "w") as out:
            json.dump(told, out)
        os.replace(f"{manifest}-{self.job}", manifest)
        for old in os.listdir(self.folder):
            if old.startswith("data-") and old != folder:
                shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class LineParts(DataSource):
    """Writes the one column of a table, finished lines."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, StringType):
            raise ValueError("one column of finished lines is needed")
        return LineWriter(local(self.options["path"]), self.options.get("dialect", "report"), self.options.get("header"), overwrite)


def csv_lines(df: DataFrame, dialect: str = "report") -> Column:
    """The line of a row, from all its columns in order."""
    if not df.columns:
        raise ValueError("rows without cells")
    return T.csv_row([F.col(f"`{c}`") for c in df.columns], plain=dialect == "plain")


def header_line(names: list[str], dialect: str) -> str:
    """The line of the column names, by the same rules as any row's."""
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(T.csv_row([F.lit(n) for n in names], plain=dialect == "plain")).first()[0]


def write_csv(df: DataFrame, path: str, dialect: str = "report", header: bool = True, overwrite: bool = False) -> None:
    """df as one file in parts, all of it or nothing. A folder that holds one already is refused unless overwritten."""
    df.sparkSession.dataSource.register(LineParts)
    out = df.select(csv_lines(df, dialect).alias("line")).write.format(FORMAT).option("dialect", dialect).mode("overwrite" if overwrite else "append")
    (out.option("header", header_line(df.columns, dialect)) if header else out).save(path)


def manifest_of(path: str) -> dict:
    with open(os.path.join(local(path), MANIFEST)) as f:
        return json.load(f)


def file_bytes(path: str) -> Iterator[bytes]:
    """The bytes of the file that a manifest tells, block by block."""
    for part in manifest_of(path)["parts"]:
        with open(os.path.join(local(path), part["path"]), "rb") as f:
            while block := f.read(1 << 20):
                yield block


def read_csv(spark: SparkSession, path: str, schema: str, dialect: str = "report") -> DataFrame:
    """The rows of a file written in a dialect, without its header; empty cells are null.

    The end of lines is given, for a reader that looks for it takes the first
    break of a part, which may stand in a cell.
    """
    parts = [os.path.join(local(path), p["path"]) for p in manifest_of(path)["parts"] if not os.path.basename(p["path"]).startswith("header-")]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(multiLine=True, lineSep=ENDS[dialect].decode(), header=False, quote='"', escape='"', charToEscapeQuoteEscaping='"', mode="FAILFAST").csv(parts)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Unset, a local master gets a temporary one; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(local(base), uuid.uuid4().hex)
