"""CSV sinks: bytes of both dialects, commits, overwriting, and jobs that fail."""

import csv
import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quirework.sources import sinks

ROWS = [(1, "=1+1", None), (2, 'a "b", c', "x\ny"), (3, "", "\tz"), (4, "é😀", "-5"), (5, "plain", "r\rs")]


def table(spark, parts=3):
    return spark.createDataFrame(ROWS, "id int, a string, b string").repartitionByRange(parts, "id").sortWithinPartitions("id")


def whole(path):
    return b"".join(sinks.file_bytes(path))


def spelled(v, plain):
    s = "" if v is None else str(v)
    if not plain and s[:1] in tuple("=+-@\t\r") and s:
        s = "'" + s
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ('",\n' if plain else '",\n\r')) else s


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("dialect", ["report", "plain"])
@pytest.mark.parametrize("parts", [1, 3, 9])
def test_bytes(spark, tmp_path, dialect, header, parts):
    path, plain = str(tmp_path / "out"), dialect == "plain"
    sinks.write_csv(table(spark, parts), path, dialect, header)
    lines = [",".join(spelled(v, plain) for v in r) for r in ([("id", "a", "b")] if header else []) + ROWS]
    want = "\n".join(lines) if plain else "".join(x + "\r\n" for x in lines)
    assert whole(path) == want.encode()
    told = sinks.manifest_of(path)
    assert told["bytes"] == len(want.encode()) and told["rows"] == len(lines)
    assert all(hashlib.sha256(open(os.path.join(path, p["path"]), "rb").read()).hexdigest() == p["sha256"] for p in told["parts"])
    assert sorted(os.listdir(path)) == sorted([sinks.MANIFEST, told["parts"][0]["path"].split("/")[0]])
    if not plain:
        assert len(list(csv.reader(io.StringIO(whole(path).decode(), newline="")))) == len(lines)


def test_empty_and_odd_names(spark, tmp_path):
    none = table(spark).where("id > 9")
    sinks.write_csv(none, str(tmp_path / "a"))
    assert whole(str(tmp_path / "a")) == b"id,a,b\r\n"
    sinks.write_csv(none, str(tmp_path / "b"), header=False)
    assert sinks.manifest_of(str(tmp_path / "b")) == {"rows": 0, "bytes": 0, "parts": []}
    sinks.write_csv(spark.range(1).select(F.lit("v").alias("=a.b,c")), str(tmp_path / "c"))
    assert whole(str(tmp_path / "c")) == b"\"'=a.b,c\"\r\nv\r\n"
    with pytest.raises(ValueError):
        sinks.local("s3://bucket/x")


def test_refused_or_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(table(spark), path)
    first = whole(path)
    with pytest.raises(Exception, match="holds a file already"):
        sinks.write_csv(table(spark).where("id < 3"), path)
    assert whole(path) == first and len(os.listdir(path)) == 2
    sinks.write_csv(table(spark).where("id < 3"), path, overwrite=True)
    assert whole(path) == first[: len(whole(path))] != first and len(os.listdir(path)) == 2


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = table(spark).withColumn("a", F.when(F.col("id") == 5, F.raise_error(F.lit("broken row"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_csv(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    sinks.write_csv(table(spark), path)
    before = whole(path)
    with pytest.raises(Exception, match="broken row"):
        sinks.write_csv(bad, path, overwrite=True)
    assert whole(path) == before and len(os.listdir(path)) == 2


def test_attempts_that_no_message_names(tmp_path):
    writer = sinks.LineWriter(str(tmp_path), "plain", None, False)
    writer.store(1, iter([["lost"]]))
    parts = [writer.store(1, iter([["c"], [], ["d", "e"]])), None, writer.store(0, iter([["a", "b"]])), writer.store(2, iter([]))]
    writer.commit(parts)
    assert whole(str(tmp_path)) == b"a\nb\nc\nd\ne"
    told = json.load(open(tmp_path / sinks.MANIFEST))
    assert [p["rows"] for p in told["parts"]] == [2, 3] and len(os.listdir(tmp_path / told["parts"][0]["path"].split("/")[0])) == 2


@pytest.mark.parametrize("dialect", ["report", "plain"])
def test_read_back_whatever_a_part_begins_with(spark, tmp_path, dialect):
    """Each part begins with a cell that has a line break of another kind than the rows."""
    cells = ["x,\n", "plain", "a\r\n,b", "end\r", ",\r", "last", "\r", "z", '"\0', "\0,", "\nq\n"]
    rows = spark.createDataFrame(list(enumerate(cells)), "id long, cell string").repartitionByRange(5, "id").sortWithinPartitions("id")
    sinks.write_csv(rows, str(tmp_path / "out"), dialect)
    got = {r[0]: r[1] for r in sinks.read_csv(spark, str(tmp_path / "out"), "id long, cell string", dialect).collect()}
    assert got == {i: "'" + c if dialect == "report" and c[0] == "\r" else c for i, c in enumerate(cells)}
