"""Streams over events in files: several micro-batches, out of order, restarted from the checkpoint, against the batch forms."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from quirework.streaming import handoff, stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"
ROWS = "key long, id long, ts timestamp, action string, value double"
CASES = {
    "take_once": (stateful.take_once_stream, lambda e: handoff.take_once(e, 3000), ("put", "put", "take"), 3000),
    "round_trip": (stateful.round_trip_stream, lambda e: stateful.round_trips(e, 90_000), ("request", "request", "request", "result"), 90_000),
    "replay": (lambda e, _: stateful.replay_stream(e), lambda e: stateful.replays(e), ("item", "item", "attach", "item", "detach"), None),
}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER[0])
    spark.conf.set(*stateful.PROVIDER)
    yield spark
    spark.conf.set(stateful.PROVIDER[0], before)


def write(path, name, rows):
    lines = [json.dumps(dict(zip(("key", "id", "ts", "action", "value"), (k, i, t.isoformat(), a, v)))) for k, i, t, a, v in rows]
    file = path / f"{name}.json"
    file.write_text("\n".join(lines))
    at = 1.7e9 + len(list(path.iterdir()))  # files are read in this order
    os.utime(file, (at, at))


def drain(spark, path, stream, out):
    """Runs the stream over the files that are there, a file a micro-batch, and stops."""
    events = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(path / "in")).withWatermark("ts", "6 hours")
    query = stream(events).writeStream.format("parquet").option("checkpointLocation", str(path / "checkpoint")).option("path", str(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return query


@pytest.mark.parametrize("name", CASES)
def test_streams_give_the_rows_of_their_batch_forms(rocks, tmp_path, name):
    stream, batch, actions, limit = CASES[name]
    (tmp_path / "in").mkdir()
    rows = [(r["user_id"] % 12 if r["user_id"] % 5 else None, r["event_id"], r["ts"], actions[hash((r["event_id"] * 7919) % 101) % len(actions)], r["value"] if r["event_id"] % 9 else None) for r in rocks.read.parquet(EVENTS).orderBy("ts").limit(300).collect()]
    rows.append((1, 10**6, rows[-1][2], "unknown", 1.0))
    end = [(99, 10**7, rows[-1][2] + datetime.timedelta(days=9), "unknown", None)]  # carries the watermark over all rows
    parts = [rows[i : i + 60][::-1] for i in range(0, len(rows), 60)]  # each out of order
    parts[1][0], parts[2][-1] = parts[2][-1], parts[1][0]  # and a row of one in the next
    for i, part in enumerate(parts[:3]):
        write(tmp_path / "in", f"a{i}", part)
    run = lambda e: stream(e, limit)
    drain(rocks, tmp_path, run, tmp_path / "out")
    for i, part in enumerate([*parts[3:], end]):
        write(tmp_path / "in", f"b{i}", part)
    assert len(drain(rocks, tmp_path, run, tmp_path / "out").recentProgress) > 1  # goes on from the checkpoint
    want = batch(rocks.createDataFrame(rows, ROWS))
    got = rocks.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 20


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_round_trips_before_after_twice_and_too_late(rocks, tmp_path):
    rows = [
        (1, 1, at(0), "result", 1.0), (1, 2, at(5), "result", 2.0), (1, 3, at(9), "request", None),  # the latest of two before
        (2, 4, at(0), "request", None), (2, 5, at(10), "result", 5.0), (2, 6, at(11), "result", 6.0),  # the first after, at the deadline
        (3, 7, at(0), "request", None), (3, 8, at(10.001), "result", 8.0), (3, 9, at(12), "request", None),  # too late for one
        (4, 10, at(3), "request", None), (4, 11, at(3), "result", 11.0), (4, 12, at(3), "request", None),  # by id at one time
        (5, 13, at(1), "request", None), (5, 14, at(2), "request", None), (5, 15, at(11.5), "result", None),
    ]
    want = {3: (2, False), 4: (5, True), 7: (None, True), 9: (8, False), 10: (11, True), 12: (11, False), 13: (None, True), 14: (15, True)}
    batch = stateful.round_trips(rocks.createDataFrame(rows, ROWS))
    assert {r["request_id"]: (r["result_id"], r["waited"]) for r in batch.collect()} == want
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows[::-1]):
        write(tmp_path / "in", f"{i:02d}", [r])
    write(tmp_path / "in", "99", [(9, 99, at(10**6), "unknown", None)])
    drain(rocks, tmp_path, stateful.round_trip_stream, tmp_path / "out")
    assert {r["request_id"]: (r["result_id"], r["waited"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect()} == want


def test_a_stash_is_replayed_once(spark):
    rows = [(1, 1, at(0), "item", 1.0), (1, 2, at(1), "item", 2.0), (1, 3, at(2), "attach", None), (1, 4, at(3), "attach", None), (1, 5, at(4), "item", 5.0), (1, 6, at(5), "detach", None), (1, 7, at(6), "item", 7.0), (1, 8, at(7), "detach", None), (1, 9, at(8), "attach", None)]
    got = {r["item_id"]: (r["taken_by"], r["replayed"]) for r in stateful.replays(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {2: (3, True), 5: (4, False), 7: (9, True)}  # the first item gave way to the second


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert stateful.round_trips(empty).count() == stateful.replays(empty).count() == 0
    assert handoff.expired(empty.select("key", "ts"), F.lit(at(0))).count() == 0
