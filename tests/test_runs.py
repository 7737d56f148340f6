"""One run at a time, cancelling of running jobs, takeover after a crash, and what is left after each exit."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quirework.plans import runs


def slow(batches):
    for batch in batches:
        time.sleep(60)
        yield batch


def until(holds, seconds=30):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.05)


def told(spark, folder):
    return {r["name"]: r for r in runs.receipts(spark, folder).collect()}


def test_a_running_job_is_cancelled_and_has_its_receipt(spark, tmp_path):
    folder = f"file://{tmp_path}"
    seen = []

    def body(run):
        run.phase("reading")
        run.hold(spark.range(10).persist(), lambda df: (df.unpersist(), seen.append("frame")))
        run.phase("counting")
        spark.range(8).mapInArrow(slow, "id long").count()
        seen.append("never")

    run = runs.start(spark, "long", body, folder)
    tracker = spark.sparkContext.statusTracker()
    until(lambda: run.phases[-1:] == ["counting"] and tracker.getActiveStageIds())
    with pytest.raises(runs.Busy):
        runs.start(spark, "second", lambda r: None, folder)
    began = time.time()
    assert run.cancel() and run.cancel() and run.wait(30) == "cancelled" and time.time() - began < 20
    assert seen == ["frame"] and not run.cancel()
    until(lambda: not tracker.getActiveStageIds())
    row = told(spark, folder)["long"]
    assert row["outcome"] == "cancelled" and row["cancelled_at"] == "counting" and row["phases"] == ["reading", "counting"] and row["leftovers"] == 0
    after = runs.start(spark, "after", lambda r: spark.range(5).count(), folder)
    assert after.wait(60) == "ok" and after.value == 5


def test_cancelling_is_honoured_between_items_and_by_a_body_that_ignores_it(spark, tmp_path):
    folder = f"file://{tmp_path}"
    items = []

    def polite(run):
        for i in range(1000):
            run.step(i, 1000)
            items.append(i)
            time.sleep(0.05)

    run = runs.start(spark, "polite", polite, folder)
    until(lambda: len(items) > 3)
    assert run.cancel() and run.wait(10) == "cancelled" and len(items) < 900 and 0 < run.at < 1

    def deaf(run):
        until(run.flag.is_set)
        return "done anyway"

    run = runs.start(spark, "deaf", deaf, folder)
    run.cancel()
    assert run.wait(10) == "cancelled" and run.value is None

    def last(run):
        run.phase(runs.FINAL_PHASE)
        time.sleep(0.5)
        return 7

    run = runs.start(spark, "last", last, folder)
    until(lambda: run.phases)
    assert not run.cancel() and run.wait(10) == "ok" and run.value == 7
    assert {n: r["outcome"] for n, r in told(spark, folder).items()} == {"polite": "cancelled", "deaf": "cancelled", "last": "ok"}


def test_leases_expire_are_taken_over_and_their_loss_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    crashed = runs.Lease(spark, folder, 30).acquire()
    with pytest.raises(runs.Busy):
        runs.Lease(spark, folder, 30).acquire()
    assert crashed.renew()
    old = time.time() - 60
    os.utime(tmp_path / "leases" / str(crashed.number), (old, old))
    taken = runs.Lease(spark, folder, 30).acquire()
    assert taken.number == crashed.number + 1 and not crashed.renew() and taken.renew()
    taken.release()
    assert runs.Lease(spark, folder, 30).acquire().number == taken.number + 1
    assert not runs.create(spark, f"{folder}/leases/{taken.number + 1}", "two can't have one number")


@pytest.mark.parametrize("end", ["ok", "failed", "cancelled"])
def test_nothing_is_left_after_any_exit(spark, tmp_path, end):
    folder, work = f"file://{tmp_path}/runs", tmp_path / "work"
    os.makedirs(tmp_path / "runs")
    order, held = [], {}

    def body(run):
        held["frame"] = run.hold(spark.range(100).persist())
        held["frame"].count()
        run.hold(1, lambda x: order.append("first"))
        spark.range(3).write.parquet(run.hold(f"file://{work}"))
        held["cast"] = run.hold(spark.sparkContext.broadcast([1]))
        held["stream"] = run.hold(spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start())
        run.hold(2, lambda x: 1 / 0)
        run.hold(3, lambda x: order.append("last"))
        run.phase("made")
        if end == "failed":
            raise ValueError("Invalid array length")
        if end == "cancelled":
            until(run.flag.is_set)
            run.check()

    run = runs.start(spark, end, body, folder)
    until(lambda: run.phases or run.done.is_set())
    if end == "cancelled":
        run.cancel()
    assert run.wait(60) == end and order == ["last", "first"]
    assert not held["frame"].is_cached and not work.exists() and not held["stream"].isActive
    row = told(spark, folder)[end]
    assert row["outcome"] == end and row["leftovers"] == 1 and (row["message"] is not None) == (end == "failed")
    assert run.ledger.release() == 0


def test_receipts_of_an_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "receipts")
    (tmp_path / "receipts" / "none.json").write_text("")
    assert runs.receipts(spark, f"file://{tmp_path}").where(F.col("run").isNotNull()).count() == 0
