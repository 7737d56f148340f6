"""Runs of Spark jobs: one at a time, cancelled on request, cleaned up on every exit, each with a receipt.

A run holds a lease in a shared folder. Leases are numbered files, each created
exclusively, so that of two who want the next number one gets it; the owner
touches its file while it runs and writes a mark when it is over. A file that
was neither touched for a while nor marked is that of a crashed driver, and the
next number is free. A run that finds a newer lease than its own stops.

Jobs of a run carry a tag. Cancelling sets a flag, which the body meets at its
next check(), and cancels the tagged jobs; a body that ignores both is run to
its end and its result thrown away. In a phase that is the last rebuild a run
can't be cancelled any more.

What a run holds is disposed of in reverse order, whether it succeeds, fails or
is cancelled, and one that can't be disposed of doesn't keep the others. The
outcome is a row of the folder's receipts.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.plans.preflight import run_receipts

#: Seconds after which a lease that nobody touched is free.
LEASE_SECONDS = 60.0
#: A phase of this name can't be cancelled.
FINAL_PHASE = "writing the result"
RECEIPT = "run string, name string, phases array<string>, phase string, cancelled_at string, error string, ms long, leftovers int"


class Busy(RuntimeError):
    """Another run is active."""


class Cancelled(RuntimeError):
    """The run was cancelled."""

    def __init__(self, phase: str | None):
        super().__init__(f"AbortError: cancelled in phase {phase}")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call created the file; False where there is one."""
    fs, at = file_system(spark, path)
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            handle = os.open(urlsplit(path).path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return True
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Lease:
    """The right to run in a folder."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = LEASE_SECONDS):
        self.spark, self.folder, self.seconds, self.number = spark, folder.rstrip("/") + "/leases", seconds, 0
        fs, at = file_system(spark, self.folder)
        fs.mkdirs(at)

    def newest(self) -> tuple[int, bool]:
        """The last number and whether it is still held; numbers start at 1."""
        fs, at = file_system(self.spark, self.folder)
        files = {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)}
        numbers = [int(n) for n in files if n.isdigit()]
        last = max(numbers, default=0)
        return last, bool(numbers) and f"{last}.over" not in files and files[str(last)] + self.seconds > time.time()

    def acquire(self) -> Lease:
        last, held = self.newest()
        if held or not create(self.spark, f"{self.folder}/{last + 1}", json.dumps({"application": self.spark.sparkContext.applicationId})):
            raise Busy("another run is active")
        self.number = last + 1
        fs, _ = file_system(self.spark, self.folder)
        for n in range(max(1, last - 8), last):  # old files go, the last ones stay to be counted on from
            for name in (f"{n}", f"{n}.over"):
                fs.delete(file_system(self.spark, f"{self.folder}/{name}")[1], False)
        return self

    def renew(self) -> bool:
        """Touches the lease; False if it was taken over."""
        fs, at = file_system(self.spark, f"{self.folder}/{self.number}")
        if self.newest()[0] != self.number:
            return False
        fs.setTimes(at, int(time.time() * 1000), -1)
        return True

    def release(self) -> None:
        create(self.spark, f"{self.folder}/{self.number}.over", "")


class Ledger:
    """What has to be disposed of, in reverse order of coming."""

    def __init__(self, spark: SparkSession):
        self.spark, self.entries = spark, []

    def hold(self, value, dispose: Callable | None = None):
        """Returns value. Without dispose: frames are unpersisted, streams stopped, broadcasts destroyed, paths deleted."""
        self.entries.append((value, dispose))
        return value

    def dispose(self, value, dispose: Callable | None) -> None:
        if dispose:
            dispose(value)
        elif isinstance(value, str):
            fs, at = file_system(self.spark, value)
            fs.delete(at, True)
        else:
            for name in ("unpersist", "stop", "destroy", "close"):
                if hasattr(value, "destroy") and name == "unpersist":  # a broadcast
                    continue
                if hasattr(value, name):
                    getattr(value, name)()
                    return

    def release(self) -> int:
        """Disposes of all and tells how many couldn't be; a second call has nothing left to do."""
        failed = 0
        while self.entries:
            try:
                self.dispose(*self.entries.pop())
            except Exception:
                failed += 1
        return failed


class Run:
    """A body at work: what it gets as its only argument, and what its caller holds."""

    def __init__(self, spark: SparkSession, name: str, folder: str, seconds: float):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")
        self.id, self.phases, self.at = uuid.uuid4().hex, [], 0.0
        self.ledger, self.flag, self.done = Ledger(spark), threading.Event(), threading.Event()
        self.cancelled_at: str | None = None
        self.outcome = self.value = self.error = None
        self.lock = threading.Lock()
        self.lease = Lease(spark, folder, seconds).acquire()

    # for the body

    def phase(self, name: str) -> None:
        self.check()
        if not self.phases or self.phases[-1] != name:
            self.phases.append(name)

    def step(self, done: int, of: int) -> None:
        """Progress comes of counters alone."""
        self.check()
        self.at = max(0.0, min(1.0, done / of)) if of > 0 else self.at

    def check(self) -> None:
        if self.flag.is_set():
            raise Cancelled(self.cancelled_at)

    def hold(self, value, dispose: Callable | None = None):
        return self.ledger.hold(value, dispose)

    # for the caller

    @property
    def tag(self) -> str:
        return f"run-{self.id}"

    def cancel(self) -> bool:
        """Whether the run will be cancelled: not once it is over, or in its last phase."""
        with self.lock:
            if self.done.is_set() or self.phases[-1:] == [FINAL_PHASE]:
                return False
            if not self.flag.is_set():
                self.cancelled_at = self.phases[-1] if self.phases else None
                self.flag.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return True

    def wait(self, seconds: float | None = None) -> str | None:
        """The outcome (ok, failed or cancelled), or None if it isn't there yet."""
        self.done.wait(seconds)
        return self.outcome

    # inside

    def watch(self) -> None:
        while not self.done.wait(self.lease.seconds / 3):
            if self.flag.is_set():  # jobs that began after the cancelling
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if not self.lease.renew():
                self.cancel()

    def work(self, body: Callable[[Run], object]) -> None:
        context, began = self.spark.sparkContext, time.time()
        context.addJobTag(self.tag)
        try:
            self.value = body(self)
        except Exception as e:
            self.error = e
        finally:
            context.removeJobTag(self.tag)
            with self.lock:
                self.outcome = "cancelled" if self.flag.is_set() else "failed" if self.error else "ok"
                if self.outcome != "ok":
                    self.value = None
            leftovers = self.ledger.release()
            said = str(Cancelled(self.cancelled_at)) if self.outcome == "cancelled" else f"{type(self.error).__name__}: {self.error}"[:2000] if self.error else None
            row = {"run": self.id, "name": self.name, "phases": self.phases, "phase": self.phases[-1] if self.phases else None, "cancelled_at": self.cancelled_at, "error": said, "ms": int(1000 * (time.time() - began)), "leftovers": leftovers}
            try:
                fs, at = file_system(self.spark, f"{self.folder}/receipts")
                fs.mkdirs(at)
                create(self.spark, f"{self.folder}/receipts/{self.id}.json", json.dumps(row))
                self.lease.release()
            finally:
                self.done.set()


def start(spark: SparkSession, name: str, body: Callable[[Run], object], folder: str, seconds: float = LEASE_SECONDS) -> Run:
    """Starts body in a thread of its own; raises Busy if another run is active in folder, which all drivers share."""
    run = Run(spark, name, folder, seconds)
    threading.Thread(target=run.watch, daemon=True).start()
    threading.Thread(target=inheritable_thread_target(spark)(run.work), args=(body,), daemon=True).start()
    return run


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """The receipts of all runs of a folder, with outcome, kind of failure and what to tell."""
    rows = spark.read.schema(RECEIPT).json(folder.rstrip("/") + "/receipts/*.json")
    return run_receipts(rows).withColumn("outcome", F.when(F.col("error").startswith("AbortError"), "cancelled").otherwise(F.col("outcome")))
