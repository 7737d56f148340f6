"""Handoffs, round trips and replays on a stream, with state by key, timers and stashes.

Rows come in any order within the watermark. A key's rows wait in a list until
the watermark has passed them, and are then worked through by time and id, so
that a stream gives the rows of its batch form, however it is cut into
micro-batches and wherever it is restarted. One timer a key wakes it at its next
row or deadline. State is one record a key, and what waits.

Rows: key, id, ts, action, value, with a watermark on ts. Spark leaves out rows
behind the watermark; rows of an unknown action change nothing; a null value is
carried on; rows without key share one; rows without ts never get their turn.

The session needs the RocksDB state store, which state variables are made for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirework.streaming.handoff import RESULT, TTL_SECONDS

#: How long a request waits for a first result.
DEADLINE_SECONDS = 10
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROUND_TRIP = "key long, request_id long, requested timestamp, result_id long, value double, waited boolean"
REPLAY = "key long, item_id long, taken_by long, replayed boolean, value double"


class InOrder(StatefulProcessor):
    """Hands a key's rows to work() by time and id, once the watermark has passed them."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, action string, value double")
        self.start()

    def start(self) -> None:
        """Opens further state."""

    def work(self, key, us: int, id: int, action: str, value: float | None) -> Iterator[tuple]:
        """Rows that one row gives."""
        raise NotImplementedError

    def passed(self, key, us: int) -> Iterator[tuple]:
        """Rows that come of the time having passed; what is still to come is later."""
        return iter(())

    def next_wake(self) -> int | None:
        """The next time, in microseconds, by which passed() has to run."""
        return None

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        return out.astype({c: "Int64" for c in out.columns if c.endswith("_id") or c == "taken_by"})

    def wake(self, waiting: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [w[0] for w in waiting[:1]] + [t for t in [self.next_wake()] if t is not None]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts.value // 1000, int(r.id), r.action, None if pd.isna(r.value) else float(r.value)) for frame in rows for r in frame.itertuples() if not pd.isna(r.ts)]
        waiting = sorted([*self.waiting.get(), *new], key=lambda w: w[:2])
        self.waiting.put(waiting)
        self.wake(waiting)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda w: w[:2])
        due = [w for w in waiting if w[0] < now]
        out: list[tuple] = []
        for us, id, action, value in due:
            out += self.passed(key[0], us)
            out += self.work(key[0], us, id, action, value)
        out += self.passed(key[0], now)
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.wake(rest)
        yield self.frame(out)

    def close(self) -> None:
        pass


def time_of(us: int) -> pd.Timestamp:
    return pd.Timestamp(us * 1000)


class TakeOnce(InOrder):
    """A put replaces what the key holds, a take empties it, and the sweep deletes what is older than ttl."""

    columns = ["key", "take_id", "taken_ts", "put_id", "value"]

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def start(self) -> None:
        self.held = self.handle.getValueState("held", "us long, id long, value double")

    def work(self, key, us, id, action, value):
        if action == "put":
            self.held.update((us, id, value))
        elif action == "take":
            held = self.held.get() if self.held.exists() else None
            self.held.clear()
            yield key, id, time_of(us), held[1] if held else None, held[2] if held else None

    def passed(self, key, us):
        if self.held.exists() and self.held.get()[0] + self.ttl < us:
            self.held.clear()
        return iter(())

    def next_wake(self):
        return self.held.get()[0] + self.ttl if self.held.exists() else None


class RoundTrip(InOrder):
    """A request gets the latest result of its key, or waits for the first until its deadline."""

    columns = ["key", "request_id", "requested", "result_id", "value", "waited"]

    def __init__(self, deadline: int):
        self.deadline = deadline * 1_000_000

    def start(self) -> None:
        self.latest = self.handle.getValueState("latest", "id long, value double")
        self.pending = self.handle.getListState("pending", "us long, id long")

    def work(self, key, us, id, action, value):
        if action == "result":
            self.latest.update((id, value))
            for at, request in self.pending.get():
                yield key, request, time_of(at), id, value, True
            self.pending.clear()
        elif action == "request":
            if self.latest.exists():
                result, value = self.latest.get()
                yield key, id, time_of(us), result, value, False
            else:
                self.pending.put([*self.pending.get(), (us, id)])

    def passed(self, key, us):
        waiting = list(self.pending.get())
        over = [p for p in waiting if p[0] + self.deadline < us]
        if over:
            left = waiting[len(over) :]
            self.pending.put(left) if left else self.pending.clear()
        for at, request in over:
            yield key, request, time_of(at), None, None, True

    def next_wake(self):
        return min((us + self.deadline for us, _ in self.pending.get()), default=None)


class Replay(InOrder):
    """Items go to the consumer at hand; else the last of them is stashed, for the next consumer to get once."""

    columns = ["key", "item_id", "taken_by", "replayed", "value"]

    def start(self) -> None:
        self.consumer = self.handle.getValueState("consumer", "id long")
        self.stash = self.handle.getListState("stash", "id long, value double")

    def work(self, key, us, id, action, value):
        if action == "item":
            if self.consumer.exists():
                self.stash.clear()
                yield key, id, self.consumer.get()[0], False, value
            else:
                self.stash.put([(id, value)])
        elif action == "attach":
            self.consumer.update((id,))
            for item, held in self.stash.get():
                yield key, item, id, True, held
            self.stash.clear()
        elif action == "detach":
            self.consumer.clear()


def run(events: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    picked = events.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), "ts", "action", F.col("value").cast("double").alias("value"))
    return picked.groupBy("key").transformWithStateInPandas(processor, schema, "append", "eventTime")


def take_once_stream(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """handoff.take_once on a stream: actions put and take."""
    return run(events, TakeOnce(ttl), RESULT)


def round_trip_stream(events: DataFrame, deadline: int = DEADLINE_SECONDS) -> DataFrame:
    """round_trips on a stream: actions request and result, which may be two streams put together."""
    return run(events, RoundTrip(deadline), ROUND_TRIP)


def replay_stream(events: DataFrame) -> DataFrame:
    """replays on a stream: actions item, attach and detach."""
    return run(events, Replay(), REPLAY)


def round_trips(events: DataFrame, deadline: int = DEADLINE_SECONDS) -> DataFrame:
    """Each request with the latest result of its key before it, else the first after it within the deadline, else null. One sort by key."""
    order = W.partitionBy("key").orderBy("ts", "id")
    result = F.when(F.col("action") == "result", F.struct("id", "ts", "value"))
    seen = events.where(F.col("action").isin("request", "result") & F.col("ts").isNotNull())
    latest = F.last(result, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    coming = F.first(result, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    met = seen.withColumn("latest", latest).withColumn("coming", coming).where("action = 'request'")
    soon = F.when(F.col("coming.ts") <= F.col("ts") + F.expr(f"INTERVAL {int(deadline)} SECONDS"), F.col("coming"))
    got = F.coalesce("latest", soon)
    return met.select("key", F.col("id").alias("request_id"), F.col("ts").alias("requested"), got["id"].alias("result_id"), got["value"].alias("value"), F.col("latest").isNull().alias("waited"))


def replays(events: DataFrame) -> DataFrame:
    """Each item that a consumer got, from whom it was taken and whether it was stashed before. One sort by key."""
    order = W.partitionBy("key").orderBy("ts", "id")
    seen = events.where(F.col("action").isin("item", "attach", "detach") & F.col("ts").isNotNull())
    at_hand = F.last(F.when(F.col("action") != "item", F.struct("action", "id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    told = seen.withColumn("at_hand", F.when(at_hand["action"] == "attach", at_hand["id"]))
    after = F.lead(F.struct("action", "id")).over(order)  # a consumer that goes takes no item with it, so these are passed over
    following = told.where("action <> 'detach'").withColumn("after", after).where("action = 'item'")
    replayed = F.when(F.col("after.action") == "attach", F.col("after.id"))
    taken = F.coalesce("at_hand", replayed)
    return following.where(taken.isNotNull()).select("key", F.col("id").alias("item_id"), taken.alias("taken_by"), F.col("at_hand").isNull().alias("replayed"), "value")
