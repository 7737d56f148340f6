"""One-shot handoffs: put a record under a key, take it once, and not after its time.

The batch form; streaming/stateful.py has that of streams. A put replaces what the key held; a take
gets it if it is no older than TTL and leaves the key empty either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_SECONDS = 300
RESULT = "key long, take_id long, taken_ts timestamp, put_id long, value double"


def take_once(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """For each take: the put that it gets, or null. events: key, id, ts, action (put or take), value.

    A take looks at the event right before it under its key: anything but a put
    means that the key is empty. One sort by key, no state.
    """
    order = W.partitionBy("key").orderBy("ts", "id")
    before = F.lag(F.struct("action", "id", "ts", "value")).over(order)
    fresh = (before["action"] == "put") & (F.col("ts") <= before["ts"] + F.expr(f"INTERVAL {int(ttl)} SECONDS"))
    seen = events.where(F.col("action").isin("put", "take")).select("*", F.when(fresh, before).alias("got"))
    return seen.where("action = 'take'").select("key", F.col("id").alias("take_id"), F.col("ts").alias("taken_ts"), F.col("got.id").alias("put_id"), F.col("got.value").alias("value"))


def expired(puts: DataFrame, now, ttl: int = TTL_SECONDS) -> DataFrame:
    """Records that a sweep at a time deletes."""
    return puts.where(F.col("ts") + F.expr(f"INTERVAL {int(ttl)} SECONDS") < F.lit(now))


def latest_wins(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's requests only the last, as struct columns of the request."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def phase_changes(log: DataFrame, key: str, order: str, phase: str) -> DataFrame:
    """Log rows at which the phase differs from that before."""
    before = F.lag(phase).over(W.partitionBy(key).orderBy(order))
    return log.withColumn("__before", before).where(~F.col(phase).eqNullSafe(F.col("__before"))).drop("__before")
