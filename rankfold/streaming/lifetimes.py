"""Lifetimes of derived rows as state of a stream.

A row lives for `ttl` after it was last written; a read of a row older than a quarter of that renews it. The state of a key
is the time of its last writing; a timer in event time ends it when the watermark has passed its lifetime, so rows that
nobody asks for any more expire as well. State and timers are in the checkpoint: a restarted stream goes on where it was.

Edge cases: events without key or time are left out; a key's events of one batch are taken in the order of time, writings
first; a writing that comes late, behind a later one, changes nothing; a read of what isn't there is a miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: What comes later than the latest event of the batches before by more than this is dropped, as streams do.
DELAY = "10 milliseconds"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Lifetime(StatefulProcessor):
    """Emits what happened to a key: written, hit, refreshed, miss, expired; times in milliseconds."""

    def __init__(self, ttl: int):
        self.ttl, self.renew = ttl, max(1000, ttl // 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("written", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = sorted((r.at, r.kind != "write", r.kind) for r in rows)
        before = at = self._written()
        for t, _, kind in events:
            if at is not None and t - at > self.ttl:
                yield Row(key=key[0], outcome="expired", at=at + self.ttl, written=None)
                at = None
            if kind == "write":
                at = t if at is None else max(at, t)
                yield Row(key=key[0], outcome="written", at=t, written=at)
            elif at is None:
                yield Row(key=key[0], outcome="miss", at=t, written=None)
            elif t - at >= self.renew:
                at = t
                yield Row(key=key[0], outcome="refreshed", at=t, written=at)
            else:
                yield Row(key=key[0], outcome="hit", at=t, written=at)
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl + 1)
            if at is None:
                self.state.clear()
            else:
                self.state.update((at,))
                self.handle.registerTimer(at + self.ttl + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at = self._written()
        if at is None or at + self.ttl >= expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.clear()
        yield Row(key=key[0], outcome="expired", at=at + self.ttl, written=None)

    def _written(self) -> int | None:
        found = self.state.get()  # one call to the store; None where there is no state
        return found[0] if found else None

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """State with timers needs a store of column families."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def lifetimes(events: DataFrame, ttl_seconds: int = 90 * 86400, delay: str = DELAY) -> DataFrame:
    """(key, outcome, at, written) of a stream of (key, kind: write or read, ts)."""
    kind = dict(events.dtypes)["key"]
    marked = events.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return marked.select("key", "kind", "at", "ts").groupBy("key").transformWithState(statefulProcessor=Lifetime(1000 * ttl_seconds), outputStructType=f"key {kind}, outcome string, at long, written long", outputMode="Append", timeMode="EventTime")


def run(events: DataFrame, path: str, ttl_seconds: int = 90 * 86400, delay: str = DELAY) -> DataFrame:
    """Takes in what the source of a stream has, and returns all outcomes so far. path: a shared folder that keeps the stream's state; a later run with the same one goes on."""
    spark = events.sparkSession
    with _rocks(spark):
        out = lifetimes(events, ttl_seconds, delay)
        out.writeStream.format("parquet").option("path", f"{path}/outcomes").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/outcomes")


def living(outcomes: DataFrame, now: str, ttl_seconds: int = 90 * 86400) -> DataFrame:
    """(key, written, refreshed) of the rows that are alive at a time: their last state, whether a read renewed them at that time."""
    at = F.unix_millis(F.lit(now).cast("timestamp"))
    # Of what happens at one time, an end comes before a writing, and that before a read.
    step = F.when(F.col("outcome") == "expired", 0).when(F.col("outcome") == "written", 1).otherwise(2)
    last = outcomes.filter("outcome <> 'miss'").groupBy("key").agg(F.max_by(F.struct("outcome", "at", "written"), F.struct("at", step.alias("step"))).alias("last"))
    alive = last.filter((F.col("last.outcome") != "expired") & (at - F.col("last.written") <= 1000 * ttl_seconds))
    return alive.select("key", F.timestamp_millis("last.written").alias("written"), ((F.col("last.outcome") == "refreshed") & (F.col("last.at") == at)).alias("refreshed"))
