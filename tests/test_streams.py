"""Lifetimes as state of a stream, and the backfill queue."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rankfold.operators import features
from rankfold.streaming import backfill, lifetimes

NOW = datetime(2024, 7, 1, 12)


def test_restarted_stream_equals_the_batch_twin(spark, tmp_path):
    """Writings in one run, reads in another that starts from the checkpoint: the rows that expire and are renewed are the batch's."""
    ages = [0, 1, 3600, 21 * 86400, 22 * 86400 + 43200 - 1, 22 * 86400 + 43200, 60 * 86400, 90 * 86400 - 1, 90 * 86400, 90 * 86400 + 1, 120 * 86400]
    rows = [(k, NOW - timedelta(seconds=ages[k % 11]), k % 2 == 0) for k in range(44)]
    table = spark.createDataFrame(rows, "key long, written timestamp, read boolean")
    schema = "key long, kind string, ts timestamp"

    def arrive(name, events):
        spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def stream():
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    arrive("a", [(k, "write", w) for k, w, _ in rows] + [(None, "write", NOW), (3, "write", None)])
    path = f"file://{tmp_path}/state"
    first = lifetimes.run(stream(), path)
    assert first.filter("outcome = 'written'").count() == 44
    arrive("b", [(k, "read", NOW) for k, _, r in rows if r] + [(99, "read", NOW)])
    second = lifetimes.run(stream(), path).cache()
    got = {(r.key, r.written, r.refreshed) for r in lifetimes.living(second, str(NOW)).collect()}
    want = {(r.key, r.written, r.refreshed) for r in features.feature_ttl(table, str(NOW)).collect()}
    assert got == want
    # What nobody reads expires by its timer.
    assert {r.key for r in second.filter("outcome = 'expired'").collect()} == {k for k, w, _ in rows if (NOW - w).total_seconds() > 90 * 86400}
    assert {r.outcome for r in second.filter("key = 99").collect()} == {"miss"}


def test_order_of_events(spark, tmp_path):
    """Late writings, reads of expired rows, a renewal that keeps a row alive."""
    at = lambda days: NOW + timedelta(days=days)
    events = [(1, "write", at(0)), (1, "read", at(80)), (1, "read", at(169)), (2, "write", at(0)), (2, "read", at(91)), (2, "write", at(92)), (3, "write", at(10)), (3, "write", at(5)), (3, "read", at(11)), (4, "read", at(0))]
    spark.createDataFrame(events, "key long, kind string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = lifetimes.run(spark.readStream.schema("key long, kind string, ts timestamp").parquet(f"{tmp_path}/in"), f"file://{tmp_path}/state")
    steps = {}
    for r in out.collect():
        steps.setdefault(r.key, []).append((r.at, r.outcome))
    names = {k: [o for _, o in sorted(v)] for k, v in steps.items()}
    assert names[1] == ["written", "refreshed", "refreshed"]
    assert names[2] == ["written", "expired", "miss", "written"]
    assert names[3][:3] == ["written", "written", "hit"] and names[4] == ["miss"]


def embed(rows):
    """Texts of an odd length can't be embedded."""
    return rows.select("key", F.when(F.length("text") % 2 == 1, F.array(F.lit(0.0))).otherwise(F.array(F.length("text").cast("double"))).alias("embedding"))


SCHEMA = "key long, text string, priority int"


def queue(spark, seen, **options):
    def process(rows):
        seen.append([(r.key, r.priority) for r in rows.orderBy(F.col("priority").desc_nulls_last(), "key").collect()])
        return embed(rows)

    like = spark.createDataFrame([], SCHEMA).schema
    return backfill.Queue(spark, like, process, "key long, embedding array<double>", failed=F.forall("embedding", lambda x: x == 0), **options)


def rows(n, start=0):
    return [(start + k, "x" * (2 + 2 * (k % 5) + (k % 10 == 7)), None if k % 13 == 0 else k % 4) for k in range(n)]


def test_priority_retries_and_linear_reads(spark):
    seen = []
    q = queue(spark, seen, cap=10, tries=3)
    q.put(spark.createDataFrame(rows(45) + [(None, "x", 1)], SCHEMA), "a")
    ticks = 0
    while q.tick():
        ticks += 1
    first = seen[:5]
    order = [p if p is not None else -1 for chunk in first for _, p in chunk]
    assert order == sorted(order, reverse=True) and [len(c) for c in first] == [10, 10, 10, 10, 5]
    bad = {k for k in range(45) if k % 10 == 7}
    assert [{k for k, _ in c} for c in seen if {k for k, _ in c} <= bad] and sum(len(bad & {k for k, _ in c}) for c in seen) == 3 * len(bad)
    got = {r.key: r.embedding for r in q.results().collect()}
    assert set(got) == set(range(45)) and q.results().count() == 45 and {k for k, v in got.items() if v == [0.0]} == bad
    assert q.rows_read == 45 + 2 * len(bad) and ticks == len(seen)


def test_reads_grow_with_rows_not_with_ticks(spark):
    reads = []
    for n in (20, 60):
        q = queue(spark, [], cap=5, tries=1)
        q.put(spark.createDataFrame(rows(n), SCHEMA), "a")
        while q.tick():
            pass
        reads.append(q.rows_read)
    assert reads == [20, 60]


def test_a_restarted_queue_goes_on(spark):
    seen = []
    q = queue(spark, seen, cap=10, tries=1)
    q.put(spark.createDataFrame(rows(30), SCHEMA), "a")
    q.tick()
    again = queue(spark, seen, cap=10, tries=1, path=q.path)
    assert len(again.waiting) == 2 and again.results().count() == 10
    again.put(spark.createDataFrame(rows(30), SCHEMA), "a")  # the same batch, delivered again
    while again.tick():
        pass
    assert sorted(r.key for r in again.results().collect()) == list(range(30))


def test_stream_with_repeats_and_cool_down(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(rows(12, start=6 * k), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = queue(spark, [], cap=8, tries=1, cool_down=1.0)
    began = time.time()
    out = q.run(stream)
    assert sorted(r.key for r in out.collect()) == list(range(24))
    assert time.time() - began >= len(q.done) - 1
    assert queue(spark, [], cap=8).results().count() == 0


@pytest.mark.parametrize("cap", [1, 100])
def test_caps(spark, cap):
    q = queue(spark, [], cap=cap, tries=1)
    q.put(spark.createDataFrame(rows(3), SCHEMA), "a")
    assert len(q.waiting) == (3 if cap == 1 else 1)


def test_a_key_costs_few_calls_to_the_store():
    """Rows go in and out without frames; a new key reads its state once, writes it once and sets one timer."""
    calls = []

    class Store:
        at = None

        def __getattr__(self, name):
            if name == "getValueState":
                return lambda *a: self

            def call(*args):
                calls.append(name)
                if name in ("update", "clear"):
                    self.at = args[0] if args else None
                return self.at if name == "get" else None

            return call

    life = lifetimes.Lifetime(1000 * 3600)
    life.init(Store())
    event = lambda at, kind: Row(key=1, kind=kind, at=at, ts=None)
    out = list(life.handleInputRows((1,), iter([event(2_000_000, "read"), event(0, "write")]), None))
    assert [(r.key, r.outcome, r.at, r.written) for r in out] == [(1, "written", 0, 0), (1, "refreshed", 2_000_000, 2_000_000)]
    assert calls == ["get", "update", "registerTimer"]
