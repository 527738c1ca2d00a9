"""Upserts that touch few buckets, batches that are delivered again, tasks that fail."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankfold.sources import files as S
from rankfold.sources.keyed import KeyedTable

SCHEMA = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path) -> set[str]:
    return {str(p) for p in Path(path).rglob("part-*") if "_ledger" not in str(p)}


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=40)
    assert t.read().count() == 0
    t.upsert(frame(spark, [(k, f"old {k}") for k in range(1000)] + [(None, "none")]), "load")
    return t


def test_few_buckets_are_rewritten(spark, table):
    before = files(table.path)
    keys = [3, 500, 999, 2000]
    buckets = {r.b for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.xxhash64("k"), F.lit(40)).alias("b")).collect()}
    table.upsert(frame(spark, [(k, f"new {k}") for k in keys]), "a")
    after = files(table.path)
    assert {p.split("bucket=")[1].split("/")[0] for p in before ^ after} == {str(b) for b in buckets} and len(buckets) < 5
    got = {r.k: r.v for r in table.read().collect()}
    assert table.read().count() == 1002 and all(got[k] == (f"new {k}" if k in keys else f"old {k}") for k in [*range(1000), 2000]) and got[None] == "none"


def test_a_batch_counts_once(spark, table):
    assert table.upsert(frame(spark, [(1, "x"), (1, "y"), (None, "z")]), "a")
    before = files(table.path)
    assert not table.upsert(frame(spark, [(1, "other")]), "a")
    assert files(table.path) == before and {r.k: r.v for r in table.read().filter("k = 1 OR k IS NULL").collect()} == {1: "y", None: "z"}
    assert table.upsert(frame(spark, []), "nothing") and files(table.path) == before


def test_a_failing_task_changes_nothing(spark, table):
    before = files(table.path)
    bad = frame(spark, [(k, f"bad {k}") for k in range(300)]).withColumn("v", F.when(F.col("k") == 299, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad, "b")
    assert files(table.path) == before and not table.applied("b") and table.read().filter("v LIKE 'bad%'").count() == 0
    assert table.upsert(frame(spark, [(7, "good")]), "b") and table.read().filter("v = 'good'").count() == 1


def test_a_merge_of_ones_own(spark, table):
    join = lambda there, new: there.alias("t").join(new.alias("n"), "k", "full").select("k", F.concat_ws("+", "t.v", "n.v").alias("v"))
    table.upsert(frame(spark, [(5, "more"), (5000, "first")]), "m", join)
    assert {r.k: r.v for r in table.read().filter("k IN (5, 6, 5000)").collect()} == {5: "old 5+more", 6: "old 6", 5000: "first"}


def test_memory_is_written_once(spark, tmp_path):
    records = spark.createDataFrame([("2024-01-01", f"h{k}", f"Rating: {k}") for k in range(30)] + [("2024-01-02", "h1", "Rating: 9")], "day string, file_stem string, value string")
    path = f"{tmp_path}/memory"
    assert S.write_memory(records, path, "first")
    first = files(path)
    assert not S.write_memory(records, path, "first") and files(path) == first
    S.write_memory(records, path)
    read = lambda: sorted((str(r.day), r.file_stem, r.value) for r in spark.read.json(path).collect())
    assert len(read()) == 31
    S.write_memory(spark.createDataFrame([("2024-01-01", "h1", "Rating: 3")], records.schema), path, "second")
    assert len(read()) == 31 and ("2024-01-01", "h1", "Rating: 3") in read() and ("2024-01-02", "h1", "Rating: 9") in read()
