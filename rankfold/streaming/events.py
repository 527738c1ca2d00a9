"""Streams of play and rating events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from ..sources.shared import shared_path


def play_counters(events: DataFrame) -> DataFrame:
    """(item, full_play_count, skip_count, last_played) of play events; works on batches and streams."""
    kind = F.col("kind")
    known = events.filter(F.col("item").isNotNull())
    return known.groupBy("item").agg(F.count_if(kind == "purchase").alias("full_play_count"), F.count_if(kind == "error").alias("skip_count"), F.max(F.when(kind == "view", F.col("ts"))).alias("last_played"))


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeated deliveries of an event within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest_ratings(events: DataFrame) -> DataFrame:
    """(item, rating, ts): the last rating of every item; works on batches and streams."""
    rated = events.filter((F.col("kind") == "click") & F.col("item").isNotNull())
    return rated.groupBy("item").agg(F.max_by(F.struct("rating", "ts"), F.struct("ts", "event_id")).alias("r")).select("item", "r.rating", "r.ts")


def event_stream(spark: SparkSession, sf_dir: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """The events table as a file stream, whether it is one file or a folder."""
    reader = spark.readStream.schema(like.schema).option("recursiveFileLookup", True)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/events*.parquet")


def drained(stream: DataFrame, key: str = "item", buckets: int = 64) -> DataFrame:
    """Runs a stream of changed rows until its source is exhausted; returns the last version of every key.

    Every batch replaces the buckets of the keys that it changed, so no older versions pile up; a batch that is repeated
    after a failure changes nothing.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    table = KeyedTable(spark, f"{path}/state", stream.schema, [key], buckets=buckets)

    def keep(batch: DataFrame, number: int) -> None:
        table.upsert(batch, str(number))

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return table.read()
