"""Queries: streams, run until their source is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, recommend
from ..sources import views as V
from ..sources.shared import shared_path
from ..streaming import backfill as B
from ..streaming import events as E
from ..streaming import lifetimes as L
from .registry import query


def _events(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    s = E.event_stream(spark, sf_dir, e)
    return s.select(F.col("user_id").alias("item"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.least(F.col("value") / 49.1, F.lit(10.0)).alias("rating"))


@query("SELECT user_id AS item, count(*) FILTER (event_type = 'purchase') AS full_play_count, count(*) FILTER (event_type = 'error') AS skip_count, CAST(floor(epoch(max(ts) FILTER (event_type = 'view'))) AS DOUBLE) AS last_played FROM events GROUP BY user_id")
def play_event_counters(spark, sf_dir):
    state = E.drained(E.play_counters(E.without_repeats(_events(spark, sf_dir))))
    return state.select("item", "full_play_count", "skip_count", F.unix_timestamp("last_played").cast("double").alias("last_played"))


@query("SELECT item, round(rating, 6) AS rating, CAST(floor(epoch(ts)) AS BIGINT) AS rated_at FROM item_events WHERE kind = 'click' QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) = 1")
def latest_rating_state(spark, sf_dir):
    return E.drained(E.latest_ratings(_events(spark, sf_dir))).select("item", F.round("rating", 6).alias("rating"), F.unix_timestamp("ts").alias("rated_at"))


@query("SELECT DISTINCT conv_id || ':' || turn AS key, CAST(16 AS INTEGER) AS dims, 'hashing-16' AS version, true AS rated FROM conversations")
def incremental_backfill(spark, sf_dir):
    """Each tick takes a capped chunk of what waits, longest texts first, embeds it, predicts a rating, and writes both back."""
    embedder = features.HashingEmbedder(16)
    docs = V.table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/conversations*.parquet")
    keyed = stream.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text", F.length("text").alias("priority"))
    rows = docs.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.coalesce("text", F.lit("")).alias("text"), (F.length("text") % 11).cast("double").alias("label"))
    rated = rows.orderBy(F.xxhash64("key"), "key").limit(500)  # a rater needs a bounded sample of ratings
    train = features.embedded(rated, embedder, "key", "text").select("key", F.col("embedding").alias("features")).join(rated.select("key", "label"), "key")
    rater = recommend.train_rater(recommend.inverse_frequency_weights(train), weight="weight", iterations=3)

    def process(batch):
        found = features.embedded(batch, embedder, "key", "text").withColumnRenamed("embedding", "features")
        return rater.predict(found).select("key", F.col("features").alias("embedding"), "version", F.col("prediction").alias("rating"))

    cap = max(200, -(-docs.count() // 4))  # a few ticks
    queue = B.Queue(spark, keyed.schema, process, "key string, embedding array<double>, version string, rating double", cap=cap, failed=F.forall("embedding", lambda x: x == 0), tries=2)
    return queue.run(keyed).select("key", F.size("embedding").alias("dims"), "version", F.col("rating").isNotNull().alias("rated"))


_TTL = """
SELECT idx, CAST(epoch(CASE WHEN r AND age >= 1944000 THEN TIMESTAMP '2024-07-01 12:00:00' ELSE w END) AS BIGINT) AS written, r AND age >= 1944000 AS refreshed
FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-07-01 12:00:00') - epoch(w) AS BIGINT) AS age FROM (SELECT idx, TIMESTAMP '2024-07-01 12:00:00' - to_hours(idx * 13 % 3000) AS w, idx % 2 = 0 AS r FROM files)) WHERE age <= 7776000
"""


@query(_TTL)
def feature_ttl(spark, sf_dir):
    now = F.lit(V.NOW).cast("timestamp")
    rows = V.files(spark, sf_dir).select("idx", (now - F.make_dt_interval(F.lit(0), (F.col("idx") * 13 % 3000).cast("int"))).alias("written"), (F.col("idx") % 2 == 0).alias("read"))
    return features.feature_ttl(rows, V.NOW).select("idx", F.unix_timestamp("written").alias("written"), "refreshed")


@query(_TTL)
def feature_ttl_stream(spark, sf_dir):
    """The same lifetimes as state of a stream: every file's row is written once, every second one is read at the end."""
    docs = V.table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/documents*.parquet")
    now = F.lit(V.NOW).cast("timestamp")
    written = F.struct(F.lit("write").alias("kind"), (now - F.make_dt_interval(F.lit(0), (F.col("doc_id") * 13 % 3000).cast("int"))).alias("ts"))
    events = F.when(F.col("doc_id") % 2 == 0, F.array(written, F.struct(F.lit("read").alias("kind"), now.alias("ts")))).otherwise(F.array(written))
    outcomes = L.run(stream.select(F.col("doc_id").alias("key"), F.explode(events).alias("e")).select("key", "e.kind", "e.ts"), shared_path(spark, "lifetimes"))
    return L.living(outcomes, V.NOW).select(F.col("key").alias("idx"), F.unix_timestamp("written").alias("written"), "refreshed")
