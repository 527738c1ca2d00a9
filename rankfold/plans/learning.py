"""Queries: recommendation, statistics of ratings, and the preference model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import uniform_sql
from ..operators import features
from ..operators import recommend as M
from ..operators import sequences as Q
from ..operators.library import latest_per_key
from ..operators.ranking import Down, global_rank
from ..operators.search import text_chunks
from ..sources import files as S
from ..sources import views as V
from ..sources.shared import stored
from .joins import _OVERLAID, overlaid
from .registry import query


@query("SELECT coalesce(avg(user_rating), 5.0) AS mean_rating FROM library")
def mean_rating_fallback(spark, sf_dir):
    return M.mean_rating(V.library(spark, sf_dir)).select(F.col("mean_rating"))


_RECENCY = "recency AS (SELECT *, CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY coalesce(epoch(last_played), 0) DESC, idx) - 1)::DOUBLE / (count(*) OVER () - 1) ELSE 0.0 END AS recency FROM overlaid)"


@query(f"WITH {_OVERLAID}, {_RECENCY} SELECT idx, round(recency, 9) AS recency FROM recency")
def recency_rank(spark, sf_dir):
    return M.recency_rank(overlaid(spark, sf_dir)).select("idx", F.round("recency", 9).alias("recency"))


_SCORED = f"{_OVERLAID}, {_RECENCY}, scored AS (SELECT idx, path, power(greatest(0.1, coalesce(user_rating, model_rating, (SELECT coalesce(avg(user_rating), 5.0) FROM overlaid))) / 10, 2) / (1 + exp(-(5 + full_play_count - skip_count) / 5.0)) * recency AS score FROM recency)"


@query(f"WITH {_SCORED} SELECT idx, path, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, idx) - 1 AS rank FROM scored")
def recommendation_score(spark, sf_dir):
    s = M.recommendation_score(overlaid(spark, sf_dir)).select("idx", "path", F.round("score", 9).alias("score"))
    return global_rank(s, [Down("score"), "idx"])


@query(f"WITH {_SCORED} SELECT idx, round(score / (SELECT sum(score) FROM scored), 9) AS probability FROM scored")
def selection_probability(spark, sf_dir):
    return M.selection_probability(M.recommendation_score(overlaid(spark, sf_dir))).select("idx", F.round("probability", 9).alias("probability"))


_HIST = "h AS (SELECT CAST(round_even(user_rating, 0) AS INTEGER) AS bin, count(*) AS n FROM rated GROUP BY ALL)"
_RATED = "rated AS (SELECT idx AS id, user_rating FROM library WHERE user_rating IS NOT NULL)"


@query(f"WITH {_RATED}, {_HIST} SELECT bin, n, (SELECT CAST(trunc(median(n)) AS BIGINT) FROM h) AS median_n FROM h")
def rating_histogram(spark, sf_dir):
    return M.rating_histogram(V.library(spark, sf_dir), "user_rating")


_PAIRS = "(SELECT idx // 32 AS batch, user_rating AS y, model_rating AS p FROM library WHERE user_rating IS NOT NULL AND model_rating IS NOT NULL)"


@query(f"""
SELECT 'all' AS kind, round(avg(abs(p - y)), 6) AS mae, round(1 - avg(abs(p - y) / (y + 2)), 6) AS accuracy, round(1 / (1 + avg(abs(p - y) / (y + 1))), 6) AS accuracy_2 FROM {_PAIRS}
UNION ALL SELECT 'batches', round(avg(m), 6), round(avg(1 - a), 6), round(avg(1 / (1 + b)), 6) FROM (SELECT avg(abs(p - y)) AS m, avg(abs(p - y) / (y + 2)) AS a, avg(abs(p - y) / (y + 1)) AS b FROM {_PAIRS} GROUP BY batch)
""")
def rating_metrics(spark, sf_dir):
    rows = V.library(spark, sf_dir).dropna(subset=["user_rating", "model_rating"]).withColumn("batch", F.expr("idx div 32"))
    r = lambda df, kind: df.select(F.lit(kind).alias("kind"), *[F.round(c, 6).alias(c) for c in ("mae", "accuracy", "accuracy_2")])
    return r(M.rating_metrics(rows, "model_rating", "user_rating"), "all").unionByName(r(M.rating_metrics(rows, "model_rating", "user_rating", "batch"), "batches"))


@query("WITH m AS (SELECT avg(label) AS m FROM train_rows WHERE id % 10 <> 0) SELECT round(1 - avg(abs(m - label) / (label + 2)), 9) AS baseline FROM train_rows, m WHERE id % 10 = 0")
def baseline_accuracy(spark, sf_dir):
    rows = V.train_rows(spark, sf_dir).withColumn("split", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    return M.baseline_accuracy(rows).select(F.round("baseline", 9).alias("baseline"))


@query("SELECT epoch, train, test FROM (SELECT event_id AS epoch, round(value / 600, 9) AS train, round(value / 500, 1) AS test FROM events) ORDER BY test DESC, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    h = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("epoch"), F.round(F.col("value") / 600, 9).alias("train"), F.round(F.col("value") / 500, 1).alias("test"))
    return M.best_epoch(h)


@query("""
WITH l AS (SELECT md5(concat_ws(':', vec_id, len(embedding), array_to_string(list_transform(embedding[1:100], lambda x: CAST(CAST(round_even(x * 1000000, 0) AS BIGINT) AS VARCHAR)), ','))) AS h FROM vectors)
SELECT md5(count(*) || ':' || sum(CAST(CAST('0x' || h[1:15] AS BIGINT) AS HUGEINT))) AS version FROM l
""")
def dataset_fingerprint(spark, sf_dir):
    return M.dataset_fingerprint(V.vectors(spark, sf_dir), "vec_id", "embedding")


@query()
def gather_training_pairs(spark, sf_dir):
    """Chunks of descriptions, and of full texts where a file has one."""
    latest = latest_per_key(S.parse_memory(V.memory(spark, sf_dir)), "file_stem", ["day", "rating", "description"])
    full = V.files(spark, sf_dir).filter("idx % 2 = 0").groupBy(F.col("hash").alias("file_stem")).agg(F.min("text").alias("text"))
    embedder = features.HashingEmbedder(16)
    out = M.training_pairs(latest, embedder).withColumn("content", F.lit("description")).unionByName(M.training_pairs(latest, embedder, full).withColumn("content", F.lit("full text")))
    return out.select("content", "file_stem", "chunk_no", "rating", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


_SPLIT = f"split_rows AS (SELECT id, label, CASE WHEN row_number() OVER (ORDER BY {uniform_sql('id', 42)}, id) - 1 < ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM train_rows)"


@query(f"WITH {_SPLIT} SELECT * FROM split_rows")
def train_test_split(spark, sf_dir):
    return M.train_test_split(V.train_rows(spark, sf_dir).select("id", "label"))


@query(f"""
WITH {_SPLIT}, n AS (SELECT CAST(round_even(count(*) FILTER (split = 'test') * 2000.0::DOUBLE / greatest(1, count(*) FILTER (split = 'train') + 2000), 0) AS BIGINT) AS share FROM split_rows),
i AS (SELECT -1 - k AS id FROM (SELECT unnest(range(0, 2000 + (SELECT share FROM n))) AS k))
SELECT id, 0 AS chunk_no, label, split, 64 AS dims FROM split_rows
UNION ALL SELECT id, unnest(range(0, CAST(floor({uniform_sql('(-1 - id)', 7)} * 5) AS BIGINT) + 1)), 0.0, CASE WHEN id < -2000 THEN 'test' ELSE 'train' END, 64 FROM i
""")
def noise_negatives(spark, sf_dir):
    rows = M.train_test_split(V.train_rows(spark, sf_dir))
    return M.with_noise(rows, 64).select("id", "chunk_no", "label", "split", F.size("features").alias("dims"))


@query("""
WITH b AS (SELECT CAST(round_even(label, 0) AS INTEGER) AS bin, count(*) AS n FROM train_rows GROUP BY ALL)
SELECT bin, n, CAST(trunc(m) AS BIGINT) - n AS added FROM b, (SELECT median(n) AS m FROM b) WHERE n < trunc(m)
""")
def oversample_to_median(spark, sf_dir):
    rows = V.train_rows(spark, sf_dir).select("id", "label")
    added = M.oversample_to_median(rows).groupBy("bin").agg(F.count("*").alias("added"))
    return added.join(M.rating_histogram(rows, "label").select("bin", "n"), "bin").select("bin", "n", "added")


@query("""
WITH b AS (SELECT CAST(round_even(label, 0) AS INTEGER) AS bin, count(*) AS n FROM train_rows GROUP BY ALL), w AS (SELECT bin, n, (SELECT sum(n) FROM b)::DOUBLE / ((SELECT count(*) FROM b) * n) AS raw FROM b)
SELECT id, round(raw / (SELECT sum(raw * n) / sum(n) FROM w), 9) AS weight FROM train_rows JOIN w ON bin = CAST(round_even(label, 0) AS INTEGER)
""")
def inverse_frequency_weights(spark, sf_dir):
    return M.inverse_frequency_weights(V.train_rows(spark, sf_dir).select("id", "label")).select("id", F.round("weight", 9).alias("weight"))


@query()
def train_rater(spark, sf_dir):
    """The epochs of one run over single vectors; the weights of the best one are what is kept."""
    _, log = Q.train_best(M.train_test_split(Q.as_sequence(V.train_rows(spark, sf_dir))), epochs=20)
    return log.select("epoch", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"))


def _chunked(spark, sf_dir, files):
    """(idx, sequence): the vectors of a text's chunks, stored: training reads them many times."""
    embedder = features.HashingEmbedder(32)
    chunks = text_chunks(files, "idx", "text", 192, 64)
    vectors = features.embedded(chunks.select(F.struct("idx", "chunk_no").alias("key"), "chunk"), embedder, "key", "chunk")
    return stored(Q.sequences(vectors.select("key.idx", "key.chunk_no", F.col("embedding").alias("features")), "idx"), "chunked")


def _rated_sequences(spark, sf_dir, chunked=None):
    """chunked: the sequences of all files, where they are at hand."""
    rated = stored(V.library(spark, sf_dir).select("idx", F.coalesce("user_rating", "model_rating").alias("label")).dropna(), "labels")
    if chunked is None:
        chunked = _chunked(spark, sf_dir, V.files(spark, sf_dir).select("idx", "text").join(rated, "idx", "left_semi"))
    rows = chunked.join(rated, "idx")
    return M.inverse_frequency_weights(M.train_test_split(rows, "idx"))


@query()
def train_sequence_rater(spark, sf_dir):
    """The history of a rater over the chunks of whole texts, rare ratings weighing more; `best` marks the epoch kept."""
    kept, _, log = Q.train(_rated_sequences(spark, sf_dir), "idx", "weight", epochs=20)
    best = M.best_epoch(log.fillna(0.0, ["test"])).select(F.col("epoch").alias("best_epoch"))
    return log.crossJoin(F.broadcast(best)).select("epoch", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"), (F.col("epoch") == F.col("best_epoch")).alias("best"))  # one row


@query()
def predict_sequence_ratings(spark, sf_dir):
    """Every file's rating by its text's chunks; files without text get 0."""
    files = V.files(spark, sf_dir).select("idx", "text")
    chunked = _chunked(spark, sf_dir, files)
    rater, _ = Q.train_best(_rated_sequences(spark, sf_dir, chunked), key="idx", weight="weight", epochs=12)
    rows = files.select("idx").join(chunked, "idx", "left")
    return rater.predict(rows).select("idx", F.coalesce(F.size("sequence"), F.lit(0)).alias("n_chunks"), F.round("prediction", 6).alias("prediction"))


@query()
def predict_ratings(spark, sf_dir):
    rows = V.train_rows(spark, sf_dir)
    rater = M.train_rater(M.inverse_frequency_weights(rows), weight="weight")
    holes = rows.withColumn("features", F.when(F.col("id") % 9 != 0, F.col("features")))
    return rater.predict(holes).select("id", F.round("prediction", 6).alias("prediction"))
