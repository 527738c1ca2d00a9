"""Recommendation, rating statistics, and the preference model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..sources.shared import stored
from .features import embedded
from .ranking import Down, global_rank
from .search import text_chunks

CLASSES = 11


def mean_rating(rows: DataFrame) -> DataFrame:
    """One row: the mean of the given user ratings, 5 if there is none."""
    return rows.agg(F.coalesce(F.avg("user_rating"), F.lit(5.0)).alias("mean_rating"))


def recency_rank(rows: DataFrame) -> DataFrame:
    """Adds `recency`: place by last play, latest first and never played last, over count - 1."""
    at = F.coalesce(F.col("last_played").cast("timestamp").cast("double"), F.lit(0.0))
    placed = global_rank(rows.withColumn("__at", at), [Down("__at"), "idx"], "__place").drop("__at")
    n = placed.agg(F.count("*").alias("__n"))
    return placed.crossJoin(F.broadcast(n)).withColumn("recency", F.when(F.col("__n") > 1, F.col("__place") / (F.col("__n") - 1)).otherwise(F.lit(0.0))).drop("__place", "__n")


def recommendation_score(rows: DataFrame) -> DataFrame:
    """rows: idx, path, ratings, play counts, last_played. Adds `score`: rating times skips times recency."""
    rows = stored(rows, "rated")  # joined once, then ranked and averaged
    placed = recency_rank(rows).crossJoin(F.broadcast(mean_rating(rows)))  # one row
    rating = F.greatest(F.lit(0.1), F.coalesce("user_rating", "model_rating", "mean_rating"))
    skips = 1 / (1 + F.exp(-(5 + F.col("full_play_count") - F.col("skip_count")) / 5))
    raw = F.pow(rating / 10, F.lit(2)) * skips * F.col("recency")
    score = F.when(F.isnan(raw) | (raw == float("-inf")), 0.0).when(raw == float("inf"), 1.0).otherwise(raw)
    return placed.withColumn("score", score).drop("mean_rating")


def selection_probability(scored: DataFrame) -> DataFrame:
    total = scored.agg(F.sum("score").alias("__total"))
    return scored.crossJoin(F.broadcast(total)).withColumn("probability", F.col("score") / F.col("__total")).drop("__total")  # one row


def rating_bin(rating: Column) -> Column:
    """Rounded half to even."""
    return F.bround(rating, 0).cast("int")


def rating_histogram(rows: DataFrame, rating: str) -> DataFrame:
    """(bin, n, median_n): the count per bin, and the median of the counts cut to a whole number."""
    h = rows.filter(F.col(rating).isNotNull()).groupBy(rating_bin(F.col(rating)).alias("bin")).agg(F.count("*").alias("n"))
    return h.crossJoin(F.broadcast(h.agg(F.percentile("n", 0.5).cast("long").alias("median_n"))))  # one row over at most 11


def rating_metrics(rows: DataFrame, prediction: str, label: str, batch: str | None = None) -> DataFrame:
    """Mean error and two accuracies; with a batch column, the means of the batches' means."""
    p, y = F.col(prediction), F.col(label)
    means = [F.avg(F.abs(p - y)).alias("mae"), F.avg(F.abs(p - y) / (y + 2)).alias("e2"), F.avg(F.abs(p - y) / (y + 1)).alias("e1")]
    if batch is None:
        return rows.agg(*means).select("mae", (1 - F.col("e2")).alias("accuracy"), (1 / (1 + F.col("e1"))).alias("accuracy_2"))
    b = rows.groupBy(batch).agg(*means)
    return b.agg(F.avg("mae").alias("mae"), F.avg(1 - F.col("e2")).alias("accuracy"), F.avg(1 / (1 + F.col("e1"))).alias("accuracy_2"))


def baseline_accuracy(rows: DataFrame, label: str = "label", split: str = "split", bias: float = 2.0) -> DataFrame:
    """Accuracy on the test rows of always predicting the mean of the training rows."""
    mean = rows.filter(F.col(split) == "train").agg(F.avg(label).alias("m"))
    return rows.filter(F.col(split) == "test").crossJoin(F.broadcast(mean)).agg((1 - F.avg(F.abs(F.col("m") - F.col(label)) / (F.col(label) + bias))).alias("baseline"))  # one row


def best_epoch(history: DataFrame) -> DataFrame:
    """history: (epoch, train, test). The earliest epoch of the greatest test accuracy."""
    return history.agg(F.max_by(F.struct("epoch", "train", "test"), F.struct(F.col("test"), (-F.col("epoch")).alias("e"))).alias("b")).select("b.*")


def dataset_fingerprint(rows: DataFrame, key: str, values: str, most: int = 100) -> DataFrame:
    """One version id of a set of named vectors. Rows are hashed where they lie; only the hashes meet, by a sum."""
    line = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.size(values).cast("string"), F.array_join(F.transform(F.slice(values, 1, most), lambda x: F.bround(x * 1e6, 0).cast("long").cast("string")), ",")))
    part = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string"))).alias("version"))


def train_test_split(rows: DataFrame, key: str = "id", share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: exactly ceil(share * n) test rows, chosen by hash, so independent of partitions."""
    placed = global_rank(rows.withColumn("__u", uniform(F.col(key), seed)), ["__u", key], "__place")
    n = rows.agg(F.ceil(F.count("*") * share).alias("__cut"))
    return placed.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("__place") < F.col("__cut"), "test").otherwise("train")).drop("__u", "__place", "__cut")


def noise_rows(like: DataFrame, n: int, dims: int, seed: int = 7, chunks: int = 5) -> DataFrame:
    """(id, chunk_no, features, label): n random samples of label 0 with 1 to `chunks` vectors each, ids below zero."""
    many = (F.floor(uniform(F.col("id"), seed) * chunks) + 1).cast("int")
    rows = like.sparkSession.range(n).select((-1 - F.col("id")).alias("id"), F.posexplode(F.sequence(F.lit(1), many)).alias("chunk_no", "k"))
    v = F.array(*[F.randn(seed + k) for k in range(dims)])
    return rows.select("id", "chunk_no", v.alias("features"), F.lit(0.0).alias("label"))


def with_noise(rows: DataFrame, dims: int, n: int = 2000, seed: int = 7) -> DataFrame:
    """rows: (id, features, label, split). n noise samples join the training rows, and their share the test rows."""
    size = rows.groupBy("split").count().collect()  # two rows
    counts = {r["split"]: r["count"] for r in size}
    share = round(counts.get("test", 0) * n / max(1, counts.get("train", 0) + n))
    noise = noise_rows(rows, n + share, dims, seed).withColumn("split", F.when(F.col("id") < -n, "test").otherwise("train"))
    own = rows.select("id", F.lit(0).alias("chunk_no"), "features", "label", "split")
    return own.unionByName(noise)


def training_pairs(records: DataFrame, embedder, full: DataFrame | None = None, key: str = "file_stem", size: int = 192, overlap: int = 64, least: int = 10) -> DataFrame:
    """(key, chunk_no, rating, features), a row for every chunk of an item's text: its description of `least` characters
    or more, or with `full` (key, text) the whole text where there is one. records: (key, rating, description), one an item."""
    texts = records.withColumn("text", F.when(F.length("description") >= least, F.col("description")))
    if full is not None:
        texts = texts.drop("text").join(full.select(key, F.col("text")), key, "left").withColumn("text", F.coalesce("text", F.when(F.length("description") >= least, F.col("description"))))
    chunks = text_chunks(texts.filter("text IS NOT NULL"), key, "text", size, overlap)
    chunks = chunks.select(F.concat_ws("\u0001", key, "chunk_no").alias("part"), key, "chunk_no", "chunk")
    vectors = embedded(chunks, embedder, "part", "chunk").select("part", F.col("embedding").alias("features"))
    return chunks.select("part", key, "chunk_no").join(vectors, "part").join(records.select(key, "rating"), key).select(key, "chunk_no", "rating", "features")


def oversample_to_median(rows: DataFrame, label: str = "label", key: str = "id", seed: int = 123) -> DataFrame:
    """Rows to add: each bin below the median count gets as many repeats as it lacks, drawn with replacement."""
    binned = rows.withColumn("bin", rating_bin(F.col(label)))
    need = rating_histogram(rows, label).withColumn("need", F.col("median_n") - F.col("n")).filter("need > 0")
    draws = need.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need")))).select("bin", "k", (F.floor(uniform(F.concat_ws(":", "bin", "k"), seed) * F.col("n")) + 1).alias("nth"))
    # Numbers within a bin, from those within (bin, bucket) and the counts of the buckets before: no bin is one task.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = binned.join(F.broadcast(need.select("bin")), "bin", "left_semi").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)))  # bins: at most 11
    before = W.partitionBy("bin").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("bin", "bucket").agg(F.count("*").alias("c")).select("bin", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"))  # eleven rows a bucket at most
    placed = dealt.withColumn("nth", F.row_number().over(W.partitionBy("bin", "bucket").orderBy(key))).join(F.broadcast(offsets), ["bin", "bucket"]).withColumn("nth", F.col("nth") + F.col("from")).drop("bucket", "from")
    return placed.join(draws, ["bin", "nth"]).select(*rows.columns, "bin")


def inverse_frequency_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds `weight`: rare bins weigh more, the mean is 1."""
    h = rows.groupBy(rating_bin(F.col(label)).alias("bin")).agg(F.count("*").alias("n"))
    w = h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("t"), F.count("*").alias("b")))).withColumn("raw", F.col("t") / (F.col("b") * F.col("n")))  # one row
    mean = w.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("mean"))
    w = w.crossJoin(F.broadcast(mean)).select("bin", (F.col("raw") / F.col("mean")).alias("weight"))  # one row
    return rows.withColumn("bin", rating_bin(F.col(label))).join(F.broadcast(w), "bin")  # at most 11 rows


class Rater:
    """A classifier over the eleven ratings; its prediction is the expected rating."""

    def __init__(self, model, features: str = "features"):
        self.model, self.features = model, features

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction` in 0..10; rows without features get 0."""
        ready = rows.withColumn("__has", F.col(self.features).isNotNull()).withColumn("__v", array_to_vector(F.coalesce(F.col(self.features), F.array_repeat(F.lit(0.0), self.model.numFeatures))))
        out = self.model.transform(ready.withColumnRenamed("__v", "__features"))
        p = vector_to_array("__probability")
        expected = F.aggregate(F.transform(p, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
        return out.withColumn("prediction", F.when(F.col("__has"), expected).otherwise(0.0)).select(*rows.columns, "prediction")


def train_rater(rows: DataFrame, weight: str | None = None, layers: tuple[int, ...] = (16,), iterations: int = 20, seed: int = 1) -> Rater:
    """rows: (features array, label 0..10). A perceptron, or with weights a logistic regression."""
    dims = rows.select(F.size("features").alias("n")).first()[0]
    data = rows.select(array_to_vector("features").alias("__features"), rating_bin(F.col("label")).cast("double").alias("__label"), *([weight] if weight else []))
    names = {"featuresCol": "__features", "labelCol": "__label", "probabilityCol": "__probability", "rawPredictionCol": "__raw", "predictionCol": "__class"}
    if weight:
        return Rater(LogisticRegression(family="multinomial", maxIter=iterations, regParam=0.01, weightCol=weight, **names).fit(data))
    return Rater(MultilayerPerceptronClassifier(layers=[dims, *layers, CLASSES], maxIter=iterations, seed=seed, **names).fit(data))


def train_best_rater(rows: DataFrame, grid: tuple[int, ...] = (10, 30)) -> tuple[Rater, DataFrame]:
    """rows with `split`: candidates by number of iterations; the best by test accuracy, and the history."""
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    best, top, log = None, -1.0, []
    for n in grid:
        rater = train_rater(train, iterations=n)
        scores = [rating_metrics(rater.predict(x), "prediction", "label").first()["accuracy_2"] for x in (train, test)]
        log.append((n, scores[0], scores[1]))
        if scores[1] is not None and scores[1] > top:
            best, top = rater, scores[1]
        best = best or rater
    return best, rows.sparkSession.createDataFrame(log, "epoch int, train double, test double")
