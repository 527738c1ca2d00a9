"""The views that the operators run on, derived from the given tables: for each a Spark builder and the same in SQL.

Only whole-number arithmetic, md5 and concatenation go into them, so Spark and other engines agree on every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL, REMOTE = "osfs:///mnt/media/", "webdav://host:6001/"
CURRENT = "m_cur"
NOW = "2024-07-01 12:00:00"

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def view(sql: str):
    def add(f):
        BUILDERS[f.__name__] = f
        SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """Puts the views that a statement names in front of it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(SQL[name])
                needed.append(name)

    add(sql)
    ctes = [f"{name} AS ({SQL[name]})" for name in needed]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ", ".join([*ctes, body])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


@view("""
SELECT doc_id AS idx, root || 'text/' || lang || '/' || source || '/doc_' || doc_id || ext AS path, ext,
  CAST(strlen(text) AS BIGINT) AS size, md5(text) AS hash, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime,
  root = 'osfs:///mnt/media/' AS is_local, text
FROM (SELECT *, CASE WHEN source IN ('src18', 'src19') THEN 'webdav://host:6001/' ELSE 'osfs:///mnt/media/' END AS root,
  CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.HTML' WHEN 2 THEN '.pdf' ELSE '.txt' END AS ext FROM documents)
""")
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    root = F.when(F.col("source").isin("src18", "src19"), REMOTE).otherwise(LOCAL)
    kind = F.col("doc_id") % 5
    ext = F.when(kind == 0, ".md").when(kind == 1, ".HTML").when(kind == 2, ".pdf").otherwise(".txt")
    return d.select(
        F.col("doc_id").alias("idx"),
        F.concat(root, F.lit("text/"), "lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
        ext.alias("ext"),
        F.octet_length("text").cast("long").alias("size"),
        F.md5("text").alias("hash"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("mtime"),
        (root == LOCAL).alias("is_local"),
        "text",
    )


@view("""
SELECT idx, path AS file_path, hash,
  CASE WHEN idx % 7 <> 0 THEN CAST(quality * 6 + (1 - toxic) * 2 + idx % 3 AS DOUBLE) END AS user_rating,
  CASE WHEN idx % 7 <> 0 THEN TIMESTAMP '2024-06-01' + to_minutes(idx) END AS user_rating_date,
  CASE WHEN idx % 5 <> 0 THEN CAST((idx * 37) % 101 AS DOUBLE) / 10 END AS model_rating,
  CASE idx % 4 WHEN 0 THEN NULL WHEN 1 THEN 'm_old' ELSE 'm_cur' END AS model_hash
FROM labels JOIN files ON doc_id = idx
""")
def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    rows = table(spark, sf_dir, "labels").join(files(spark, sf_dir), F.col("doc_id") == i)
    rated = i % 7 != 0
    return rows.select(
        "idx",
        F.col("path").alias("file_path"),
        "hash",
        F.when(rated, (F.col("quality") * 6 + (1 - F.col("toxic")) * 2 + i % 3).cast("double")).alias("user_rating"),
        F.when(rated, F.lit("2024-06-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))).alias("user_rating_date"),
        F.when(i % 5 != 0, ((i * 37) % 101).cast("double") / 10).alias("model_rating"),
        F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "m_old").otherwise("m_cur").alias("model_hash"),
    )


@view("""
SELECT idx, CASE WHEN idx % 10 <> 0 THEN path END AS file_path, hash, full_play_count, skip_count, last_played,
  CASE WHEN idx % 3 = 0 THEN CAST(idx % 11 AS DOUBLE) END AS user_rating, CASE WHEN idx % 2 = 0 THEN CAST(idx % 9 AS DOUBLE) END AS model_rating
FROM files JOIN (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS full_play_count, count(*) FILTER (event_type = 'error') AS skip_count,
  max(ts) FILTER (event_type = 'view') AS last_played FROM events GROUP BY user_id) ON user_id = idx
""")
def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, i = F.col("event_type"), F.col("idx")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("full_play_count"), F.count_if(kind == "error").alias("skip_count"), F.max(F.when(kind == "view", F.col("ts"))).alias("last_played"))
    rows = files(spark, sf_dir).join(e, F.col("user_id") == i)
    return rows.select(
        "idx", F.when(i % 10 != 0, F.col("path")).alias("file_path"), "hash", "full_play_count", "skip_count", "last_played",
        F.when(i % 3 == 0, (i % 11).cast("double")).alias("user_rating"), F.when(i % 2 == 0, (i % 9).cast("double")).alias("model_rating"),
    )


@view("""
SELECT idx, replace(replace(path, 'osfs:///mnt/media/', ''), 'webdav://host:6001/', '') AS file_path, hash,
  CASE WHEN idx % 2 = 0 THEN CAST(idx % 10 AS DOUBLE) END AS user_rating, CASE WHEN idx % 2 = 0 THEN TIMESTAMP '2023-05-01' + to_minutes(idx) END AS user_rating_date,
  CASE WHEN idx % 3 = 0 THEN CAST(idx % 8 AS DOUBLE) END AS model_rating, CASE WHEN idx % 3 = 0 THEN 'm_legacy' END AS model_hash
FROM files JOIN (SELECT DISTINCT user_id FROM events) ON user_id = idx
""")
def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    rows = files(spark, sf_dir).join(table(spark, sf_dir, "events").select("user_id").distinct(), F.col("user_id") == i)
    return rows.select(
        "idx", F.replace(F.replace(F.col("path"), F.lit(LOCAL), F.lit("")), F.lit(REMOTE), F.lit("")).alias("file_path"), "hash",
        F.when(i % 2 == 0, (i % 10).cast("double")).alias("user_rating"), F.when(i % 2 == 0, F.lit("2023-05-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))).alias("user_rating_date"),
        F.when(i % 3 == 0, (i % 8).cast("double")).alias("model_rating"), F.when(i % 3 == 0, "m_legacy").alias("model_hash"),
    )


@view("""
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label, vec_id % 97 AS size FROM embeddings
UNION ALL SELECT -1, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.0::DOUBLE), 0, 96 FROM embeddings WHERE vec_id = 0
""")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = e.withColumn("size", F.col("vec_id") % 97)
    blank = e.filter("vec_id = 0").select(F.lit(-1).cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.lit(0.0)).alias("embedding"), F.lit(0).alias("label"), F.lit(96).cast("long").alias("size"))
    return rows.unionByName(blank)


@view("SELECT embedding AS q FROM vectors WHERE vec_id = 0")
def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("vec_id = 0").select(F.col("embedding").alias("q"))


@view("""
SELECT vec_id // 5 AS file_id, vec_id % 5 AS chunk_no, embedding FROM vectors WHERE vec_id >= 0
UNION ALL SELECT 3, 5, embedding FROM vectors WHERE vec_id = -1
""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    own = v.filter("vec_id >= 0").select(F.expr("vec_id div 5").alias("file_id"), (F.col("vec_id") % 5).alias("chunk_no"), "embedding")
    return own.unionByName(v.filter("vec_id = -1").select(F.lit(3).cast("long").alias("file_id"), F.lit(5).cast("long").alias("chunk_no"), "embedding"))


@view("SELECT label AS tag_no, 'tag_' || label AS tag, arg_min(embedding, vec_id) AS embedding FROM vectors WHERE vec_id >= 0 GROUP BY label")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).filter("vec_id >= 0").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return v.select(F.col("label").alias("tag_no"), F.concat(F.lit("tag_"), F.col("label").cast("string")).alias("tag"), "embedding")


@view("SELECT path || '.meta' AS path, b.text FROM benchmark b JOIN files ON item_id = idx")
def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "note")
    return files(spark, sf_dir).join(b, F.col("item_id") == F.col("idx")).select(F.concat("path", F.lit(".meta")).alias("path"), F.col("note").alias("text"))


@view("""
SELECT day, hash AS file_stem, CASE WHEN idx % 11 = 0 THEN 'Rating: ?' ELSE 'Rating: ' || CAST(coalesce(user_rating, 5) + CASE day WHEN '2024-06-02' THEN 1 ELSE 0 END AS VARCHAR) END
  || chr(10) || 'File Path: ' || file_path || chr(10) || chr(10) || text AS value
FROM library JOIN (SELECT idx AS i, text FROM files) ON i = idx CROSS JOIN (SELECT unnest(['2024-06-01', '2024-06-02']) AS day) WHERE day = '2024-06-01' OR idx % 4 = 0
""")
def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = library(spark, sf_dir).join(files(spark, sf_dir).select(F.col("idx").alias("i"), "text"), F.col("i") == F.col("idx"))
    days = F.when(F.col("idx") % 4 == 0, F.array(F.lit("2024-06-01"), F.lit("2024-06-02"))).otherwise(F.array(F.lit("2024-06-01")))
    rows = rows.withColumn("day", F.explode(days))
    rating = (F.coalesce("user_rating", F.lit(5.0)) + F.when(F.col("day") == "2024-06-02", 1).otherwise(0)).cast("string")
    first = F.when(F.col("idx") % 11 == 0, F.lit("Rating: ?")).otherwise(F.concat(F.lit("Rating: "), rating))
    return rows.select("day", F.col("hash").alias("file_stem"), F.concat(first, F.lit("\nFile Path: "), "file_path", F.lit("\n\n"), "text").alias("value"))


@view("SELECT user_id AS item, event_id, ts, event_type AS kind, least(value / 49.1, 10) AS rating FROM events")
def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_id", "ts", F.col("event_type").alias("kind"), F.least(F.col("value") / 49.1, F.lit(10.0)).alias("rating"))


@view("SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x, value AS y FROM events")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import global_rank

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "event_id", F.col("value").alias("y"))
    ranked = global_rank(rows, ["series", "ts", "event_id"])
    first = ranked.groupBy(F.col("series").alias("s")).agg(F.min("rank").alias("first"))  # a few event types
    return ranked.join(first, F.col("series").eqNullSafe(F.col("s"))).select("series", (F.col("rank") - F.col("first")).alias("x"), "y")


@view("SELECT l.idx AS id, v.embedding AS features, coalesce(user_rating, model_rating, 5) AS label FROM library l JOIN vectors v ON vec_id = l.idx")
def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("features"))
    return library(spark, sf_dir).join(v, F.col("vec_id") == F.col("idx")).select(F.col("idx").alias("id"), "features", F.coalesce("user_rating", "model_rating", F.lit(5.0)).alias("label"))
