"""Queries: joins, set operations and library maintenance."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import uniform, uniform_sql
from ..operators import library as L, ranking as R
from ..sources import files as S
from ..sources import views as V
from ..sources.keyed import KeyedTable
from ..sources.shared import shared_path
from .registry import query

EPOCH = "CAST(floor(epoch({0})) AS DOUBLE)"


def _seconds(c: str):
    return F.unix_timestamp(c).cast("double")


@query("SELECT f.idx, coalesce(user_rating, model_rating) AS score FROM files f LEFT JOIN library ON file_path = path")
def effective_rating(spark, sf_dir):
    return L.effective_rating(V.files(spark, sf_dir).select("idx", "path"), V.library(spark, sf_dir)).select("idx", "score")


_RESOLVED = """
resolved AS (SELECT f.idx, f.path, p.user_rating, p.model_rating, p.full_play_count, p.skip_count, p.last_played, 'path' AS found_by FROM files f JOIN plays p ON p.file_path = f.path
  UNION ALL SELECT f.idx, f.path, h.user_rating, h.model_rating, h.full_play_count, h.skip_count, h.last_played, 'hash' FROM files f JOIN (SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY hash ORDER BY idx) = 1) h ON h.hash = f.hash
  WHERE f.path NOT IN (SELECT file_path FROM plays WHERE file_path IS NOT NULL))"""


def _resolved(spark, sf_dir):
    return L.resolve_play_record(V.files(spark, sf_dir).select("idx", "path", "hash"), V.plays(spark, sf_dir))


@query(f"WITH {_RESOLVED} SELECT idx, user_rating, model_rating, full_play_count, skip_count, {EPOCH.format('last_played')} AS last_played, found_by FROM resolved")
def resolve_play_record(spark, sf_dir):
    return _resolved(spark, sf_dir).select("idx", "user_rating", "model_rating", "full_play_count", "skip_count", _seconds("last_played").alias("last_played"), "found_by")


_OVERLAID = f"""{_RESOLVED},
overlaid AS (SELECT f.idx, f.path, CASE WHEN l.idx IS NOT NULL THEN l.user_rating ELSE r.user_rating END AS user_rating, CASE WHEN l.idx IS NOT NULL THEN l.model_rating ELSE r.model_rating END AS model_rating,
  coalesce(full_play_count, 0) AS full_play_count, coalesce(skip_count, 0) AS skip_count, last_played FROM files f LEFT JOIN resolved r USING (path) LEFT JOIN library l ON l.file_path = f.path)"""


def overlaid(spark, sf_dir):
    return L.overlay_ratings(V.files(spark, sf_dir).select("idx", "path"), _resolved(spark, sf_dir), V.library(spark, sf_dir))


@query(f"WITH {_OVERLAID} SELECT idx, user_rating, model_rating, full_play_count, skip_count, {EPOCH.format('last_played')} AS last_played FROM overlaid")
def overlay_ratings(spark, sf_dir):
    return overlaid(spark, sf_dir).select("idx", "user_rating", "model_rating", "full_play_count", "skip_count", _seconds("last_played").alias("last_played"))


@query(f"""
WITH {_RESOLVED}, page AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) - 1 AS rank FROM (SELECT f.idx, f.path, f.size, coalesce(user_rating, model_rating) AS score FROM files f LEFT JOIN library ON file_path = path) WHERE score IS NOT NULL)
SELECT rank, page.path, l.user_rating, l.model_rating, coalesce(l.model_rating IS NOT NULL AND l.model_hash IS DISTINCT FROM 'm_cur', false) AS stale, coalesce(full_play_count, 0) AS full_play_count, coalesce(skip_count, 0) AS skip_count,
  CASE WHEN last_played IS NULL THEN 'Never' ELSE 'Played' END AS played, s.path IS NOT NULL AS has_meta
FROM page LEFT JOIN library l ON l.file_path = page.path LEFT JOIN resolved r ON r.path = page.path LEFT JOIN sidecars s ON s.path = page.path || '.meta' WHERE rank < 100
""")
def enrich_page(spark, sf_dir):
    """The page is cut first; its hundred rows are then looked up in the large tables."""
    library = V.library(spark, sf_dir)
    files = V.files(spark, sf_dir).select("idx", "path", "size", "hash")
    rows = R.page_by_score(L.effective_rating(files, library))
    info = library.select(F.col("file_path").alias("path"), "user_rating", "model_rating", L.rating_is_stale(F.col("model_rating"), F.col("model_hash"), V.CURRENT).alias("s"))
    played = L.resolve_play_record(rows.select("idx", "path", "hash"), V.plays(spark, sf_dir)).drop("idx", "user_rating", "model_rating")
    side = V.sidecars(spark, sf_dir).select(F.col("path").alias("meta"), F.lit(True).alias("has_meta"))
    rows = rows.join(info, "path", "left").join(played, "path", "left").join(side, F.concat("path", F.lit(".meta")) == F.col("meta"), "left")
    return rows.select("rank", "path", "user_rating", "model_rating", F.coalesce("s", F.lit(False)).alias("stale"), F.coalesce("full_play_count", F.lit(0)).alias("full_play_count"), F.coalesce("skip_count", F.lit(0)).alias("skip_count"), F.when(F.col("last_played").isNull(), "Never").otherwise("Played").alias("played"), F.coalesce("has_meta", F.lit(False)).alias("has_meta"))


@query("SELECT f.idx, path, coalesce(model_rating IS NOT NULL AND model_hash IS NOT NULL, false) AS stale FROM files f LEFT JOIN library l ON file_path = path WHERE NOT coalesce(model_rating IS NOT NULL AND model_hash = 'm_cur', false)")
def unrated_files(spark, sf_dir):
    return L.unrated_files(V.files(spark, sf_dir), V.library(spark, sf_dir), V.CURRENT)


@query("SELECT DISTINCT path FROM files EXCEPT SELECT file_path FROM library WHERE user_rating IS NOT NULL EXCEPT SELECT file_path FROM library WHERE model_hash = 'm_old'")
def new_files(spark, sf_dir):
    lib = V.library(spark, sf_dir).withColumnRenamed("file_path", "path")
    return L.new_files(V.files(spark, sf_dir), lib.filter("user_rating IS NOT NULL"), lib.filter("model_hash = 'm_old'"))


@query("""
WITH t AS (SELECT idx AS id, hash, file_path, user_rating FROM library), i AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN hash ELSE '' END AS hash, file_path, user_rating FROM plays),
hits AS (SELECT id, i.idx, i.user_rating FROM t JOIN i ON i.hash = t.hash AND i.hash <> '' UNION ALL SELECT id, i.idx, i.user_rating FROM t JOIN i ON i.file_path = t.file_path),
won AS (SELECT id, user_rating AS new FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx DESC) = 1)
SELECT t.id, hash, file_path, CASE WHEN won.id IS NOT NULL THEN new ELSE user_rating END AS user_rating, CASE WHEN won.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM t LEFT JOIN won USING (id)
UNION ALL SELECT idx, hash, file_path, user_rating, 'inserted' FROM i WHERE idx NOT IN (SELECT idx FROM hits)
""")
def upsert_by_hash_or_path(spark, sf_dir):
    target = V.library(spark, sf_dir).select(F.col("idx").alias("id"), "hash", "file_path", "user_rating")
    incoming = V.plays(spark, sf_dir).select("idx", F.when(F.col("idx") % 2 == 0, F.col("hash")).otherwise("").alias("hash"), "file_path", "user_rating")
    return L.upsert_by_hash_or_path(target, incoming, ["user_rating"])


@query(f"""
WITH o AS (SELECT CASE WHEN contains(file_path, '://') THEN file_path ELSE 'osfs:///mnt/media/' || file_path END AS file_path, hash, user_rating, user_rating_date, model_rating, model_hash FROM legacy)
SELECT file_path, coalesce(l.hash, o.hash) AS hash, coalesce(l.user_rating, o.user_rating) AS user_rating, {EPOCH.format('CASE WHEN l.user_rating IS NOT NULL THEN l.user_rating_date ELSE o.user_rating_date END')} AS rated_at,
  coalesce(l.model_rating, o.model_rating) AS model_rating, CASE WHEN l.model_rating IS NOT NULL THEN l.model_hash ELSE o.model_hash END AS model_hash FROM library l FULL JOIN o USING (file_path)
""")
def merge_fill_missing(spark, sf_dir):
    m = L.merge_fill_missing(V.library(spark, sf_dir), V.legacy(spark, sf_dir), V.LOCAL)
    return m.select("file_path", "hash", "user_rating", _seconds("user_rating_date").alias("rated_at"), "model_rating", "model_hash")


@query("SELECT hash, file_path AS old_path, new_path FROM library JOIN (SELECT hash, arg_max(path, idx) AS new_path FROM files GROUP BY hash) USING (hash) WHERE file_path <> new_path")
def sync_paths_by_hash(spark, sf_dir):
    return L.sync_paths_by_hash(V.library(spark, sf_dir), V.files(spark, sf_dir))


@query("SELECT idx, path, size FROM files WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, size + CASE WHEN idx % 9 = 0 THEN 1 ELSE 0 END AS size, mtime FROM files WHERE is_local) g WHERE g.path = files.path AND g.size = files.size AND g.mtime = files.mtime)")
def missing_features(spark, sf_dir):
    files = V.files(spark, sf_dir).select("idx", "path", "size", "mtime", "is_local")
    known = files.filter("is_local").select("path", (F.col("size") + F.when(F.col("idx") % 9 == 0, 1).otherwise(0)).alias("size"), "mtime")
    return L.missing_features(files, known, ["path", "size", "mtime"]).select("idx", "path", "size")


@query("SELECT hash, file_path, user_rating, strftime(coalesce(user_rating_date, TIMESTAMP '2024-07-01'), '%Y-%m-%d') AS day FROM library WHERE user_rating IS NOT NULL AND hash NOT IN (SELECT file_stem FROM memory WHERE day = '2024-06-02')")
def memory_backfill(spark, sf_dir):
    return L.memory_backfill(V.library(spark, sf_dir), V.memory(spark, sf_dir).filter("day = '2024-06-02'"), V.NOW)


_WINDOWS = """
span AS (SELECT user_id, min(epoch(ts)) AS t0, max(epoch(ts)) - min(epoch(ts)) AS total FROM events GROUP BY user_id),
w AS (SELECT user_id, k AS window_no, t0 + lo + k * (hi - lo) / 3 AS s, t0 + least(lo + k * (hi - lo) / 3 + 86400, total) AS e FROM (SELECT *, greatest(lo, total - 86400 - lo) AS hi FROM (SELECT *, least(43200.0, total * 0.05) AS lo FROM span)), (SELECT unnest([0, 1, 2, 3]) AS k))
"""


@query(f"WITH {_WINDOWS} SELECT w.user_id, window_no, count(*) AS n, round(sum(value), 6) AS total FROM w JOIN events v ON v.user_id = w.user_id AND epoch(ts) >= s AND epoch(ts) < e GROUP BY w.user_id, window_no")
def sample_windows_join(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("user_id", "ts", "value")
    w = L.sample_windows(e, "user_id", "ts", 4, 86400.0)
    return L.in_windows(e, w, "user_id", "ts", 86400.0).groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT idx, path, root FROM (SELECT idx, path, 'a' AS root FROM files WHERE is_local UNION ALL SELECT idx, path, 'b' FROM files WHERE NOT is_local UNION ALL SELECT idx, path, 'c' FROM files WHERE NOT is_local)")
def union_roots(spark, sf_dir):
    f = V.files(spark, sf_dir).select("idx", "path", "is_local")
    part = lambda p, r: f.filter(p).select("idx", "path", F.lit(r).alias("root"))
    return S.union_roots(part("is_local", "a"), part("NOT is_local", "b"), part("NOT is_local", "c"))


_FORMATS = "('.txt', '.md', '.htm', '.html')"
_FOLDERS = f"""
folders AS (SELECT array_to_string(s[1:d], '/') AS folder, array_to_string(s[1:d - 1], '/') AS parent, d AS depth, count(*) FILTER (ok AND d = len(s) - 1) AS num_files, count(*) FILTER (ok) AS total_files
  FROM (SELECT s, ok, unnest(range(1, len(s))) AS d FROM (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS s, lower(ext) IN {_FORMATS} AS ok FROM files)) GROUP BY ALL)"""


def _folders(spark, sf_dir):
    return L.folder_counts(V.files(spark, sf_dir).select("path", "ext"), L.FORMATS["text"])


@query(f"WITH {_FOLDERS} SELECT folder, parent, CAST(depth AS INTEGER) AS depth, num_files, total_files FROM folders")
def folder_counts(spark, sf_dir):
    return _folders(spark, sf_dir)


@query(f"WITH {_FOLDERS} SELECT folder, num_files, total_files FROM folders f WHERE starts_with('osfs:/mnt/media/text/en/', folder || '/') OR EXISTS (SELECT 1 FROM folders p WHERE p.folder = f.parent AND starts_with('osfs:/mnt/media/text/en/', p.folder || '/'))")
def folder_children(spark, sf_dir):
    return L.folder_children(_folders(spark, sf_dir), "osfs:/mnt/media/text/en").select("folder", "num_files", "total_files")


@query("SELECT hash, min(idx) AS idx, arg_min(path, idx) AS path FROM files GROUP BY hash")
def dedupe_first_by_hash(spark, sf_dir):
    return L.dedupe_first(V.files(spark, sf_dir).select("hash", "idx", "path"), "hash", "idx")


@query("SELECT file_stem, max(day) AS day, count(*) > 0 AS there FROM memory GROUP BY file_stem")
def latest_per_key(spark, sf_dir):
    m = V.memory(spark, sf_dir).select("file_stem", "day", "value")
    return L.latest_per_key(m, "file_stem", ["day", "value"]).select("file_stem", "day", F.col("value").isNotNull().alias("there"))


@query("""
WITH p AS (SELECT path AS file_path, hash AS p_hash, CAST(idx % 10 AS DOUBLE) AS prediction FROM files WHERE idx % 3 <> 1)
SELECT file_path, coalesce(hash, p_hash) AS hash, user_rating, CASE WHEN prediction IS NOT NULL THEN prediction ELSE model_rating END AS model_rating, CASE WHEN prediction IS NOT NULL THEN 'm_new' ELSE model_hash END AS model_hash FROM library FULL JOIN p USING (file_path)
""")
def write_back_ratings(spark, sf_dir):
    predicted = V.files(spark, sf_dir).filter("idx % 3 <> 1").select("path", "hash", (F.col("idx") % 10).cast("double").alias("prediction"))
    return L.write_back_ratings(V.library(spark, sf_dir), predicted, "m_new")


def _rated(spark, sf_dir):
    e = V.item_events(spark, sf_dir).filter("kind = 'click'")
    return e.join(V.files(spark, sf_dir).select("idx", F.col("path").alias("file_path"), "hash"), F.col("item") == F.col("idx")).select("file_path", "hash", "ts", F.round("rating", 6).alias("value"))


_RATE = f"""
WITH r AS (SELECT path AS file_path, hash AS n_hash, ts, round(rating, 6) AS value FROM item_events JOIN files ON item = idx WHERE kind = 'click' QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, value DESC) = 1)
SELECT file_path, CASE WHEN value IS NOT NULL THEN n_hash ELSE hash END AS hash, CASE WHEN value IS NOT NULL THEN value ELSE user_rating END AS user_rating, {EPOCH.format('CASE WHEN value IS NOT NULL THEN ts ELSE user_rating_date END')} AS rated_at, model_rating FROM library FULL JOIN r USING (file_path)
"""


@query(_RATE)
def rate_file(spark, sf_dir):
    return L.rate_files(V.library(spark, sf_dir), _rated(spark, sf_dir)).select("file_path", "hash", "user_rating", _seconds("user_rating_date").alias("rated_at"), "model_rating")


@query(_RATE)
def rate_into_buckets(spark, sf_dir):
    """The same ratings as an upsert into a bucketed table: touched buckets alone are rewritten, the repeated batch changes nothing."""
    library = V.library(spark, sf_dir).select("file_path", "hash", "user_rating", "user_rating_date", "model_rating")
    table = KeyedTable(spark, shared_path(spark, "library"), library.schema, ["file_path"])
    table.upsert(library, "load")
    for _ in range(2):
        table.upsert(_rated(spark, sf_dir), "ratings", L.rate_files, ["ts", "value"])
    return table.read().select("file_path", "hash", "user_rating", _seconds("user_rating_date").alias("rated_at"), "model_rating")


# Ranking ------------------------------------------------------------------------------------------------------------

_SCORES = "(SELECT f.idx, path, size, coalesce(user_rating, model_rating) AS score FROM files f LEFT JOIN library ON file_path = path)"


def _scores(spark, sf_dir):
    return L.effective_rating(V.files(spark, sf_dir).select("idx", "path", "size"), V.library(spark, sf_dir))


@query(f"SELECT idx, score, row_number() OVER (ORDER BY score DESC, idx) - 1 AS rank, row_number() OVER (ORDER BY score, idx DESC) - 1 AS reverse_rank FROM {_SCORES} WHERE score IS NOT NULL")
def rank_by_score(spark, sf_dir):
    s = _scores(spark, sf_dir)
    back = R.rank_by_score(s, "least-relevant").select("idx", F.col("rank").alias("reverse_rank"))
    return R.rank_by_score(s).join(back, "idx").select("idx", "score", "rank", "reverse_rank")


@query(f"SELECT idx, score, row_number() OVER (ORDER BY ln(greatest(score, 1e-9)) / 0.5 - ln(-ln({uniform_sql('path', 7)})) DESC, idx) - 1 AS rank FROM {_SCORES} WHERE score IS NOT NULL")
def temperature_shuffle(spark, sf_dir):
    return R.temperature_shuffle(_scores(spark, sf_dir), 0.5, seed=7).select("idx", "score", "rank")


@query(f"SELECT idx, {uniform_sql('path', 7)} AS score FROM files")
def random_order(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", uniform(F.col("path"), 7).alias("score"))


@query(f"SELECT rank, idx, path, total FROM (SELECT *, row_number() OVER (ORDER BY score DESC, idx) - 1 AS rank, count(*) OVER () AS total FROM {_SCORES} WHERE score IS NOT NULL) WHERE rank >= 50 AND rank < 150")
def page(spark, sf_dir):
    scored = _scores(spark, sf_dir)
    return R.page_by_score(scored, 50, 100).crossJoin(F.broadcast(R.drop_unscored(scored).agg(F.count("*").alias("total")))).select("rank", "idx", "path", "total")  # one row


_RES = "CASE idx % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN idx || 'x0' ELSE idx || 'x' || (idx % 7 + 1) END"


@query(f"""
SELECT idx, CAST(size AS DOUBLE) AS by_size, CASE WHEN idx % 5 IN (0, 1, 2) THEN 0.0 ELSE CAST(idx * (idx % 7 + 1) AS DOUBLE) END AS by_pixels, CASE WHEN idx % 5 IN (0, 1, 2) THEN 0.0 ELSE round(CAST(idx AS DOUBLE) / (idx % 7 + 1), 9) END AS by_proportion, coalesce(TRY_CAST(CASE WHEN idx % 4 = 0 THEN 'x' ELSE CAST(idx AS VARCHAR) END AS DOUBLE), 0) AS by_length
FROM (SELECT *, {_RES} AS resolution FROM files)
""")
def keyword_sort(spark, sf_dir):
    from ..functions.numbers import number
    from ..operators import search

    i = F.col("idx")
    s = i.cast("string")
    res = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, "bad").when(i % 5 == 2, F.concat(s, F.lit("x0"))).otherwise(F.concat(s, F.lit("x"), (i % 7 + 1).cast("string")))
    length = number(F.when(i % 4 == 0, "x").otherwise(s))
    return V.files(spark, sf_dir).select("idx", F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("by_size"), search.pixels(res).alias("by_pixels"), F.round(search.proportion(res), 9).alias("by_proportion"), length.alias("by_length"))


_N = "sqrt(list_dot_product({0}, {0}))"
_VECTOR_OK = f"{_N.format('embedding')} >= 1e-5"
_COS = f"CASE WHEN {_VECTOR_OK} THEN list_dot_product(embedding, q) / ({_N.format('embedding')} * {_N.format('q')}) END"


@query(f"""
WITH s AS (SELECT file_id, {_COS} AS s FROM chunks, query_vector), m AS (SELECT file_id, max(s) AS m FROM s GROUP BY file_id),
meta AS (SELECT file_id, any_value(m) + (ln(sum(exp(greatest(16 * (s - m), -50)))) - ln(count(s))) / 16 AS score FROM s JOIN m USING (file_id) GROUP BY file_id)
SELECT 'keyword' AS kind, idx, CAST(size AS DOUBLE) AS score FROM files UNION ALL SELECT 'empty', idx, 0.0 FROM files
UNION ALL SELECT 'by file', idx, round(CASE WHEN {_VECTOR_OK} THEN 1 / (1 + list_distance(embedding, q)) END, 6) FROM files LEFT JOIN vectors ON vec_id = idx, query_vector
UNION ALL SELECT 'semantic-content', idx, round({_COS}, 6) FROM files LEFT JOIN vectors ON vec_id = idx, query_vector
UNION ALL SELECT 'semantic-metadata', idx, round(score, 6) FROM files LEFT JOIN meta ON file_id = idx
""")
def dispatch_query(spark, sf_dir):
    from ..operators.features import FixedEmbedder
    from ..operators.search import semantic_scorers, standard_scorers

    files = V.files(spark, sf_dir).select("idx", "path", "size")
    text = "what the first vector stands for"
    embedder = FixedEmbedder({text: V.query_vector(spark, sf_dir).first()["q"]})
    vectors = V.vectors(spark, sf_dir).select(F.col("vec_id").alias("idx"), "embedding")
    chunks = V.chunks(spark, sf_dir).select(F.col("file_id").alias("idx"), "embedding")
    scorers = semantic_scorers(standard_scorers(), embedder, vectors, chunks)
    known = files.orderBy("idx").first()["path"]
    part = lambda kind, q, mode="file-name": scorers.score(files, q, mode).select(F.lit(kind).alias("kind"), "idx", F.round("score", 6).alias("score"))
    parts = [part("keyword", "file size"), part("empty", ""), part("by file", known), part("semantic-content", text, "semantic-content"), part("semantic-metadata", text, "semantic-metadata")]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT idx, path FROM (SELECT idx, path, coalesce(model_rating IS NOT NULL AND model_hash IS NOT NULL, false) AS stale FROM (SELECT f.idx, path, model_rating, model_hash FROM files f LEFT JOIN library ON file_path = path) WHERE NOT coalesce(model_rating IS NOT NULL AND model_hash = 'm_cur', false)) ORDER BY stale, path LIMIT 300")
def cap_batch(spark, sf_dir):
    """The limit is the feature: one background run takes a batch."""
    return R.cap_batch(L.unrated_files(V.files(spark, sf_dir), V.library(spark, sf_dir), V.CURRENT), 300, "stale", "path").select("idx", "path")


@query()
def scorer_registry(spark, sf_dir):
    from ..operators.search import standard_scorers

    files = V.files(spark, sf_dir).select("idx", "path", "size")
    return standard_scorers(3).score(files, "doc_1").select("idx", F.round("score", 6).alias("score"))
