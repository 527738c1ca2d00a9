"""Queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.library import effective_rating
from ..operators.ranking import page_by_score
from ..sources import files as S
from ..sources import views as V
from ..sources.sectioned_csv import export_csv
from ..sources.sectioned_csv import import_csv as read_sections
from .registry import query


@query()
def scan_files(spark, sf_dir):
    return S.scan_files(spark, [sf_dir, f"{sf_dir}/not-there"], {".parquet"}).select(T.base_name(F.col("path")).alias("name"), "size", "ext")


@query("""
SELECT page_id, scheme || '://' || host || '/' AS base_url, '/' || array_to_string(list_filter(string_split(rest, '/'), lambda s: s NOT IN ('', '.')), '/') AS path_in_fs, false AS is_local
FROM (SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '^[^/]*', '') AS rest FROM pages)
UNION ALL SELECT -1 - idx, CASE WHEN is_local THEN 'osfs:///' ELSE 'webdav://host:6001/' END, CASE WHEN is_local THEN replace(path, 'osfs://', '') ELSE replace(path, 'webdav://host:6001', '') END, is_local FROM files
""")
def split_url(spark, sf_dir):
    urls = V.table(spark, sf_dir, "pages").select("page_id", "url").unionByName(V.files(spark, sf_dir).select((-1 - F.col("idx")).alias("page_id"), F.col("path").alias("url")))
    u = F.col("url")
    return urls.select("page_id", T.base_url(u).alias("base_url"), T.path_in_fs(u).alias("path_in_fs"), T.is_local_url(u).alias("is_local"))


@query("""
SELECT f.path, s.sidecar FROM files f LEFT JOIN (
  SELECT path, coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= 3 AND n <= 200), '') AS sidecar FROM (
    SELECT path, i, line, sum(length(line)) OVER (PARTITION BY path ORDER BY i) AS n FROM (
      SELECT path, i, CASE WHEN i < len(parts) THEN parts[i] || chr(10) ELSE parts[i] END AS line
      FROM (SELECT path, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM sidecars)) WHERE line <> '')
  GROUP BY path) s ON s.path = f.path || '.meta'
""")
def read_sidecar(spark, sf_dir):
    return S.with_sidecar(V.files(spark, sf_dir).select("path"), V.sidecars(spark, sf_dir), lines=3, chars=200)


@query("""
SELECT f.path, sidecar FROM files f LEFT JOIN (
  SELECT path, coalesce(string_agg(c, '' ORDER BY i) FILTER (n <= 120), '') AS sidecar FROM (
    SELECT path, i, c, sum(strlen(c)) OVER (PARTITION BY path ORDER BY i) AS n FROM (SELECT path, i, text[i] AS c FROM (SELECT path, text, unnest(range(1, length(text) + 1)) AS i FROM sidecars)))
  GROUP BY path) s ON s.path = f.path || '.meta'
""")
def read_sidecar_bytes(spark, sf_dir):
    """The variant with a cap in bytes."""
    return S.with_sidecar(V.files(spark, sf_dir).select("path"), V.sidecars(spark, sf_dir), most_bytes=120)


@query("""
SELECT idx, CASE WHEN length(head) > 400 THEN head[1:400] || '...' ELSE head END AS preview
FROM (SELECT idx, array_to_string(string_split(CASE WHEN cut[-1] = chr(10) THEN cut[1:length(cut) - 1] ELSE cut END, chr(10))[1:25], chr(10)) AS head FROM (SELECT idx, substring(text, 1, 4096) AS cut FROM files))
""")
def text_preview(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", T.preview(F.col("text")).alias("preview"))


@query("""
SELECT strftime(coalesce(user_rating_date, TIMESTAMP '2024-07-01'), '%Y-%m-%d') AS day, hash AS file_stem,
  'Rating: ' || CAST(user_rating AS VARCHAR) || chr(10) || 'Soft Hash: ' || hash || chr(10) || 'File Path: ' || file_path || chr(10) || 'File Name: ' || split_part(file_path, '/', -1) || chr(10) || 'Captured At: 2024-07-01 12:00:00' || chr(10) || chr(10)
  || CASE WHEN idx % 2 = 0 THEN 'text of ' || file_path ELSE '# Note:' || chr(10) || 'Original file was not available; captured metadata is limited.' || chr(10) END AS value
FROM library WHERE user_rating IS NOT NULL
""")
def write_memory(spark, sf_dir):
    rated = V.library(spark, sf_dir).filter("user_rating IS NOT NULL").withColumn("description", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("text of "), "file_path")))
    return S.memory_records(rated, V.NOW)


@query("""
SELECT day, file_stem, TRY_CAST(nullif(regexp_extract(split_part(value, chr(10), 1), '^Rating:\\s*(\\S+)', 1), '') AS DOUBLE) AS rating,
  regexp_replace(regexp_replace(value[instr(value, chr(10)) + 1:], '^\\s+', ''), '\\s+$', '') AS description
FROM memory WHERE TRY_CAST(nullif(regexp_extract(split_part(value, chr(10), 1), '^Rating:\\s*(\\S+)', 1), '') AS DOUBLE) IS NOT NULL
""")
def read_memory(spark, sf_dir):
    return S.parse_memory(V.memory(spark, sf_dir))


_CELL = "CASE WHEN regexp_matches({0}, '[,\"\\r\\n\\\\]') THEN '\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\"\"') || '\"' ELSE {0} END"


def _tables(spark, sf_dir):
    library = V.library(spark, sf_dir).select("idx", "hash", "file_path", "user_rating", F.date_format("user_rating_date", "yyyy-MM-dd HH:mm:ss").alias("user_rating_date"))
    notes = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("note"), F.lit("secret").alias("blob"))
    return {"library": library, "notes": notes}


@query(f"""
SELECT 0 AS section, -1::BIGINT AS key, 'library.idx,library.hash,library.file_path,library.user_rating,library.user_rating_date' AS line
UNION ALL SELECT 0, idx, idx || ',' || hash || ',' || file_path || ',' || coalesce(CAST(user_rating AS VARCHAR), '') || ',' || coalesce(strftime(user_rating_date, '%Y-%m-%d %H:%M:%S'), '') FROM library
UNION ALL SELECT 1, -1, 'notes.item_id,notes.note' UNION ALL SELECT 1, item_id, item_id || ',' || {_CELL.format("text")} FROM benchmark
""")
def export_sectioned_csv(spark, sf_dir):
    lines = export_csv(_tables(spark, sf_dir), frozenset({"blob"}), {"library": "idx", "notes": "item_id"})
    return lines.withColumn("key", F.coalesce("key", F.lit(-1).cast("long")))


@query("""SELECT idx, hash, file_path, user_rating, CAST(epoch(user_rating_date) AS DOUBLE) AS rated_at FROM library""")
def import_sectioned_csv(spark, sf_dir):
    tables = {"library": _tables(spark, sf_dir)["library"], "unknown": V.tags(spark, sf_dir).select("tag_no", "tag")}
    lines = export_csv(tables, order={"library": "idx", "unknown": "tag_no"})
    # Line numbers that keep the sections apart, headers first.
    lines = lines.select((F.col("section").cast("long") * (1 << 40) + F.coalesce(F.col("key") + 1, F.lit(0))).alias("line_no"), "line")
    got = read_sections(lines, {"library": {"idx": "long", "hash": "string", "file_path": "string", "user_rating": "double", "user_rating_date": "timestamp"}})["library"]
    return got.select("idx", "hash", "file_path", "user_rating", F.unix_timestamp("user_rating_date").cast("double").alias("rated_at"))


@query("""
SELECT rank, '{"path":"' || path || '","size":' || size || ',"search_score":' || CASE WHEN score IS NULL THEN 'null' ELSE CAST(score AS VARCHAR) END || '}' AS json
FROM (SELECT path, size, score, row_number() OVER (ORDER BY score DESC, idx) - 1 AS rank FROM (SELECT f.idx, f.path, f.size, coalesce(user_rating, model_rating) AS score FROM files f LEFT JOIN library ON file_path = path) WHERE score IS NOT NULL) WHERE rank < 100
""")
def result_page_json(spark, sf_dir):
    ranked = page_by_score(effective_rating(V.files(spark, sf_dir).select("idx", "path", "size"), V.library(spark, sf_dir)))
    row = F.struct("path", "size", F.when(~F.isnan("score"), F.col("score")).alias("search_score"))
    return ranked.select("rank", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


@query("""
WITH g AS (SELECT DISTINCT lang, source FROM documents)
SELECT source AS tag, (SELECT md5(string_agg(source, chr(10) ORDER BY source))[1:12] FROM g) AS vocabulary FROM g
""")
def flatten_vocabulary(spark, sf_dir):
    groups = V.table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set("source").alias("tags"))
    return S.vocabulary(groups, "tags")
