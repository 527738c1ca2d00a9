"""Queries: projections, filters and predicates; scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as X
from ..functions.fuzzy import fuzzy_score
from ..functions.numbers import sampled_hash as sampled
from ..operators import features, library as L, names, ranking as R, search
from ..sources import views as V
from .registry import query

QUERY = "doc_1"


@query("""
SELECT idx, ext, CASE WHEN lower(ext) IN ('.txt', '.md', '.htm', '.html') THEN 'text' END AS modality FROM files
""")
def modality_of(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", "ext", L.modality_of(F.col("ext")).alias("modality"))


def _scored(spark, sf_dir):
    nan = F.when(F.col("idx") % 6 == 0, float("nan")).otherwise(F.col("score"))
    return L.effective_rating(V.files(spark, sf_dir).select("idx", "path", "size"), V.library(spark, sf_dir)).withColumn("score", nan)


_SCORED = "(SELECT f.idx, path, size, CASE WHEN f.idx % 6 = 0 THEN 'NaN'::DOUBLE ELSE coalesce(user_rating, model_rating) END AS score FROM files f LEFT JOIN library ON file_path = path)"


@query(f"SELECT idx, score FROM {_SCORED} WHERE score IS NOT NULL AND NOT isnan(score)")
def drop_unscored(spark, sf_dir):
    return R.drop_unscored(_scored(spark, sf_dir)).select("idx", "score")


@query(f"SELECT count(*) AS total, count(*) FILTER (score IS NOT NULL AND NOT isnan(score)) AS scored, count(*) FILTER (score IS NULL OR isnan(score)) AS unindexed, least(count(*) FILTER (score IS NOT NULL AND NOT isnan(score)), 100) AS shown FROM {_SCORED}")
def search_summary(spark, sf_dir):
    return R.search_summary(_scored(spark, sf_dir)).withColumn("shown", F.col("shown").cast("long"))


@query("""
SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) < 1e-5 AS unindexed, list_max(list_transform(embedding, lambda x: abs(x))) <= 1e-5 AS blank FROM vectors
""")
def is_unindexed_vector(spark, sf_dir):
    return V.vectors(spark, sf_dir).select("vec_id", X.is_unindexed(F.col("embedding")).alias("unindexed"), X.is_blank(F.col("embedding")).alias("blank"))


@query("SELECT idx, model_rating IS NOT NULL AND model_hash IS DISTINCT FROM 'm_cur' AS stale FROM library")
def rating_is_stale(spark, sf_dir):
    return V.library(spark, sf_dir).select("idx", L.rating_is_stale(F.col("model_rating"), F.col("model_hash"), V.CURRENT).alias("stale"))


_STRINGS = "(SELECT page_id, url, unnest([url, url || '/%2e%2e/x', url || '/%252e%252e/x', url || '/....flac', '/ETC/passwd?' || url]) AS value, unnest([0, 1, 2, 3, 4]) AS kind FROM pages)"


@query(f"""
SELECT page_id, kind, contains(v, '/etc/') OR contains(v, '/proc/') OR (contains(value, '/') AND list_contains(string_split(v, '/'), '..')) AS unsafe
FROM (SELECT page_id, kind, value, lower(url_decode(url_decode(value))) AS v FROM {_STRINGS})
""")
def quarantine_unsafe_paths(spark, sf_dir):
    url = F.col("url")
    values = F.array(url, F.concat(url, F.lit("/%2e%2e/x")), F.concat(url, F.lit("/%252e%252e/x")), F.concat(url, F.lit("/....flac")), F.concat(F.lit("/ETC/passwd?"), url))
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(values).alias("kind", "value"))
    return rows.select("page_id", "kind", T.is_unsafe(F.col("value")).alias("unsafe"))


_PAYLOADS = """(SELECT page_id, unnest(['{"data":{"files":[{"path":"' || u || '/../x"}]}}', '{"files":["normal.jpg",["' || u || '/%252e%252e/x"]]}', '{"a":{"b":{"c":"' || u || '"}},"n":5,"ok":true,"z":null}',
  '{"../etc/passwd":{"/proc/x":"' || u || '"}}', '{"a":[[{"b":"\\u002e\\u002e/' || u || '"}]]}', u || '/../{']) AS payload, unnest([0, 1, 2, 3, 4, 5]) AS kind FROM (SELECT page_id, replace(replace(url, '\\', '\\\\'), '"', '\\"') AS u FROM pages))"""


@query(f"""
WITH v AS (SELECT page_id, kind, json_extract_string(t.atom, '$') AS value FROM {_PAYLOADS} p, json_tree(p.payload) t WHERE kind < 5 AND t.type = 'VARCHAR' UNION ALL SELECT page_id, kind, payload FROM {_PAYLOADS} WHERE kind = 5)
SELECT page_id, kind, count(*) AS n_strings, count(*) FILTER (contains(v, '/etc/') OR contains(v, '/proc/') OR (contains(value, '/') AND list_contains(string_split(v, '/'), '..'))) AS n_unsafe
FROM (SELECT *, lower(url_decode(url_decode(value))) AS v FROM v) GROUP BY page_id, kind
""")
def quarantine_unsafe_payloads(spark, sf_dir):
    """Strings nested in JSON, at any depth."""
    u = F.replace(F.replace(F.col("url"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    j = lambda before, after: F.concat(F.lit(before), u, F.lit(after))
    payloads = F.array(
        j('{"data":{"files":[{"path":"', '/../x"}]}}'), j('{"files":["normal.jpg",["', '/%252e%252e/x"]]}'), j('{"a":{"b":{"c":"', '"}},"n":5,"ok":true,"z":null}'),
        j('{"../etc/passwd":{"/proc/x":"', '"}}'), j('{"a":[[{"b":"\\u002e\\u002e/', '"}]]}'), j("", "/../{"),
    )
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(payloads).alias("kind", "payload"))
    values = rows.select("page_id", "kind", T.json_strings(F.col("payload")).alias("v"))
    return values.select("page_id", "kind", F.size("v").cast("long").alias("n_strings"), F.size(F.filter("v", T.is_unsafe)).cast("long").alias("n_unsafe"))


@query("SELECT idx, kind, CASE kind WHEN 0 THEN path_ WHEN 1 THEN '/mnt/media/b' WHEN 2 THEN NULL ELSE '/mnt/media' END AS resolved FROM (SELECT idx, '/mnt/media' || '/text/' || idx || ext AS path_, unnest([0, 1, 2, 3]) AS kind FROM files)")
def within_base(spark, sf_dir):
    base = "/mnt/media"
    name = F.concat(F.lit("text/"), F.col("idx").cast("string"), "ext")
    asked = F.array(F.concat(F.lit("./"), name), F.concat(name, F.lit("/../../b")), F.concat(F.lit("../media2/"), name), F.lit(""))
    rows = V.files(spark, sf_dir).select("idx", F.posexplode(asked).alias("kind", "asked"))
    full = T.folded_path(F.concat(F.lit(base + "/"), "asked"))
    return rows.select("idx", "kind", F.when((full == base) | full.startswith(base + "/"), full).alias("resolved"))


@query("""
SELECT idx, kind FROM (SELECT idx, kind, CASE kind WHEN 0 THEN path WHEN 1 THEN replace(path, '/doc_', '/.doc_') WHEN 2 THEN 'osfs:///mnt/project_config/modules/m/' || idx || '.meta' ELSE 'osfs:///mnt/project_config/modules/m/' || idx || '.py' END AS path
FROM (SELECT idx, path, unnest([0, 1, 2, 3]) AS kind FROM files)) WHERE (starts_with(path, 'osfs:///mnt/media/') AND kind <> 1) OR kind = 2
""")
def servable_files(spark, sf_dir):
    own = F.col("path")
    module = F.concat(F.lit("osfs:///mnt/project_config/modules/m/"), F.col("idx").cast("string"))
    paths = F.array(own, F.replace(own, F.lit("/doc_"), F.lit("/.doc_")), F.concat(module, F.lit(".meta")), F.concat(module, F.lit(".py")))
    return L.servable(V.files(spark, sf_dir).select("idx", F.posexplode(paths).alias("kind", "path")), [V.LOCAL]).select("idx", "kind")


@query("SELECT idx, size FROM files WHERE length(trim(text)) >= 10")
def min_content(spark, sf_dir):
    return V.files(spark, sf_dir).filter(F.length(F.trim("text")) >= 10).select("idx", "size")


def _metadata():
    return F.create_map(F.lit("title"), F.concat(F.lit("t "), F.col("idx").cast("string")), F.lit("body"), F.col("text"), F.lit("comment"), F.lit("  "))


@query("SELECT idx, 'title: t ' || idx || CASE WHEN length(text) <= 1000 AND trim(text) <> '' THEN chr(10) || 'body: ' || text ELSE '' END AS lines FROM files")
def string_metadata_only(spark, sf_dir):
    kept = F.map_filter(_metadata(), lambda k, v: (F.length(v) <= 1000) & (F.trim(v) != ""))
    return V.files(spark, sf_dir).select("idx", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("lines"))


@query("SELECT idx, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[\\\\/._\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM files")
def normalize_text(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", T.normalize_text(F.col("text")).alias("plain"))


@query()
def fuzzy_ratio(spark, sf_dir):
    p = F.col("path")
    return V.files(spark, sf_dir).select("idx", F.round(fuzzy_score("doc 1", T.normalize_text(p), T.normalize_text(T.base_name(p))), 6).alias("ratio"))


@query(f"SELECT idx, CASE WHEN lower(path) = '{QUERY}.html' THEN 4 WHEN list_contains(string_split(lower(path), '/'), '{QUERY}.html') THEN 3 WHEN contains(lower(path), '{QUERY}.html') THEN 2 ELSE 0 END AS priority FROM files")
def literal_priority(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", T.literal_priority(F.col("path"), f"{QUERY}.html").alias("priority"))


@query()
def filename_score(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", F.round(search.filename_score(F.col("path"), QUERY), 6).alias("score"))


@query()
def filename_search(spark, sf_dir):
    """The 100 best names; ratios are computed only for names whose bound can reach them."""
    found = names.name_search(names.name_index(V.files(spark, sf_dir)), "src1 doc 12", 100)
    return found.select(F.col("key").alias("idx"), "path", F.round("score", 6).alias("score"))


@query("""
SELECT idx, k, CASE WHEN n >= 1073741824 THEN CAST(round(n / 1073741824.0::DOUBLE, 2) AS VARCHAR) || ' GB' WHEN n >= 1048576 THEN CAST(round(n / 1048576.0::DOUBLE, 2) AS VARCHAR) || ' MB'
  WHEN n >= 1024 THEN CAST(round(n / 1024.0::DOUBLE, 2) AS VARCHAR) || ' KB' WHEN n >= 1 THEN CAST(round(n / 1.0::DOUBLE, 2) AS VARCHAR) || ' B' ELSE '0B' END AS shown
FROM (SELECT idx, k, CASE k WHEN 0 THEN size WHEN 1 THEN size * 1000 WHEN 2 THEN size * 300000 ELSE 0 END AS n FROM (SELECT idx, size, unnest([0, 1, 2, 3]) AS k FROM files))
""")
def human_size(spark, sf_dir):
    rows = V.files(spark, sf_dir).select("idx", F.posexplode(F.array("size", F.col("size") * 1000, F.col("size") * 300000, F.lit(0).cast("long"))).alias("k", "n"))
    return rows.select("idx", "k", T.human_size(F.col("n")).alias("shown"))


@query("""
SELECT event_id, lpad(CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((s % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even(s % 60, 0) AS BIGINT) AS VARCHAR), 2, '0') AS shown
FROM (SELECT event_id, CAST(event_id * 37 % 86400 AS DOUBLE) + event_id % 2 * 0.5 AS s FROM events)
""")
def human_length(spark, sf_dir):
    s = (F.col("event_id") * 37 % 86400).cast("double") + F.col("event_id") % 2 * 0.5
    return V.table(spark, sf_dir, "events").select("event_id", T.human_length(s).alias("shown"))


@query("""
SELECT idx, CASE WHEN t IS NULL THEN 'Never' WHEN epoch(n) - epoch(t) < 60 THEN 'Just now' ELSE trim(concat_ws(' ', CASE WHEN m // 12 > 0 THEN (m // 12) || ' years' END, CASE WHEN m % 12 > 0 THEN (m % 12) || ' months' END,
  CASE WHEN r // 86400 > 0 THEN (r // 86400) || ' days' END, CASE WHEN r % 86400 // 3600 > 0 THEN (r % 86400 // 3600) || ' hours' END, CASE WHEN r % 3600 // 60 > 0 THEN (r % 3600 // 60) || ' minutes' END)) || ' ago' END AS shown
FROM (SELECT idx, t, n, m, CAST(epoch(n) AS BIGINT) - CAST(epoch(t + to_months(CAST(m AS INTEGER))) AS BIGINT) AS r FROM (SELECT idx, t, n, date_sub('month', t, n) AS m FROM (SELECT idx, TIMESTAMP '2024-07-01 12:00:00' AS n,
  CASE WHEN idx % 13 = 0 THEN NULL WHEN idx % 17 = 0 THEN TIMESTAMP '2024-07-01 11:59:30' ELSE TIMESTAMP '2020-01-15 03:30:00' + to_hours(idx * 11 % 35000) END AS t FROM files)))
""")
def human_time_ago(spark, sf_dir):
    i, now = F.col("idx"), F.lit(V.NOW).cast("timestamp")
    then = F.when(i % 13 == 0, F.lit(None).cast("timestamp")).when(i % 17 == 0, F.lit("2024-07-01 11:59:30").cast("timestamp")).otherwise(F.lit("2020-01-15 03:30:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (i * 11 % 35000).cast("int")))
    return V.files(spark, sf_dir).select("idx", T.human_time_ago(then, now).alias("shown"))


@query("SELECT idx, md5(text) AS digest FROM files")
def content_hash(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", F.md5("text").alias("digest"))


@query("""
SELECT idx, CASE WHEN n <= 5 * 512 THEN md5(h) ELSE md5(h[1:512] || '|' || h[st + 1:st + 512] || '|' || h[2 * st + 1:2 * st + 512] || '|' || h[3 * st + 1:3 * st + 512] || '|' || h[n - 511:n] || '|' || n) END AS digest
FROM (SELECT idx, h, length(h) AS n, (length(h) - 512) // 4 AS st FROM (SELECT idx, hex(text) AS h FROM files))
""")
def sampled_hash(spark, sf_dir):
    return V.files(spark, sf_dir).select("idx", sampled(F.hex("text"), block=512).alias("digest"))


@query("""
SELECT f.idx, 'File Name: ' || split_part(f.path, '/', -1) || chr(10) || 'File Path: ' || f.path || chr(10) || chr(10) || CASE WHEN is_local THEN
  CASE WHEN f.idx % 3 = 0 THEN '# Automatic description:' || chr(10) || 'a ' || f.ext || ' file' || chr(10) || chr(10) ELSE '' END || '# Internal metadata:' || chr(10) || 'title: t ' || f.idx || chr(10) || CASE WHEN length(f.text) <= 1000 THEN 'body: ' || f.text || chr(10) ELSE '' END || chr(10)
  ELSE '# Remote file note:' || chr(10) || 'Original file content is not fetched automatically. Rate this file to generate a permanent description in memory.' || chr(10) || chr(10) END
  || CASE WHEN s.text IS NOT NULL THEN '# External metadata from ''' || split_part(f.path, '/', -1) || '.meta'' file:' || chr(10) || s.text || chr(10) ELSE '' END AS description
FROM files f LEFT JOIN sidecars s ON s.path = f.path || '.meta'
""")
def description_text(spark, sf_dir):
    from ..sources.files import with_sidecar

    rows = with_sidecar(V.files(spark, sf_dir), V.sidecars(spark, sf_dir))
    name = T.base_name(F.col("path"))
    line = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c], F.lit("\n"))
    auto = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("a "), "ext", F.lit(" file")))
    local = F.concat(F.coalesce(line("# Automatic description:\n", auto, "\n"), F.lit("")), line("# Internal metadata:"), line("title: t ", F.col("idx").cast("string")), F.when(F.length("text") <= 1000, line("body: ", F.col("text"))).otherwise(""), F.lit("\n"))
    # Fixed value: the wording is part of the format.
    remote = F.lit("# Remote file note:\nOriginal file content is not fetched automatically. Rate this file to generate a permanent description in memory.\n\n")
    side = F.when(F.col("sidecar").isNotNull(), F.concat(line("# External metadata from '", name, ".meta' file:"), line(F.col("sidecar")))).otherwise("")
    return rows.select("idx", F.concat(line("File Name: ", name), line("File Path: ", F.col("path"), "\n"), F.when(F.col("is_local"), local).otherwise(remote), side).alias("description"))


@query("""
SELECT idx, k AS chunk_no, k * 128 AS first_token, least(192, n - k * 128) AS n_tokens, md5(array_to_string(w[k * 128 + 1:k * 128 + 192], ' ')) AS digest
FROM (SELECT idx, w, n, unnest(range(0, CASE WHEN n <= 192 THEN 1 ELSE CAST(ceil((n - 192) / 128.0) AS BIGINT) + 1 END)) AS k FROM (SELECT idx, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM files WHERE text <> ''))
""")
def chunk_text(spark, sf_dir):
    c = search.text_chunks(V.files(spark, sf_dir), "idx", "text", 192, 64)
    return c.select("idx", F.col("chunk_no").cast("long").alias("chunk_no"), (F.col("chunk_no") * 128).cast("long").alias("first_token"), F.size(F.split("chunk", " ")).cast("long").alias("n_tokens"), F.md5("chunk").alias("digest"))


@query("""
WITH s AS (SELECT idx, idx // 32 AS batch, list_transform(string_split(text, ' '), lambda w: length(w))[1:512] AS v FROM files), m AS (SELECT batch, max(len(v)) AS width FROM s GROUP BY batch)
SELECT idx, width, CAST(list_sum(v) AS BIGINT) AS total, width - len(v) AS padding FROM s JOIN m USING (batch)
""")
def pad_truncate(spark, sf_dir):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    rows = V.files(spark, sf_dir).select("idx", F.expr("idx div 32").alias("batch"), lengths.alias("v"))
    p = features.padded(rows, "idx", "v", "batch")
    return p.select("idx", F.size("values").cast("long").alias("width"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("padding"))
