"""Queries: vector search, neighbours, tags, fingerprints, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import features
from ..operators import search as O
from ..operators import tags as G
from ..operators.ranking import Down, global_rank
from ..sources import views as V
from .registry import query

_DOT = "list_dot_product(embedding, q)"
_NORM = "sqrt(list_dot_product({0}, {0}))"
_OK = f"{_NORM.format('embedding')} >= 1e-5"


@query(f"SELECT vec_id, round(CASE WHEN {_OK} THEN {_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q')}) END, 6) AS score FROM vectors, query_vector")
def cosine_search(spark, sf_dir):
    return O.cosine_search(V.vectors(spark, sf_dir), V.query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(CASE WHEN {_OK} THEN 1 / (1 + list_distance(embedding, q)) END, 6) AS score FROM vectors, query_vector")
def by_example_search(spark, sf_dir):
    return O.by_example_search(V.vectors(spark, sf_dir), V.query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
WITH s AS (SELECT file_id, CASE WHEN {_OK} THEN {_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q')}) END AS s FROM chunks, query_vector), m AS (SELECT file_id, max(s) AS m FROM s GROUP BY file_id)
SELECT file_id, round(any_value(m) + (ln(sum(exp(greatest(16 * (s - m), -50)))) - ln(count(s))) / 16, 6) AS score FROM s JOIN m USING (file_id) GROUP BY file_id
""")
def smooth_max_search(spark, sf_dir):
    return O.smooth_max_search(V.chunks(spark, sf_dir), V.query_vector(spark, sf_dir)).select("file_id", F.round("score", 6).alias("score"))


_NEAREST = "nearest AS (SELECT a.vec_id, arg_min(b.vec_id, {d: list_distance(a.embedding, b.embedding), i: b.vec_id}) AS neighbor, min(list_distance(a.embedding, b.embedding)) AS distance FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"


@query(f"WITH {_NEAREST} SELECT vec_id, neighbor, round(distance, 6) AS distance FROM nearest")
def nearest_neighbor(spark, sf_dir):
    return O.nearest_neighbor(V.vectors(spark, sf_dir)).select("vec_id", "neighbor", F.round("distance", 6).alias("distance"))


@query()
def nearest_neighbor_lsh(spark, sf_dir):
    """The approximate index; tests hold its recall to the exact search."""
    return O.nearest_neighbor_lsh(V.vectors(spark, sf_dir).filter("vec_id >= 0")).select("vec_id", "neighbor", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NEAREST} SELECT vec_id, round(o.distance, 6) AS neighbor_distance, round(n.distance, 6) AS distance, size, row_number() OVER (ORDER BY round(o.distance, 6), round(n.distance, 6), size, vec_id) - 1 AS rank FROM nearest n JOIN (SELECT vec_id AS neighbor, distance FROM nearest) o USING (neighbor) JOIN vectors USING (vec_id)")
def similarity_order(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    keys = O.similarity_keys(O.nearest_neighbor(v), v.select("vec_id", "size"))
    keys = keys.select("vec_id", F.round("neighbor_distance", 6).alias("neighbor_distance"), F.round("distance", 6).alias("distance"), "size")
    return global_rank(keys, ["neighbor_distance", "distance", "size", "vec_id"])


_TAGGED = f"tagged AS (SELECT vec_id, tag_no, tag, {_DOT.replace('q', 'te')} / ({_NORM.format('embedding')} * {_NORM.format('te')}) AS similarity FROM vectors, (SELECT tag_no, tag, embedding AS te FROM tags) WHERE {_OK})"


@query(f"WITH {_TAGGED} SELECT vec_id, tag_no, tag, round(similarity, 6) AS similarity FROM tagged")
def tag_similarity(spark, sf_dir):
    return G.tag_similarity(V.vectors(spark, sf_dir), V.tags(spark, sf_dir)).select("vec_id", "tag_no", "tag", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_TAGGED} SELECT vec_id, string_agg(tag, ', ' ORDER BY round(similarity, 9) DESC, tag_no) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, tag_no) AS n FROM tagged WHERE similarity >= 0) WHERE n <= 15 GROUP BY vec_id")
def top_tags(spark, sf_dir):
    return G.best_tags(V.vectors(spark, sf_dir), V.tags(spark, sf_dir))


@query(f"""
WITH {_TAGGED}, t AS (SELECT vec_id, string_agg(tag, ', ' ORDER BY round(similarity, 9) DESC, tag_no) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, tag_no) AS n FROM tagged WHERE similarity >= 0) WHERE n <= 15 GROUP BY vec_id),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k, len(embedding) AS n FROM vectors WHERE {_OK}),
f AS (SELECT vec_id, string_agg('abcdefghijklmnopqrstuvwxyz012345'[r * 32 // n + 1], ' ' ORDER BY k) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, k) - 1 AS r FROM e) GROUP BY vec_id)
SELECT vec_id, coalesce(fingerprint, '') AS fingerprint, CASE WHEN fingerprint IS NULL THEN '# Embedding proxy (m):' || chr(10) || '[Error: embedding unavailable — file could not be processed by the embedding model]' || chr(10)
  ELSE '# Embedding proxy (m):' || chr(10) || coalesce('Tags: ' || tags || chr(10), '') || 'Fingerprint: ' || fingerprint || chr(10) END AS section FROM vectors LEFT JOIN f USING (vec_id) LEFT JOIN t USING (vec_id)
""")
def fingerprint(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    t = G.best_tags(v, V.tags(spark, sf_dir))
    rows = v.select("vec_id", X.fingerprint(F.col("embedding")).alias("fingerprint")).join(t, "vec_id", "left")
    return rows.select("vec_id", "fingerprint", O.proxy_section(F.col("fingerprint"), F.coalesce("tags", F.lit("")), "m").alias("section"))


@query()
def embed_missing(spark, sf_dir):
    embedder = features.HashingEmbedder(32)
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = features.embedded(docs.filter("doc_id % 2 = 0"), embedder, "doc_id", "text")
    return features.embed_missing(docs, stored, embedder, "doc_id", "text").select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"), "version")


@query()
def embedder_plugin(spark, sf_dir):
    return features.embedded(V.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text"), features.HashingEmbedder(16), "key", "text").select("key", F.size("embedding").alias("dims"), "version")


@query(f"SELECT vec_id, round({_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q')}), 6) AS score FROM vectors JOIN files ON idx = vec_id, query_vector WHERE is_local AND {_OK}")
def local_only_semantic(spark, sf_dir):
    local = V.files(spark, sf_dir).filter("is_local").select(F.col("idx").alias("vec_id"))
    scored = O.cosine_search(V.vectors(spark, sf_dir).join(local, "vec_id", "left_semi"), V.query_vector(spark, sf_dir))
    return scored.filter("score IS NOT NULL").select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT idx, k AS chunk_no, CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(w[1:k * 128], ' ')) + 1 END AS s, array_to_string(w[k * 128 + 1:k * 128 + 192], ' ') AS t
  FROM (SELECT idx, w, n, unnest(range(0, CASE WHEN n <= 192 THEN 1 ELSE CAST(ceil((n - 192) / 128.0) AS BIGINT) + 1 END)) AS k FROM (SELECT idx, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM files WHERE text <> ''))),
d AS (SELECT idx, chunk_no, s, s + length(t) AS e, (length(t) - length(replace(t, 'e', '')))::DOUBLE / length(t) AS score FROM c),
x AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, lead(score) OVER w AS nscore FROM d WINDOW w AS (PARTITION BY idx ORDER BY chunk_no))
SELECT idx, chunk_no, part, s AS start, e AS end, round(score, 6) AS score FROM (SELECT idx, chunk_no, 0 AS part, greatest(coalesce(pe, 0), s) AS s, coalesce(ns, e) AS e, score FROM x UNION ALL SELECT idx, chunk_no, 1, ns, e, (score + nscore) / 2 FROM x WHERE ns IS NOT NULL) WHERE s < e
""")
def segment_scores(spark, sf_dir):
    c = O.text_chunks(V.files(spark, sf_dir), "idx", "text", 192, 64)
    share = (F.length("chunk") - F.length(F.replace("chunk", F.lit("e"), F.lit("")))) / F.length("chunk")
    s = O.segment_scores(c.withColumn("score", share).drop("chunk"), "idx")
    return s.select("idx", F.col("chunk_no").cast("long").alias("chunk_no"), "part", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 6).alias("score"))


@query()
def lttb_downsample(spark, sf_dir):
    return O.lttb(V.history(spark, sf_dir), 400)
