"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clusters, compression, decontamination, html, lexical, mixing, pii, quality, repeats, sharding, simhash, tokens, toxicity
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", limit=512)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_pii_spans, op3_main_text, op4_simhash_dedup, op5_quality_rules,
        op6_suffix_dedup, op7_token_counts, op8_shard, op9_decontaminate, op10_toxicity,
        op11_compression_quality, op12_shallot_clusters, op13_norm_bucket_search,
    )
}


def _kmeans_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    """Plain k-means: every distance, every round."""
    near = "SELECT r, vec_id, v, arg_min(no, {{d: d, no: no}}) AS no, min(d) AS d FROM (SELECT r, vec_id, v, no, list_sum(list_transform(range(1, {n}), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS d FROM whole, {c}) GROUP BY r, vec_id, v".replace("{n}", str(dims + 1))
    parts = [
        f"fine AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"whole AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM fine)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS no, v AS c FROM whole QUALIFY no < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS ({near.format(c=f'c{n}')})")
        if n < rounds:
            means = f"SELECT no, list(CAST(m AS BIGINT) ORDER BY j) AS m FROM (SELECT no, j, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT no, unnest(v) AS x, unnest(range(1, {dims + 1})) AS j FROM a{n}) GROUP BY no, j) GROUP BY no"
            parts.append(f"c{n + 1} AS (SELECT no, coalesce(m, c) AS c FROM c{n} LEFT JOIN ({means}) USING (no))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(no AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY no) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (no)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
g AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(t) AS term FROM (SELECT item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
m AS (SELECT r, doc_id, CAST(25 + (75 * len(t) * n) // l AS BIGINT) AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT item_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

#: Of the others none is expressible in SQL as a whole; tests/llm hold them against brute force.
ORACLES: dict[str, str] = {
    "op12_shallot_clusters": _kmeans_sql(16, 3, 64, 64),
    "op13_norm_bucket_search": _RANKED,
}
