"""The best files of a name search, without a fuzzy ratio for every name.

An index holds each file's normalised path and base name with their distinct words, stored once for all searches. A search
computes an upper bound of every name's score from them with built-in functions: a common subsequence is never longer than
the characters that two texts share (each counted as often as both have it), and what word-wise ratios owe to shared words
is known exactly. The names of the highest bounds are scored first; their k-th score is what the others' bounds have to
reach, and only those are scored too. So the result is that of scoring everything.

(A list of names by word or q-gram alone can't decide: a subsequence may share no q-gram with the name it comes from.)

Edge cases: an empty query finds nothing; null paths score as empty names; equal scores go by key; empty tables give an
empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import fuzzy_score
from ..sources.shared import stored

#: Names scored first, as a multiple of k.
FIRST = 2


def plain_query(query: str) -> str:
    return " ".join(query.strip().lower().replace("_", " ").replace("-", " ").replace(".", " ").replace("/", " ").split())


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def name_index(files: DataFrame, key: str = "idx", path: str = "path") -> DataFrame:
    """(key, path, full, base, full_words, base_words), stored: what searches need of every name."""
    names = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.coalesce(T.normalize_text(F.col(path)), F.lit("")).alias("full"), F.coalesce(T.normalize_text(T.base_name(F.col(path))), F.lit("")).alias("base"))
    return stored(names.withColumns({"full_words": _words(F.col("full")), "base_words": _words(F.col("base"))}), "names")


def _shared(text: Column, q: str) -> Column:
    """Characters that a text shares with the query, each as often as both have it."""
    out = F.lit(0)
    for c, n in sorted(Counter(q).items()):
        out = out + F.least(F.lit(n), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))
    return out.cast("double")


def _word_bound(text: Column, words: Column, q: str) -> Column:
    """Of the token-set ratio: shared words are exact, the rest is bounded by shared characters."""
    asked = sorted(set(q.split()))
    own = F.array(*[F.lit(w) for w in asked])
    both = F.array_intersect(words, own)
    joined = lambda a: (F.aggregate(a, F.lit(0), lambda s, w: s + F.length(w)) + F.size(a) - 1).cast("double")
    n, m, b = float(len(" ".join(asked))), joined(words), joined(both)
    some = F.size(both) > 0
    whole = some & ((F.size(both) == len(asked)) | (F.size(both) == F.size(words)))
    mixed = 200 * F.least(_shared(text, " ".join(asked)), F.lit(n), m) / (n + m)
    parts = F.greatest(mixed, F.when(some, 200 * b / (b + n)), F.when(some, 200 * b / (b + m)))
    return F.when(F.size(words) == 0, 0.0).when(whole, 100.0).otherwise(parts)


def _whole_bound(text: Column, words: Column, q: str) -> Column:
    """Of the weighted ratio of one word."""
    n, m = F.lit(float(len(q))), F.length(text).cast("double")
    c = _shared(text, q)
    plain = 200 * c / (n + m)
    longer = F.greatest(n, m) / F.least(n, m)
    held = F.array_contains(words, q)
    distinct = (F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) + F.size(words) - 1).cast("double")
    sets = F.when(held, 100.0).otherwise(200 * F.least(c, n, distinct) / (n + distinct))

    def cut(size: Column) -> Column:
        # A part may be cut at the ends down to what is shared.
        least = F.least(n, size)
        return 200 * F.least(c, least) / (least + F.least(c, least))

    part = F.when(held, 100.0).otherwise(F.greatest(cut(m), cut(distinct)))  # repeated words count once in a word-wise part
    scale = F.when(longer <= 8.0, 0.9).otherwise(0.6)
    near = F.greatest(plain, 0.95 * plain, 0.95 * sets)
    return F.when((m == 0) | (c == 0), 0.0).when(longer < 1.5, near).otherwise(F.greatest(plain, scale * part))


def score_bound(query: str) -> Column:
    """An upper bound of filename_score over the columns of the index."""
    q = plain_query(query)
    bound = _word_bound if " " in q else _whole_bound
    fuzzy = F.greatest(1.3 * bound(F.col("base"), F.col("base_words"), q), bound(F.col("full"), F.col("full_words"), q))
    return (10.0 * T.literal_priority(F.coalesce("path", F.lit("")), query) + fuzzy) / 100.0 + 1e-9


def candidates(index: DataFrame, query: str, k: int) -> DataFrame:
    """(key, path, score) of the names that get a ratio: the k best ones are among them."""
    q = plain_query(query)
    exact = (10.0 * T.literal_priority(F.coalesce("path", F.lit("")), query) + fuzzy_score(q, F.col("full"), F.col("base"))) / 100.0
    if not q:
        return index.filter("false").select("key", "path", F.lit(0.0).alias("score"))
    bounded = stored(index.withColumn("bound", score_bound(query)).select("key", "path", "full", "base", "bound"), "name-bounds")
    first = stored(bounded.orderBy(F.col("bound").desc(), F.col("key").asc_nulls_last()).limit(FIRST * k).withColumn("score", exact), "names-first")  # FIRST * k rows
    kth = first.select("score", "key").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last()).limit(k).collect()
    last = first.agg(F.min("bound")).first()[0]
    better = F.lit(True)
    if len(kth) == k:
        # What can only tie with the k-th comes before it by its key alone.
        tie = F.col("key").isNotNull() if kth[-1].key is None else F.col("key") < F.lit(kth[-1].key)
        better = (F.col("bound") > kth[-1].score + 2e-9) | ((F.col("bound") >= kth[-1].score) & tie)
    rest = bounded.filter(better & (F.col("bound") <= F.lit(last if last is not None else 0.0)))
    scored = first.select(F.col("key").alias("__key"))
    rest = rest.join(F.broadcast(scored), F.col("key").eqNullSafe(F.col("__key")), "left_anti").withColumn("score", exact)  # FIRST * k keys
    return first.select("key", "path", "score").unionByName(rest.select("key", "path", "score"))


def name_search(index: DataFrame, query: str, k: int = 100) -> DataFrame:
    """(key, path, score): the k best names by filename_score, ties by key."""
    return candidates(index, query, k).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last()).limit(k)
