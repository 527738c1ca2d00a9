"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies grows with a power of its
length, up to ``max_copies``; its whole part is certain, and for the fraction the documents of a source are
ranked by random odds over inclusion odds (Pareto sampling) and taken in that order until the source's words
are as near to its target as whole documents allow.

Nothing is gathered by source: all sums are partial aggregates by (source, size) or (source, rank bucket), and
the only rows that are sorted within a source are those of the one bucket that holds the cut.

Edge cases: a null or empty text has 0 words and is never taken; a null source is a source of its own, last;
rows with equal id and text share one random number and are taken or left together; an empty table gives an
empty result; further columns are carried along unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, unit, written

BUCKETS = 4096


@dataclass(frozen=True)
class Mix:
    """weights: repeated over the sources in code point order; total: words of the mix over words of the input."""

    weights: tuple[float, ...] = (5, 2, 1)
    total: float = 1.5
    max_copies: int = 2
    length_power: float = 0.25
    seed: int = 20240


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _favour(size: Column, mix: Mix) -> Column:
    """A document's relative weight as a whole number, so that sums don't depend on their order."""
    return F.round(F.pow(size.cast("double"), F.lit(mix.length_power)) * 1024).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(key, source_size) -> with target: shares by weight, none over max_copies times its source, the excess reshared.

    With sources sorted by capacity over weight, the common level is the largest of the levels that result if
    all sources before a source are full. One row per source, so the global window is over a small table.
    """
    cap, w = float(mix.max_copies), F.col("weight")
    by_name = W.orderBy(F.col("key") == "-", "key")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("room", "nth").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), ((F.col("nth") - 1) % len(mix.weights) + 1).cast("int")))
        .withColumn("room", F.col("source_size") * cap / w)
        .withColumn("left", F.sum("source_size").over(every) * float(mix.total) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left") / (F.sum(w).over(every) - F.coalesce(F.sum(w).over(before), F.lit(0.0)))).over(every))
        .select("key", "source_size", F.least(F.col("source_size") * cap, F.col("level") * w).alias("target"))
    )


def _ranked(df: DataFrame, mix: Mix) -> DataFrame:
    """With the certain copies and the Pareto rank z in (0, 1), the odds ratio q as q / (1 + q); bucket: of z."""
    size, u = F.col("__size"), unit(F.col("__h"))
    expected = F.when(size > 0, F.least(F.lit(float(mix.max_copies)), F.col("__rate") * _favour(size, mix))).otherwise(F.lit(0.0))
    df = df.withColumn("__expected", expected).withColumn("__sure", F.floor("__expected")).withColumn("__p", F.col("__expected") - F.col("__sure"))
    p = F.col("__p")
    z = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    bucket = F.when(p > 0, F.least(F.floor(F.col("__z") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    return df.withColumn("__z", F.when(p > 0, z)).withColumn("__bucket", bucket)


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix) -> DataFrame:
    return docs.withColumns({"__key": _key(F.col(source_col)), "__size": n_words(F.col(text_col)), "__h": F.xxhash64(F.lit(mix.seed), F.col(id_col), F.col(text_col))})


def fit(slim: DataFrame, mix: Mix) -> DataFrame:
    """slim: (__key, __size, __h). One row per source: its size, target, rate of copies, and the cut in Pareto order."""
    cap, size, n = float(mix.max_copies), F.col("__size"), F.col("n")
    hist = written(slim.groupBy("__key", "__size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = written(source_targets(hist.groupBy(F.col("__key").alias("key")).agg(F.sum(n * size).alias("source_size")), mix), "mix-targets")
    # The rate: the longest documents reach max_copies first; the same rule of the largest level.
    of = hist.filter(size > 0).join(targets, F.col("__key") == F.col("key")).withColumn("fav", _favour(size, mix))
    all_of = W.partitionBy("key")
    longer = W.partitionBy("key").orderBy(F.desc("__size")).rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("target") - cap * F.coalesce(F.sum(n * size).over(longer), F.lit(0))
    mass = F.sum(n * size * F.col("fav")).over(all_of) - F.coalesce(F.sum(n * size * F.col("fav")).over(longer), F.lit(0))
    rates = of.withColumn("level", rest / mass).groupBy("key").agg(F.max("level").alias("__rate"))
    sources = targets.join(rates, "key", "left").select(F.col("key").alias("__key"), "source_size", "target", F.coalesce("__rate", F.lit(0.0)).alias("__rate"))
    sources = written(sources, "mix-rates")
    sure = _ranked(hist.withColumn("__h", F.lit(0).cast("long")).join(sources, "__key"), mix).groupBy("__key").agg(F.sum(n * size * F.col("__sure")).alias("sure"))
    budget = sources.join(sure, "__key").select("__key", (F.col("target") - F.col("sure")).alias("budget"))
    # The bucket that holds the cut.
    ranked = _ranked(slim.join(sources, "__key"), mix).filter(F.col("__z").isNotNull())
    upto = W.partitionBy("__key").orderBy("__bucket")
    cums = ranked.groupBy("__key", "__bucket").agg(F.sum("__size").alias("s")).withColumn("cum", F.sum("s").over(upto))
    cut = cums.join(budget, "__key").filter(F.col("cum") > F.col("budget")).groupBy("__key").agg(F.min("__bucket").alias("__cut"), F.min_by(F.col("budget") - (F.col("cum") - F.col("s")), F.col("__bucket")).alias("rest"))
    cut = written(cut, "mix-cuts")
    # Inside it, the place where the words come nearest.
    upto = W.partitionBy("__key").orderBy("__z")
    inside = ranked.join(cut, "__key").filter(F.col("__bucket") == F.col("__cut")).groupBy("__key", "__z", "rest").agg(F.sum("__size").alias("s"))
    last = inside.withColumn("cum", F.sum("s").over(upto)).filter(2 * F.col("cum") - F.col("s") <= 2 * F.col("rest")).groupBy("__key").agg(F.max("__z").alias("__last"))
    out = sources.join(cut.drop("rest"), "__key", "left").join(last, "__key", "left")
    return written(out.withColumn("__cut", F.coalesce("__cut", F.lit(BUCKETS))), "mix-plan")


def with_copies(prepared: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Adds the plan's columns and the number of copies to rows that _prepared() made; narrow but for a join with the per-source plan."""
    df = _ranked(prepared.join(plan, "__key", "left"), mix)
    taken = (F.col("__bucket") < F.col("__cut")) | ((F.col("__bucket") == F.col("__cut")) & (F.col("__z") <= F.col("__last")))
    return df.withColumn("__copies", (F.col("__sure") + F.coalesce(taken, F.lit(False)).cast("int")).cast("int"))


def decisions(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size in words, its source's size and target, and the words that the mix takes of it."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    slim = written(_prepared(docs, "id", "t", "s", mix).drop("t", "s"), "mix-docs")
    out = with_copies(slim, fit(slim, mix), mix)
    return out.select(F.col("id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the columns it came with."""
    # The caller's columns stay in one struct, so their names don't matter.
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    ready = _prepared(own, "id", "t", "s", mix).drop("id", "t", "s")
    slim = written(ready.select("__key", "__size", "__h"), "mix-docs")
    plan = fit(slim, mix).select("__key", "__rate", "__cut", "__last")
    taken = with_copies(ready, plan, mix).filter(F.col("__copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
