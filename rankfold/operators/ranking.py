"""Order, sampling, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import race_key, uniform
from ..sources.shared import stored


#: Rows up to whose place a page is taken from the top of a sort.
DEEP = 100_000


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds the place (from 0) of every row in a total order, without gathering rows in one task.

    Range partitions are sorted and numbered on their own and stored; a partition's offset is the count of the
    rows before it, a table of one row per partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    # The sort keys go first as columns, so that range bounds are sampled on them.
    keyed = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(_plain(keys))])
    order = _order([F.col(f"__k{i}") for i in range(len(keys))], keys)
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    numbered = stored(dealt.select(*cols, F.shiftright(local, 33).cast("int").alias("__part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("__nth")), "rank")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = numbered.groupBy("__part").agg(F.count("*").alias("n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    return numbered.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select(*cols, (F.col("__from") + F.col("__nth")).alias(name))


class Down:
    """A descending sort key."""

    def __init__(self, column: Column | str):
        self.column = F.col(column) if isinstance(column, str) else column


def _descending(k) -> bool:
    return isinstance(k, Down)


def _order(columns: list[Column], keys) -> list[Column]:
    return [c.desc_nulls_last() if _descending(k) else c.asc_nulls_first() for c, k in zip(columns, keys, strict=True)]


def _plain(keys) -> list[Column]:
    return [k.column if isinstance(k, Down) else (F.col(k) if isinstance(k, str) else k) for k in keys]


def drop_unscored(df: DataFrame, score: str = "score") -> DataFrame:
    """Null and NaN both mean unscored."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score))


def score_order(order: str = "most-relevant", score: str = "score", idx: str = "idx") -> list:
    if order not in ("most-relevant", "least-relevant"):
        raise ValueError(f"unknown order: {order}")
    return [Down(score), idx] if order == "most-relevant" else [score, Down(idx)]


def rank_by_score(df: DataFrame, order: str = "most-relevant", score: str = "score", idx: str = "idx") -> DataFrame:
    """Adds `rank`: best first, ties by listing order; least-relevant is the exact reverse."""
    return global_rank(drop_unscored(df, score), score_order(order, score, idx))


def page_by_score(df: DataFrame, offset: int = 0, limit: int = 100, order: str = "most-relevant", score: str = "score", idx: str = "idx") -> DataFrame:
    """The page that rank_by_score() and page() give, sorted no further than its end."""
    return top_page(drop_unscored(df, score), score_order(order, score, idx), offset, limit)


def temperature_shuffle(df: DataFrame, temperature: float, seed: int, score: str = "score", key: str = "path", idx: str = "idx") -> DataFrame:
    """Sampling without replacement, each draw in proportion to score ** (1 / temperature); 0: strict order."""
    if temperature <= 0:
        return rank_by_score(df, score=score, idx=idx)
    keyed = drop_unscored(df, score).withColumn("__race", race_key(F.col(score), temperature, uniform(F.col(key), seed)))
    return global_rank(keyed, [Down("__race"), idx]).drop("__race")


def page(ranked: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """The rows of one page of a ranked frame; a filter on the rank, no second sort."""
    return ranked.filter((F.col("rank") >= offset) & (F.col("rank") < offset + limit))


def top_page(df: DataFrame, keys: list[Column], offset: int = 0, limit: int = 100, name: str = "rank") -> DataFrame:
    """One page of a total order with its ranks, without ordering the rest: every task keeps its first offset + limit
    rows. A page beyond DEEP rows is cut from the whole ranking instead."""
    if offset + limit > DEEP:
        ranked = global_rank(df, keys, name)
        return ranked.filter((F.col(name) >= offset) & (F.col(name) < offset + limit))
    order = _order(_plain(keys), keys)
    head = df.orderBy(*order).limit(offset + limit)
    return head.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long")).filter(F.col(name) >= offset)  # DEEP rows at most


def cap_batch(df: DataFrame, cap: int | None, *order: Column | str) -> DataFrame:
    """The first `cap` rows in priority order, all if there is no cap."""
    return df if cap is None else df.orderBy(*order).limit(cap)


def search_summary(df: DataFrame, shown: int = 100, score: str = "score") -> DataFrame:
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("scored"), F.count_if(~ok).alias("unindexed"), F.least(F.count_if(ok), F.lit(shown)).alias("shown"))
