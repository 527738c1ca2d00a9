"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Dimensions are the byte length (log scale), the source and the language, each on a grid of 1,024 steps. A node
that is due several shards is split along its widest dimension at the weighted median (weights: bytes; for an
uneven number of shards the matching quantile), until every leaf has the bytes of one shard. All nodes of a
level are split at once, and medians are found on histograms: by grid step, then by hash bucket within the one
step that holds the median, so no node is ever gathered or sorted.

Equal texts have equal coordinates and stay together, unless a group of them exceeds 1/64 of a shard: such a
group is dealt out by a hash of the id, so one hot group can't unbalance the shards.

Edge cases: a null text has size 1 and checksum 0; null sources and languages sort first; repeated rows are
placed like any others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

STEPS, FINE, PARTS = 1024, 4096, 64
DIMS = ("__g0", "__g1", "__g2")


def _rank(points: DataFrame, name: str, out: str) -> DataFrame:
    """Grid step of a name: its place among the distinct names, spread over the grid. One row per name."""
    names = points.groupBy(name).agg(F.count("*").alias("n")).select(name)
    place = F.percent_rank().over(W.orderBy(F.col(name).asc_nulls_first()))
    return written(names.select(F.coalesce(name, F.lit("")).alias("k"), F.col(name).isNull().alias("none"), F.floor(place * (STEPS - 1)).cast("int").alias(out)), "shard-names")


def _points(docs: DataFrame, shards: int, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """One slim row per document with its grid coordinates and its fine bucket."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("__crc"),
        F.xxhash64(text).alias("__th"),
        F.col(source_col).cast("string").alias("__source"),
        F.col(lang_col).cast("string").alias("__lang"),
    )
    slim = written(slim, "shard-docs")
    # A group's coordinates; a heavy group falls into parts.
    group = slim.groupBy("__th", "__crc", "__size").agg(F.count("*").alias("n"), F.min("__source").alias("__source"), F.min("__lang").alias("__lang"))
    total = written(slim.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("total"), F.coalesce(F.max("__size"), F.lit(1)).alias("longest")), "shard-total")
    share = F.col("n") * F.col("__size") * F.lit(shards * PARTS) / F.col("total")
    group = group.crossJoin(F.broadcast(total)).withColumn("__parts", F.when((F.col("n") > 1) & (share > 1), F.ceil(share)).otherwise(F.lit(1)))  # total is one row
    length = F.least(F.lit(STEPS - 1), F.floor(F.log2(F.col("__size").cast("double")) / F.greatest(F.log2(F.col("longest").cast("double")), F.lit(1.0)) * (STEPS - 1)))
    group = written(group.withColumn("__g0", length.cast("int")).drop("n", "total", "longest"), "shard-groups")
    for name, out in (("__source", "__g1"), ("__lang", "__g2")):
        r = _rank(group, name, out)
        group = group.join(r, (F.coalesce(group[name], F.lit("")) == r["k"]) & (group[name].isNull() == r["none"])).drop("k", "none", name)
    points = slim.drop("__source", "__lang").join(group, ["__th", "__crc", "__size"])
    part = F.when(F.col("__parts") > 1, F.pmod(F.xxhash64("__id", F.lit("part")), F.col("__parts"))).otherwise(F.lit(0))
    fine = F.pmod(F.xxhash64("__th", "__crc", part), F.lit(FINE)).cast("int")
    points = points.withColumn("__fine", fine).withColumn("__node", F.lit(0)).withColumn("__due", F.lit(shards))
    return written(points.drop("__parts"), "shard-points")


def _nearest(hist: DataFrame, step: str, keep: list[str]) -> DataFrame:
    """Per node, the step where the running weight first reaches the goal; rest: what of the goal is left before it."""
    upto = W.partitionBy("__node").orderBy(step)
    cum = hist.withColumn("cum", F.sum("w").over(upto)).filter(F.col("cum") >= F.col("goal"))
    return cum.groupBy("__node", *keep).agg(F.min(step).alias("at"), F.min_by(F.col("goal") - (F.col("cum") - F.col("w")), F.col(step)).alias("rest"))


def _split(points: DataFrame) -> DataFrame:
    """Splits every node that is due more than one shard; node numbers are the first shard that a node is due."""
    open_ = points.filter(F.col("__due") > 1)
    widths = [(F.max(d) - F.min(d)) for d in DIMS]
    nodes = open_.groupBy("__node", "__due").agg(F.sum("__size").alias("w"), *[w.alias(f"w{i}") for i, w in enumerate(widths)])
    widest = F.greatest(*[F.col(f"w{i}") for i in range(len(DIMS))])
    dim = F.coalesce(*[F.when(F.col(f"w{i}") == widest, F.lit(i)) for i in range(len(DIMS))])
    half = F.floor(F.col("__due") / 2)
    nodes = written(nodes.select("__node", dim.alias("dim"), (F.col("w") * half / F.col("__due")).alias("goal")), "shard-nodes")
    at = F.element_at(F.array(*DIMS), F.col("dim") + 1)
    placed = open_.join(nodes, "__node").withColumn("g", at)
    coarse = written(_nearest(placed.groupBy("__node", "dim", "goal", "g").agg(F.sum("__size").alias("w")), "g", ["dim"]), "shard-steps")
    inside = placed.select("__node", "g", "__fine", "__size").join(coarse.select("__node", F.col("at").alias("g"), "rest"), ["__node", "g"])
    upto = W.partitionBy("__node").orderBy("__fine")
    cum = inside.groupBy("__node", "rest", "__fine").agg(F.sum("__size").alias("w")).withColumn("cum", F.sum("w").over(upto))
    fine = cum.filter(2 * F.col("cum") - F.col("w") <= 2 * F.col("rest")).groupBy("__node").agg(F.max("__fine").alias("last"))
    cuts = written(coarse.join(fine, "__node", "left").select("__node", "dim", "at", F.coalesce("last", F.lit(-1)).alias("last")), "shard-cuts")
    discard(nodes, coarse)
    right = (at > F.col("at")) | ((at == F.col("at")) & (F.col("__fine") > F.col("last")))
    split = points.join(cuts, "__node", "left").withColumn("right", F.coalesce(right, F.lit(False)))
    due = F.when(F.col("__due") == 1, F.lit(1)).otherwise(F.when(F.col("right"), F.col("__due") - half).otherwise(half))
    node = F.when(F.col("right"), F.col("__node") + half).otherwise(F.col("__node"))
    return split.select("__id", "__size", "__crc", "__th", *DIMS, "__fine", node.cast("int").alias("__node"), due.cast("int").alias("__due"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: its shard, and its gapless slot there; the shards' bytes are near equal."""
    points = _points(docs, shards, id_col, text_col, source_col, lang_col)
    for _ in range(max(0, shards - 1).bit_length()):
        points = _split(points)
    spread = F.xxhash64("__id", "__th", "__crc")
    placed = written(points.select("__id", "__size", "__crc", "__th", F.col("__node").alias("shard"), spread.alias("__spread"), F.pmod(spread, F.lit(STEPS)).cast("int").alias("__b")), "shard-placed")
    before = W.partitionBy("shard").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__b").agg(F.count("*").alias("n")).select("shard", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = written(starts, "shard-starts")
    nth = F.row_number().over(W.partitionBy("shard", "__b").orderBy("__spread", "__id", "__size", "__crc"))
    out = placed.withColumn("nth", nth).join(starts, ["shard", "__b"])
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

