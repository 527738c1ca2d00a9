"""Cosines of items with a vocabulary of tags: matrix products per Arrow batch, best tags kept in bounded memory.

The vocabulary is broadcast in parts of at most LIMIT bytes. Inside a part, tags lie in groups around leaders (tags chosen
by number); an item's cosine with a leader and the group's widest angle bound its cosine with every tag of the group, so
groups that can't reach an item's `most`-th best tag so far, or the threshold, are left out. What remains is one matrix
product for each group, best groups first. An item never has more than its best tags in memory.

Similarities are compared after rounding to nine digits, ties by tag number. Edge cases: items without a vector have no
rows; tags without one are never found; an empty vocabulary or table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Bytes of a part of the vocabulary's matrix that is broadcast.
LIMIT = 64 << 20
ROWS = 1024


class Vocabulary:
    """Unit vectors of tags in groups around leaders, with each group's widest angle."""

    def __init__(self, numbers: list[int], names: list[str], matrix: np.ndarray):
        self.numbers, self.names = np.array(numbers), names
        unit = matrix / np.sqrt((matrix * matrix).sum(1))[:, None]
        n = len(unit)
        self.leaders = unit[:: max(1, math.isqrt(n))]
        near = (unit @ self.leaders.T).argmax(1)
        self.groups = [np.flatnonzero(near == g) for g in range(len(self.leaders))]
        self.units = [unit[g] for g in self.groups]
        self.width = np.array([np.arccos(np.clip((u @ lead).min(), -1, 1)) if len(u) else 0.0 for u, lead in zip(self.units, self.leaders, strict=True)])

    def best(self, x: np.ndarray, most: int | None, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each row of x (unit length) the places of its tags, best first, their rounded cosines times 1e9, and the number of cosines computed."""
        n = len(self.names)
        angle = np.arccos(np.clip(x @ self.leaders.T, -1, 1))
        bound = np.cos(np.maximum(0.0, angle - self.width[None, :])) + 1e-9
        least = np.full(len(x), threshold - 5e-10)
        # A row's tags are integers that sort by rounded cosine, then by number: unique, so no tie is left to chance.
        top: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        computed = len(x) * len(self.leaders)
        for g in np.argsort(-bound.mean(0), kind="stable"):
            if not len(self.groups[g]):
                continue
            rows = np.flatnonzero(bound[:, g] >= least)
            if not len(rows):
                continue
            s = x[rows] @ self.units[g].T
            computed += s.size
            keys = np.rint(s * 1e9).astype(np.int64) * n + (n - 1 - self.groups[g])[None, :]
            for r, own, score in zip(rows, keys, s, strict=True):
                fit = own[score >= least[r]]
                if not len(fit):
                    continue
                all_ = np.concatenate([top[r], fit])
                if most is not None and len(all_) > most:
                    all_ = np.partition(all_, len(all_) - most)[len(all_) - most :]
                    least[r] = max(least[r], (all_.min() // n) * 1e-9 - 1e-9)
                top[r] = all_
        floor = math.ceil(round(threshold * 1e9, 3)) * n
        top = [-np.sort(-t[t >= floor]) for t in top]
        return [n - 1 - t % n for t in top], [t // n for t in top], computed


def _parts(tags: DataFrame) -> Iterator[Vocabulary]:
    rows = tags.filter(~V.is_unindexed(F.col("embedding"))).select(F.col("tag_no").cast("long").alias("no"), "tag", "embedding")
    n, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = -(-n * (dims or 1) * 8 // LIMIT)
    for p in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("no"), F.lit(parts)) == p).orderBy("no", "tag").collect()  # about LIMIT bytes
        if own:
            yield Vocabulary([r.no for r in own], [r.tag for r in own], np.array([r.embedding for r in own], float))


def _units(items: DataFrame, key: str) -> DataFrame:
    v = F.col("embedding")
    return items.filter(~V.is_unindexed(v)).select(F.col(key).alias("k"), v.alias("v"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
        yield part.column("k"), x / np.sqrt((x * x).sum(1))[:, None]


def tag_similarity(items: DataFrame, tags: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, tag_no, tag, similarity): the cosine of every item with every tag, as asked for; for the best ones see best_tags."""
    kind, out = dict(items.dtypes)[key], None
    for vocabulary in _parts(tags):
        shared = items.sparkSession.sparkContext.broadcast(vocabulary)  # LIMIT bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v = shared.value
            for batch in batches:
                for keys, x in _rows(batch):
                    for own, units in zip(v.groups, v.units, strict=True):
                        if len(own):
                            row, col = np.repeat(np.arange(len(x)), len(own)), np.tile(own, len(x))
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(v.numbers[col], pa.int64()), pa.array(v.names).take(pa.array(col)), pa.array((x @ units.T).ravel())], names=["k", "tag_no", "tag", "similarity"])

        part = _units(items, key).mapInArrow(run, f"k {kind}, tag_no long, tag string, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.sparkSession.createDataFrame([], f"k {kind}, tag_no long, tag string, similarity double")
    return out.select(F.col("k").alias(key), F.col("tag_no").cast(dict(tags.dtypes)["tag_no"]).alias("tag_no"), "tag", "similarity")


def best_tags(items: DataFrame, tags: DataFrame, key: str = "vec_id", threshold: float | None = None, most: int = 15, counter: Accumulator | None = None) -> DataFrame:
    """(key, tags): best first, joined by commas; without a threshold the best 15 that aren't negative, else all that reach it."""
    kind, parts = dict(items.dtypes)[key], []
    many, least = (most, 0.0) if threshold is None else (None, threshold)
    for vocabulary in _parts(tags):
        shared = items.sparkSession.sparkContext.broadcast(vocabulary)  # LIMIT bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v = shared.value
            names = pa.array(v.names, pa.string())
            for batch in batches:
                for keys, x in _rows(batch):
                    places, scores, n = v.best(x, many, least)
                    if counter is not None:
                        counter.add(n)
                    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
                    at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]), pa.int32())
                    fields = [pa.array(-np.concatenate(scores), pa.int64()), pa.array(v.numbers[flat], pa.int64()), names.take(pa.array(flat))]
                    found = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, names=["s", "no", "tag"]))
                    yield pa.RecordBatch.from_arrays([keys, found], names=["k", "found"])

        parts.append(_units(items, key).mapInArrow(run, f"k {kind}, found array<struct<s:long,no:long,tag:string>>"))
    if not parts:
        return items.sparkSession.createDataFrame([], f"`{key}` {kind}, tags string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(parts) > 1:
        merged = F.array_sort(F.flatten(F.collect_list("found")))
        out = out.groupBy("k").agg((F.slice(merged, 1, many) if many else merged).alias("found"))
    return out.filter(F.size("found") > 0).select(F.col("k").alias(key), F.array_join(F.transform("found", lambda x: x["tag"]), ", ").alias("tags"))
