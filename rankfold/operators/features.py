"""Features: pluggable embedders, incremental embedding, lifetimes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words whose hashes an embedder remembers.
WORDS = 1 << 17


class Embedder(Protocol):
    """What a module brings along: a version that invalidates old vectors, and the vectors of a batch of texts."""

    dims: int
    version: str

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class HashingEmbedder:
    """Counts of hashed words, unit length: the default where no pretrained model is at hand."""

    def __init__(self, dims: int = 64):
        self.dims, self.version = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out, known = [], {}
        for t in texts:
            words = t.lower().split()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
            if len(known) > WORDS:
                known = {}
            v = np.bincount((h % np.uint64(self.dims)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dims)
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out


class FixedEmbedder:
    """Vectors of known texts; others can't be embedded."""

    def __init__(self, known: dict[str, list[float]]):
        self.known, self.dims, self.version = known, len(next(iter(known.values()))), "fixed"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        if unknown := [t for t in texts if t not in self.known]:
            raise ValueError(f"unknown text: {unknown[0][:40]}")
        return [np.array(self.known[t]) for t in texts]


def _alone(embedder: Embedder, text: str) -> np.ndarray:
    try:
        return embedder.embed([text])[0]
    except ValueError:
        return np.zeros(embedder.dims)


def embedded(items: DataFrame, embedder: Embedder, key: str, text: str) -> DataFrame:
    """(key, embedding, version); what can't be embedded gets a zero vector, which counts as missing."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            try:
                vectors = embedder.embed(texts)
            except ValueError:
                # One at a time: only what fails by itself counts as missing.
                vectors = [_alone(embedder, t) for t in texts]
            yield pd.DataFrame({key: pdf[key], "embedding": [v.tolist() for v in vectors], "version": embedder.version})

    return items.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>, version string")


def embed_missing(items: DataFrame, features: DataFrame, embedder: Embedder, key: str, text: str, cap: int | None = None) -> DataFrame:
    """The features with those of items added that had none of the embedder's version."""
    blank = F.forall("embedding", lambda x: x == 0)
    current = features.filter((F.col("version") == embedder.version) & ~blank)  # zero vectors are tried again
    missing = items.join(current.select(key), key, "left_anti")
    if cap is not None:
        missing = missing.orderBy(key).limit(cap)
    return current.select(key, "embedding", "version").unionByName(embedded(missing, embedder, key, text))


def feature_ttl(features: DataFrame, now: str, ttl_seconds: int = 90 * 86400) -> DataFrame:
    """Drops expired rows; a read refreshes rows older than a quarter of their lifetime. features: (.., written, read bool)."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("written")
    refreshed = F.col("read") & (age >= max(1, ttl_seconds // 4))
    live = features.filter(age <= ttl_seconds)
    return live.withColumns({"refreshed": refreshed, "written": F.when(refreshed, F.lit(now).cast("timestamp")).otherwise(F.col("written"))})


def padded(sequences: DataFrame, key: str, column: str, batch: str, most: int | None = 512, fill: Column | None = None) -> DataFrame:
    """(key, batch, values, mask): cut to `most` (None: whole), padded with `fill` (0) to the longest of the batch; mask is true on padding."""
    cut = sequences.select(key, batch, (F.col(column) if most is None else F.slice(column, 1, most)).alias("values"))
    width = cut.groupBy(batch).agg(F.max(F.size("values")).alias("width"))
    rows = cut.join(width, batch)
    pad = F.col("width") - F.size("values")
    fill = F.lit(0).cast("long") if fill is None else fill
    return rows.select(key, batch, F.concat("values", F.array_repeat(fill, pad)).alias("values"), F.concat(F.transform("values", lambda x: F.lit(False)), F.array_repeat(F.lit(True), pad)).alias("mask"))
