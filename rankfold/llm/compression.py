"""Quality classifier by compression: dictionaries built from good and from bad text, the difference in size as score.

A zstandard dictionary is built from pieces of good labelled texts and another from pieces of bad ones. Every whole text
is cut into pieces of PIECE bytes, each is compressed with either dictionary, and the difference of the two sizes over
the piece's length says whose language it speaks. A logistic curve calibrates the differences (of the whole text, of its
worst piece and its worst three, for junk may fill a part only), the compressed size itself (repetitive pieces shrink
most) and the length into the probability of label 1.

Bounded samples: labels of at most SAMPLE rows, in the order of a hash of their id; at most PIECES pieces a label build
its dictionary, spread over whole texts, and the curve is fitted on at most SAMPLE rows of numbers, both in hash order.
Only these pieces, two dictionaries of SIZE bytes and the numbers meet on the driver, however often an id is repeated.

Edge cases: null and empty texts are one empty piece and get the score of no difference; without training rows of both
kinds there are no dictionaries and all scores are the share of label 1 among the training rows, 0.5 if there are none;
a null id is never held out and has no label; repeated rows score alike; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, written
from .toxicity import logistic

#: Labelled rows, pieces a label, bytes of a piece and of a dictionary, pieces that one text gives at most.
SAMPLE, PIECES, PIECE, SIZE, OF_A_TEXT = 12_000, 4_000, 512, 32_768, 16
LEVEL = 3
#: Shorter pieces count as so long, so that a few bytes don't make a large share; pieces under it aren't called repetitive.
LEAST = 64
#: A compressed share below which a piece is repetitive.
DENSE = 0.35

INPUTS = ("difference", "excess", "worst", "worst_three", "repetitive", "share", "length")


def pieces(text: bytes) -> list[bytes]:
    """The whole text, in order; an empty one is one empty piece."""
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)] or [b""]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(SIZE, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-SIZE:]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def inputs(text: bytes, good: Callable[[bytes], bytes], bad: Callable[[bytes], bytes]) -> tuple[float, ...]:
    """The INPUTS of one whole text."""
    parts = pieces(text)
    size = np.array([(len(good(p)), len(bad(p)), len(p)) for p in parts], float)
    g, b, n = size.T
    long = np.maximum(n, LEAST)
    rates = np.sort((g - b) / long)[::-1]
    total = max(float(n.sum()), float(LEAST))
    difference = float((g - b).sum()) / total
    densest = float(np.where(n >= LEAST, np.minimum(g, b) / long, 1.0).min())
    return (10 * difference, 10 * max(difference, 0.0), 10 * float(rates[0]), 10 * float(rates[:3].mean()), 10 * max(DENSE - densest, 0.0), 3 * float(g.sum()) / total, float(np.log1p(n.sum())) / 10)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(h, t, y): the texts of at most SAMPLE labels whose rows aren't held out."""
    sample = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")  # SAMPLE rows of two numbers
    return rows.select(F.xxhash64("id").alias("h"), "t", F.col("y").cast("int").alias("y"))


def learn(train: DataFrame) -> tuple[bytes, bytes] | None:
    """The dictionaries of good and of bad text; None if a kind is missing."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, y, at, part = [], [], [], []
            for key, text, label in zip(batch.column("h").to_pylist(), batch.column("t").cast(pa.binary()), batch.column("y").to_pylist(), strict=True):
                every = pieces(text.as_py() or b"")
                for k in sorted({j * len(every) // OF_A_TEXT for j in range(OF_A_TEXT)}):
                    h.append(key), y.append(label), at.append(k), part.append(every[k])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(part, pa.binary())], names=["h", "y", "k", "piece"])

    rows = train.mapInArrow(spread, "h long, y int, k int, piece binary").filter(F.octet_length("piece") >= 8)
    samples = []
    for label in (1, 0):
        # Written first: the cut is made by a shuffle of every task's best, not by the driver, which gets PIECES of PIECE bytes.
        chosen = written(rows.filter(F.col("y") == label).select("piece", F.xxhash64("h", "k").alias("o"), "h", "k").orderBy("o", "h", "k", "piece").limit(PIECES), "compression-pieces")
        samples.append([bytes(r.piece) for r in sorted(chosen.collect(), key=lambda r: (r.o, r.h, r.k, bytes(r.piece)))])
        discard(chosen)
    return (dictionary(samples[0]), dictionary(samples[1])) if all(samples) else None


def with_inputs(df: DataFrame, keep: str, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    """(keep, INPUTS) of the texts t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = map(compressor, dictionaries)
        for batch in batches:
            rows = [inputs(t.as_py() or b"", good, bad) for t in batch.column("t").cast(pa.binary())]
            cols = np.array(rows, float).reshape(-1, len(INPUTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(keep), *(pa.array(c, pa.float64()) for c in cols)], names=[keep, *INPUTS])

    return df.select(keep, "t").mapInArrow(run, ", ".join([f"{keep} {dict(df.dtypes)[keep]}", *(f"{c} double" for c in INPUTS)]))


def calibrate(train: DataFrame, dictionaries: tuple[bytes, bytes]) -> list[float]:
    """Weights of the intercept and the INPUTS."""
    rows = with_inputs(train.withColumn("hy", F.struct("h", "y")), "hy", dictionaries).select("hy.*", *INPUTS)
    rows = rows.orderBy("h", "y", *INPUTS).limit(SAMPLE).toPandas()  # numbers; sums don't depend on the order of partitions
    x = np.column_stack([np.ones(len(rows)), rows[list(INPUTS)].to_numpy(float)])
    return [float(v) for v in logistic(x, rows["y"].to_numpy(float))]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: whether its label was held out, the probability of label 1, and the prediction."""
    ship(docs.sparkSession)
    train = written(training(docs, labels, id_col, text_col, label_col), "compression-train")
    dictionaries = learn(train)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if dictionaries is None:
        share = train.agg(F.avg("y")).first()[0]
        d = d.withColumn("score", F.lit(0.5 if share is None else float(share)))
    else:
        w = calibrate(train, dictionaries)
        z = F.lit(w[0])
        for weight, name in zip(w[1:], INPUTS, strict=True):
            z = z + weight * F.col(name)
        d = with_inputs(d, "id", dictionaries).withColumn("score", 1 / (1 + F.exp(-z)))
    discard(train)
    return d.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
