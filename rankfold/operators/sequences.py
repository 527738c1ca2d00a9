"""A rater over sequences of vectors: an item's chunks, of any number, in the order of the text.

Gated attention (Ilse et al., 2018, "Attention-based deep multiple instance learning") weighs the chunks: every head
scores each vector, a softmax over the item's own chunks turns the scores into shares, and the weighted sums feed a small
perceptron over the eleven ratings. The prediction is the expected rating. Without learned places (places=0) the order of
chunks makes no difference; with them, chunks are told apart by their place on a doubling scale.

Training is gradient descent on all rows: in each epoch every task computes the loss's gradient of its padded batches, the
sums are added up in a tree, and the driver makes one Adam step on a parameter vector of fixed size. The weights of every
epoch are kept, with the accuracies that they reach on training and test rows, so the best epoch is one of a single run.

Every chunk of an item counts, however many there are; only a caller that names `most` has sequences cut to so many.

Edge cases: items without chunks are predicted 0 and not trained on; rows without a label aren't trained on; what a batch
is padded to makes no difference to any row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import stored
from .features import padded

CLASSES = 11


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; the parameters lie in one vector, in the order of `parts`."""

    dims: int
    hidden: int = 16
    heads: int = 2
    dense: int = 24
    places: int = 0
    scale: float = 1.0

    @property
    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "v": (self.dims, self.hidden), "u": (self.dims, self.hidden), "w": (self.hidden, self.heads), "place": (self.places, self.heads),
            "w1": (self.heads * self.dims, self.dense), "b1": (self.dense,), "w2": (self.dense, CLASSES), "b2": (CLASSES,),
        }

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts.values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts.items():
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out

    def start(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        parts = [r.normal(0, (1 / s[0]) ** 0.5, s) if len(s) == 2 and name != "place" else np.zeros(s) for name, s in self.parts.items()]
        return np.concatenate([p.ravel() for p in parts])


def forward(shape: Shape, flat: np.ndarray, x: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """x: [rows, chunks, dims], valid: [rows, chunks]. All that the gradient needs, and `p`, the classes' shares."""
    w = shape.split(flat)
    x = x * shape.scale
    t, g = np.tanh(x @ w["v"]), 1 / (1 + np.exp(-np.clip(x @ w["u"], -30, 30)))
    e = (t * g) @ w["w"]
    place = None
    if shape.places:
        place = np.minimum(np.log2(np.arange(x.shape[1]) + 1).astype(int), shape.places - 1)
        e = e + w["place"][place]
    e = np.where(valid[:, :, None], e, -np.inf)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    z = np.einsum("bsa,bsd->bad", a, x).reshape(len(x), -1)
    h = np.tanh(z @ w["w1"] + w["b1"])
    logits = h @ w["w2"] + w["b2"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    return {"x": x, "t": t, "g": g, "a": a, "z": z, "h": h, "p": p / p.sum(1, keepdims=True), "place": place}


def expected(p: np.ndarray) -> np.ndarray:
    return p @ np.arange(CLASSES)


def targets(label: np.ndarray) -> np.ndarray:
    """A rating between two classes is shared out between them."""
    y = np.clip(label, 0, CLASSES - 1)
    low = np.minimum(np.floor(y).astype(int), CLASSES - 2)
    out = np.zeros((len(y), CLASSES))
    out[np.arange(len(y)), low], out[np.arange(len(y)), low + 1] = low + 1 - y, y - low
    return out


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, valid: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the weighted cross entropies, its gradient, and the predictions."""
    w, f = shape.split(flat), forward(shape, flat, x, valid)
    y = targets(label)
    loss = float((weight * -(y * np.log(f["p"] + 1e-12)).sum(1)).sum())
    d_logits = (f["p"] - y) * weight[:, None]
    d_h = (d_logits @ w["w2"].T) * (1 - f["h"] ** 2)
    d_z = (d_h @ w["w1"].T).reshape(len(x), shape.heads, shape.dims)
    d_a = np.einsum("bad,bsd->bsa", d_z, f["x"])
    d_e = f["a"] * (d_a - (f["a"] * d_a).sum(1, keepdims=True))
    d_tg = d_e @ w["w"].T
    flat_x = f["x"].reshape(-1, shape.dims)
    d_place = np.zeros((shape.places, shape.heads))
    if shape.places:
        np.add.at(d_place, f["place"], d_e.sum(0))
    parts = {
        "v": flat_x.T @ (d_tg * f["g"] * (1 - f["t"] ** 2)).reshape(-1, shape.hidden), "u": flat_x.T @ (d_tg * f["t"] * f["g"] * (1 - f["g"])).reshape(-1, shape.hidden),
        "w": (f["t"] * f["g"]).reshape(-1, shape.hidden).T @ d_e.reshape(-1, shape.heads), "place": d_place,
        "w1": f["z"].T @ d_h, "b1": d_h.sum(0), "w2": f["h"].T @ d_logits, "b2": d_logits.sum(0),
    }
    return loss, np.concatenate([parts[name].ravel() for name in shape.parts]), expected(f["p"])


def _tensor(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat vectors of a batch of array<array<double>>, and how many each row has."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims), size


def _groups(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of equal length, in parts of bounded size."""
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        most = max(1, 8192 // max(1, int(n)))
        for k in range(0, len(rows), most):
            yield int(n), rows[k : k + most]


def sequences(chunks: DataFrame, key: str, order: str = "chunk_no", features: str = "features", most: int | None = None) -> DataFrame:
    """(key, sequence): all vectors of every item, or the first `most`, in order."""
    kept = chunks.filter(F.col(features).isNotNull()).select(key, F.struct(F.col(order).alias("o"), F.col(features).alias("f")).alias("c"), F.col(order).alias("o"))
    listed = F.array_sort(F.collect_list("c"))
    return (kept if most is None else kept.filter(F.col("o") < most)).groupBy(key).agg(F.transform(listed, lambda c: c["f"]).alias("sequence"))


def _cut(column: str, most: int | None) -> Column:
    return F.col(column) if most is None else F.slice(column, 1, most)


def batched(rows: DataFrame, key: str, dims: int, size: int = 256, most: int | None = None) -> DataFrame:
    """(key, values, mask) in padded batches of about one length: lengths on a doubling scale, dealt by hash into batches of about `size`."""
    n = F.size("sequence") if most is None else F.least(F.size("sequence"), F.lit(most))
    own = rows.filter(F.size("sequence") > 0).select(key, "sequence", F.ceil(F.log2(n.cast("double"))).cast("int").alias("class"))
    many = own.groupBy("class").agg((F.floor(F.count("*") / size) + 1).alias("many"))  # a row for each length class
    dealt = own.join(F.broadcast(many), "class").withColumn("batch", F.concat_ws(":", "class", F.pmod(F.xxhash64(key), "many")))
    return padded(dealt, key, "sequence", "batch", most, F.array_repeat(F.lit(0.0), dims)).select(key, "values", "mask")


class SequenceRater:
    def __init__(self, shape: Shape, flat: np.ndarray, most: int | None = None):
        self.shape, self.flat, self.most = shape, flat, most

    def predict(self, rows: DataFrame, sequence: str = "sequence") -> DataFrame:
        """Adds `prediction` in 0..10; rows without chunks get 0."""
        shape, flat, names = self.shape, self.flat, rows.columns
        at = len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, size = _tensor(batch.column(at), shape.dims)
                first, out = np.concatenate([[0], np.cumsum(size)]).astype(int), np.zeros(batch.num_rows)
                for n, own in _groups(size):
                    if n:
                        stack = x[first[own][:, None] + np.arange(n)]
                        out[own] = expected(forward(shape, flat, stack, np.ones((len(own), n), bool))["p"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out)], names=[*names, "prediction"])

        cut = F.coalesce(_cut(sequence, self.most), F.array().cast("array<array<double>>"))
        return rows.withColumn("__cut", cut).mapInArrow(run, StructType([*rows.schema.fields, StructField("prediction", DoubleType())]))


BLOCK = "n int, values binary, valid binary, label binary, weight binary, test binary"


def _blocks(batch: DataFrame, dims: int) -> DataFrame:
    """Rows of equal length as one row of numbers in bytes: epochs read them without unpacking lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, size = _tensor(b.column("values"), dims)
            valid = ~b.column("mask").flatten().to_numpy(zero_copy_only=False).astype(bool)
            first = np.concatenate([[0], np.cumsum(size)]).astype(int)
            y, weight, test = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "test"))
            for n, own in _groups(size):
                at = first[own][:, None] + np.arange(n)
                parts = [x[at], valid[at], y[own].astype(float), weight[own].astype(float), test[own].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["n", "values", "valid", "label", "weight", "test"])

    return batch.mapInArrow(run, BLOCK)


def _epoch(blocks: DataFrame, shape: Shape, flat: np.ndarray) -> np.ndarray:
    """Sums over all rows: of the training rows the gradient, loss, weight, error share and count; of the test rows error share and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.size + 6)
        for b in batches:
            for k, n in enumerate(b.column("n").to_pylist()):
                x, valid, y, weight, test = (np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in (("values", float), ("valid", bool), ("label", float), ("weight", float), ("test", bool)))
                loss, g, got = gradient(shape, flat, x.reshape(-1, n, shape.dims), valid.reshape(-1, n), y, np.where(test, 0.0, weight))
                off = np.abs(got - y) / (y + 1)
                total += np.concatenate([g, [loss, weight[~test].sum(), off[~test].sum(), (~test).sum(), off[test].sum(), test.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return blocks.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums)).treeReduce(np.add)


def train(rows: DataFrame, key: str = "id", weight: str | None = None, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4, seed: int = 1, most: int | None = None, **sizes) -> tuple[list[np.ndarray], Shape, DataFrame]:
    """rows: (key, sequence, label, split). The weights of every epoch, the shape, and the history (epoch, train, test)."""
    spark = rows.sparkSession
    known = rows.filter((F.size("sequence") > 0) & F.col("label").isNotNull())
    vectors = known.select(F.explode(_cut("sequence", most)).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    dims, mean = vectors.agg(F.max(F.size("x")), F.avg(squares / F.size("x"))).first()
    if dims is None:
        raise ValueError("no labelled sequence to train on")
    shape = Shape(dims, scale=float(mean or 1.0) ** -0.5, **sizes)
    labels = known.select(key, F.col("label").cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), (F.col("split") == "test").alias("test"))
    data = stored(_blocks(batched(known.select(key, "sequence"), key, dims, most=most).join(labels, key).select("values", "mask", "label", "weight", "test"), dims), "sequences")
    flat, m, v = shape.start(seed), np.zeros(shape.size), np.zeros(shape.size)
    kept, log = [], []
    for epoch in range(1, epochs + 1):
        sums = _epoch(data, shape, flat)
        g, (_, total, off, n, off_test, n_test) = sums[: shape.size], sums[shape.size :]
        kept.append(flat)
        log.append((epoch, *(float(1 / (1 + s / c)) if c else None for s, c in ((off, n), (off_test, n_test)))))
        g = g / max(total, 1e-9) + decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return kept, shape, spark.createDataFrame(log, "epoch int, train double, test double")


def train_best(rows: DataFrame, **options) -> tuple[SequenceRater, DataFrame]:
    """The rater of the epoch that is best on the test rows, and the history."""
    from .recommend import best_epoch

    kept, shape, history = train(rows, **options)
    best = best_epoch(history.fillna(0.0, ["test"])).first()["epoch"]
    return SequenceRater(shape, kept[best - 1], options.get("most")), history


def as_sequence(rows: DataFrame, features: str = "features") -> DataFrame:
    """Rows of one vector as sequences of one chunk."""
    return rows.withColumn("sequence", F.when(F.col(features).isNotNull(), F.array(features)))
