"""Exact k-means over whole-number vectors, by Shallot search.

Every vector remembers its centroid and its second-nearest one, an upper bound of its distance to the first and a lower
bound of that to all others. A round moves the bounds by what the centroids moved; where they still keep the vector in
its cluster, no distance is computed. Otherwise the distances to the two remembered centroids are computed, the scan
starts from the closer one, and goes through the other centroids in the order of their distance from it, inside a ball
whose radius (the distance to the start plus that to the second-nearest so far) shrinks with every closer find. What the
ball doesn't rule out is compared by squared distances in 64-bit integers; a smaller centroid number wins a tie, for
bounds only rule out what is farther by more than their rounding.

State (vector, the two centroids, the bounds) is a table written once a round, the older one deleted; a round shuffles
nothing but sums of k clusters, combined in every task. Centroids (k rows) are all that reaches the driver.

Edge cases: vectors that are null, of another length, or hold a null or a value that isn't finite are left out; values
beyond +-LARGEST (after scaling) count as that, so that squared distances fit into 64 bits; with fewer than k vectors
there are fewer centroids; repeated rows count as often as they occur, and of equal ids the vectors order the starts; a
null id's hash comes last; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, written

LARGEST = 1 << 27
#: Relative rounding of the bounds, far above that of doubles.
SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Assigns vectors to the nearest of some centroids; `computed` counts distances between a vector and a centroid."""

    def __init__(self, centroids: np.ndarray):
        self.c, self.k, self.computed = centroids.astype(np.int64), len(centroids), 0
        diff = self.c[:, None, :] - self.c[None, :, :]
        self.between = np.sqrt((diff * diff).sum(2).astype(float))
        self.order = np.argsort(self.between, axis=1, kind="stable")
        # A centroid's own place in its order is the first, also among equal centroids.
        for a in range(self.k):
            row = self.order[a].tolist()
            row.remove(a)
            self.order[a] = [a, *row]
        self.half = np.array([self.between[a, self.order[a, 1]] / 2 for a in range(self.k)]) if self.k > 1 else np.full(self.k, np.inf)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Without bounds: distances to all centroids. Returns nearest, second, upper and lower bound."""
        n = len(x)
        d1, d2 = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        a, b = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for j in range(self.k):
            self._offer(np.arange(n), np.full(n, j, np.int32), squared(x, self.c[j]), a, b, d1, d2)
        self.computed += n * self.k
        return a, b, np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float)) if self.k > 1 else np.full(n, np.inf)

    @staticmethod
    def _offer(rows, j, d, a, b, d1, d2) -> None:
        """Takes centroid j at squared distance d as nearest or second of the rows; ties go to smaller numbers."""
        wins = (d < d1[rows]) | ((d == d1[rows]) & (j < a[rows]))
        w = rows[wins]
        b[w], d2[w] = a[w], d1[w]
        a[w], d1[w] = j[wins], d[wins]
        rest = ~wins & ((d < d2[rows]) | ((d == d2[rows]) & (j < b[rows])))
        r = rows[rest]
        b[r], d2[r] = j[rest], d[rest]

    def again(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, up: np.ndarray, low: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """With the state of the round before and what each centroid has moved since."""
        if self.k == 1:
            return a, b, up + moved[a], low
        a, b, up, low = a.copy(), b.copy(), up + moved[a], low.copy()
        top = np.argsort(-moved, kind="stable")[:2]
        low -= np.where(a == top[0], moved[top[1]], moved[top[0]])
        stay = up * (1 + SLACK) < np.maximum(low, self.half[a]) * (1 - SLACK)
        todo = np.flatnonzero(~stay)
        if not len(todo):
            return a, b, up, low
        p, s0, s1 = x[todo], a[todo], b[todo]
        da, db = squared(p, self.c[s0]), squared(p, self.c[s1])
        self.computed += 2 * len(todo)
        swap = (db < da) | ((db == da) & (s1 < s0))
        na, nb = np.where(swap, s1, s0).astype(np.int32), np.where(swap, s0, s1).astype(np.int32)
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        start, reach = na.copy(), np.sqrt(d1.astype(float))
        tried0, tried1 = s0, s1
        live = np.arange(len(todo))
        for step in range(1, self.k):
            j = self.order[start[live], step]
            # Whoever is nearer than the second so far lies in this ball around the start; later ones lie farther out.
            inside = self.between[start[live], j] * (1 - SLACK) <= (reach[live] + np.sqrt(d2[live].astype(float))) * (1 + SLACK)
            live, j = live[inside], j[inside]
            if not len(live):
                break
            new = (j != tried0[live]) & (j != tried1[live])
            rows, at = live[new], j[new].astype(np.int32)
            if len(rows):
                self._offer(rows, at, squared(p[rows], self.c[at]), na, nb, d1, d2)
                self.computed += len(rows)
        a[todo], b[todo], up[todo], low[todo] = na, nb, np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))
        return a, b, up, low


STATE = "id {kind}, v array<int>, a int, b int, up double, low double"


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _state(batch: pa.RecordBatch, parts: tuple) -> pa.RecordBatch:
    a, b, up, low = parts
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(up, pa.float64()), pa.array(low, pa.float64())], names=["id", "v", "a", "b", "up", "low"])


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors of `dims` finite components; native."""
    x = F.col(vector_col)
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    limit = F.lit(float(LARGEST))
    whole = F.transform(x, lambda c: F.floor(F.greatest(-limit, F.least(limit, c.cast("double") * scale))).cast("int"))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]]]:
    """Count and component sums of the k clusters: each task adds up its own, one shuffle of sums adds up the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, x = batch.column("a").to_numpy(zero_copy_only=False), _matrix(batch, dims)
            o = np.argsort(a, kind="stable")
            own, at = np.unique(a[o], return_index=True)
            if len(own):
                s = np.column_stack([np.add.reduceat(x[o], at, axis=0), np.diff(np.append(at, len(a)))])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(own)), pa.int32()), pa.array(s.ravel(), pa.int64())], names=["a", "j", "s"])

    sums = [[0] * dims for _ in range(k)]
    n = np.zeros(k, np.int64)
    for a, j, s in state.select("a", "v").mapInArrow(add, "a int, j int, s long").groupBy("a", "j").agg(F.sum("s")).collect():  # k * (dims + 1) rows
        if j == dims:
            n[a] = s
        else:
            sums[a][j] = s
    return n, sums


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    spark = rows.sparkSession
    ship(spark)
    d = whole_vectors(rows, id_col, vector_col, dims, scale)
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    c = np.array([r.v for r in d.orderBy(h.asc_nulls_last(), "v").limit(k).collect()], np.int64).reshape(-1, dims)  # k rows
    kind = dict(d.dtypes)["id"]
    schema = STATE.format(kind=kind)
    if not len(c):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def begin(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
        search = Search(c)
        for batch in batches:
            yield _state(batch, search.first(_matrix(batch, dims)))

    state = written(d.mapInArrow(begin, schema), "clusters-0")
    for number in range(1, rounds + 1):
        new = c.copy()
        n, sums = _sums(state, len(c), dims)
        for a in np.flatnonzero(n):
            new[a] = [s // int(n[a]) for s in sums[a]]
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + SLACK)
        c = new

        def step(batches: Iterator[pa.RecordBatch], c=c, moved=moved) -> Iterator[pa.RecordBatch]:
            search = Search(c)
            for batch in batches:
                old = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "up", "low")]
                yield _state(batch, search.again(_matrix(batch, dims), *old, moved))

        before, state = state, written(state.mapInArrow(step, schema), f"clusters-{number}")
        discard(before)

    def finish(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("a"), pa.array(squared(_matrix(batch, dims), c[a]), pa.int64())], names=["id", "cluster", "distance"])

    final = written(state.select("id", "v", "a").mapInArrow(finish, f"id {kind}, cluster int, distance long"), "clusters-final")
    discard(state)
    inertia = dict(final.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    total = sum(inertia.values())
    own = [(a, s, total, hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest()) for a, s in sorted(inertia.items())]
    summed = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(summed), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
