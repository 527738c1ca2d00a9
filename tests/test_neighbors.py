"""Exact nearest neighbours over pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from rankfold.operators import neighbors


def brute(v: np.ndarray, keys: list[int]) -> dict[int, tuple[int, float]]:
    out = {}
    for a in range(len(v)):
        d = np.sqrt(((v[a] - v) ** 2).sum(1))
        j = min((x for x in range(len(v)) if x != a), key=lambda x: (d[x], keys[x]))
        out[keys[a]] = (keys[j], d[j])
    return out


def frame(spark, v, keys):
    return spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, v, strict=True)], "vec_id long, embedding array<double>")


def clustered(seed: int, n: int, centers: int = 40, dims: int = 8):
    r = np.random.default_rng(seed)
    return r.normal(0, 10, (centers, dims))[r.integers(0, centers, n)] + r.normal(0, 0.3, (n, dims))


@pytest.mark.parametrize(("kind", "block"), [("clusters", 64), ("noise", 100), ("grid", 50), ("one hot cell", 40), ("line", 30)])
def test_equals_brute_force(spark, kind, block):
    r = np.random.default_rng(7)
    v = {
        "clusters": lambda: clustered(1, 600), "noise": lambda: r.normal(size=(400, 16)), "grid": lambda: r.integers(0, 4, (300, 3)).astype(float),
        "one hot cell": lambda: np.concatenate([r.normal(0, 1e-3, (250, 4)) + 5, r.normal(0, 50, (50, 4))]), "line": lambda: np.arange(200.0)[:, None] ** 2,
    }[kind]()
    keys = r.permutation(10 * len(v))[: len(v)].tolist()
    got = {x.vec_id: (x.neighbor, x.distance) for x in neighbors.nearest_neighbor(frame(spark, v, keys), block=block).collect()}
    want = brute(v, keys)
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert np.allclose([got[k][1] for k in want], [want[k][1] for k in want])


def test_under_a_quarter_of_the_distances(spark):
    v = clustered(2, 3000)
    counter = spark.sparkContext.accumulator(0)
    got = {x.vec_id: x.neighbor for x in neighbors.nearest_neighbor(frame(spark, v, list(range(3000))), block=256, counter=counter).collect()}
    want = brute(v, list(range(3000)))
    assert got == {k: x[0] for k, x in want.items()}
    assert 0 < counter.value < 3000 * 2999 / 4


def test_copies_and_some_queries(spark):
    """A third of the rows are one vector; they meet by a grouping, not by pairs. Only some items are asked for."""
    r = np.random.default_rng(3)
    v = np.concatenate([np.tile(r.normal(size=6), (300, 1)), r.normal(size=(600, 6))])
    keys = r.permutation(900).tolist()
    df = frame(spark, v, keys)
    want = brute(v, keys)
    counter = spark.sparkContext.accumulator(0)
    got = {x.vec_id: (x.neighbor, x.distance) for x in neighbors.nearest_neighbor(df, block=128, counter=counter).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    asked = [k for k in range(900) if k % 7 == 0]
    some = neighbors.nearest_neighbor(df, block=128, queries=spark.createDataFrame([(k,) for k in asked], "vec_id long")).collect()
    assert {x.vec_id: x.neighbor for x in some} == {k: want[k][0] for k in asked} and len(some) == len(asked)


def test_few_rows(spark):
    v = np.array([[1.0, 2.0], [1.0, 2.0], [4.0, 6.0]])
    df = frame(spark, v, [5, 3, 9]).union(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, neighbors.nearest_neighbor(df).collect())) == [(3, 5, 0.0), (5, 3, 0.0), (9, 3, 5.0)]
    assert neighbors.nearest_neighbor(df.filter("vec_id = 9")).count() == 0 and neighbors.nearest_neighbor(df.limit(0)).count() == 0


def test_routes_go_by_bundles(spark):
    """Directions that no bound tells apart: an item is compared with everything about once, in bundles."""
    v = np.random.default_rng(8).normal(size=(3000, 32))
    counter = spark.sparkContext.accumulator(0)
    got = {x.vec_id: x.neighbor for x in neighbors.nearest_neighbor(frame(spark, v, list(range(3000))), block=64, counter=counter).collect()}
    assert got == {k: x[0] for k, x in brute(v, list(range(3000))).items()}
    assert counter.value < 1.5 * 3000 * 3000
    assert max(len(p) for p in neighbors._parts(iter([pd.DataFrame({"i": range(5000)})]))) <= neighbors.PART


def test_lsh_on_near_copies_and_strangers(spark, monkeypatch):
    """Near copies meet in buckets, strangers whose neighbours are far go to the exact search: nine of ten are right, and few buckets are compared."""
    from rankfold.operators import search

    r = np.random.default_rng(12)
    v = r.normal(size=(3000, 64))
    v[2400:] = v[:600] + r.normal(0, 0.05, (600, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    asked = []
    exact = search.nearest_neighbor

    def watched(*a, queries=None, **k):
        asked.append(queries.count())
        return exact(*a, queries=queries, **k)

    monkeypatch.setattr(search, "nearest_neighbor", watched)
    got = {x.vec_id: x.neighbor for x in search.nearest_neighbor_lsh(frame(spark, v, list(range(3000)))).collect()}
    want = brute(v, list(range(3000)))
    assert set(got) == set(want) and np.mean([got[k] == want[k][0] for k in want]) >= 0.9
    assert asked[0] <= 1900
