"""Cosines with a vocabulary, and the best tags."""

from __future__ import annotations

import numpy as np
import pytest

from rankfold.operators import tags as G


def frames(spark, x, t):
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(-1, [0.0] * x.shape[1]), (-2, None)], "vec_id long, embedding array<double>")
    vocabulary = spark.createDataFrame([(3 * k, f"t{k}", v.tolist()) for k, v in enumerate(t)] + [(9999, "blank", [0.0] * x.shape[1])], "tag_no long, tag string, embedding array<double>")
    return items, vocabulary


def brute(x, t, threshold=None, most=15):
    s = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T, 9)
    out = {}
    for k, row in enumerate(s):
        order = sorted((j for j in range(len(t)) if row[j] >= (0.0 if threshold is None else threshold)), key=lambda j: (-row[j], j))
        if order := order if threshold is not None else order[:most]:
            out[k] = ", ".join(f"t{j}" for j in order)
    return out


def data(seed, n, m, dims=6):
    r = np.random.default_rng(seed)
    t = r.normal(size=(m, dims))
    t[m // 2] = 2 * t[1]  # the same direction twice
    return r.normal(size=(n, dims)), t


@pytest.mark.parametrize(("threshold", "limit"), [(None, 64 << 20), (0.6, 64 << 20), (None, 4000), (0.6, 4000), (2.0, 4000)])
def test_best_tags_equal_brute_force(spark, monkeypatch, threshold, limit):
    """Also with a vocabulary in many parts."""
    monkeypatch.setattr(G, "LIMIT", limit)
    x, t = data(1, 150, 220)
    items, vocabulary = frames(spark, x, t)
    got = {r.vec_id: r.tags for r in G.best_tags(items, vocabulary, threshold=threshold).collect()}
    assert got == brute(x, t, threshold)


def test_groups_are_left_out(spark):
    """Tags in tight groups: most cosines aren't computed."""
    r = np.random.default_rng(2)
    heads = r.normal(size=(40, 12))
    t = np.repeat(heads, 50, axis=0) + 0.02 * r.normal(size=(2000, 12))
    x = heads[r.integers(0, 40, 300)] + 0.02 * r.normal(size=(300, 12))
    items, vocabulary = frames(spark, x, t)
    counter = spark.sparkContext.accumulator(0)
    got = {k.vec_id: k.tags for k in G.best_tags(items, vocabulary, counter=counter).collect()}
    assert got == brute(x, t)
    assert 0 < counter.value < 0.5 * 300 * 2000


def test_plans_have_no_cross_join(spark, capsys):
    items, vocabulary = frames(spark, *data(3, 10, 10))
    for df in (G.best_tags(items, vocabulary), G.tag_similarity(items, vocabulary)):
        df.explain()
        shown = capsys.readouterr().out
        assert "Cartesian" not in shown and "NestedLoop" not in shown and "MapInArrow" in shown


def test_similarities_and_empty_frames(spark):
    x, t = data(4, 20, 30)
    items, vocabulary = frames(spark, x, t)
    rows = G.tag_similarity(items, vocabulary).collect()
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T
    assert len(rows) == 600 and all(abs(r.similarity - s[r.vec_id, r.tag_no // 3]) < 1e-12 and r.tag == f"t{r.tag_no // 3}" for r in rows)
    for a, b in ((items.limit(0), vocabulary), (items, vocabulary.limit(0))):
        assert G.best_tags(a, b).count() == 0 and G.tag_similarity(a, b).count() == 0
