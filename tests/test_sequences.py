"""The rater over sequences of chunk vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import recommend
from rankfold.operators import sequences as Q


@pytest.mark.parametrize("places", [0, 3])
def test_gradient_equals_finite_differences(places):
    r = np.random.default_rng(3)
    shape = Q.Shape(5, hidden=4, heads=2, dense=6, places=places, scale=1.3)
    flat = shape.start(1) + 0.1 * r.normal(size=shape.size)
    x, valid = r.normal(size=(3, 6, 5)), np.arange(6)[None, :] < np.array([6, 1, 4])[:, None]
    y, weight = np.array([0.0, 7.4, 10.0]), np.array([1.0, 2.0, 0.5])
    _, g, _ = Q.gradient(shape, flat, x, valid, y, weight)
    for k in r.choice(shape.size, 60, replace=False):
        step = np.zeros(shape.size)
        step[k] = 1e-5
        up, down = (Q.gradient(shape, flat + s * step, x, valid, y, weight)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - g[k]) < 1e-4 * max(1, abs(g[k]))


def test_targets():
    assert Q.targets(np.array([0.0, 7.25, 10.0, 12.0])).sum(1).tolist() == [1] * 4
    assert np.allclose(Q.expected(Q.targets(np.array([0.0, 7.25, 10.0, -3.0]))), [0, 7.25, 10, 0])


@pytest.mark.parametrize("places", [0, 4])
def test_padding_and_order(places):
    r = np.random.default_rng(5)
    shape = Q.Shape(4, places=places)
    flat = shape.start(2) + 0.2 * r.normal(size=shape.size)
    x = r.normal(size=(1, 7, 4))
    alone = Q.forward(shape, flat, x, np.ones((1, 7), bool))["p"]
    wide = np.concatenate([x, 99 * r.normal(size=(1, 9, 4))], axis=1)
    assert np.allclose(alone, Q.forward(shape, flat, wide, np.arange(16)[None, :] < 7)["p"])
    turned = Q.forward(shape, flat, x[:, ::-1], np.ones((1, 7), bool))["p"]
    assert np.allclose(alone, turned) == (places == 0)


def needle(seed: int, n: int, dims: int = 8):
    """Items of 1 to 12 chunks; one chunk, marked by its first component, says the rating, the others are noise with any second one."""
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        rating = int(r.integers(0, 11))
        x = r.normal(0, 0.3, (int(r.integers(1, 13)), dims))
        x[:, 1] = r.uniform(-1, 1, len(x))
        at = int(r.integers(0, len(x)))
        x[at, 0], x[at, 1] = 3.0, rating / 5 - 1
        rows.append((k, x.tolist(), float(rating)))
    return rows


def test_beats_the_mean_vector(spark):
    rows = spark.createDataFrame(needle(1, 1500), "id long, sequence array<array<double>>, label double")
    split = recommend.train_test_split(rows, share=0.25).cache()
    mean = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x[j]) / F.size("sequence"))
    flat = Q.as_sequence(split.withColumn("features", mean).drop("sequence"))
    test = split.filter("split = 'test'")
    off = {}
    for name, data in (("chunks", split), ("mean", flat)):
        rater, history = Q.train_best(data, epochs=60, rate=0.03)
        held = test if name == "chunks" else flat.filter("split = 'test'")
        off[name] = recommend.rating_metrics(rater.predict(held), "prediction", "label").first().mae
        best = recommend.best_epoch(history).first()
        assert history.count() == 60 and best.test == max(r.test for r in history.collect()) and best.epoch > 1
    assert off["chunks"] < 1.2 and off["chunks"] < 0.6 * off["mean"]


def test_the_best_epoch_is_what_is_kept(spark):
    """Predictions of the weights kept reach the accuracy that the history states for their epoch."""
    split = recommend.train_test_split(spark.createDataFrame(needle(2, 200), "id long, sequence array<array<double>>, label double"), share=0.3)
    rater, history = Q.train_best(split, epochs=6)
    got = recommend.rating_metrics(rater.predict(split.filter("split = 'test'")), "prediction", "label").first().accuracy_2
    assert got == pytest.approx(max(r.test for r in history.collect()))


def test_batches_pad_to_their_longest(spark):
    rows = spark.createDataFrame([(k, [[float(k), 1.0]] * (k % 9)) for k in range(60)] + [(99, [[1.0, 2.0]] * 700)], "id long, sequence array<array<double>>")
    got = Q.batched(rows, "id", 2, size=8, most=512).collect()
    assert {r.id for r in got} == {k for k in range(60) if k % 9} | {99}
    for r in got:
        n = min(512, 700 if r.id == 99 else r.id % 9)
        assert len(r["values"]) == len(r["mask"]) < 2 * n + 1 and r["mask"] == [False] * n + [True] * (len(r["mask"]) - n)
        assert all(x == [0.0, 0.0] for x in r["values"][n:])


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 3.0, "train"), (2, [], 3.0, "test"), (3, [[1.0, 0.0]], None, "train"), (4, [[0.0, 1.0]] * 600, 9.0, "train"), (5, [[0.0, 1.0]], 9.0, "train")], "id long, sequence array<array<double>>, label double, split string")
    rater, history = Q.train_best(rows, epochs=3)
    assert [r.test for r in history.collect()] == [None] * 3
    out = {r.id: r.prediction for r in rater.predict(rows).collect()}
    assert out[1] == out[2] == 0.0 and all(0 < out[k] <= 10 for k in (3, 4, 5))
    assert out[4] == pytest.approx(out[5])
    assert rater.predict(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.train(rows.limit(0))


def test_sequences_are_in_order_and_cut(spark):
    chunks = spark.range(30).selectExpr("id % 2 AS id", "CAST(29 - id AS int) AS chunk_no", "IF(id = 7, NULL, array(CAST(id AS double))) AS features")
    got = {r.id: [x[0] for x in r.sequence] for r in Q.sequences(chunks, "id", most=10).collect()}
    assert got == {0: [28.0, 26.0, 24.0, 22.0, 20.0], 1: [29.0, 27.0, 25.0, 23.0, 21.0]}


def test_whole_texts_become_sequences(spark, sf):
    """A text of more than 512 chunks: the last vector is that of its last chunk."""
    from rankfold.operators.features import HashingEmbedder
    from rankfold.plans import learning

    words = [f"w{k % 977}" for k in range(192 + 128 * 620)]
    files = spark.createDataFrame([(1, " ".join(words)), (2, "a b")], "idx long, text string")
    got = {r.idx: r.sequence for r in learning._chunked(spark, sf, files).collect()}
    assert (len(got[1]), len(got[2])) == (621, 1)
    assert np.allclose(got[1][-1], HashingEmbedder(32).embed([" ".join(words[-192:])])[0])


def test_ends_of_long_sequences_count(spark):
    """Two tables that differ beyond the 600th chunk alone: other weights, and other predictions."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4, 640, 3))
    kinds = "id long, sequence array<array<double>>, label double, split string"
    one, two = (spark.createDataFrame([(k, np.concatenate([x[k, :600], sign * x[k, 600:]]).tolist(), 2.0 + 2 * k, "test" if k == 3 else "train") for k in range(4)], kinds) for sign in (1, -1))
    assert {b["mask"].count(False) for b in Q.batched(one, "id", 3).collect()} == {640}
    (kept, shape, _), (others, _, _) = (Q.train(rows, epochs=3) for rows in (one, two))
    assert not np.allclose(kept[-1], others[-1])
    rater, _ = Q.train_best(one, epochs=3)
    assert rater.most is None
    p, q = ({r.id: r.prediction for r in Q.SequenceRater(shape, kept[-1]).predict(rows).collect()} for rows in (one, two))
    assert all(abs(p[k] - q[k]) > 1e-9 for k in p)


def test_sequences_are_embedded_once(spark, sf):
    """What training reads many times is stored: its plan has no Python, so no pass embeds a text again."""
    from rankfold.plans import learning

    rows = learning._rated_sequences(spark, sf)
    assert "InPandas" not in rows._jdf.queryExecution().toString() and rows.count() > 0


def test_embedder_counts_words():
    import xxhash

    from rankfold.operators.features import HashingEmbedder

    texts = ["a b A c", "", "b b b", " x\ty "]
    for text, v in zip(texts, HashingEmbedder(8).embed(texts), strict=True):
        want = np.zeros(8)
        for h in map(xxhash.xxh64_intdigest, text.lower().split()):
            want[h % 8] += 1 if h >> 63 else -1
        assert np.array_equal(v, want / np.linalg.norm(want) if want.any() else want)
