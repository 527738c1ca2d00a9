"""Compression classifier, exact k-means, ranked lexical search."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankfold.llm import clusters, compression, lexical, queries

from .conftest import story


# ---- compression


@given(st.binary(max_size=2000))
@settings(max_examples=100, deadline=None)
def test_pieces_are_the_whole_text(text):
    parts = compression.pieces(text)
    assert b"".join(parts) == text and all(len(p) <= compression.PIECE for p in parts)


def test_compression_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = compression.scored(docs, labels).join(labels.dropna(), "doc_id").toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(good) > 500 and good.predicted.mean() > 0.985 and bad.predicted.mean() < 0.1
    # Areas: a good row outranks a bad one.
    assert np.mean(good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]) > 0.98


def test_held_out_labels_are_not_learned(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", (1 - labels.quality).cast("int")).filter(compression.held_out("doc_id")).unionByName(labels.filter(~compression.held_out("doc_id")))
    a, b = (compression.scored(docs, x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (labels, flipped))
    assert a.equals(b)


def test_compression_edges(spark, edges, nothing, labels):
    rows = compression.scored(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(empty) == 1
    assert len({r.score for r in rows if r.doc_id == 9}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert compression.scored(nothing, labels).count() == 0
    assert {r.score for r in compression.scored(edges, labels.limit(0)).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r.score for r in compression.scored(edges, one).collect()} == {1.0}


def test_one_labelled_id_on_many_rows(spark, monkeypatch):
    """What reaches the driver is bounded by rows, not by labels."""
    monkeypatch.setattr(compression, "SAMPLE", 50)
    monkeypatch.setattr(compression, "PIECES", 40)
    docs = spark.range(20_000).selectExpr("CAST(IF(id % 3 = 0, 7, id) AS long) AS doc_id", "concat('text number ', id, ' and more words of it') AS text")
    labels = spark.createDataFrame([(7, 1), (4, 0), (8, 0), (11, 1)], "doc_id long, quality int")
    train = compression.training(docs, labels, "doc_id", "text", "quality")
    assert train.count() > 6_000
    assert compression.scored(docs, labels).count() == 20_000


# ---- clusters


def slow_kmeans(v: np.ndarray, ids: list, k: int, rounds: int) -> list[tuple]:
    start = sorted(range(len(v)), key=lambda r: (ids[r] is None, hashlib.sha256(f"1:{ids[r]}".encode()).hexdigest() if ids[r] is not None else "", v[r].tolist()))[:k]
    c = v[start].copy()
    for number in range(rounds + 1):
        d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(2)
        a = d.argmin(1)
        if number < rounds:
            c = np.array([v[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    near = d[np.arange(len(v)), a]
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return [(ids[r], int(a[r]), int(near[r]), int(near[a == a[r]].sum()), int(near.sum()), sha[a[r]]) for r in range(len(v))]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *r[:1], *r[1:]) if r[0] is not None else (True, -1, *r[1:]))


@pytest.mark.parametrize(("n", "k", "spread"), [(400, 16, 3), (400, 16, 0), (7, 16, 2), (300, 5, 1), (1, 3, 2)])
def test_clusters_equal_plain_kmeans(spark, n, k, spread):
    """Few levels, so that ties are everywhere; repeated rows, ids and vectors; a null id."""
    r = np.random.default_rng(n + k)
    x = np.round(r.integers(0, 3, (n, 1)) * spread + r.normal(0, 1, (n, 4)) * 1.5) / 2
    x[: n // 3] = x[0]
    ids = [None if i == 5 else int(i) if i % 11 else 3 for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2.0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, a int, v double")
    got = clusters.clustered(df, k=k, rounds=3, dims=4, scale=2).collect()
    want = slow_kmeans(np.floor(2 * x).astype(np.int64), ids, k, 3)
    assert in_order(map(tuple, got)) == in_order(want)


def test_vectors_that_are_left_out(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 0.0]), (7, [1e300, -1e300]), (8, [-0.01, 0.5])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in clusters.clustered(df, dims=2).collect()}
    assert sorted(got) == [7, 8]
    assert list(clusters.whole_vectors(df.filter("vec_id = 8"), "vec_id", "embedding", 2, 64).first().v) == [-1, 32]
    assert clusters.clustered(df.limit(0), dims=2).count() == 0 and clusters.clustered(df.limit(0), dims=2).columns == list(got[7].asDict())


@pytest.mark.parametrize("dims", [2, 64])
def test_bounds_save_distances(sf, dims):
    """The same assignments as by all distances, in few dimensions from a small part of them."""
    x = duckdb.sql(f"SELECT embedding FROM '{sf}/../sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(64 * np.array([e[0] for e in x], float)).astype(np.int64)[:, :dims] * (64 // dims)
    c = np.unique(x, axis=0)[:16]
    s = clusters.Search(c)
    a, b, up, low = s.first(x)
    total = spent = 0
    for _ in range(6):
        new = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(16)])
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + clusters.SLACK)
        s, c = clusters.Search(new), new
        a, b, up, low = s.again(x, a, b, up, low, moved)
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert (a == d.argmin(1)).all() and (up >= np.sqrt(d.min(1)) * (1 - 1e-6)).all()
        assert (low <= np.sqrt(np.sort(d, 1)[:, 1]) * (1 + 1e-6)).all()
        total, spent = total + d.size, spent + s.computed
    assert spent < (0.5 if dims == 2 else 1) * total


# ---- lexical search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in PATTERN.findall(t or "")]


@given(st.text("aZ09 _-\x00\x7f\x80éß日\U0001f600\n\xa0İ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_terms(t):
    assert [w.decode() for w in lexical.terms(t.encode())] == words(t)


def slow_ranked(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        q = Counter(w for t in {t for i, t in items if i == item} for w in words(t))
        found = []
        for i, c, m in held:
            m = 25 + 75 * m * n // total
            if s := sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, a in q.items() if w in c):
                found.append((-s, i is None, i))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


ORDER = lambda r: (r[0] is None, r[0] or 0, r[1])


@pytest.mark.parametrize("block", [200_000, 60])
def test_ranked_equals_brute_force(spark, edges, edge_rows, nothing, monkeypatch, block):
    """Nulls, ties, copies, a very long text; with a small block every query is a pass of its own."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    items = [(1, story(1, 20)), (2, "the one x"), (2, "é 日本語 nul"), (2, "the one x"), (3, ""), (4, None), (None, story(6, 30)), (6, story(5)), (7, "the THE the")]
    asked = spark.createDataFrame([(*x, 1, "c") for x in items], "item_id long, text string, doc_id int, t string")
    got = sorted(map(tuple, lexical.ranked(edges, asked, k=3).collect()), key=ORDER)
    assert got == sorted(slow_ranked([(r[0], r[1]) for r in edge_rows], items, 3), key=ORDER)
    assert lexical.ranked(nothing, asked).count() == 0 and lexical.ranked(edges, asked.limit(0)).count() == 0


def test_ties_among_copies_go_by_id(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'alpha beta gamma', concat('delta ', id, ' beta ', id % 7)) AS text")
    items = spark.createDataFrame([(1, "gamma alpha"), (2, "beta 4")], "item_id int, text string")
    got = sorted(map(tuple, lexical.ranked(docs, items).collect()), key=ORDER)
    assert got == slow_ranked([(r.doc_id, r.text) for r in docs.collect()], [(1, "gamma alpha"), (2, "beta 4")])
    assert [r[2] for r in got if r[0] == 1] == list(range(0, 30, 3))


def test_bounds_leave_few_vectors(sf):
    """Most vectors are ruled out by their coordinates or their norm, and none wrongly."""
    docs = [t.encode() for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/../sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    items = [t.encode() for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/../sf0.01/benchmark.parquet' ORDER BY item_id").fetchall()]
    asked = [Counter(lexical.terms(t)) for t in items]
    number = {w: k for k, w in enumerate(sorted({w for c in asked for w in c}))}
    held = [Counter(w for w in lexical.terms(t) if w in number) for t in docs]
    df = Counter(w for c in held for w in c)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) for w in number])
    qs = lexical.Queries([[(number[w], n) for w, n in c.items()] for c in asked], weight)
    rows = [[(number[w], 1_000_000_000 * f // (1000 * f + 800)) for w, f in c.items()] for c in held]
    rows.sort(key=lambda r: -sum(p * p for _, p in r))
    flat = [x for r in rows for x in r]
    b = lexical.Bucket(np.cumsum([0, *map(len, rows)]), np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), np.array([math.sqrt(sum(p * p for _, p in r)) for r in rows]), len(number))
    scored = 0
    for k in range(len(qs)):
        q = dict(zip(qs.t[k].tolist(), qs.q[k].tolist(), strict=True))
        exact = [sum(q.get(t, 0) * p for t, p in r) for r in rows]
        least = sorted(exact)[-10]
        found, score, n = b.search(qs, k, least)
        assert dict(zip(found.tolist(), score.tolist(), strict=True)) == {j: s for j, s in enumerate(exact) if s >= least}
        scored += n
    assert scored < 0.25 * len(rows) * len(qs)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, sf, duck, rows_of):
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)
