"""Near copies by shingle similarity, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankfold.llm import simhash as S

from .conftest import row, story


def slow_set(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def slow_groups(texts, least=0.8):
    """Group number by text."""
    sets = [slow_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holds = defaultdict(list)
    for i, a in enumerate(sets):
        near = range(i) if not a else sorted({j for g in a for j in holds[g]})
        for g in a:
            holds[g].append(i)
        for j in near:
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def copies(seed: int) -> list[str]:
    """Stories and near copies with a growing number of changed words, and a passage that all of them share."""
    r = random.Random(seed)
    out = []
    for k in range(25):
        words = story(seed * 1000 + k, r.choice([12, 60, 200])).split() + story(seed, 15).split()
        out.append(" ".join(words))
        for n in range(6):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 30) + n)):
                w[r.randrange(len(w))] = f"x{r.random()}"
            out.append(" ".join(w).upper() if n % 2 else " ".join(w))
    return out


def check_groups(got: list, want: list, recall: float):
    """No group joins what brute force keeps apart; of the texts that brute force would drop so many are dropped."""
    assert all(want[g] == w for g, w in zip(got, want, strict=True))
    assert len(want) - len(set(got)) >= recall * (len(want) - len(set(want)))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    texts = copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups(texts)
    assert len(set(want)) < len(texts) - 20
    got = {r.id: r.component for r in S.near_grouped(docs).collect()}
    check_groups([got[k] for k in range(len(texts))], want, 0.95)


def test_crowded_buckets(spark):
    """With 9 bits some eight strangers share a bucket, as they do with 30 bits among some 10^8 texts: copies still meet."""
    r = random.Random(9)
    texts = [story(7000 + k, r.randint(20, 400)) for k in range(400)]
    for t in texts[:70]:
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = f"z{r.random()}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups(texts)
    got = {r.id: r.component for r in S.near_grouped(docs, bits=9).collect()}
    assert len(texts) - len(set(want)) > 50
    check_groups([got[k] for k in range(len(texts))], want, 0.95)


def test_recall_on_the_sample(spark, sf):
    """Ten thousand documents: at least 0.9 of the near copies that aren't equal sets, and no false link."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/../sf0.1/documents.parquet").select("doc_id", "text").collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_groups([t for _, t in rows])
    at = {d: k for k, (d, _) in enumerate(rows)}
    found = {r.id: r.component for r in S.near_grouped(docs).collect()}
    got = [at[found[d]] for d, _ in rows]
    check_groups(got, want, 0.99)
    sets = {}
    for k, (_, t) in enumerate(rows):
        sets.setdefault(frozenset(slow_set(t)), k)
    first = set(sets.values())
    mergeable = len(first) - len({want[k] for k in first})
    merged = len(first) - len({got[k] for k in first})
    assert mergeable > 30 and merged >= 0.9 * mergeable


def test_no_link_is_left_out(spark, sf):
    """All groups of brute force, with the links at exactly 0.8: on ten thousand documents, and on pairs whose sets differ in as much as they may."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/../sf0.1/documents.parquet").select("doc_id", "text").collect())
    r = random.Random(21)
    for k in range(300):
        words = story(40_000 + k, 4 + r.randint(1, 60)).split()
        n = len(words) - 4
        rows += [(1_000_000 + 2 * k, " ".join(words)), (1_000_001 + 2 * k, " ".join([*words, *(f"w{k}x{j}" for j in range(n // 4))]))]
    got = {x.id: x.component for x in S.near_grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_groups([t for _, t in rows])
    assert [got[d] for d, _ in rows] == [rows[k][0] for k in want]


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_similar_sets_share_a_part(similarity):
    r = np.random.default_rng(4)
    lows = S.classes(5000, similarity)
    for n in [*range(1, 60), 200, 999, 3000]:
        for _ in range(20):
            s = np.unique(r.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            r.shuffle(s)
            both = int(r.integers(1, n + 1))
            a, b = s[:n], s[n - both : n - both + int(r.integers(max(1, both), n + 1))]
            if S.alike(np.sort(a), np.sort(b), similarity):
                assert np.isin(S.signatures(a, similarity, lows), S.signatures(b, similarity, lows)).any()


def test_large_family(spark):
    """Three hundred near copies of one text are one group; verification never compares all pairs."""
    r = random.Random(3)
    base = story(77, 150).split()
    texts = [" ".join(base)]
    for _ in range(300):
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"y{r.random()}"
        texts.append(" ".join(w))
    got = S.near_grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.filter("component <> 0").count() <= 3


def test_stage_drops_near_copies(spark, sf):
    """Two changed words of 300, and a cut end: similarity over 0.8, but 3 and 4 bits apart by the fingerprint."""
    words = story(5, 300).split()
    near = [" ".join(f"y{k}" if k in range(20, 20 + 8 * 10, 40) else w for k, w in enumerate(words)), " ".join(words[:285])]
    far = " ".join("z" if k % 12 == 0 else w for k, w in enumerate(words))
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate([" ".join(words), *near, far])])
    assert sorted(r._1 for r in corpus_pipeline.near_duplicates(spark, docs.withColumnsRenamed({"_1": "doc_id", "_2": "text"}), sf).withColumnRenamed("doc_id", "_1").collect()) == [0, 3]


def test_edges(spark, edges, edge_rows, nothing, sf):
    kept = corpus_pipeline.near_duplicates(spark, edges, sf)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, None, 8, 9, 10, 11, 12, 13, 15]))
    assert corpus_pipeline.near_duplicates(spark, nothing, sf).count() == 0


@pytest.mark.parametrize("groups", [S.grouped, S.near_grouped])
def test_one_id_for_several_texts(spark, sf, groups):
    """Groups that have the same least id, or none, are still groups of their own: each keeps a document."""
    rows = [(1, story(1)), (1, story(2)), (1, story(2)), (2, story(3)), (2, story(1)), (3, story(2)), (3, story(4)), (None, story(5)), (None, story(6)), (None, story(6)), (None, story(3)), (4, ""), (4, None), (4, story(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, story(1)), (1, story(2)), (2, story(3)), (3, story(4)), (None, story(5)), (None, story(6)), (4, ""), (4, story(7))], key=str)
    assert sorted(((r.doc_id, r.text or "") for r in S.deduplicated(docs, groups=groups).collect()), key=str) == want
    assert sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()), key=str) == want


def test_names_and_types_of_further_columns(spark, sf):
    docs = spark.createDataFrame([(1, story(1)), (1, story(1)), (2, story(1)), (3, story(3))], "doc_id long, text string")
    docs = docs.select("*", F.create_map(F.lit("a"), "doc_id").alias("row"), *[F.lit("clash").alias(c) for c in ("th", "__th", "id", "kid", "nth", "fp", "s", "a.b", "component")])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((r.doc_id, r.row["a"], r["th"], r["a.b"]) for r in kept.collect()) == [(1, 1, "clash", "clash"), (3, 3, "clash", "clash")]


def test_changed_copies_are_not_paired(spark, monkeypatch):
    """A family whose copies are mostly changed too much to be near each other, and strangers with a long common passage: the groups of brute force, from few pairs."""
    r = random.Random(8)
    base, passage = story(78, 150).split(), story(79, 60).split()
    texts = [" ".join(base)]
    for k in range(250):
        w = list(base)
        for at in sorted(r.sample(range(len(w)), r.randint(2, 7)), reverse=True):
            w[at : at + 1] = [[], [f"y{r.random()}"], [w[at], f"y{r.random()}"]][k % 3]
        texts.append(" ".join(w))
    texts += [" ".join(story(9000 + k, r.randint(15, 40)).split() + passage) for k in range(250)]
    pairs, verified = [], S._verified
    monkeypatch.setattr(S, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    got = {x.id: x.component for x in S.near_grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert [got[k] for k in range(len(texts))] == slow_groups(texts)
    assert sum(pairs) < 8 * len(texts)


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_places_with_frequent_members(similarity):
    """Whichever members count as frequent, similar sets share a name whose places and classes the join allows."""
    r = np.random.default_rng(5)
    lows = S.classes(5000, similarity)
    for n in [*range(1, 40), 200, 999]:
        for _ in range(20):
            u = r.permutation(np.unique(r.integers(0, 1 << 63, 2 * n).astype(np.uint64)))
            level = dict(zip(u.tolist(), (r.integers(0, 4, len(u)) * (r.random(len(u)) < r.random())).tolist(), strict=True))
            both = int(r.integers(1, n + 1))
            a, b = u[:n], u[n - both : n - both + int(r.integers(max(1, both), n + 1))]
            if S.alike(np.sort(a), np.sort(b), similarity):
                one, two = ({x: (p, o) for x, p, o in zip(*(c.tolist() for c in S.placed(s, similarity, lows, np.array([level[m] for m in s.tolist()]))), strict=True)} for s in (a, b))
                o = int(S.shared(len(a), len(b), similarity))
                assert any((one[x][1] or two[x][1]) and len(a) - one[x][0] >= o and len(b) - two[x][0] >= o for x in one.keys() & two.keys())
