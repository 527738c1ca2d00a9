"""SimHash, long repeats, decontamination."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.llm import decontamination as D
from rankfold.llm import repeats as R
from rankfold.llm import simhash as S
from rankfold.llm.components import components

from .conftest import story


def slow_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    """rows: (id, text). Component by (id, text)."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups: dict = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [(i, f"{fps[k]:016x}", min((x for x in groups[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in S.components_of(docs).collect())
    assert got == sorted(slow_components([tuple(r) for r in docs.collect()]))


def test_simhash_edges(edges, edge_rows, nothing):
    got = sorted((tuple(r) for r in S.components_of(edges).collect()), key=str)
    assert got == sorted(slow_components([(r[0], r[1]) for r in edge_rows]), key=str)
    assert S.components_of(nothing).collect() == []
    kept = S.deduplicated(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({r[2] if r[2] is not None else r[1] for r in got})
    assert S.deduplicated(nothing).count() == 0


def test_ball_hashing_links_all_within_two_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = {(e.a, e.b) for e in S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    u = lambda x: x % (1 << 64)
    assert all((u(a) ^ u(b)).bit_count() <= 2 for a, b in edges)

    def roots(pairs):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups: dict = {}
        for x in signed:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert roots(edges) == roots([(a, b) for a in signed for b in signed if a < b and (u(a) ^ u(b)).bit_count() <= 2])


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 150), (7, 100), (300, 301), (301, 302), (302, 300)] + [(400, k) for k in range(401, 450)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in [*range(2, 61), 100, 150, 200]) and got[301] == got[302] == 300 and all(got[k] == 400 for k in range(401, 450))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=6), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_index_core_matches_brute_force(texts, extra):
    """Small windows on repetitive texts: contexts, index and cuts in memory."""
    width, gram = 12, 8
    data = [t.encode() * (1 + extra) for t in texts]
    found = R.contexts(data, width, gram)
    for t, d in enumerate(data):
        own = sorted((s, s + m) for x, s, m, _, _ in found if x == t)
        flat = [k for a, b in own for k in range(a, b)]
        assert flat == list(range(max(0, len(d) - width + 1)))
    seen: dict = {}
    for t, s, m, a, c in found:
        seen.setdefault((a, c), []).append(data[t][s : s + m + width - 1])
    marks = {k: None for k, v in seen.items() if len(v) > 1}
    rows = sorted((a, c, v[0]) for (a, c), v in seen.items())
    if rows:
        for (a, c, _), m in zip(rows, R.RunLengthIndex([x[0] for x in rows], [x[2] for x in rows], width).repeated(), strict=True):
            if m.any() and (a, c) not in marks:
                marks[a, c] = np.packbits(m).tobytes()
    want = R.brute_force(data, width)
    for t, d in enumerate(data):
        n, runs, kept = R.cut(d, marks, [x for x in found if x[0] == t], width)
        assert (n, runs) == want[t][1:3]


def passages(n=40):
    common = story(99, 60)
    return [(k, f"{story(1000 + k, 40)} {common if k % 3 else common[:250]} {story(2000 + k, 40)}") for k in range(n)]


@pytest.mark.parametrize("hot", [R.HOT, 2])
def test_repeats_match_brute_force(spark, edges, edge_rows, hot):
    """With a low limit hot anchors are divided at every level, and the rest counted, which gives the same."""
    rows = [(r[0], r[1]) for r in edge_rows] + [(100 + k, t) for k, t in passages()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.digest(R.without_repeats(docs, hot=hot)).collect())
    want = R.brute_force([None if t is None else t.encode() for _, t in rows])
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert any(g[2] for g in got)


def test_repeats_on_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.digest(R.without_repeats(docs)).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, R.brute_force([r.text.encode() for r in rows]), strict=True))


def test_repeats_of_nothing(nothing):
    assert R.without_repeats(nothing).collect() == []


def edited(text: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[k] = r.choice("abcxyz")
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, r.choice("abcxyz"))
    return "".join(out)


def slow_distance(p: bytes, t: bytes) -> int:
    row = [0] * (len(t) + 1)
    for k, c in enumerate(p, 1):
        new = [k]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_alignment(p, t, most):
    want = slow_distance(p.encode(), t.encode())
    got = D.align(p.encode(), t.encode(), most)
    assert (got is None) == (want > most)
    if got:
        assert got[0] == want and 0 <= got[1] <= got[2] <= len(t)


def test_no_occurrence_within_budget_is_lost():
    """Planted passages with edits at the budget: all found, in one pass and in pieces; clean texts stay clean."""
    items = [story(k, 30).encode() for k in range(30)]
    index = D.Index(items)
    texts, want = [], set()
    for k in range(90):
        item = k % 30
        passage = edited(items[item].decode(), int(len(items[item]) * 0.03), k).upper() if k % 2 else items[item].decode()
        texts.append(f"{story(500 + k, 80)} {passage} {story(700 + k, 80)}".encode())
        want.add((k, item))
    texts += [story(900 + k, 200).encode() for k in range(30)]
    got = {(t, i) for t, i, *_ in index.find(texts)}
    assert want <= got
    assert all(t < 90 for t, _ in got)


def test_decontamination(spark, edges, nothing):
    bench = spark.createDataFrame([(1, story(4, 30)), (2, None), (3, "short"), (4, story(77, 40)), (5, story(77, 40))], "item_id long, text string")
    extra = [(50, "before\n" + story(77, 40).upper().replace(" ", "\n") + " after"), (51, story(78, 40))]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((r.doc_id, r.item_id) for r in D.contaminations(docs, bench).collect())
    assert got == [(8, 1), (50, 4), (50, 5)]
    span = next(r for r in D.contaminations(docs, bench).collect() if r.doc_id == 50)
    assert span.start == 7 and span.end == 7 + len(story(77, 40))
    left = D.cleaned(edges, bench)
    assert left.columns == edges.columns and left.count() == edges.count() - 1
    assert D.contaminations(nothing, bench).count() == 0 and D.cleaned(nothing, bench).count() == 0
    assert D.contaminations(docs, bench.limit(0)).count() == 0 and D.cleaned(edges, bench.limit(0)).count() == edges.count()


def test_benchmark_in_blocks(spark, monkeypatch):
    items = [(k, story(3000 + k, 30)) for k in range(40)]
    docs = [(k, f"{story(4000 + k, 50)} {t} end") for k, t in items]
    monkeypatch.setattr(D, "BLOCK", 2000)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), bench).select("doc_id", "item_id").distinct()
    assert sorted(tuple(r) for r in got.collect()) == [(k, k) for k in range(40)]


def test_leaks_of_the_sample(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    squeeze = lambda t: re.sub(r"[\t-\r]", " ", t).lower()
    texts = [(r.doc_id, squeeze(r.text)) for r in docs.collect()]
    want = {(d, b.item_id) for b in bench.collect() for d, t in texts if squeeze(b.text) in t}
    got = {(r.doc_id, r.item_id) for r in D.contaminations(docs, bench).collect()}
    assert want and want <= got


def test_hashes_of_variants(spark):
    assert len(set(spark.range(1).select(F.explode(S.variants(F.lit(5).cast("long")))).toPandas().iloc[:, 0])) == 65
