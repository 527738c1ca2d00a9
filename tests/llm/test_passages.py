"""Passages of benchmark items that begin anywhere."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rankfold.llm import decontamination as D

from .conftest import story
from .test_duplicates import edited, slow_distance


@pytest.mark.parametrize("size", [96, 97, 108, 119, 131, 142])
def test_exact_passages_at_every_offset(size):
    item = story(11, 60).encode()[:300]
    index = D.Index([story(12, 40).encode(), item])
    texts, places = [], []
    for o in range(len(item) - size + 1):
        before = story(2000 + o, 20)
        texts.append(f"{before} ".encode() + item[o : o + size] + f" {story(3000 + o, 20)}".encode())
        places.append((len(before) + 1, len(before) + 1 + size))
    got = {t: (a, b) for t, i, a, b, _ in index.find(texts) if i == 1}
    assert sorted(got) == list(range(len(texts)))
    assert all(got[k][0] < b and a < got[k][1] and got[k][1] - got[k][0] >= 96 - 9 for k, (a, b) in enumerate(places))


@pytest.mark.parametrize("size", [100, 120, 142])
def test_edited_passages_at_every_offset(size):
    """Found if and only if some stretch of 96 bytes is within the budget."""
    item = story(21, 60).encode()[:290]
    index = D.Index([item])
    texts, want = [], []
    for o in range(0, len(item) - size + 1, 3):
        passage = edited(item[o : o + size].decode(), 5 + o % 9, o).encode()
        texts.append(f"{story(4000 + o, 20)} ".encode() + passage + f" {story(5000 + o, 20)}".encode())
        near = range(max(0, o - 12), min(len(item) - 96, o + size - 96 + 12) + 1)
        if any(slow_distance(item[k : k + 96], texts[-1]) <= 9 for k in near) if o % 9 == 0 else D.align(item[o : o + 96], texts[-1], 9):
            want.append(len(texts) - 1)
    got = {t for t, *_ in index.find(texts)}
    assert want and set(want) <= got
    for t in got - set(want):
        assert any(D.align(item[k : k + 96], texts[t], 9) for k in range(len(item) - 95))
    assert not list(index.find([story(6000 + k, 60).encode() for k in range(20)]))


def substituted(r, item: bytes, k: int) -> bytes:
    out = bytearray(item)
    for at in r.sample(range(len(item)), k):
        out[at] = r.choice([c for c in b"abcdefghijklmnopqrstuvwxyz" if c != out[at]])
    return bytes(out)


@pytest.mark.parametrize("n", range(8, 41))
def test_short_items_lose_nothing(n):
    """With as many edits as the budget allows, at every length; and nothing beyond it."""
    r = random.Random(n)
    items = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(6)]
    index = D.Indexes([*items, b"tiny"])
    texts, want = [], []
    for k in range(24):
        i = r.randrange(6)
        edits = D.budget(n)
        core = substituted(r, items[i], edits)
        if k % 3 == 1 and edits:
            at = r.randrange(n)
            core = substituted(r, items[i][:at] + items[i][at + 1 :], edits - 1)
        if k % 3 == 2 and edits:
            at = r.randrange(n)
            core = substituted(r, items[i][:at] + b"~" + items[i][at:], edits - 1)
        texts.append(b"zz ZZ 00 " + core + b" zz 11 zz")
        want.append((k, i))
    texts += [substituted(r, x, D.budget(n) + 3) for x in items]
    got = {(t, i) for t, i, *_ in index.find(texts)}
    assert set(want) <= got
    for t, i in got:
        assert slow_distance(items[i], texts[t]) <= D.budget(n)
    brute = {(t, i) for t, x in enumerate(texts) for i, item in enumerate(items) if slow_distance(item, x) <= D.budget(n)}
    assert got == brute


def test_common_grams_are_taken_in_pieces(monkeypatch):
    """A stock phrase in all items and texts: the same result whatever the bound on hits at once."""
    items = [f"{story(k, 6)} in accordance with the terms and conditions {story(50 + k, 8)}".encode() for k in range(40)]
    texts = [b" and then ".join(items[k : k + 3]) for k in range(0, 40, 5)] + [b"in accordance with the terms and conditions " * 4]
    index = D.Index(items)
    want = index.find(texts)
    assert {i for t, i, *_ in want if t < 8} >= {k + j for k in range(0, 38, 5) for j in range(3)}
    monkeypatch.setattr(D, "HITS", 500)
    assert index.find(texts) == want


def test_blocks_pieces_and_equal_items(spark, monkeypatch):
    """Many blocks, one item longer than a piece, equal items: as with one block; found through the whole query."""
    monkeypatch.setattr(D, "BLOCK", 2000)
    monkeypatch.setattr(D, "PIECE", 1000)
    long = story(5, 600)
    bench = [(k, story(100 + k, 15)) for k in range(12)] + [(20, story(100, 15)), (21, long), (None, story(300, 12)), (22, None), (23, "tiny"), (24, "abcdefghij")]
    docs = [(k, f"{story(500 + k, 20)} {story(100 + k, 15)}") for k in range(12)]
    docs += [(50 + k, f"{story(700 + k, 9)} {long[o : o + 120]} x") for k, o in enumerate(range(0, len(long) - 120, 97))]
    docs += [(390, "zz zz abcdeXghij zz zz"), (391, "tiny"), (392, None), (None, story(300, 12)), (393, story(900, 50))]
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("h", F.lit("clash")).withColumn("i", F.lit("clash"))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("d", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in D.contaminations(d, b).collect()}
    want = {(k, k) for k in range(12)} | {(0, 20), (390, 24), (None, None)} | {(i, 21) for i, _ in docs if i is not None and 50 <= i < 390}
    assert got == want
    kept = D.cleaned(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {391, 392, 393}
    assert D.contaminations(d.limit(0), b).count() == 0 and D.contaminations(d, b.limit(0)).count() == 0 and D.cleaned(d, b.limit(0)).count() == len(docs)


def test_indexes_are_built_once_a_round(monkeypatch):
    """With six blocks an index isn't built anew for every batch, and every batch meets every block."""
    import types

    import pyarrow as pa

    built, met = [], []
    monkeypatch.setattr(D, "Indexes", lambda items: built.append(1) or items)
    monkeypatch.setattr(D, "SWEEP", 1000)
    monkeypatch.setattr(D, "_indexes", type(D._indexes)())
    parts = [types.SimpleNamespace(id=k, value=[(0, b"x")]) for k in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["y" * 96])], names=["t"]) for _ in range(50)]
    for held, order in D._rounds(iter(batches), "t", parts):
        assert [b.id for b in order] in (list(range(6)), list(range(5, -1, -1)))
        for b in order:
            D._index(b)
        met += held
    assert len(met) == 50 and len(built) <= 6 + 4 * 5
    built.clear()
    assert [len(h) for h, _ in D._rounds(iter(batches), "t", parts[:2])] == [1] * 50
