"""Extraction, quality, tokens, toxicity, pipeline."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.llm import quality, tokens, toxicity

from .conftest import story


def slow_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(grams)
    hit = {j for k, g in enumerate(grams) if often[g] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@given(st.text(" ab\n#é\x0b ", max_size=80))
@settings(max_examples=200, deadline=None)
def test_statistics(t):
    assert quality.statistics(t.encode())[:5] == slow_statistics(t)


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for r in docs.collect():
        n = slow_statistics(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == n
        assert g.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (g.base_failed and g.kept)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(marks[i], g.kept) for i, g in got.items() if i in marks and not g.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.99
    assert np.mean([not k for q, k in judged if q == 0]) > 0.9


def test_quality_on_held_out_rows(spark, sf):
    """Rules learned without a third of the labels judge that third."""
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels.filter("doc_id % 3 <> 1"))
    d = quality.with_statistics(docs.join(labels.filter("doc_id % 3 = 1"), "doc_id").select("doc_id", "text", "quality"))
    rows = d.filter(~quality.base_failed()).select("quality", quality.rejected(rules).alias("gone")).toPandas()
    assert len(rows) > 1000
    assert rows[rows.quality == 1].gone.mean() < 0.01 and rows[rows.quality == 0].gone.mean() > 0.95


def test_learner_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covers(r, x, 3000)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * hit.sum()
    assert quality.learn(x, np.zeros(3000, bool)) == []


def test_quality_edges(edges, edge_rows, nothing, labels):
    got = quality.judged(edges, labels)
    assert got.count() == len(edge_rows)
    assert got.filter("doc_id IN (4, 5, 6, 10) AND kept").count() == 0
    kept = quality.filtered(edges, labels)
    assert kept.columns == edges.columns and kept.count() == got.filter("kept").count()
    assert quality.judged(nothing, labels).count() == 0 and quality.judged(edges, labels.limit(0)).count() == len(edge_rows)


TEXTS = ["<|endoftext|>a b<|endoftext|>", "", "  a  \n\n b", "日本語 text", "a\x1cb \x85 c d", "I'm they'll x123 !!", "word" * 3000, None, "ß ñandú Ünïcode Привет"]


def test_token_counts(spark, sf, edges, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edges.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(TEXTS, 10**6)), "doc_id long, text string"))
    tok = tokens._load(tokens._file("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = tokens.token_counts(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(nothing).count() == 0


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_counter_agrees_with_the_library(t):
    c = tokens._state.setdefault("test", tokens.Counter("byte_bpe_50k.json", {}))
    assert c.count(t) == len(c.tok.encode(t, add_special_tokens=False).ids)


def test_small_cache_still_counts_right(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 8)
    c = tokens.Counter("byte_bpe_50k.json", {" the": 1})
    t = story(5, 300) + " the end"
    assert c.count(t) == len(c.tok.encode(t, add_special_tokens=False).ids)


def test_all_code_points_go_through_both_tiers(monkeypatch):
    """No text but one with special strings is encoded whole; another pre-tokenizer falls back to the library's cuts."""
    c = tokens.Counter("byte_bpe_50k.json", {})
    assert c.agrees and not c.whole
    texts = [t for t in TEXTS if t and "<|" not in t] + ["\U0001f600\U0001f601 日本語 ก็ ٣٤ ½ ² \u200b\u3000x\x85y", "a\u0301 e\u0308" * 50]
    want = [c._whole(t) for t in texts]
    monkeypatch.setattr(c, "_whole", None)
    assert [c.count(t) for t in texts] == want
    monkeypatch.setattr(tokens, "PATTERN", r"\\S+|\\s+")
    d = tokens.Counter("byte_bpe_50k.json", {})
    assert not d.agrees and [d.count(t) for t in texts] == want


def test_folding():
    assert toxicity.fold("ІDІ0Т") == "idiot"
    assert toxicity.fold("ｃｌｏｗｎ m0r0n l​oser") == "clown moron loser"
    assert toxicity.fold("tr@sh st@ff $ 5!") == "trash staff $ s!"


def test_lexicon_and_exceptions():
    x = toxicity.Lexicon({"clown": 2.0, "idiot": 3.0}, {"class clown"})
    assert x.weigh("You c1own! 1d10t, i d")[0] == 5.0
    assert x.weigh("the class clown and clowns")[0] == 0.0
    assert x.weigh("")[3] == 0 and toxicity.Lexicon({}, set()).weigh("a b") == (0.0, 0, 0, 2)
    y = toxicity.Lexicon({"clown": 2.0, "clow*": 1.0, "idiot*": 3.0}, {"class clown"})
    assert y.weigh("clown clowny clow idiotic 1diots class clown, xidiot") == (2.0 + 1.0 + 1.0 + 3.0 + 3.0, 5, 5, 8)


@given(st.lists(st.sampled_from("ab abc abcd bc b.c ABC a8c xab the_ab the ab! 4b".split()), max_size=12))
@settings(max_examples=200, deadline=None)
def test_matcher_against_brute_force(words):
    """Word by word: the greatest weight of the word itself or of a stem, unless the word ends an exception."""
    weights, exceptions = {"abc": 5.0, "ab*": 2.0, "bc": 1.0, "abcd*": 7.0}, {"the ab", "xab bc"}
    text = " ".join(words)
    folded = toxicity.fold(text)
    found = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", folded)]
    free = [(m.start(), m.end()) for e in exceptions for m in re.finditer(rf"(?<![^\W\d_]){e}(?![^\W\d_])", folded)]
    total, hits = 0.0, []
    for at, w in found:
        best = max([x for e, x in weights.items() if (w.startswith(e[:-1]) if e.endswith("*") else w == e)], default=0.0)
        if best and not any(a <= at < b for a, b in free):
            total += best
            hits.append(w)
    assert toxicity.Lexicon(weights, exceptions).weigh(text) == (total, len(hits), len(set(hits)), len(text.split()))


def test_lexicon_is_learned_whole(spark):
    """Words, stems and exception phrases of planted rows; no phrase is cut off, whatever its place in the alphabet."""
    rows = [(f"{story(k, 12)} clown {story(k + 500, 6)} zorgish{'abcdefgh'[k % 8]}q {story(k + 900, 3)}", 1) for k in range(40)]
    rows += [(f"{story(k + 2000, 30)} {p} clown {story(k + 3000, 5)}", 0) for k in range(3) for p in ("class", "zirkus", "birthday")] + [(story(k + 5000, 40), 0) for k in range(80)]
    weights, exceptions = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, y int"))
    assert {"clown", "zorgish*"} <= set(weights) and exceptions == {"class clown", "zirkus clown", "birthday clown"}
    assert toxicity.learn_lexicon(spark.createDataFrame([], "t string, y int")) == ({}, set())


def test_toxicity_on_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    got = toxicity.scored(docs, labels)
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    precision = held[held.predicted == 1].toxic.mean()
    recall = held[held.toxic == 1].predicted.mean()
    assert precision > 0.95 and recall >= 0.9
    # Labels of held-out rows don't matter.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(tuple(r) for r in toxicity.scored(docs, turned).collect()) == sorted(tuple(r) for r in got.collect())


def test_toxicity_edges(edges, edge_rows, nothing, labels):
    got = toxicity.scored(edges, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(nothing, labels).count() == 0
    assert len({r.score for r in toxicity.scored(edges, labels.limit(0)).collect()}) == 1


def test_pipeline(spark, sf):
    """Every stage against its operator or brute force on what the stage before kept."""
    import corpus_pipeline as p
    from rankfold.llm import decontamination
    from rankfold.llm.common import written

    from .test_similar import slow_groups

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs
    seen = []
    for name, stage in p.STAGES:
        out = written(stage(spark, docs, sf), name)
        seen.append((name, docs, out))
        if name != "shard":
            assert out.columns == given.columns
            assert out.select("doc_id", "text").subtract(docs.select("doc_id", "text")).count() == 0
        docs = out
    quality_in, quality_out = seen[0][1], seen[0][2]
    kept = {r.doc_id for r in quality.judged(quality_in, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in quality_out.collect()} == kept
    # The stage takes five-word shingles and a similarity of 0.8 or more.
    rows = sorted((r.doc_id, r.text) for r in seen[1][1].select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in seen[1][2].collect()) == sorted({rows[k][0] for k in slow_groups([t for _, t in rows])})
    leaked = {r.doc_id for r in decontamination.contaminations(seen[2][1], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in seen[2][2].collect()} == {r.doc_id for r in seen[2][1].collect()} - leaked
    assert seen[3][2].count() == seen[4][2].count()
    assert p.run(spark, sf).count() == seen[4][2].count()


CLASHES = ("__th", "__key", "__z", "__h", "__size", "__copies", "__q_n_words", "q_n_words", "_q_x", "row", "nth", "kid", "law", "slot", "shard", "bucket")


def test_pipeline_edges(spark, sf, edges, nothing):
    """Nulls, ties, repeated rows, empty tables, and columns with the names that stages use themselves."""
    import corpus_pipeline as p

    for docs in (edges, nothing):
        docs = docs.select("*", *[F.lit("mine").alias(c) for c in CLASHES])
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r[c] == "mine" for r in rows for c in CLASHES)
            docs = spark.createDataFrame(rows, docs.schema)
        assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_one_labelled_id_on_very_many_rows(spark, monkeypatch):
    """The curve is fitted on bounded rows of numbers, however often a labelled id is repeated."""
    monkeypatch.setattr(toxicity, "SAMPLE", 500)
    seen = []
    real = toxicity.inputs
    monkeypatch.setattr(toxicity, "inputs", lambda weight, *rest: seen.append(len(weight)) or real(weight, *rest))
    docs = spark.range(100_000).selectExpr("CAST(IF(id > 50, 7, id) AS long) AS doc_id", "concat('some text of row ', id) AS text")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(50)], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).count() == 100_000
    assert seen and max(seen) <= 500


def test_the_tokenizer_starts_no_threads(monkeypatch):
    """Spark's tasks keep the cores busy: threads for each text's few new pieces more than doubled the CPU seconds."""
    import os

    from rankfold.llm import tokens

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    tokens.Counter("byte_bpe_50k.json", {})
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
