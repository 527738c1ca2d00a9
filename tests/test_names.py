"""Name search by bounds gives what scoring every name gives."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.functions import fuzzy
from rankfold.operators import names, search

WORDS = "garden cat river stone night blue summer walk piano live demo take one two final mix copy old holiday beach snow train city".split()


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(4)
    paths = [f"osfs:///mnt/media/{r.choice(WORDS)}/{r.choice(WORDS)}_{r.choice(WORDS)}/" + r.choice(" -_").join(r.choice(WORDS) for _ in range(r.randint(1, 5))) + f"_{k}.{r.choice(['mp3', 'txt', 'flac'])}" for k in range(6000)]
    rows = [(k, p) for k, p in enumerate(paths)] + [(6000, None), (6001, ""), (6002, paths[5]), (6003, "/"), (6004, "night"), (6005, "night piano")]
    return spark.createDataFrame(rows, "idx long, path string").cache()


@pytest.fixture(scope="module")
def index(files):
    return names.name_index(files).cache()


def everything(files, query, k):
    scored = files.withColumn("score", search.filename_score(F.col("path"), query))
    return [(r.idx, r.score) for r in scored.orderBy(F.col("score").desc_nulls_last(), "idx").limit(k).collect()]


@pytest.mark.parametrize("query", ["blue piano", "night", "piano live final mix", "snwo", "Garden_Cat", "zzz", "x", "beach holiday summer walk 17", "mp3"])
def test_equals_scoring_everything(files, index, query):
    want = everything(files, query, 100)
    got = [(r.key, r.score) for r in names.name_search(index, query, 100).collect()]
    scores = {r.idx: r.s for r in files.withColumn("s", F.coalesce(search.filename_score(F.col("path"), query), F.lit(0.0))).collect()}
    assert [s for _, s in got] == pytest.approx([s if s is not None else 0.0 for _, s in want]) and all(scores[k] == pytest.approx(s) for k, s in got)
    if all(s for _, s in want):
        assert [(k, round(s, 9)) for k, s in got] == [(k, round(s, 9)) for k, s in want]


@pytest.mark.parametrize("query", ["blue piano", "piano live final mix", "beach holiday summer walk 17", "garden", "night_777"])
def test_under_a_tenth_of_the_ratios(index, query):
    """Also where an eighth of the names tie for the last place."""
    assert 100 <= names.candidates(index, query, 100).count() < 600


def test_bounds_hold(spark):
    """For random texts of few letters, where everything nearly matches."""
    r = random.Random(6)
    texts = sorted({" ".join("".join(r.choice("ab1") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 5))) for _ in range(1500)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", names._words(F.col("t"))).cache()
    for q in ("ab", "a1b a", "aab1ab1b1a", "b b a", "1"):
        bound, ratio = (names._word_bound, fuzzy.token_set_ratio) if " " in q else (names._whole_bound, fuzzy.weighted_ratio)
        for x in df.select("t", bound(F.col("t"), F.col("w"), q).alias("b")).collect():
            assert ratio(q, x.t) <= x.b + 1e-9, (q, x.t)


@given(st.text("ab ", max_size=8), st.text("ab ", max_size=12))
@settings(max_examples=300, deadline=None)
def test_common_characters_bound_the_ratio(a, b):
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    assert fuzzy.lcs(a, b) <= common


def test_edges(index):
    assert names.name_search(index, "  ", 10).count() == 0
    assert names.name_search(index.limit(0), "cat", 10).count() == 0
    assert names.name_search(index, "night", 3).count() == 3
    assert names.name_search(index, "cat", 10**4).count() == 6006
