"""Strings nested in JSON."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.functions import text as T


def strings(x):
    if isinstance(x, dict):
        return [s for v in x.values() for s in strings(v)]
    if isinstance(x, list):
        return [s for v in x for s in strings(v)]
    return [x] if isinstance(x, str) else []


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text('ab":\\/.,[]{}\n é', max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k":\\.', max_size=3), x, max_size=3), max_leaves=12)


@given(st.lists(VALUES, min_size=20, max_size=40))
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
def test_strings_at_any_depth(spark, values):
    rows = [(k, json.dumps(v, ensure_ascii=k % 2 == 0, indent=None if k % 3 else 1)) for k, v in enumerate(values)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, p string").select("k", T.json_strings(F.col("p")).alias("s")).collect()}
    assert got == {k: strings(v) for k, v in enumerate(values)}


@pytest.mark.parametrize(
    ("payload", "bad"),
    [
        ({"path": "../../../etc/passwd"}, True), ({"data": {"file": "../../secret.txt"}}, True), ({"files": ["normal.jpg", "../../../etc/passwd"]}, True), ({"folder": "images/vacation"}, False),
        ({"a": [{"b": [{"c": "%252e%252e/x"}]}]}, True), ({"../x": "fine"}, False), ({"q": "....flac"}, False),
    ],
)
def test_payloads(spark, payload, bad):
    row = spark.createDataFrame([(json.dumps(payload),)], "p string")
    assert row.select(F.exists(T.json_strings(F.col("p")), T.is_unsafe)).first()[0] is bad


def test_not_json(spark):
    long = "[" * 200 + '"' + "a\\\\" * 50_000 + '"' + "]" * 200
    df = spark.createDataFrame([(0, None), (1, ""), (2, "{not json"), (3, '["open'), (4, long)], "k int, p string")
    got = {r.k: r.s for r in df.select("k", T.json_strings(F.col("p")).alias("s")).collect()}
    assert got[0] == [] and got[1] == [""] and got[2] == ["{not json"] and got[3] == ['["open'] and [len(x) for x in got[4]] == [100_000]
