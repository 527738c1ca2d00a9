"""Every registered query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from rankfold.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck, rows_of):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_operators(monkeypatch):
    """The rest imports and registers when that subpackage and the pipeline are gone."""
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("rankfold.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    names = e.queries()
    assert "recommendation_score" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    e.oracle_sql()
