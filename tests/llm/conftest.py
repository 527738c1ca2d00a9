from __future__ import annotations

import random

import pytest



def story(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "un", "vos", "re", "di"]) for _ in range(r.randint(1, 4))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, id string, th string, target double, fp long, t string, a int, c int"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), "clash", 7, "clash", "clash", 0.5, 3, "clash", 1, 2)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    return [
        row(1, story(1)), row(2, story(1)), row(3, story(2), None, None), row(4, ""), row(5, None), row(6, "   \n\t "), row(None, story(3)), row(8, story(4), "de", None),
        row(9, story(5)), row(9, story(5)), row(10, "one"), row(11, story(6, 20_000)), row(12, "the " * 500), row(13, "nul\x00byte é 日本語 \U0001f600 " * 30), row(None, None, None, None), row(15, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(1, 14)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
