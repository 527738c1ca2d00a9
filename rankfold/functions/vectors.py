"""Vector columns: array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels and the symbols of a fingerprint.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz012345"


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def is_unindexed(a: Column, least: float = 1e-5) -> Column:
    """A missing vector: null, empty, or too short to have a direction."""
    return F.coalesce(norm(a) < F.lit(least), F.lit(True))


def is_blank(a: Column, least: float = 1e-5) -> Column:
    """A missing chunk: no component stands out."""
    return F.coalesce(F.forall(a, lambda x: F.abs(x) <= F.lit(least)), F.lit(True))


def fingerprint(a: Column) -> Column:
    """Every dimension's rank as one of 32 symbols; empty for a missing vector.

    The ranks come from one sort of (value, place) and one of (place, rank), so a row costs O(D log D).
    """
    levels = len(SYMBOLS)
    ordered = F.array_sort(F.transform(a, lambda x, k: F.struct(x.alias("x"), k.alias("k"))))
    back = F.array_sort(F.transform(ordered, lambda s, r: F.struct(s["k"].alias("k"), r.alias("r"))))
    symbols = F.transform(back, lambda s: F.substring(F.lit(SYMBOLS), (F.floor(s["r"] * levels / F.size(a)) + 1).cast("int"), F.lit(1)))
    return F.when(is_unindexed(a, 1e-6), F.lit("")).otherwise(F.array_join(symbols, " "))
