"""Fuzzy string ratios by the published definitions of the normalised indel similarity, in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel in one integer."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one of its length (or cut at the ends)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, best = len(a), 0.0
    need, have, common = Counter(a), Counter(), 0
    for k in range(1 - n, len(b)):
        # Characters that part and string share, counted as the part slides along: no ratio is above that share.
        if k + n <= len(b):
            c = b[k + n - 1]
            common += have[c] < need[c]
            have[c] += 1
        if k > 0:
            c = b[k - 1]
            have[c] -= 1
            common -= have[c] < need[c]
        part = b[max(0, k) : k + n]
        if 200.0 * common / (n + len(part)) > best:
            best = max(best, ratio(a, part))
    return best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if both else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))) if x and y else 0.0


def weighted_ratio(a: str, b: str) -> float:
    """The weighted ratio: plain, token-wise, and for very different lengths partial ratios at a discount."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def fuzzy_score(query: str, full: Column, base: Column) -> Column:
    """The better of 1.3 times the base name's ratio and the full path's; all are normalised texts."""
    score = token_set_ratio if " " in query else weighted_ratio

    @F.pandas_udf("double")
    def scored(f: pd.Series, b: pd.Series) -> pd.Series:
        once = {t: score(query, t) for t in {t or "" for t in [*f, *b]}}  # names repeat
        return pd.Series([max(1.3 * once[y or ""], once[x or ""]) for x, y in zip(f, b, strict=True)], dtype=float)

    return scored(full, base)
