"""Quality rules: a learned decision list over text statistics.

Sequential covering on a bounded sample of labelled documents: a rule is grown condition by condition by
information gain, pruned on held-back rows, and accepted while its precision there is high; what it covers is
set aside and the next rule is grown. The ordered list becomes one Spark conditional expression, applied to the
statistics of all documents. Only documents that a rule of high precision covers are rejected.

Edge cases: a null text is an empty one (no words, so it fails the base rule); without labelled rows of both
kinds the list is empty and the base rule alone decides; repeated rows are judged alike; an empty table gives an
empty result; further columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ship

#: Labelled rows that the list is fitted on at most, taken in the order of a hash of their id.
SAMPLE = 20_000
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
_UPPER = bytes(range(65, 91))
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_MARKS = b"!?;:_=~^\\/{}[]@+"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more, the first one included."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    n, end = 0, 0
    for at, g in enumerate(grams):
        if often[g] > 1:
            n += at + window - max(at, end)
            end = at + window
    return n


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    b = text or b""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
    less = lambda chars: len(b) - len(b.translate(None, chars))
    return (
        len(words), len(b.translate(None, _CONTINUES + _SPACE)), less(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), less(_UPPER), less(_MARKS), len(set(words)),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns of docs, followed by the COUNTS of its texts."""
    ship(docs.sparkSession)
    new = [prefix + c for c in COUNTS]
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in new)])

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            stats = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *stats], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def features(prefix: str = "") -> dict[str, Column]:
    """What rules speak of: shares that don't depend on a text's length, and the length."""
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}
    words, chars, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    return {
        "words": c["n_words"], "word_length": c["word_chars"] / words, "symbols_a_word": c["n_symbols"] / words, "repeated_lines": c["n_dup_lines"] / lines,
        "repeated_words": c["n_repeat_words"] / words, "capitals": c["n_upper"] / chars, "marks_a_word": c["n_marks"] / words, "variety": c["n_distinct"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] <= self.value

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.value if self.above else of[self.feature] <= self.value


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for c in rule:
        m &= c.mask(x)
    return m


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (bad[inside].sum() < inside.sum()):
        p0, n0 = bad[inside].sum(), inside.sum()
        best, found = 0.0, None
        for name, v in x.items():
            values = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, cuts)))
            for value in values:
                for above in (True, False):
                    m = inside & (v >= value if above else v <= value)
                    p, n = bad[m].sum(), m.sum()
                    if p and (gain := p * (math.log2(p / n) - math.log2(p0 / n0))) > best + 1e-9:
                        best, found = gain, Condition(name, above, float(value))
        if found is None:
            break
        rule, inside = (*rule, found), inside & found.mask(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, support: int = 3, longest: int = 4, most: int = 16, cuts: int = 33) -> list[Rule]:
    """Ordered rules for bad rows. Every third row is held back to prune and to accept rules."""
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most:
        g, h = left & ~held, left & held
        if bad[g].sum() < support:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], longest, cuts)
        xh, bh = {k: v[h] for k, v in x.items()}, bad[h]

        def worth(r: Rule) -> float:
            m = _covers(r, xh, len(bh))  # noqa: B023
            return (2 * bh[m].sum() - m.sum()) / max(1, m.sum()) + 1e-3 * bh[m].sum() / max(1, bh.sum()) if r else -1.0  # noqa: B023

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        covered = _covers(rule, x, len(bad)) & left
        n_held, n_all = (covered & held).sum(), covered.sum()
        if not rule or bad[covered].sum() < support or bad[covered & held].sum() < precision * n_held or bad[covered].sum() < precision * n_all:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learns from at most SAMPLE labelled rows; label 0 is bad."""
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")  # SAMPLE rows of two numbers
    rows = with_statistics(texts, "t").select(F.xxhash64("id").alias("h"), "y", *[c.alias(k) for k, c in features().items()]).orderBy("h", "y", "words").limit(SAMPLE).toPandas()
    rows = rows[rows["words"] >= MIN_WORDS]
    bad = (rows["y"].to_numpy() == 0) if len(rows) else np.zeros(0, bool)
    if not bad.any() or bad.all():
        return []
    return learn({k: rows[k].to_numpy(float) for k in features()}, bad)


def rejected(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as a conditional expression: true where the first rule that fires rejects."""
    of = features(prefix)
    out = None
    for rule in rules:
        fires = rule[0].column(of)
        for c in rule[1:]:
            fires = fires & c.column(of)
        out = F.when(fires, True) if out is None else out.when(fires, True)
    return F.lit(False) if out is None else out.otherwise(False)


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEATED * F.col(prefix + "n_words"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base statistics, whether the base rule fails, and the verdict."""
    rules = fit(docs, labels, id_col, text_col)
    d = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t")
    kept = ~base_failed() & ~rejected(rules)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their columns."""
    rules = fit(docs, labels, id_col, text_col)
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    d = with_statistics(docs, text_col, prefix)
    return d.filter(~base_failed(prefix) & ~rejected(rules, prefix)).select(*[f"`{c}`" for c in docs.columns])
