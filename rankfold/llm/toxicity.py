"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents and invisible marks, and maps homoglyphs and digit substitutions to Latin
letters. The lexicon is learned from labelled training rows: whole words, and stems (the first letters of words, for
languages that inflect), weighted by the lower bound of their log odds, counted over distinct contexts (previous word),
so copies of one text count once; a stem needs several words. At each word the greatest weight that matches counts.
Two-word phrases that hold a lexicon word common in clean rows, occur in several clean rows and in no toxic row, are
exceptions and cancel the match inside. A logistic curve over the matched weight, its density by length, how many and
how many different words match, and the length calibrates the score.

Nothing of the lexicon is cut off: entries and exceptions are bounded by the words of the labelled sample (each needs
SUPPORT contexts, or REPEATS rows), whose rows are bounded by SAMPLE. LIMIT checks the size before the broadcast.

Edge cases: null and empty texts get the score of a text without matches; without training rows of both kinds
the lexicon is empty and all scores are equal; a null id is never held out; an empty table gives an empty
result; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, written

#: Labelled training rows used at most, in the order of a hash of their id.
SAMPLE = 12_000
#: Contexts that an entry needs among toxic rows, clean rows that an exception needs, lengths of stems, words of a stem,
#: least weight, and entries that are broadcast at most (more raise an error instead of being dropped).
SUPPORT, REPEATS, STEMS, KIN, LEAST, LIMIT = 5, 2, range(4, 9), 4, 1.0, 1_000_000

#: Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "з": "3", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D6A4)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if len(plain) == 1:
            out[c] = plain
    out |= {c: None for c in [0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x300, 0x370)]}
    for a, b in (HOMOGLYPHS | DIGITS).items():
        b = DIGITS.get(b, b)
        out[ord(a)] = b
        if len(a.upper()) == 1:
            out.setdefault(ord(a.upper()), b)
    return out


TABLE = _table()
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower().translate(TABLE)
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


def _spellings(entry: str) -> list[str]:
    """An entry, and with its first letters l read as i: 1 stands for either."""
    at = [k for k, c in enumerate(entry) if c == "l"][:4]
    out = []
    for pick in product("li", repeat=len(at)):
        e = list(entry)
        for k, c in zip(at, pick, strict=True):
            e[k] = c
        out.append("".join(e))
    return out


class Lexicon:
    """weights: by word, or by stem with a star at its end."""

    def __init__(self, weights: dict[str, float], exceptions: set[str]):
        self.machine = ahocorasick.Automaton()
        # A word and a stem may be spelled alike: whole word's weight, stem's weight, exception.
        found: dict[str, list] = {}
        for e in sorted(exceptions):
            for s in _spellings(e):
                found.setdefault(s, [None, None, False])[2] = True
        for e, w in sorted(weights.items()):
            stem = e.endswith("*")
            for s in _spellings(e.rstrip("*")):
                slot = found.setdefault(s, [None, None, False])
                slot[stem] = max(slot[stem] or 0.0, w)
        for s, (word, stem, free) in found.items():
            self.machine.add_word(s, (len(s), word, stem, free))
        if len(self.machine):
            self.machine.make_automaton()

    def weigh(self, text: str) -> tuple[float, int, int, int]:
        """The matched weight outside exception phrases, the matches, the different matching words, and the number of words."""
        n = len(text.split())
        if not len(self.machine):
            return 0.0, 0, 0, n
        t = fold(text)
        found: dict[int, float] = {}
        free = []
        for end, (k, word, stem, exempt) in self.machine.iter(t):
            a, b = end - k + 1, end + 1
            if a and t[a - 1].isalpha():
                continue
            whole = b >= len(t) or not t[b].isalpha()
            if exempt and whole:
                free.append((a, b))
            w = max(word if word is not None and whole else 0.0, stem or 0.0)
            if w > found.get(a, 0.0):
                found[a] = w
        if free:
            found = {a: w for a, w in found.items() if not any(x <= a < y for x, y in free)}
        different = {_LETTERS.match(t, a)[0] for a in found}
        return float(sum(found.values())), len(found), len(different), n


def inputs(weight: np.ndarray, hits: np.ndarray, different: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.maximum(words, 1)
    return np.column_stack([np.ones(len(weight)), weight > 0, np.log1p(weight), np.log1p(100 * weight / n), np.log1p(hits), np.log1p(different), np.log1p(100 * hits / n), np.log1p(words) / 10])


def _odds(a: float, b: float, ta: float, tb: float) -> float:
    """Lower bound (two standard errors) of the log odds of being toxic, from counts a of ta and b of tb."""
    p, q, r, s = a + 0.5, b + 0.5, ta - a + 0.5, tb - b + 0.5
    return math.log(p * s / (q * r)) - 2 * math.sqrt(1 / p + 1 / q + 1 / max(r, 0.5) + 1 / max(s, 0.5))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(t, hy) of the rows of at most SAMPLE labels that aren't held out: text, and a hash of the id with the label."""
    sample = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id").select("t", "y", F.struct(F.xxhash64("id").alias("h"), "y").alias("hy"))  # SAMPLE rows of two numbers


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], set[str]]:
    def run(batches):
        for batch in batches:
            rows = []
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = _LETTERS.findall(fold(t or ""))
                rows += {(w, before, bool(y)) for before, w in zip(["", *words], words, strict=False) if 3 <= len(w) <= 24}
            w, before, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(before, pa.string()), pa.array(y, pa.bool_())], names=["w", "before", "y"])

    rows = train.mapInArrow(run, "w string, before string, y boolean").groupBy("w", "before").agg(F.max("y").alias("bad"), F.max(~F.col("y")).alias("good"), F.count_if(~F.col("y")).alias("n"))
    seen = written(rows, "toxicity-contexts")
    counts = written(seen.groupBy("w").agg(F.count_if("bad").alias("a"), F.count_if("good").alias("b")), "toxicity-words")
    ta, tb = (x or 0 for x in counts.agg(F.sum("a"), F.sum("b")).first())
    stems = counts.select(F.explode(F.array(*[F.when(F.char_length("w") > k, F.substring("w", 1, k)) for k in STEMS])).alias("w"), "a", "b").dropna(subset=["w"])
    stems = stems.groupBy(F.concat("w", F.lit("*")).alias("w")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("kin")).filter(F.col("kin") >= KIN).drop("kin")
    fit = counts.unionByName(stems).filter((F.col("a") >= SUPPORT) & (F.col("a") > F.col("b") * F.lit(ta / max(tb, 1))))
    rows = fit.orderBy("w").limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError("the lexicon has too many entries to broadcast: raise SUPPORT or lower SAMPLE")
    weights = {r.w: o for r in rows if (o := _odds(r.a, r.b, ta, tb)) > LEAST}
    often = [r.w for r in rows if r.w in weights and r.b >= 3]
    if not often:
        discard(seen, counts)
        return weights, set()
    words = train.sparkSession.createDataFrame([(w,) for w in often], "w string")
    clean = seen.filter(F.col("good") & ~F.col("bad") & (F.col("before") != "") & (F.col("n") >= REPEATS)).join(words, "w", "left_semi")
    phrases = clean.select(F.concat_ws(" ", "before", "w")).limit(LIMIT + 1).collect()
    if len(phrases) > LIMIT:
        raise ValueError("too many exception phrases to broadcast: raise REPEATS or lower SAMPLE")
    discard(seen, counts)
    return weights, {p[0] for p in phrases}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method on a bounded sample."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


WEIGHED = ("weight", "hits", "different", "words")


def _weighed(df: DataFrame, keep: str, kind: str, lexicon) -> DataFrame:
    def run(batches):
        machine = Lexicon(*lexicon.value)
        for batch in batches:
            got = [machine.weigh(t or "") for t in batch.column("t").to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[keep, *WEIGHED])

    return df.select(keep, "t").mapInArrow(run, f"{keep} {kind}, weight double, hits long, different long, words long")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row per document: whether its label was held out, score in (0, 1), prediction."""
    spark = docs.sparkSession
    ship(spark)
    train = training(docs, labels, id_col, text_col, label_col)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(train))
    rows = _weighed(train, "hy", dict(train.dtypes)["hy"], lexicon).select("hy.*", *WEIGHED)
    rows = rows.orderBy("h", "y", *WEIGHED).limit(SAMPLE).toPandas()  # numbers, bounded also where an id is on many rows
    rows = rows.sort_values(["y", *WEIGHED])  # sums don't depend on the order of partitions
    y = rows["y"].to_numpy(float)
    x = inputs(*(rows[c].to_numpy(float) for c in WEIGHED))
    w = logistic(x, y) if 0 < y.sum() < len(y) else np.zeros(x.shape[1])
    c = [float(v) for v in w]
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    d = _weighed(d, "id", dict(d.dtypes)["id"], lexicon)
    hit, n = F.col("weight"), F.greatest(F.col("words"), F.lit(1))
    z = F.lit(c[0]) + c[1] * (hit > 0).cast("double") + c[2] * F.log1p(hit) + c[3] * F.log1p(100 * hit / n) + c[4] * F.log1p(F.col("hits").cast("double"))
    z = z + c[5] * F.log1p(F.col("different").cast("double")) + c[6] * F.log1p(100 * F.col("hits") / n) + c[7] * F.log1p(F.col("words").cast("double")) / 10
    d = d.withColumn("score", 1 / (1 + F.exp(-z)))
    return d.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
