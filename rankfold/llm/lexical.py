"""Ranked lexical search: the best documents of every query text, exactly, over norm-ordered impact vectors.

A document's impact vector has a coordinate for each term that some query holds: the saturated frequency of the term in
the document. A query's vector has its terms' counts times their weights; the score is the inner product, in integers.

1. One scan of the documents counts the queries' terms (a broadcast dictionary) and all terms: the index is a table of
   (length, term numbers, frequencies), from which the counts of documents and of each term's documents come.
2. Impact vectors are dealt by range into norm buckets, longest first, and sorted within; ties of the norm are split by a
   hash of the id, so copies don't meet in one task.
3. The longest 1/FIRST of the vectors is searched first. Its k-th score is a lower bound that every task starts from;
   buckets whose norm can't reach any query's bound aren't read (a filter on the sorted column).
4. Inside a bucket a query is skipped if the Cauchy-Schwarz bound of the longest vector stays below its k-th score so
   far. Else its heaviest coordinates (FOCUS of the squared weight) are added up, and the bound of the others' product by
   the rest of both norms leaves few vectors; these are rescored over all coordinates in 64-bit integers.

Bounds are doubles with more slack than their rounding, and only what lies strictly below is dropped: ties survive.

Queries are taken in blocks of at most BLOCK (query, term) pairs, or one query if it alone is longer; a block's dictionary,
weights and bounds are what is broadcast and what the driver holds. Every block scans the documents once.

Edge cases: null and empty texts have no terms, and such documents are no results; a query without terms has no result;
rows of one query id are one query, equal rows counting once; documents in repeated rows each count and rank; equal
scores go by ascending id, null ids last; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, ship, written

BLOCK = 200_000
FIRST = 64
#: Share of a query's squared weight that its focus coordinates hold at least.
FOCUS = 0.995
SLACK = 1e-9

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and everything beyond ASCII, of UTF-8 bytes."""
    return text.translate(_LOWER).split()


class Queries:
    """A block of queries: by number, their term numbers and weights, heaviest first."""

    def __init__(self, counts: list[list[tuple[int, int]]], weight: np.ndarray):
        self.t, self.q, self.rest, self.focus, self.norm = [], [], [], [], []
        for own in counts:
            t = np.array([x[0] for x in own], np.int64)
            q = np.array([x[1] for x in own], np.int64) * weight[t]
            o = np.argsort(-q, kind="stable")
            t, q = t[o], q[o]
            energy = np.append(np.cumsum((q.astype(float) ** 2)[::-1])[::-1], 0.0)
            f = int(np.argmax(energy <= (1 - FOCUS) * energy[0]))
            self.t.append(t), self.q.append(q), self.rest.append(math.sqrt(energy[f])), self.focus.append(f), self.norm.append(math.sqrt(energy[0]))

    def __len__(self) -> int:
        return len(self.t)


class Bucket:
    """Impact vectors of about one norm: row offsets, term numbers, impacts, norms; and postings by term."""

    def __init__(self, offsets: np.ndarray, t: np.ndarray, p: np.ndarray, norm: np.ndarray, n_terms: int):
        self.offsets, self.t, self.p, self.norm, self.n = offsets, t, p, norm, len(norm)
        row = np.repeat(np.arange(self.n), np.diff(offsets))
        o = np.argsort(t, kind="stable")
        self.row, self.hit = row[o], p[o]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_terms))])
        self.longest = float(norm.max()) if self.n else 0.0
        self.dense = np.zeros(n_terms, np.int64)

    def search(self, qs: Queries, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that score `least` or more on query k, their scores, and how many were scored exactly."""
        none = np.zeros(0, np.int64)
        if not len(qs.t[k]) or qs.norm[k] * self.longest * (1 + SLACK) + 1 < least:
            return none, none, 0
        part, seen = np.zeros(self.n, np.int64), np.zeros(self.n)
        for j in range(qs.focus[k]):
            s = slice(self.starts[qs.t[k][j]], self.starts[qs.t[k][j] + 1])
            part[self.row[s]] += qs.q[k][j] * self.hit[s]
            seen[self.row[s]] += self.hit[s].astype(float) ** 2
        bound = part + qs.rest[k] * np.sqrt(np.maximum(self.norm**2 * (1 + SLACK) - seen, 0.0)) * (1 + SLACK) + 1
        rows = np.flatnonzero(bound >= least)
        if not len(rows):
            return none, none, 0
        self.dense[qs.t[k]] = qs.q[k]
        if 8 * len(rows) > self.n:
            sums = np.concatenate([[0], np.cumsum(self.dense[self.t] * self.p)])
            score = (sums[self.offsets[1:]] - sums[self.offsets[:-1]])[rows]
        else:
            score = np.array([int(self.dense[self.t[a:b]] @ self.p[a:b]) for a, b in zip(self.offsets[rows], self.offsets[rows + 1], strict=True)], np.int64)
        self.dense[qs.t[k]] = 0
        keep = score >= least
        return rows[keep], score[keep], len(rows)


def best(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The k first by score, then by id, null last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]


def _lists(column: pa.ListArray, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _blocks(pairs: DataFrame) -> int:
    """How many blocks by hash of the query's number keep each at BLOCK pairs or one query."""
    n = max(1, -(-2 * pairs.count() // BLOCK))
    while True:
        size = pairs.groupBy(F.pmod("ix", F.lit(n)).alias("b")).agg(F.count("*").alias("n"), F.min("ix").alias("a"), F.max("ix").alias("z"))
        if size.filter((F.col("n") > BLOCK) & (F.col("a") < F.col("z"))).isEmpty():
            return n
        n *= 2


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(id, n, t, f): the number of terms, and the numbers and frequencies of those that queries hold. docs: (id, t)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(numbers)  # at most BLOCK terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, at, t, f = [], [0], [], []
            for text in batch.column("t").cast(pa.binary()):
                words = terms(text.as_py() or b"")
                held = Counter(map(number, words))
                held.pop(None, None)
                n.append(len(words)), t.extend(held.keys()), f.extend(held.values()), at.append(len(t))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (t, f)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], names=["id", "n", "t", "f"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, t array<int>, f array<int>")


def impacts(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(id, norm, t, p) of the indexed rows that hold a query's term; p: impacts."""
    m = 25 + F.expr(f"CAST((75BD * n * {n_docs}BD) div {n_terms}BD AS LONG)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = _lists(batch.column("f"), np.int64)
            size = batch.column("t").value_lengths().to_numpy(zero_copy_only=False)
            m = np.repeat(batch.column("m").to_numpy(zero_copy_only=False), size)
            p = (1_000_000_000 * f) // (1000 * f + 8 * m)
            at = np.concatenate([[0], np.cumsum(size)])
            norm = np.sqrt(np.add.reduceat(p.astype(float) ** 2, at[:-1]))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(p, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm, pa.float64()), batch.column("t"), lists], names=["id", "norm", "t", "p"])

    held = rows.filter(F.size("t") > 0).select("id", m.alias("m"), "t", "f")
    return held.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, norm double, t array<int>, p array<long>")


def search(vectors: DataFrame, queries, n_terms: int, least: list[int], k: int) -> DataFrame:
    """(ix, id, score): every task's k best of each query that reach the query's least score."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs: Queries = queries.value
        floor, top = list(least), [[] for _ in range(len(qs))]
        for batch in batches:
            lists = batch.column("t")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            b = Bucket(at, _lists(lists, np.int64), _lists(batch.column("p"), np.int64), batch.column("norm").to_numpy(zero_copy_only=False), n_terms)
            ids = batch.column("id")
            for j in range(len(qs)):
                rows, score, _ = b.search(qs, j, floor[j])
                if len(rows) > k:
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[score >= cut], score[score >= cut]
                if len(rows):
                    top[j] = best(top[j] + list(zip(score.tolist(), ids.take(pa.array(rows)).to_pylist(), strict=True)), k)
                    if len(top[j]) == k:
                        floor[j] = max(floor[j], top[j][-1][0])
        if found := [(j, i, s) for j, own in enumerate(top) for s, i in own]:
            ix, i, s = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ix, pa.int32()), pa.array(i, ids.type), pa.array(s, pa.int64())], names=["ix", "id", "score"])

    return vectors.mapInArrow(run, f"ix int, id {kind}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("ix").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, id, score): the k best documents of every query text, from rank 1, with scores above 0."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind, item_kind = dict(d.dtypes)["id"], dict(items.dtypes)[item_col]
    wanted = items.select(F.col(item_col).alias("item"), F.encode(item_text_col, "UTF-8").alias("t")).distinct()
    asked = wanted.groupBy("item").agg(F.collect_list("t").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, c = [], [], []
            for row, texts in enumerate(batch.column("t").to_pylist()):
                held = Counter(w for t in texts for w in terms(t))
                at.extend([row] * len(held)), term.extend(held.keys()), c.extend(held.values())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int32())), pa.array(term, pa.binary()), pa.array(c, pa.int32())], names=["item", "term", "c"])

    pairs = written(asked.mapInArrow(count, f"item {item_kind}, term binary, c int").withColumn("ix", F.xxhash64("item")), "lexical-items")
    out = None
    n = _blocks(pairs)
    for number in range(n):
        own = pairs.filter(F.pmod("ix", F.lit(n)) == number).collect()  # BLOCK pairs, or one query
        if not own:
            continue
        ids = list(dict.fromkeys(r.item for r in own))
        place = {x: j for j, x in enumerate(ids)}
        numbers = {x: j for j, x in enumerate(sorted({bytes(r.term) for r in own}))}
        counts: list[list[tuple[int, int]]] = [[] for _ in ids]
        for r in own:
            counts[place[r.item]].append((numbers[bytes(r.term)], r.c))
        found = _block(d, counts, numbers, k)
        if found is None:
            continue
        names = spark.createDataFrame(list(enumerate(ids)), f"ix int, item {item_kind}")
        rows = _top(found, k).join(F.broadcast(names), "ix").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")  # a block's queries
        out = rows if out is None else out.unionByName(rows)
    discard(pairs)
    return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long") if out is None else out


def _block(d: DataFrame, counts: list[list[tuple[int, int]]], numbers: dict[bytes, int], k: int) -> DataFrame | None:
    """(ix, id, score) of a block's queries: all of the k best, and little else."""
    spark, kind = d.sparkSession, dict(d.dtypes)["id"]
    rows = written(index(d, numbers), "lexical-index")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        discard(rows)
        return None
    df = dict(rows.select(F.explode("t").alias("t")).groupBy("t").count().collect())  # at most BLOCK terms
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(j, 0) + 1))) for j in range(len(numbers))], np.int64)
    qs = Queries(counts, weight)
    shared = spark.sparkContext.broadcast(qs)
    dealt = impacts(rows, n_docs, n_terms).repartitionByRange(F.col("norm").desc(), F.xxhash64("id")).sortWithinPartitions(F.col("norm").desc())
    vectors = written(dealt, "lexical-buckets")
    discard(rows)
    least = [1] * len(qs)
    cut = vectors.agg(F.percentile_approx("norm", 1 - 1 / FIRST)).first()[0]
    if cut is None:
        discard(vectors)
        return None
    first = _top(search(vectors.filter(F.col("norm") >= cut), shared, len(numbers), least, k), k).drop("rank").collect()  # k rows a query
    scores: dict[int, list[int]] = {}
    for r in first:
        scores.setdefault(r.ix, []).append(r.score)
    least = [min(s) if len(s := scores.get(j, [])) == k else 1 for j in range(len(qs))]
    # No query can be answered by a shorter vector than this.
    reach = min((x / n for x, n in zip(least, qs.norm, strict=True) if n), default=0.0)
    rest = vectors.filter((F.col("norm") < cut) & (F.col("norm") >= reach * (1 - 1e-6)))
    found = written(search(rest, shared, len(numbers), least, k).unionByName(spark.createDataFrame(first, f"ix int, id {kind}, score long")), "lexical-found")
    discard(vectors)
    return found
