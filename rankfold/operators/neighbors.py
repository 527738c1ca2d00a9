"""Exact nearest neighbours over pivots.

1. Equal vectors meet by a grouping; one of them, of least key, stands for all from here on.
2. A bounded number of items, chosen by hash, are pivots; every item goes to the cell of its nearest pivot, and large
   cells are dealt into blocks by hash.
3. Inside its block every item finds its nearest; that, or the nearest other pivot, is an upper bound of its distance.
4. With the cells' radii and the triangle inequality, an item's bound says which other cells may hold something nearer:
   those whose ring around their pivot it reaches, on its own side of the plane between the two pivots or close to it.
   Blocks lie in bundles, and an item is sent once to each bundle that holds such a cell; there it is compared with the
   part of each cell's ring that its bound reaches, and every comparison lowers the bound for the next.

How much that saves depends on the data: clustered vectors are compared with few cells; where all distances are about
equal (random directions in many dimensions) no bound rules anything out and the work is quadratic, in tasks of at most
two bundles: memory stays that of two bundles, and what is shuffled is the vectors times the number of bundles. Bounds have more slack than the rounding of distances, and equally near items compare by exact distance,
then by key.

Edge cases: null vectors are left out; a single item has no neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Pivots at most; they are broadcast.
PIVOTS = 4096
#: Rows of a bundle at most, and bundles at least, so that few rows keep all cores busy too.
BUNDLE, BUNDLES = 16384, 8
#: Rows whose distances to all pivots are held at once.
PART = 512
#: Items that are compared with a part of a ring at once.
STEP = 64
#: Slack of a bound, by the length of the vectors: far above the rounding of distances by matrix products.
SLACK = 1e-6


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0.0))


def closest(p: np.ndarray, q: np.ndarray, itself: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each p the place of the nearest q and its exact distance, inf if there is none; q are in the order of their
    keys. itself: p's that are among q, and their places there, which don't count."""
    d = (-2 * p) @ q.T
    d += (q * q).sum(1)[None, :]
    row = np.arange(len(p))
    if itself is not None:
        d[itself] = np.inf
    best = d.argmin(1)
    least = d[row, best]
    none = ~np.isfinite(least)
    # What is as near but for rounding is compared by exact distance, then by key.
    slack = 1e-9 * ((p * p).sum(1) + (q * q).sum(1).max())
    for r in np.flatnonzero(~none & (np.count_nonzero(d <= (least + slack)[:, None], axis=1) > 1)):
        at = np.flatnonzero(d[r] <= least[r] + slack[r])
        best[r] = at[((p[r] - q[at]) ** 2).sum(1).argmin()]
    return best, np.where(none, np.inf, np.sqrt(((p - q[best]) ** 2).sum(1)))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), PART):
            yield pdf.iloc[k : k + PART]


def nearest_neighbor(items: DataFrame, key: str = "vec_id", embedding: str = "embedding", block: int = 2048, queries: DataFrame | None = None, counter: Accumulator | None = None) -> DataFrame:
    """(key, neighbor, distance) to the nearest other item, least key of equals. queries (key): the items asked for.

    block: rows of a task's side at most, but for what one key repeats. counter: adds up the distances computed.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[key]
    rows = items.filter(F.col(embedding).isNotNull()).select(F.col(key).alias("i"), F.col(embedding).alias("v"))
    rows = rows.withColumn("w", F.lit(True)) if queries is None else rows.join(queries.select(F.col(key).alias("i")).distinct().withColumn("w", F.lit(True)), "i", "left").fillna(False, ["w"])
    rows = stored(rows, "nearest-items")
    heads = stored(rows.groupBy("v").agg(F.min("i").alias("i"), F.count("*").alias("n"), F.max("w").alias("any")), "nearest-distinct")
    own = heads.join(rows.select(F.col("i").alias("__i"), "w"), F.col("i") == F.col("__i")).select("i", "v", "w")
    single = heads.filter("n = 1").select("i")
    found = _distinct(own, heads.count(), kind, block, counter).join(single, "i", "left_semi")
    # Copies: the least key, and for that the least of the others.
    copies = rows.join(heads.filter("n > 1").select("v", F.col("i").alias("first")), "v")
    others = copies.filter(F.col("i") != F.col("first"))
    least = others.groupBy("first").agg(F.min("i").alias("j"))
    head = copies.filter((F.col("i") == F.col("first")) & F.col("w")).select("i").join(least, F.col("i") == F.col("first")).select("i", "j")
    equal = others.filter("w").select("i", F.col("first").alias("j")).unionByName(head).withColumn("d", F.lit(0.0))
    return found.unionByName(equal).select(F.col("i").alias(key), F.col("j").alias("neighbor"), F.col("d").alias("distance"))


def _distinct(rows: DataFrame, n: int, kind: str, block: int, counter: Accumulator | None) -> DataFrame:
    """(i, j, d) for distinct vectors (i, v, w), of those with w."""
    spark = rows.sparkSession
    if n <= block:

        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i").reset_index(drop=True)
            x, i, asked = _stack(pdf["v"]), pdf["i"].to_numpy(), np.flatnonzero(pdf["w"].to_numpy(bool))
            if counter is not None:
                counter.add(len(asked) * len(x))
            best, d = closest(x[asked], x, (np.arange(len(asked)), asked)) if len(asked) else (asked, np.zeros(0))
            fine = np.isfinite(d)
            return pd.DataFrame({"i": i[asked][fine], "j": i[best][fine], "d": d[fine]})

        return rows.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(1))).groupBy("b").applyInPandas(alone, f"i {kind}, j {kind}, d double")  # one block
    rows = stored(rows, "nearest-heads")
    many = min(PIVOTS, -(-4 * n // block))
    chosen = rows.orderBy(F.xxhash64("i"), "i").limit(many).select("i", "v").orderBy("i").toPandas()  # PIVOTS rows
    if not len(chosen):
        return spark.createDataFrame([], f"i {kind}, j {kind}, d double")
    pivots, names = _stack(chosen["v"]), chosen["i"].to_numpy()
    far, longest = distances(pivots, pivots), float(np.sqrt((pivots * pivots).sum(1)).max())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            x = _stack(pdf["v"])
            d = distances(x, pivots)
            if counter is not None:
                counter.add(d.size)
            cell = d.argmin(1)
            # The nearest pivot that isn't the item itself is an upper bound.
            d[pdf["i"].to_numpy()[:, None] == names[None, :]] = np.inf
            at = d.argmin(1)
            bound = np.where(np.isfinite(d.min(1)), np.sqrt(((x - pivots[at]) ** 2).sum(1)), np.inf)
            yield pdf.assign(c=cell.astype("int32"), r=np.sqrt(((x - pivots[cell]) ** 2).sum(1)), j=names[at], d=bound)

    placed = stored(rows.mapInPandas(assign, f"i {kind}, v array<double>, w boolean, c int, r double, j {kind}, d double"), "nearest-placed")
    stats = placed.groupBy("c").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # PIVOTS rows
    low, high, blocks = np.full(many, np.inf), np.full(many, -np.inf), np.ones(many, int)
    for s in stats:
        low[s.c], high[s.c], blocks[s.c] = s.low, s.high, -(-s.n // block)
    split = spark.createDataFrame([(s.c, int(blocks[s.c])) for s in stats], "c int, nb int")
    dealt = placed.join(F.broadcast(split), "c").withColumn("b", F.pmod(F.xxhash64("i"), "nb").cast("int"))  # PIVOTS rows

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        x, asked = _stack(pdf["v"]), np.flatnonzero(pdf["w"].to_numpy(bool))
        if len(asked):
            best, d = closest(x[asked], x, (np.arange(len(asked)), asked))
            if counter is not None:
                counter.add(len(asked) * len(pdf))
            i, j, bound = pdf["i"].to_numpy(), pdf["j"].to_numpy().copy(), pdf["d"].to_numpy().copy()
            better = (d < bound[asked]) | ((d == bound[asked]) & (i[best] < j[asked]))
            j[asked[better]], bound[asked[better]] = i[best[better]], d[better]
            pdf = pdf.assign(j=j, d=bound)
        return pdf

    schema = f"i {kind}, v array<double>, w boolean, c int, b int, r double, j {kind}, d double"
    ready = dealt.select("i", "v", "w", "c", "b", "r", "j", "d").groupBy("c", "b").applyInPandas(inside, schema)
    ready = stored(ready, "nearest-bounds")

    # Cells by their place along a chain of near pivots, so that a bundle's blocks lie near each other.
    bundle, place = max(block, min(BUNDLE, -(-n // BUNDLES))), np.zeros(many, int)
    held = {s.c: s.n for s in stats}
    todo, at = np.ones(many, bool), 0
    for k in range(many):
        place[at], todo[at] = k, False
        at = int(np.where(todo, far[at], np.inf).argmin())
    first, rows_before, number = np.zeros(many, int), 0, 0
    for c in place.argsort():
        each = held.get(c, 0) / blocks[c]
        first[c] = number
        for _ in range(blocks[c] if c in held else 0):
            if rows_before and rows_before + each > bundle:
                number, rows_before = number + 1, 0
            rows_before += each
        # A cell of several blocks may reach over bundles: its blocks are dealt to them in turn.
        blocks[c] = number - first[c] + 1
    last = first + blocks - 1
    start = spark.createDataFrame([(int(c), int(first[c]), int(blocks[c])) for c in held], "c int, f int, nf int")
    there = ready.select("c", "i", "v", "r").join(F.broadcast(start), "c").select((F.col("f") + F.pmod(F.xxhash64("i", F.lit(1)), "nf").cast("int")).alias("th"), F.col("c").alias("tc"), F.col("i").alias("ti"), F.col("v").alias("tv"), F.col("r").alias("tr"))  # PIVOTS rows

    def reached(x: np.ndarray, c: np.ndarray, r: np.ndarray, bound: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the cells may hold something within the bounds, and the distances to their pivots."""
        d = distances(x, pivots[cells])
        between = np.maximum(far[c][:, cells], 1e-300)
        plane = (d**2 - (r**2)[:, None]) / (2 * between)
        plane[c[:, None] == cells[None, :]] = 0.0
        least = np.maximum(np.maximum(d - high[None, cells], low[None, cells] - d), plane)
        slack = SLACK * (np.sqrt((x * x).sum(1)) + longest)[:, None] * (1 + d / np.where(far[c][:, cells] > 0, far[c][:, cells], np.inf))
        return (least <= bound[:, None] + slack) & np.isfinite(high)[None, cells], d

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            x, c = _stack(pdf["v"]), pdf["c"].to_numpy()
            reach, d = reached(x, c, pdf["r"].to_numpy(), pdf["d"].to_numpy(), np.arange(many))
            if counter is not None:
                counter.add(d.size)
            sent = np.zeros((len(c), number + 1), bool)
            for cell in np.flatnonzero(reach.any(0)):
                sent[:, first[cell] : last[cell] + 1] |= reach[:, cell, None]
            row, to = np.nonzero(sent)
            yield pdf.iloc[row].drop(columns=["w"]).assign(h=to.astype("int32"))

    # An item's sender is the bundle number of its own cell: so a task has a bundle on either side at most.
    sent = ready.filter("w").select("i", "v", "w", "c", "r", "j", "d").mapInPandas(route, f"i {kind}, v array<double>, c int, r double, j {kind}, d double, h int")
    sent = sent.join(F.broadcast(start), "c").withColumn("y", F.col("f") + F.pmod(F.xxhash64("i", F.lit(1)), "nf").cast("int")).drop("f", "nf")  # PIVOTS rows
    there = there.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(number))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"i": left["i"][:0], "j": left["i"][:0], "d": np.zeros(0)})
        right = right.sort_values(["tc", "tr"])
        x, y, r, tc = _stack(left["v"]), _stack(right["tv"]), right["tr"].to_numpy(), right["tc"].to_numpy()
        i, names_there, own, radius = left["i"].to_numpy(), right["ti"].to_numpy(), left["c"].to_numpy(), left["r"].to_numpy()
        j, bound = left["j"].to_numpy().copy(), left["d"].to_numpy().copy()
        slack = SLACK * (np.sqrt((x * x).sum(1)).max() + np.sqrt((y * y).sum(1)).max())
        for cell in np.unique(tc):
            start, end = np.searchsorted(tc, cell, "left"), np.searchsorted(tc, cell, "right")
            reach, dp = reached(x, own, radius, bound, np.array([cell]))
            asked = np.flatnonzero(reach[:, 0])
            asked = asked[np.argsort(dp[asked, 0], kind="stable")]
            for k in range(0, len(asked), STEP):
                s = asked[k : k + STEP]
                a, b = np.searchsorted(r[start:end], [(dp[s, 0] - bound[s]).min() - slack, (dp[s, 0] + bound[s]).max() + slack])
                at = np.arange(start + a, start + b)
                if not len(at):
                    continue
                at = at[np.argsort(names_there[at], kind="stable")]
                # An item of the same cell may be among them.
                where = np.searchsorted(names_there[at], i[s]).clip(max=len(at) - 1)
                same = np.flatnonzero(names_there[at][where] == i[s])
                best, d = closest(x[s], y[at], (same, where[same]))
                if counter is not None:
                    counter.add(len(s) * len(at))
                better = np.isfinite(d) & ((d < bound[s]) | ((d == bound[s]) & (names_there[at][best] < j[s])))
                j[s[better]], bound[s[better]] = names_there[at][best[better]], d[better]
        fine = np.isfinite(bound)
        return pd.DataFrame({"i": i[fine], "j": j[fine], "d": bound[fine]})

    crossed = sent.groupBy("h", "y").cogroup(there.groupBy("th", "ty")).applyInPandas(compare, f"i {kind}, j {kind}, d double")
    every = ready.filter("w AND d < double('infinity')").select("i", "j", "d").unionByName(crossed)
    return every.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select("i", "m.j", "m.d")
