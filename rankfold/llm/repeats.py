"""Removal of long repeats by a run-length index over the places where texts can repeat.

A byte goes if a window of WIDTH bytes that covers it also starts anywhere else. The work is dealt out by content:

1. Every window picks the least hashed gram of GRAM bytes in it (leftmost of equals) as its anchor. The choice
   depends on the window's bytes alone, so equal windows have equal anchors. Neighbouring windows with one anchor
   form a context; each window start of a text lies in exactly one context.
2. Only hashes travel: contexts by (anchor hash, context hash). Anchors seen once are done. A context that is
   itself seen twice or more is repeated whole; it is kept once, with its multiplicity.
3. Where one anchor has different contexts, one text of each context hands in its bytes, dealt out by anchor. Per
   share, a run-length index is built: suffixes of the contexts sorted within their anchor, the Burrows-Wheeler
   transform cut into runs, and the common length with the neighbour sampled at run starts and run ends only.
   Streaming over a context, the statistic of a place is its sample, or inside a run one less than that of the
   place before. Windows whose statistic reaches WIDTH are repeated.
4. Marks go back to all texts that have the context, which cut out what the marked windows cover.

An anchor with more than HOT windows in different contexts (a passage that very many texts share, each in other
surroundings) is indexed in parts: inside its contexts every window picks a second anchor by another hash, which again
depends on the window's bytes alone, so equal windows stay together; the parts are what contexts were one level above.
What is still as hot after LEVELS such divisions (windows that share nearly all of their bytes) is resolved by counting
window hashes, which is exact too and splits at will. Hashes of anchor and context together have 128 bits.

Edge cases: null texts are empty; texts shorter than WIDTH have nothing to remove; equal rows are repeats of each
other; null ids are treated like any id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, written

WIDTH, GRAM = 200, 32
#: Window starts of one anchor beyond which it is divided (an index takes some 400 bytes a start), and how often at
#: most; window starts in one index of several anchors; bytes in one numpy pass.
HOT, LEVELS, STARTS, CHUNK = 300_000, 3, 40_000, 1 << 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(0xFFFFFFFF)
#: 0 pads contexts in the index; texts are UTF-8, in which 255 doesn't occur.
_NO_ZERO = bytes([255, *range(1, 256)])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    if n < w:
        return x[:0]
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def _contexts(texts: list[bytes], first: int, base: int, width: int, gram: int, out: list, level: int = 0) -> None:
    buf = b"".join(texts) + bytes(8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)) * _M1
    k = 8
    while k < gram:
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * _M2 + h[k:]
        k *= 2
    h ^= h >> np.uint64(32)
    h *= _M3 + np.uint64(2 * level)  # another order of the grams at every level
    h ^= h >> np.uint64(29)
    least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & _LOW
    n = np.maximum(sizes - width + 1, 0)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    if not len(at):
        return
    anchor = least[at].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    of = np.searchsorted(starts, at[new], "right") - 1
    # Empty texts share their start with the next one; the last text that starts there has the windows.
    windows = np.diff(np.concatenate((new, [len(at)])))
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    lo, hashes = at[new], h[anchor[new]].view(np.int64)
    for t, s, m, a in zip(of.tolist(), lo.tolist(), windows.tolist(), hashes.tolist(), strict=True):
        out.append((first + t, base + s - int(starts[t]), m, a, digest(view[s : s + m + width - 1], 7) - (1 << 63)))


def contexts(texts: list[bytes], width: int = WIDTH, gram: int = GRAM, level: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(text, first window start, windows, anchor hash, context hash) of all contexts; depends on each text alone."""
    out: list = []
    k = 0
    while k < len(texts):
        if len(texts[k]) > CHUNK:
            for base in range(0, len(texts[k]) - width + 1, CHUNK):
                _contexts([texts[k][base : base + CHUNK + width - 1]], k, base, width, gram, out, level)
            k += 1
            continue
        first, size = k, 0
        while k < len(texts) and size + len(texts[k]) <= CHUNK:
            size += len(texts[k])
            k += 1
        _contexts(texts[first:k], first, 0, width, gram, out, level)
    return out


class RunLengthIndex:
    """Over distinct contexts, each with its group: run-length Burrows-Wheeler transform with samples at run ends."""

    def __init__(self, groups: list[int], texts: list[bytes], width: int = WIDTH):
        self.width = width
        longest = max(map(len, texts))
        self.windows = np.array([len(t) - width + 1 for t in texts])
        buf = np.frombuffer(b"".join(t.translate(_NO_ZERO) + bytes(longest) for t in texts), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(t) + longest for t in texts])[:-1]))
        self.first = np.concatenate(([0], np.cumsum(self.windows)[:-1]))
        own = np.repeat(np.arange(len(texts)), self.windows)
        off = np.arange(self.windows.sum()) - self.first[own]
        rows = as_strided(buf, (len(buf) - longest + 1, longest), (1, 1))[begin[own] + off]
        left = (self.windows + width - 1)[own] - off
        _, group = np.unique(np.array(groups, np.int64), return_inverse=True)
        group = group[own]
        order = np.argsort(rows.view(f"S{longest}").ravel(), kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        before = np.where(off > 0, rows[np.maximum(np.arange(len(off)) - 1, 0), 0].astype(np.int16), np.int16(-1))
        bwt, g = before[order], group[order]
        cut = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0) | (g[1:] != g[:-1])))
        heads = np.flatnonzero(cut)
        tails = np.concatenate((heads[1:], [len(order)])) - 1
        self.size, self.runs, self.lengths = len(order), bwt[heads], np.diff(np.concatenate((heads, [len(order)])))
        self.up, self.down = self._sample(order, g, rows, left, heads, -1), self._sample(order, g, rows, left, tails, 1)

    @staticmethod
    def _sample(order, g, rows, left, ranks: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text of run ends, and the common lengths there with the neighbour of another run."""
        places, lengths = order[ranks], np.zeros(len(ranks), np.int64)
        near = np.flatnonzero((ranks + step >= 0) & (ranks + step < len(order)))
        near = near[g[ranks[near]] == g[ranks[near] + step]]
        for k in range(0, len(near), 8192):
            part = near[k : k + 8192]
            a, b = places[part], order[ranks[part] + step]
            differ = rows[a] != rows[b]
            at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
            lengths[part] = np.minimum(at, np.minimum(left[a], left[b]))
        by_place = np.argsort(places)
        return places[by_place], lengths[by_place]

    def _stream(self, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The statistic at every place: its sample, or one less than at the place before. Every text's begin is a sample."""
        places, lengths = samples
        at = np.arange(self.size)
        last = np.searchsorted(places, at, "right") - 1
        return lengths[last] - (at - places[last])

    def repeated(self) -> list[np.ndarray]:
        """For every context, which of its windows occur in another place of its group."""
        m = np.maximum(self._stream(self.up), self._stream(self.down)) >= self.width
        return [m[a : a + n] for a, n in zip(self.first, self.windows, strict=True)]


def _parts(batches, column: str, most: int = 2 << 20):
    """The batches cut so that a column holds about `most` bytes in each, whatever the rows' lengths."""
    for batch in batches:
        sizes = np.cumsum([len(x) for x in batch.column(column).cast(pa.large_binary()).fill_null(b"").to_pylist()]) // most
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def _anchored(docs: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    """One row per text and distinct context: (id, th, a, c, n)."""

    def run(batches):
        for batch in _parts(batches, "t"):
            texts = [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]
            seen: dict[tuple, int] = {}
            for t, _, _, a, c in contexts(texts, width, gram):
                seen[t, a, c] = seen.get((t, a, c), 0) + 1
            at = pa.array([k[0] for k in seen], pa.int64())
            cols = [batch.column("id").take(at), batch.column("th").take(at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int32())], names=["id", "th", "a", "c", "n"])

    return docs.mapInArrow(run, f"id {kind}, th long, a long, c long, n int")


def _packed(docs: DataFrame, kind: str) -> DataFrame:
    """(id, th, z): texts compressed for the shuffle."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [z.compress(t or b"") for t in batch.column("t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(data, pa.binary())], names=["id", "th", "z"])

    return docs.mapInArrow(run, f"id {kind}, th long, z binary")


def _unpacked(column) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in column.to_pylist()]


def _indexed(rows: DataFrame, width: int) -> DataFrame:
    """rows: (a, c, text) of distinct contexts. (a, c, mask) of those with repeated windows."""

    def marks(part):
        index = RunLengthIndex([x[0] for x in part], [x[2] for x in part], width)
        for (a, c, _), m in zip(part, index.repeated(), strict=True):
            if m.any():
                yield a, c, np.packbits(m).tobytes()

    def run(batches):
        part, group, size = [], [], 0
        names = ["a", "c", "mask"]

        def out(rows):
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("a", "c", "text")), strict=True):
                if group and row[0] != group[-1][0]:
                    # A group is never cut; groups are indexed together while they are small.
                    more = sum(len(x[2]) - width + 1 for x in group)
                    if part and size + more > STARTS:
                        yield out(marks(part))
                        part, size = [], 0
                    part, size, group = part + group, size + more, []
                group.append(row)
        if part or group:
            more = sum(len(x[2]) - width + 1 for x in group)
            if part and size + more > STARTS:
                yield out(marks(part))
                part = []
            yield out(marks(part + group))

    dealt = rows.repartition("a").sortWithinPartitions("a", "c")
    return dealt.mapInArrow(run, "a long, c long, mask binary")


def _counted(rows: DataFrame, width: int) -> DataFrame:
    """Like _indexed(), for hot anchors: windows are counted by a 128-bit hash."""

    def spread(batches):
        for batch in batches:
            a, c, k, p, q = [], [], [], [], []
            for i, j, text in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "text")), strict=True):
                view = memoryview(text)
                for s in range(len(text) - width + 1):
                    d = xxhash.xxh3_128_digest(view[s : s + width])
                    a.append(i)
                    c.append(j)
                    k.append(s)
                    p.append(int.from_bytes(d[:8], "little", signed=True))
                    q.append(int.from_bytes(d[8:], "little", signed=True))
                if len(a) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c, k, p, q)], names=["a", "c", "k", "p", "q"])
                    a, c, k, p, q = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c, k, p, q)], names=["a", "c", "k", "p", "q"])

    windows = rows.repartition("a", "c").mapInArrow(spread, "a long, c long, k long, p long, q long")
    often = windows.groupBy("p", "q").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("p", "q")
    found = windows.join(often, ["p", "q"]).groupBy("a", "c").agg(F.collect_list("k").alias("ks"))  # at most a context's windows

    def pack(batches):
        for batch in batches:
            masks = []
            for ks in batch.column("ks").to_pylist():
                m = np.zeros(max(ks) + 1, np.uint8)
                m[ks] = 1
                masks.append(np.packbits(m).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("c"), pa.array(masks, pa.binary())], names=["a", "c", "mask"])

    return found.mapInArrow(pack, "a long, c long, mask binary")


def _masked(rows: DataFrame, width: int, gram: int, hot: int, level: int = 1) -> DataFrame:
    """rows: (a, c, text) of distinct contexts. (a, c, mask) of those with repeated windows, hot anchors in parts."""
    crowd = written(rows.groupBy("a").agg(F.sum(F.octet_length("text") - (width - 1)).alias("m")).filter(F.col("m") > hot).select("a"), "repeats-crowd")
    few = _indexed(rows.join(crowd, "a", "left_anti"), width)
    if crowd.isEmpty():
        return few
    many = rows.join(crowd, "a", "left_semi")
    if level > LEVELS:
        return few.unionByName(_counted(many, width))

    def divide(batches):
        for batch in _parts(batches, "text", 1 << 20):
            a, c, texts = (batch.column(x).to_pylist() for x in ("a", "c", "text"))
            out = [(a[t], c[t], s, m, xxhash.xxh3_64_intdigest(a[t].to_bytes(8, "little", signed=True) + p.to_bytes(8, "little", signed=True)) - (1 << 63), q, texts[t][s : s + m + width - 1]) for t, s, m, p, q in contexts(texts, width, gram, level)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:6]), pa.array(cols[6], pa.binary())], names=["a", "c", "s", "m", "p", "q", "text"])

    parts = written(many.repartition("a", "c").mapInArrow(divide, "a long, c long, s long, m long, p long, q long, text binary"), "repeats-parts")
    distinct = written(parts.groupBy("p", "q").agg(F.count("*").alias("n"), F.first("text").alias("text")), "repeats-distinct")
    whole = distinct.filter("n > 1").select("p", "q", F.lit(None).cast("binary").alias("mask"))
    below = _masked(distinct.select(F.col("p").alias("a"), F.col("q").alias("c"), "text"), width, gram, hot, level + 1).select(F.col("a").alias("p"), F.col("c").alias("q"), "mask")
    marks = whole.unionByName(below.join(whole.select("p", "q"), ["p", "q"], "left_anti"))
    found = parts.select("a", "c", "s", "m", "p", "q").join(marks, ["p", "q"]).groupBy("a", "c").agg(F.collect_list(F.struct("s", "m", "mask")).alias("parts"))  # as many as a context has windows at most

    def unite(batches):
        for batch in batches:
            masks = []
            for found_ in batch.column("parts").to_pylist():
                m = np.zeros(max(x["s"] + x["m"] for x in found_), np.uint8)
                for x in found_:
                    bits = np.ones(x["m"], np.uint8) if x["mask"] is None else np.unpackbits(np.frombuffer(x["mask"], np.uint8))[: x["m"]]
                    m[x["s"] : x["s"] + len(bits)] = bits
                masks.append(np.packbits(m).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("c"), pa.array(masks, pa.binary())], names=["a", "c", "mask"])

    return few.unionByName(found.mapInArrow(unite, "a long, c long, mask binary"))


def cut(data: bytes, marks: dict[tuple[int, int], bytes | None], found: list, width: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left); marks: mask by context, None for all windows."""
    edge = np.zeros(len(data) + 1, np.int32)
    for _, s, m, a, c in found:
        if (a, c) in marks:
            mask = marks[a, c]
            at = s + (np.arange(m) if mask is None else np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[:m]))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): kept is what is left of the text's bytes."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    kind = dict(d.dtypes)["id"]
    anchored = written(_anchored(d, kind, width, gram), "repeats-anchors")
    # Anchors seen twice or more; c1 = c2: always in the same context.
    often = anchored.groupBy("a").agg(F.sum("n").alias("seen"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter(F.col("seen") > 1)
    often = written(often.select("a", (F.col("c1") != F.col("c2")).alias("mixed")), "repeats-often")
    again = written(anchored.join(often, "a"), "repeats-again")
    # Distinct contexts, each with its multiplicity and one text that has it.
    distinct = again.groupBy("a", "c", "mixed").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id"), F.col("th"))).alias("by"))
    distinct = written(distinct, "repeats-contexts")
    whole = distinct.filter(F.col("n") > 1).select("a", "c", F.lit(None).cast("binary").alias("mask"))
    mixed = distinct.filter("mixed")
    wanted = mixed.groupBy(F.col("by.id").alias("wid"), F.col("by.th").alias("wth")).agg(F.collect_set("c").alias("cs"))  # at most a text's contexts

    def hand_in(batches):
        for batch in _parts(batches, "z", 1 << 20):
            texts = _unpacked(batch.column("z"))
            cs = [set(x) for x in batch.column("cs").to_pylist()]
            rows, done = [], set()
            for t, s, m, a, c in contexts(texts, width, gram):
                if c in cs[t] and (t, a, c) not in done:
                    done.add((t, a, c))
                    rows.append((a, c, texts[t][s : s + m + width - 1]))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["a", "c", "text"])

    packed = _packed(d, kind)
    same = packed["id"].eqNullSafe(F.col("wid")) & (packed["th"] == F.col("wth"))
    handed = packed.join(wanted, same).dropDuplicates(["id", "th"]).select("z", "cs").mapInArrow(hand_in, "a long, c long, text binary")
    handed = written(handed.join(mixed.select("a", "c"), ["a", "c"], "left_semi"), "repeats-bytes")
    masks = _masked(handed, width, gram, hot)
    marks = written(whole.unionByName(masks.join(whole.select("a", "c"), ["a", "c"], "left_anti")), "repeats-marks")
    discard(anchored, often, distinct, handed)
    by_doc = again.select("id", "th", "a", "c").distinct().join(marks, ["a", "c"]).groupBy(F.col("id").alias("mid"), F.col("th").alias("mth")).agg(F.collect_list(F.struct("a", "c", "mask")).alias("marks"))

    def clean(batches):
        for batch in _parts(batches, "z", 1 << 20):
            texts = _unpacked(batch.column("z"))
            marks = [{(x["a"], x["c"]): x["mask"] for x in (m or ())} for m in batch.column("marks").to_pylist()]
            busy = [k for k, m in enumerate(marks) if m]
            found: dict[int, list] = {k: [] for k in busy}
            for x in contexts([texts[k] for k in busy], width, gram):
                found[busy[x[0]]].append(x)
            got = [cut(t, marks[k], found[k], width) if marks[k] else (0, 0, t) for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    packed = _packed(d, kind)
    same = packed["id"].eqNullSafe(F.col("mid")) & (packed["th"] == F.col("mth"))
    out = packed.join(by_doc, same, "left").select("id", "z", "marks").mapInArrow(clean, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(cleaned: DataFrame) -> DataFrame:
    """without_repeats() with the kept bytes as SHA-256."""
    return cleaned.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def brute_force(texts: list[bytes | None], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """The same by looking at every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t or b"") - width + 1):
            w = t[s : s + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        t = t or b""
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out
