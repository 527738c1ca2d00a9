"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every benchmark item is covered by overlapping probes of 96 bytes (a shorter item is one probe). Within k edits of
a probe of n bytes there are at least n - q + 1 - k q of its q-grams, all in one band of diagonals: hits of
document q-grams are counted in overlapping diagonal bands (width 32, step 16, so any drift of up to 16 lies
within one band), regions that hold enough of them within a probe's length are retained, and each is verified by
aligning the probe inside the band with an edit budget of a tenth of its length. Where no probe is found, every other
stretch of 96 bytes of the item that may have hits there and holds enough of its q-grams is aligned too, all of them
in one banded pass, so a passage is found wherever in the item it begins; the stretch of least edits is reported.

q is 8, and 5 for short items (10 to 15, 20 to 23, 30 and 31 bytes) for which the bound at 8 would be 0 or less: at 5 it
is 1 or more, so nothing within the budget is lost at any length.

Letters A-Z count as lower case and all white space as spaces; both keep byte positions. The benchmark is the
stated query set: its distinct texts, long ones in overlapping pieces, are taken in blocks of bounded size, each
broadcast; documents are read once, every batch runs against one block after the other, and none is shuffled.

Edge cases: null texts are empty and match nothing; items of fewer than SHORTEST = 8 bytes match nothing (they would be
common words); equal items are all reported; repeated rows repeat; empty tables give an empty result; further columns
are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

Q, SHORT_Q, SHORTEST, PROBE, EDITS, STEP, NEAR = 8, 5, 8, 96, 0.1, 16, 32
#: Bytes of benchmark text in one block, of one piece of a long item, and of document text in one numpy pass; hits that
#: are spread to bands at once; indexes that a worker holds;
#: bytes of documents that every block goes over before the next round, where there are more blocks than that.
BLOCK, PIECE, CHUNK, HITS, HELD, SWEEP = 2 << 20, 32 << 10, 4 << 20, 2 << 20, 2, 64 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


def _grams(buf: bytes, q: int = Q) -> np.ndarray:
    """The q-grams of buf as numbers; q is 8 at most."""
    if len(buf) < q:
        return np.zeros(0, "<u8")
    v = np.ndarray((len(buf) - q + 1,), "<u8", buf + bytes(8 - q), strides=(1,))
    return v if q == 8 else v & np.uint64((1 << 8 * q) - 1)


def _slot(v: np.ndarray) -> np.ndarray:
    return ((v * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


def budget(n: int) -> int:
    return int(n * EDITS)


def align(probe: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of probe inside text, None if it takes more than most edits."""
    at = text.find(probe)
    if at >= 0:
        return 0, at, at + len(probe)
    t = np.frombuffer(text, np.uint8)

    def ends(p: np.ndarray, t: np.ndarray) -> tuple[int, int]:
        ramp = np.arange(len(t) + 1)
        row = np.zeros(len(t) + 1, np.int64)
        for k, c in enumerate(p, 1):
            new = np.empty_like(row)
            new[0] = k
            new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
            row = np.minimum.accumulate(new - ramp) + ramp
            if row.min() > most:
                return most + 1, 0
        return int(row.min()), int(row.argmin())

    p = np.frombuffer(probe, np.uint8)
    edits, end = ends(p, t)
    if edits > most:
        return None
    _, back = ends(p[::-1], t[:end][::-1])
    return edits, max(0, end - back), end


def align_all(x: bytes, offsets: np.ndarray, text: bytes, first: int, width: int, most: int) -> np.ndarray:
    """The least edits of each stretch x[o : o + PROBE] on the diagonals first to first + width - 1 of text, most + 1 if more.

    Diagonal d: byte o + k of the item lies beside byte o + k + d of the text, edits may drift by most to either side.
    """
    best = np.full(len(offsets), most + 1, np.int64)
    item = np.frombuffer(x, np.uint8)
    # No byte of the item is 255: places outside the text cost as much as bytes that are missing.
    low = int(offsets.min()) + first - most
    high = int(offsets.max()) + PROBE + first + width + most
    t = np.full(high - low, 255, np.uint8)
    a, b = max(0, low), min(len(text), high)
    if a < b:
        t[a - low : b - low] = np.frombuffer(text, np.uint8)[a:b]
    cells = np.arange(width + 2 * most)
    live, rows = np.arange(len(offsets)), np.zeros((len(offsets), len(cells)), np.int64)
    at = offsets + first - most - low
    for k in range(PROBE):
        new = rows + (t[at[live, None] + k + cells] != item[offsets[live] + k][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], rows[:, 1:] + 1)
        rows = np.minimum.accumulate(new - cells, axis=1) + cells
        going = rows.min(axis=1) <= most
        if not going.all():
            live, rows = live[going], rows[going]
            if not len(live):
                return best
    best[live] = rows.min(axis=1)
    return best


def gram_of(n: int) -> int:
    """The q for a probe of n bytes: at Q the lemma's bound must be 1 or more, at SHORT_Q it is for any n of SHORTEST or more."""
    return Q if n - Q + 1 - Q * budget(n) >= 1 else SHORT_Q


class Index:
    """The q-grams of one block of items, all of one q."""

    def __init__(self, items: list[bytes], q: int = Q):
        self.q = q
        self.items = [fold(x) for x in items]
        sizes = [max(0, len(x) - q + 1) for x in self.items]
        values = np.concatenate([_grams(x, q) for x in self.items] or [np.zeros(0, "<u8")])
        item, off = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)])
        order = np.argsort(values, kind="stable")
        self.item, self.off = item[order], off[order]
        self.grams, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.there = np.zeros(1 << _BITS, bool)
        self.there[_slot(self.grams)] = True
        n = np.array([min(len(x), PROBE) for x in self.items] or [0])
        self.need = np.maximum(1, n - q + 1 - q * (n * EDITS).astype(int))
        self.reach = n + (n * EDITS).astype(int)
        self.probe_grams: dict[tuple[int, int], list[bytes]] = {}
        #: A probe at least every half probe, the last one at the item's end.
        self.probes = [sorted({*range(0, max(1, len(x) - PROBE + 1), PROBE // 2), max(0, len(x) - PROBE)}) for x in self.items]

    def regions(self, buf: bytes) -> list[tuple[int, int, int]]:
        """(item, diagonal where a band begins, position) wherever a band has enough hits within a probe's reach."""
        v = _grams(buf, self.q)
        if not len(self.grams) or not len(v):
            return []
        hit = self.there[_slot(v)]
        # A region needs so many hits within so many bytes, whatever the item: other hits can be forgotten.
        reach, need = int(self.reach.max()) + 1, int(self.need.min())
        total = np.concatenate(([0], np.cumsum(hit)))
        ahead = total[np.minimum(np.arange(len(hit)) + reach, len(hit))] - total[:-1] >= need
        edge = np.zeros(len(hit) + 1, np.int32)
        edge[:-1] += ahead
        edge[reach:] -= ahead[: max(0, len(hit) + 1 - reach)]
        pos = np.flatnonzero(hit & (np.cumsum(edge)[:-1] > 0))
        at = np.minimum(np.searchsorted(self.grams, v[pos]), len(self.grams) - 1)
        same = self.grams[at] == v[pos]
        pos, at = pos[same], at[same]
        # In pieces of bounded work that overlap by a probe's reach, however many items have a q-gram.
        work = np.cumsum(self.count[at])
        out: set[tuple[int, int, int]] = set()
        k = 0
        while k < len(pos):
            end = int(np.searchsorted(work, (work[k - 1] if k else 0) + HITS, "right"))
            end = max(end, int(np.searchsorted(pos, pos[k] + 2 * reach, "right")))
            out.update(self._banded(pos[k:end], at[k:end], len(buf)))
            if end >= len(pos):
                break
            k = max(k + 1, int(np.searchsorted(pos, pos[end] - reach)))
        return sorted(out)

    def _banded(self, pos: np.ndarray, at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        n = self.count[at]
        k = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
        pos, item, off = np.repeat(pos, n), self.item[k], self.off[k]
        longest = max(map(len, self.items))
        band = (pos - off + longest) // STEP + 1
        bands = (size + longest) // STEP + 3
        key = item * bands + band
        both = np.sort(np.concatenate([key, key - 1]).astype(np.int64) << 24 | np.concatenate([pos, pos]))
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        key, pos = both >> 24, both & ((1 << 24) - 1)
        last = np.arange(len(key)) + self.need[key // bands] - 1
        ok = last < len(key)
        ok[ok] = (key[last[ok]] == key[ok]) & (pos[last[ok]] - pos[ok] <= self.reach[key[ok] // bands])
        # One place for every NEAR bytes of a band.
        key, pos = key[ok], pos[ok] // NEAR
        both = np.unique(key << 24 | pos)
        return [(int(a // bands), int((a % bands - 1) * STEP - longest), int(p) * NEAR) for a, p in zip(both >> 24, both & ((1 << 24) - 1), strict=True)]

    def enough(self, item: int, o: int, text: bytes) -> bool:
        """The lemma for one probe: so many of its q-grams are in the text."""
        if (item, o) not in self.probe_grams:
            probe = self.items[item][o : o + PROBE]
            self.probe_grams[item, o] = [probe[k : k + self.q] for k in range(len(probe) - self.q + 1)]
        there = {text[k : k + self.q] for k in range(len(text) - self.q + 1)}
        return sum(g in there for g in self.probe_grams[item, o]) >= self.need[item]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of all verified regions, in bytes; those of one item that touch are joined."""
        out: list[tuple[int, int, int, int, int]] = []
        k = 0
        while k < len(texts):
            first, size = k, 0
            while k < len(texts) and (k == first or size + len(texts[k]) + Q < CHUNK):
                size += len(texts[k]) + Q
                k += 1
            if size < 1 << 24:
                out += self._find(texts[first:k], first)
            else:  # one text over 16 MB: overlapping pieces
                over = 2 * PROBE + max(map(len, self.items), default=0)
                whole = texts[first]
                pieces = {(f, i, a + s, b + s, e) for s in range(0, len(whole), CHUNK) for f, i, a, b, e in self._find([whole[s : s + CHUNK + over]], first)}
                out += sorted(pieces)
        return out

    def _verify(self, x: bytes, item: int, of: int, diagonal: int, p: int, buf: bytes, lo: int, hi: int, tried: set, found: dict) -> None:
        """Aligns the probes that may have hits at p, each once in a text and band."""
        for o in self.probes[item]:
            probe = x[o : o + PROBE]
            most = budget(len(probe))
            a, b = max(lo, diagonal + o - most), min(hi, diagonal + o + 2 * STEP + len(probe) + most)
            if p + NEAR <= a or p > b or b - a < len(probe) - most or (of, item, diagonal, o) in tried:
                continue
            tried.add((of, item, diagonal, o))
            text = buf[a:b]
            hit = align(probe, text, most) if self.enough(item, o, text) else None
            if hit:
                found.setdefault((of, item), []).append((a + hit[1] - lo, a + hit[2] - lo, hit[0]))
        if len(x) > PROBE and not any(s + lo < p + NEAR and p < t + lo for s, t, _ in found.get((of, item), ())):
            self._stretches(x, item, of, diagonal, p, buf, lo, hi, tried, found)

    def _stretches(self, x: bytes, item: int, of: int, diagonal: int, p: int, buf: bytes, lo: int, hi: int, tried: set, found: dict) -> None:
        """The same for the stretches that begin between probes."""
        most = budget(PROBE)
        from_, to = max(0, p - diagonal - 2 * STEP - PROBE - most), min(len(x) - PROBE, p + NEAR - diagonal + most)
        if from_ > to:
            return
        a, b = max(lo, diagonal + from_ - most), min(hi, diagonal + to + 2 * STEP + PROBE + most)
        text = buf[a:b]
        there = {text[k : k + Q] for k in range(len(text) - Q + 1)}
        total = np.cumsum([0, *[x[k : k + Q] in there for k in range(from_, to + PROBE - Q + 1)]])
        offsets = from_ + np.flatnonzero(total[PROBE - Q + 1 :] - total[: -(PROBE - Q + 1)] >= self.need[item])
        offsets = np.array([o for o in offsets.tolist() if (of, item, diagonal, o) not in tried], np.int64)
        if not len(offsets):
            return
        tried.update((of, item, diagonal, o) for o in offsets.tolist())
        edits = align_all(x, offsets, buf[lo:hi], diagonal - lo, 2 * STEP, most)
        k = int(edits.argmin())
        if edits[k] <= most:
            o = int(offsets[k])
            a = max(lo, diagonal + o - most)
            _, start, end = align(x[o : o + PROBE], buf[a : min(hi, diagonal + o + 2 * STEP + PROBE + most)], most)
            found.setdefault((of, item), []).append((a + start - lo, a + end - lo, int(edits[k])))

    def _find(self, texts: list[bytes], first: int) -> list[tuple[int, int, int, int, int]]:
        gap = b"\xff" * Q
        starts = np.cumsum([0, *[len(t) + Q for t in texts]]).tolist()[:-1]
        buf = fold(gap.join(texts) + gap)
        tried: set[tuple[int, int, int, int]] = set()
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for item, diagonal, p in self.regions(buf):
            x = self.items[item]
            for of in {bisect_right(starts, p) - 1, bisect_right(starts, p + NEAR - 1) - 1}:
                self._verify(x, item, of, diagonal, p, buf, starts[of], starts[of] + len(texts[of]), tried, found)
        out = []
        for (of, item), spans in sorted(found.items()):
            spans.sort()
            a, b, e = spans[0]
            for s, t, edits in spans[1:]:
                if s <= b:
                    b, e = max(b, t), max(e, edits)
                else:
                    out.append((first + of, item, a, b, e))
                    a, b, e = s, t, edits
            out.append((first + of, item, a, b, e))
        return out


class Indexes:
    """The indexes of one block: its items by the q that their length takes. Finds like Index, items by their place in the block."""

    def __init__(self, items: list[bytes]):
        of = [gram_of(min(len(x), PROBE)) for x in items]
        self.parts = []
        for q in sorted(set(of)):
            at = [k for k, x in enumerate(of) if x == q and len(items[k]) >= SHORTEST]
            if at:
                self.parts.append((at, Index([items[k] for k in at], q)))

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        return [(t, at[i], a, b, e) for at, index in self.parts for t, i, a, b, e in index.find(texts)]


_indexes: OrderedDict[int, Indexes] = OrderedDict()
#: Numbers of the blocks that this driver has sent.
_numbers = itertools.count()


def _index(block) -> Indexes:
    if block.id in _indexes:
        _indexes.move_to_end(block.id)
    else:
        _indexes[block.id] = Indexes([x for _, x in block.value])
        while len(_indexes) > HELD:
            _indexes.popitem(last=False)
    return _indexes[block.id]


def _rounds(batches, column: str | int, blocks: list):
    """Lists of batches, and the blocks in the order to take them in. What a worker can't hold is built once for some
    SWEEP bytes of documents, and the order turns round each time, so that the last indexes serve again."""
    held, size, turned = [], 0, False
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if len(blocks) <= HELD or size >= SWEEP:
            yield held, blocks[::-1] if turned else blocks
            held, size, turned = [], 0, not turned
    if held:
        yield held, blocks[::-1] if turned else blocks


class _Block:
    """A broadcast list of (hash of the item's text, piece of it), known by a number."""

    def __init__(self, shared, number: int):
        self.shared, self.id = shared, number

    @property
    def value(self):
        return self.shared.value


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t")).filter(F.octet_length("t") >= SHORTEST)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[_Block]:
    """The benchmark's distinct texts, in pieces, in blocks of about BLOCK bytes; one at a time is fetched and broadcast."""
    sc = benchmark.sparkSession.sparkContext
    texts = _items(benchmark, item_col, text_col).groupBy("h").agg(F.first("t").alias("t"))
    # Pieces overlap by more than a probe, so every stretch of 96 bytes lies within one.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("t") - 2 * PROBE), F.lit(PIECE))
    pieces = texts.select("h", "t", F.explode(starts).alias("at")).select("h", "at", F.substring("t", F.col("at"), F.lit(PIECE + 2 * PROBE)).alias("x"))
    pieces = written(pieces, "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
    n = -(-total // BLOCK)
    out = []
    for k in range(n):
        rows = pieces.filter(F.pmod(F.xxhash64("h", "at"), F.lit(n)) == k).orderBy("h", "at").collect()  # about BLOCK bytes
        out.append(_Block(sc.broadcast([(r.h, bytes(r.x)) for r in rows]), next(_numbers)))
    return out


def _merged(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits), those of one text and item that touch joined."""
    out: list[list[int]] = []
    for t, i, a, b, e in sorted(found):
        if out and out[-1][:2] == [t, i] and a <= out[-1][3]:
            out[-1][3:] = max(out[-1][3], b), max(out[-1][4], e)
        else:
            out.append([t, i, a, b, e])
    return [tuple(x) for x in out]


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, item, start, end, edits): every region of a document that holds a passage of an item, in code points."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    queries = blocks(benchmark, item_col, item_text_col)

    def run(batches):
        for held, order in _rounds(batches, "t", queries):
            texts = [[t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()] for batch in held]
            every: list[list] = [[] for _ in held]
            for block in order:
                items, index = block.value, _index(block)
                for own, into in zip(texts, every, strict=True):
                    into += [(t, items[i][0], a, b, e) for t, i, a, b, e in index.find(own)]
            for batch, own, found in zip(held, texts, map(_merged, every), strict=True):
                place = lambda f, k: len(own[f[0]][: f[k]].decode("utf-8", "ignore"))  # noqa: B023, E731
                cols = [pa.array([f[1] for f in found], pa.int64()), pa.array([place(f, 2) for f in found], pa.int64()), pa.array([place(f, 3) for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array([f[0] for f in found], pa.int64())), *cols], names=["d", "h", "start", "end", "edits"])

    found = d.mapInArrow(run, f"d {dict(d.dtypes)['d']}, h long, start long, end long, edits int")
    out = found.join(_items(benchmark, item_col, item_text_col).select("h", "i"), "h")
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_col), "start", "end", "edits")


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any contaminated region, with their columns; a filter, nothing is shuffled."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    queries = blocks(benchmark, item_col, item_text_col)

    def run(batches):
        for held, order in _rounds(batches, at, queries):
            texts = [[t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()] for batch in held]
            left = [list(range(len(own))) for own in texts]
            for block in order:
                index = _index(block)
                for n, own in enumerate(texts):
                    found = {f[0] for f in index.find([own[k] for k in left[n]])}
                    left[n] = [k for m, k in enumerate(left[n]) if m not in found]
            for batch, rows in zip(held, left, strict=True):
                yield batch.take(pa.array(rows, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
