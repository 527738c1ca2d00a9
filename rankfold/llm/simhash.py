"""SimHash near-duplicates with meet-in-the-middle ball hashing.

A 64-bit fingerprint per text from the XXH64 of its word shingles. Two fingerprints within radius 2 have a
common variant within radius 1 of either, so every *distinct* fingerprint emits its 65 variants and the shuffle
on the variant brings all linked pairs together. At most 65 distinct fingerprints can meet at a variant, and all
of them are within the radius of each other, so consecutive ones are linked: that loses no connection and no
group grows with the data, however many copies a text has (grouped()).

Copies of similarity 0.8 differ in some ten of 64 bits, far beyond any ball that can be enumerated, so near_rooted()
joins the sets of five-word shingles themselves, exactly. With all members in one order, the first one that two similar
sets have in common has few before it in either: what a set has alone is bounded by both sizes (shared()). So every set
names its first members, each with its place, and similar sets meet at a member whose two places the bound allows. Any
order will do; rare members come first, so neither a common passage nor what a large family of copies shares brings sets
together that have enough of their own, be they a template's strangers or copies that are changed too much. Which members
are frequent is counted by task (frequent()); where a set has to name frequent ones too, it names them for each class of
sizes that its partners can be in, as far as that class's bound goes (placed()).
At a member all are first compared with the one that has the fewest before it: in a family that is the least changed copy.
What is then still in different components is compared with its neighbour in size, and the rest pair by pair. Pairs are
tested by places, by sizes and by parities (a bit for each residue of the members' hashes: two sets differ in as many members
as bits at least), and then on the whole sets. Groups are the components of the verified links.

Edge cases: a null text is an empty one; texts without words have fingerprint 0 and are linked like any others; a text
of fewer words than a shingle has one shingle of all of them; rows with a null id take part and take the least id of
their group (null if it has none); equal rows fall into one group, rows that only have their id in common don't; an empty table
gives an empty result; further columns are ignored or carried along, whatever their names and types.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, ship, written
from .components import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: For near copies by similarity: words of a shingle, the least similarity, bits of a member's name.
NEAR_SHINGLE, SIMILARITY, NEAR_BITS = 5, 0.8, 64
#: Members that a task counts at once, the least number of sets there that makes one count as frequent, and how many are told apart at most.
COUNTED, OFTEN, FREQUENT = 1 << 22, 4, 1 << 19
#: Growth of the classes of sizes for which frequent members are named.
WIDTH = 1.03
#: Bits of a set's parities.
PARITIES = 1024
#: Sets that a task remembers, so that exact copies are dealt out once.
RECENT = 100_000
#: Hashes that are unpacked to bits at once.
BLOCK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A-Z lower-cased, words joined by one space, shingles with repeats; a bit is 1 if set in over half the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([one(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp) of every row; fp: the fingerprint's bits as a long, th: a hash of the text."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            texts = batch.column("t").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(fps)], names=["id", "th", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"id {kind}, th long, fp long")


def variants(fp: Column, bits: int = BITS) -> Column:
    """The fingerprint and its neighbours at one bit: all within half the radius."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return F.concat(F.array(fp), flips)


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp. (a, b), a < b: pairs within the radius that connect all such pairs."""
    near = fps.select("fp", F.explode(variants(F.col("fp"))).alias("v"))
    chain = near.select("fp", F.lag("fp").over(W.partitionBy("v").orderBy("fp")).alias("a")).filter(F.col("a").isNotNull())
    pairs = chain.select("a", F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, root, component): root is one number for each group, component the least id that links reach."""
    slim = written(fingerprints(docs.select(id_col, text_col), id_col, text_col), "simhash-docs")
    of_fp = written(slim.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-fps")
    roots = components(links(of_fp.select("fp")))
    rooted = of_fp.join(roots, of_fp["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("hung"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.max("hung").alias("linked"))
    # Only fingerprints of several rows or with links need a lookup; all others are their own component.
    table = rooted.join(least, "root").filter((F.col("n") > 1) | F.col("linked")).select("fp", "root", "component")
    table = written(table, "simhash-components").withColumn("known", F.lit(True))
    discard(of_fp)
    out = slim.join(table, "fp", "left")
    return out.select("id", "th", "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("known"), F.col("component")).otherwise(F.col("id")).alias("component"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprint as 16 hex digits, and its component."""
    return grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(text: bytes | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x, SEED) for x in words], np.uint64)
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mixed(h ^ w[j : len(w) - k + 1 + j])
    return np.unique(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shared(a, b, similarity: float):
    """Members that similar sets of these sizes have in common at least; numbers or arrays."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6).astype(np.int64)


def classes(most: int, similarity: float) -> np.ndarray:
    """The least size of every class of sizes up to `most`, and of the next one."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * min(WIDTH, 1 / similarity))))
    return np.array(out)


def placed(s: np.ndarray, similarity: float, lows: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the first members of a set of distinct hashes, their places, and whether the name is for the set's own class.

    levels: of how many sets each member is, on any scale; 0: rare. A rare member has one name, a frequent one has one for
    each class of sizes; two similar sets meet at a name that is for the class of the smaller one.
    """
    n = len(s)
    levels = np.zeros(n, np.int64) if levels is None else levels
    order = np.lexsort((s, levels))[: n - math.ceil(similarity * n - 1e-6) + 1]
    first, rare = s[order], int((levels[order] == 0).sum())
    names, places, own = [_mixed(first[:rare])], [np.arange(rare)], [np.ones(rare, bool)]
    if rare < len(first):
        mine = int(np.searchsorted(lows, n, "right")) - 1
        for c in range(int(np.searchsorted(lows, max(1, math.ceil(n * similarity - 1e-6)), "right")) - 1, mine + 1):
            more = first[rare : n - int(shared(n, int(lows[c]), similarity)) + 1]
            names.append(_mixed(_mixed(more) + np.uint64(c + 1)))
            places.append(np.arange(rare, rare + len(more)))
            own.append(np.full(len(more), c == mine))
    return np.concatenate(names), np.concatenate(places), np.concatenate(own)


def signatures(s: np.ndarray, similarity: float, lows: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """The names alone: similar sets have one in common."""
    return placed(s, similarity, lows, levels)[0]


def parities(s: np.ndarray) -> np.ndarray:
    """For every residue whether an odd number of members has it."""
    odd = np.bincount((s % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets is so great; empty ones are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _distinct_sets(batch: pa.RecordBatch, shingle: int, seen: set) -> tuple[list[np.ndarray], list[int], list[bool]]:
    """The sets of the texts `t`, their ids, and whether the task sees one first, as far as RECENT sets reach back."""
    sets = [shingles(t.as_py(), shingle) for t in batch.column("t").cast(pa.binary())]
    ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
    new = []
    for s in ids:
        new.append(s not in seen)
        seen.add(s)
    if len(seen) > RECENT:
        seen.clear()
    return sets, ids, new


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of many sets, sorted, and the logarithm of how many; docs: (t). Every task counts its own sets in blocks, and
    what is frequent in none of them counts as rare: that decides about the order of members and so about time, never about a result."""

    def run(batches):
        seen, held, size = set(), [], 0

        def counted():
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                sets, _, new = _distinct_sets(batch.slice(k, 512), shingle, seen)
                held += [s for s, fresh in zip(sets, new, strict=True) if fresh]
                size += sum(len(s) for s, fresh in zip(sets, new, strict=True) if fresh)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        yield counted()

    sums = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    sums = written(sums, "simhash-frequent")
    least, total = 0, 0
    for level, n in sorted(sums.groupBy("level").count().collect(), reverse=True):  # a row for each power of two
        total += n
        if total > FREQUENT:
            break
        least = level
    kept = sums.filter(F.col("level") >= least).toArrow() if total else None
    discard(sums)
    if kept is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    h = kept.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], kept.column("level").to_numpy()[order].astype(np.uint8)


def _sketched(docs: DataFrame, kind: str, shingle: int, similarity: float, bits: int) -> DataFrame:
    """docs: (id, th, t). With the set's id s, its size n, its parities, its members as 32-bit hashes, and what it names:
    twice the place, and one more if the name is for its own class; copies within a task name nothing again."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs.select("t"), shingle))

    def run(batches):
        often, often_levels = known.value
        lows, seen = classes(1, similarity), set()

        def level(s):
            if not len(often):
                return None
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            return np.where(often[at] == s, often_levels[at], 0)

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets, ids, new = _distinct_sets(part, shingle, seen)
                if max(map(len, sets), default=0) >= lows[-1]:
                    lows = classes(max(map(len, sets)), similarity)
                named = [placed(s, similarity, lows, level(s)) if fresh and len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)) for s, fresh in zip(sets, new, strict=True)]
                cols = [
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())), pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                    pa.array([(x >> np.uint64(64 - bits)).view(np.int64) for x, _, _ in named], pa.list_(pa.int64())), pa.array([(2 * p + o).astype(np.int32) for _, p, o in named], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), *cols], names=["id", "th", "s", "n", "parities", "members", "names", "places"])

    return docs.mapInArrow(run, f"id {kind}, th long, s long, n long, parities array<long>, members binary, names array<long>, places array<int>")


def _allowed(similarity: float, a: str = "", b: str = "o") -> Column:
    """Whether the sizes and places of two rows (place, own, n) leave a similarity open; a, b: before their columns' names."""
    one, two = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    both = F.ceil(F.lit(similarity / (1 + similarity)) * (one("n") + two("n")) - F.lit(1e-6))
    sizes = F.least(one("n"), two("n")) >= F.greatest(one("n"), two("n")) * F.lit(similarity) - F.lit(1e-9)
    return (one("own") | two("own")) & sizes & (one("n") - one("place") >= both) & (two("n") - two("place") >= both)


def _apart(a: str, b: str):
    """Bits in which the parities differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _verified(pairs: DataFrame, nodes: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (s, n, parities) that are similar. Sets are only shuffled for pairs that sizes and
    parities don't rule out."""
    side = lambda c: nodes.select(F.col("s").alias(c), *[F.col(x).alias(c + x) for x in ("n", "parities")])
    share = F.lit((1 - similarity) / (1 + similarity))
    far = (F.least("an", "bn") < F.greatest("an", "bn") * F.lit(similarity) - F.lit(1e-9)) | (_apart("aparities", "bparities") > share * (F.col("an") + F.col("bn")) + F.lit(1e-6))
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(~far).select("a", "b"), "simhash-pairs")
    # Written first, so that Spark knows its size when it plans the join: while it is small no sets are shuffled here.
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "simhash-wanted")
    sets = written(sketches.select("s", "members").join(wanted, "s", "left_semi").groupBy("s").agg(F.first("members").alias("m")), "simhash-sets")

    def compare(batches):
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in ("x", "y")]
            yield batch.select(["a", "b"]).filter(pa.array([alike(x, y, similarity) for x, y in zip(*sides, strict=True)], pa.bool_()))

    joined = near.join(sets.select(F.col("s").alias("a"), F.col("m").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("m").alias("y")), "b")
    links = written(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "simhash-links")
    discard(near, wanted, sets)
    return links


def near_rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, bits: int = NEAR_BITS) -> DataFrame:
    """(id, th, root) of every row; root: one number for each group of texts whose shingle sets are so similar.

    All pairs of that similarity count. bits: of a member's name; fewer bring more strangers together and change no result.
    """
    if not 0 < similarity <= 1 or shingle < 1 or not 8 <= bits <= 64:
        raise ValueError("similarity lies above 0 and up to 1, a shingle has a word at least; a member's name has 8 to 64 bits")
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    sketches = written(_sketched(d, dict(d.dtypes)["id"], shingle, similarity, bits), "simhash-sketches")
    part = W.partitionBy("x")
    named = sketches.select("s", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("names", "places")).alias("name"))
    named = named.select(F.col("name.names").alias("x"), "s", "n", F.col("name.places").alias("p"))
    met = named.select("*", F.min("s").over(part).alias("low"), F.max("s").over(part).alias("high")).filter("low <> high")
    met = written(met.select("x", "s", "n", F.expr("p div 2").cast("int").alias("place"), (F.col("p") % 2 == 1).alias("own")).distinct(), "simhash-met")
    wanted = written(met.select("s").distinct(), "simhash-met-sets")
    nodes = sketches.select("s", "n", "parities").join(wanted, "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("parities").alias("parities"))
    nodes = written(nodes, "simhash-nodes")
    pair = [F.least("s", "os").alias("a"), F.greatest("s", "os").alias("b")]

    def verified(rows: DataFrame) -> DataFrame:
        """rows: (s, n, place, own, o: the same of another one)."""
        wide = rows.select("s", "n", "place", "own", *[F.col(f"o.{c}").alias(f"o{c}") for c in ("s", "n", "place", "own")])
        return _verified(wide.filter((F.col("s") != F.col("os")) & _allowed(similarity)).select(*pair).distinct(), nodes, sketches, similarity)

    def apart(links: DataFrame) -> DataFrame:
        """The rows at whose member there are several components, with their component r."""
        roots = components(links).select(F.col("node").alias("s"), F.col("root").alias("c"))
        roots = roots.unionByName(roots.select(F.col("c").alias("s"), "c").distinct())  # a root is in its component
        rooted = met.join(roots, "s", "left").select("x", "s", "n", "place", "own", F.coalesce("c", "s").alias("r"))
        held = rooted.select("*", F.min("r").over(part).alias("low"), F.max("r").over(part).alias("high")).filter("low <> high")
        return written(held.drop("low", "high"), "simhash-open")

    # The least changed of all, and of those in whose class the others meet.
    me = F.struct("place", "s", "n", "own")
    centres = met.select("*", F.array_distinct(F.array(F.min(me).over(part), F.min(F.when(F.col("own"), me)).over(part))).alias("os"))
    links = verified(centres.select("s", "n", "place", "own", F.explode("os").alias("o")).filter("o IS NOT NULL"))
    held = apart(links)
    # Near copies are of about one size, so they are neighbours at a member though strangers of other sizes share it.
    before = F.lag(F.struct("s", "n", "place", "own", "r")).over(part.orderBy("n", "place", "s"))
    more = verified(held.select("*", before.alias("o")).filter("o.r <> r"))
    chained, links = links, written(links.unionByName(more), "simhash-links")
    discard(chained, more, held)
    # What is in different components and still shares a member is compared pair by pair.
    open_ = apart(links)
    other = open_.select("x", *[F.col(c).alias(f"o{c}") for c in ("s", "n", "place", "own", "r")])
    fits = (F.col("r") < F.col("or")) & _allowed(similarity)
    more = _verified(open_.join(other, "x").filter(fits).select(*pair).distinct(), nodes, sketches, similarity)
    roots = components(links.unionByName(more)).select(F.col("node").alias("s"), F.col("root").alias("r"))
    found = written(sketches.select("id", "th", "s").join(roots, "s", "left").select("id", "th", F.coalesce("r", "s").alias("root")), "simhash-docs")
    discard(sketches, met, wanted, nodes, open_, links, more)
    return found


def near_grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, th, root, component): near_rooted() with the least id of every group."""
    found = near_rooted(docs, id_col, text_col, **options)
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(least, "root").select("id", "th", "root", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[DataFrame, str, str], DataFrame] = grouped) -> DataFrame:
    """One document of each group, the one of least id (of several with that id, the one of least text hash).

    groups: what makes the groups, grouped() or near_rooted().
    """
    found = groups(docs, id_col, text_col)
    # By root, as several groups may have the same least id. Null ids: a group without any id keeps its row of least text hash.
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("best"))
    keep = written(best.select(F.col("best.id").alias("kid"), F.col("best.th").alias("kth")).distinct(), "simhash-kept")
    # The caller's columns stay in one struct, so no name or type of theirs matters.
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    kept = own.join(keep, F.col("id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth")), "left_semi")
    # Repeated rows with one id and text: the first of them by a hash of the whole row.
    nth = F.row_number().over(W.partitionBy("id", "th").orderBy(F.xxhash64(F.to_json("row"))))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")
