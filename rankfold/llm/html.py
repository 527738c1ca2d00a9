"""Main text of web pages: a sparse suffix array over each host's pages, with page structure as the tie-break.

A page becomes blocks of text in page order; scripts, styles and the like are no text. Blocks in an article or main
part that nothing in it casts doubt on are the page's own statement of its article and are kept: repeats alone would
lose an article that a host carries twice. All other blocks of all pages are judged by the array:

1. The tokens of a page's doubtful blocks are joined to one stream, with marks for the page's begin and end. Sampled
   suffixes (block starts, and local minima of a hash of three tokens, the same wherever the same tokens stand) are cut
   at DEPTH tokens. Equal suffixes of a host are counted first, so a menu on millions of pages is one row a partition.
2. Distinct suffixes are dealt out by host and first RUN tokens, sorted, and compared with the neighbours of other pages
   in that order: common lengths of RUN tokens or more are repeated runs.
3. The runs go back to their pages. A block that runs cover for the most part is boilerplate; unique runs stay.

Structure decides what the array leaves open: unrepeated blocks in menus, headers, footers, sidebars, notices, adverts,
forms and comments go, and so does what lies outside the article on a page that marks one. Where no article is marked,
blocks that two or three pages share are an article carried again if others are shared by many more, if they are long,
or by their position between kept blocks; a page of which nothing would be left keeps what the fewest pages share.

Any run of RUN + 3 tokens is found, but for up to three tokens at its start, and one of RUN tokens if it begins a block. Words in class and id never empty an
article: inside it only names that are boilerplate as a whole count (class="ad"); others (class="legal-analysis", and
names that an article's own parts bear, as class="menu") make the block doubtful, and the array decides.

Edge cases: null html is empty; a page without text gives an empty string; broken mark-up is read as browsers do
where it matters (unclosed paragraphs, bare ampersands, unclosed comments, elements that close themselves, quotes inside
unquoted values); formulas are text; a null or odd url is a host of its own
kind; rows with one page id are one page and can't prove a repeat, null ids are different pages unless url and html
agree; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, ship, written

#: Tokens of a repeated run, tokens of a suffix, window of the sampling, and the share of a block that runs must cover.
RUN, DEPTH, WINDOW, COVER = 6, 16, 4, 0.5
#: A block on so many pages at most is an article carried again, if another block is on FEW times as many pages, if it
#: has LONG tokens, or if it lies between blocks that are kept.
COPIES, FEW, LONG = 3, 4, 40
#: Pages parsed at once.
SLICE = 512

#: Attributes: a quote opens a value after an equals sign only; elsewhere (don't) it is a character.
_ATTRIBUTES = r"((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)"
#: Comments; elements whose content is no text, up to the page's end if they aren't closed; elements that are left out with
#: what they hold, only their tag if they close themselves or nothing closes them; all other tags; declarations.
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>script|style|template|iframe|textarea|xmp|noembed)(?=[\s/>]){_ATTRIBUTES}>(?:.*?</(?P=raw)(?=[\s/>])[^>]*+>|.*\Z)"
    rf"|<(?P<left>noscript|svg|select|button|object|annotation|annotation-xml)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?</(?P=left)(?=[\s/>])[^>]*+>"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+){_ATTRIBUTES}>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Names of elements; words in class, id and role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head title".split())
BOILER = frozenset("nav aside footer form menu dialog header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
WHOLE = frozenset("html body main".split())
SELF_ENDING = frozenset("p li td th tr dt dd h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Names that speak of boilerplate by themselves, those that do so only beside such a name, and those that may go along.
SURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus respond pagination pager banner".split())
#: Those that an article's own parts may have too (the menu of a restaurant, a notice, the banner of its heading): inside one they only make a block doubtful.
OWN = frozenset("menu notice notices banner masthead modal overlay promo promotion signup subscribe".split())
MAYBE = frozenset("share sharing social related recommended replies reply copyright legal login search widget follow tags".split())
ALONG = frozenset("area bar block box body bottom buttons container content desktop form group header holder inner item items left links list main mobile outer page panel posts primary right secondary section site slot text thread top unit wrap wrapper".split())
_SPLIT = re.compile(r"[^a-z0-9]+")

#: States of a block: outside any article, in one, in one but doubtful, boilerplate by structure.
OPEN, ARTICLE, DOUBTFUL, OUTSIDE = range(4)


def _named(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether class, id or role surely speak of boilerplate, may speak of it, or speak of the main part; inside an article or not."""
    sure = maybe = main = False
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            sure, main = sure or value in ROLES, main or value in MAIN
            continue
        main = main or value in MAIN
        for name in value.split():
            words = set(filter(None, _SPLIT.split(name)))
            if not words.isdisjoint(SURE) and words <= SURE | MAYBE | ALONG and not (inside and words & SURE <= OWN):
                sure = True
            elif not words.isdisjoint(SURE | MAYBE):
                maybe = maybe or words <= MAYBE | ALONG or not words.isdisjoint(SURE | MAYBE)
    return sure, maybe, main


class _Stack:
    """Open elements as (name, silent, boilerplate, named boilerplate, doubtful, main), and how many of each kind there are."""

    def __init__(self) -> None:
        self.open: list[tuple] = []
        self.counts = [0, 0, 0, 0, 0]

    def push(self, name: str, *kinds: bool) -> None:
        self.open.append((name, *kinds))
        for k, x in enumerate(kinds):
            self.counts[k] += x

    def pop(self) -> str:
        name, *kinds = self.open.pop()
        for k, x in enumerate(kinds):
            self.counts[k] -= x
        return name

    def has(self, name: str) -> bool:
        return any(e[0] == name for e in self.open)

    def around_main(self) -> None:
        """What holds an article isn't boilerplate by its name."""
        self.open = [(n, s, b, False, False, m) for n, s, b, _, _, m in self.open]
        self.counts[2] = self.counts[3] = 0

    @property
    def state(self) -> int | None:
        silent, boiler, named, doubtful, main = self.counts
        if silent:
            return None
        if boiler or named:
            return OUTSIDE
        if not main:
            return OPEN
        return DOUBTFUL if doubtful else ARTICLE


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(state, text) of a page's blocks in order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    #: What stood before an inline element that is left out of its paragraph.
    held: list[list[str]] = []
    stack = _Stack()

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((stack.state, text))

    def close(name: str) -> None:
        while True:
            flush()
            popped = stack.pop()
            if popped not in BLOCKS:
                parts.extend(held.pop())
            if popped == name:
                return

    at = 0
    html = html or ""
    for m in _TAG.finditer(html):
        if m.start() > at and not stack.counts[0]:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m["close"], m[m.lastindex]
        sure, maybe, good = _named(attributes, stack.counts[4] > 0) if attributes and not closing else (False, False, False)
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            if closing and stack.has(name):
                close(name)
            elif sure and not closing and name not in VOID:
                held.append(parts.copy())
                parts.clear()
                stack.push(name, False, False, True, False, False)
            continue
        flush()
        if closing:
            if stack.has(name):
                close(name)
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name in ("div", "p"):
            continue
        if stack.open and (stack.open[-1][0] == "p" or stack.open[-1][0] == name and name in SELF_ENDING):
            stack.pop()  # a block ends an open paragraph, and these end an open element of their kind
        inside = stack.counts[4] > 0
        good = name in MAIN or (good and not sure)
        if name in WHOLE or (name == "article" and not inside and not sure):
            sure = maybe = False
        if good and not sure:
            stack.around_main()
        boiler = name in BOILER and not (name == "header" and inside)
        stack.push(name, name in SILENT, boiler, sure, maybe and inside, good and not sure and not boiler)
    if at < len(html) and not stack.counts[0]:
        parts.append(html[at:])
    while held:
        close(stack.open[-1][0])
    flush()
    return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


class Stream:
    """The tokens of a page's judged blocks as 16-bit codes, two marks at either end, and where each block lies."""

    def __init__(self, found: list[tuple[int, str]]):
        codes, self.spans = [1, 1], {}
        for k, (state, text) in enumerate(found):
            if state != ARTICLE:
                tokens = text.split()
                self.spans[k] = (len(codes), len(codes) + len(tokens))
                codes += [3 + xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % 65_000 for t in tokens]
        codes += [2, 2]
        self.codes = np.array(codes, ">u2")

    def samples(self) -> list[int]:
        """Where suffixes begin: the page's begin, blocks, and the least of WINDOW neighbours by a hash of three tokens."""
        n = len(self.codes)
        if n < RUN or not self.spans:
            return []
        c = self.codes.astype(np.uint64)
        h = ((c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        windows = np.lib.stride_tricks.sliding_window_view(h, min(WINDOW, len(h)))
        chosen = set((np.arange(len(windows)) + windows.argmin(axis=1)).tolist()) | {0} | {a for a, _ in self.spans.values()}
        return sorted(s for s in chosen if s <= n - RUN)

    def suffix(self, s: int) -> bytes:
        return self.codes[s : s + DEPTH].tobytes().ljust(2 * DEPTH, b"\0")


def common(a: bytes, b: bytes) -> int:
    """Common tokens of two suffixes."""
    k = 0
    while k < len(a) and a[k : k + 2] == b[k : k + 2]:
        k += 2
    return k // 2


def neighbours(rows):
    """rows: (host, suffix, least page, greatest page, count), sorted by host and suffix. (host, suffix, length, count):
    the common length with the nearest suffixes of other pages, where it is RUN or more."""
    wait: list[list] = []  # suffixes of one page that wait for the next one of another page
    before = None  # the last suffix of another page than theirs
    for o, s, a, b, n in rows:
        if wait and wait[-1][0] != o:
            yield from (tuple(w[:4]) for w in wait if w[2] >= RUN)
            wait, before = [], None
        if a != b:
            length = DEPTH
        else:
            length = 0
            other = wait[-1] if wait and wait[-1][4] != a else before
            if other is not None and other[0] == o:
                length = common(other[1], s)
        same = wait and wait[-1][4] == a == b
        if not same:
            for w in wait:
                w[2] = max(w[2], common(w[1], s))
            if wait:
                before = wait[-1]
            yield from (tuple(w[:4]) for w in wait if w[2] >= RUN)
            wait = []
        wait.append([o, s, length, max(n, 2), a if a == b else None])
    yield from (tuple(w[:4]) for w in wait if w[2] >= RUN)


def decided(found: list[tuple[int, str]], runs: list[tuple[int, int, int]]) -> tuple[str, int, int]:
    """The text that is left of a page's blocks, how many blocks the array removes, and how many structure does.

    runs: (place, length, pages) of repeated suffixes in the page's stream.
    """
    spans = Stream(found).spans if len(runs) else {}
    covered: dict[int, int] = {}
    if spans:
        size = max(b for _, b in spans.values()) + 2
        inside, pages = np.zeros(size, bool), np.full(size, 2)
        for at, length, n in runs:
            inside[at : at + length] = True
            # So many pages have the first RUN tokens; where runs overlap the greater number counts.
            pages[at : at + RUN] = np.maximum(pages[at : at + RUN], n)
        for k, (a, b) in spans.items():
            if inside[a:b].sum() >= COVER * (b - a):
                covered[k] = int(np.median(pages[a:b][inside[a:b]]))
    marked = any(s in (ARTICLE, DOUBTFUL) for s, _ in found)
    most = max(covered.values(), default=0)
    rare = {k for k, n in covered.items() if found[k][0] == OPEN and n <= COPIES}
    again = {k for k in rare if FEW * covered[k] <= most or spans[k][1] - spans[k][0] >= LONG}
    sure = [k for k, (state, _) in enumerate(found) if state == OPEN and (k in again or k not in covered)]
    again |= {k for k in rare if sure and sure[0] < k < sure[-1]}
    kept, by_array, by_structure = [], 0, 0
    for k, (state, text) in enumerate(found):
        if state == ARTICLE:
            kept.append(text)
        elif k in covered and k not in again:
            by_array += 1
        elif state == DOUBTFUL or (state == OPEN and not marked):
            kept.append(text)
        else:
            by_structure += 1
    if not kept and not marked:
        # Nothing is left: what the fewest pages share.
        open_ = {k: n for k, n in covered.items() if found[k][0] == OPEN}
        fewest = min(open_.values(), default=0)
        kept = [found[k][1] for k, n in sorted(open_.items()) if n == fewest]
        by_array -= len(kept)
    return "\n\n".join(kept), by_array, by_structure


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars) of every page, and how many of its blocks the array and structure removed."""
    ship(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    kinds = dict(p.dtypes)
    own = F.xxhash64(F.col("u"), F.col("h"))
    # j: this row's content; q: the page, by its id where it has one.
    p = p.select("i", "u", F.xxhash64(host_of(F.col("u"))).alias("o"), F.xxhash64("i", own).alias("j"), F.when(F.col("i").isNull(), own).otherwise(F.xxhash64("i")).alias("q"), "h")

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                of, suffixes, at = [], [], []
                for n, h in enumerate(part.column("h").to_pylist()):
                    stream = Stream(blocks(h))
                    places = stream.samples()
                    of += [n] * len(places)
                    at += places
                    suffixes += map(stream.suffix, places)
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in "ojq"), pa.array(suffixes, pa.binary()), pa.array(at, pa.int32())], names=["o", "j", "q", "suffix", "at"])

    suffixes = written(p.select("o", "j", "q", "h").mapInArrow(spread, "o long, j long, q long, suffix binary, at int"), "pages-suffixes")
    head = F.substring("suffix", 1, 2 * RUN)
    distinct = suffixes.groupBy("o", "suffix").agg(F.min("q").alias("a"), F.max("q").alias("b"), F.count("*").alias("n")).withColumn("head", head)

    def compare(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("o", "suffix", "a", "b", "n")), strict=True)

        out: list[tuple] = []

        def packed():
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["o", "suffix", "length", "n"])

        for row in neighbours(rows()):
            out.append(row)
            if len(out) == 8192:
                yield packed()
                out.clear()
        yield packed()

    # n: suffixes of the host with these first RUN tokens. The window holds one host's distinct suffixes of one such beginning,
    # and spills; equal ones are counted before.
    array = distinct.withColumn("n", F.sum("n").over(W.partitionBy("o", "head"))).sortWithinPartitions("o", "suffix").select("o", "suffix", "a", "b", "n")
    repeated = array.mapInArrow(compare, "o long, suffix binary, length int, n long")
    runs = suffixes.join(repeated, ["o", "suffix"]).groupBy("j").agg(F.collect_set(F.struct("at", "length", "n")).alias("runs"))  # as many as a page has tokens at most
    runs = written(runs, "pages-runs")
    discard(suffixes)

    def parse(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                found = [blocks(h) for h in part.column("h").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in "iuj"), pa.array([bytes(s for s, _ in b) for b in found], pa.binary()), pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))], names=["i", "u", "j", "states", "texts"])

    def decide(batches):
        for batch in batches:
            got = []
            for states, texts, marks in zip(*(batch.column(c).to_pylist() for c in ("states", "texts", "runs")), strict=True):
                got.append(decided(list(zip(states, texts, strict=True)), [(r["at"], r["length"], r["n"]) for r in marks or ()]))
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["i", "u", "text", "by_array", "by_structure"])

    # Only text is shuffled here, and nothing where the runs are few enough for Spark to broadcast them.
    parsed = p.select("i", "u", "j", "h").mapInArrow(parse, f"i {kinds['i']}, u {kinds['u']}, j long, states binary, texts array<string>")
    out = parsed.join(runs, "j", "left").select("i", "u", "states", "texts", "runs").mapInArrow(decide, f"i {kinds['i']}, u {kinds['u']}, text string, by_array int, by_structure int")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "by_array", "by_structure")
