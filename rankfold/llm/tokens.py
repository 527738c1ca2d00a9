"""Token counts of whole texts by a two-tier lookup on the map side.

A compact hash table with the token count of every pre-token that is itself an entry of the vocabulary (the
strings that byte-pair merges found frequent; as many as the vocabulary has, whatever the corpus) is made once
on the driver and broadcast. What misses it goes through a cache of bounded size in each Python worker, and only
what misses both is encoded, a batch of unique pre-tokens at a time. Nothing is shuffled.

The library decides in all cases. Texts of common code points are cut by the published pattern of byte-level
vocabularies, all others by the library's own pre-tokenizer; either way pre-tokens go through both tiers. When a worker
starts, the pattern is held against the library's pre-tokenizer, and the sums over pre-tokens against whole encodings,
on PROBES: if the pattern differs, the library cuts all texts; if sums differ (a normalizer, a prefix space), or a text
holds a special string, texts are encoded whole.

Edge cases: null is an empty text, 0 tokens; special strings in a text count as the one token that the library's
default makes of them; an empty table gives an empty result; repeated rows repeat; further columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Fixed value: the published pre-token pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which pattern and library are known to agree; texts with others are cut by the library.
SAFE = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€]*")
#: Entries of a worker's cache; the older half goes when it is full.
CACHE = 200_000
#: Fixed texts on which pattern, pre-tokens and library are compared at start.
PROBES = ["I'll say: it's 3 o'clock, they've 12,345.67 €!", "  two  spaces\n\n\tand tabs \r\n", "Über größe naïve Привет Ωμέγα", "x_y-z/@#$%^&*()[]{}<>|~` \u2014 \u2026 ", "camelCase HTML5 a1b2 \u00a0nbsp", " leading", "trailing ", "a", " ", "don't CAN'T we're"]

_state: dict[str, "Counter"] = {}


def _file(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class Counter:
    """Counts tokens in one worker; frequent: pre-token -> count, shared and read-only."""

    def __init__(self, tokenizer: str, frequent: dict[str, int]):
        # Spark's tasks keep the cores busy; the library's own threads for small batches cost more than they do.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.frequent, self.seen = _file(tokenizer), frequent, {}
        self.tok = _load(self.path)
        with open(self.path, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN).findall
        pre = self.tok.pre_tokenizer
        self.library = (lambda t: [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)]) if pre is not None else None
        self.whole = self.library is None or self.tok.normalizer is not None
        self.agrees = not self.whole and all(self.library(t) == self.pattern(t) for t in PROBES)
        self.whole = self.whole or any(self.count(t) != self._whole(t) for t in PROBES)

    def _whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _misses(self, pieces: list[str]) -> None:
        if len(self.seen) + len(pieces) > CACHE:
            for old in list(itertools.islice(self.seen, len(self.seen) // 2 + 1)):
                del self.seen[old]
        for p, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.seen[p] = len(e.ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole or (self.special and self.special.search(text)):
            return self._whole(text)
        pieces = self.pattern(text) if self.agrees and SAFE.fullmatch(text) else self.library(text)
        frequent, seen = self.frequent, self.seen
        n, rest = 0, []
        for p in pieces:
            k = frequent.get(p) or seen.get(p)
            if k is None:
                rest.append(p)
            else:
                n += k
        if rest:
            new = list(dict.fromkeys(rest))
            for k in range(0, len(new), CACHE // 4):
                part = new[k : k + CACHE // 4]
                self._misses(part)
                if len(new) > len(part):
                    chosen = set(part)
                    n += sum(self.seen[p] for p in rest if p in chosen)
            if len(new) <= CACHE // 4:
                n += sum(self.seen[p] for p in rest)
        return n


def frequent_lengths(tokenizer: str) -> dict[str, int]:
    """Token counts of the vocabulary's entries that are one pre-token; as many as the vocabulary has at most."""
    tok = _load(_file(tokenizer))
    cut = regex.compile(PATTERN)
    texts = (tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size()))
    pieces = list({t for t in texts if t and "�" not in t and SAFE.fullmatch(t) and cut.fullmatch(t)})
    return {p: len(e.ids) for p, e in zip(pieces, tok.encode_batch(pieces, add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are more tokens than the limit."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer))

    def run(batches):
        counter = _state.get(tokenizer)
        if counter is None:
            counter = _state[tokenizer] = Counter(tokenizer, table.value)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("t"))
    out = slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
