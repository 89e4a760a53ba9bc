"""Byte-pair encoding of whole texts, from a vocabulary file of a public tokenizer.

Two ways to merge, for two operators: `merged_rounds` takes many words at once in one flat numpy
array and finds each word's lowest-rank pair by binary search over sorted pair keys; `merges_in`
takes one word, with a heap of pairs over a linked list, and counts merges without making ids.
Either is exact for a merge table in which a merge comes after those that make its parts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lean_batches, returning, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct words whose results a task keeps; beyond that it forgets all and begins anew.
CACHED_WORDS = 200_000
#: Words that are longer are worked out each time they come, so that the cache is bounded in bytes too.
CACHED_LENGTH = 64
#: New words that are merged in one flat array, as a count of their bytes.
ROUND_BYTES = 1 << 20
#: A word of more symbols than this is merged by itself, from the places that have changed.
LONG_WORD = 2_000
NO_RANK = np.iinfo(np.int64).max


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary files are installed; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves, the others in order for U+0100 and on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, iter(range(0x100, 0x200))
    for b in own:
        letters[b] = chr(b)
    return [c or chr(next(spare)) for c in letters]


class Vocabulary:
    """What a tokenizer's JSON file says: symbols, ranked merges, special strings."""

    def __init__(self, text: str) -> None:
        said = json.loads(text)
        model = said["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = np.fromiter((i for a, b in merges for i in (self.ids[a], self.ids[b], self.ids[a + b])), np.int64).reshape(-1, 3)
        letters = byte_letters()
        self.byte_ids = np.array([self.ids.get(c, -1) for c in letters], np.int64)
        self.last_ids = np.array([self.ids.get(c + self.suffix, -1) for c in letters], np.int64)
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at special strings: whether a piece is one, and the piece."""
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]


# ---------------------------------------------------------------- batched numpy rounds


class PairTable:
    """Sorted keys of all pairs that merge, for binary search."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        m = vocabulary.merges
        self.width = int(max(vocabulary.ids.values())) + 1
        keys = m[:, 0] * self.width + m[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), m[:, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)


def merged_rounds(symbols: np.ndarray, starts: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merged symbols of all words and where each word starts. No word is empty.

    symbols: those of word w at starts[w]:starts[w + 1]. A round merges, in every word, all
    places of its lowest-rank pair, from left to right where they overlap. Words without a pair drop
    out of the later rounds.
    """
    n = len(starts)
    done_symbols: list[np.ndarray] = []
    done_words: list[np.ndarray] = []
    word = np.repeat(np.arange(n), np.diff(np.append(starts, len(symbols))))
    while len(symbols):
        inside = word[1:] == word[:-1]
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1][inside] = pairs.rank(symbols[:-1][inside], symbols[1:][inside])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(symbols)))
        still = np.repeat(lowest != NO_RANK, sizes)
        done_symbols.append(symbols[~still])
        done_words.append(word[~still])
        hit = still & (rank == np.repeat(lowest, sizes))
        symbols, word, hit, rank = symbols[still], word[still], hit[still], rank[still]
        if not len(symbols):
            break
        # Of hits that touch (a pair of equal symbols), every second is taken, from the left.
        at = np.flatnonzero(hit)
        new_run = np.concatenate(([True], (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])))
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        symbols[at] = pairs.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word = symbols[keep], word[keep]
    symbols, word = np.concatenate(done_symbols or [symbols]), np.concatenate(done_words or [word])
    order = np.argsort(word, kind="stable")
    return symbols[order], np.searchsorted(word[order], np.arange(n))


def merged_long(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The merged symbols of one word, as merged_rounds() makes them, in time that goes by the merges and not by rounds times length.

    A round takes all places of the lowest rank there is; places of each rank wait in a list of their own, and only
    the neighbours of what was merged are looked up anew. As a merge comes after those that make its parts, ranks only rise.
    """
    n = len(symbols)
    symbols = np.append(symbols, -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(at: np.ndarray) -> None:
        rank = pairs.rank(symbols[at], symbols[after[at]])
        at, rank = at[rank != NO_RANK], rank[rank != NO_RANK]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else (), np.split(at, cuts), strict=False):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(part)

    wait(np.arange(n - 1))
    while ranks:
        rank = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        # A place whose pair has changed since waits under its new rank.
        at = at[(symbols[at] >= 0) & (after[at] < n)]
        at = at[pairs.rank(symbols[at], symbols[after[at]]) == rank]
        if not len(at):
            continue
        # Of places that touch, every second is taken, from the left.
        new_run = np.concatenate(([True], after[at[:-1]] != at[1:]))
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        gone = after[at]
        symbols[at] = pairs.made[rank]
        symbols[gone] = -1
        after[at] = after[gone]
        before[after[at]] = at
        left = before[at]
        wait(np.unique(np.concatenate([at[after[at] < n], left[left >= 0]])))
    return symbols[:n][symbols[:n] >= 0]


class RoundEncoder:
    """Encodes and decodes texts as a vocabulary with word ends says: NFC, white space as one space, lower case."""

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, text: str) -> None:
        self.vocabulary = Vocabulary(text)
        self.pairs = PairTable(self.vocabulary)
        self.known: dict[str, str] = {}
        self.names: dict[str, str] = {str(i): s for said in (self.vocabulary.ids, self.vocabulary.special) for s, i in said.items()}

    def words(self, text: str) -> list[str]:
        """Pre-tokens, special strings among them as they are (marked by a leading NUL)."""
        out: list[str] = []
        for special, piece in self.vocabulary.pieces(text):
            if special:
                out.append("\0" + piece)
            else:
                out += self.WORD.findall(lowered(piece))
        return out

    def encode_new(self, words: list[str]) -> list[str]:
        """The ids of each word, as decimals joined by spaces."""
        coded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        symbols = self.vocabulary.byte_ids[flat]
        symbols[starts + lengths - 1] = self.vocabulary.last_ids[flat[starts + lengths - 1]]
        if len(words) == 1 and len(symbols) > LONG_WORD:
            symbols = merged_long(symbols, self.pairs)
        else:
            symbols, starts = merged_rounds(symbols, starts, self.pairs)
        said = list(map(str, symbols.tolist()))
        ends = np.append(starts[1:], len(said)).tolist()
        return [" ".join(said[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text, as decimals joined by spaces."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        split = [self.words(t) for t in texts]
        fresh = {w for ws in split for w in set(ws) if w not in self.known}
        new = {w: str(self.vocabulary.special[w[1:]]) for w in fresh if w[0] == "\0" and w[1:] in self.vocabulary.special}
        batch: list[str] = []
        size = 0
        new.update((w, self.encode_new([w])[0]) for w in fresh if w not in new and len(w) > LONG_WORD // 4)
        for w in [*(w for w in fresh if w not in new), ""]:
            if batch and (not w or size + len(w) > ROUND_BYTES):
                new.update(zip(batch, self.encode_new(batch), strict=True))
                batch, size = [], 0
            batch.append(w)
            size += len(w)
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= CACHED_LENGTH)
        lookup = self.known.__getitem__ if all(len(w) <= CACHED_LENGTH for w in new) else lambda w: new[w] if w in new else self.known[w]
        for ws in split:
            yield " ".join(map(lookup, ws))

    def decode(self, ids: str) -> str:
        """As a tokenizer without a decoder joins its tokens: by spaces."""
        return " ".join(map(self.names.__getitem__, ids.split(" "))) if ids else ""


def lowered(text: str) -> str:
    """NFC, each run of white space as one space, lower case."""
    text = unicodedata.normalize("NFC", text)
    # Lower case goes character by character: no rule for a sigma at the end of a word.
    return text.lower() if text.isascii() else "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


# ---------------------------------------------------------------- heap and linked list


class HeapCounter:
    """Counts tokens without making them: a word's symbols, less its merges."""

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, text: str) -> None:
        self.vocabulary = v = Vocabulary(text)
        self.ranks = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(v.merges.tolist())}
        self.byte_ids = v.byte_ids.tolist()
        counter = self

        class Known(dict):
            def __missing__(self, word: str) -> int:
                n = counter.count_word(word)
                if len(word) <= CACHED_LENGTH:
                    self[word] = n
                return n

        self.known = Known()

    def count_word(self, word: str) -> int:
        symbols = [self.byte_ids[b] for b in word.encode()]
        return len(symbols) - merges_in(symbols, self.ranks)

    def count(self, text: str) -> int:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        total = 0
        for special, piece in self.vocabulary.pieces(text):
            total += 1 if special else sum(map(self.known.__getitem__, self.WORD.findall(piece)))
        return total


def merges_in(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges a word takes: the heap gives the lowest-rank pair, leftmost first.

    after and before link the symbols that are left; a pair that has changed since it was pushed is
    known by its symbols and passed over.
    """
    n = len(symbols)
    heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]  # noqa: B905
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before, merges = [*range(1, n + 1)], [*range(-1, n - 1)], 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = ranks[left, right][1], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[pair][0], i, *pair))
        h = before[i]
        if h >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[pair][0], h, *pair))
    return merges


# ---------------------------------------------------------------- over tables


def _mapped(docs: DataFrame, columns: dict[str, pa.DataType], make: Callable[[], Callable[[list[str]], list[tuple]]], keep: list[str], more: str) -> DataFrame:
    """keep and columns for every row; make() gives, once per task, the function from texts to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = of([t or "" for t in part.column(part.schema.get_field_index("__text")).to_pylist()])
                made = [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i, c in enumerate(part.schema.names) if c != "__text"), *made], names=[*(c for c in part.schema.names if c != "__text"), *columns])

    lean_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return kept.mapInArrow(returning(run), f"{fields}, {more}")


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """keep with ids, an array of int, and the decoded text of every row (null or empty text: none, empty)."""
    text = docs.sparkSession.sparkContext.broadcast(file_text(path))

    def make() -> Callable[[list[str]], list[tuple]]:
        encoder = RoundEncoder(text.value)
        return lambda texts: [([int(i) for i in ids.split(" ")] if ids else [], encoder.decode(ids)) for ids in encoder.encode(texts)]

    return _mapped(docs, {"ids": pa.list_(pa.int32()), "decoded": pa.string()}, make, keep, "ids array<int>, decoded string")


def op7_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The op7 contract: encoded(), with ids and decoded text as hashes, so that neither is stored.

    Null and empty texts have no tokens and decode to nothing; every row is encoded by itself, so ids may be null or
    repeated; an empty table gives an empty one; further columns play no part.
    """
    text = docs.sparkSession.sparkContext.broadcast(file_text(path or vocabulary_path("word_bpe_49k.json")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make() -> Callable[[list[str]], list[tuple]]:
        encoder = RoundEncoder(text.value)
        return lambda texts: [(ids.count(" ") + 1 if ids else 0, sha(ids), sha(encoder.decode(ids))) for ids in encoder.encode(texts)]

    return _mapped(docs, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, make, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_digest(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """The op8 contract. Null and empty texts have no bytes and no tokens; ids may be null or repeated.

    An empty table gives an empty one; further columns play no part.
    """
    text = docs.sparkSession.sparkContext.broadcast(file_text(path or vocabulary_path("byte_bpe_50k.json")))

    def make() -> Callable[[list[str]], list[tuple]]:
        counter = HeapCounter(text.value)

        def of(texts: list[str]) -> list[tuple]:
            counts = [counter.count(t) for t in texts]
            return [(len(t.encode()), n, n > limit) for t, n in zip(texts, counts, strict=True)]

        return of

    return _mapped(docs, {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}, make, ["doc_id"], "n_bytes long, n_tokens long, over_limit boolean")


def op7_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the vocabulary with word ends."""
    return op7_digest(table(spark, sf_dir, "documents"))


def op8_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the byte-level vocabulary."""
    return op8_digest(table(spark, sf_dir, "documents"))
