"""Quality classifier on subword embeddings, trained by stochastic gradient descent in numpy.

A document has three means: of the vectors of its words, of their character n-grams, and of its pairs of
neighbouring words, all hashed into one table of buckets. The mean of the three goes into a softmax over the classes. As
the output is linear in that mean, a trained model comes down to one weight per bucket: scoring adds up numbers
that are known per word, and one per pair.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import lean_batches, returning, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: At most so many labelled documents are learned from, those with the lowest hash of their id, none longer than
#: TRAINING_LONGEST bytes, and of these the first TRAINING_BYTES of text: what the driver holds is bounded.
TRAINING_ROWS, TRAINING_BYTES, TRAINING_LONGEST = 2_500, 8 << 20, 1 << 16
BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 12, (3, 4, 5)
EPOCHS, RATE, SEED = 12, 5.0, 7
#: Words whose numbers a task keeps, and their characters; beyond either it forgets all and begins anew.
CACHED_WORDS, CACHED_CHARS = 100_000, 1 << 20
#: Words, n-grams and pairs of words each have a mean of their own.
KINDS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word, the buckets of all n-grams of all words, and the number of the word that each n-gram is of."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    left = ends[of] - np.arange(len(flat))
    place = (sizes[of] - left).astype(np.uint64)
    whole = _mixed(np.add.reduceat(flat * _mixed(place + np.uint64(1)), ends - sizes))
    hashes, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[at + k]
        hashes.append(_mixed(h))
        owners.append(of[at])
    return whole, bucket(np.concatenate(hashes)), np.concatenate(owners)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def pair_buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The buckets of pairs of words, in order, from the words' hashes."""
    return bucket(_mixed(left * np.uint64(0x9E3779B97F4A7C15) + right))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features, and the share of each in the mean of the three means; no words: none."""
    words = WORD.findall(text)
    whole, grams, _ = features(words)
    kinds = [bucket(whole), grams, pair_buckets(whole[:-1], whole[1:])]
    shares = np.concatenate([np.full(len(k), 1 / (KINDS * max(1, len(k)))) for k in kinds])
    found, which = np.unique(np.concatenate(kinds), return_inverse=True)
    return found.astype(np.int32), np.bincount(which, shares, len(found)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Log odds of class 1: the bias, plus the weights of a document's features by their shares."""

    weights: np.ndarray
    bias: float

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -60.0, 60.0)))


def trained(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """docs: the bag of every document. One document is one step; the same input gives the same model.

    Without documents the score is 0.5; with one class it is that class's smoothed share.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.log(np.array([1 - share, share], np.float32))
    wanted = np.eye(2, dtype=np.float32)[labels]
    full = [i for i, (ids, _) in enumerate(docs) if len(ids)]
    steps, step = EPOCHS * len(full), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(full):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            ids, shares = docs[i]
            mine = vectors[ids]
            mean = shares @ mine
            logits = mean @ out + bias
            likely = np.exp(logits - logits.max())
            error = rate * (wanted[i] - likely / likely.sum())
            vectors[ids] = mine + shares[:, None] * (out @ error)
            out += np.outer(mean, error)
            bias += error
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id has the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> Model:
    """The model for labels (doc_id, quality) of documents that aren't held out.

    At most `rows` labels are used, and of their documents, in the same order, those up to `size` bytes of text.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.select(F.col("doc_id").alias("__id"), (F.col("quality") > 0).cast("int").alias("label"))
    # A label may come twice, and an id: the order leaves no choice between rows that differ.
    chosen = chosen.distinct().orderBy(F.xxhash64("__id"), "__id", "label").limit(rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAINING_LONGEST)
    sample = sample.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", "label", "text", F.octet_length("text").alias("__size"))
    order = Window.orderBy(F.xxhash64("__id"), "__id", "label", "text").rowsBetween(Window.unboundedPreceding, 0)
    # The limit before the window bounds what its one task sorts, if an id has very many documents.
    first = sample.orderBy(F.xxhash64("__id"), "__id", "label", "text").limit(rows)
    got = first.withColumn("__sum", F.sum("__size").over(order)).where(F.col("__sum") <= size).select("label", "text").collect()
    return trained([bag(r["text"]) for r in got], np.array([r["label"] for r in got], np.int64))


class Scorer:
    """Scores texts; of each word it keeps its hash, its weight, and the sum and number of its n-grams' weights."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros((0, 3))

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            whole, grams, of = features(part)
            more = np.stack([self.model.weights[bucket(whole)].astype(float), np.bincount(of, self.model.weights[grams], len(part)), np.bincount(of, minlength=len(part))], axis=1)
            self.hashes, self.numbers = np.concatenate([self.hashes, whole]), np.concatenate([self.numbers, more])
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)), strict=True))
            self.chars += sum(map(len, part))

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.forget()
        split = [WORD.findall(t) for t in texts]
        self.learn([*dict.fromkeys(w for ws in split for w in ws if w not in self.known)])
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter((self.known[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(split)), sizes)
        sums = [np.bincount(of, column, len(split)) for column in self.numbers[words].T]
        hashes, together = self.hashes[words], of[1:] == of[:-1]
        pairs = np.bincount(of[1:][together], self.model.weights[pair_buckets(hashes[:-1], hashes[1:])[together]], len(split))
        total = sums[0] / np.maximum(1, sizes) + sums[1] / np.maximum(1, sums[2]) + pairs / np.maximum(1, sizes - 1)
        return self.model.score(total / KINDS)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of every whole text; a null or empty text has the score of the bias alone."""
    lean_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                score = pa.array(scorer.score([t or "" for t in part.column(at).to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(returning(run), f"{fields}, `{column}` double")


def digest(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The op3 contract. Ids may be null or repeated: every row is scored by its own text.

    A null or wordless text has the score of the bias alone; no usable labels give 0.5 for all; an empty table gives an
    empty one; further columns, whatever their names, play no part.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs, with their columns, that the classifier doesn't reject."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= least).drop(name)


def op3_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones."""
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
