"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hash bucket and of the buckets of
its character n-grams (3 to 5 bytes of the word between marks).  A document's vector is the
mean over its words, plus the vector of one word bigram in which a word equal to the one
before it is written "=" (so that repetition counts whatever the word is).  A linear layer
and softmax give the probability of label 1.  numpy stochastic gradient descent trains all
of it on at most TRAIN_ROWS labelled rows.

After training only the difference of the two outputs matters, which is linear in the
buckets: one float for each bucket is sent to the workers (4 * BUCKETS bytes, whatever the
input), and each worker keeps the scores of the words it met in a bounded cache.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache
from .common import id_remainder, materialize, passage, sample_by_hash

#: The bound of the labelled rows that training uses.
TRAIN_ROWS = 2500
#: Of a longer text so much is trained on, from a place chosen by hash (it is scored as a whole like
#: any other): the driver holds the sample.
TRAIN_CHARS = 100_000
BUCKETS = 1 << 18
DIM, EPOCHS, BATCH, RATE, SEED = 8, 3, 32, 200.0, 11
#: Few rows are passed over more often than EPOCHS, until there were so many steps.
MIN_STEPS = 100
NGRAMS = (3, 4, 5)
#: Words in each of the two generations of a worker's cache.
CACHE = 300_000
#: Longer words are not kept in it.
LONG_WORD = 256


def buckets(word: bytes) -> Iterator[int]:
    """Of the word and its n-grams, whatever its length; bucket 0 is the bigram "="."""
    marked = b"<" + word + b">"
    yield 1 + crc32(word, 1) % (BUCKETS - 1)
    for n in NGRAMS:
        for i in range(len(marked) - n + 1):
            yield 1 + crc32(marked[i : i + n], 2) % (BUCKETS - 1)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float

    def scorer(self):
        weight, bias = self.weight.tolist(), float(self.bias)
        same = weight[0]

        def mean(word: bytes) -> float:
            total, n = 0.0, 0
            for n, b in enumerate(buckets(word), 1):
                total += weight[b]
            return total / n

        class Scores(ChunkCache):
            # a long word is scored anew, so that the cache's bytes are bounded too
            def __missing__(self, word: bytes) -> float:
                return super().__missing__(word) if len(word) <= LONG_WORD else mean(word)

        cache = Scores(mean, CACHE)

        def score(text: bytes | None) -> float:
            words = (text or b"").split()
            z = bias
            if words:
                repeats = sum(map(operator.eq, words, islice(words, 1, None)))
                z += (sum(map(cache.__getitem__, words)) + repeats * same) / len(words)
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def _add_rows(to: np.ndarray, rows: np.ndarray, what: np.ndarray) -> None:
    """to[rows] += what, where rows may repeat; np.add.at is much faster on flat arrays."""
    at = (rows[:, None] * DIM + np.arange(DIM)).ravel()
    np.add.at(to.reshape(-1), at, what.astype(np.float32).ravel())


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Labels are 0 or 1.  Without rows, or with one label only, the bias alone tells it."""
    y = np.asarray(labels, np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else 4.0 * (2 * y[0] - 1))
    ids: dict[bytes, int] = {}
    doc_words, doc_share, doc_same = [], [], []
    for t in texts:
        words = t.split()
        c = Counter(words)
        n = max(1, len(words))
        doc_words.append(np.array([ids.setdefault(w, len(ids)) for w in c], np.int64))
        doc_share.append(np.array(list(c.values()), np.float32) / n)
        doc_same.append(sum(map(operator.eq, words, islice(words, 1, None))) / n)
    features = [np.fromiter(buckets(w), np.int64) for w in ids]
    size = np.array([len(f) for f in features])
    rng = np.random.default_rng(SEED)
    e = np.zeros((BUCKETS, DIM), np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    batches = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            words, inverse = np.unique(np.concatenate([doc_words[i] for i in rows]), return_inverse=True)
            of_doc = np.repeat(np.arange(len(rows)), [len(doc_words[i]) for i in rows])
            share = np.concatenate([doc_share[i] for i in rows])
            if len(words):
                f = np.concatenate([features[w] for w in words])
                starts = np.concatenate([[0], np.cumsum(size[words])[:-1]])
                vectors = np.add.reduceat(e[f], starts, axis=0) / size[words, None]
            same = np.array([doc_same[i] for i in rows], np.float32)
            hidden = same[:, None] * e[0]
            if len(words):
                _add_rows(hidden, of_doc, share[:, None] * vectors[inverse])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            g_hidden = p @ out.T
            out -= 0.02 * rate * (hidden.T @ p)
            bias -= 0.01 * rate * p.sum(0)
            e[0] -= rate * (same @ g_hidden)
            if len(words):
                g_words = np.zeros((len(words), DIM), np.float32)
                _add_rows(g_words, inverse, share[:, None] * g_hidden[of_doc])
                _add_rows(e, f, np.repeat(-rate * g_words / size[words, None], size[words], axis=0))
    diff = out[:, 1] - out[:, 0]
    return Model((e @ diff).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, modulus: int = 3) -> Model:
    """Trains on at most TRAIN_ROWS rows of docs that have a label, of each TRAIN_CHARS characters at
    most, chosen by a hash of the id (of rows that repeat an id the least text); rows whose crc32(doc_id) modulo modulus is held_out are never among them.  Rows of
    labels without id or label count for nothing; of contradictory labels the larger holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)")
    if held_out is not None:
        known = known.where(id_remainder(F.col("doc_id"), modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # only ids that docs still has count against the bound
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = materialize(sample_by_hash(known, TRAIN_ROWS, "doc_id"), "quality-sample")
    text = passage(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id"), TRAIN_CHARS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    # chosen has at most TRAIN_ROWS rows of two numbers
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").limit(TRAIN_ROWS).collect()
    return train([bytes(r.text) for r in rows], [r.quality for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts have no words and the bias alone."""

    def run(batches):
        f = model.scorer()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([f(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, repeated rows included.
    Of docs doc_id and text are read; clashing columns there or in labels don't matter."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least least.  The text passes
    through the worker that scores it, so nothing is shuffled."""
    model = fit(docs, labels)
    names = docs.columns
    schema = docs.schema

    def run(batches):
        f = model.scorer()
        for b in batches:
            texts = b.column(names.index("text")).cast(pa.string()).to_pylist()
            yield b.filter(pa.array([f(None if t is None else t.encode()) >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
