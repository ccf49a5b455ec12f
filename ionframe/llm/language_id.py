"""Language identification by nearest centroids.

A text's vector holds its hashed byte trigrams (ASCII lower case), with logarithmic counts,
weighted by inverse document frequency and normalised.  Each language's training vectors
are clustered into up to CENTROIDS groups by spherical k-means; a text gets the language of
the centroid with the largest cosine.  A text whose distance from its nearest centroid is
beyond that language's radius is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, materialize, passage

#: The bounds of the labelled rows that training uses, for each language and in all.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 300, 4000
#: Of a longer text so much is trained on, from a place chosen by hash (it is identified as a whole
#: like any other): the driver holds the sample.
TRAIN_CHARS = 100_000
DIM_BITS, CENTROIDS, ROUNDS = 14, 4, 12
SHARPNESS = 20.0
DIM = 1 << DIM_BITS


def counts(text: bytes) -> np.ndarray:
    """Logarithmic counts of the hashed trigrams of a whole text between blanks."""
    out = np.zeros(DIM, np.float32)
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    for lo in range(0, max(1, len(b) - 2), 1 << 20):
        x = b[lo : lo + (1 << 20) + 2].astype(np.uint32)
        code = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return np.log1p(out)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray) -> np.ndarray:
    """Centroids of unit vectors: farthest-first seeds, then spherical k-means."""
    c = _unit(x.mean(0, keepdims=True))
    seeds = [int((x @ c[0]).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(CENTROIDS, len(x)) and near.min() < 1 - 1e-6:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = np.stack([_unit(x[own == k].mean(0)) if (own == k).any() else c[k] for k in range(len(c))])
    return c


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    radius: np.ndarray  # of each language

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected."""
        cos = _unit(np.stack([counts(t) for t in texts]) * self.idf) @ self.centroids.T
        by = np.full((len(texts), len(self.languages)), -1.0)
        for k, lang in enumerate(self.language_of):
            by[:, lang] = np.maximum(by[:, lang], cos[:, k])
        best = by.argmax(1)
        top = by[np.arange(len(by)), best]
        score = 1 / np.exp(SHARPNESS * (by - top[:, None])).sum(1)
        return [self.languages[i] for i in best], score, 1 - top > self.radius[best]


def train(texts: list[bytes], langs: list[str]) -> Model:
    """With no rows the model has the one language "und", which every text gets."""
    names = sorted(set(langs))
    if not names:
        return Model(["und"], np.ones(DIM, np.float32), np.zeros((1, DIM), np.float32), np.zeros(1, int), np.ones(1))
    x = np.stack([counts(t) for t in texts])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(x * idf)
    of = np.array([names.index(n) for n in langs])
    cents, whose, radius = [], [], []
    for i in range(len(names)):
        own = x[of == i]
        c = _cluster(own)
        cents.append(c)
        whose += [i] * len(c)
        radius.append(min(1.0, 1 - 0.5 * float(np.quantile((own @ c.T).max(1), 0.01))))
    return Model(names, idf, np.concatenate(cents).astype(np.float32), np.array(whose), np.array(radius))


def fit(docs: DataFrame, held_out: int | None = 2, modulus: int = 4) -> Model:
    """Trains on docs whose lang and text are not null, but for ids whose crc32 modulo
    modulus is held_out: at most TRAIN_PER_LANGUAGE rows of a language, chosen by a hash of
    the id and the text, and at most TRAIN_ROWS in all, of each TRAIN_CHARS characters at most.
    Rows that repeat id, language and text count once."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("_lang"), F.xxhash64(F.col("text").cast("string")).alias("_text_hash"), F.col("text").isNotNull().alias("_has"))
    known = known.where("_lang is not null and _has and doc_id is not null").drop("_has").distinct()
    if held_out is not None:
        known = known.where(id_remainder(F.col("doc_id"), modulus) != held_out)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_text_hash")
    ranked = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TRAIN_PER_LANGUAGE)
    chosen = materialize(ranked.orderBy("r", "_lang", "doc_id", "_text_hash").limit(TRAIN_ROWS).select("doc_id", "_lang", "_text_hash"), "language-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_text_hash"), passage(F.col("text").cast("string"), F.col("doc_id"), TRAIN_CHARS).cast("binary").alias("text"))
    # chosen has at most TRAIN_ROWS rows
    rows = texts.join(F.broadcast(chosen), ["doc_id", "_text_hash"]).dropDuplicates(["doc_id", "_lang", "_text_hash"]).orderBy("doc_id", "_lang", "_text_hash").limit(TRAIN_ROWS).collect()
    return train([bytes(r.text) for r in rows], [r["_lang"] for r in rows])


def identify(docs: DataFrame, model: Model, held_out: int = 2, modulus: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs, repeated rows
    included.  Null texts and texts without a letter are "und" with score 0 and rejected; a
    rejected text keeps its nearest language in lang_pred.  Reads doc_id and text only."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo in range(0, len(b), 128):
                texts = b.column(1).slice(lo, 128).to_pylist()
                lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                at = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                if at:
                    got, score[at], out[at] = model.predict([texts[i].encode() for i in at])
                    for i, g in zip(at, got):
                        lang[i] = g
                yield pa.record_batch([ids.slice(lo, 128), pa.array(lang), pa.array(score), pa.array(out)], names=["doc_id", "lang_pred", "score", "rejected"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = d.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
