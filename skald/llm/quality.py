"""Supervised subword embeddings for document quality.

Words and their character n-grams are hashed to learned vectors; a document is the average of its vectors, and a
softmax over it gives the class. Training is minibatch stochastic gradient descent in numpy on a bounded sample of
labelled rows (``SAMPLE``, those with the least hash of the doc_id); features of the sample are made in Spark tasks
from whole texts, and all of them are learned from: the driver holds them packed. As the output is linear in the average, scoring needs one learned number for each bucket: the
broadcast is 2^BITS floats, and whole texts are scored in Arrow batches.

Null and empty texts have no features and score by the bias alone. Labels that are null or on no document teach
nothing; labels of one document that differ count once each, equal texts with the same label once in all. Rows without a doc_id
aren't learned from, other columns are ignored. Equal texts get equal scores. With nothing to learn from,
the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skald.llm.common import Scratch
from skald.llm.ngrams import PIECE, crc_mod

BITS = 16
DIMENSION = 16
#: Labelled rows that a model learns from, at most.
SAMPLE = 4000
EPOCHS = 12
BATCH = 32
RATE = 0.5
NGRAMS = (3, 4)
FOLDS = 5
CUT = 0.3


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the words of a text and of the n-grams of their characters, with blanks as word ends; symbols and case count."""
    text = text or ""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # cut between words where there is a gap to cut at
            gap = text.rfind(" ", at, end)
            end = gap if gap > at else end
        part = text[at:end]
        at = end
        cp = np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where((cp == 32) | ((cp >= 9) & (cp <= 13)), np.uint32(32), cp)
        blank = cp == 32
        inside = ~blank
        starts = np.flatnonzero(inside[1:] & blank[:-1]) + 1
        if not len(starts):
            continue
        # word hash: the sum over its places of mixed (code point, place)
        place = np.arange(len(cp)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(cp))))
        mixed = (cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed[blank] = 0
        word = np.add.reduceat(mixed, starts)
        yield ((word ^ (word >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        for n in NGRAMS:
            h = np.full(len(cp) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            crosses = np.zeros(len(h), bool)
            for i in range(n):
                h ^= cp[i : len(h) + i]
                h *= np.uint32(0x01000193)
                if 0 < i < n - 1:
                    crosses |= blank[i : len(h) + i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            yield (h[~crosses] & np.uint32((1 << BITS) - 1)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) from rows of (buckets, weights that sum to 1, label)."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIMENSION, (1 << BITS, DIMENSION))
    out = np.zeros((DIMENSION, 2))
    bias = np.zeros(2)
    steps = EPOCHS * -(-len(rows) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = [rows[i] for i in order[at : at + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            h = np.stack([w @ table[b] for b, w, _ in batch])
            logits = h @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), [y for *_, y in batch]] -= 1
            back = p @ out.T
            out -= rate * h.T @ p
            bias -= rate * p.mean(axis=0)
            for (b, w, _), g in zip(batch, back, strict=True):
                table[b] -= rate * 20 * np.outer(w, g)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """A model of ``label`` (0 or 1) from the labelled rows of ``docs``, SAMPLE at most."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, digest, y in zip(b["text"], b["digest"], b["y"], strict=True):
                count = np.zeros(1 << BITS, np.int64)
                for f in features(text):
                    count += np.bincount(f, minlength=1 << BITS)
                at = np.flatnonzero(count)
                yield pd.DataFrame({"digest": [digest], "b": [at.astype("<u2").tobytes()], "w": [(count[at] / max(1, count.sum())).astype("<f4").tobytes()], "y": [y]})

    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    named = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    ids = named.select("doc_id", "digest").join(marked, "doc_id").groupBy("digest", "y").agg(F.min("doc_id").alias("doc_id"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "digest", "y").limit(SAMPLE)
    texts = named.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["digest", "y"])
    scratch = Scratch(docs.sparkSession, "quality")
    made = scratch.keep(texts.select("text", "digest", "y").mapInPandas(make, "digest long, b binary, w binary, y int"), "features")
    # SAMPLE rows of 2^BITS features at most, six bytes each: packed, they stay in memory
    rows = [(r["digest"], r["y"], bytes(r["b"]), bytes(r["w"])) for r in made.toLocalIterator()]
    scratch.drop(made)
    if not rows:
        return np.zeros(1 << BITS, np.float32), 0.0
    rows.sort()  # the order of arrival is chance
    return train([(np.frombuffer(b, "<u2"), np.frombuffer(w, "<f4"), y) for _, y, b, w in rows])


def score(text: str | None, weight: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for f in features(text):
        total += float(weight[f].sum(dtype=np.float64))
        n += len(f)
    return float(1 / (1 + np.exp(-(total / max(1, n) + bias))))


def predict(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [score(t, *shared.value) for t in b["text"]]}, columns=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double")
    fold = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
