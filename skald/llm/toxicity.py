"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the learned weights of its hashed words and 4-grams, each once; a document is
toxic if any of its sentences is, so that its probability is their noisy-or, ``1 - product(1 - p)``. Training lowers the
document's log loss by AdaGrad with an L1 penalty in numpy: the gradient of a toxic document goes to its sentences in proportion to what
they explain. It takes a bounded sample of labelled rows, at most ``SAMPLE`` of each label, those with the least hash of
the doc_id; their features are made in Spark tasks from whole texts. Weights of all buckets are broadcast, 2^BITS floats,
and whole texts are scored in Arrow batches. ``locate`` gives the sentences that make a document toxic.

A sentence ends at ``. ! ? ; 。 ！ ？`` or a line end; one of more than ``LONG`` words is scored in parts of so many. Null and
empty texts and texts without a letter have no sentence and score 0. Labels that are null or on no document teach
nothing; labels of one document that differ count once each, equal texts with the same label once in all; rows without
a doc_id aren't learned from. Equal texts get equal scores. With nothing to learn from, weights are 0 and a document scores by
the bias of its sentences alone, under 0.5 up to some hundred of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skald.llm.common import Scratch
from skald.llm.ngrams import PIECE, crc_mod, letters

BITS = 18
#: Labelled rows of each label that a model learns from, at most.
SAMPLE = 2000
EPOCHS = 6
#: Batches that a small sample is learned from, at least.
STEPS = 600
BATCH = 32
RATE = 0.3
#: By how much of a step weights are drawn to 0: buckets that explain little have none.
SHRINK = 0.03
BIAS = -10.0
GRAM = 4
LONG = 40
FOLDS = 5
CUT = 0.5
#: Whether a code point below 65,536 ends a sentence.
STOPS = np.isin(np.arange(1 << 16), [ord(c) for c in ".!?;。！？\n\r"])


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(start, part): parts of bounded size, cut after a sentence's end where there is one, else between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            stop = max(text.rfind(c, at, end) for c in ".!?;\n")
            gap = stop if stop > at else text.rfind(" ", at, end)
            end = gap + 1 if gap > at else end
        yield at, text[at:end]
        at = end


def sentences(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket and sentence of each feature, start and end of each sentence), piece by piece.

    Sentences of a piece count from 0.
    """
    for at, part in pieces(text or ""):
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.concatenate([[np.uint32(32)], letters(part), np.full(GRAM, 32, np.uint32)])
        inside = cp != 32
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if not len(starts):
            continue
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        stops = np.cumsum(STOPS[np.minimum(raw, 0xFFFF)])
        run = stops[starts - 1]
        nth = np.arange(len(starts)) - np.searchsorted(run, run)
        fresh = np.append(True, (run[1:] != run[:-1]) | (nth[1:] % LONG == 0))
        of_word = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts)) - 1
        # word hash: the sum over its places of mixed (code point, place)
        place = np.arange(len(cp), dtype=np.int64) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(cp))))
        mixed = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed[~inside] = 0
        word = np.add.reduceat(mixed, starts)
        word = ((word ^ (word >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        # 4-grams of a word with the blanks around it: one starts at each place from the blank ahead, none crosses into the next word
        n = len(cp) - GRAM + 1
        h = np.full(n, 0x9E3779B1, np.uint32)
        for i in range(GRAM):
            h ^= cp[i : n + i]
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        real = inside[1 : n + 1] & inside[2 : n + 2]
        grams = np.flatnonzero(real)
        begins = np.zeros(len(cp), np.int32)
        begins[starts] = fresh
        of_gram = np.cumsum(begins)[grams + 1] - 1
        bucket = np.concatenate([word, (h[grams] & np.uint32((1 << BITS) - 1)).astype(np.int64)])
        yield bucket, np.concatenate([of_word, of_gram]), at + starts[first] - 1, at + ends[last] - 1


def once(bucket: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a sentence, by sentence."""
    key = np.sort(sentence << BITS | bucket)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & ((1 << BITS) - 1), key >> BITS


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def gradient(weight: np.ndarray, bias: float, bucket: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(by weight, by bias, loss) of the log loss of noisy-or documents; ``doc`` is that of each sentence."""
    z = np.bincount(sentence, weight[bucket], len(doc)) + bias
    total = np.bincount(doc, softplus(z), len(y))  # -log of the probability that no sentence is toxic
    total = np.maximum(total, 1e-12)
    by_total = np.where(y == 1, -1 / np.expm1(np.minimum(total, 500.0)), 1.0)
    by_z = by_total[doc] * sigmoid(z)
    loss = np.where(y == 1, -np.log(-np.expm1(-total)), total)
    return np.bincount(bucket, by_z[sentence], len(weight)), float(by_z.sum()), float(loss.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from rows of (buckets, their sentences, label)."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(1 << BITS), BIAS
    seen, seen_bias = np.full(1 << BITS, 0.1), 1.0
    rows = [r for r in rows if len(r[0])]
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = [rows[i] for i in order[at : at + BATCH]]
            size = np.array([int(s[-1]) + 1 if len(s) else 0 for _, s, _ in batch])
            shift = np.cumsum(size) - size
            bucket = np.concatenate([b for b, *_ in batch])
            sentence = np.concatenate([s + k for (_, s, _), k in zip(batch, shift, strict=True)])
            doc = np.repeat(np.arange(len(batch)), size)
            g, g_bias, _ = gradient(weight, bias, bucket, sentence, doc, np.array([y for *_, y in batch]))
            seen += g * g
            seen_bias += g_bias * g_bias
            step = RATE / np.sqrt(seen)
            weight -= step * g
            weight = np.sign(weight) * np.maximum(np.abs(weight) - step * SHRINK, 0)
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    return weight.astype(np.float32), float(bias)


def packed(text: str | None) -> tuple[bytes, bytes]:
    """Buckets and sentences of a whole text, as 32-bit numbers."""
    buckets, of, n = [], [], 0
    for bucket, sentence, start, _ in sentences(text):
        bucket, sentence = once(bucket, sentence)
        buckets.append(bucket)
        of.append(sentence + n)
        n += len(start)
    if not buckets:
        return b"", b""
    return np.concatenate(buckets).astype("<i4").tobytes(), np.concatenate(of).astype("<i4").tobytes()


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float]:
    """A model of ``label`` (0 or 1) from the labelled rows of ``docs``, SAMPLE of each label at most."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, digest, y in zip(b["text"], b["digest"], b["y"], strict=True):
                bucket, sentence = packed(text)
                yield pd.DataFrame({"digest": [digest], "b": [bucket], "s": [sentence], "y": [y]})

    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    named = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    ids = named.select("doc_id", "digest").join(marked, "doc_id").groupBy("digest", "y").agg(F.min("doc_id").alias("doc_id"))
    order = [F.xxhash64("doc_id"), "doc_id", "digest", "y"]
    chosen = ids.where("y = 1").orderBy(*order).limit(SAMPLE).union(ids.where("y = 0").orderBy(*order).limit(SAMPLE))
    texts = named.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["digest", "y"])
    scratch = Scratch(docs.sparkSession, "toxicity")
    made = scratch.keep(texts.select("text", "digest", "y").mapInPandas(make, "digest long, b binary, s binary, y int"), "features")
    rows = [(r["digest"], r["y"], bytes(r["b"]), bytes(r["s"])) for r in made.toLocalIterator()]
    scratch.drop(made)
    rows.sort()  # the order of arrival is chance
    return train([(np.frombuffer(b, "<i4"), np.frombuffer(s, "<i4"), y) for _, y, b, s in rows])


def spans(text: str | None, weight: np.ndarray, bias: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, logit) of the sentences of a text, piece by piece."""
    for bucket, sentence, start, end in sentences(text):
        counts = weight[bucket] != 0
        bucket, sentence = once(bucket[counts], sentence[counts])
        yield start, end, np.bincount(sentence, weight[bucket], len(start)) + bias


def score(text: str | None, weight: np.ndarray, bias: float) -> float:
    total = sum(float(softplus(z).sum()) for *_, z in spans(text, weight, bias))
    return float(-np.expm1(-total))


def locate(docs: DataFrame, model: tuple[np.ndarray, float], least: float = CUT) -> DataFrame:
    """doc_id, score and ``offending``: start, end (code points) and probability of the sentences of at least ``least``, in page order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores, found = [], []
            for text in b["text"]:
                total, here = 0.0, []
                for start, end, z in spans(text, *shared.value):
                    total += float(softplus(z).sum())
                    p = sigmoid(z)
                    here += [{"start": int(start[i]), "end": int(end[i]), "p": float(p[i])} for i in np.flatnonzero(p >= least)]
                scores.append(float(-np.expm1(-total)))
                found.append(here)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": scores, "offending": found})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, offending array<struct<start:int,end:int,p:double>>")


def predict(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted and offending for each row."""
    fold = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return locate(docs, model).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
