"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are summed over the whole text of every learning row: each task counts into one dense
matrix and sends a row for each bucket it has seen, so what is shuffled is bounded by tasks x languages x buckets. The
log-probability matrix, buckets x languages floats with a checked number of languages, is broadcast. Texts are scored
in batches: their counts are the rows of a sparse matrix of at most ``BATCH`` entries and one text more, which is
multiplied with the matrix one language after another, so memory depends on neither languages nor lengths.

Rows whose lang or text is null teach nothing. Null texts and texts without a letter are ``und`` with score 0; equal
texts get equal results; ties go to the language that sorts first. With nothing to learn from, all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skald.llm.ngrams import crc_mod, hashed

SIZES = (1, 2, 3)
BITS = 14
#: Languages that a model may have: bounds the broadcast matrix (64 MB).
LANGUAGES = 1000
SMOOTHING = 0.5
FOLDS = 5
#: Entries of a sparse batch of texts, beyond which it is scored.
BATCH = 1 << 19
#: Evidence is divided by the square root of its n-grams over this many: long texts don't all score 1.
TEMPER = 50.0


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each comes."""
    each = np.zeros(1 << BITS, np.int64)
    for h in hashed(text or "", SIZES, BITS):
        each += np.bincount(h, minlength=1 << BITS)
    at = np.flatnonzero(each)
    return at, each[at]


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior

    def _score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, float]]:
        """Sparse rows (buckets, counts) times the matrix, language by language."""
        sizes = np.array([len(at) for at, _ in rows])
        at, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
        first = np.cumsum(sizes) - sizes
        total = np.stack([np.add.reduceat(n * self.logp[at, k], first) for k in range(len(self.langs))], axis=1)
        length = np.add.reduceat(n, first)
        score = (total + self.prior) / np.maximum(1.0, np.sqrt(length / TEMPER))[:, None]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(self.langs[k], float(p[i, k])) for i, k in enumerate(best)]

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        out: list[tuple[str, float]] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        places: list[int] = []

        def flush() -> None:
            for i, found in zip(places, self._score(rows) if rows else (), strict=True):
                out[i] = found
            rows.clear()
            places.clear()

        held = 0
        for text in texts:
            out.append(("und", 0.0))
            if text and self.langs and any(map(str.isalpha, text)):
                rows.append(counts(text))
                places.append(len(out) - 1)
                held += len(rows[-1][0])
                if held > BATCH:
                    flush()
                    held = 0
        flush()
        return out


def learn(docs: DataFrame) -> Model:
    """A model of the rows of ``docs`` (text, lang)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BITS, np.int64)
                rows[lang] = rows.get(lang, 0) + 1
                for h in hashed(text, SIZES, BITS):
                    seen[lang] += np.bincount(h, minlength=1 << BITS)
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(c[at], rows[lang])})

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    each = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).select("lang", F.col("c.bucket").alias("b"), F.col("c.n").alias("n"))
    found = sorted(each.limit(LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the model would be too large to broadcast")
    logp = np.full((1 << BITS, len(found)), SMOOTHING)
    prior = np.zeros(len(found))
    for i, r in enumerate(found):
        b, n = np.array(r["b"]), np.array(r["n"], float)
        prior[i] = n[b == -1].sum()
        logp[b[b >= 0], i] += n[b >= 0]
    logp = np.log(logp / logp.sum(axis=0, keepdims=True)) if found else logp
    return Model([r["lang"] for r in found], logp.astype(np.float32), np.log(prior / prior.sum()) if found else prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = zip(*shared.value.predict(b["text"]), strict=True) if len(b) else ((), ())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)))


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that a model learns from: a text, a lang, and outside the held-out fold."""
    return held_out(docs).where(~F.col("held_out"))


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that have no language or one that is less likely than ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != "und" and score >= least for lang, score in shared.value.predict(texts)], dtype=bool)

    return docs.where(kept("text"))
