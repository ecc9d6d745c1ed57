"""Language ID and the quality classifier against loops over single n-grams, buckets and weights."""

import math

import numpy as np

from skald.llm import langid, quality

M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def gram_hash(points):
    n = len(points)
    h = n * 0x9E3779B1 & M32
    for c in points:
        h = (h ^ c) * 0x01000193 & M32
    h ^= h >> 15
    h = h * 0x85EBCA6B & M32
    return h ^ h >> 13


# language ID


def letter(c):
    low = c.lower()
    return ord(low if len(low) == 1 else c) if c.isalpha() else 32


def lang_buckets(text):
    """How often each bucket comes, gram by gram; a gram begins with a letter or before one."""
    cp = [32, *map(letter, text), 32]
    out = {}
    for n in langid.SIZES:
        for i in range(len(cp) - n + 1):
            real = cp[i] != 32 if n == 1 else cp[i] != 32 or cp[i + 1] != 32
            if real:
                b = gram_hash(cp[i : i + n]) & (1 << langid.BITS) - 1
                out[b] = out.get(b, 0) + 1
    return out


def test_language_id_by_loops(spark):
    learned = [("the cat sat on the mat", "en"), ("The DOG ran!", "en"), ("der Hund läuft", "de"), ("die Katze saß", "de"), ("le chat, été", "fr"), ("", "fr"), (None, "en"), ("nothing", None)]
    texts = ["the dog", "Katze und Hund", "été 12 chat", "x", "the cat " * 80, "日本語 der", "12", "", None]
    model = langid.learn(spark.createDataFrame(learned, "text string, lang string"))
    counts, rows = {}, {}
    for text, lang in learned:
        if text is not None and lang is not None:
            rows[lang] = rows.get(lang, 0) + 1
            for b, n in lang_buckets(text).items():
                counts.setdefault(lang, {})[b] = counts.setdefault(lang, {}).get(b, 0) + n
    size = 1 << langid.BITS
    want = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            want.append(("und", 0.0))
            continue
        found = lang_buckets(text)
        length = sum(found.values())
        scores = {}
        for lang in rows:
            total = sum(counts[lang].values()) + langid.SMOOTHING * size
            s = sum(n * math.log((counts[lang].get(b, 0) + langid.SMOOTHING) / total) for b, n in found.items())
            scores[lang] = (s + math.log(rows[lang] / sum(rows.values()))) / max(1.0, math.sqrt(length / langid.TEMPER))
        best = max(scores, key=scores.get)
        want.append((best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.lang_pred, r.score) for r in sorted(langid.predict(docs, model).collect(), key=lambda r: r.doc_id)]
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-4)


# quality


def quality_buckets(text):
    """Buckets of words and of their 3- and 4-grams, one by one; repeats included."""
    words, at = [], 0
    cp = [32, *(32 if ord(c) == 32 or 9 <= ord(c) <= 13 else ord(c) for c in text), 32]
    out = []
    while at < len(cp):
        if cp[at] == 32:
            at += 1
            continue
        end = at
        while cp[end] != 32:
            end += 1
        words.append((at, end))
        at = end
    for a, b in words:
        total = 0
        for place, c in enumerate(cp[a:b]):
            m = (c * 0x9E3779B97F4A7C15 & M64) ^ (place * 0xC2B2AE3D27D4EB4F & M64)
            m ^= m >> 29
            total = total + (m * 0xBF58476D1CE4E5B9 & M64) & M64
        out.append((total ^ total >> 32) & (1 << quality.BITS) - 1)
    for n in quality.NGRAMS:
        for i in range(len(cp) - n + 1):
            if all(cp[i + k] != 32 for k in range(1, n - 1)):
                out.append(gram_hash(cp[i : i + n]) & (1 << quality.BITS) - 1)
    return out


def test_quality_features_and_score_by_loops():
    rng = np.random.default_rng(2)
    weight = rng.normal(0, 1, 1 << quality.BITS).astype(np.float32)
    for text in ("Some words, of a text!\nAnd é 日本 12.", "a", "  x\ty  ", "word " * 50, ""):
        buckets = quality_buckets(text)
        found = [np.zeros(0, np.int64), *quality.features(text)] if text.strip() else [np.zeros(0, np.int64)]
        assert sorted(np.concatenate(found).tolist()) == (sorted(buckets) if text.strip() else [])
        mean = sum(float(weight[b]) for b in buckets) / max(1, len(buckets)) if text.strip() else 0.0
        assert abs(quality.score(text, weight, 0.3) - 1 / (1 + math.exp(-(mean + 0.3)))) < 1e-6


def test_quality_training_by_loops(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 5)
    monkeypatch.setattr(quality, "EPOCHS", 3)
    monkeypatch.setattr(quality, "BATCH", 4)
    rng = np.random.default_rng(0)
    rows = []
    for i in range(10):
        b = np.sort(rng.choice(32, 6, replace=False))
        w = rng.random(6)
        rows.append((b, w / w.sum(), i % 2))
    dim = quality.DIMENSION
    draw = np.random.default_rng(1)
    table = draw.normal(0, 1 / dim, (32, dim)).tolist()
    out, bias = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
    steps, step = 3 * 3, 0
    for _ in range(3):
        order = draw.permutation(10)
        for at in range(0, 10, 4):
            batch = [rows[i] for i in order[at : at + 4]]
            rate = quality.RATE * (1 - step / steps)
            step += 1
            hidden, error = [], []
            for b, w, y in batch:
                h = [sum(wi * table[bi][d] for bi, wi in zip(b, w, strict=True)) for d in range(dim)]
                z = [sum(h[d] * out[d][k] for d in range(dim)) + bias[k] for k in (0, 1)]
                e = [math.exp(v - max(z)) for v in z]
                hidden.append(h)
                error.append([e[k] / sum(e) - (k == y) for k in (0, 1)])
            back = [[sum(p[k] * out[d][k] for k in (0, 1)) for d in range(dim)] for p in error]
            for d in range(dim):
                for k in (0, 1):
                    out[d][k] -= rate * sum(h[d] * p[k] for h, p in zip(hidden, error, strict=True))
            for k in (0, 1):
                bias[k] -= rate * sum(p[k] for p in error) / len(batch)
            for (b, w, _), g in zip(batch, back, strict=True):
                for bi, wi in zip(b, w, strict=True):
                    for d in range(dim):
                        table[bi][d] -= rate * 20 * wi * g[d]
    want = [sum(table[b][d] * (out[d][1] - out[d][0]) for d in range(dim)) for b in range(32)]
    weight, least = quality.train(rows)
    assert np.allclose(weight, want, atol=1e-5) and abs(least - (bias[1] - bias[0])) < 1e-6
