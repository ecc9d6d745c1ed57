"""Merkle manifests, phrase collocations and toxicity against brute force."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from skald.llm import collocations, merkle, queries, toxicity
from skald.llm.common import Scratch

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, key double"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "t", 1, 0.5) for r in rows], DOCS)


# manifests


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def grown(nodes):
    """The top and each node's way up, by loops."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            ways[i].append((nodes[a // 16 * 16 : a // 16 * 16 + 16], a % 16))
            at[i] = a // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def manifest(rows):
    size = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for d, s, lang, n, text in rows:
        of = lambda t: digest(*map(size, (d, s, lang, n, t)))
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        sources.setdefault(s, []).append((d is not None, d or 0, of(text), of(low) if hit else of(text), d))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(sources[s]) for s in order}
    tops = {s: grown([x[2] for x in leaves[s]]) for s in order}
    root, ways = grown([tops[s][0] for s in order])
    out = []
    for s, above in zip(order, ways, strict=True):
        for x, way in zip(leaves[s], tops[s][1], strict=True):
            node = x[3]
            for run, at in way + above:
                node = digest(*run[:at], node, *run[at + 1 :])
            proof = digest(*(n for run, at in way + above for i, n in enumerate(run) if i != at))
            out.append((x[4], x[2], tops[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


MANY = [(i, f"s{i % 3 if i % 2 else 0}", "en", i, f"Text {i} É") for i in range(700)] + [(None, None, None, None, None), (None, None, "x", 1, ""), (5, "S", "en", 1, "A" * 100_000)] + [(7, "s0", "en", 1, "Same")] * 20
CASES = {
    "many": MANY, "one": [(4, "a", "en", 1, "Hello")], "alone, no source": [(4, None, None, None, None)], "sixteen": [(i, "a", "en", 1, "X") for i in range(16)], "seventeen": [(i, "a", "en", 1, "X") for i in range(17)],
    "sources": [(i, f"src{i:03d}", "de", 2, "Ö" * i) for i in range(40)], "two blocks": [(i, "a", "en", 1, "X") for i in range(257)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(spark, name):
    got = merkle.manifest(table(spark, CASES[name]).repartition(3), Scratch(spark, "m"))
    assert sorted(map(tuple, got.collect()), key=str) == manifest(CASES[name])


def test_manifest_of_nothing(spark):
    assert merkle.manifest(table(spark, []), Scratch(spark, "m")).collect() == []


# collocations


def phrases(rows, least, longest, within, top):
    """By counting everything in one dictionary for each language."""
    count, total = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    count[key] = count.get(key, 0) + 1
    found = {k: f for k, f in count.items() if len(k[1]) >= 2 and f >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = any(k == lang and len(q) > len(p) and 100 * f >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (k, q), f in found.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:i]] * count[lang, p[i:]]), i) for i in range(1, len(p))]
            score, i = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:i]], count[lang, p[i:]]))
    return sorted((lang, n, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for n, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def corpus():
    rng = np.random.default_rng(3)
    words = ["a", "b", "The", "É", "x-y", "日本", "the"]
    rows = [(None, None), ("en", ""), ("en", " . \t\n"), ("und", "A b a b A b"), (None, "a B a b"), ("fr", "q " * 3000), ("en", "The\xa0x the")]
    for i in range(150):
        n = int(rng.integers(0, 30))
        rows.append((["en", "de"][i % 2], "".join(words[int(rng.integers(len(words)))] + [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"][int(rng.integers(8))] for _ in range(n))))
    return rows + [rows[-1]] * 5


@pytest.mark.parametrize("least, longest, within, top, broadcast", [(3, 5, 100, 2000, True), (3, 5, 100, 2000, False), (5, 3, 60, 7, True), (10_000, 5, 100, 10, True)])
def test_collocations(spark, monkeypatch, least, longest, within, top, broadcast):
    if not broadcast:
        monkeypatch.setattr(collocations, "BROADCAST", -1)
    monkeypatch.setattr(collocations, "BATCH", 64)
    rows = corpus()
    docs = spark.createDataFrame([(i, lang, text, 1, "x") for i, (lang, text) in enumerate(rows)], "doc_id int, lang string, text string, row int, ids string").repartition(3)
    got = collocations.collocations(docs, Scratch(spark, "c"), least, longest, within, top)
    assert sorted(map(tuple, got.collect())) == phrases(rows, least, longest, within, top)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", 2 * big), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    n = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    r = collocations.cuts(counts.where("phrase = 'a b'"), counts, n).first()
    assert r.score == 1000 * (big - 1) * 10**15 // (big * 2 * big) and (r.l, r.r) == (big, 2 * big)


# toxicity


def test_features_of_sentences():
    """Words and 4-grams of each sentence as loops find them, by what they share and what not."""
    text = "One two. Three, one! 日本 four\nfive?   .. " + "w " * 95 + "end"
    found = []
    for bucket, sentence, start, end in toxicity.sentences(text):
        b, s = toxicity.once(bucket, sentence)
        found += [(text[i:j], set(b[s == k].tolist())) for k, (i, j) in enumerate(zip(start, end, strict=True))]
    assert [t for t, _ in found] == ["One two", "Three, one", "日本 four", "five", "w " * 39 + "w", "w " * 39 + "w", "w " * 15 + "end"]

    def alone(words):
        out = set()
        for w in words:
            for bucket, *_ in toxicity.sentences(w):
                out |= set(bucket.tolist())
        return out

    for t, features in found:
        words = "".join(c if c.isalpha() else " " for c in t).split()
        assert features == alone(words)
    assert list(toxicity.sentences(None)) == list(toxicity.sentences(" 12 !! ")) == []


def test_features_in_pieces(monkeypatch):
    text = "Some words here. And more of them; 12 three four five. " * 30
    whole = toxicity.packed(text)
    monkeypatch.setattr(toxicity, "PIECE", 200)
    assert toxicity.packed(text) == whole


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    weight, bias = rng.normal(0, 1, 12), -1.0
    bucket, sentence = rng.integers(0, 12, 40), np.sort(rng.integers(0, 9, 40))
    doc, y = np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1, 0, 1, 0])

    def loss(w, b):
        out = 0.0
        for d in range(4):
            clean = 1.0
            for s in np.flatnonzero(doc == d):
                clean *= 1 - 1 / (1 + np.exp(-(sum(w[k] for k, t in zip(bucket, sentence, strict=True) if t == s) + b)))
            out -= np.log(1 - clean if y[d] else clean)
        return out

    g, g_bias, value = toxicity.gradient(weight, bias, bucket, sentence, doc, y)
    assert abs(value - loss(weight, bias)) < 1e-9
    for i in range(12):
        step = np.eye(12)[i] * 1e-6
        assert abs(g[i] - (loss(weight + step, bias) - loss(weight - step, bias)) / 2e-6) < 1e-5
    assert abs(g_bias - (loss(weight, bias + 1e-6) - loss(weight, bias - 1e-6)) / 2e-6) < 1e-5


def test_score_is_the_noisy_or_of_its_sentences():
    rng = np.random.default_rng(1)
    weight = rng.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32)
    text = "One two. Three one! " * 3 + "four five"
    clean = 1.0
    for sentence in text.replace("!", ".").split("."):
        z = -2.0
        for bucket, s, *_ in toxicity.sentences(sentence):
            z += sum(float(weight[b]) for b in set(bucket.tolist()))
            clean *= 1 - 1 / (1 + np.exp(-z))
    assert abs(toxicity.score(text, weight, -2.0) - (1 - clean)) < 1e-6


def test_toxicity_held_out_and_located(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.queries()["op13_toxicity_instances"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    known = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) >= 0.95
    insults = ("idiot", "moron", "stupid", "trash", "worthless", "disgusting", "pathetic", "scum", "loser", "clown")
    spans = [texts[r.doc_id][slice(*map(int, s.split(":")))] for r in rows if r.predicted and r.n_offending for s in r.offending.split(",")]
    assert len(spans) >= 10 and np.mean([any(w in s.lower() for w in insults) for s in spans]) >= 0.6
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, monkeypatch):
    odd = [(1, "", "en"), (2, None, "en"), (3, "12 34 ++", None), (None, "bad word " * 70, "en"), (4, "x" * 300_000, "fr"), (4, "x" * 300_000, "fr"), (5, "bad! fine.", "en")]
    docs = spark.createDataFrame([(*r, "s", 0.5, 1) for r in odd], "doc_id long, text string, lang string, score string, offending double, b int")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (4, 1), (4, 0), (5, 1), (9, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(rows) or real(rows))
    rows = toxicity.predict(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert sorted(y for *_, y in seen[0]) == [0, 0, 1, 1, 1]  # of the rows that are labelled; the two equal texts once a label
    nothing = toxicity.learn(docs, labels.limit(0))
    assert not nothing[0].any() and all(r.predicted == 0 for r in toxicity.predict(docs, nothing).collect())
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    toxicity.learn(docs, labels)
    assert sorted(y for *_, y in seen[-1]) == [0, 1]
    assert toxicity.predict(docs.limit(0), nothing).collect() == []
