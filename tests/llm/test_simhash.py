import random

from skald.llm import simhash
from skald.llm.common import Scratch
from skald.llm.components import components


def brute(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(300)]
    df = spark.createDataFrame([*edges, *edges[:20], (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == brute({x for e in real for x in e}, real)
    assert components(df.limit(0), Scratch(spark, "t")).collect() == []


def linked(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= simhash.LIMIT]


def test_links_lose_none(spark, monkeypatch):
    rng = random.Random(5)
    sign = lambda x: x - ((x >> 63) << 64)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:60]]
    ball = [base[0]]
    for _ in range(400):  # one large group of near copies
        ball.append(rng.choice(ball) ^ (1 << rng.randrange(64)))
    low = [base[1] ^ rng.getrandbits(6) for _ in range(60)]  # and one that differs in few places
    fps = sorted({sign(x) for x in [*base, *near, *ball, *low]})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for size in (128, 3):
        monkeypatch.setattr(simhash, "PAIRWISE", size)
        edges = [(r.a, r.b) for r in simhash.links(df, Scratch(spark, "t")).collect()]
        assert brute(fps, edges) == brute(fps, linked(fps)), size


def test_fingerprint_against_definition():
    import re

    import xxhash

    for text in ("", None, "One", "one two", "A b C d e A b c", "é É x y z \x0b w\x1c v", "a b c " * 50):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_edge_rows(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (1, None), (2, ""), (9, "quite other words that stand here alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (1, 1), (2, 1), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0), Scratch(spark, "t")).collect() == []


def test_pivots_discard_and_lose_none(spark):
    """In one large block group, pivots alone rule out most pairs, and none that is within the limit."""
    rng = random.Random(6)
    base = [rng.getrandbits(32) for _ in range(300)]
    fps = sorted({b ^ (1 << rng.randrange(32)) if rng.random() < 0.5 else b for b in base} | {b ^ 5 for b in base[:40]})
    df = spark.createDataFrame([(f, 0) for f in fps], "fp long, k long")
    stored = Scratch(spark, "t").keep(simhash.distance_table(df.select("fp")), "pivots")
    got = {use: {(r.a, r.b) for r in simhash.candidates(df, stored, ["k"], use).collect()} for use in (0, 1, simhash.PIVOTS)}
    true = {(b, a) if b < a else (a, b) for a, b in linked(fps)}
    assert len(got[0]) == len(fps) * (len(fps) - 1) // 2
    assert true <= got[simhash.PIVOTS] <= got[1] <= got[0]
    assert len(got[1]) < 0.7 * len(got[0]) and len(got[simhash.PIVOTS]) < 0.05 * len(got[0])
    assert {(r.a, r.b) for r in simhash.verified(simhash.candidates(df, stored, ["k"])).collect()} == true
