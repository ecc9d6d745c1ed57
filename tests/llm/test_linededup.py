import random

import pytest
from pyspark.sql import functions as F

from skald.llm import linededup
from skald.llm.common import Scratch


def shingles(line):
    n = linededup.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwéß") for _ in range(rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(rng.randint(8, 40)) for _ in range(30)]

    def near(s):
        at = rng.randrange(len(s))
        return s[:at] + rng.choice("xyz") + s[at + 1 :]

    hot = line(60)
    lines = [*base, *(near(b) for b in base), *base[:5], *(near(hot) for _ in range(50)), "ok", "ok", "   ", ""]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4 + 1)]
    return [*docs, (None, base[0]), (900, None), (901, ""), docs[3]]


def expected(rows):
    """All lines against all: what a brute-force version removes."""
    rows = list(dict.fromkeys(rows))
    at = [((-1 if d is None else d), i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for *_, x in at})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(a, b) >= linededup.SIMILARITY:
                root[find(a)] = find(b)
    keep = {}
    for d, i, x in sorted(at):
        keep.setdefault(find(x), (d, i))
    return {(d, i) for d, i, x in at if keep[find(x)] != (d, i)}


@pytest.mark.parametrize("pairwise", [32, 3])
def test_against_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(linededup, "PAIRWISE", pairwise)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, band int")
    got = linededup.dedup(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and {"doc_id", "text", "band", "removed_lines"} == set(got[0].asDict())
    removed = {(-1 if r.doc_id is None else r.doc_id, x.no) for r in got for x in r.removed_lines or ()}
    assert removed == expected(rows)
    texts = {(r.doc_id, r.text) for r in got}
    for d, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if ((-1 if d is None else d), i) not in removed)
        assert (d, left) in texts


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(df, Scratch(spark, "t")).collect() == []


def test_one_character_edits_of_short_lines(spark):
    rng = random.Random(8)
    five = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    near = lambda a, b: len(five(a) & five(b)) / len(five(a) | five(b)) >= 0.8
    rows, want = [], set()
    for n in range(30, 81):
        line = "".join(rng.choice("abcdefghij klmnop") for _ in range(n - 2))
        line = f"x{line}y"
        at = rng.randrange(8, n - 8)
        copy = line[:at] + "7" + line[at + 1 :]
        rows += [(n, line), (1000 + n, copy)]
        want |= {1000 + n} if near(line, copy) else set()
    assert {1000 + n for n in range(49, 81)} <= want
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id for r in got if r.removed_lines} == want


def test_bitmaps_discard_only_for_certain(spark):
    """Two sets of 1,000 with a similarity of 0.8 may differ in 222 elements, and in as many bits."""
    sketch = lambda p, ones: [F.lit(1000).alias(f"{p}size"), *(F.lit(-1 if k < ones else 0).cast("long").alias(f"{p}b{k}") for k in range(linededup.WORDS))]
    for ones, may in ((1, True), (3, True), (4, False)):
        row = spark.range(1).select(*sketch("x_", ones), *sketch("y_", 0))
        assert row.select(linededup._may_link("x_", "y_")).first()[0] == may


def test_recall_at_the_threshold(spark):
    """Pairs with a similarity of 0.80 to 0.85 in four classes of length, edited at single places and in one run."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz     éß"
    rows, pairs = [], 0
    while pairs < 400:
        n = rng.choice((60, 150, 400, 1500))
        line = "a" + "".join(rng.choice(letters) for _ in range(n)) + "b"
        copy = list(line)
        if rng.random() < 0.5:
            for _ in range(max(1, n // 50 + rng.randint(-1, 1))):
                copy[rng.randrange(1, n)] = "7"
        else:
            at = rng.randrange(1, n // 2)
            copy[at : at + n // 9] = ["8"] * (n // 9 + rng.randint(-2, 2))
        copy = "".join(copy)
        if 0.8 <= jaccard(line, copy) <= 0.85:
            rows += [(2 * pairs, line), (2 * pairs + 1, copy)]
            pairs += 1
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    gone = {r.doc_id for r in got if r.removed_lines}
    assert all(d % 2 for d in gone) and len(gone) >= 0.97 * pairs


def test_very_long_line(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400_000))
    rows = [(1, line), (2, line[:200_000] + "#" + line[200_000:]), (3, line[::-1]), (4, None), (4, "x\n" + line)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, x.no, x.keep_doc_id) for r in got for x in r.removed_lines or ()) == [(2, 0, 1), (4, 1, 1)]


def test_sets_and_classes_stay_in_compiled_steps(spark):
    """A generator works its expressions out uncompiled, and a class that a row isn't of has nothing to do for it."""
    texts = spark.createDataFrame([(1, "abcdefghij")], "node long, line string")
    drawn = linededup.sketches(texts)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (drawn, linededup.signatures(texts.select(F.col("line").alias("text"))))]
    generators = [x for p in plans for x in p.split("\n") if "Generate " in x]
    assert len(generators) == 4 and not any(f in x for x in generators for f in ("array_distinct", "lambda"))
    assert all("FILTER (WHERE" in p for p in plans)
    assert drawn.first()["size"] == 6


def test_sketches_leave_links_and_pairs_without_one(spark):
    lines = ["abcdefghij" * 30, "abcdefghij" * 31, "klmnopqrst" * 30, "the quick brown fox jumps over the lazy dog " * 2, "0123456789"]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    drawn = linededup.sketches(texts.where("node < 4"))
    pairs = spark.createDataFrame([(a, b) for b in range(5) for a in range(b)], "a long, b long")
    left = linededup.likely(pairs, drawn)
    found = {(r.a, r.b): r.sizes for r in left.collect()}
    assert found[0, 1] == 20 and (0, 3) not in found
    assert {p for p, sizes in found.items() if sizes is None} == {(a, 4) for a in range(4)}
    assert [tuple(r) for r in linededup.verify(left, texts).collect()] == [(0, 1)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digests_and_sets_are_made_once(spark):
    """Neither a text's digest for each of its lines nor a line's set for a filter on its size."""
    docs = spark.createDataFrame([(1, "one\n \ntwo"), (2, None)], "doc_id long, text string")
    lines = linededup.occurrences(docs)
    assert "xxhash64(text" not in optimized(lines).split("Generate posexplode")[0]
    digest = docs.select(F.xxhash64("text")).first()[0]
    assert [(r.doc_id, r.digest, r.no, r.line) for r in lines.orderBy("no").collect()] == [(1, digest, 0, "one"), (1, digest, 2, "two")]
    texts = spark.createDataFrame([(1, "abcdefghij")], "node long, line string")
    assert optimized(linededup.sketches(texts)).count("array_distinct") == 1


def test_bands_are_dealt_and_sorted_once(spark):
    lines = ["abcdefghij" * 30, "abcdefghij" * 31, "abcdefghij" * 32, "the quick brown fox", "the quick brown fox", "0123456789"]
    found = linededup.bands(linededup.signatures(spark.createDataFrame([(x,) for x in lines], "text string")))
    assert "Join" not in optimized(found) and optimized(found).count("Aggregate") == 1
    rows = found.collect()
    nodes = {r.node for r in rows}
    assert len(nodes) == 4 and all(r.low <= r.node <= r.high and r.n > 1 for r in rows)
    assert {(r.n, r.low == r.high) for r in rows} == {(3, False), (2, True)}


def test_verification_with_and_without_sizes(spark):
    """Sets of 10 and 11 that share 9 or 10: a size that is known stands for one that is made."""
    lines = ["abcdefghijklmn", "abcdefghijklmno", "abcdefghijklmxyz"]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    for known in ((None, None), (10, None), (10, 21)):
        pairs = spark.createDataFrame([(0, 1, *known), (1, 0, *((11, known[1]) if known[0] else known)), (0, 2, known[0], known[1] and 22)], "a long, b long, size long, sizes long")
        assert sorted(tuple(r) for r in linededup.verify(pairs, texts).collect()) == [(0, 1), (1, 0)]
