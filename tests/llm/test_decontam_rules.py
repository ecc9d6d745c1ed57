import collections
import random
import re

from pyspark.sql import functions as F

from skald.llm import decontam, rules
from skald.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, names in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    ids |= names
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("the of And to été in a 7 is it".split()) for _ in range(n))
    items = [(i, text(rng.randint(12, 30))) for i in range(8)] + [(20, "Two words"), (21, "one"), (3, "a of the to a of"), (22, None), (23, "--"), (9, "été " * 12)]
    docs = []
    for i in range(16):
        planted = rng.choice([t for _, t in items if t])
        docs.append((i, f"{text(30)} {planted}. {text(30)}" if i % 2 else text(60)))
    docs += [(1, "Two--words one"), docs[3], docs[3], (None, items[0][1]), (90, None), (91, "  "), (92, "two words " * 500), (93, items[1][1])]
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, n int, win string")
    b = spark.createDataFrame([(*r, "g") for r in items], "item_id long, text string, gram string")
    for limit in (decontam.BROADCAST, 0):
        monkeypatch.setattr(decontam, "BROADCAST", limit)
        got = decontam.contamination(d, b, Scratch(spark, "t")).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == brute(docs, items)
        assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert not any(r.contaminated for r in decontam.contamination(d, b.limit(0), Scratch(spark, "t")).collect())
    assert decontam.contamination(d.limit(0), b, Scratch(spark, "t")).collect() == []


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c a b c x"), (5, "a a a a"), (None, "x" * 200_000), (6, "l\nl\n\n \nl\nm"), (7, "a b c d " * 5000), (8, "### !! " * 60), (9, "é ß \x1c| < >")]


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, t string")
    rows = rules.apply_policy(rules.apply_policy(rules.ledger(df), rules.BASE, "base"), rules.STRICT).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str)
    assert got == sorted(((d, *measured(t)) for d, t in ROWS), key=str)
    for r in rows:
        assert r.base == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words) and (r.base or not r.kept)
    assert rules.ledger(df.limit(0)).collect() == []


def test_ablation(spark):
    led = spark.range(64).select(F.col("id").alias("doc_id"), F.col("id").alias("failed_bits"))
    got = {r.rule: r for r in rules.ablation(led, rules.BASE).collect()}
    assert got["too_short"].n_failed == 32 and got["too_short"].n_only == 16 and got["too_short"].n_kept_without == 32 and got["too_short"].n_docs == 64


def test_digits_and_bullets(spark):
    low = " ".join(f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(1, low), (2, low.replace("word", "12345")), (3, "- " + low.replace(" ", "\n - ")), (4, "- a\n" + low.replace(" ", "\n"))]
    led = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: {n for n, b in rules.BIT.items() if r.failed_bits & b} for r in led.collect()}
    assert got == {1: set(), 2: {"digits"}, 3: {"bullets"}, 4: set()}


def test_capitals_are_shouting(spark):
    low = " ".join(f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(1, low), (2, low.upper()), (3, low.replace(" ", "! ")), (4, low.replace("word", "WORD")), (5, low.replace("word", "WOrd")), (6, "é" * 9 + "É" * 200)]
    led = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_upper, r.kept, {n for n, b in rules.BIT.items() if r.failed_bits & b}) for r in rules.apply_policy(led, rules.STRICT).collect()}
    assert got[1] == (0, True, set()) and got[2] == (6 * 64, False, {"shouting"}) and got[3] == (0, False, {"exclamations"})
    assert got[4] == (4 * 64, False, {"shouting"}) and got[5] == (2 * 64, True, set()) and got[6][0] == 0
    assert rules.STRICT.version != "strict-1"
