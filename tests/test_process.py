"""The whole script pipeline against loops over one script at a time."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from skald import dimensions as D
from skald.functions import text as X
from skald.operators import script as S

TAG = re.compile(X.TAG)
SENTENCE = re.compile(S.SENTENCE.replace("(?U)", ""))
SCENE = re.compile(S.SCENE_LINE)


def paragraphs(text):
    """(scene, paragraph) in order."""
    out, mark, ranks = [], 0, {}
    for block in text.replace("\r\n", "\n").split("\n\n"):
        lines = block.split("\n")
        if any(SCENE.search(x.strip(" ")) for x in lines):
            mark += 1
            block = "\n".join(x for x in lines if x.strip(" ") and not SCENE.search(x.strip(" ")))
        if block.strip():
            out.append((ranks.setdefault(mark, len(ranks) + 1), block))
    return out


def segments(text):
    """[text, emotion, effects, pause] of one paragraph."""
    out, emotion, effects, at, held = [], "", set(), 0, ""

    def end():
        nonlocal held
        if held.strip():
            out.append([held.rstrip(), emotion, sorted(effects), 0.0])
        held = ""

    for m in [*TAG.finditer(text), None]:
        held += text[at : m.start() if m else len(text)]
        if m is None:
            end()
            return out
        at = m.end()
        name, _, value = m.group()[1:-1].partition(":")
        name, value = name.upper(), value.strip(" ")
        effect = name.lstrip("/").lower()
        if name in ("PAUSE", "EMOTION") or effect in D.EFFECTS:
            end()
        if name == "EMOTION":
            emotion = value.upper()
        elif name == "PAUSE" and out:
            try:
                seconds = float(value or 1)
            except ValueError:
                seconds = 1.0
            out[-1][3] += max(0.0, min(10.0, seconds))
        elif effect in D.EFFECTS:
            (effects.discard if name[0] == "/" else effects.add)(effect)


def sentences(text):
    out = []
    for line in text.split("\n"):
        goes_on = False
        for piece in SENTENCE.split(line):
            piece = piece.strip()
            if not piece:
                continue
            if goes_on:
                out[-1] += " " + piece
            else:
                out.append(piece)
            last = re.sub(r"\.+$", "", re.sub(r'[").]+$', "", piece.split()[-1]).lower())
            goes_on = last in D.ABBREVIATIONS and piece[-1] not in "!?"
    return out


def clauses(text, most=600):
    if len(text) <= most:
        return [text]
    out = [""]
    for c in re.split(r"(?<=[,;:।])\s+", text):
        if len(out[-1]) + len(c) + 1 <= most:
            out[-1] = (out[-1] + " " + c).strip()
        else:
            out.append(c)
    return [x for x in out if x]


def feeling(s):
    """(emotion, intensity) of a sentence."""
    low = s.lower()
    emotion, sure = next(((e, 0.75) for cues, e in D.CUES if any(c in low for c in cues)), (None, 0.0))
    if emotion is None:
        if s.rstrip(" ").endswith("!"):
            emotion, sure = ("FEAR", 0.6) if re.search("no|stop|run|help", low) or re.search(S.BENGALI_FEAR, s) else ("EXCITED", 0.5)
        elif s.rstrip(" ").endswith("?") and re.search(r"\b(who|what|where|why|how)\b", low):
            emotion, sure = "MYSTERIOUS", 0.4
        else:
            emotion = "NEUTRAL"
    return ("WHISPER", max(sure, 0.8)) if re.search(r"\bwhisper(ed|s)?\b", low) else (emotion, sure)


def jitter(seconds, text):
    share = int(hashlib.sha1(f"pause:{text}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    return 0.0 if seconds <= 0 else round(seconds * (0.85 + 0.30 * share), 3)


def narrate(text, strength=0.7, words_per_chunk=45):
    """(scene, text, emotion, effects, pause before, pause after) of each chunk."""
    rows, holds = [], ""
    for scene, paragraph in paragraphs(text):
        for seg, given, effects, pause in segments(paragraph):
            spoken = re.sub(r"[ \t]{2,}", " ", re.sub(r"\b((?i:Mr|Mrs|Ms|Dr|Prof|St|Ave|Blvd))\.(?=\s+[A-Z])", r"\1", seg))
            pieces = [p for s in sentences(spoken) for p in clauses(s)]
            for i, p in enumerate(pieces):
                emotion, sure = feeling(p)
                if emotion not in ("NEUTRAL", "WHISPER") and sure >= 0.55 - 0.15 * strength:
                    holds = emotion
                rows.append((scene, p, given or holds, sorted({*effects, "whisper"}) if emotion == "WHISPER" else effects, pause if i == len(pieces) - 1 else 0.0))
    chunks, before = [], None
    for row in rows:
        if before is None or (row[0], row[3]) != before or len(row[1].split(" ")) >= words_per_chunk or len(chunks[-1]) == 4:
            chunks.append([])
        chunks[-1].append(row)
        before = row[0], row[3]
    out = []
    for i, c in enumerate(chunks):
        said = " ".join(r[1] for r in c)
        last = c[-1][4]
        if said.rstrip(" ")[-1] in ".!?।" and last < 0.35:
            last = 0.35
        same = i > 0 and chunks[i - 1][0][0] == c[0][0]
        out.append((c[0][0], said, next((r[2] for r in reversed(c) if r[2]), ""), sorted({e for r in c for e in r[3]}), round(c[0][4] * 0.5, 3) if same else 0.0, jitter(last, said)))
    return out


def scripts():
    rng = random.Random(11)
    bits = [
        "The door was open. ", "She laughed loudly! ", "Why did he run? ", "Dr. Smith came in. ", "Nothing moved ", "he said, ", "\n", "\n\n", "\n\n", "[PAUSE:2]", "[PAUSE]", "[PAUSE:x]", "[EMOTION:FEAR]", "[EMOTION:]", "[WHISPER]", "[/WHISPER]",
        "[EMPHASIS]", "[/emphasis]", "[BOGUS:1]", "\n\n[SCENE: Two]\n\n", "\n\n# Three\n\n", "## Four\nA line of it. ", "Maria whispered the secret. ", '"Stop!" he cried. ', "one clause of a long sentence, " * 30, "word " * 60, "It ended. ", "   ", "বাঁচাও! ", "\r\n",
    ]
    fixed = ["", "   \n\n ", "[PAUSE:3]", "[PAUSE:3]First. [PAUSE:1][PAUSE:2.5] Second. [PAUSE:9]", "[SCENE: A]\n\n[SCENE: B]\n\nOnly this."]
    return fixed + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]


def test_process_is_the_loop(spark):
    texts = scripts()
    df = spark.createDataFrame([(i, t, 150, 45) for i, t in enumerate(texts)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    got = {}
    for r in S.process(df).orderBy("script_id", "chunk_id").collect():
        got.setdefault(r.script_id, []).append((r.scene_id, r.text, r.emotion, list(r.effects), r.pause_before, r.pause_after))
    for i, t in enumerate(texts):
        assert got.get(i, []) == narrate(t), repr(t)


def test_process_deals_scripts_once(spark):
    df = spark.createDataFrame([(1, "A b.", 150, 45)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    plan = S.process(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_process_with_a_lexicon(spark):
    df = spark.createDataFrame([(1, "The gnome saw Nevada. It cost $5.", 150, 45)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    lexicon = spark.createDataFrame([("gnome", "nohm"), ("five dollars", "a fiver")], "word string, spoken string")
    assert S.process(df, lexicon=lexicon).select(F.col("text")).first()[0] == "The nohm saw Nevada. It cost a fiver."


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 1000)
    rows = spark.createDataFrame([(i, "It rained. " * 10, 150, 45) for i in range(100)] + [(100, None, 150, 45)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    plan = S.process(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(script_id") == 1 and "hashpartitioning(script_id#" in plan and ", 11), REPARTITION_BY_NUM" in plan
    assert S.parts_for(rows.limit(0)) == spark.sparkContext.defaultParallelism


def test_lists_are_worked_out_once(spark):
    """Ahead of an explode Spark filters by the size of its list, for which all texts are worked out a second time."""
    df = spark.createDataFrame([(1, "A b.", 150, 45)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    plan = S.process(df)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "size(" in x]


def test_sentences_of_odd_letters_are_the_loop(spark):
    """A line that is a NUL, the characters that mark sentences within, blanks of all kinds, abbreviations in a row."""
    bits = ["The end. ", "Prof. Dr. St. Xu ", "Dr.) ", "etc. And so. ", "no.” Yes", "\x00", "\n\x00\n", "\x01", "\x02a", "\x01a ", "  ", "\n \n", "\u0085", "He said no. Yes", 'He cried "Stop!" and ', "ſt. Xu", "é. É", "? ", "Mr.. X"]
    rng = random.Random(3)
    texts = ["", "\x00", "\x01", "\x02a\x01"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    got = {i: [] for i in range(len(texts))}
    for r in S.sentences(spark.createDataFrame(list(enumerate(texts)), "script_id long, script_text string")).orderBy("script_id", "sent_no").collect():
        assert r.sent_no == len(got[r.script_id])
        got[r.script_id].append(r.sentence)
    for i, t in enumerate(texts):
        assert got[i] == sentences(t), repr(t)


def test_process_has_no_windows(spark):
    """All state is held in lists of a script's row; only the place in a scene, where it is asked for, takes a window."""
    df = spark.createDataFrame([(1, "A b.", 150, 45)], "script_id long, script_text string, target_wpm int, words_per_chunk int")
    plan = S.process(df).drop("index_in_scene")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Aggregate" not in plan


def test_long_scripts_take_linear_time(spark):
    bits = ["It rained. [PAUSE:1][WHISPER]She slept. [/WHISPER][EMOTION:SAD] He wept! ", "It rained.\n\nShe slept.\n\n# Next\n\n"]
    took = {}
    for n in (10, 20_000):
        df = spark.range(1).select(F.lit(1).alias("script_id"), F.concat(*(F.repeat(F.lit(b), n) for b in bits)).alias("script_text"), F.lit(150).alias("target_wpm"), F.lit(45).alias("words_per_chunk"))
        began = time.perf_counter()
        # a whispered chunk and one of the sentences behind it for each first bit, and one that a scene ends for each second; the first chunk
        # is the sentence before all whispers, and the last sentence of the first bits shares a chunk with the first scene's
        rows = S.process(df).agg(F.count("text"), F.sum("words")).first()
        took[n] = time.perf_counter() - began
        assert tuple(rows) == (1 + 2 * n + n - 1, 10 * n)
    assert took[20_000] < 60


def test_rows_that_share_an_id_take_windows(spark):
    """One script in several rows keeps its state from row to row; both ways give the same for scripts of one row."""
    schema = "script_id long, script_text string, target_wpm int, words_per_chunk int"
    df = spark.createDataFrame([(i, t, 150, 45) for i, t in enumerate(scripts()[:60])], schema)
    rows = lambda way: sorted(map(repr, S.timed(way(df, 0.7, None)).select("script_id", "chunk_id", "text", "scene_id", "effects", "emotion", "words", "pause_before", "pause_after", "est_seconds").collect()))
    assert rows(S.by_windows) == rows(S.by_lists)
    plan = lambda *ids: S.process(spark.createDataFrame([(i, "A b.", 150, 45) for i in ids], schema))._jdf.queryExecution().executedPlan().toString()
    assert plan(1, 2).count("Window") <= 1 < plan(1, 1).count("Window")
