"""Scripts to segments, scenes, sentences, annotations and chunks.

The whole pipeline cuts a script into lists within its row, numbered in linear time, without a window or a join; the operators on rows
are windows over rows, dealt by script. ``by`` names the columns that tell scripts, or parts of scripts, apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from skald import dimensions as D
from skald.functions import text as X
from skald.operators import lexicon as L, planning as P

SCENE_LINE = r"(?i)^\s*(?:\[\s*SCENE\s*:?\s*([^\]]*)\]\s*|#{1,3}\s*(.+))$"
SENTENCE = r"""(?U)(?<=[.!?।])\s+(?=["'A-Z0-9ঀ-৿])|(?<=[.!?।]["”’])\s+"""
SIMPLE = r"(?U)(?<=[.!?।])\s+"
# The same ends in a text of several lines, and words after which a marked end is none, begun with what is quick to look for.
BLANK = r"[\s&&[^\n]]"
IN_LINE = rf"""(?U){BLANK}(?:(?<=[.!?।]{BLANK}){BLANK}*(?=["'A-Z0-9ঀ-৿])|(?<=[.!?।]["”’]{BLANK}){BLANK}*)"""
SHORT = rf"""([").](?<=(?U:(?<![^\s{X.MARK}]))(?i:{"|".join(D.ABBREVIATIONS)})[").])[").]*){X.MARK}"""
#: Pairs that keep marks in texts apart, in their order; lower-case letters neither begin nor end a sentence.
ESCAPES = (("\x02", "\x02b"), (X.MARK, "\x02a"))
MAX_CHARS = 600
#: Sentences of a chunk at most.
MOST = 4
#: Bytes of scripts that a task of ``process`` works on, about: its windows sort several forms of them at once.
PART = 4 << 20
# English verbs of speech and quotation marks.
DIALOGUE = r"\b([A-Z][a-z]+)\s+(?:said|asked|replied|whispered|shouted|murmured|sobbed|laughed|growled|breathed)\b"
QUOTED = r"""["“”‘’].+?["“”‘’]"""
# Bengali verbs of speech, fear words and question words.
BENGALI_SAID = "বললেন|বলল|বলে উঠল|জিজ্ঞেস করলেন|জিজ্ঞেস করল|প্রশ্ন করল|উত্তর দিল|চিৎকার করে বলল|ফিসফিস করে বলল|হেসে বলল|কেঁদে বলল|ডাক দিল|ডাকল|বলতে লাগল"
BENGALI_FEAR = "বাঁচাও|থাম|দৌড়|পালাও"
BENGALI_WH = r"(?<![ঀ-৿])(?:কে|কী|কেন|কিভাবে|কোথায়|কখন|কোন|কেমন)(?![ঀ-৿])"

ID = ("script_id",)
SCRIPT = (*ID, "target_wpm", "words_per_chunk")
ordered = lambda *order, by=ID: Window.partitionBy(*by).orderBy(*order)
running = lambda *order, by=ID: ordered(*order, by=by).rowsBetween(Window.unboundedPreceding, 0)


def explode_list(df: DataFrame, keep: tuple[str, ...], values: Column, no: str, out: str) -> DataFrame:
    """``keep`` and a row for each element of an array.

    The outer form, as Spark filters empty arrays ahead of the plain one, and works out their elements twice for that.
    """
    return df.select(*keep, F.posexplode_outer(values).alias(no, out)).where(F.col(no).isNotNull())


def explode_lines(df: DataFrame, text: str, sep: str, no: str, out: str) -> DataFrame:
    return explode_list(df, tuple(c for c in df.columns if c != text), F.split(text, sep), no, out)


# lists


def places(values: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The places whose element, given with its place, passes a test."""
    return F.array_compact(F.transform(values, lambda x, i: F.when(test(x, i), i)))


def each_run(starts: Column, n: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(start, length, number)`` of the runs that begin at ``starts`` in a list of ``n`` elements."""
    return X.let(starts, lambda s: F.transform(s, lambda a, j: body(a, F.coalesce(F.get(s, j + 1), n) - a, j)))


def held(values: Column) -> Column:
    """A list whose nulls take the element before."""
    return X.let(values, lambda v: F.flatten(each_run(places(v, lambda x, i: (i == 0) | x.isNotNull()), F.size(v), lambda a, n, _: F.array_repeat(F.get(v, a), n))))


# markup


def segment_list(raw: Column) -> Column:
    """Array of (text, emotion, effects, pause_after) of a tagged text.

    A tag's state holds for the text after it; a pause belongs to the text before it, pauses ahead of all text are
    dropped. Unknown tags vanish without ending a segment.
    """
    full = lambda t: t.rlike(r"(?U)\S")
    trimmed = lambda t: F.regexp_extract(t, r"(?Us)^(.*\S)", 1)
    known = ("PAUSE", "EMOTION", *(e.upper() for e in D.EFFECTS), *("/" + e.upper() for e in D.EFFECTS))

    def tag(t: Column) -> Column:
        head = F.upper(F.regexp_extract(t, r"^\[(/?[A-Za-z_]+)", 1))
        return F.struct(head.alias("head"), F.trim(F.regexp_extract(t, r":([^\]]*)\]$", 1)).alias("value"))

    def group(text: Column, x: Column) -> Column:
        """A known tag and the text up to the next one."""
        number = F.when(x["value"] == "", F.lit("1")).otherwise(x["value"]).try_cast("double")
        pause = F.when(x["head"] == "PAUSE", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(number, F.lit(1.0))))).otherwise(F.lit(0.0))
        on = (F.when(x["head"] == e.upper(), True).when(x["head"] == "/" + e.upper(), False).alias(f"on_{e}") for e in D.EFFECTS)
        return F.struct(text.alias("text"), full(text).alias("full"), F.when(x["head"] == "EMOTION", F.upper(x["value"])).alias("emotion"), pause.alias("pause"), *on)

    def groups(z: Column) -> Column:
        # part i + 1 follows tag i
        ends = places(z["parts"], lambda x, i: (i == 0) | F.get(z["tags"], i - 1)["head"].isin(*known))
        return each_run(ends, F.size(z["parts"]), lambda a, n, _: group(F.array_join(F.slice(z["parts"], a + 1, n), ""), F.get(z["tags"], a - 1)))

    def states(g: Column) -> Column:
        return F.struct(g.alias("g"), held(g["emotion"]).alias("emotion"), *(held(g[f"on_{e}"]).alias(e) for e in sorted(D.EFFECTS)))

    def cut(z: Column) -> Column:
        # the pause of a group stands before its text: it goes to the segment before
        pauses = lambda a, n: F.aggregate(F.slice(z["g"], a + 2, n), F.lit(0.0), lambda total, x: total + x["pause"])
        effects = lambda a: F.array_compact(F.array(*(F.when(F.get(z[e], a), F.lit(e)) for e in sorted(D.EFFECTS))))
        one = lambda a, n, _: F.struct(trimmed(F.get(z["g"], a)["text"]).alias("text"), F.coalesce(F.get(z["emotion"], a), F.lit("")).alias("emotion"), effects(a).alias("effects"), pauses(a, n).alias("pause_after"))
        return each_run(places(z["g"], lambda x, _: x["full"]), F.size(z["g"]), one)

    def tagged(t: Column) -> Column:
        both = F.struct(F.split(t, X.TAG).alias("parts"), F.transform(F.regexp_extract_all(t, F.lit(X.TAG), F.lit(0)), tag).alias("tags"))
        return X.let(X.let(X.let(both, groups), states), cut)

    plain = lambda t: F.array(F.struct(trimmed(t).alias("text"), F.lit("").alias("emotion"), F.array().cast("array<string>").alias("effects"), F.lit(0.0).alias("pause_after")))
    return X.let(raw, lambda t: F.when(t.contains("["), tagged(t)).otherwise(F.filter(plain(t), lambda x: x["text"] != "")))


def segments(scripts: DataFrame, by: tuple[str, ...] = ID) -> DataFrame:
    """(by, seg_no, text, emotion, effects, pause_after) of tagged scripts.

    A tag's state holds for the text after it; a pause belongs to the text before it, pauses ahead of all text are
    dropped. Unknown tags vanish without ending a segment.
    """
    raw = F.col("script_text")
    tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(raw, F.lit(X.TAG), F.lit(0)))
    rows = explode_list(scripts, by, F.arrays_zip(F.split(raw, X.TAG).alias("part"), tags.alias("tag")), "i", "z").select(*by, "i", "z.part", "z.tag")
    head = F.upper(F.regexp_extract("tag", r"^\[(/?[A-Za-z_]+)", 1))
    value = F.trim(F.regexp_extract("tag", r":([^\]]*)\]$", 1))
    number = F.when(value == "", F.lit("1")).otherwise(value).try_cast("double")
    rows = rows.withColumns(
        {
            "head": head,
            "emo": F.when(head == "EMOTION", F.upper(value)),
            "pause": F.when(head == "PAUSE", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(number, F.lit(1.0))))).otherwise(F.lit(0.0)),
            "known": head.isin("PAUSE", "EMOTION", *(e.upper() for e in D.EFFECTS), *("/" + e.upper() for e in D.EFFECTS)).cast("int"),
        }
    )
    on = {f"on_{e}": F.when(F.col("head") == e.upper(), True).when(F.col("head") == "/" + e.upper(), False) for e in D.EFFECTS}
    rows = rows.withColumns(on).withColumn("grp", F.sum("known").over(running("i", by=by)))
    state = {"emo": F.last("emo", True).over(running("i", by=by))} | {c: F.coalesce(F.last(c, True).over(running("i", by=by)), F.lit(False)) for c in on}
    rows = rows.withColumns(state)
    parts = rows.groupBy(*by, "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"),
        F.max_by("emo", "i").alias("emotion"), F.sum("pause").alias("pause"), *(F.max_by(c, "i").alias(c) for c in on),
    )
    full = F.col("text").rlike(r"(?U)\S").cast("int")
    parts = parts.withColumn("full", full).withColumn("seg_no", F.sum("full").over(running("grp", by=by)))
    effects = F.array_compact(F.array(*(F.when(F.col(f"on_{e}"), e) for e in sorted(D.EFFECTS))))
    said = F.struct(F.regexp_extract("text", r"(?Us)^(.*\S)", 1).alias("text"), F.coalesce("emotion", F.lit("")).alias("emotion"), effects.alias("effects"))
    # the pause of a group stands before its text: it goes to the segment before
    each = parts.select(*by, F.inline(F.array(F.struct("seg_no", F.when(F.col("full") == 1, said).alias("x"), F.lit(0.0).alias("pause")), F.struct((F.col("seg_no") - F.col("full")).alias("seg_no"), F.lit(None).alias("x"), F.col("pause")))))
    segs = each.groupBy(*by, "seg_no").agg(F.first("x", True).alias("x"), F.sum("pause").alias("pause_after")).where("x is not null")
    return segs.select(*by, "seg_no", "x.text", "x.emotion", "x.effects", "pause_after")


def unknown_tags(scripts: DataFrame) -> DataFrame:
    known = ["PAUSE", "EMOTION", "SCENE", *(e.upper() for e in D.EFFECTS), *("/" + e.upper() for e in D.EFFECTS)]
    tags = scripts.select("script_id", F.explode(F.regexp_extract_all("script_text", F.lit(X.TAG), F.lit(0))).alias("tag"))
    return tags.where(~F.upper(F.regexp_extract("tag", r"^\[(/?[A-Za-z_]+)", 1)).isin(*known))


def scene_list(text: Column) -> Column:
    """Array of (scene_id, title, para_no, paragraph): paragraphs by scene; marker lines are not spoken."""
    marker = lambda x: (x.contains("[") | x.contains("#")) & F.trim(x).rlike(SCENE_LINE)

    def marked(lines: Column, block: Column, no: Column) -> Column:
        first = F.trim(F.get(F.filter(lines, marker), F.lit(0)))
        title = F.trim(F.concat(F.regexp_extract(first, SCENE_LINE, 1), F.regexp_extract(first, SCENE_LINE, 2)))
        body = F.array_join(F.filter(lines, lambda x: (F.trim(x) != "") & ~marker(x)), "\n")
        return F.struct(title.alias("t"), no.alias("para_no"), F.when(title.isNull(), block).otherwise(body).alias("paragraph"))

    def block(b: Column, no: Column) -> Column:
        plain = F.struct(F.lit(None).cast("string").alias("t"), no.alias("para_no"), b.alias("paragraph"))
        return F.when(b.contains("[") | b.contains("#"), X.let(F.split(b, "\n"), lambda lines: marked(lines, b, no))).otherwise(plain)

    def cut(blocks: Column) -> Column:
        spoken = lambda a, n: F.filter(F.slice(blocks, a + 1, n), lambda x: x["paragraph"].rlike(r"(?U)\S"))
        runs = each_run(places(blocks, lambda x, i: (i == 0) | x["t"].isNotNull()), F.size(blocks), lambda a, n, _: F.struct(F.get(blocks, a)["t"].alias("t"), spoken(a, n).alias("paras")))
        name = lambda x, j: F.coalesce(F.nullif(x["t"], F.lit("")), F.concat(F.lit("Scene "), (j + 1).cast("string")))
        one = lambda x, j: F.transform(x["paras"], lambda p: F.struct((j + 1).alias("scene_id"), name(x, j).alias("title"), p["para_no"].alias("para_no"), p["paragraph"].alias("paragraph")))
        return F.flatten(F.transform(F.filter(runs, lambda x: F.size(x["paras"]) > 0), one))

    blocks = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n"), block)
    return X.let(blocks, cut)


def scenes(scripts: DataFrame, by: tuple[str, ...] = ID) -> DataFrame:
    """(by, scene_id, title, para_no, paragraph): paragraphs by scene; marker lines are not spoken."""
    blocks = explode_lines(scripts.select(*by, F.replace("script_text", F.lit("\r\n"), F.lit("\n")).alias("t")), "t", "\n\n", "para_no", "block")
    lines = F.split("block", "\n")
    marks_scene = lambda x: (x.contains("[") | x.contains("#")) & F.trim(x).rlike(SCENE_LINE)
    marks = F.filter(lines, marks_scene)
    first = F.trim(F.get(marks, F.lit(0)))
    title = F.trim(F.concat(F.regexp_extract(first, SCENE_LINE, 1), F.regexp_extract(first, SCENE_LINE, 2)))
    marked = F.size(marks) > 0
    body = F.when(marked, F.array_join(F.filter(lines, lambda x: (F.trim(x) != "") & ~marks_scene(x)), "\n")).otherwise(F.col("block"))
    rows = blocks.select(*by, "para_no", body.alias("paragraph"), marked.cast("int").alias("m"), F.when(marked, title).alias("t"))
    rows = rows.withColumns({"s": F.sum("m").over(running("para_no", by=by)), "t": F.last("t", True).over(running("para_no", by=by))}).where(F.col("paragraph").rlike(r"(?U)\S"))
    rows = rows.withColumn("scene_id", F.dense_rank().over(ordered("s", by=by)))
    return rows.select(*by, "scene_id", F.coalesce(F.nullif("t", F.lit("")), F.concat(F.lit("Scene "), F.col("scene_id").cast("string"))).alias("title"), "para_no", "paragraph")


# sentences


def simple_sentences(df: DataFrame, text: str = "script_text") -> DataFrame:
    rows = explode_lines(df.select("script_id", text), text, SIMPLE, "sent_no", "sentence")
    return rows.where(F.trim("sentence") != "")


def sentence_list(text: Column) -> Column:
    """Array of sentences: lines cut at sentence ends, fragments after an abbreviation joined again.

    Ends are marked by one character, the marks after abbreviations are taken back, and the text is split once.
    """

    def cut(t: Column) -> Column:
        lines = F.regexp_replace(F.regexp_extract(t, r"(?Us)^\s*(.*\S)", 1), rf"(?U){BLANK}*\n\s*", "\n")
        marked = F.regexp_replace(F.regexp_replace(lines, IN_LINE, X.MARK), SHORT, "$1 ")
        return F.filter(F.split(F.replace(marked, F.lit("\n"), F.lit(X.MARK)), X.MARK), lambda p: p != "")

    def escaped(t: Column) -> Column:
        """Texts that hold the mark itself."""
        for a, b in ESCAPES:
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.transform(cut(t), lambda p: F.replace(F.replace(p, *map(F.lit, ESCAPES[1][::-1])), *map(F.lit, ESCAPES[0][::-1])))

    return X.let(text, lambda t: F.when(t.contains(X.MARK), escaped(t)).otherwise(cut(t)))


def sentences(df: DataFrame, text: str = "script_text", by: tuple[str, ...] = ID) -> DataFrame:
    """(by, sent_no, sentence) of ``sentence_list``."""
    return explode_list(df, by, sentence_list(F.col(text)), "sent_no", "sentence")


def hard_split(sentence: Column, most: int = MAX_CHARS) -> Column:
    """Array of pieces: clauses of an overlong sentence packed up to ``most`` characters, in one scan of one pattern.

    A piece is the rest if that fits, else the most that ends with a clause, else one clause too long by itself.
    """
    pieces = rf"(?s) ?(.{{1,{most}}}\z|.{{0,{most - 1}}}[,;:।](?= )|.+?[,;:।](?= )|.+\z)"
    packed = F.regexp_extract_all(F.regexp_replace(sentence, r"(?U)(?<=[,;:।])\s+", " "), F.lit(pieces), F.lit(1))
    return F.when(F.length(sentence) <= most, F.array(sentence)).otherwise(F.filter(packed, lambda x: x != ""))


# rules


def is_dialogue(s: Column) -> Column:
    return s.rlike(DIALOGUE) | s.rlike(BENGALI_SAID) | s.rlike(QUOTED)


def speaker(s: Column) -> Column:
    return F.regexp_extract(s, DIALOGUE, 1)


def cues_in(text: Column) -> Column:
    """Those of the built-in cues that a text of many sentences contains, in their order: each sentence needs to be searched for these only.

    The rest of a cue from a rare letter on is searched for first, as a search stops at each place of its first letter.
    """
    cues = [(c, emotion) for group, emotion in D.CUES for c in group]
    rarest = lambda c: c[max(range(max(1, len(c) - 2)), key=lambda i: "etaoinshrdlcumwfgypbvkjxqz".find(c[i])) :]

    def found(low: Column, some: list[tuple[str, str]]) -> Column:
        return F.array_compact(F.array(*(F.when(low.contains(rarest(c)) & low.contains(c), F.struct(F.lit(c).alias("cue"), F.lit(e).alias("emotion"))) for c, e in some)))

    plain = [x for x in cues if x[0].isascii()]
    only = lambda low: (F.octet_length(low) == F.length(low)) | ~low.rlike("[ঀ-৿]")
    return X.let(F.lower(text), lambda low: F.when(only(low), found(low, plain)).otherwise(found(low, cues)))


def cue_emotion(lower: Column, cues: Column | None = None) -> Column:
    """The emotion of the first cue in the sentence, null if there is none; ``cues`` are those that it may have, or else all.

    ``lower`` is to be bound, as it is read for each cue. Cues are a list that is filtered: a chain of searches makes a method too large for the JVM to compile.
    """
    if cues is None:
        cues = F.array(*(F.struct(F.lit(c).alias("cue"), F.lit(e).alias("emotion")) for group, e in D.CUES for c in group))
    return F.get(F.filter(cues, lambda x: lower.contains(x["cue"])), F.lit(0))["emotion"]


def punctuation_emotion(s: Column) -> tuple[Column, Column]:
    end, low = F.rtrim(s), F.lower(s)
    afraid = low.rlike("no|stop|run|help") | s.rlike(BENGALI_FEAR)
    asks = end.endswith("?") & (low.rlike(r"\b(who|what|where|why|how)\b") | s.rlike(BENGALI_WH))
    emotion = F.when(end.endswith("!") & afraid, "FEAR").when(end.endswith("!"), "EXCITED").when(asks, "MYSTERIOUS")
    return emotion, sureness(emotion)


def sureness(mark: Column) -> Column:
    return F.when(mark == "FEAR", 0.6).when(mark == "EXCITED", 0.5).when(mark == "MYSTERIOUS", 0.4)


def feeling(s: Column, cues: Column | None = None) -> Column:
    """(emotion, intensity) of a sentence; ``cues`` as in ``cue_emotion``."""

    def say(x: Column) -> Column:
        score = F.when(x["cue"].isNotNull(), 0.75).otherwise(F.coalesce(sureness(x["mark"]), F.lit(0.0)))
        emotion = F.when(x["hush"], "WHISPER").otherwise(F.coalesce(x["cue"], x["mark"], F.lit("NEUTRAL")))
        return F.struct(emotion.alias("emotion"), F.when(x["hush"], F.greatest(score, F.lit(0.8))).otherwise(score).alias("intensity"))

    def found(low: Column) -> Column:
        hush = (low.contains("whisper") & low.rlike(r"\bwhisper(ed|s)?\b")) | low.contains("ফিসফিস")
        mark = F.when(s.contains("!") | s.contains("?"), punctuation_emotion(s)[0])
        return F.struct(cue_emotion(low, cues).alias("cue"), mark.alias("mark"), hush.alias("hush"))

    return X.let(X.let(F.lower(s), found), say)


def analyse(sents: DataFrame, col: str = "sentence") -> DataFrame:
    """``sents`` with emotion, intensity, is_dialogue and speaker."""
    s = F.col(col)
    out = sents.withColumn("_felt", feeling(s))
    return out.withColumns({"emotion": F.col("_felt.emotion"), "intensity": F.col("_felt.intensity"), "is_dialogue": is_dialogue(s), "speaker": speaker(s)}).drop("_felt")


def is_sure(emotion: Column, intensity: Column, strength: float) -> Column:
    return (emotion != "NEUTRAL") & (emotion != "WHISPER") & (intensity >= 0.55 - 0.15 * strength)


def annotate(analysed: DataFrame, strength: float = 0.7, order: tuple[str, ...] = ("sent_no",)) -> DataFrame:
    """``analysed`` with tag_emotion, the emotion that holds from confident sentences on, and whispered."""
    sure = is_sure(F.col("emotion"), F.col("intensity"), strength)
    return analysed.withColumns({"tag_emotion": F.coalesce(F.last(F.when(sure, F.col("emotion")), True).over(running(*order)), F.lit("")), "whispered": F.col("emotion") == "WHISPER"})


def structure(sents: DataFrame) -> DataFrame:
    """(script_id, label, start_sentence, end_sentence): each part starts at its first cue late enough and after the part before."""
    n = F.count(F.lit(1)).over(Window.partitionBy("script_id"))
    rows = sents.select("script_id", "sent_no", F.lower("sentence").alias("low"), n.alias("n"))
    after = F.lit(-1)
    names = []
    for label, share in (("Conflict", 0.1), ("Suspense", 1 / 3), ("Climax", 0.7), ("Resolution", 0.85)):
        hit = F.lit(False)
        for cue in D.STRUCTURE[label]:
            hit = hit | F.col("low").contains(cue)
        start = F.floor(F.col("n") / 10) if label == "Conflict" else F.floor(F.col("n") / 3) if label == "Suspense" else F.floor(F.col("n") * share)
        name = label.lower()
        first = F.min(F.when(hit & (F.col("sent_no") >= F.greatest(start, after)), F.col("sent_no"))).over(Window.partitionBy("script_id"))
        rows = rows.withColumn(f"_{name}", F.coalesce(first, F.lit(-1)))
        names.append((label, f"_{name}"))
        after = F.col(f"_{name}")
    one = rows.groupBy("script_id").agg(F.max("n").alias("n"), *(F.max(c).alias(c) for _, c in names))
    before, cells = F.lit(0), [F.struct(F.lit("Introduction").alias("label"), F.lit(0).cast("long").alias("start_sentence"))]
    for label, c in names:
        cells.append(F.when(F.col(c) > F.greatest(before, F.lit(0)), F.struct(F.lit(label).alias("label"), F.col(c).cast("long").alias("start_sentence"))))
        before = F.col(c)
    parts = one.select("script_id", "n", F.inline(F.array_compact(F.array(*cells))))
    end = F.lead("start_sentence").over(ordered("start_sentence")) - 1
    return parts.select("script_id", "label", "start_sentence", F.coalesce(end, F.col("n") - 1).alias("end_sentence"))


# chunks


def is_long(sentence: Column, words: Column) -> Column:
    blanks = F.octet_length(sentence) - F.octet_length(F.replace(sentence, F.lit(" "), F.lit("")))
    return blanks + 1 >= words


def chunk_groups(sents: DataFrame, most: int = MOST, order: tuple[str, ...] = ("sent_no",)) -> DataFrame:
    """``sents`` (script_id, sent_no, sentence, scene_id, effects, words_per_chunk) with chunk_id.

    A chunk ends at a new scene, a change of effects, before a long sentence, and after ``most`` sentences. ``order`` names the
    columns that order a script's sentences; all windows share its sort.
    """
    w = ordered(*order)
    key = F.array_join("effects", ",")
    long = is_long(F.col("sentence"), F.col("words_per_chunk"))
    hard = F.coalesce(F.lag("scene_id").over(w) != F.col("scene_id"), F.lit(True)) | (F.lag(key).over(w) != key) | long
    rows = sents.withColumns({"_hard": hard, "_at": F.row_number().over(w)})
    place = F.col("_at") - F.max(F.when(F.col("_hard"), F.col("_at"))).over(running(*order))
    rows = rows.withColumn("_starts", (place % most == 0).cast("int"))
    return rows.withColumn("chunk_id", (F.sum("_starts").over(running(*order)) - 1).cast("int")).drop("_hard", "_at", "_starts")


def chunk_list(sents: Column, words: Column, most: int = MOST) -> Column:
    """Array of (text, scene_id, effects, emotion, first, last, same) of a script's sentences (sentence, scene_id, effects, emotion, pause) by the rules of ``chunk_groups``.

    ``first`` and ``last`` are the pauses of the first and the last sentence; ``same`` tells whether the chunk before is of the same scene.
    """

    def cut(s: Column) -> Column:
        def hard(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            return (i == 0) | (before["scene_id"] != x["scene_id"]) | (before["effects"] != x["effects"]) | is_long(x["sentence"], words)

        def one(a: Column, n: Column, _: Column) -> Column:
            def chunk(rows: Column) -> Column:
                head = F.get(rows, F.lit(0))
                emotion = F.coalesce(F.try_element_at(F.filter(rows["emotion"], lambda e: e != ""), F.lit(-1)), F.lit(""))
                same = F.coalesce(F.get(s, a - 1)["scene_id"] == head["scene_id"], F.lit(False))
                return F.struct(
                    F.array_join(rows["sentence"], " ").alias("text"), head["scene_id"].alias("scene_id"), head["effects"].alias("effects"), emotion.alias("emotion"),
                    head["pause"].alias("first"), F.element_at(rows["pause"], -1).alias("last"), same.alias("same"),
                )

            return X.let(F.slice(s, a + 1, n), chunk)

        starts = F.flatten(each_run(places(s, hard), F.size(s), lambda a, n, _: F.sequence(a, a + n - 1, F.lit(most))))
        return each_run(starts, F.size(s), one)

    return X.let(sents, cut)


def chunks(grouped: DataFrame) -> DataFrame:
    """One row per chunk: text, words, scene, effects, the last emotion, pauses and estimated seconds."""
    return timed(joined(grouped))


def joined(grouped: DataFrame, most: int = MOST, order: tuple[str, ...] = ("sent_no",)) -> DataFrame:
    """One row per chunk, as ``chunk_list`` has them.

    The rows of a chunk follow one another and are ``most`` at most: the first one looks ahead for the others.
    """
    w = ordered(*order)
    ahead = {f"_{c}{i}": F.lead(c, i).over(w) for i in range(1, most) for c in ("chunk_id", "sentence", "emotion", "pause")}
    before = {"_chunk": F.lag("chunk_id").over(w), "_scene": F.lag("scene_id").over(w)}
    rows = grouped.withColumns(ahead | before).where("_chunk is null or _chunk <> chunk_id")
    mine = lambda c, i: F.when(F.col(f"_chunk_id{i}") == F.col("chunk_id"), F.col(f"_{c}{i}")) if i else F.col(c)
    last = F.col("pause")
    for i in range(1, most):
        last = F.when(F.col(f"_chunk_id{i}") == F.col("chunk_id"), F.col(f"_pause{i}")).otherwise(last)
    return rows.select(
        "script_id", "chunk_id", F.concat_ws(" ", *(mine("sentence", i) for i in range(most))).alias("text"), "scene_id", F.array_sort(F.array_distinct("effects")).alias("effects"),
        F.coalesce(*(F.nullif(mine("emotion", i), F.lit("")) for i in reversed(range(most))), F.lit("")).alias("emotion"), F.col("pause").alias("first"), last.alias("last"), "target_wpm",
        F.coalesce(F.col("_scene") == F.col("scene_id"), F.lit(False)).alias("same"),
    )


def timed(rows: DataFrame) -> DataFrame:
    """Chunks with words, place in the scene, pauses and estimated seconds in place of first, last and same."""
    floor = F.when(P.ends_sentence(F.col("text")) & (F.col("last") < P.BREATH), F.lit(P.BREATH)).otherwise(F.col("last"))
    out = rows.withColumns(
        {
            "words": X.word_count(F.col("text")),
            "index_in_scene": F.row_number().over(Window.partitionBy("script_id", "scene_id").orderBy("chunk_id")) - 1,
            "pause_before": F.when(F.col("same"), F.round(F.col("first") * 0.5, 3)).otherwise(F.lit(0.0)),
            "pause_after": P.jitter_pause(floor, F.col("text")),
        }
    )
    return out.withColumn("est_seconds", P.estimate_seconds(F.greatest(F.lit(1), "words"), F.col("target_wpm").cast("double"), F.col("pause_after"))).drop("first", "last", "same")


def force_emotion(scripts: DataFrame, emotion: str | None = None) -> DataFrame:
    """``scripts`` whose lines begin with the tag of the forced emotion; blank lines and scene markers stay as they are."""
    own = F.col("forced_emotion") if "forced_emotion" in scripts.columns else F.lit(None).cast("string")
    forced = F.upper(F.coalesce(F.nullif(F.trim(own), F.lit("")), F.lit(emotion or "")))
    tagged = F.regexp_replace("script_text", F.lit(r"(?m)^(?=.*\S)(?!(?i:\s*(?:\[\s*SCENE\b|#{1,3}\s)))"), F.concat(F.lit("[EMOTION:"), F.regexp_replace(forced, r"[^A-Z_]", ""), F.lit("]")))
    return scripts.withColumn("script_text", F.when(forced.isin("", "AUTO"), F.col("script_text")).otherwise(tagged))


def parts_for(scripts: DataFrame) -> int:
    """How many tasks scripts are dealt to: one for every ``PART`` bytes of text, and no fewer than there are cores.

    The texts' bytes are summed first, as a fixed number of tasks, or one that adaptive execution merges by compressed bytes, would let
    the memory of a task grow with the input.
    """
    spark = scripts.sparkSession
    size = scripts.agg(F.sum(F.octet_length("script_text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // PART))


def process(scripts: DataFrame, strength: float = 0.7, forced_emotion: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Scripts (script_id, script_text, target_wpm, words_per_chunk) to chunks: explicit tags win over annotations.

    Scenes come first, then the segments of each paragraph, its sentences and their analysis; rows are dealt by script once. An
    emotion that is forced, by a column ``forced_emotion`` or else the argument, holds from the start of every line to a tag within
    it; null, empty and AUTO force none. A ``lexicon`` table (word, spoken) respells the text in place of the built-in words.

    A script that is a row is cut in lists of that row. Where rows share an id, a script's state runs through several rows, and all go
    by windows over rows.
    """
    dealt = force_emotion(scripts, forced_emotion).select(*SCRIPT, "script_text").repartition(parts_for(scripts), "script_id")
    shared = not scripts.groupBy("script_id").count().where("count > 1").isEmpty()
    return timed((by_windows if shared else by_lists)(dealt, strength, lexicon))


def by_lists(dealt: DataFrame, strength: float, lexicon: DataFrame | None) -> DataFrame:
    """``process`` of scripts of one row each: neither a window nor a join, unless a lexicon is given."""
    part = lambda p, s: F.struct(p["scene_id"].alias("scene_id"), s["emotion"].alias("given"), s["effects"].alias("effects"), s["pause_after"].alias("pause"), s["text"].alias("text"))
    parts = F.flatten(F.transform(scene_list(F.col("script_text")), lambda p: F.transform(segment_list(p["paragraph"]), lambda s: part(p, s))))
    rows = dealt.select(*SCRIPT, parts.alias("parts"))
    said = lambda t: X.normalise(t)
    if lexicon is None:
        said = lambda t: X.let(X.normalise(t), lambda n: X.pronounce(n)[0])
    rows = rows.select(*SCRIPT, F.transform("parts", lambda p: p.withField("text", said(p["text"]))).alias("parts"))
    if lexicon is not None:
        one = explode_list(rows, SCRIPT, F.col("parts"), "no", "p").select(*SCRIPT, "no", "p", F.col("p.text").alias("text"), F.struct("script_id", "no").alias("_id"))
        one = L.respell(one, lexicon, "text", "_id").select(*SCRIPT, F.struct("no", F.col("p").withField("text", F.col("said")).alias("p")).alias("x"))
        rows = one.groupBy(*SCRIPT).agg(F.array_sort(F.collect_list("x"))["p"].alias("parts"))
    rows = rows.select(*SCRIPT, F.flatten(F.transform("parts", lambda p: spoken(p, strength))).alias("sents"))
    rows = rows.select(*SCRIPT, with_tags(F.col("sents")).alias("sents"))
    found = explode_list(rows, SCRIPT[:2], chunk_list(F.col("sents"), F.col("words_per_chunk")), "chunk_id", "c")
    return found.select("script_id", "chunk_id", "c.*", "target_wpm")


def spoken(part: Column, strength: float) -> Column:
    """The sentences of a segment (scene_id, given, effects, pause, text) with their sure emotions; the last one takes the pause."""

    def each(x: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            def cell(felt: Column) -> Column:
                sure = F.when(is_sure(felt["emotion"], felt["intensity"], strength), felt["emotion"])
                effects = F.when(felt["emotion"] == "WHISPER", F.array_sort(F.array_union(part["effects"], F.array(F.lit("whisper"))))).otherwise(part["effects"])
                pause = F.when(k == F.size(x["all"]) - 1, part["pause"]).otherwise(F.lit(0.0))
                return F.struct(s.alias("sentence"), part["scene_id"].alias("scene_id"), part["given"].alias("given"), sure.alias("sure"), effects.alias("effects"), pause.alias("pause"))

            return X.let(feeling(s, x["cues"]), cell)

        return F.transform(x["all"], one)

    split = lambda list_: F.when(F.exists(list_, lambda s: F.length(s) > MAX_CHARS), F.flatten(F.transform(list_, lambda s: hard_split(s)))).otherwise(list_)
    pieces = X.let(sentence_list(part["text"]), split)
    return X.let(X.let(pieces, lambda p: F.struct(p.alias("all"), cues_in(F.array_join(p, "\n")).alias("cues"))), each)


def with_tags(sents: Column) -> Column:
    """A script's sentences with the emotion that is given or else was the last sure one."""

    def cut(s: Column) -> Column:
        emotion = lambda x, t: F.when(x["given"] != "", x["given"]).otherwise(F.coalesce(t, F.lit("")))
        one = lambda x, t: F.struct(x["sentence"].alias("sentence"), x["scene_id"].alias("scene_id"), x["effects"].alias("effects"), emotion(x, t).alias("emotion"), x["pause"].alias("pause"))
        return F.zip_with(s, held(s["sure"]), one)

    return X.let(sents, cut)


def by_windows(dealt: DataFrame, strength: float, lexicon: DataFrame | None) -> DataFrame:
    """``process`` of scripts of any number of rows, by windows that share one sort of a script's sentences."""
    para = (*SCRIPT, "scene_id", "para_no")
    paras = scenes(dealt, SCRIPT).select(*para, F.col("paragraph").alias("script_text"))
    seg = (*para, "seg_no", "given", "effects", "pause_after")
    segs = segments(paras, para).withColumnRenamed("emotion", "given").withColumn("text", X.normalise(F.col("text")))
    if lexicon is None:
        said = segs.withColumn("text", X.let(F.col("text"), lambda t: X.pronounce(t)[0]))
    else:
        said = L.respell(segs.withColumn("_id", F.struct("script_id", "para_no", "seg_no")), lexicon, "text", "_id").withColumn("text", F.col("said"))
    # sentences stay in order by their places, so that all windows of a script share one sort
    listed = said.withColumn("_all", sentence_list(F.col("text"))).select(*seg, F.flatten(F.transform("_all", lambda s: hard_split(s))).alias("_all"))
    rows = explode_list(listed.withColumn("_n", F.size("_all")), (*seg, "_n"), F.col("_all"), "k", "sentence")
    rows = rows.withColumn("pause", F.when(F.col("k") == F.col("_n") - 1, F.col("pause_after")).otherwise(F.lit(0.0)))
    order = ("para_no", "seg_no", "k")
    rows = annotate(analyse(rows), strength, order)
    tag = F.when(F.col("given") != "", F.col("given")).otherwise(F.col("tag_emotion"))
    rows = rows.withColumns({"emotion": tag, "effects": F.when(F.col("whispered"), F.array_sort(F.array_union("effects", F.array(F.lit("whisper"))))).otherwise(F.col("effects"))})
    return joined(chunk_groups(rows, order=order), order=order)
