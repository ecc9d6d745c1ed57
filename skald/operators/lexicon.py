"""Lexicon tables applied to texts: the first cue of a sentence, and respellings.

A lexicon is a table, never part of the plan. Cues are found by an automaton in one pass over each sentence, in Arrow
batches; sentences aren't shuffled. Respellings reach a script by a join of its words with the first words of the
lexicon's keys, so that each script meets only the entries that it may need, whatever the lexicon's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Cues that are searched for at once: the bound of what is sent to the executors in one piece.
CUES = 50_000
WORD = r"\w+"


@lru_cache(maxsize=8)
def _automaton(cues: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for cue, rank in cues:
        found.add_word(cue, rank)
    found.make_automaton()
    return found


def first_cue(sents: DataFrame, lexicon: DataFrame, text: str = "sentence", out: str = "cue_emotion") -> DataFrame:
    """``sents`` with the emotion of the cue of least priority that the lower-cased text contains, null if there is none.

    ``lexicon``: cue, emotion, priority; of equal priorities the cue that sorts first counts. An empty cue is in every
    text, null cues and emotions are in none. Lexicons of more than ``CUES`` cues are searched for in several passes.
    """
    usable = lexicon.where("cue is not null and emotion is not null").groupBy("cue").agg(F.min(F.struct("priority", "emotion")).alias("x"))
    ordered = usable.select("cue", "x.priority", "x.emotion").orderBy("priority", "cue").toLocalIterator()
    part: list[tuple[str, str]] = []
    # later parts have higher priorities: a sentence takes the first part that finds something
    found = F.lit(None).cast("string")
    columns: list = []
    for row in ordered:
        part.append((row["cue"], row["emotion"]))
        if len(part) == CUES:
            columns.append(_search(sents, part, text))
            part = []
    if part:
        columns.append(_search(sents, part, text))
    return sents.withColumn(out, F.coalesce(*columns) if columns else found)


def _search(sents: DataFrame, cues: list[tuple[str, str]], text: str):
    shared = sents.sparkSession.sparkContext.broadcast(cues)

    @F.pandas_udf("string")
    def emotion(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cues = shared.value
        machine = _automaton(tuple((c, i) for i, (c, _) in enumerate(cues) if c))
        empty = next((i for i, (c, _) in enumerate(cues) if not c), None)
        for b in batches:
            out = []
            for low in b:
                best = None if low is None else empty
                if low and len(machine):
                    for _, rank in machine.iter(low):
                        if best is None or rank < best:
                            best = rank
                            if not best:
                                break
                out.append(None if best is None else cues[best][1])
            yield pd.Series(out, dtype=object)

    return emotion(F.lower(text))


# respellings


def first_word(key: str) -> str:
    found = re.search(WORD, key)
    return found.group().lower() if found else ""


def key_pattern(key: str) -> str:
    """A key as a pattern: keys that begin with a capital are met as they are written, others in any case."""
    return re.escape(key) if key[:1].isupper() else f"(?i:{re.escape(key)})"


def respell_one(text: str | None, entries: list[tuple[str, str]]) -> tuple[str | None, int]:
    """``text`` with whole words respelled, the leftmost and then the longest key first, and the number of hits."""
    if text is None or not entries:
        return text, 0
    entries = sorted(entries, key=lambda e: (-len(e[0]), e[0]))
    exact = {k: s for k, s in reversed(entries)}
    folded = {k.lower(): s for k, s in reversed(entries) if not k[:1].isupper()}
    pattern = r"\b(?:" + "|".join(key_pattern(k) for k, _ in entries) + r")\b"
    return re.subn(pattern, lambda m: exact.get(m.group()) or folded[m.group().lower()], text)


def respell(scripts: DataFrame, lexicon: DataFrame, text: str = "script_text", key: str = "script_id") -> DataFrame:
    """``scripts`` with ``said`` and ``hits``: whole words respelled by ``lexicon`` (word, spoken), what is respelled isn't read again.

    Of overlapping keys the leftmost counts, then the longest. Keys that are null, empty, without a word or spelled as they
    are spoken do nothing; of several entries with one key the first by its spelling counts. Rows that share ``key`` share
    their candidates; texts that are null stay null.
    """

    @F.pandas_udf("string")
    def head(words: pd.Series) -> pd.Series:
        return words.map(first_word)

    @F.pandas_udf("struct<said:string,hits:int>")
    def say(texts: pd.Series, entries: pd.Series) -> pd.DataFrame:
        rows = [respell_one(t, [] if e is None else [(x["word"], x["spoken"]) for x in e]) for t, e in zip(texts, entries, strict=True)]
        return pd.DataFrame(rows, columns=["said", "hits"])

    keys = lexicon.where("word <> '' and spoken <> '' and word <> spoken").groupBy("word").agg(F.min("spoken").alias("spoken"))
    keys = keys.withColumn("_first", head("word")).where("_first <> ''")
    words = scripts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), F.lower))).alias("_first"))
    mine = words.join(keys, "_first").groupBy(key).agg(F.collect_set(F.struct("word", "spoken")).alias("_entries"))
    rows = scripts.join(mine.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return rows.withColumn("_said", say(text, "_entries")).select(*scripts.columns, F.col("_said.said").alias("said"), F.col("_said.hits").alias("hits"))
