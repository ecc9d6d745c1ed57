"""Phrase collocations by relational mining: sorted occurrence relations, joined with themselves, counted and pruned.

``R_k`` has the places of all frequent phrases of k words. It is stored with a row per document, its places ascending,
so that a merge of neighbours needs no shuffle. A piece ends where a place is left out: neighbours are always of one piece.
From ``R_k`` to ``R_k+1``:

* two phrases at adjacent places of a piece are merged to one of k + 1 words, named by the pair of their ids;
* the pairs are counted, first within batches, then by a shuffle of (pair, count), and the frequent ones get ids;
* a semi-join with the frequent pairs, which also puts their ids in, leaves the places of ``R_k+1``. The frequent pairs
  are broadcast if their bytes are within ``BROADCAST``; beyond it places are joined by shuffle and grouped again.

A phrase is frequent only if both its parts of k words are, so nothing is lost by pruning; ids stand for whole phrases,
no hash does. Counts are exact, scores are computed in 38 digits.

Null texts have no words, a null language is ``und``. Equal rows count as often as they are there. Other columns are
ignored. A table without frequent phrases gives no rows. A text of any length is one row of each relation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from skald.llm.common import Scratch, ascii_lower, size_of

LEAST = 100
LONGEST = 5
#: Hundredths of a phrase's occurrences within a longer candidate from which it is dropped.
WITHIN = 100
TOP = 2000
#: Bytes up to which frequent groups are broadcast.
BROADCAST = 32 << 20
#: Places that are counted at once in a task.
BATCH = 1 << 20
#: Parts that each language is divided into before its first rows are sought.
SALTS = 64
#: A token that ends a piece; it has a place of its own and is no word.
END = "\n"


def tokens(text: Column) -> Column:
    """The words of a text in order, with END between its pieces; empty tokens at the ends of the text are none."""
    return F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[.,;:!?\x0A-\x0D]+", " \n "), r"[\x20\x09]+")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), tokens(F.col("text").cast("string")).alias("tokens"))


# the merge and the look-up within a batch of a relation


def neighbours(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indices of the occurrences that the next one follows without a gap."""
    return np.flatnonzero((doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1))


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document within the batch, place, id) of each occurrence."""
    places = batch.column("places")
    doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))
    return doc, places.flatten().to_numpy(zero_copy_only=False), batch.column("ids").flatten().to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches with some BATCH elements at most, or one row."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
            yield b.slice(at, upto - at)
            at = upto


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, f) of the pairs of neighbours in each batch."""
    for part in slices(batches, "places"):
        doc, place, ids = flat(part)
        i = neighbours(doc, place)
        if len(i):
            known, inverse = np.unique(ids, return_inverse=True)
            keys, f = np.unique(inverse[i] * len(known) + inverse[i + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known[keys // len(known)]), pa.array(known[keys % len(known)]), pa.array(f.astype(np.int64))], ["a", "b", "f"])


def relation(row: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row for each document that has occurrences left."""
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int32), ids.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(row[doc[starts]]), *lists], ["row", "places", "ids"])


RELATION = "row long, places array<int>, ids array<long>"


def keep_pairs(groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a relation to the next one, by the frequent pairs (a, b, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, name = groups.value
        known = np.unique(np.append(a, b))
        keys = np.searchsorted(known, a) * len(known) + np.searchsorted(known, b)
        order = np.argsort(keys)
        keys, name = keys[order], name[order]
        for part in slices(batches, "places"):
            doc, place, ids = flat(part)
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            ok = known[at] == ids
            i = neighbours(doc, place)
            i = i[ok[i] & ok[i + 1]]
            pair = at[i] * len(known) + at[i + 1]
            to = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = keys[to] == pair
            i, to = i[hit], to[hit]
            yield relation(part.column("row").to_numpy(), doc[i], place[i], name[to])

    return run


def spread_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, place, a, b) of all pairs of neighbours, for a join by shuffle."""
    for part in slices(batches, "places"):
        doc, place, ids = flat(part)
        i = neighbours(doc, place)
        yield pa.RecordBatch.from_arrays([pa.array(part.column("row").to_numpy()[doc[i]]), pa.array(place[i]), pa.array(ids[i]), pa.array(ids[i + 1])], ["row", "place", "a", "b"])


def keep_words(groups: tuple[pa.Array, list[str], np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From tokens to the relation of frequent words: their number in the vocabulary, then (language, word) to an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, langs, keys, name = groups.value
        langs = pa.array(langs, pa.string())
        for part in slices(batches, "tokens"):
            length = pc.list_value_length(part.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), length)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
            word = pc.fill_null(pc.index_in(part.column("tokens").flatten().cast(pa.string()), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            lang = pc.fill_null(pc.index_in(part.column("lang").cast(pa.string()), value_set=langs), -1).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            pair = lang * len(vocabulary) + word
            to = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = (word >= 0) & (lang >= 0) & (keys[to] == pair)
            yield relation(part.column("row").to_numpy(), doc[hit], place[hit], name[to[hit]])

    return run


def regroup(places: DataFrame) -> DataFrame:
    """A relation of (row, place, id)."""
    rows = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x"))
    return rows.select("row", F.col("x.place").cast("array<int>").alias("places"), F.col("x.id").alias("ids"))


# the levels


def word_groups(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""
    each = texts(docs).select("lang", F.explode("tokens").alias("phrase")).where((F.col("phrase") != "") & (F.col("phrase") != END))
    return each.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f"))


def word_places(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``R_1``: the places of the frequent words (id, lang, phrase) in the documents."""
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "lang", "tokens")
    named = words.select("lang", "phrase", "id")
    if size_of(named) > BROADCAST:
        each = rows.select("row", "lang", F.posexplode("tokens").alias("place", "phrase"))
        return regroup(each.join(named, ["lang", "phrase"]))
    found = named.toArrow()
    vocabulary = pc.unique(found["phrase"].combine_chunks())
    langs = sorted(set(found["lang"].to_pylist()))
    keys = pc.index_in(found["lang"], value_set=pa.array(langs, pa.string())).to_numpy().astype(np.int64) * len(vocabulary) + pc.index_in(found["phrase"], value_set=vocabulary).to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, langs, keys[order], found["id"].to_numpy()[order]))
    return rows.mapInArrow(keep_words(shared), RELATION)


def next_places(places: DataFrame, groups: DataFrame) -> DataFrame:
    """``R_k+1`` from ``R_k`` and the frequent pairs (a, b, id)."""
    named = groups.select("a", "b", "id")
    if size_of(named) > BROADCAST:
        pairs = places.mapInArrow(spread_pairs, "row long, place int, a long, b long")
        return regroup(pairs.join(named, ["a", "b"]))
    found = named.toPandas()
    shared = places.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy(np.int64) for c in ("a", "b", "id")))
    return places.mapInArrow(keep_pairs(shared), RELATION)


def mine(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([(id, lang, phrase, f, a, b) of the frequent phrases of each length], (lang, n) of all words)."""
    named = lambda df: df.withColumn("id", F.monotonically_increasing_id())
    words = scratch.keep(word_groups(docs), "words")
    n = scratch.keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "n")
    none = F.lit(None).cast("long")
    levels = [scratch.keep(named(words.where(F.col("f") >= least)).select("id", "lang", "phrase", "f", none.alias("a"), none.alias("b")), "groups")]
    scratch.drop(words)
    places = None
    while len(levels) < longest and not levels[-1].isEmpty():
        before = places
        places = scratch.keep(word_places(docs, levels[0]) if before is None else next_places(before, levels[-1]), "places")
        if before is not None:
            scratch.drop(before)
        pairs = places.mapInArrow(count_pairs, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        pairs = scratch.keep(named(pairs), "pairs")
        first = levels[-1].select(F.col("id").alias("a"), "lang", "phrase")
        last = levels[-1].select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("_last"))
        levels.append(scratch.keep(pairs.join(first, "a").join(last, "b").select("id", "lang", F.concat_ws(" ", "phrase", "_last").alias("phrase"), "f", "a", "b"), "groups"))
    if places is not None:
        scratch.drop(places)
    return levels, n


def uncovered(level: DataFrame, longer: DataFrame, within: int) -> DataFrame:
    """The phrases that no phrase one word longer covers; what a still longer one covers, one of these does too, as counts only fall."""
    parts = longer.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
    return level.join(parts, "id", "left").where(F.col("_f").isNull() | (100 * F.col("_f") < within * F.col("f"))).drop("_f")


def cuts(candidates: DataFrame, counts: DataFrame, n: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each candidate by its lowest-scoring cut, the first of equal ones."""
    words = F.split("phrase", " ")
    each = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("_w")).select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    each = each.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, F.size("_w") - F.col("k")).alias("_r"))
    side = lambda key, out: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(out))
    each = each.join(side("_l", "l"), ["lang", "_l"]).join(side("_r", "r"), ["lang", "_r"]).join(n, "lang")
    big = lambda c: f"cast({c} as decimal(38, 0))"
    each = each.withColumn("score", F.expr(f"(cast(1000 as decimal(38, 0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})"))
    return each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def collocations(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    levels, n = mine(docs, scratch, least, longest)
    counts = levels[0].select("lang", "phrase", "f")
    for level in levels[1:]:
        counts = counts.union(level.select("lang", "phrase", "f"))
    stay = [uncovered(level, levels[i + 2], within) if i + 2 < len(levels) else level for i, level in enumerate(levels[1:])]
    if not stay:
        stay = [levels[0].limit(0)]
    candidates = stay[0].select("lang", "phrase", "f")
    for s in stay[1:]:
        candidates = candidates.union(s.select("lang", "phrase", "f"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then the first of those: no task gets a whole language
    parts = Window.partitionBy("lang", "_salt").orderBy(*order)
    found = cuts(candidates, counts, n).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
