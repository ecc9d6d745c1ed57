"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` words (an item of fewer words is one window). A window is the set of its
positioned word shingles. The shingles of a benchmark are ordered by rarity over the documents; for full containment
the necessary prefix of a window is its rarest shingle. Document shingles meet the prefixes in one equi-join; bounds
on position and length discard candidates that would stick out of the text; survivors are verified exactly, by the
shingles at the start and the end of the window, which together spell it.

The documents are exploded once and joined with the benchmark's shingles before anything is shuffled. That side is
broadcast only while it has at most ``BROADCAST`` bytes, and shuffled beyond.

Null and blank texts have no words, and items without words no windows. Results are by (doc_id, text): repeated rows,
null ids and ids with several texts each get the result of their own text. An item without an id hits words, but is
listed nowhere. Empty tables give clean documents or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skald.llm.common import Scratch, ascii_lower, let, size_of, words

SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WINDOW = 10
SHINGLE = 5
#: Bytes of shingles that are broadcast at most.
BROADCAST = 64 << 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def _gram(w: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(w, at + 1, n), " ")


def _grams(w: Column, k: int) -> Column:
    """(at, gram): the shingles of ``k`` words."""
    none = F.array().cast("array<struct<at:int,gram:string>>")
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("at"), _gram(w, i, k).alias("gram")))).otherwise(none)


def windows(items: DataFrame) -> DataFrame:
    """Distinct (win, n, k): the window's text, its words, and the words of its shingles; with item_ids, those it is from."""
    w = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(WINDOW), F.size("w"))
    cut = w.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(_gram(F.col("w"), i, n).alias("win")))).alias("x"))
    return cut.select("item_id", F.col("x.win").alias("win"), "n", F.least(F.lit(SHINGLE), "n").alias("k")).distinct()


def shingles(wins: DataFrame) -> DataFrame:
    """(win, n, k, gram, at): the shingles of each window by their offset."""
    each = lambda w: F.transform(F.sequence(F.lit(0), F.col("n") - F.col("k")), lambda i: F.struct(_gram(w, i, F.col("k")).alias("gram"), i.alias("at")))
    return wins.select("win", "n", "k").distinct().select("win", "n", "k", F.inline(let(F.split("win", " "), each)))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if size_of(df) <= BROADCAST else df


def occurrences(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, start, n, win): every occurrence of a window, as words [start, start + n) of the document."""
    wins = scratch.keep(shingles(windows(items)), "windows")
    known = wins.select("gram", "k").distinct()
    sizes = known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # at most SHINGLE rows
    if not sizes:
        return docs.limit(0).select("doc_id", F.xxhash64("text").alias("digest"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("win"))

    def grams(w: Column) -> Column:
        parts = [_grams(w, k) for k in sorted(r["k"] for r in sizes)]
        return F.struct(F.size(w).alias("n"), (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("g"))

    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("digest"), let(item_words(text), grams).alias("q"))
    found = found.select("doc_id", "digest", F.col("q.n").alias("n_words"), F.inline("q.g"))
    # repeated rows are one text here
    hits = scratch.keep(found.join(_sized(known.select("gram")), "gram").distinct(), "shingles")
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # the rarest shingle of a window is its prefix; a window with a shingle that no document has is nowhere
    ranked = wins.join(often, "gram", "left").groupBy("win", "n", "k").agg(
        F.count_if(F.col("often").isNull()).alias("absent"), F.min(F.struct("often", "gram", "at")).alias("p")
    )
    prefix = scratch.keep(ranked.where("absent = 0").select("win", "n", "k", F.col("p.gram").alias("gram"), F.col("p.at").alias("off")), "prefix")
    candidates = hits.join(_sized(prefix), "gram").withColumn("start", F.col("at") - F.col("off"))
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).select("doc_id", "digest", "start", "n", "k", "win")
    for at in (F.lit(0), F.col("n") - F.col("k")):  # the shingles at both ends spell the window
        end = candidates.withColumns({"at": F.col("start") + at, "gram": _gram(F.split("win", " "), at, F.col("k"))})
        b = hits.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_h"), F.col("at").alias("_at"), F.col("gram").alias("_gram"))
        on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_h")) & (F.col("at") == F.col("_at")) & (F.col("gram") == F.col("_gram"))
        candidates = end.join(b, on, "left_semi").drop("at", "gram")
    return candidates.drop("k")


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: doc_id, the carried columns, n_words, n_hit, item_ids (sorted as strings), contaminated."""
    found = scratch.keep(occurrences(docs, items, scratch), "occurrences")
    span = found.select("doc_id", "digest", "start", (F.col("start") + F.col("n")).alias("end")).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    step = lambda acc, x: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["to"]))).alias("hit"), F.greatest(acc["to"], x["end"]).alias("to")
    )
    hit = span.select("doc_id", "digest", F.aggregate("s", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")), step)["hit"].alias("n_hit"))
    source = windows(items).select("win", F.col("item_id").cast("string").alias("item_id")).where("item_id is not null")
    which = found.select("doc_id", "digest", "win").distinct().join(source, "win").groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = hit.join(which, hit.doc_id.eqNullSafe(which.doc_id) & (hit.digest == which.digest), "left").select(hit.doc_id.alias("_d"), hit.digest.alias("_h"), "n_hit", "item_ids")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *carry, F.xxhash64(text).alias("_digest"), F.size(item_words(text)).cast("long").alias("n_words"))
    joined = rows.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_digest") == F.col("_h")), "left")
    return joined.select(
        "doc_id", *carry, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
