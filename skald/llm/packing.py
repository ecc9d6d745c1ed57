"""Packing into fixed-length sequences by cutting-stock column generation.

Documents are tokenised in Arrow batches and cut at multiples of the sequence length; what leaves that step is a row
for each piece. The histogram of piece lengths, rounded up to ``WIDTH`` tokens, is all that the driver sees: at most
CAPACITY / WIDTH numbers whatever the corpus. A linear program over patterns of lengths is solved by column
generation, a knapsack by dynamic programming pricing the columns; the solution is rounded down and the remainder
packed by first fit decreasing, which gives more patterns. Pieces are ranked within their length class, by salted
windows so that no class meets in one task, and a rank is a slot of a pattern's copy.

Null texts are empty: their one id is the end id. Equal rows are packed as many times as they come; null doc_ids are
packed like others. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skald.llm.common import Scratch

CAPACITY = 2048
WIDTH = 8
END_ID = 1
#: Salts of the ranks within a class, at least.
SALTS = 64
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(vocabulary: str | None = None):
    """The byte-level BPE of a rank file: the same ids as the tokenizers library gives for the vocabulary's JSON file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) and, if wanted, ids: the pieces of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_to_numpy
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(encode(text or "", allowed_special="all"), END_ID).astype("<u4")
                for at in range(0, len(ids), CAPACITY):
                    part = ids[at : at + CAPACITY]
                    row = (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids))
                    out.append((*row, part.astype(np.int64)) if keep_ids else row)
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best multiset of items that fits, by dynamic programming over the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.flatnonzero(size <= c)
        if len(fit):
            got = value[fit] + best[c - size[fit]]
            i = int(np.argmax(got))
            if got[i] > best[c - 1] + 1e-12:
                best[c], pick[c] = got[i], fit[i]
                continue
        best[c] = best[c - 1]
    used, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if pick[c] >= 0:
            used[pick[c]] += 1
            c -= int(size[pick[c]])
        else:
            c -= 1
    return float(best[room]), used


def solve(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut: covers the demand exactly or more, no pattern over the room."""
    m = len(size)
    basis = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / (room // size))
    x = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # each pattern costs one sequence
        worth, column = knapsack(np.maximum(price, 0), size, room)
        if worth <= 1 + 1e-3:  # within a thousandth of the best
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64).copy()
    found: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x, kind="stable"):
        column = np.round(basis[:, j]).astype(np.int64)
        n = int(min([int(x[j] + 1e-9), *(left[i] // column[i] for i in np.flatnonzero(column))]))
        if n > 0:
            found.append((column, n))
            left -= n * column
    # first fit decreasing of the remainder, all copies of a bin at a time
    order = np.argsort(-size, kind="stable")
    while left.any():
        column, free = np.zeros(m, np.int64), room
        for i in order:
            k = min(int(left[i]), free // int(size[i]))
            column[i] = k
            free -= k * int(size[i])
        n = int(min(left[i] // column[i] for i in np.flatnonzero(column)))
        found.append((column, n))
        left -= n * column
    return found


def slots(histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(class, first, last, copies' share, first sequence): the ranks of a class that a pattern takes."""
    classes = sorted(histogram)
    if not classes:
        return []
    plan = solve(np.array(classes), np.array([histogram[c] for c in classes], float), CAPACITY // WIDTH)
    taken, rows, sequence = dict.fromkeys(classes, 0), [], 0
    for column, n in plan:
        for c, a in zip(classes, column.tolist(), strict=True):
            if a:
                rows.append((c, taken[c], taken[c] + a * n, a, sequence))
                taken[c] += a * n
        sequence += n
    return rows


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    spark = scratch.spark
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = pieces(docs, vocabulary, keep_ids).withColumns({"_class": F.ceil(F.col("length") / WIDTH).cast("int"), "_salt": F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")})
    cut = scratch.keep(cut, "pieces")
    sizes = scratch.keep(cut.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("n")), "sizes")
    histogram = {r["_class"]: r["n"] for r in sizes.groupBy("_class").agg(F.sum("n").alias("n")).collect()}  # CAPACITY / WIDTH rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_class", "_salt", before.alias("_before"))
    plan = spark.createDataFrame(slots(histogram), "_class int, _first long, _last long, _share long, _sequence long")
    rank = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start")) - 1
    # offsets: classes x salts rows; plan: the patterns' parts
    ranked = cut.withColumn("_in", rank).join(F.broadcast(offsets), ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("_class", "_c")), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    sequence = F.col("_sequence") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_share"))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("sequence_id", sequence.cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return out.select("doc_id", "start", "length", *["ids"] * keep_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset")
