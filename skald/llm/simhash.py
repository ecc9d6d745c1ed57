"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made in Arrow batches; only (row, fingerprint) leaves that step. Of each distinct fingerprint the
distances to ``PIVOTS`` reference fingerprints are computed once and stored. A pair within the limit has coordinates
that differ by no more (triangle inequality), and shares two of four 16-bit blocks. Pairs are joined by their blocks and
by the quantised coordinates of the first ``CELLS`` pivots, the one side also into the neighbouring cell where its
coordinate is within the limit of it; a pair that meets goes if any other coordinate differs by more than the limit,
and survivors are verified by their distance. Blocks shared by many fingerprints are split into sub-blocks and finally
into masked keys whose members are linked to one star centre, so that no group is expanded into its pairs and no link is
lost.

Null and blank texts have fingerprint zero, which links like any other. Null doc_ids take part but never name a
component, unless all its members are null. Repeated rows each give a row. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skald.llm.common import Scratch
from skald.llm.components import components

LIMIT = 2
SHINGLE = 3
SEED = 42
PIVOTS = 16
#: Pivots whose quantised coordinates are part of the join key, and the width of a cell.
CELLS = 2
WIDTH = 6
#: Groups up to this size are compared pairwise: at most so many comparisons a member.
PAIRWISE = 128
#: Shingles hashed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    n = max(1, len(raw) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = raw[at : at + CHUNK + SHINGLE - 1]
        grams = zip(part, part[1:], part[2:]) if len(raw) >= SHINGLE else [part]
        h = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, fp long) for each row, and the text's digest if asked for; the bits of the unsigned fingerprint in a signed long."""
    more = ["digest"] if digest else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp, **{c: b[c] for c in more}})

    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.xxhash64("text").alias(c) for c in more)]
    return docs.select(*cols).mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: random words, fixed by the seed."""
    return np.random.default_rng(SEED).integers(-(2**63), 2**63 - 1, n).tolist()


def distance_table(fps: DataFrame) -> DataFrame:
    """``fps`` with p0.., the Hamming distances to the pivots."""
    return fps.select("*", *(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots())))


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def _cut(free: list[int]) -> list[tuple[int, list[int]]]:
    """(mask, bits left free) for each two of the four blocks into which the free bits are cut."""
    w = len(free) // 4
    blocks = [free[i : i + w] for i in range(0, len(free), w)]
    return [(sum(1 << b for c in two for b in blocks[c]), [b for c in range(4) if c not in two for b in blocks[c]]) for two in combinations(range(4), 2)]


def _masks() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Masks of the blocks (k1), of the sub-blocks (k1, k2) and of all but two of the bits then free (k1, k2, m); 6, 36 and 4,320 rows."""
    first, second, third = [], [], []
    for k1, (m1, free1) in enumerate(_cut(list(range(64)))):
        first.append((k1, _signed(m1)))
        for k2, (m2, free2) in enumerate(_cut(free1)):
            second.append((k1, k2, _signed(m2)))
            third += [(k1, k2, _signed(~((1 << x) | (1 << y)) & (2**64 - 1))) for x, y in combinations(free2, 2)]
    return first, second, third


def _split(groups: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that are compared pairwise, and those of larger groups; groups of one are left out."""
    sizes = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    big = sizes.where(F.col("_n") > PAIRWISE).drop("_n")
    small = sizes.where(F.col("_n") <= PAIRWISE).drop("_n")
    return groups.join(small, key, "left_semi"), groups.join(big, key, "left_semi")


def candidates(groups: DataFrame, table: DataFrame, key: list[str], use: int = PIVOTS) -> DataFrame:
    """(a, b), a < b, of groups of bounded size whose coordinates for the first ``use`` pivots differ by LIMIT at most.

    ``table``: distance_table(). Each pair meets once: in the cells that its one side is in.
    """
    t = groups.join(table, "fp")
    cells = range(min(CELLS, use))
    own = [F.floor(F.col(f"p{i}") / WIDTH).alias(f"c{i}") for i in cells]
    left = t.select(*key, *own, F.col("fp").alias("a"), *(F.col(f"p{i}").alias(f"a{i}") for i in range(use)))
    right = t.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("fp").alias("b"), *(F.col(f"p{i}").alias(f"b{i}") for i in range(use)))
    for i in cells:
        at = F.col(f"b{i}")
        right = right.withColumn(f"_c{i}", F.explode(F.array_distinct(F.array(F.floor((at - LIMIT) / WIDTH), F.floor((at + LIMIT) / WIDTH)))))
    on = F.col("a") < F.col("b")
    for c in [*key, *(f"c{i}" for i in cells)]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    for i in range(use):
        on = on & (F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= LIMIT)
    return left.join(right, on).select("a", "b")


def verified(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT)


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that give the components of all links within LIMIT bits.

    ``fps``: distinct fp. Their pivot distances are stored first. Two fingerprints that differ in two bits share two of four blocks, whichever the bits.
    """
    first, second, third = _masks()
    stored = scratch.keep(distance_table(fps), "pivots")
    spark = scratch.spark
    table = lambda rows, names: F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)))
    key = lambda name: F.col("fp").bitwiseAND(F.col("mask")).alias(name)
    masks = F.array(*(F.struct(F.lit(k).cast("long").alias("k1"), F.lit(m).cast("long").alias("mask")) for k, m in first))
    groups = scratch.keep(stored.select("fp", F.inline(masks)).select("fp", "k1", key("v1")), "blocks")
    small, big = _split(groups, ["k1", "v1"])
    edges = verified(candidates(small, stored, ["k1", "v1"]))
    big = scratch.keep(big, "large")
    if big.isEmpty():
        return edges
    # the 32 bits that a large group leaves free, again in four blocks of which two are shared
    groups = scratch.keep(big.join(table(second, ["k1", "k2", "mask"]), "k1").select("fp", "k1", "v1", "k2", key("v2")), "blocks")
    small, big = _split(groups, ["k1", "v1", "k2", "v2"])
    edges = edges.union(verified(candidates(small, stored, ["k1", "v1", "k2", "v2"])))
    # 16 bits left: two members within the limit are equal but for some two of them
    keys = big.join(table(third, ["k1", "k2", "mask"]), ["k1", "k2"]).select("fp", "mask", key("v"))
    centre = keys.groupBy("mask", "v").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    return edges.union(keys.join(centre, ["mask", "v"]).select("a", F.col("fp").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, scratch: Scratch, digest: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id: the smallest doc_id reachable by links.

    With ``digest`` also that of the text and the component's root, which is never null.
    """
    more = ["digest", "root"] if digest else []
    rows = scratch.keep(fingerprints(docs, digest), "fingerprints")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    comp = components(links(distinct.select("fp"), scratch), scratch)
    named = distinct.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id", *more[1:])
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", *more)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
