"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skald.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the pointers, and contracts the edges to the roots
    so found; loops and parallel edges vanish, so later rounds are small. Hooking is a min aggregate with map-side
    combine: a node with very many edges costs no more than its edges. Nulls and loops in ``edges`` are left out; an
    empty table gives an empty result.
    """
    spark = scratch.spark
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = scratch.keep(edges, "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))))
        first = scratch.keep(both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")), "hook")
        # a root's root, twice: chains of hooks shorten
        up = first.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        once = first.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
        hook = scratch.keep(once.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "hook")
        scratch.drop(first)
        maps.append(hook)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        short = live.join(to("a"), "a").join(to("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct()
        after = scratch.keep(short, "edges")
        scratch.drop(live)
        live = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not maps:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
    # a node that is no root leaves the edges, and a root goes on: follow the maps from the last back to the first
    out = maps[-1]
    for m in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        out = scratch.keep(m.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "map")
    return out
