"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, and a proof for every row.

Rows become leaves (SHA-256 over length-prefixed fields). The leaves of a source ascend by doc_id, and each run of
``FAN`` nodes is hashed to a node of the next level until one is left; the roots of the sources, in their order, are
reduced in the same way. Numbers in a source come from a range partitioning and the counts of its parts, so a source
of any size is spread over all tasks. ``FAN ** DEPTH`` leaves in a row are a superblock. What lies above superblocks
is reduced level by level, and each superblock is sent the runs on its way to the root. The leaves of a superblock and
these outer nodes are then cogrouped: one task finishes the local levels, joins the proofs and folds each row's leaf
with them. No task holds more than a superblock and its way up.

Nulls are fields ``-``; a null source is a source, the first. Rows without a doc_id come first in their source and
aren't tampered with; rows that share one stand in the order of their leaves. Equal rows are leaves of their own. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skald.llm.common import Scratch

FAN = 16
#: Levels of a superblock.
DEPTH = 2
SIZE = FAN**DEPTH
#: Digits of a digest.
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_FOLD = 5


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**instead: Column) -> Column:
    """Digest of a row, with other values in place of some of its fields."""
    return F.sha2(F.concat(*(field(instead.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(row, key, doc_id, leaf, tampered): keys sort as sources do, null first; ``tampered`` is the leaf after tampering."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_FOLD == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = docs.select(*FIELDS).select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"), leaf().alias("leaf"), F.when(hit, leaf(text=lower)).alias("tampered"))
    return made.select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("tampered"))


def numbered(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``df`` with part and at, sorted over all its partitions, and (group, part, shift, n): ``at + shift`` numbers a group's n rows from 0."""
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = scratch.keep(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
    counts = stored.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(group).orderBy("part")
    shifts = counts.select(group, "part", (F.sum("m").over(before) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy(group)).alias("n"))
    return stored, shifts


def run_of(place: str) -> Column:
    return F.floor(F.col(place) / FAN).cast("long")


def joined(place: str, node: str) -> Column:
    """The digests of a group in their order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, node))), lambda x: x[node]), "")


def ways(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, pos, way, top) of ``nodes`` (tree, pos, n, node): the runs on the way to the tree's top, lowest first.

    A run is (nodes, at): its digests and the place of the node that the way comes from. Trees shrink together, level by
    level, to a sixteenth each time; the number of levels is all that the driver learns.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("tree", F.col("node").alias("top"))
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", run_of("pos").alias("run"), "n").agg(joined("pos", "node").alias("nodes"))
        levels.append(scratch.keep(runs, "level"))
        most = -(-most // FAN)
        nodes = levels[-1].select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2("nodes", 256).alias("node"))
        tops = tops.union(nodes.where("n = 1").select("tree", F.col("node").alias("top")))
    step = "array<struct<nodes:string,at:int>>"
    down = None
    for runs in reversed(levels):
        up = runs.withColumn("way", F.array().cast(step)) if down is None else runs.join(down.withColumnsRenamed({"pos": "run", "way": "_way"}), ["tree", "run"], "left").withColumn("way", F.coalesce("_way", F.array().cast(step)))
        each = up.select("tree", "run", "nodes", "way", F.explode(F.sequence(F.lit(0), (F.length("nodes") / DIGITS).cast("int") - 1)).alias("at"))
        down = each.select("tree", (F.col("run") * FAN + F.col("at")).alias("pos"), F.concat(F.array(F.struct("nodes", "at")), "way").alias("way"))
    if down is None:
        return tops.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast(step).alias("way"), "top")
    alone = tops.join(down.select("tree").distinct(), "tree", "left_anti").select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast(step).alias("way"))
    return down.union(alone).join(tops, "tree")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def put(nodes: str, at: int, node: str) -> str:
    return nodes[: at * DIGITS] + node + nodes[(at + 1) * DIGITS :]


def prove(mine: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The rows of one superblock: local levels, proofs and folded roots."""
    mine = mine.sort_values("local")
    levels, nodes = [], mine["leaf"].tolist()
    size = int(mine["n"].iloc[0])
    for _ in range(DEPTH):
        if size > 1:
            levels.append(["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
            nodes = [digest(r) for r in levels[-1]]
            size = -(-size // FAN)
    outer = outer.sort_values("level")
    subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
    above = [(r.nodes, int(r.at)) for r in outer.itertuples() if r.nodes is not None]
    rest = "".join(put(nodes, at, "") for nodes, at in above)
    proofs, folds = [], []
    for i, node in enumerate(mine["tampered"]):
        way = [(runs[i // FAN ** (k + 1)], i // FAN**k % FAN) for k, runs in enumerate(levels)]
        proofs.append(digest("".join(put(nodes, at, "") for nodes, at in way) + rest))
        for nodes, at in way + above:
            node = digest(put(nodes, at, node))
        folds.append(node)
    return pd.DataFrame({"doc_id": mine["doc_id"], "leaf": mine["leaf"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folds})


def manifest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    made = scratch.keep(leaves(docs), "leaves")
    stored, shifts = numbered(made, "key", ["doc_id", "leaf", "row"], scratch)
    shifts = scratch.keep(shifts, "shifts")
    keys, steps = numbered(shifts.select(F.lit(0).alias("all"), "key").distinct(), "all", ["key"], scratch)
    trees = keys.join(steps.withColumnRenamed("n", "n_trees"), ["all", "part"]).select("key", (F.col("at") + F.col("shift")).alias("tree"), "n_trees")
    places = shifts.join(trees, "key").select("key", "part", "shift", "n", "tree", "n_trees")
    at = F.col("at") + F.col("shift")
    rows = stored.join(places, ["key", "part"]).select("tree", "n_trees", "n", F.floor(at / SIZE).cast("long").alias("block"), (at % SIZE).cast("int").alias("local"), F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered")
    rows = scratch.keep(rows, "rows")
    scratch.drop(made, stored)

    blocks = rows.groupBy("tree", "n_trees", "n", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "leaf"))), lambda x: x["leaf"]).alias("nodes"))
    for k in range(DEPTH):
        above = F.transform(F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice("nodes", i * FAN + 1, F.lit(FAN)), ""), 256))
        blocks = blocks.withColumn("nodes", F.when(F.col("n") > FAN**k, above).otherwise(F.col("nodes")))
    blocks = scratch.keep(blocks.select("tree", "n_trees", F.col("block").alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"), F.get("nodes", F.lit(0)).alias("node")), "blocks")
    inner = scratch.keep(ways(blocks, scratch), "ways")

    subroots = inner.where("pos = 0").join(blocks.where("pos = 0").select("tree", "n_trees"), "tree")
    whole = ways(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("n_trees").alias("n"), F.col("top").alias("node")), scratch)
    last = whole.select(F.col("pos").alias("tree"), F.col("way").alias("last"), F.col("top").alias("root"))
    outer = inner.join(last, "tree").select("tree", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", F.posexplode_outer(F.concat("way", "last")).alias("level", "run"))
    outer = outer.select("tree", "block", "subroot", "root", "level", "run.nodes", "run.at")

    mine = rows.select("tree", "block", "n", "local", "doc_id", "leaf", "tampered")
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = mine.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(prove, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
