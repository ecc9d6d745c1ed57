"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and its decisions take effect.
``run`` writes every stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skald.llm import decontam, langid, linededup, packing, simhash
from skald.llm.common import SPACE, Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being that of the text now."""
    return df.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of the labelled ones recognises; texts without a letter or a clear language go."""
    return _documents(langid.reject(docs, langid.learn(langid.learning_rows(docs))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near copies of an earlier line; a document of which nothing is left goes."""
    found = linededup.dedup(docs, Scratch(spark, "lines"))
    return _documents(found.where(F.col("removed_lines").isNull() | (F.ltrim("text", F.lit(SPACE)) != "")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, nulls last, and then the least text digest.

    Texts that aren't near copies all stay, whether their ids are null or shared.
    """
    scratch = Scratch(spark, "simhash")
    rows = simhash.near_duplicates(docs, scratch, digest=True)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first"))
    stay = first.select(F.struct("first.doc_id", "first.digest").alias("_row"))
    # equal rows share id and digest: one of them is left
    marked = docs.withColumn("_row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest")))
    return _documents(marked.join(stay, "_row", "left_semi").dropDuplicates(["_row"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontam"), carry=("text", "lang", "source"))
    return _documents(found.where("not contaminated").withColumn("n_chars", F.lit(0)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    return packing.pack(docs, Scratch(spark, "packing"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Language ID, MinHash and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
