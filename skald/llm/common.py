"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words in the word-based contracts.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, though ``body`` uses it many times.

    Catalyst may inline a projected array into a lambda that reads it, which would evaluate it for
    every element; binding it as a lambda variable rules that out.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


#: Removes a query's shuffle files at its end; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that is no longer read.

    A table's shuffle files go as soon as it is written: nothing reads them again. ``options``: the writer's.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.options: dict[str, str] = {}

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**self.options).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)


def size_of(df: DataFrame) -> int:
    """Bytes of the rows as text: what a side is measured by before it is broadcast."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ASCII texts take the built-in's fast path."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column, separators: str) -> Column:
    """The words of ``text`` between runs of ``separators``; null and blank texts have none."""
    run = "[" + "".join(f"\\x{ord(c):02X}" for c in separators) + "]+"
    empty = F.array().cast("array<string>")
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(separators))
    return let(trimmed, lambda t: F.when(t == "", empty).otherwise(F.split(t, run)))


#: Bits of a membership filter: a table of 2 MB, whatever it is made of.
FILTER_BITS = 24


def maybe(keys: DataFrame, name: str, scratch: Scratch) -> Callable[[Column], Column]:
    """A test that holds for all of ``keys``' hashes ``name`` and for few others, to be made before a join shuffles.

    The hashes' low bits are marked in one array of fixed size, a scalar subquery of the plan that uses it.
    """
    words = 1 << (FILTER_BITS - 6)
    word = lambda h: F.shiftright(h, 6).bitwiseAND(words - 1).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    h = F.col(name)
    marks = keys.groupBy(word(h).alias("word")).agg(F.bit_or(bit(h)).alias("bits"))
    every = scratch.spark.range(words).select(F.col("id").cast("int").alias("word")).join(marks, "word", "left")
    rows = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    table = scratch.keep(every.agg(rows.alias("rows")).select(F.col("rows.bits").alias("bits")), "filter").scalar()
    return lambda at: F.get(table, word(at)).bitwiseAND(bit(at)) != 0
