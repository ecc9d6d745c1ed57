"""Incremental jobs: a folder queue of scripts, chunk dedup within a watermark, run progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skald.operators import planning as P, script as S


def plan_scripts(scripts: DataFrame) -> DataFrame:
    """Chunks of scripts with their content keys."""
    c = S.process(scripts)
    return c.withColumn("key", P.chunk_key(F.col("text"), F.col("emotion"), F.array_join("effects", ","), F.col("target_wpm")))


def script_folder(spark: SparkSession, folder: str, target_wpm: int = 150) -> DataFrame:
    """A stream of the scripts that arrive in a folder."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    return files.select(F.xxhash64(F.input_file_name()).alias("script_id"), F.col("value").alias("script_text"), F.lit(target_wpm).alias("target_wpm"), F.lit(45).alias("words_per_chunk"))


#: Digits of a key that name its part of the plan table, after a letter: 16 ** PREFIX folders.
PREFIX = 2


def stream_scripts(scripts: DataFrame, plan: str, checkpoint: str) -> StreamingQuery:
    """Plans every new script of a stream and appends the chunks whose keys the plan table doesn't hold; ends when all at hand is done.

    The table is partitioned by the first digits of the keys, and a batch reads only the parts that its own keys are in: its
    cost depends on the batch. The first batch is written as it is planned; the chunks of later ones are staged beside the table
    first, so that they are planned once. A batch that is repeated finds its keys there and adds nothing. Chunks are dealt by key
    ahead of their parts, as the dedup drops the copies of a frequent one before they are moved.
    """
    spark = scripts.sparkSession

    def write(chunks: DataFrame, number: int) -> None:
        chunks.withColumn("batch", F.lit(number)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(plan)

    def add(batch: DataFrame, number: int) -> None:
        chunks = plan_scripts(batch).dropDuplicates(["key"]).withColumn("prefix", F.concat(F.lit("k"), F.substring("key", 1, PREFIX)))
        try:
            known = spark.read.parquet(plan)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return write(chunks, number)
        stage = f"{plan.rstrip('/')}_staged/batch={number}"
        chunks.write.mode("overwrite").parquet(stage)
        staged = spark.read.schema(chunks.schema).parquet(stage)
        touched = [r[0] for r in staged.select("prefix").distinct().collect()]  # 16 ** PREFIX at most
        fresh = staged.join(known.where(F.col("prefix").isin(touched)).select("key"), "key", "left_anti")
        write(fresh, number)

    return scripts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_chunks(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of a key within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def run_progress(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, run_id, n, last): the latest state of each run in each window; late rows are dropped by the watermark."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "run_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "chunk_id", "status")).alias("last"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the rows at hand, as Parquet in a shared folder, read back with its ``batch``; a batch that is repeated replaces itself."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")  # a stream without rows has no batches
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


def latest(states: DataFrame, *keys: str) -> DataFrame:
    """Of rows that update mode gave, the last of each key: also of windows that the watermark hasn't closed."""
    rest = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
