"""Queries of sources, sinks and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skald.plans.registry import query, workspace
from skald.plans.views import TAGGED, duck, table, view, wide
from skald.sources import files
from skald.streaming import jobs


@query("s2_s3_projects", "select source as name, count(*) n_chunks, cast(sum(length(text)) as bigint) chars, 'DOCUMENTARY' preset from documents group by source")
def s2(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("source").alias("name"), F.col("doc_id").cast("int").alias("chunk_id"), "text", F.lit("done").alias("status"))
    path = workspace(spark, "projects")
    files.write_projects(docs.select(F.col("source").alias("name"), F.lit("x").alias("unknown_key")).distinct(), chunks, path)
    back = files.scan_projects(spark, path, one_per_file=False)
    chars = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.length(c["text"]))
    return back.groupBy("name", F.col("settings.preset").alias("preset")).agg(F.sum(F.size("chunks")).alias("n_chunks"), F.sum(chars).alias("chars"))


@query("s6_append_generation", "with " + duck("v_history") + " select cast(created_at as date) created, count(*) * 2 n from v_history group by 1")
def s6(spark, d) -> DataFrame:
    h = view(spark, d, "v_history")
    path = workspace(spark, "generations")
    # a month is few files if its rows meet first
    monthly = h.repartition(F.date_format("created_at", "yyyy-MM"))
    for _ in range(2):
        files.append_generations(monthly, path)
    return spark.read.parquet(path).groupBy(F.to_date("created_at").alias("created")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_write_stems", "select case label % 4 when 0 then 'VOICE' when 1 then 'MUSIC' when 2 then 'SFX' else 'AMBIENCE' end track, count(*) n_blocks from embeddings where label % 4 <> 2 group by 1")
def s7(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    track = F.element_at(F.array(*map(F.lit, ("VOICE", "MUSIC", "SFX", "AMBIENCE"))), (F.col("label") % 4 + 1).cast("int"))
    samples = F.when(F.col("label") % 4 == 2, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    path = workspace(spark, "stems")
    files.write_stems(e.select(F.col("vec_id").alias("mix_id"), track.alias("track"), F.lit(0).alias("block_no"), samples.alias("samples")), path)
    return spark.read.parquet(path).groupBy("track").agg(F.count(F.lit(1)).alias("n_blocks"))


Q16 = "list_transform(embedding, lambda x: cast(floor(x::double * 32767) as int) / 32768.0::double)"


@query("s5_scan_clips", f"with q as (select vec_id, {Q16} x from embeddings where vec_id % 50 <> 0), b as (select vec_id, x, unnest(range(0, (len(x) + 15) // 16)) block_no from q) select 'clip' || vec_id || '.wav' clip, cast(block_no as bigint) block_no, cast(len(x[block_no * 16 + 1:block_no * 16 + 16]) as int) n, list_max(x[block_no * 16 + 1:block_no * 16 + 16]) top, false failed from b union all select 'clip' || vec_id || '.wav', 0, null, null, true from embeddings where vec_id % 50 = 0")
def s5(spark, d) -> DataFrame:
    """Clips written as WAV files, every third in two channels, every fiftieth broken, and read back by ranges of some frames."""
    e = table(spark, d, "embeddings").repartition(8)
    k, x = F.col("vec_id"), F.transform("embedding", lambda v: v.cast("double"))
    clips = e.select(F.concat(F.lit("clip"), k.cast("string"), F.lit(".wav")).alias("clip"), F.when(k % 3 == 0, F.array(x, x)).otherwise(F.array(x)).alias("channels"), (k % 50 == 0).alias("broken"))
    path = workspace(spark, "clips")
    files.write_clips(clips, path, 8000).agg(F.sum("n_bytes")).first()
    read = files.scan_clips(spark, path, 16, split=1 << 20)
    return read.select("clip", "block_no", F.size("samples").alias("n"), F.array_max("samples").cast("double").alias("top"), F.col("error").isNotNull().alias("failed")).withColumn("n", F.when(~F.col("failed"), F.col("n")))


@query("s1_scan_scripts", "select doc_id script_id, length(coalesce(text, '')) chars, md5(coalesce(text, '')) digest from documents")
def s1(spark, d) -> DataFrame:
    """Every document written as a text file of its own, and the folder read back."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("folder"), F.col("text").alias("script_text"))
    path = workspace(spark, "scripts")
    files.write_scripts(wide(docs), path)
    back = files.scan_scripts(spark, path)
    text = F.expr("substring(script_text, 1, length(script_text) - 1)")
    return back.select(F.nullif(F.regexp_extract("name", r"_(.*)\.txt$", 1), F.lit("")).cast("long").alias("script_id"), F.length(text).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


@query("x1_stream_scripts")
def x1(spark, d) -> DataFrame:
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    scripts = spark.sql(TAGGED, documents=docs).withColumns({"target_wpm": F.lit(150), "words_per_chunk": F.lit(45)})
    plan = workspace(spark, "plan")
    jobs.stream_scripts(scripts, plan, workspace(spark, "x1")).awaitTermination()
    return spark.read.parquet(plan).select("key", "words", "emotion", "est_seconds")


SYNTH = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("x2_stream_dedup_chunks", "select distinct user_id || '-' || event_type key from events")
def x2(spark, d) -> DataFrame:
    e = jobs.events_stream(spark, f"{d}/events.parquet*", SYNTH).select("ts", F.concat_ws("-", "user_id", "event_type").alias("key"), "event_id")
    return jobs.drain(jobs.dedup_chunks(e, "365 days"), workspace(spark, "x2_out"), workspace(spark, "x2")).select("key")


@query("x3_stream_progress", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, user_id run_id, count(*) n, max(row(ts, event_id, event_type))[2] chunk_id, max(row(ts, event_id, event_type))[3] status from events group by 1, 2")
def x3(spark, d) -> DataFrame:
    e = jobs.events_stream(spark, f"{d}/events.parquet*", SYNTH).select("ts", F.col("user_id").alias("run_id"), F.col("event_id").alias("chunk_id"), F.col("event_type").alias("status"))
    out = jobs.latest(jobs.drain(jobs.run_progress(e), workspace(spark, "x3_out"), workspace(spark, "x3"), mode="update"), "window", "run_id")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "run_id", "n", F.col("last.chunk_id").alias("chunk_id"), F.col("last.status").alias("status"))
