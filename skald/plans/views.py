"""The tables that queries read: driver tables and views that decorate their rows, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCRIPT = """
select doc_id as script_id, source as name, lang, text as script_text,
 case when doc_id % 3 = 0 then 'HORROR' when doc_id % 3 = 1 then 'DOCUMENTARY' else 'unknown' end as preset,
 cast(130 + doc_id % 40 as int) as target_wpm, 45 as words_per_chunk from {documents}
"""
TAGGED = """
select doc_id as script_id, concat('[SCENE: S', cast(doc_id % 7 as varchar(20)), ']', chr(10), chr(10), 'It began quietly. ',
 case when doc_id % 4 = 0 then '[EMOTION:FEAR]' when doc_id % 4 = 1 then '[WHISPER]' when doc_id % 4 = 2 then '[EMPHASIS]' else '[BOGUS]' end,
 text, case when doc_id % 4 = 1 then '[/WHISPER]' when doc_id % 4 = 2 then '[/EMPHASIS]' else '' end,
 ' [PAUSE:', cast(doc_id % 12 as varchar(20)), '] ', chr(10), chr(10), '# Part two', chr(10), chr(10),
 case when doc_id % 5 = 0 then 'But everything changed that night! ' when doc_id % 5 = 1 then 'Maria whispered the secret. '
      when doc_id % 5 = 2 then '"Why now?" John asked. ' else 'Dr. Smith smiled. ' end, 'In the end, peace returned.') as script_text from {documents}
"""
NUMERIC = """
select o_orderkey as script_id, concat('Order ', cast(o_orderkey as varchar(20)), ' of ',
 case month(o_orderdate) when 1 then 'January' when 2 then 'Feb.' when 3 then 'March' when 4 then 'April' when 5 then 'May' when 6 then 'June' when 7 then 'July'
 when 8 then 'Aug' when 9 then 'September' when 10 then 'Oct' when 11 then 'November' else 'December' end, ' ',
 cast(day(o_orderdate) as varchar(20)), ', ', cast(year(o_orderdate) as varchar(20)), ' cost $', cast(cast(floor(o_totalprice) as bigint) as varchar(20)), '.',
 lpad(cast(o_orderkey % 100 as varchar(20)), 2, '0'), ' less ', cast(o_orderkey % 40 as varchar(20)), '% at ', cast(o_orderkey % 12 + 1 as varchar(20)), ':',
 lpad(cast(o_orderkey % 60 as varchar(20)), 2, '0'), ' after ', cast(o_orderkey % 90 as varchar(20)), ' km. Dr. Harris paid in Nevada.') as script_text from {orders}
"""
SYNTH = """
select event_id as chunk_id, user_id as run_id, case when event_id % 2 = 0 then 'edge' else 'gemini' end as engine,
 concat('voice', cast(user_id % 5 as varchar(20))) as voice_id, cast(1 + event_id % 45 as int) as word_count, value as duration_seconds,
 case when event_type = 'error' then 'failed' else 'done' end as status, ts, cast(event_id % 3 as double) / 4 as pause_before, cast(event_id % 5 as double) / 8 as pause_after from {events}
"""
HISTORY = "select o_orderkey as id, o_custkey as project_id, o_totalprice as duration_seconds, o_orderdate as created_at from {orders}"
CLIP_SPARK = "select vec_id as clip_id, label, pos, cast(amp as double) as amp from {embeddings} lateral view posexplode(embedding) t as pos, amp"
CLIP_DUCK = "select vec_id as clip_id, label, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, cast(unnest(embedding) as double) as amp from embeddings"

VIEWS = {"v_script": SCRIPT, "v_tagged": TAGGED, "v_numeric": NUMERIC, "v_synth": SYNTH, "v_history": HISTORY, "v_clip": CLIP_SPARK}
TABLES = ("documents", "orders", "events", "embeddings", "pages", "conversations", "lineitem", "customer", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read in fewer parts than there are: texts cost far more to work on than to move.

    A table of many files or row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if name in ("v_script", "v_tagged", "v_numeric"):
        used = {t: wide(df) for t, df in used.items()}
    return spark.sql(sql, **used)


def duck(*names: str) -> str:
    """The views as a WITH list for DuckDB."""
    parts = [f"{n} as ({CLIP_DUCK if n == 'v_clip' else VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return ", ".join(parts)
