"""Queries of the planning, timeline and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skald import dimensions as D
from skald.operators import planning as P, script
from skald.plans.registry import query
from skald.plans.views import duck, table, view

S = "v_synth"


def synth(spark, d) -> DataFrame:
    return view(spark, d, S)


@query("s8_supported_audio", r"select part_path, lower(regexp_extract(part_path, '\.[^./]+$')) ext from (select 'music/' || p_partkey || case p_partkey % 4 when 0 then '.WAV' when 1 then '.mp3' when 2 then '.txt' else '' end part_path from part) where lower(regexp_extract(part_path, '\.[^./]+$')) in ('.wav', '.mp3', '.flac', '.ogg', '.m4a')")
def s8(spark, d):
    p = F.col("p_partkey")
    tail = F.when(p % 4 == 0, ".WAV").when(p % 4 == 1, ".mp3").when(p % 4 == 2, ".txt").otherwise("")
    files = table(spark, d, "part").select(F.concat(F.lit("music/"), p.cast("string"), tail).alias("part_path"))
    return files.select("part_path", P.extension(F.col("part_path")).alias("ext")).where(F.col("ext").isin(*D.AUDIO_TYPES))


@query("p6_preview_events", f"with {duck(S)} select chunk_id, run_id, start_seconds from (select chunk_id, run_id, round(pause_before + coalesce(sum(pause_before + duration_seconds + pause_after) over (partition by run_id order by chunk_id rows between unbounded preceding and 1 preceding), 0), 4) start_seconds from v_synth) where start_seconds <= least(90, 60)")
def p6(spark, d):
    t = P.timeline(synth(spark, d), "run_id", "chunk_id", F.col("pause_before"), F.col("duration_seconds"), F.col("pause_after"))
    return t.select("chunk_id", "run_id", F.round("start_seconds", 4).alias("start_seconds")).where(F.col("start_seconds") <= F.least(F.lit(90), F.lit(60)))


@query("p7_normalise_settings", "with s as (select o_orderkey id, case o_orderkey % 4 when 0 then 'piper' when 1 then 'Gemini' when 2 then null else 'edge' end engine0, case o_orderkey % 3 when 0 then 'Puck' when 1 then 'en-US-JennyNeural' else 'nobody' end voice, case o_orderkey % 5 when 0 then 'psychology' when 1 then '' else 'robot' end ch from orders), e as (select *, case lower(coalesce(engine0, 'edge')) when 'piper' then 'edge' when 'parler' then 'edge' else lower(coalesce(engine0, 'edge')) end engine from s) select id, engine, case when voice in ('Puck', 'en-US-JennyNeural') then voice when engine = 'edge' then 'en-US-AriaNeural' else 'Charon' end voice_id, case when ch in ('standard', 'meditation', 'psychology') then ch else 'standard' end character_name from e")
def p7(spark, d):
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, "piper").when(k % 4 == 1, "Gemini").when(k % 4 == 2, F.lit(None)).otherwise("edge").alias("engine"),
        F.when(k % 3 == 0, "Puck").when(k % 3 == 1, "en-US-JennyNeural").otherwise("nobody").alias("voice_id"), F.when(k % 5 == 0, "psychology").when(k % 5 == 1, "").otherwise("robot").alias("c"),
    )
    engine = F.lower(F.coalesce("engine", F.lit("edge")))
    for old, new in D.LEGACY_ENGINES.items():
        engine = F.when(engine == old, new).otherwise(engine)
    out = P.with_voice(raw.withColumn("engine", engine))
    return out.select("id", "engine", F.col("voice_final").alias("voice_id"), F.when(F.col("c").isin(*D.CHARACTERS), F.col("c")).otherwise("standard").alias("character_name"))


@query("p8_safe_name", r"""select page_id, nullif(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g')), '') name from pages""")
def p8(spark, d):
    return table(spark, d, "pages").select("page_id", P.safe_name(F.col("url")).alias("name"))


LOG_SQL = r"""with l as (select event_id, case event_id % 7 when 0 then 400 when 1 then 404 when 2 then 429 when 3 then 500 when 4 then 503 when 5 then 403 else 418 end status,
 case when event_id % 2 = 0 then 'quota  for ' || event_type || '   is used' else '  plain ' || event_type || '  body ' end body,
 case when event_id % 3 = 0 then cast(event_id % 90 as double) end retry_after, event_id % 4 attempt from events)
select event_id, trim(regexp_replace(body, '\s+', ' ', 'g')) reason, case when status in (400, 401, 403) then 'rejected' when status = 404 then 'not_found' when status = 429 then 'quota' else 'failed' end failure,
 status in (429, 500, 502, 503) retryable, cast(case when retry_after is not null then least(retry_after, 60) else 2.0 * (attempt + 1) end as double) wait_seconds from l"""


@query("p9_failure_triage", LOG_SQL)
def p9(spark, d):
    k = F.col("event_id")
    status = F.lit(418)
    for i, s in enumerate((400, 404, 429, 500, 503, 403)):
        status = F.when(k % 7 == i, s).otherwise(status)
    inner = F.struct(F.struct(F.lit(1).alias("code"), F.concat(F.lit("quota  for "), "event_type", F.lit("   is used")).alias("message")).alias("error"))
    log = table(spark, d, "events").select(
        "event_id", status.alias("status"), F.when(k % 2 == 0, F.to_json(inner)).otherwise(F.concat(F.lit("  plain "), "event_type", F.lit("  body "))).alias("body"),
        F.when(k % 3 == 0, (k % 90).cast("double")).alias("retry_after"), (k % 4).alias("attempt"),
    )
    return P.triage(log).select("event_id", "reason", "failure", "retryable", F.col("wait_seconds").cast("double"))


FORCED = "case doc_id % 3 when 0 then 'SAD' when 1 then 'auto' end"


@query("p10_force_emotion", "with l as (select doc_id, case when doc_id % 3 = 0 then array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') and not regexp_matches(x, '(?i)^\\s*(\\[\\s*SCENE\\b|#{1,3}\\s)') then '[EMOTION:SAD]' || x else x end), chr(10)) else text end t from documents) select doc_id as script_id, t as script_text from l")
def p10(spark, d):
    """The scripts with the emotion that their row forces, as the pipeline reads them."""
    docs = table(spark, d, "documents").selectExpr("doc_id as script_id", "text as script_text", f"{FORCED} as forced_emotion")
    return script.force_emotion(docs).select("script_id", "script_text")


@query("r2_length_scale", f"with {duck(S)}, r as (select chunk_id, case when duration_seconds > 0 then word_count * 60.0 / duration_seconds else 0 end rate from v_synth) select chunk_id, case when rate <= 0 then 1.0 else round(greatest(0.8, least(1.25, rate / cast(130 + chunk_id % 40 as double))), 4) end::double scale from r")
def r2(spark, d):
    rate = F.when(F.col("duration_seconds") > 0, F.col("word_count") * 60.0 / F.col("duration_seconds")).otherwise(0.0)
    return synth(spark, d).select("chunk_id", P.wpm_to_scale(rate, (130 + F.col("chunk_id") % 40).cast("double")).alias("scale"))


@query("r3_rate_pitch", f"with {duck(S)}, p as (select chunk_id, 0.7 + (chunk_id % 61) / 100.0 scale, (chunk_id % 21 - 10) * 1.0 semis from v_synth) select chunk_id, printf('%+.0f%%', greatest(-30.0, least(30.0, (1.0 / scale::double - 1.0) * 100.0))) rate, printf('%+.0fHz', greatest(-40.0, least(40.0, semis::double * 8.0))) pitch from p")
def r3(spark, d):
    p = synth(spark, d).select("chunk_id", (F.lit(0.7) + (F.col("chunk_id") % 61) / 100.0).alias("scale"), ((F.col("chunk_id") % 21 - 10) * 1.0).alias("semis"))
    return p.select("chunk_id", P.rate_percent(F.col("scale")).alias("rate"), P.pitch_hertz(F.col("semis")).alias("pitch"))


H01 = "cast(('0x' || substr(sha1({}), 1, 8)) as bigint)::double / 4294967295.0"


@query("r5_hash_jitter", "select doc_id, round(0.35 * (0.85 + 0.30 * (" + H01.format("'pause:' || source || doc_id") + ")), 3) pause, round(1.0 + ((" + H01.format("'rate:' || source || doc_id") + ") - 0.5) * 0.04, 9) rate from documents")
def r5(spark, d):
    text = F.concat("source", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", P.jitter_pause(F.lit(P.BREATH), text).alias("pause"), F.round(P.jitter_rate(text), 9).alias("rate"))


@query("r6_estimate_duration", f"with {duck(S)} select chunk_id, round(word_count / greatest(60, 40 + chunk_id % 120)::double * 60.0 + pause_after, 3) as seconds from v_synth")
def r6(spark, d):
    return synth(spark, d).select("chunk_id", P.estimate_seconds(F.col("word_count"), (40 + F.col("chunk_id") % 120).cast("double"), F.col("pause_after")).alias("seconds"))


@query("r7_final_length_scale", f"with {duck(S)} select chunk_id, round(greatest(0.8, least(1.25, (0.9 + pause_before / 10) * (1 + pause_after / 10) * (1.0 + (({H01.format("'rate:' || voice_id || chunk_id")}) - 0.5) * 0.04) * case when chunk_id % 4 = 0 then 1.05 else 1.0 end)), 4) scale from v_synth")
def r7(spark, d):
    s = synth(spark, d)
    text = F.concat("voice_id", F.col("chunk_id").cast("string"))
    return s.select("chunk_id", P.final_scale(0.9 + F.col("pause_before") / 10, 1 + F.col("pause_after") / 10, text, F.col("chunk_id") % 4 == 0).alias("scale"))


RATED = "select chunk_id, run_id, word_count, ts, 1.0 + pause_before / 4 scale, case when duration_seconds > 0 then word_count * 60.0 / duration_seconds else 0 end actual_wpm, cast(150 as double) target_wpm from v_synth"


@query("r8_rate_correction", f"with {duck(S)}, r as ({RATED}), a as (select *, row_number() over (partition by run_id, word_count order by ts, chunk_id) attempt from r), d as (select *, case when actual_wpm > 0 then abs(actual_wpm - target_wpm) / target_wpm end dev from a) select chunk_id, cast(attempt as int) attempt, round(dev, 6) deviation, case when dev > 0.08 then round(greatest(0.8, least(1.25, scale * actual_wpm / target_wpm)), 4) end retry_scale, row_number() over (partition by run_id, word_count order by case when dev is not null then dev when attempt = 1 then 0 else 'infinity'::double end, attempt) = 1 kept from d")
def r8(spark, d):
    """Attempts at chunks of one run with as many words: the retry's scale, and the attempt that is kept."""
    rate = F.when(F.col("duration_seconds") > 0, F.col("word_count") * 60.0 / F.col("duration_seconds")).otherwise(0.0)
    s = synth(spark, d).select("chunk_id", "run_id", "word_count", "ts", (1.0 + F.col("pause_before") / 4).alias("scale"), rate.alias("actual_wpm"), F.lit(150.0).alias("target_wpm"))
    r = P.keep_closer(P.correct_rate(s), ["run_id", "word_count"], "ts", "chunk_id")
    return r.select("chunk_id", "attempt", "deviation", "retry_scale", "kept")


@query("r10_chunk_gain", f"with {duck(S)} select chunk_id, case when chunk_id % 4 = 2 then 1.5 else 0.0 end::double gain_db from v_synth")
def r10(spark, d):
    effects = F.when(F.col("chunk_id") % 4 == 2, F.array(F.lit("breath"), F.lit("emphasis"))).otherwise(F.array(F.lit("low")))
    return synth(spark, d).select("chunk_id", P.chunk_gain(effects).alias("gain_db"))


@query("a3_actual_wpm", f"with {duck(S)} select run_id, case when sum(duration_seconds) > 0 then round(sum(word_count) / sum(duration_seconds) * 60.0, 4) else 0 end::double wpm from v_synth group by run_id")
def a3(spark, d):
    total = F.sum("duration_seconds")
    return synth(spark, d).groupBy("run_id").agg(F.when(total > 0, F.round(F.sum("word_count") / total * 60.0, 4)).otherwise(0.0).alias("wpm"))


@query("a4_usage_report", f"with {duck(S)} select engine, voice_id, cast(sum(word_count * 6) as bigint) characters, round(sum(duration_seconds), 3) as seconds, count(*) requests from v_synth group by engine, voice_id")
def a4(spark, d):
    return synth(spark, d).groupBy("engine", "voice_id").agg(F.sum((F.col("word_count") * 6).cast("long")).alias("characters"), F.round(F.sum("duration_seconds"), 3).alias("seconds"), F.count(F.lit(1)).alias("requests"))


@query("a5_completion", f"with {duck(S)} select run_id, count(*) filter (status = 'done') done, count(*) total, count(*) filter (status <> 'done') missing from v_synth group by run_id")
def a5(spark, d):
    return synth(spark, d).groupBy("run_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "done").alias("missing"))


@query("a6_batch_summary", f"with {duck(S)} select status, count(*) scripts from (select run_id, case when bool_or(status = 'failed') then 'failed' else 'succeeded' end status from v_synth group by run_id) group by status")
def a6(spark, d):
    runs = synth(spark, d).groupBy("run_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("succeeded").alias("status"))
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("scripts"))


@query("a7_cache_stats", "select lang, count(*) files, cast(sum(strlen(text)) as bigint) total_bytes from documents group by lang")
def a7(spark, d):
    return P.cache_stats(table(spark, d, "documents").select("lang", F.octet_length("text").alias("size_bytes")), "lang")


@query("a8_natural_wpm", f"with {duck(S)} select voice_id, greatest(60, least(300, round(sum(word_count) / sum(duration_seconds) * 60.0, 4)))::double wpm from v_synth group by voice_id")
def a8(spark, d):
    rate = F.round(F.sum("word_count") / F.sum("duration_seconds") * 60.0, 4)
    return synth(spark, d).groupBy("voice_id").agg(F.greatest(F.lit(60.0), F.least(F.lit(300.0), rate)).alias("wpm"))


@query("w2_timeline_cursor", f"with {duck(S)} select chunk_id, run_id, round(pause_before + coalesce(sum(pause_before + duration_seconds + pause_after) over (partition by run_id order by chunk_id rows between unbounded preceding and 1 preceding), 0), 4) start_seconds from v_synth")
def w2(spark, d):
    t = P.timeline(synth(spark, d), "run_id", "chunk_id", F.col("pause_before"), F.col("duration_seconds"), F.col("pause_after"))
    return t.select("chunk_id", "run_id", F.round("start_seconds", 4).alias("start_seconds"))


@query("w3_character_gap", "select conv_id, turn, case when regexp_matches(rtrim(lag(text) over (partition by conv_id order by turn)), '[।!?.；]$') then 1.5 else 0.0 end::double gap from conversations")
def w3(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.character_gap(F.col("text"), "conv_id", "turn", "meditation").alias("gap"))


@query("w3_gapped_timeline", "with g as (select conv_id, turn, length(text) / 15.0::double secs, case when regexp_matches(rtrim(lag(text) over (partition by conv_id order by turn)), '[।!?.；]$') then 1.5 else 0.0 end::double gap from conversations) select conv_id, turn, round(gap + coalesce(sum(gap + secs) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0), 4) start_seconds from g")
def w3_gapped(spark, d):
    """The cursor with a character's gaps in it."""
    c = table(spark, d, "conversations")
    gap = P.character_gap(F.col("text"), "conv_id", "turn", "meditation")
    t = P.timeline(c, "conv_id", "turn", F.lit(0.0), F.length("text") / 15.0, F.lit(0.0), gap)
    return t.select("conv_id", "turn", F.round("start_seconds", 4).alias("start_seconds"))


@query("w9_pacing_schedule", f"with {duck(S)} select chunk_id, run_id, (row_number() over (partition by run_id order by chunk_id) - 1) * 4.0::double send_at from v_synth")
def w9(spark, d):
    return synth(spark, d).select("chunk_id", "run_id", P.pacing("run_id", "chunk_id", 4.0).alias("send_at"))


@query("w10_progress_eta", f"with {duck(S)}, w as (select *, row_number() over (partition by run_id order by chunk_id) done, count(*) over (partition by run_id) n from v_synth) select chunk_id, run_id, done / n * 90.0 percent, (n - done) * duration_seconds / done eta from w")
def w10(spark, d):
    return P.progress(synth(spark, d), "run_id", "chunk_id", F.col("duration_seconds")).select("chunk_id", "run_id", "percent", "eta")


@query("w11_latest_snapshot", "with s as (select user_id, max(row(ts, event_id)) x from events where event_type = 'purchase' and user_id % 5 <> 0 group by 1), a as (select user_id, max(row(ts, event_id)) x from events where event_type <> 'purchase' and user_id % 7 <> 0 group by 1) select user_id project, case when s.x is null or a.x[1] > s.x[1] then 'snapshot' else 'save' end source, case when s.x is null or a.x[1] > s.x[1] then a.x[2] else s.x[2] end file from s full join a using (user_id)")
def w11(spark, d):
    """Projects of users: purchases are saves, all other events autosaves; some projects have only one of both."""
    e = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("ts").alias("at"), F.col("event_id").alias("file"), "event_type")
    saves = e.where("event_type = 'purchase' and project % 5 <> 0")
    return P.recoverable(saves, e.where("event_type <> 'purchase' and project % 7 <> 0")).select("project", "source", "file")


@query("k1_recent_generations", f"with {duck('v_history')} select id, project_id, duration_seconds from v_history order by id desc limit 25")
def k1(spark, d):
    return view(spark, d, "v_history").select("id", "project_id", "duration_seconds").orderBy(F.desc("id")).limit(25)


@query("k3_order_events", f"with {duck(S)} select run_id, chunk_id, row_number() over (partition by run_id order by ts, chunk_id) place from v_synth")
def k3(spark, d):
    return P.in_order(synth(spark, d), "run_id", "ts", "chunk_id").select("run_id", "chunk_id", "place")


@query("u2_dedup_plan", f"with {duck(S)} select k, chunk_id from (select engine || voice_id || word_count k, chunk_id, row_number() over (partition by engine || voice_id || word_count order by chunk_id desc) n from v_synth) where n = 1")
def u2(spark, d):
    keyed = synth(spark, d).select(F.concat("engine", "voice_id", F.col("word_count").cast("string")).alias("k"), "chunk_id")
    return keyed.groupBy("k").agg(F.max("chunk_id").alias("chunk_id"))


KEY = "substr(sha1(concat_ws(chr(31), text, source, lang, cast(doc_id % 7 as varchar))), 1, 24)"


def planned(spark, d, extra: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" More."))).otherwise(F.col("text")) if extra else F.col("text")
    return docs.select("doc_id", P.chunk_key(text, F.col("source"), F.col("lang"), F.col("doc_id") % 7).alias("key"), F.length("text").alias("size_bytes"))


@query("r9_chunk_key", f"select doc_id, {KEY} key from documents")
def r9(spark, d):
    return planned(spark, d).select("doc_id", "key")


@query("j3_cache_hits", f"with p as (select doc_id, {KEY} key, length(text) size_bytes from documents), c as (select * from p where doc_id % 3 = 0 and size_bytes > 44) select doc_id, key, key in (select key from c) hit from p")
def j3(spark, d):
    plan = planned(spark, d)
    cache = plan.where("doc_id % 3 = 0")
    return P.cache_flags(plan, cache).select("doc_id", "key", "hit")


KEY_B = KEY.replace("text,", "case when doc_id % 10 = 0 then text || ' More.' else text end,")


@query("j4_plan_diff", f"with a as (select distinct {KEY} key from documents), b as (select distinct {KEY_B} key from documents) select coalesce(a.key, b.key) key, case when a.key is null then 'added' when b.key is null then 'removed' else 'kept' end state from a full join b on a.key = b.key")
def j4(spark, d):
    return P.plan_diff(planned(spark, d), planned(spark, d, extra=True))


@query("j5_relocate_paths", r"with c as (select p_partkey id, 'C:\old\' || case when p_partkey % 2 = 0 then 'clips/' else 'x\' end || 'k' || p_partkey || '.wav' path from part), f as (select 'k' || p_partkey || '.wav' base, '/cache/k' || p_partkey || '.wav' path from part where p_partkey % 3 = 0) select id, coalesce(f.path, c.path) path from c left join f on base = 'k' || id || '.wav'")
def j5(spark, d):
    k = F.col("p_partkey").cast("string")
    parts = table(spark, d, "part")
    rows = parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit("C:\\old\\"), F.when(F.col("p_partkey") % 2 == 0, "clips/").otherwise("x\\"), F.lit("k"), k, F.lit(".wav")).alias("path"))
    files = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("/cache/k"), k, F.lit(".wav")).alias("path"))
    return P.relocate(rows, files)


@query("j9_resume_plan", f"with p as (select doc_id, {KEY} key from documents), r as (select key, max(doc_id) id from p where doc_id % 2 = 0 group by key) select doc_id, case when id % 3 = 0 then 'done' else 'pending' end state, case when id % 3 = 0 then 'a/' || id end path, case when id % 3 = 0 then id / 2.0 end::double as seconds from p left join r using (key)")
def j9(spark, d):
    plan = planned(spark, d).select("doc_id", "key")
    r = plan.where("doc_id % 2 = 0").groupBy("key").agg(F.max("doc_id").alias("id"))
    results = r.select("key", F.when(F.col("id") % 3 == 0, "done").otherwise("failed").alias("status"), F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), (F.col("id") / 2.0).alias("seconds"))
    return P.resume_plan(plan, results).drop("key")


@query("j1_voice_lookup", "with " + duck(S) + ", v as (select voice_id, style, gender from " + D.values_sql([(v[1], v[3], v[2]) for v in D.VOICES], "voice_id, style, gender") + "), s as (select chunk_id, engine, case chunk_id % 4 when 0 then 'Kore' when 1 then 'en-US-GuyNeural' else 'none' end want from v_synth), f as (select *, case when want in (select voice_id from v) then want when engine = 'edge' then 'en-US-AriaNeural' else 'Charon' end voice_id from s) select chunk_id, voice_id, style, gender from f join v using (voice_id)")
def j1(spark, d):
    s = synth(spark, d).select("chunk_id", "engine", F.when(F.col("chunk_id") % 4 == 0, "Kore").when(F.col("chunk_id") % 4 == 1, "en-US-GuyNeural").otherwise("none").alias("voice_id"))
    found = P.with_voice(s).select("chunk_id", F.col("voice_final").alias("voice_id"))
    return P.lookup(found, D.voices(spark).select("voice_id", "style", "gender"), "voice_id")


@query("j2_preset_lookup", "with " + duck("v_script") + ", p as (select * from " + D.values_sql(D.PRESETS, D.PRESET_SCHEMA.replace(" string", "").replace(" int", "").replace(" double", "")) + "), l as (select * from " + D.values_sql(D.LOUDNESS, "loudness, target_level, ceiling") + ") select script_id, p.preset, wpm, preset_pause_scale, target_level from v_script s join p on p.preset = case when s.preset = 'unknown' then 'DOCUMENTARY' else s.preset end join l using (loudness)")
def j2(spark, d):
    s = P.with_preset(view(spark, d, "v_script").select("script_id", "preset"))
    return P.lookup(s, D.loudness(spark), "loudness").select("script_id", "preset", "wpm", "preset_pause_scale", "target_level")


@query("r1_plan_prosody", "with " + duck(S) + ", f as (select emotion, rate_scale, pause_scale, intensity from " + D.values_sql([p[:4] for p in D.PROFILES], "emotion, rate_scale, pause_scale, intensity") + "), s as (select chunk_id, pause_before, pause_after, chunk_id % 4 = 1 whisper, case chunk_id % 3 when 0 then 1.6 else 1.0 end ps, case chunk_id % 5 when 0 then 'FEAR' when 1 then 'HAPPY' when 2 then 'WHISPER' else 'NEUTRAL' end emotion from v_synth) select chunk_id, round((1.0 + (rate_scale - 1.0) * 0.7) * case when whisper then 1.05 else 1.0 end, 4) plan_scale, round(pause_before * (pause_scale * ps), 3) plan_before, round(pause_after * (pause_scale * ps), 3) plan_after, round(case when whisper then greatest(intensity * 0.7, 0.6) else intensity * 0.7 end, 3) plan_intensity from s join f using (emotion)")
def r1(spark, d):
    k = F.col("chunk_id")
    s = synth(spark, d).select(
        "chunk_id", "pause_before", "pause_after", F.when(k % 4 == 1, F.array(F.lit("whisper"))).otherwise(F.array().cast("array<string>")).alias("effects"),
        F.when(k % 3 == 0, "horror").otherwise("none").alias("preset"), F.when(k % 5 == 0, "fear").when(k % 5 == 1, "HAPPY").when(k % 5 == 2, "WHISPER").otherwise("odd").alias("emotion"),
    )
    return P.plan_prosody(s).select("chunk_id", "plan_scale", "plan_before", "plan_after", "plan_intensity")


STYLE_SQL = [(e, f"{t}{', slowly' if 1 + (r - 1) * 0.7 > 1.06 and 'slowly' not in t else ', quickly' if 1 + (r - 1) * 0.7 < 0.94 else ''}") for (e, t), (_, r, *_x) in zip(D.EMOTION_STYLE, D.PROFILES, strict=True)]


@query("r4_style_prompt", "with " + duck(S) + ", st as (select * from " + D.values_sql(STYLE_SQL, "emotion, style") + "), pd as (select * from " + D.values_sql(D.PRESET_DIRECTION, "preset, direction") + "), s as (select chunk_id, voice_id, case chunk_id % 5 when 0 then 'SAD' when 1 then 'EXCITED' when 2 then 'SUSPENSE' else 'NEUTRAL' end emotion, case chunk_id % 3 when 0 then 'HORROR' when 1 then 'SCI_FI' else 'other' end preset from v_synth) select chunk_id, 'Read aloud ' || style || case when emotion = 'NEUTRAL' and direction is not null then ', ' || direction else '' end || ': ' || voice_id prompt from s join st using (emotion) left join pd using (preset)")
def r4(spark, d):
    k = F.col("chunk_id")
    s = synth(spark, d).withColumn("emotion", F.when(k % 5 == 0, "SAD").when(k % 5 == 1, "EXCITED").when(k % 5 == 2, "SUSPENSE").otherwise("NEUTRAL")).withColumn("preset", F.when(k % 3 == 0, "HORROR").when(k % 3 == 1, "SCI_FI").otherwise("other"))
    return s.select("chunk_id", F.concat(F.lit("Read aloud "), P.style_direction(F.col("emotion"), F.col("preset")), F.lit(": "), "voice_id").alias("prompt"))


CATALOG_SQL = D.values_sql([(v[0], v[1], v[5]) for v in D.VOICES], "pos, voice_id, engine")


@query("p4_voices_for_engine", "with " + duck(S) + ", v as (select engine, count(*) n_voices, string_agg(voice_id, ',' order by pos) voices from " + CATALOG_SQL + " group by engine) select chunk_id, engine, n_voices, voices from v_synth join v using (engine)")
def p4(spark, d):
    rows = P.voices_for_engine(synth(spark, d).select("chunk_id", "engine"), D.voices(spark))
    return rows.select("chunk_id", "engine", F.size("voices").cast("long").alias("n_voices"), F.array_join("voices", ",").alias("voices"))


@query("u1_all_voices", "with " + duck(S) + ", w as (select *, row_number() over (partition by engine order by pos) - 1 i, count(*) over (partition by engine) m from " + CATALOG_SQL + ") select w.voice_id, w.pos, count(chunk_id) uses, cast(coalesce(sum(word_count), 0) as bigint) words from w left join v_synth s on s.engine = w.engine and chunk_id % m = i group by 1, 2")
def u1(spark, d):
    """The use of every voice of both catalogs, those included that no chunk has: chunks take the voices of their engine in turn."""
    every = P.all_voices(D.voices(spark), "edge", "gemini")
    rows = P.voices_for_engine(synth(spark, d).select("chunk_id", "engine", "word_count"), every)
    said = rows.select("word_count", F.get("voices", (F.col("chunk_id") % F.size("voices")).cast("int")).alias("voice_id"))
    uses = said.groupBy("voice_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("word_count").alias("words"))
    return every.join(uses, "voice_id", "left").select("voice_id", "pos", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))


@query("k2_find_by_style", "with w as (select event_id, case event_id % 4 when 0 then 'UPBEAT' when 1 then 'firm' when 2 then 'news' else 'none' end style, case event_id % 3 when 0 then 'male' when 1 then 'Female' else '' end gender from events), v as (select * from " + D.values_sql([(v[0], v[1], v[2], v[3]) for v in D.VOICES], "pos, voice_id, gender, style") + ") select event_id, min_by(voice_id, pos) voice_id from w left join v on lower(v.style) = lower(w.style) and (w.gender = '' or v.gender = lower(w.gender)) group by event_id")
def k2(spark, d):
    k = F.col("event_id")
    w = table(spark, d, "events").select("event_id", F.when(k % 4 == 0, "UPBEAT").when(k % 4 == 1, "firm").when(k % 4 == 2, "news").otherwise("none").alias("style"), F.when(k % 3 == 0, "male").when(k % 3 == 1, "Female").otherwise("").alias("gender"))
    return P.find_by_style(w, D.voices(spark), "event_id").select("event_id", "voice_id")
