"""Queries of the signal, timeline and mixing operators. Clips here have 64 samples, blocks 8 and hops 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skald.operators import blocks as K, signal as G
from skald.plans.registry import query
from skald.plans.views import duck, table, view

V = "with " + duck("v_clip")
BLK = V + ", b as (select clip_id, cast(floor(pos / 8.0) as int) block, max(abs(amp)) peak, avg(amp * amp) energy from v_clip group by 1, 2)"
TRACKS = ("VOICE", "MUSIC", "SFX", "AMBIENCE")


def clips(spark, d) -> DataFrame:
    return view(spark, d, "v_clip")


def whole(spark, d) -> DataFrame:
    """(clip_id, label, amps): the same clips as arrays."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("amps"))


def levels(spark, d, size: int = 8) -> DataFrame:
    return K.levels(K.cut(whole(spark, d), size))


def gated(spark, d) -> DataFrame:
    return K.gated_level(levels(spark, d, 4), 16, 4)


def samples(blocks: DataFrame, array: str, size: int, start: str = "block", pos: str = "pos", amp: str = "amp") -> DataFrame:
    """A row per sample that is there, for the comparison with SQL."""
    keep = [c for c in blocks.columns if c not in (array, start)]
    rows = blocks.select(*keep, start, F.posexplode(array).alias("_i", amp)).where(F.col(amp).isNotNull())
    return rows.select(*keep, (F.col(start) * size + F.col("_i")).cast("int").alias(pos), amp)


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("a9_peak_dbfs", V + " select clip_id, round(20.0 * log10(greatest(max(abs(amp)), 1e-9)), 6) peak_db from v_clip group by clip_id")
def a9(spark, d):
    top = levels(spark, d).groupBy("clip_id").agg(F.max("peak").alias("peak"))
    return top.select("clip_id", r6(G.decibels(F.col("peak")), "peak_db"))


@query("a10_block_peaks", BLK + " select clip_id, block, round(peak / max(peak) over (partition by clip_id), 4) peak from b")
def a10(spark, d):
    return levels(spark, d).select("clip_id", F.col("block").cast("int"), F.round(F.col("peak") / F.max("peak").over(G.per_clip()), 4).alias("peak"))


LEVEL = V + ", p as (select clip_id, b, avg(amp * amp) e from v_clip, range(0, 13) t(b) where pos >= b * 4 and pos < b * 4 + 16 group by 1, 2), l as (select *, avg(e) over (partition by clip_id) * 0.1 gate from p where 10 * log10(greatest(e, 1e-12)) > -70), k as (select clip_id, 10 * log10(greatest(avg(e), 1e-12)) gated_level_db from l where e > gate group by 1), lv as (select c.clip_id, coalesce(gated_level_db, -70.0) gated_level_db from (select distinct clip_id from v_clip) c left join k using (clip_id))"


@query("a11_gated_loudness", LEVEL + " select clip_id, round(gated_level_db, 6) gated_level_db from lv")
def a11(spark, d):
    return gated(spark, d).select("clip_id", r6(F.col("gated_level_db"), "gated_level_db"))


RUNS = ", r as (select *, row_number() over (partition by clip_id order by block) - row_number() over (partition by clip_id, peak < 0.2 order by block) island from b), s as (select clip_id, peak < 0.2 q, island, count(*) n from r group by 1, 2, 3), sl as (select clip_id, coalesce(max(n) filter (q), 0) longest from s group by 1)"


@query("w5_silence_runs", BLK + RUNS + " select clip_id, longest from sl")
def w5(spark, d):
    return G.silence_runs(levels(spark, d), 0.2)


@query("a12_quality_gate", LEVEL + ", b as (select clip_id, cast(floor(pos / 8.0) as int) block, max(abs(amp)) peak from v_clip group by 1, 2)" + RUNS + ", st as (select clip_id, count(*) / 8.0 duration, 20.0 * log10(greatest(max(abs(amp)), 1e-9)) db from v_clip group by 1) select clip_id, duration::double duration, round(db, 4) peak_db, concat_ws(',', case when db >= -0.05 then 'critical:clipping' end, case when clip_id % 9 = 0 then 'critical:missing_chunks' end, case when duration > 5 and abs(gated_level_db + 14) > 3 then 'warning:loudness' end, case when db > -0.7 then 'warning:peak' end, case when longest >= 2 then 'warning:long_silence' end) issues, db >= -0.05 or clip_id % 9 = 0 blocked from st join lv using (clip_id) join sl using (clip_id)")
def a12(spark, d):
    blk = levels(spark, d)
    missing = whole(spark, d).select("clip_id", F.when(F.col("clip_id") % 9 == 0, 1).otherwise(0).alias("missing"))
    q = G.quality(blk, gated(spark, d), G.silence_runs(blk, 0.2), missing, 8, -14.0, -1.0, 2)
    return q.withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["code"])), ","))


@query("w6_trim_tail", V + ", m as (select *, max(pos) filter (abs(amp) > 0.3) over (partition by clip_id) last from v_clip) select clip_id, count(*) kept, round(sum(amp), 6) total from m where last is null or pos < last + 4 group by clip_id")
def w6(spark, d):
    return G.trim_tail(clips(spark, d), 0.3, 4).groupBy("clip_id").agg(F.count(F.lit(1)).alias("kept"), r6(F.sum("amp"), "total"))


@query("w7_short_term_level", BLK + " select clip_id, block, round(10.0 * log10(greatest(e, 1e-12)), 6) level_db from (select clip_id, block, avg(energy) over w e, count(*) over w n from b window w as (partition by clip_id order by block rows between current row and 2 following)) where n = 3")
def w7(spark, d):
    return K.short_term(levels(spark, d), 3).select("clip_id", "block", r6(F.col("level_db"), "level_db"))


@query("w8_lookahead_gain", V + " select clip_id, pos, round(least(0.25 / greatest(max(abs(amp)) over (partition by clip_id order by pos rows between current row and 4 following), 1e-9), 1.0), 6) gain from v_clip")
def w8(spark, d):
    gain = K.lookahead_gain(K.cut(whole(spark, d), 8), 8, 0.25, 4)
    return samples(gain, "gain", 8, amp="gain").select("clip_id", "pos", r6(F.col("gain"), "gain"))


@query("g1_apply_gain", V + " select clip_id, pos, round(case when label % 4 = 0 then amp else amp * pow(10.0, (label % 4 * -1.5) / 20.0) end, 6) amp from v_clip")
def g1(spark, d):
    return clips(spark, d).select("clip_id", "pos", r6(G.gain(F.col("amp"), (F.col("label") % 4 * -1.5)), "amp"))


@query("g2_linear_fades", V + " select clip_id, pos, round(amp * case when pos < 8 then pos / 7.0 else 1.0 end * case when pos >= 48 then (63 - pos) / 15.0 else 1.0 end, 6) amp from v_clip")
def g2(spark, d):
    return clips(spark, d).select("clip_id", "pos", r6(G.fade(F.col("amp"), F.col("pos"), F.lit(64), 8, 16), "amp"))


@query("g3_power_fades", V + " select clip_id, pos, round(amp * case when pos < 8 then pow(pos / 7.0, 1.5) else 1.0 end * case when pos >= 48 then pow((63 - pos) / 15.0, 1.5) else 1.0 end, 6) amp from v_clip")
def g3(spark, d):
    return clips(spark, d).select("clip_id", "pos", r6(G.fade(F.col("amp"), F.col("pos"), F.lit(64), 8, 16, 1.5), "amp"))


@query("g4_micro_fades", V + " select clip_id, pos, round(case when label % 4 <> 0 then amp else amp * case when pos < 4 then 0.5 - 0.5 * cos(pi() * pos / 4.0) else 1.0 end * case when pos >= 56 then 0.5 - 0.5 * cos(pi() * (63 - pos) / 8.0) else 1.0 end end, 6) + 0.0 amp from v_clip")
def g4(spark, d):
    voice = F.col("label") % 4 == 0  # only the voice is faded
    return clips(spark, d).select("clip_id", "pos", (F.round(F.when(voice, G.micro_fade(F.col("amp"), F.col("pos"), F.lit(64), 4, 8)).otherwise(F.col("amp")), 6) + F.lit(0.0)).alias("amp"))


@query("g5_peak_normalise", V + ", m as (select *, max(abs(amp * 3)) over (partition by clip_id) p from v_clip) select clip_id, pos, round(case when p > 1 then amp * 3 / p else amp * 3 end, 6) guarded, round(case when p > 1e-9 then amp * 3 * (0.9 / p) else amp * 3 end, 6) scaled from m")
def g5(spark, d):
    x = F.col("amp") * 3
    return clips(spark, d).select("clip_id", "pos", r6(G.peak_guard(x), "guarded"), r6(G.peak_guard(x, target=0.9), "scaled"))


@query("g6_soft_saturate", V + " select clip_id, pos, round(tanh(amp * 1.8) / tanh(1.8), 6) amp from v_clip")
def g6(spark, d):
    return clips(spark, d).select("clip_id", "pos", r6(G.saturate(F.col("amp"), 1.8), "amp"))


@query("g7_mono_downmix", V + " select clip_id // 2 clip_id, pos, round(avg(amp), 6) amp from v_clip group by 1, 2")
def g7(spark, d):
    return G.downmix(clips(spark, d).withColumn("clip_id", F.expr("clip_id div 2"))).select("clip_id", "pos", r6(F.col("amp"), "amp"))


@query("g11_level_to_target", LEVEL + " select clip_id, pos, round(case when abs(-20 - gated_level_db) < 0.01 then amp else amp * pow(10.0, (-20 - gated_level_db) / 20.0) end, 6) amp from v_clip join lv using (clip_id)")
def g11(spark, d):
    c = clips(spark, d)
    return c.join(gated(spark, d), "clip_id").select("clip_id", "pos", r6(G.gain(F.col("amp"), -20.0 - F.col("gated_level_db")), "amp"))


ENV = BLK.replace("with ", "with recursive ") + """, e as (select clip_id, block, peak * (case when peak > 0 then 0.8 else 0.2 end)::double env from b where block = 0
 union all select b.clip_id, b.block, env + (peak - env) * case when peak > env then 0.8::double else 0.2::double end from e join b on b.clip_id = e.clip_id and b.block = e.block + 1)"""


def envelopes(spark, d) -> DataFrame:
    return K.follow(levels(spark, d).select("clip_id", "block", "peak"), "clip_id", "block", "peak", 0.2, 0.8).drop("peak")


@query("g8_envelope_follow", ENV + " select clip_id, block, round(env, 6) env from e")
def g8(spark, d):
    return envelopes(spark, d).select("clip_id", F.col("block").cast("int"), r6(F.col("env"), "env"))


@query("g9_compress_gain", ENV + ", c as (select clip_id, block, greatest(20.0 * log10(greatest(env, 1e-9)) + 12.0, 0.0) * (1.0 / 3.0::double - 1.0) cut from e) select clip_id, block, round(cut - 0.7 * avg(cut) over (partition by clip_id), 6) + 0.0 gain_db from c")
def g9(spark, d):
    return K.compress(envelopes(spark, d), -12.0, 3.0).select("clip_id", F.col("block").cast("int"), (F.round("gain_db", 6) + F.lit(0.0)).alias("gain_db"))


def tracks(spark, d) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, TRACKS)), (F.col("label") % 4 + 1).cast("int"))
    return K.cut(whole(spark, d), 8).select("clip_id", "block", "amps", t.alias("track"), (F.col("clip_id") % 50).alias("mix_id"))


TR = V + ", t as (select clip_id, pos, amp, case label % 4 when 0 then 'VOICE' when 1 then 'MUSIC' when 2 then 'SFX' else 'AMBIENCE' end track, clip_id % 50 mix_id from v_clip)"
DUCK = TR + ", vb as (select mix_id, cast(floor(pos / 8.0) as int) block, max(abs(amp)) peak from t where track = 'VOICE' group by 1, 2), va as (select *, peak > greatest(0.5 * max(peak) over (partition by mix_id), 1e-6) active from vb), mb as (select distinct mix_id, cast(floor(pos / 8.0) as int) block from t where track = 'MUSIC')"


@query("j6_duck_gain", DUCK.replace("0.5 * max", "0.06 * max") + " select mix_id, block, case when active then 0.35 else 1.0 end::double gain from mb left join va using (mix_id, block)")
def j6(spark, d):
    t = tracks(spark, d)
    stems = t.select("mix_id", "track", F.col("block").alias("cell"), "amps")
    active = K.activity(stems.where("track = 'VOICE'").groupBy("mix_id", "track", "cell").agg(F.array(F.max(K.peak(F.col("amps")))).alias("amps")))
    music = t.where("track = 'MUSIC'").select("mix_id", F.col("block").alias("cell")).distinct()
    return music.join(active, ["mix_id", "cell"], "left").select("mix_id", F.col("cell").cast("int").alias("block"), F.when(F.col("active"), F.lit(0.35)).otherwise(F.lit(1.0)).alias("gain"))


SMOOTH = DUCK.replace("0.5 * max", "0.06 * max").replace("with ", "with recursive ", 1) + """, ba as (select m.mix_id, u.block, coalesce(cast(active as int), 0)::double x from (select distinct mix_id from vb) m cross join (select unnest(range(0, 8)) block) u left join va on va.mix_id = m.mix_id and va.block = u.block),
sm as (select mix_id, block, x * 0.5::double a from ba where block = 0 union all select ba.mix_id, ba.block, a + (x - a) * case when x > a then 0.5::double else 0.1::double end from sm join ba on ba.mix_id = sm.mix_id and ba.block = sm.block + 1)"""


def smoothed(spark, d) -> DataFrame:
    t = tracks(spark, d).select("mix_id", "track", F.col("block").alias("cell"), "amps")
    voice = t.where("track = 'VOICE'").groupBy("mix_id", "track", "cell").agg(F.array(F.max(K.peak(F.col("amps")))).alias("amps"))
    return K.smooth_activity(K.activity(voice), 8, 0.5, 0.9)


@query("g10_smooth_duck_gain", SMOOTH + " select mix_id, cast(block as int) block, round(1 - (1 - pow(10.0, -9.0 / 20.0)) * a, 6) gain from sm")
def g10(spark, d):
    gain = 1.0 - (1.0 - F.pow(F.lit(10.0), F.lit(-9.0 / 20.0))) * F.col("a")
    return smoothed(spark, d).select("mix_id", F.col("cell").cast("int").alias("block"), r6(gain, "gain"))


@query("g10_ducked_music", SMOOTH + """, si as (select *, coalesce(lag(a) over w, a) a0, coalesce(lead(a) over w, a) a1 from sm window w as (partition by mix_id order by block))
 select t.mix_id, clip_id, cast(pos as int) pos, round(amp * (1 - (1 - pow(10.0, -9.0 / 20.0)) * coalesce(case when pos % 8 < 4 then a0 + (a - a0) * (pos % 8 + 4) / 8.0::double else a + (a1 - a) * (pos % 8 - 4) / 8.0::double end, 0)), 6) amp
 from t left join si on si.mix_id = t.mix_id and si.block = t.pos // 8 where track = 'MUSIC'""")
def g10_music(spark, d):
    """The smoothed ducking applied to the music of each mix."""
    music = tracks(spark, d).where("track = 'MUSIC'").withColumnRenamed("block", "cell")
    out = K.duck(music, smoothed(spark, d), F.lit(9.0), 8)
    return samples(out.drop("track"), "amps", 8, "cell").select("mix_id", "clip_id", "pos", r6(F.col("amp"), "amp"))


def events(spark, d) -> DataFrame:
    return tracks(spark, d).select("mix_id", "clip_id", "track").distinct().withColumn("start", (F.col("clip_id") % 5 * 16).cast("int"))


@query("j7_place_events", TR + " select mix_id, clip_id, cast(clip_id % 5 * 16 + pos as int) sample_no, amp from t where clip_id % 5 * 16 + pos < 96")
def j7(spark, d):
    placed = K.place(K.cut(whole(spark, d), 8), events(spark, d), 96, 8)
    rows = placed.select("mix_id", "clip_id", (F.col("cell") * 8 + F.col("offset")).alias("_at"), F.posexplode("piece").alias("_i", "amp"))
    return rows.select("mix_id", "clip_id", (F.col("_at") + F.col("_i")).cast("int").alias("sample_no"), "amp")


@query("j8_crossfade", V + ", a as (select clip_id pair, pos, amp from v_clip where clip_id % 2 = 0), b as (select clip_id - 1 pair, pos, amp from v_clip where clip_id % 2 = 1), l as (select pair, pos, case when pos < 48 then amp else amp * pow(cos(pi() / 2 * (pos - 48) / 15.0), 2) end x from a), r as (select pair, pos + 48 pos, case when pos < 16 then amp * (1 - pow(cos(pi() / 2 * pos / 15.0), 2)) else amp end x from b) select pair, cast(pos as int) pos, round(sum(x), 6) amp from (select * from l union all select * from r) group by 1, 2")
def j8(spark, d):
    c = clips(spark, d)
    a = c.where("clip_id % 2 = 0").select(F.col("clip_id").alias("pair"), "pos", "amp", F.lit(64).alias("n"))
    b = c.where("clip_id % 2 = 1").select((F.col("clip_id") - 1).alias("pair"), "pos", "amp")
    return G.crossfade(a, b, 16).select("pair", F.col("pos").cast("int").alias("pos"), r6(F.col("amp"), "amp"))


@query("g12_assemble_timeline", "with " + duck("v_synth") + " select run_id, 'VOICE' track, chunk_id::bigint clip, round(start, 4) start_seconds, 0.0::double gain_db from (select *, pause_before + coalesce(sum(pause_before + duration_seconds + pause_after) over (partition by run_id order by chunk_id rows between unbounded preceding and 1 preceding), 0) start from v_synth) union all select distinct run_id, 'MUSIC', -1, 0.0, -20.0 + -22.0 / 2 from v_synth")
def g12(spark, d):
    from skald.operators.planning import timeline

    s = view(spark, d, "v_synth")
    t = timeline(s, "run_id", "chunk_id", F.col("pause_before"), F.col("duration_seconds"), F.col("pause_after"))
    voice = t.select("run_id", F.lit("VOICE").alias("track"), F.col("chunk_id").cast("long").alias("clip"), F.round("start_seconds", 4).alias("start_seconds"), F.lit(0.0).alias("gain_db"))
    music = s.select("run_id").distinct().select("run_id", F.lit("MUSIC").alias("track"), F.lit(-1).cast("long").alias("clip"), F.lit(0.0).alias("start_seconds"), F.lit(-20.0 + -22.0 / 2).alias("gain_db"))
    return voice.unionByName(music)


@query("g13_mixdown", TR + ", p as (select mix_id, track, cast(clip_id % 5 * 16 + pos as int) sn, sum(amp) amp from t where clip_id % 5 * 16 + pos < 96 group by 1, 2, 3), vb as (select mix_id, sn // 8 block, max(abs(amp)) peak from p where track = 'VOICE' group by 1, 2), va as (select mix_id, block, peak > greatest(0.06 * max(peak) over (partition by mix_id), 1e-6) active from vb), m as (select p.mix_id, sn, sum(amp * case when active then pow(10.0, -case track when 'MUSIC' then 9.0 when 'AMBIENCE' then 3.0 else 0.0 end / 20.0) else 1.0 end) x from p left join va on va.mix_id = p.mix_id and block = sn // 8 group by 1, 2), g as (select *, max(abs(x)) over (partition by mix_id) pk from m) select mix_id, sn sample_no, round(case when pk > 1 then x / pk else x end, 6) amp from g")
def g13(spark, d):
    mix = K.mixdown(K.cut(whole(spark, d), 8), events(spark, d), 96, 8, 9.0)
    return samples(mix, "amps", 8, "cell", "sample_no").select("mix_id", "sample_no", r6(F.col("amp"), "amp"))