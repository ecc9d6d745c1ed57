"""Lookups, plans, timelines and reports over script, chunk and synthesis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skald import dimensions as D

SCALE_MIN, SCALE_MAX = 0.8, 1.25
BREATH = 0.35
GAPS = {"meditation": 1.5, "psychology": 0.9}
VALID_BYTES = 44


# scalars


def clamp_scale(value: Column) -> Column:
    return F.round(F.greatest(F.lit(SCALE_MIN), F.least(F.lit(SCALE_MAX), value)), 4)


def wpm_to_scale(natural: Column, target: Column) -> Column:
    """Speaking-length factor for a target rate; 1 where either rate isn't positive."""
    return F.when((natural <= 0) | (target <= 0), F.lit(1.0)).otherwise(clamp_scale(natural / target))


def _whole(value: Column, most: float) -> Column:
    """The value within -most..most as a whole number; halves go to the even one."""
    return F.rint(F.greatest(F.lit(-most), F.least(F.lit(most), value)))


def rate_percent(scale: Column) -> Column:
    return F.format_string("%+.0f%%", _whole((1.0 / scale - 1.0) * 100.0, 30.0))


def pitch_hertz(semitones: Column) -> Column:
    return F.format_string("%+.0fHz", _whole(semitones * 8.0, 40.0))


def hash01(key: Column) -> Column:
    """A number in 0..1 that depends on the text alone."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def jitter_pause(seconds: Column, text: Column) -> Column:
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(F.round(seconds * (0.85 + 0.30 * hash01(F.concat(F.lit("pause:"), text))), 3))


def jitter_rate(text: Column) -> Column:
    return 1.0 + (hash01(F.concat(F.lit("rate:"), text)) - 0.5) * 0.04


def estimate_seconds(words: Column, wpm: Column, pause: Column | None = None) -> Column:
    spoken = words / F.greatest(F.lit(60), wpm) * 60.0
    return F.round(spoken if pause is None else spoken + pause, 3)


def final_scale(base: Column, plan: Column, text: Column, emphasis: Column) -> Column:
    return clamp_scale(base * plan * jitter_rate(text) * F.when(emphasis, F.lit(1.05)).otherwise(F.lit(1.0)))


def chunk_key(*parts: Column) -> Column:
    """Content address of a chunk: 24 hexadecimal digits of a SHA-1 over its parts."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 24)


def safe_name(name: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")), F.lit(""))


def ends_sentence(text: Column) -> Column:
    return F.right(F.rtrim(text), F.lit(3)).rlike(r"[.!?।]$")  # a line's end may follow


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


# lookups


def lookup(df: DataFrame, dim: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Left join with a dimension of fixed size."""
    return df.join(F.broadcast(dim), on, "left")


def with_voice(df: DataFrame, engine: str = "engine", voice: str = "voice_id", defaults: dict[str, str] = D.NARRATOR) -> DataFrame:
    """``df`` with ``voice_final``: the voice if the catalog has it, else its engine's default."""
    known = D.voices(df.sparkSession).select(F.col("voice_id").alias("_voice"))
    default = F.lit(None)
    for k, v in defaults.items():
        default = F.when(F.col(engine) == k, F.lit(v)).otherwise(default)
    return lookup(df, known, F.col(voice) == F.col("_voice")).withColumn("voice_final", F.coalesce("_voice", default)).drop("_voice")


def with_preset(df: DataFrame) -> DataFrame:
    """``df`` with its preset's row; an unknown preset takes the default's."""
    key = F.replace(F.upper("preset"), F.lit("-"), F.lit("_"))
    known = [r[0] for r in D.PRESETS]
    return lookup(df.withColumn("preset", F.when(key.isin(known), key).otherwise(D.DEFAULT_PRESET)), D.presets(df.sparkSession), "preset")


def with_profile(df: DataFrame) -> DataFrame:
    key = F.upper("emotion")
    known = [r[0] for r in D.PROFILES]
    return lookup(df.withColumn("emotion", F.when(key.isin(known), key).otherwise("NEUTRAL")), D.profiles(df.sparkSession), "emotion")


def plan_prosody(df: DataFrame, strength: float = 0.7) -> DataFrame:
    """``df`` (emotion, effects, pauses, preset) with the plan's scale, pauses, intensity and pitch."""
    s = F.lit(max(0.0, min(1.0, strength)))
    whisper = F.array_contains("effects", "whisper")
    rate = 1.0 + (F.col("rate_scale") - 1.0) * s
    pause = F.col("pause_scale") * F.col("preset_pause_scale")
    return with_profile(with_preset(df)).withColumns(
        {
            "plan_scale": F.round(F.when(whisper, rate * 1.05).otherwise(rate), 4),
            "plan_before": F.round(F.col("pause_before") * pause, 3),
            "plan_after": F.round(F.col("pause_after") * pause, 3),
            "plan_intensity": F.round(F.when(whisper, F.greatest(F.col("intensity") * s, F.lit(0.6))).otherwise(F.col("intensity") * s), 3),
            "plan_pitch": F.col("pitch_semitones") * s,
        }
    )


# plans and caches


def cache_hits(plan: DataFrame, cache: DataFrame) -> DataFrame:
    return plan.join(cache.where(F.col("size_bytes") > VALID_BYTES).select("key"), "key", "left_semi")


def cache_misses(plan: DataFrame, cache: DataFrame) -> DataFrame:
    return plan.join(cache.where(F.col("size_bytes") > VALID_BYTES).select("key"), "key", "left_anti")


def cache_flags(plan: DataFrame, cache: DataFrame) -> DataFrame:
    """``plan`` with ``hit``: hits and misses by one join."""
    valid = cache.where(F.col("size_bytes") > VALID_BYTES).select("key", F.lit(True).alias("hit")).distinct()
    return plan.join(valid, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_stats(cache: DataFrame, *by: str) -> DataFrame:
    return cache.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_bytes"))


def plan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, state): added, removed or kept, by one full outer join."""
    side = lambda df, c: df.select("key", F.lit(True).alias(c)).distinct()
    both = side(old, "_old").join(side(new, "_new"), "key", "full_outer")
    return both.select("key", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept").alias("state"))


def all_voices(catalog: DataFrame, *engines: str) -> DataFrame:
    """The voices of the engines, one catalog after the other."""
    return catalog.where(F.col("engine").isin(*engines))


def voices_for_engine(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` with ``voices``, those of the row's engine in the catalog's order; a catalog has a fixed size."""
    each = catalog.groupBy("engine").agg(F.sort_array(F.collect_list(F.struct("pos", "voice_id"))).alias("_v"))
    return rows.join(F.broadcast(each), "engine", "left").withColumn("voices", F.coalesce(F.transform("_v", lambda x: x["voice_id"]), F.array().cast("array<string>"))).drop("_v")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def relocate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``path`` pointing at the cached file of the same base name, where there is one; of several the first by its path."""
    f = files.where("path is not null").groupBy(base_name(F.col("path")).alias("_base")).agg(F.min("path").alias("_path"))
    return rows.join(f, base_name(F.col("path")) == F.col("_base"), "left").withColumn("path", F.coalesce("_path", "path")).drop("_base", "_path")


def resume_plan(plan: DataFrame, results: DataFrame) -> DataFrame:
    """``plan`` with state, path and seconds: finished chunks keep theirs, the rest is pending.

    A key counts as finished if one of its results is done and has a path; of several the last by its path, then its seconds.
    """
    done = results.where((F.col("status") == "done") & F.col("path").isNotNull())
    r = done.groupBy("key").agg(F.max(F.struct("path", "seconds")).alias("_r"))
    has = F.col("_r").isNotNull()
    return plan.join(r, "key", "left").select(*plan.columns, F.when(has, "done").otherwise("pending").alias("state"), F.col("_r.path").alias("path"), F.col("_r.seconds").alias("seconds"))


def recoverable(saves: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(project, source, at, file): what each project opens with, its last snapshot if that is newer than its last save.

    Both sides: project, at, file. A project without a save opens with its snapshot, one without a snapshot with its save;
    at the same time the save counts. Rows without a time count only where a project has no other.
    """
    last = lambda df, c: df.groupBy("project").agg(F.max(F.struct("at", "file")).alias(c))
    both = last(saves, "_save").join(last(snapshots, "_snap"), "project", "full_outer")
    newer = F.col("_save").isNull() | F.coalesce(F.col("_snap.at") > F.col("_save.at"), F.col("_save.at").isNull() & F.col("_snap.at").isNotNull())
    pick = F.when(newer, F.col("_snap")).otherwise(F.col("_save"))
    return both.withColumns({"source": F.when(newer, "snapshot").otherwise("save"), "_x": pick}).select("project", "source", F.col("_x.at").alias("at"), F.col("_x.file").alias("file"))


def latest(df: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# timelines


def timeline(df: DataFrame, by: str, order: str, before: Column, seconds: Column, after: Column, gap: Column | None = None) -> DataFrame:
    """``df`` with start_seconds: a running cursor over the rows of ``by``. A ``gap`` is added to the silence ahead of its row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if gap is not None:  # gaps look back a row themselves: they are worked out ahead of the cursor
        df = df.withColumn("_gap", gap)
        return timeline(df, by, order, before + F.col("_gap"), seconds, after).drop("_gap")
    return df.withColumn("start_seconds", F.coalesce(F.sum(before + seconds + after).over(w), F.lit(0.0)) + before)


def character_gap(text: Column, by: str, order: str, character: str) -> Column:
    """Extra silence before a chunk whose predecessor ends a sentence."""
    before = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    return F.when(F.rtrim(before).rlike("[।!?.；]$"), F.lit(GAPS.get(character, 0.0))).otherwise(F.lit(0.0))


def pacing(by: str, order: str, seconds: float) -> Column:
    return (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) * F.lit(seconds)


def progress(df: DataFrame, by: str, order: str, elapsed: Column) -> DataFrame:
    w = Window.partitionBy(by)
    done, n = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    return df.withColumns({"percent": done / n * 90.0, "eta": (n - done) * elapsed / done})


# failures


def triage(log: DataFrame) -> DataFrame:
    """``log`` (status, body, retry_after, attempt) with reason, class, retryable and the wait before the next attempt."""
    message = F.get_json_object("body", "$.error.message")
    text = F.when(F.trim("body").startswith("{") & (F.coalesce(message, F.lit("")) != ""), message).otherwise(F.col("body"))
    s = F.col("status")
    return log.withColumns(
        {
            "reason": F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 220),
            "failure": F.when(s.isin(400, 401, 403), "rejected").when(s == 404, "not_found").when(s == 429, "quota").otherwise("failed"),
            "retryable": s.isin(429, 500, 502, 503),
            "wait_seconds": F.when(F.col("retry_after").isNotNull(), F.least(F.col("retry_after"), F.lit(60.0))).otherwise(2.0 * (F.col("attempt") + 1)),
        }
    )


def correct_rate(df: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """``df`` (actual_wpm, target_wpm, scale) with deviation and the scale of a retry, null where none is due or nothing was heard."""
    off = F.when(F.col("actual_wpm") > 0, F.abs(F.col("actual_wpm") - F.col("target_wpm")) / F.col("target_wpm"))
    return df.withColumn("deviation", F.round(off, 6)).withColumn("retry_scale", F.when(off > tolerance, clamp_scale(F.col("scale") * F.col("actual_wpm") / F.col("target_wpm"))))


def keep_closer(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """``df`` (actual_wpm, target_wpm) with attempt, from 1 in the given order, and ``kept``: the attempt nearest to its target.

    A retry is kept only if it is closer than all before it. A first attempt without a rate is kept, a retry without one isn't.
    """
    off = F.abs(F.col("actual_wpm") - F.col("target_wpm")) / F.col("target_wpm")
    rows = df.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    far = F.when(F.col("actual_wpm") > 0, off).when(F.col("attempt") == 1, 0.0).otherwise(float("inf"))
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*by).orderBy(far, "attempt")) == 1)


# voices and styles


def chunk_gain(effects: Column) -> Column:
    """Decibels that a chunk's effects add."""
    return F.when(F.array_contains(effects, "emphasis"), 1.5).otherwise(0.0)


def in_order(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``place``, from 1 within ``by``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def find_by_style(wanted: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, voice_id) for each row of ``wanted`` (key, style, gender): the catalog's first voice of that style, and of that gender unless it is empty."""
    v = catalog.select("pos", "voice_id", F.lower("style").alias("_style"), F.col("gender").alias("_gender"))
    met = lookup(wanted, v, (F.lower("style") == F.col("_style")) & ((F.col("gender") == "") | (F.lower("gender") == F.col("_gender"))))
    return met.groupBy(key).agg(F.min_by("voice_id", "pos").alias("voice_id"))


def style_direction(emotion: Column, preset: Column, strength: float = 0.7) -> Column:
    """Style direction of an emotion and a preset, with a word for the pace."""
    styles, rates = dict(D.EMOTION_STYLE), {e: r for e, r, *_ in D.PROFILES}
    style = F.lit(None)
    for e, t in styles.items():
        blended = 1.0 + (rates[e] - 1.0) * strength
        word = "slowly" if blended > 1.06 else "quickly" if blended < 0.94 else ""
        style = F.when(emotion == e, F.lit(f"{t}, {word}" if word and word not in t else t)).otherwise(style)
    style = F.coalesce(style, F.lit(styles["NEUTRAL"]))
    tail = F.lit("")
    for p, t in D.PRESET_DIRECTION:
        tail = F.when(preset == p, F.lit(f", {t}")).otherwise(tail)
    return F.concat(style, F.when(emotion == "NEUTRAL", tail).otherwise(F.lit("")))
