"""Sample expressions (gains, fades, saturation), silence, crossfades and the quality gate.

Levels, look-ahead, followers, placing and mixing are in ``blocks``, over arrays of samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

FLOOR = 1e-9


def per_clip(clip: str = "clip_id") -> Window:
    return Window.partitionBy(clip)


def decibels(x: Column) -> Column:
    return 20.0 * F.log10(F.greatest(x, F.lit(FLOOR)))


def power_db(x: Column) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(1e-12)))


def gain(x: Column, db: Column | float) -> Column:
    """``x`` amplified; gains under a hundredth of a decibel are none."""
    db = F.lit(float(db)) if not isinstance(db, Column) else db
    return F.when(F.abs(db) < 0.01, x).otherwise(x * F.pow(F.lit(10.0), db / 20.0))


def fade(x: Column, pos: Column, n: Column, head: int, tail: int, power: float = 1.0) -> Column:
    """Ramps of ``head`` samples in and ``tail`` samples out."""
    shape = lambda r: F.pow(r, F.lit(power)) if power != 1.0 else r
    rise = F.when(pos < head, shape(pos / F.lit(float(max(1, head - 1))))).otherwise(F.lit(1.0))
    fall = F.when(pos >= n - tail, shape((n - 1 - pos) / F.lit(float(max(1, tail - 1))))).otherwise(F.lit(1.0))
    return x * rise * fall


def micro_fade(x: Column, pos: Column, n: Column, head: int, tail: int) -> Column:
    """Raised-cosine edges."""
    rise = F.when(pos < head, 0.5 - 0.5 * F.cos(math.pi * pos / float(head))).otherwise(F.lit(1.0))
    fall = F.when(pos >= n - tail, 0.5 - 0.5 * F.cos(math.pi * (n - 1 - pos) / float(tail))).otherwise(F.lit(1.0))
    return x * rise * fall


def saturate(x: Column, drive: float) -> Column:
    return F.tanh(x * drive) / F.tanh(F.lit(drive))


def peak_guard(x: Column, clip: str = "clip_id", target: float | None = None) -> Column:
    """``x`` over its clip's peak where that is over 1, or scaled to a peak of ``target``."""
    peak = F.max(F.abs(x)).over(per_clip(clip))
    if target is None:
        return F.when(peak > 1.0, x / peak).otherwise(x)
    return F.when(peak > FLOOR, x * (target / peak)).otherwise(x)


def downmix(df: DataFrame) -> DataFrame:
    return df.groupBy("clip_id", "pos").agg(F.avg("amp").alias("amp"))


def silence_runs(blk: DataFrame, threshold: float) -> DataFrame:
    """(clip_id, longest): the longest run of blocks below the threshold; 0 if there is none."""
    w = per_clip().orderBy("block")
    quiet = F.col("peak") < threshold
    mark = blk.withColumn("quiet", quiet).withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("clip_id", "quiet").orderBy("block")))
    runs = mark.groupBy("clip_id", "quiet", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("clip_id").agg(F.coalesce(F.max(F.when(F.col("quiet"), F.col("n"))), F.lit(0)).alias("longest"))


def trim_tail(df: DataFrame, threshold: float, keep: int) -> DataFrame:
    """Samples up to ``keep`` after the last one above the threshold; clips without one stay whole."""
    last = F.max(F.when(F.abs("amp") > threshold, F.col("pos"))).over(per_clip())
    return df.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("pos") < F.col("_last") + keep)).drop("_last")


def crossfade(a: DataFrame, b: DataFrame, overlap: int) -> DataFrame:
    """(pair, pos, amp): b after a, the last ``overlap`` samples of a under the first of b with cosine weights.

    ``a`` has n, its number of samples.
    """
    x = lambda i: F.cos(math.pi / 2 * i / float(max(1, overlap - 1)))
    first = F.col("pos") - (F.col("n") - overlap)
    left = a.select("pair", "pos", F.when(first < 0, F.col("amp")).otherwise(F.col("amp") * x(first) * x(first)).alias("l"))
    ends = a.groupBy("pair").agg(F.first("n").alias("n"))
    shifted = b.join(ends, "pair")
    y = 1.0 - x(F.col("pos")) * x(F.col("pos"))
    right = shifted.select("pair", (F.col("pos") + F.col("n") - overlap).alias("pos"), F.when(F.col("pos") < overlap, F.col("amp") * y).otherwise(F.col("amp")).alias("r"))
    both = left.join(right, ["pair", "pos"], "full_outer")
    return both.select("pair", "pos", (F.coalesce("l", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("amp"))


def quality(blocks: DataFrame, levels: DataFrame, silences: DataFrame, missing: DataFrame, rate: int, target: float, ceiling: float, silent: int) -> DataFrame:
    """(clip_id, duration, peak_db, issues, blocked): the gate's findings; a critical one blocks export. ``blocks``: clip_id, n, peak."""
    stats = blocks.groupBy("clip_id").agg(F.sum("n").alias("n"), F.max("peak").alias("peak"))
    q = stats.join(levels, "clip_id", "left").join(silences, "clip_id", "left").join(missing, "clip_id", "left")
    issue = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    db, seconds = decibels(F.col("peak")), F.col("n") / float(rate)
    found = F.array_compact(
        F.array(
            issue(db >= -0.05, "critical", "clipping"), issue(F.coalesce("missing", F.lit(0)) > 0, "critical", "missing_chunks"),
            issue((seconds > 5) & (F.abs(F.col("gated_level_db") - target) > 3.0), "warning", "loudness"), issue(db > ceiling + 0.3, "warning", "peak"), issue(F.col("longest") >= silent, "warning", "long_silence"),
        )
    )
    return q.select("clip_id", seconds.alias("duration"), F.round(db, 4).alias("peak_db"), found.alias("issues"), F.exists(found, lambda x: x["severity"] == "critical").alias("blocked"))
