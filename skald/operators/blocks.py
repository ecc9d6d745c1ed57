"""Clips as blocks: (clip_id, block, amps), arrays of ``size`` samples, the last of a clip being shorter. No row per sample.

Blocks are cut, measured, placed and summed by array expressions. Two things run in Arrow batches: the maximum ahead of each
sample, linear whatever the look-ahead, and the follower, whose level is carried from one batch to the next. All else
works on a row per block or per hop. Null samples are places where nothing is; blocks without samples have no peak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skald.operators.signal import FLOOR, decibels, power_db

#: Parts that the clips over one timeline block are divided into before they are summed.
SALTS = 16


def per(by: str, order: str = "block") -> Window:
    return Window.partitionBy(by).orderBy(order)


def cut(clips: DataFrame, size: int) -> DataFrame:
    """Blocks of whole clips (clip_id, amps); other columns are kept."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("amps") - 1), F.lit(size))
    each = F.transform(starts, lambda i: F.slice("amps", i + 1, F.lit(size)))
    return clips.select(*(c for c in clips.columns if c != "amps"), F.posexplode(each).alias("block", "amps"))


def spread(rows: DataFrame, at: Column, total: Column | None, size: int) -> DataFrame:
    """``rows`` (amps) cut where blocks of ``size`` begin: cell, offset in it and piece; ``at`` is the place of the first sample."""
    low, high = F.greatest(at, F.lit(0)), at + F.size("amps")
    high = high if total is None else F.least(high, total)
    rows = rows.withColumns({"_at": at.cast("long"), "_low": low.cast("long"), "_high": high.cast("long")}).where("_high > _low")
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor((F.col("_high") - 1) / size))))
    start = F.greatest(F.col("_low"), F.col("cell") * size)
    stop = F.least(F.col("_high"), (F.col("cell") + 1) * size)
    piece = F.slice("amps", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int"))
    return rows.withColumns({"piece": piece, "offset": (start - F.col("cell") * size).cast("int")}).drop("amps", "_at", "_low", "_high")


def reblock(blocks: DataFrame, size: int, to: int) -> DataFrame:
    """The same clips in blocks of ``to`` samples."""
    pieces = spread(blocks.select("clip_id", "block", "amps"), F.col("block") * size, None, to)
    rows = pieces.groupBy("clip_id", "cell").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("p"))
    return rows.select("clip_id", F.col("cell").cast("int").alias("block"), F.flatten(F.transform("p", lambda x: x["piece"])).alias("amps"))


def peak(amps: Column) -> Column:
    return F.array_max(F.transform(amps, F.abs))


def squares(amps: Column) -> Column:
    return F.aggregate(amps, F.lit(0.0), lambda a, x: a + x * x)


def levels(blocks: DataFrame) -> DataFrame:
    """(clip_id, block, peak, energy, n): each block measured once; energy is the mean square."""
    n = F.size("amps")
    return blocks.select("clip_id", "block", peak(F.col("amps")).alias("peak"), F.when(n > 0, squares(F.col("amps")) / n).alias("energy"), n.alias("n"))


def windows(hops: DataFrame, k: int) -> DataFrame:
    """``hops`` (clip_id, block, energy, n) with total and m: energy and samples of ``k`` hops from each on, as differences of prefix sums."""
    w = per("clip_id")
    sums = hops.withColumns({"_s": F.sum(F.col("energy") * F.col("n")).over(w), "_m": F.sum("n").over(w), "_i": F.row_number().over(w)})
    ahead = lambda c: F.lead(c, k - 1).over(w) if k > 1 else F.col(c)
    out = sums.withColumns({"_to": ahead("_s"), "_mto": ahead("_m")}).where("_to is not null")
    return out.withColumns({"total": F.greatest(F.lit(0.0), F.col("_to") - F.col("_s") + F.col("energy") * F.col("n")), "m": F.col("_mto") - F.col("_m") + F.col("n")}).drop("_s", "_m", "_i", "_to", "_mto")


def gated_level(hops: DataFrame, size: int, hop: int, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(clip_id, gated_level_db): mean energy of overlapping windows of ``size`` samples through an absolute and a relative gate.

    ``hops`` are levels of blocks of ``hop`` samples. Clips without a window over the gate are at the absolute gate.
    """
    whole = windows(hops, size // hop).where(F.col("m") == size).select("clip_id", (F.col("total") / size).alias("energy"))
    loud = whole.where(power_db(F.col("energy")) > absolute)
    gate = F.avg("energy").over(Window.partitionBy("clip_id")) * (10 ** (relative / 10))
    kept = loud.withColumn("gate", gate).where("energy > gate").groupBy("clip_id").agg(power_db(F.avg("energy")).alias("level"))
    every = hops.groupBy("clip_id").agg(F.lit(absolute).alias("_floor"))
    return every.join(kept, "clip_id", "left").select("clip_id", F.coalesce("level", "_floor").alias("gated_level_db"))


def short_term(hops: DataFrame, width: int) -> DataFrame:
    """(clip_id, block, level_db) of each ``width`` hops in a row, by their mean energy."""
    even = hops.withColumn("n", F.lit(1))
    return windows(even, width).select("clip_id", "block", power_db(F.col("total") / width).alias("level_db"))


# the maximum ahead


def forward_max(x: np.ndarray, n: int, ahead: int) -> np.ndarray:
    """``max(x[i : i + ahead + 1])`` for the first n places: the end of one run of ``ahead + 1`` and the start of the next."""
    w = ahead + 1
    padded = np.full(-(-(n + ahead) // w) * w, -np.inf)
    padded[: min(len(x), len(padded))] = x[: len(padded)]
    runs = padded.reshape(-1, w)
    start = np.maximum.accumulate(runs, axis=1).ravel()
    end = np.maximum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(end[:n], start[ahead : ahead + n])


def lookahead_gain(blocks: DataFrame, size: int, ceiling: float, ahead: int) -> DataFrame:
    """(clip_id, block, gain array): the gain that keeps the next ``ahead`` samples under the ceiling.

    A block sees the head of the next one; blocks shorter than the look-ahead are joined to longer ones first.
    """
    if size <= ahead:
        size, blocks = ahead + 1, reblock(blocks, size, ahead + 1)
    following = F.coalesce(F.lead(F.slice("amps", 1, ahead)).over(per("clip_id")), F.array().cast("array<double>")) if ahead else F.array().cast("array<double>")

    @F.pandas_udf("array<double>")
    def gains(own: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(own, n, strict=True):
            top = forward_max(np.nan_to_num(np.abs(np.asarray(x, np.float64))), int(m), ahead)
            out.append(np.minimum(ceiling / np.maximum(top, FLOOR), 1.0))
        return pd.Series(out)

    seen = blocks.select("clip_id", "block", F.concat("amps", following).alias("seen"), F.size("amps").alias("n"))
    return seen.select("clip_id", "block", gains("seen", "n").alias("gain"))


# the follower


def follow(df: DataFrame, by: str, order: str, value: str, attack: float, release: float, start: float = 0.0, out: str = "env") -> DataFrame:
    """``df`` with ``out``: towards a larger value by ``attack``, towards a smaller by ``release``; 0 is at once.

    Rows stream by ``by`` and ``order`` and only the level is carried on, so a clip of any length takes linear time and no
    memory. A null value leaves the level as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, begun = None, start, False
        for b in batches:
            smooth = np.empty(b.num_rows)
            for i, (k, v) in enumerate(zip(b.column(by).to_pylist(), b.column(value).to_pylist(), strict=True)):
                if not begun or k != key:
                    key, level, begun = k, start, True
                if v is not None:
                    level += (v - level) * (1.0 - (attack if v > level else release))
                smooth[i] = level
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(smooth)], [*b.schema.names, out])

    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def compress(env: DataFrame, threshold_db: float, ratio: float) -> DataFrame:
    """(clip_id, block, gain_db) of followed blocks (clip_id, block, env), with make-up of 0.7 of the mean reduction."""
    cut_db = F.greatest(decibels(F.col("env")) - threshold_db, F.lit(0.0)) * (1.0 / ratio - 1.0)
    return env.withColumn("cut", cut_db).select("clip_id", "block", (F.col("cut") - 0.7 * F.avg("cut").over(Window.partitionBy("clip_id"))).alias("gain_db"))


# timelines


def place(blocks: DataFrame, events: DataFrame, total: int, size: int) -> DataFrame:
    """(mix_id, clip_id, track, cell, offset, piece): clip blocks on the timeline, each cut at the timeline block that it runs into.

    ``events``: mix_id, clip_id, track, start. What lies before 0 or beyond ``total`` is dropped.
    """
    at = blocks.select("clip_id", "block", "amps").join(events.select("mix_id", "clip_id", "track", "start"), "clip_id")
    return spread(at, F.col("start") + F.col("block") * size, F.lit(total), size).select("mix_id", "clip_id", "track", "cell", "offset", "piece")


def gap(n: Column | int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def added(arrays: Column, size: int) -> Column:
    """Element by element the sum of an array of arrays; null where all are null."""
    both = lambda x, y: F.coalesce(x + y, x, y)
    return F.aggregate(arrays, gap(size), lambda a, x: F.zip_with(a, x, both))


def sum_pieces(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, amps): pieces of one cell summed, first within parts of its clips."""
    wide = pieces.select(*keys, F.pmod(F.xxhash64("clip_id", "offset"), F.lit(SALTS)).alias("_salt"), F.concat(gap(F.col("offset")), F.transform("piece", lambda x: x.cast("double")), gap(size - F.col("offset") - F.size("piece"))).alias("x"))
    part = wide.groupBy(*keys, "_salt").agg(F.collect_list("x").alias("x")).select(*keys, added(F.col("x"), size).alias("x"))
    return part.groupBy(*keys).agg(F.collect_list("x").alias("x")).select(*keys, added(F.col("x"), size).alias("amps"))


def activity(stems: DataFrame) -> DataFrame:
    """(mix_id, cell, active) of the cells where the voice has samples."""
    voice = stems.where("track = 'VOICE'").select("mix_id", "cell", peak(F.col("amps")).alias("peak"))
    return voice.select("mix_id", "cell", (F.col("peak") > F.greatest(0.06 * F.max("peak").over(Window.partitionBy("mix_id")), F.lit(1e-6))).alias("active"))


def smooth_activity(active: DataFrame, cells: int, attack: float, release: float) -> DataFrame:
    """(mix_id, cell, a): the voice's activity in 0..1 over every cell of the timeline, followed."""
    mixes = active.select("mix_id").distinct().select("mix_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    target = mixes.join(active, ["mix_id", "cell"], "left").select("mix_id", "cell", F.coalesce(F.col("active").cast("double"), F.lit(0.0)).alias("target"))
    return follow(target, "mix_id", "cell", "target", attack, release, 0.0, "a")


def duck(stem: DataFrame, smoothed: DataFrame, depth_db: Column, size: int) -> DataFrame:
    """``stem`` (mix_id, track, cell, amps) times the gain of the smoothed activity, in a straight line from middle to middle of the cells."""
    w = per("mix_id", "cell")
    sides = smoothed.select("mix_id", "cell", "a", F.coalesce(F.lag("a").over(w), "a").alias("_before"), F.coalesce(F.lead("a").over(w), "a").alias("_after"))
    half, lost = size / 2, 1.0 - F.pow(F.lit(10.0), -depth_db / 20.0)
    rows = stem.join(sides, ["mix_id", "cell"], "left").withColumn("_lost", lost)
    a = lambda i: F.when(i < half, F.col("_before") + (F.col("a") - F.col("_before")) * (i + half) / size).otherwise(F.col("a") + (F.col("_after") - F.col("a")) * (i - half) / size)
    ducked = F.transform("amps", lambda x, i: x * (1.0 - F.col("_lost") * a(i)))
    return rows.withColumn("amps", F.when(F.col("a").isNull(), F.col("amps")).otherwise(ducked)).select(*stem.columns)


def mixdown(blocks: DataFrame, events: DataFrame, total: int, size: int, ducking_db: float, smooth: tuple[float, float] | None = None) -> DataFrame:
    """(mix_id, cell, amps): clips placed, music and ambience ducked under the voice, summed and guarded; null samples are gaps.

    Ambience is ducked by a third, by 3 dB at least. With ``smooth`` (attack, release) the ducking glides; without, each cell
    is ducked as a whole.
    """
    stems = sum_pieces(place(blocks, events, total, size), ["mix_id", "track", "cell"], size)
    active = activity(stems)
    depth = F.when(F.col("track") == "MUSIC", ducking_db).when(F.col("track") == "AMBIENCE", max(3.0, ducking_db / 3)).otherwise(0.0)
    if smooth:
        ducked = duck(stems, smooth_activity(active, -(-total // size), *smooth), depth, size)
    else:
        level = F.when(F.col("active"), F.pow(F.lit(10.0), -depth / 20.0)).otherwise(F.lit(1.0))
        ducked = stems.join(active, ["mix_id", "cell"], "left").withColumn("_level", level).select("mix_id", "track", "cell", F.transform("amps", lambda x: x * F.col("_level")).alias("amps"))
    mixed = ducked.groupBy("mix_id", "cell").agg(F.collect_list("amps").alias("x")).select("mix_id", "cell", added(F.col("x"), size).alias("amps"))
    tops = mixed.groupBy("mix_id").agg(F.max(peak(F.col("amps"))).alias("_top"))
    return mixed.join(tops, "mix_id").select("mix_id", "cell", F.when(F.col("_top") > 1.0, F.transform("amps", lambda x: x / F.col("_top"))).otherwise(F.col("amps")).alias("amps"))
