"""Onset bins, flux and evidence runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signal import BAND_SCALE, RMS_SCALE, magnitude
from ..functions.tempo import div
from .waveform import islands


def bins(samples: DataFrame, frames: int) -> DataFrame:
    """(track_id, bin, sum_absolute, sample_count, complete)."""
    out = samples.groupBy("track_id", div(F.col("frame"), frames).alias("bin")).agg(F.sum(magnitude(F.col("x"), BAND_SCALE)).alias("sum_absolute"), F.count("*").alias("sample_count"))
    return out.withColumn("complete", F.col("sample_count") == frames)


def fine(samples: DataFrame, frames: int) -> DataFrame:
    """``waveform.accumulators`` of small columns with ``sum_absolute`` and ``last_frame``: one pass over the samples that columns, tiles and bins of any multiple are rolled up from."""
    m, a = magnitude(F.col("x"), RMS_SCALE), magnitude(F.col("x"), BAND_SCALE)
    return samples.groupBy("track_id", div(F.col("frame"), frames).alias("column_index")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(m * m).alias("sum_squares"), F.count("*").alias("n"), F.max(F.abs(F.col("x")) >= 1).alias("clipped"), F.sum(a).alias("sum_absolute"), F.max("frame").alias("last_frame")
    )


def rolled_bins(parts: DataFrame, factor: int, frames: int) -> DataFrame:
    """``bins`` of ``frames`` frames, each of ``factor`` columns of ``fine``."""
    out = parts.groupBy("track_id", div(F.col("column_index"), factor).alias("bin")).agg(F.sum("sum_absolute").alias("sum_absolute"), F.sum("n").alias("sample_count"))
    return out.withColumn("complete", F.col("sample_count") == frames)


def energy(total, n):
    return total / (n * F.lit(float(BAND_SCALE)))


def evidence(b: DataFrame, capacity: int) -> DataFrame:
    """(track_id, first_bin, end_bin): the longest run of complete bins among the last ``capacity``, of equal ones the first."""
    newest = b.groupBy("track_id").agg(F.max("bin").alias("newest"))
    held = b.filter("complete").join(newest, "track_id").filter(F.col("bin") > F.col("newest") - capacity)
    runs = islands(held, ["track_id"], "bin")
    best = runs.groupBy("track_id").agg(F.max(F.struct("length", (-F.col("first")).alias("n"))).alias("b"))
    return best.select("track_id", (-F.col("b.n")).alias("first_bin"), (F.col("b.length") - F.col("b.n")).alias("end_bin"))


def flux(b: DataFrame, run: DataFrame, window_bins: int | None = None) -> DataFrame:
    """(track_id, bin, flux): rises of energy inside the evidence; each window's first bin has no bin before it."""
    inside = b.join(run, "track_id").filter("bin >= first_bin and bin < end_bin")
    e = inside.select("track_id", "bin", (F.col("bin") - F.col("first_bin")).alias("offset"), energy(F.col("sum_absolute"), F.col("sample_count")).alias("e"))
    keys = ["track_id"]
    if window_bins:
        e = e.withColumn("window", div(F.col("offset"), window_bins))
        keys.append("window")
    before = F.lag("e", 1, 0.0).over(W.partitionBy(*keys).orderBy("bin"))
    return e.select(*keys, "bin", "offset", F.greatest(F.lit(0.0), F.col("e") - before).alias("flux"))
