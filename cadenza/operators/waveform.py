"""Waveform columns, tiles and spans: tumbling-window summaries with explicit coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import COLUMN_CLIPPED, COLUMN_VALID, UNKNOWN_CONFIDENCE
from ..functions.signal import RMS_SCALE, magnitude, quantize_peak, quantize_rms
from ..functions.tempo import div


def accumulators(samples: DataFrame, frames: int) -> DataFrame:
    """(track_id, column_index, lo, hi, sum_squares, n, clipped): what columns are made of.

    All parts commute and sums are of whole numbers, so partial results of any split of the samples
    merge to the same values; Spark combines them before the shuffle.
    """
    m = magnitude(F.col("x"), RMS_SCALE)
    return samples.groupBy("track_id", div(F.col("frame"), frames).alias("column_index")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(m * m).alias("sum_squares"), F.count("*").alias("n"), F.max(F.abs(F.col("x")) >= 1).alias("clipped")
    )


def merged(acc: DataFrame, factor: int = 1) -> DataFrame:
    """Accumulators of ``factor`` columns each; with 1, of partial columns."""
    return acc.groupBy("track_id", div(F.col("column_index"), factor).alias("column_index")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum_squares").alias("sum_squares"), F.sum("n").alias("n"), F.max("clipped").alias("clipped")
    )


def mono(samples: DataFrame) -> DataFrame:
    """(track_id, frame, channel, x) to (track_id, frame, x): one channel as it is, two as their mean; more end the query with an error."""
    out = samples.groupBy("track_id", "frame").agg(F.sum(F.when(F.col("channel") == 0, F.col("x"))).alias("a"), F.sum(F.when(F.col("channel") == 1, F.col("x"))).alias("b"), F.max("channel").alias("last"))
    x = F.when(F.col("last") > 1, F.raise_error(F.lit("an overview takes one or two channels"))).when(F.col("last") == 1, (F.col("a") + F.col("b")) * 0.5).otherwise(F.col("a"))
    return out.select("track_id", "frame", x.cast("double").alias("x"))


def totals(samples: DataFrame) -> DataFrame:
    """(track_id, total_frames): tracks that end with their last sample."""
    return samples.groupBy("track_id").agg((F.max("frame") + 1).alias("total_frames"))


def complete(acc: DataFrame, frames: int, total: DataFrame | int | None) -> DataFrame:
    """The columns that have all their frames.  The last may be short once a track's end is known, in frames or by track."""
    if total is None:
        return acc.filter(F.col("n") == frames)
    if isinstance(total, int):
        end = F.lit(total)
    else:
        acc, end = acc.join(total, "track_id"), F.col("total_frames")
    want = F.least(F.lit(frames), end - F.col("column_index") * frames)
    return acc.filter(F.col("n") == want).drop("total_frames")


def finalized(acc: DataFrame) -> DataFrame:
    """Quantised columns."""
    flags = F.lit(COLUMN_VALID) + F.when(F.col("clipped"), COLUMN_CLIPPED).otherwise(0)
    return acc.select(
        "track_id", "column_index", quantize_peak(F.col("lo")).alias("minimum"), quantize_peak(F.col("hi")).alias("maximum"),
        quantize_rms(F.col("sum_squares"), F.col("n")).alias("rms"), flags.cast("int").alias("flags"), F.col("n").alias("sample_count"),
    )


def columns(samples: DataFrame, frames: int, total: DataFrame | int | None = None) -> DataFrame:
    return finalized(complete(accumulators(samples, frames), frames, total))


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, first, last, length) of the runs of consecutive values of ``at``, which are distinct.

    Runs are found inside stretches of 4096 values first; only these meet by key.
    """
    cut = rows.select(*keys, F.col(at).alias("at"), F.shiftright(F.col(at).cast("bigint"), 12).alias("__stretch"))
    inside = W.partitionBy(*keys, "__stretch").orderBy("at")
    local = cut.withColumn("run", F.col("at") - F.row_number().over(inside)).groupBy(*keys, "__stretch", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = W.partitionBy(*keys).orderBy("first")
    apart = F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1))
    marked = local.select(*keys, "first", "last", apart.alias("new")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    return out.withColumn("length", F.col("last") - F.col("first") + 1)


def spans(cols: DataFrame, frames: int, total: DataFrame | None = None) -> DataFrame:
    """(track_id, span_index, first_frame, end_frame, first_column, column_count): coverage by complete columns."""
    runs = islands(cols, ["track_id"], "column_index")
    end: Column = (F.col("last") + 1) * frames
    if total is not None:
        runs, end = runs.join(total, "track_id"), F.least(end, F.col("total_frames"))
    index = F.row_number().over(W.partitionBy("track_id").orderBy("first")) - 1
    return runs.select("track_id", index.alias("span_index"), (F.col("first") * frames).alias("first_frame"), end.alias("end_frame"), F.col("first").alias("first_column"), F.col("length").alias("column_count"))


def confidence(cols: DataFrame, frames: int, total: DataFrame) -> DataFrame:
    """(track_id, complete, expected, confidence): the share of columns that are there, in whole per cent; 255 where the length isn't known."""
    have = cols.groupBy("track_id").agg(F.count("*").alias("complete"))
    want = div(F.col("total_frames") + frames - 1, frames)
    out = total.join(have, "track_id", "left").select("track_id", F.coalesce("complete", F.lit(0)).alias("complete"), want.alias("expected"))
    score = F.when(F.col("expected").isNull(), UNKNOWN_CONFIDENCE).when(F.col("expected") == 0, 0).otherwise(div(F.col("complete") * 100, F.col("expected")))
    return out.withColumn("confidence", score.cast("int"))


def tiles(cols: DataFrame, tile_columns: int) -> DataFrame:
    """(track_id, tile_index, first_column, column_count): the columns of each tile."""
    tile = div(F.col("column_index"), tile_columns)
    return cols.groupBy("track_id", tile.alias("tile_index")).agg(F.min("column_index").alias("first_column"), F.count("*").alias("column_count"))


def longest_runs(cols: DataFrame, tile_columns: int) -> DataFrame:
    """(track_id, tile_index, first_column, column_count): the run each tile publishes, its longest, of equal ones the first."""
    tiled = cols.select("track_id", div(F.col("column_index"), tile_columns).alias("tile_index"), "column_index")
    runs = islands(tiled, ["track_id", "tile_index"], "column_index")
    best = runs.groupBy("track_id", "tile_index").agg(F.max(F.struct("length", (-F.col("first")).alias("n"))).alias("b"))
    return best.select("track_id", "tile_index", (-F.col("b.n")).alias("first_column"), F.col("b.length").alias("column_count"))


def recent_tiles(accesses: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` tiles of each track that were used last: (track_id, tile_index, serial) in, with ``recency`` from 1 out.

    A column ``protected`` says on which a request or the focus lies: these stay before all others, and among more of them than
    there is room for the ones used last do.
    """
    if "protected" in accesses.columns:
        held = accesses.groupBy("track_id", "tile_index").agg(F.max("serial").alias("serial"), F.max("protected").alias("protected"))
        order = W.partitionBy("track_id").orderBy(F.desc("protected"), F.desc("serial"), "tile_index")
        return held.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= keep)
    last = accesses.groupBy("track_id", "tile_index").agg(F.max("serial").alias("serial"))
    ranked = last.withColumn("recency", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("serial"), "tile_index")))
    return ranked.filter(F.col("recency") <= keep)


def resumed(prior: DataFrame, later: DataFrame) -> DataFrame:
    """Columns of an earlier result and new ones; where both have one the earlier one stays."""
    fresh = later.join(prior.select("track_id", "column_index"), ["track_id", "column_index"], "left_anti")
    return prior.unionByName(fresh)
