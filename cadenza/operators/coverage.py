"""Range algebra: accepted ranges, gaps, conflicts, states of requested ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ABSENT, MAX_PUSH_FRAMES, PARTIAL
from ..functions.ranges import Accepted, contains, overlaps
from ..functions.tempo import div
from .waveform import islands


#: Range joins and first steps of unions go by stretches of 2**18 frames of a track, so that a long track is many keys.
STRETCH = 18


def _union(rows: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("first_frame", "end_frame")
    reach = F.max("end_frame").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("first_frame") > reach if touching else F.col("first_frame") >= reach
    marked = rows.select(*keys, "first_frame", "end_frame", F.coalesce(apart, F.lit(True)).cast("int").alias("new"))
    island = marked.withColumn("island", F.sum("new").over(order))  # equal blocks are peers, of one island
    return island.groupBy(*keys, "island").agg(F.min("first_frame").alias("first_frame"), F.max("end_frame").alias("end_frame")).drop("island")


def accepted_ranges(blocks: DataFrame, touching: bool = True) -> DataFrame:
    """(track_id, first_frame, end_frame): the union of the blocks; touching ones join.

    Blocks that start in one stretch of a track are joined first, so only what is left of each stretch meets by track.
    """
    cut = blocks.select("track_id", "first_frame", "end_frame", F.shiftright("first_frame", STRETCH).alias("__stretch"))
    return _union(_union(cut, ["track_id", "__stretch"], touching).drop("__stretch"), ["track_id"], touching)


def stretches(first: Column, end: Column, shift: int = STRETCH) -> Column:
    """The stretches that a range lies in; an empty one lies in none."""
    return F.when(first < end, F.sequence(F.shiftright(first, shift), F.shiftright(end - 1, shift)))


def meetings(rows: DataFrame, ranges: DataFrame, shift: int = STRETCH) -> DataFrame:
    """``rows`` (track_id, first_frame, end_frame, ...), each once with a null range and once with every range of its track that it overlaps.

    The columns of ``ranges`` come back with ``v_`` before their names; ``__base`` is 1 in the row without a range, else 0.
    The join is on track and stretch, and a pair counts in the stretch where the later of the two starts, so it comes up once.
    """
    v = ranges.select(*(F.col(c).alias(f"v_{c}") for c in ranges.columns))
    base = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in v.dtypes), F.lit(1).alias("__base"))
    left = rows.distinct().withColumn("__at", F.explode(stretches(F.col("first_frame"), F.col("end_frame"), shift)))
    right = v.withColumn("__vat", F.explode(stretches(F.col("v_first_frame"), F.col("v_end_frame"), shift)))
    late = F.greatest(F.shiftright("first_frame", shift), F.shiftright("v_first_frame", shift))
    on = (F.col("v_track_id") == F.col("track_id")) & (F.col("__vat") == F.col("__at")) & overlaps(F.col("first_frame"), F.col("end_frame"), F.col("v_first_frame"), F.col("v_end_frame"))
    pairs = left.join(right, on).filter(F.col("__at") == late).drop("__at", "__vat").withColumn("__base", F.lit(0))
    return base.unionByName(pairs)


def folded(met: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """One row for each of the rows that went into ``meetings``, equal ones too, with aggregates over the ranges it met."""
    out = met.groupBy(*columns).agg(*aggregates, F.sum("__base").alias("__times"))
    return out.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).drop("__times")


def missing_ranges(accepted: DataFrame, totals: DataFrame) -> DataFrame:
    """(track_id, first_frame, end_frame) of [0, total_frames) that no accepted range covers."""
    ends = accepted.select("track_id", "first_frame", "end_frame")
    edge = totals.select("track_id", F.col("total_frames").alias("first_frame"), F.col("total_frames").alias("end_frame"))
    before = F.coalesce(F.lag("end_frame").over(W.partitionBy("track_id").orderBy("first_frame", "end_frame")), F.lit(0))
    gaps = ends.unionByName(edge).select("track_id", before.alias("first_frame"), F.col("first_frame").alias("end_frame"))
    return gaps.filter("first_frame < end_frame")


def first_missing(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """``requests`` with (missing_first, missing_end): the first part of each range that isn't accepted; null where all is.

    Accepted ranges must be disjoint and not touch.
    """
    ranges = accepted.select("track_id", "first_frame", "end_frame")
    # the range that covers the request's start, and the first that begins after it
    covers = F.col("v_first_frame") <= F.col("first_frame")
    agg = folded(meetings(requests, ranges), requests.columns, F.max(F.when(covers, F.col("v_end_frame"))).alias("c"), F.min(F.when(~covers, F.col("v_first_frame"))).alias("n"))
    start = F.coalesce("c", "first_frame")
    # a disjoint range never starts at the end of the one that covers the start
    end = F.least(F.coalesce("n", "end_frame"), F.col("end_frame"))
    whole = start >= F.col("end_frame")
    return agg.select(*requests.columns, F.when(~whole, start).alias("missing_first"), F.when(~whole, end).alias("missing_end"))


def acceptance(blocks: DataFrame, serial: str = "request_id", limit: int = MAX_PUSH_FRAMES) -> DataFrame:
    """``blocks`` (track_id, first_frame, end_frame, ...) with ``accepted_frames`` and ``status``, as pushed in the order of ``serial``.

    Of a block counts the longest prefix that meets no range accepted before; a block that starts inside one is a
    conflict and leaves no trace.  What a block may take is ``limit`` frames from its start, so blocks that
    overlap no other within these are taken as they are, and the others fall into regions that don't touch
    each other's frames: a region, not a track, is folded in order by one task.
    """
    reach = F.least(F.col("end_frame"), F.col("first_frame") + limit)
    good = (F.col("first_frame") < F.col("end_frame")) & (F.col("first_frame") >= 0)
    mine = blocks.select(F.col("track_id"), F.col(serial).alias("serial"), "first_frame", F.col("end_frame").alias("block_end"), reach.alias("end_frame")).filter(good)
    regions = accepted_ranges(mine, touching=False)
    placed = meetings(mine, regions).filter("__base = 0").select("track_id", "serial", "first_frame", "block_end", F.col("v_first_frame").alias("region"))
    sizes = placed.groupBy("track_id", "region").agg(F.count("*").alias("__n"))
    placed = placed.join(sizes, ["track_id", "region"])
    kinds = dict(placed.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held = pdf.sort_values("serial"), Accepted()
        got = [held.push(int(f), int(e) - int(f), limit) for f, e in zip(pdf["first_frame"], pdf["block_end"], strict=True)]
        return pd.DataFrame({"track_id": pdf["track_id"], "serial": pdf["serial"], "accepted_frames": [n for n, _ in got], "status": [s for _, s in got]})

    several = placed.filter("__n > 1").groupBy("track_id", "region").applyInPandas(run, f"track_id {kinds['track_id']}, serial {kinds['serial']}, accepted_frames long, status string")
    count = F.col("block_end") - F.col("first_frame")
    taken = F.least(count, F.lit(limit))
    single = placed.filter("__n = 1").select("track_id", "serial", taken.cast("long").alias("accepted_frames"), F.when(taken == count, "OK").otherwise("MORE_WORK").alias("status"))
    got = several.unionByName(single).withColumnRenamed("serial", serial)
    out = blocks.join(got, ["track_id", serial], "left")
    return out.select(*blocks.columns, F.coalesce("accepted_frames", F.lit(0)).alias("accepted_frames"), F.coalesce("status", F.lit("INVALID")).alias("status"))


def ended(tracks: DataFrame) -> DataFrame:
    """(track_id, known_total, accepted_end, final_end, earlier_end) with ``status``: a track's end can be given once, again only alike, and neither off a known length nor before accepted frames."""
    again = F.when(F.col("earlier_end") == F.col("final_end"), "OK").otherwise("CONFLICT")
    bad = (F.col("known_total") != F.col("final_end")) | (F.col("accepted_end") > F.col("final_end"))
    status = F.when(F.col("final_end").isNull(), "INVALID").when(F.col("earlier_end").isNotNull(), again).when(F.coalesce(bad, F.lit(False)), "CONFLICT").otherwise("OK")
    return tracks.withColumn("status", status)


def validated(blocks: DataFrame, total_frames: int | None = None, planes: int | None = None) -> DataFrame:
    """``blocks`` (first_frame, frame_count) with an ``error``: null for good ones.

    With columns ``data`` and ``planes`` (an array), interleaved samples must come in ``data`` alone; where ``planes`` says that the
    source is planar, they must come in exactly so many planes from the first on, and no ``data``.
    """
    error = F.when(F.col("frame_count") <= 0, "empty").when(F.col("first_frame") < 0, "negative")
    error = error.when(F.col("first_frame") > F.lit((1 << 63) - 1) - F.col("frame_count"), "overflow")
    if total_frames is not None:
        error = error.when(F.col("first_frame") + F.col("frame_count") > total_frames, "beyond_end")
    if {"data", "planes"} <= set(blocks.columns):
        given = F.coalesce(F.filter("planes", lambda p: p.isNotNull()), F.array())
        if planes is None:
            error = error.when(F.col("data").isNull() | (F.size(given) > 0), "interleaved")
        else:
            whole = (F.size(given) == planes) & (F.size(F.filter(F.slice("planes", 1, planes), lambda p: p.isNotNull())) == planes)
            error = error.when(F.col("data").isNotNull() | ~F.coalesce(whole, F.lit(False)), "planar")
    return blocks.withColumn("error", error)


def feature_state(requests: DataFrame, values: DataFrame) -> DataFrame:
    """``requests`` with the ``state`` of a feature that holds over ranges (track_id, first, end, state).

    Inside one range it has that state; where it only meets one, it is partial; else it is absent.
    """
    inside = contains(F.col("v_first_frame"), F.col("v_end_frame"), F.col("first_frame"), F.col("end_frame"))
    met = meetings(requests, values.select("track_id", "first_frame", "end_frame", "state"))
    out = folded(met, requests.columns, F.max(F.when(inside, F.col("v_state"))).alias("whole"), F.count("v_state").alias("hits"))
    return out.select(*requests.columns, F.coalesce("whole", F.when(F.col("hits") > 0, PARTIAL), F.lit(ABSENT)).cast("int").alias("state"))


def covered(requests: DataFrame, runs: DataFrame, frames: int, *more: Column) -> DataFrame:
    """``requests`` with ``want`` and ``have``: how many columns (or tiles) of ``frames`` lie below, and how many of them are in ``runs`` (track_id, first, last, ...).

    Runs of columns, not columns, are joined, so the work doesn't grow with a request's length.
    """
    first, end = div(F.col("first_frame"), frames) * frames, (div(F.col("end_frame") - 1, frames) + 1) * frames
    others = [c for c in runs.columns if c not in ("track_id", "first", "last")]
    ranges = runs.select("track_id", (F.col("first") * frames).alias("first_frame"), ((F.col("last") + 1) * frames).alias("end_frame"), *others)
    part = F.when(F.col("__base") == 0, div(F.least(F.col("v_end_frame"), end) - F.greatest(F.col("v_first_frame"), first), frames))
    got = folded(meetings(requests, ranges), requests.columns, F.coalesce(F.sum(part), F.lit(0)).alias("have"), *more)
    return got.withColumn("want", div(end - first, frames))


def tile_state(requests: DataFrame, tiles: DataFrame, tile_frames: int) -> DataFrame:
    """``requests`` with the least ``state`` of the tiles below them where all are there, partial where some are, else absent."""
    runs = islands(tiles.select("track_id", "state", "tile_index"), ["track_id", "state"], "tile_index").drop("length")
    out = covered(requests, runs, tile_frames, F.min("v_state").alias("least"))
    state = F.when(F.col("have") == F.col("want"), F.col("least")).when(F.col("have") > 0, PARTIAL).otherwise(ABSENT)
    return out.select(*requests.columns, state.cast("int").alias("state"))
