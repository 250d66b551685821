"""Requests: ranking, states and what samples to ask for next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BACKGROUND, CANCELLED, MAX_PUSH_FRAMES, MAX_REQUESTS, PARTLY_SATISFIED, QUEUED, REQUEST_FAILED, SATISFIED, WAITING, Feature
from ..functions.ranges import focus as focus_range
from ..functions.tempo import div, scheduler_priority
from .coverage import covered, first_missing, folded, meetings
from .waveform import islands


def ranked(requests: DataFrame) -> DataFrame:
    """``requests`` of each track by effective priority, deadline, age and id, with ``rank`` from 1."""
    effective = scheduler_priority(F.col("priority"), F.col("skips"))
    has = F.col("deadline") != 0
    order = W.partitionBy("track_id").orderBy(F.desc("effective_priority"), F.desc(has.cast("int")), F.when(has, F.col("deadline")).asc_nulls_last(), "serial", "request_id")
    rows = requests if "serial" in requests.columns else requests.withColumn("serial", F.col("request_id"))
    return rows.withColumn("effective_priority", effective.cast("int")).withColumn("rank", F.row_number().over(order)).drop("serial")


def progress(requests: DataFrame, columns: DataFrame, frames: int, detail: DataFrame | None = None, detail_frames: int = 256) -> DataFrame:
    """``requests`` with ``state`` and ``permille`` (0, 500 or 1000) by the complete columns below them.

    A column ``features`` says what each asks for, by default the overview; ``detail`` are the complete detail columns.
    A request is satisfied when all it asks for is there, partly so when some is, and waits for samples else; one that asks
    for neither stays queued.  A column ``status`` with one of CANCELLED, REQUEST_FAILED or, unless detail is asked for,
    SATISFIED is final.
    """
    cols = requests.columns
    mask = F.coalesce(F.col("features"), F.lit(0)) if "features" in cols else F.lit(int(Feature.OVERVIEW))
    asks = lambda f: mask.bitwiseAND(F.lit(int(f))) != 0
    runs = lambda c: islands(c.select("track_id", "column_index").distinct(), ["track_id"], "column_index").drop("length")
    out = covered(requests, runs(columns), frames).withColumnsRenamed({"want": "__want", "have": "__have"})
    over, some = F.col("__have") == F.col("__want"), F.col("__have") > 0
    wide, any_wide = F.lit(True), F.lit(False)
    if detail is not None:
        out = covered(out, runs(detail), detail_frames).withColumnsRenamed({"want": "__dwant", "have": "__dhave"})
        wide, any_wide = F.col("__dhave") == F.col("__dwant"), F.col("__dhave") > 0
    o, d = asks(Feature.OVERVIEW), asks(Feature.DETAIL) if detail is not None else F.lit(False)
    state = F.when(~o & ~d, QUEUED).when((~o | over) & (~d | wide), SATISFIED).when((o & some) | (d & any_wide), PARTLY_SATISFIED).otherwise(WAITING)
    if "status" in cols:
        kept = F.col("status").isin(CANCELLED, REQUEST_FAILED) | ((F.col("status") == SATISFIED) & ~d)
        state = F.when(kept, F.col("status")).otherwise(state)
    out = out.withColumn("__state", state.cast("int"))
    permille = F.when(F.col("__state") == SATISFIED, 1000).when(F.col("__state") == PARTLY_SATISFIED, 500).otherwise(0)
    return out.select(*cols, F.col("__state").alias("state"), permille.cast("int").alias("permille"))


def targets(tracks: DataFrame, requests: DataFrame, feature: Feature, focus: DataFrame | None = None) -> DataFrame:
    """(track_id, first_frame, end_frame, priority, token): what each track is to be asked for next, before what is there is taken off.

    ``tracks`` are (track_id, total_frames or null, contiguous_end).  An open request for ``feature`` goes first, the one with
    the highest priority and of these the first by id; then a focus (track_id, playhead, behind, ahead, features, priority);
    then, for the overview, the whole track, or the next block where its length isn't known.
    """
    open_states = [QUEUED, WAITING, PARTLY_SATISFIED]
    asked = requests.filter(F.col("features").bitwiseAND(F.lit(int(feature))) != 0)
    asked = asked.filter(F.col("status").isin(open_states)) if "status" in requests.columns else asked
    best = asked.groupBy("track_id").agg(F.min(F.struct((-F.col("priority")).alias("p"), "request_id", "first_frame", "end_frame")).alias("r"))
    out = tracks.join(best, "track_id", "left")
    if focus is None:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in (("ff", "long"), ("fe", "long"), ("fp", "int"))})
    else:
        first, end = focus_range(F.col("playhead"), F.col("behind"), F.col("ahead"))
        at = focus.filter(F.col("features").bitwiseAND(F.lit(int(feature))) != 0).select("track_id", first.alias("ff"), end.alias("fe"), F.col("priority").alias("fp"))
        out = out.join(at.filter("ff < fe"), "track_id", "left")
    by_request, by_focus = F.col("r").isNotNull(), F.col("ff").isNotNull()
    known = F.col("total_frames").isNotNull()
    rest_first = F.when(known, 0).otherwise(F.col("contiguous_end"))
    rest_end = F.coalesce("total_frames", F.col("contiguous_end") + MAX_PUSH_FRAMES)
    pick = lambda a, b, c: F.when(by_request, a).when(by_focus, b).otherwise(c)
    none = F.lit(None).cast("long") if feature != Feature.OVERVIEW else None
    first = pick(F.col("r.first_frame"), F.col("ff"), rest_first if none is None else none)
    end = pick(F.col("r.end_frame"), F.col("fe"), rest_end if none is None else none)
    out = out.select("track_id", first.cast("long").alias("first_frame"), F.least(end, F.coalesce("total_frames", end)).cast("long").alias("end_frame"), pick(-F.col("r.p"), F.col("fp"), F.lit(BACKGROUND)).cast("int").alias("priority"), pick(F.col("r.request_id"), F.lit(0), F.lit(0)).cast("long").alias("token"))
    return out.filter("first_frame < end_frame")


def next_pushes(tracks: DataFrame, requests: DataFrame, accepted: DataFrame, focus: DataFrame | None = None, detail: DataFrame | None = None, detail_frames: int = 256) -> DataFrame:
    """(track_id, token, feature, first_frame, end_frame, priority): the samples that each track needs next, one push at most.

    Where the analysis has detail, its columns come first: ``detail`` are those that are there, and of the detail target the first
    run of columns that aren't is asked for.  Else it is the first missing range of the overview's target.
    """
    goal = targets(tracks, requests, Feature.OVERVIEW, focus)
    gap = first_missing(goal, accepted).filter("missing_first is not null")
    end = F.least(F.col("missing_end"), F.col("missing_first") + MAX_PUSH_FRAMES)
    over = gap.select("track_id", "token", F.lit(int(Feature.OVERVIEW)).alias("feature"), F.col("missing_first").alias("first_frame"), end.alias("end_frame"), "priority")
    if detail is None:
        return over
    n = detail_frames
    goal = targets(tracks, requests, Feature.DETAIL, focus)
    whole = goal.select("track_id", "token", "priority", (div(F.col("first_frame"), n) * n).alias("first_frame"), (div(F.col("end_frame") + n - 1, n) * n).alias("end_frame"))
    runs = islands(detail.select("track_id", "column_index").distinct(), ["track_id"], "column_index")
    there = runs.select("track_id", (F.col("first") * n).alias("first_frame"), ((F.col("last") + 1) * n).alias("end_frame"))
    gap = first_missing(whole, there).filter("missing_first is not null").join(tracks.select("track_id", "total_frames"), "track_id")
    end = F.least(F.col("missing_end"), F.col("missing_first") + MAX_PUSH_FRAMES)
    fine = gap.select("track_id", "token", F.lit(int(Feature.DETAIL)).alias("feature"), F.col("missing_first").alias("first_frame"), F.least(end, F.coalesce("total_frames", end)).alias("end_frame"), "priority").filter("first_frame < end_frame")
    return fine.unionByName(over.join(fine.select("track_id"), "track_id", "left_anti"))


def scored_blocks(blocks: DataFrame, requests: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """``blocks`` (block_id, track_id, first_frame, end_frame) of queued samples with ``request_id`` and ``effective_priority`` of the best request that overlaps each, and their ``rank`` in a track.

    The focus counts where no request is better than its priority; blocks that nothing asks for come last, in order of arrival.
    """
    ask = requests if "features" not in requests.columns else requests.filter(F.col("features").bitwiseAND(F.lit(int(Feature.OVERVIEW))) != 0)
    score = scheduler_priority(F.col("priority"), F.col("skips")).cast("int")
    has = F.col("deadline") != 0
    # smaller is better: priority, then with a deadline, then the earlier one, then age and id
    key = F.struct((-score).alias("p"), (~has).alias("no_deadline"), F.when(has, F.col("deadline")).otherwise(0).alias("deadline"), "request_id")
    met = meetings(blocks, ask.select("track_id", "first_frame", "end_frame", key.alias("key")))
    out = folded(met, blocks.columns, F.min("v_key").alias("k"))
    best = out.select(*blocks.columns, F.col("k.request_id").alias("request_id"), F.coalesce(-F.col("k.p"), F.lit(0)).alias("effective_priority"), F.col("k").alias("k"))
    if focus is not None:
        first, end = focus_range(F.col("playhead"), F.col("behind"), F.col("ahead"))
        at = focus.select("track_id", first.alias("first_frame"), end.alias("end_frame"), "priority")
        near = folded(meetings(blocks, at), blocks.columns, F.max("v_priority").alias("__focus"))
        best = best.join(near.select("block_id", "__focus"), "block_id")
        wins = F.col("__focus") > F.col("effective_priority")
        best = best.withColumn("request_id", F.when(~F.coalesce(wins, F.lit(False)), F.col("request_id"))).withColumn("k", F.when(~F.coalesce(wins, F.lit(False)), F.col("k")))
        best = best.withColumn("effective_priority", F.greatest(F.col("effective_priority"), F.coalesce("__focus", F.lit(0)))).drop("__focus")
    order = W.partitionBy("track_id").orderBy(F.desc("effective_priority"), F.col("k").asc_nulls_last(), "block_id")
    return best.withColumn("rank", F.row_number().over(order)).drop("k")


def demand(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """(track_id, request_id, first_frame, end_frame): for each track the first missing samples of its best request that misses some, one push at most."""
    open_ones = first_missing(requests, accepted).filter("missing_first is not null")
    best = ranked(open_ones).filter("rank = 1")
    end = F.least(F.col("missing_end"), F.col("missing_first") + MAX_PUSH_FRAMES)
    return best.select("track_id", "request_id", F.col("missing_first").alias("first_frame"), end.alias("end_frame"))


def admitted(requests: DataFrame, limit: int = MAX_REQUESTS) -> DataFrame:
    """``requests`` (request_id, track_id, ..., serial) with ``error``: the first ``limit`` of a track by serial are held, later ones exceed it; empty ranges and ids that came before are refused."""
    bad = F.when(F.col("first_frame") >= F.col("end_frame"), "invalid")
    again = F.row_number().over(W.partitionBy("track_id", "request_id").orderBy(F.col("first_frame") >= F.col("end_frame"), "serial"))
    rows = requests.withColumn("error", bad.when(again > 1, "conflict"))
    place = F.sum(F.col("error").isNull().cast("int")).over(W.partitionBy("track_id").orderBy("serial").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__place", place).withColumn("error", F.when(F.col("error").isNull() & (F.col("__place") > limit), "limit").otherwise(F.col("error"))).drop("__place")


def aged(requests: DataFrame, chosen: DataFrame, max_skips: int = 32) -> DataFrame:
    """``requests`` with ``skips`` one higher, up to a limit, for all that weren't chosen, and 0 for those that were."""
    mine = chosen.select("request_id", F.lit(True).alias("__chosen"))
    out = requests.join(mine, "request_id", "left")
    return out.withColumn("skips", F.when(F.col("__chosen"), 0).otherwise(F.least(F.col("skips") + 1, F.lit(max_skips)))).drop("__chosen").select(*requests.columns)
