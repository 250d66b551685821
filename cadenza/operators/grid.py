"""Global grids: windows, segments, beats, locks and revisions."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import APPLIED, FINAL, GRID_DEGRADED, GRID_DYNAMIC, HYBRID, MAX_BEATS, MAX_SEGMENTS, PENDING, SEGMENTS, STABLE, Geometry
from ..functions import series
from ..functions.tempo import Q32, beat_count, div, period_q32
from .coverage import STRETCH, folded, meetings, stretches
from .onset import bins, evidence, flux


def global_flux(samples: DataFrame, g: Geometry) -> DataFrame:
    b = bins(samples, g.global_frames)
    return flux(b, evidence(b, g.global_capacity), g.window_bins)


def windows(f: DataFrame, g: Geometry) -> DataFrame:
    """(track_id, window, first_bin, end_bin, tempo, phase, score, confidence) of the windows that have a tempo.

    Windows are independent: they, not tracks, are the unit of work.
    """
    key = dict(f.dtypes)["track_id"]
    cols = ["track_id", "window", "first_bin", "end_bin", "tempo", "phase", "score", "confidence"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        got = series.window_tempo(pdf["flux"].to_numpy(), g)
        if got is None:
            return pd.DataFrame(columns=cols)
        return pd.DataFrame([(pdf["track_id"].iloc[0], int(pdf["window"].iloc[0]), int(pdf["bin"].iloc[0]), int(pdf["bin"].iloc[-1]) + 1, got["tempo"], got["phase"], got["score"], got["confidence"])], columns=cols)

    return f.groupBy("track_id", "window").applyInPandas(run, f"track_id {key}, window long, first_bin long, end_bin long, tempo int, phase int, score double, confidence int")


def segments(w: DataFrame, g: Geometry) -> DataFrame:
    """(track_id, segment_id, first_frame, end_frame, anchor, tempo, confidence, window_count, flags): the ordered fold of each track's windows."""
    key = dict(w.dtypes)["track_id"]
    cols = ["track_id", "segment_id", "first_frame", "end_frame", "anchor", "tempo", "confidence", "window_count", "flags"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_bin")
        rows = [{"first": r.first_bin, "end": r.end_bin, "tempo": r.tempo, "phase": r.phase, "confidence": r.confidence} for r in pdf.itertuples()]
        out, degraded = series.merged_segments(rows, MAX_SEGMENTS)
        flags = (GRID_DYNAMIC if len(out) > 1 else 0) | (GRID_DEGRADED if degraded else 0)
        n = g.global_frames
        return pd.DataFrame([(pdf["track_id"].iloc[0], i, s["first"] * n, s["end"] * n, s["anchor"] * n, s["tempo"], s["confidence"], s["windows"], flags) for i, s in enumerate(out, 1)], columns=cols)

    return w.groupBy("track_id").applyInPandas(run, f"track_id {key}, segment_id int, first_frame long, end_frame long, anchor long, tempo int, confidence int, window_count int, flags int")


def lag_break_segments(w: DataFrame) -> DataFrame:
    """Segments that break where the tempo differs from the window before: the relational variant of ``segments``."""
    order = W.partitionBy("track_id").orderBy("first_bin")
    new = F.coalesce((F.abs(F.col("tempo") - F.lag("tempo").over(order)) > series.SEGMENT_BREAK).cast("int"), F.lit(1))
    marked = w.withColumn("new", new).withColumn("segment_id", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("track_id", "segment_id").agg(
        F.min("first_bin").alias("first_bin"), F.max("end_bin").alias("end_bin"), F.count("*").alias("window_count"), div(F.sum("tempo"), F.count("*")).alias("tempo"), div(F.sum("confidence"), F.count("*")).alias("confidence")
    )


def with_periods(s: DataFrame, g: Geometry) -> DataFrame:
    whole, frac = period_q32(F.col("tempo"), g.sample_rate)
    out = s.withColumn("period_whole", whole).withColumn("period_frac", frac)
    return out.withColumn("beat_count", beat_count(F.col("anchor"), F.col("first_frame"), F.col("end_frame"), F.col("period_whole"), F.col("period_frac")))


def grid_summary(w: DataFrame, s: DataFrame, dynamic: bool = False) -> DataFrame:
    """(track_id, nominal, confidence, representation, segment_count): the widest segment's tempo, of equal ones the first, and the windows' mean confidence."""
    mean = w.groupBy("track_id").agg(div(F.sum("confidence"), F.count("*")).alias("confidence"))
    best = s.groupBy("track_id").agg(F.max(F.struct((F.col("end_frame") - F.col("first_frame")).alias("span"), (-F.col("segment_id")).alias("n"), "tempo")).alias("b"), F.count("*").alias("segment_count"))
    kind = F.when((F.col("segment_count") > 1) | F.lit(dynamic), HYBRID).otherwise(SEGMENTS)
    return best.join(mean, "track_id").select("track_id", F.col("b.tempo").alias("nominal"), "confidence", kind.alias("representation"), "segment_count")


def _period() -> Column:
    return (F.col("period_whole") * F.lit(Q32).cast("bigint") + F.col("period_frac")).cast("decimal(20,0)")


def _q32(c: str) -> Column:
    return (F.col(c).cast("decimal(19,0)") * F.lit(Q32).cast("decimal(11,0)")).cast("decimal(38,0)")


def numbered(s: DataFrame, limit: int = MAX_BEATS) -> DataFrame:
    """Segments with periods, of grids that list their beats: ``beat_count`` is the number of beats listed, ``anchor_ordinal`` the number before.

    Beats run on over a track's segments up to ``limit``; where some are cut off, the flags of all the track's segments say degraded.
    """
    up = lambda a: F.when(a <= 0, 0).otherwise(F.call_function("div", a + _period() - 1, _period())).cast("bigint")
    has = F.coalesce(F.col("period_whole") > 0, F.lit(False))
    first, end = (F.when(has, up(_q32(c) - _q32("anchor"))).otherwise(0) for c in ("first_frame", "end_frame"))
    k = s.withColumn("__k0", first).withColumn("__n", F.greatest(end - F.col("__k0"), F.lit(0)))
    track = W.partitionBy("track_id")
    before = F.coalesce(F.sum("__n").over(track.orderBy("segment_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    k = k.withColumn("anchor_ordinal", F.least(before, F.lit(limit)).cast("bigint")).withColumn("__cut", F.max((before + F.col("__n") > limit) | ~has).over(track))
    k = k.withColumn("beat_count", F.least(F.col("__n"), F.lit(limit) - F.col("anchor_ordinal")).cast("bigint"))
    flags = F.col("flags") if "flags" in s.columns else F.lit(0)
    return k.withColumn("flags", F.when(F.col("__cut"), flags.bitwiseOR(F.lit(GRID_DEGRADED))).otherwise(flags).cast("int")).drop("__n", "__cut").withColumnRenamed("__k0", "first_beat")


def beats(s: DataFrame, limit: int = MAX_BEATS) -> DataFrame:
    """(track_id, ordinal, segment_id, whole, frac_q32, confidence): beats of segments with periods.

    Ordinals run on over a track's segments.  Positions are the anchor and a multiple of the period in
    whole 2**-32 frames, by one product.
    """
    each = numbered(s, limit).filter("beat_count > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("beat_count") - 1)).alias("__i"))
    pos = (_q32("anchor") + (F.col("first_beat") + F.col("__i")).cast("decimal(19,0)") * _period()).cast("decimal(38,0)")
    unit = F.lit(Q32).cast("decimal(11,0)")
    return each.select("track_id", (F.col("anchor_ordinal") + F.col("__i")).alias("ordinal"), "segment_id", F.call_function("div", pos, unit).alias("whole"), (pos % unit).cast("bigint").alias("frac_q32"), "confidence")


def beat_at(frames: DataFrame, s: DataFrame) -> DataFrame:
    """``frames`` (track_id, frame) with the last beat at or before each, by segment arithmetic: (segment_id, k, beat_frame)."""
    a = s.select("track_id", "segment_id", "first_frame", "end_frame", "anchor", "period_whole", "period_frac").filter("period_whole > 0")
    parts = a.withColumn("__at", F.explode(stretches(F.col("first_frame"), F.col("end_frame"))))
    hit = frames.withColumn("__at", F.shiftright("frame", STRETCH)).join(parts, ["track_id", "__at"])
    hit = hit.filter((F.col("frame") >= F.col("first_frame")) & (F.col("frame") < F.col("end_frame")) & (F.col("frame") >= F.col("anchor")))
    period = F.col("period_whole") * F.lit(Q32).cast("bigint") + F.col("period_frac")
    wide = (F.col("frame") - F.col("anchor")).cast("decimal(19,0)") * F.lit(Q32).cast("decimal(11,0)")
    k = F.call_function("div", wide, period.cast("decimal(20,0)"))
    whole = F.col("anchor") + F.call_function("div", (k.cast("decimal(19,0)") * period.cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(Q32).cast("decimal(11,0)"))
    return hit.select("track_id", "frame", "segment_id", k.alias("k"), whole.alias("beat_frame"))


def locked_conflicts(locks: DataFrame, s: DataFrame, tempo_limit: int = 500, anchor_limit: int = 2048) -> DataFrame:
    """``locks`` (lock_id, track_id, first_frame, end_frame, tempo, anchor) with ``conflict``: a segment below differs too much."""
    met = meetings(locks, s.select("track_id", "first_frame", "end_frame", "tempo", "anchor"))
    bad = (F.abs(F.col("v_tempo") - F.col("tempo")) > tempo_limit) | (F.abs(F.col("v_anchor") - F.col("anchor")) > anchor_limit)
    return folded(met, locks.columns, F.max(F.coalesce(bad, F.lit(False))).alias("conflict"))


def applied(locks: DataFrame, s: DataFrame) -> DataFrame:
    """``locks`` taken over from the first segment that overlaps each; without one a lock stays."""
    met = meetings(locks, s.select("track_id", "segment_id", "first_frame", "end_frame", "tempo", "anchor"))
    best = folded(met, locks.columns, F.min(F.when(F.col("__base") == 0, F.struct("v_segment_id", "v_tempo", "v_anchor"))).alias("b"))
    keep = [c for c in locks.columns if c not in ("tempo", "anchor")]
    return best.select(*keep, F.coalesce("b.v_tempo", "tempo").alias("tempo"), F.coalesce("b.v_anchor", "anchor").alias("anchor"))


def locked(grids: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (lock_id, track_id, first_frame, end_frame) with ``status``: which of them lock their track's local grid.

    ``grids`` are (track_id, state, first_frame, end_frame, locked_first, locked_end), the last two null for a grid that isn't locked.
    Only stable and final grids can be locked, over a range inside their own; a locked grid can be locked over the same range again.  Of
    several requests for an open grid the first by ``lock_id`` that may be granted holds, and the others are judged against it.
    """
    g = grids.select("track_id", "state", F.col("first_frame").alias("gf"), F.col("end_frame").alias("ge"), "locked_first", "locked_end")
    rows = requests.join(g, "track_id", "left")
    empty = F.col("first_frame") >= F.col("end_frame")
    ready = F.coalesce(F.col("state").isin(STABLE, FINAL), F.lit(False))
    outside = (F.col("first_frame") < F.col("gf")) | (F.col("end_frame") > F.col("ge"))
    fits = ~empty & ready & ~outside
    holder = F.min(F.when(fits & F.col("locked_first").isNull(), F.struct("lock_id", "first_frame", "end_frame"))).over(W.partitionBy("track_id"))
    rows = rows.withColumn("__holder", holder)
    first, end = F.coalesce("locked_first", "__holder.first_frame"), F.coalesce("locked_end", "__holder.end_frame")
    # before the holder's turn a request that fits would have been the holder, so order needs no more care
    same = (F.col("first_frame") == first) & (F.col("end_frame") == end)
    status = F.when(empty, "invalid").when(~ready, "invalid_state").when(outside, "conflict").when(same, "ok").otherwise("conflict")
    return rows.select(*requests.columns, status.alias("status"))


def signatures(s: DataFrame, representation: DataFrame | None = None) -> DataFrame:
    """(track_id, signature): FNV-1a with 64 bits over each track's number of segments and of beats, its representation and its segments' ranges, anchors, periods and tempi.

    A track has ``MAX_SEGMENTS`` segments at most.
    """
    fields = ("first_frame", "end_frame", "anchor", "period_whole", "period_frac", "tempo")
    listed = s.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", *(F.col(c).cast("long").alias(c) for c in fields)))).alias("s"), F.sum(F.col("beat_count").cast("long")).alias("beats"))
    kind = F.when(F.size("s") > 1, HYBRID).otherwise(SEGMENTS)
    if representation is not None:
        listed, kind = listed.join(representation.select("track_id", "representation"), "track_id"), F.col("representation")
    one = lambda x: F.array(x["first_frame"], x["end_frame"], x["anchor"], F.lit(0).cast("long"), x["period_whole"], x["period_frac"], x["tempo"])
    beats = F.when(kind == SEGMENTS, 0).otherwise(F.col("beats"))  # a constant grid lists none
    values = F.concat(F.array(F.size("s").cast("long"), beats.cast("long"), kind.cast("long")), F.flatten(F.transform("s", one)))

    @F.pandas_udf("decimal(20,0)")
    def fnv(lists: pd.Series) -> pd.Series:
        def one(values):
            h = 1469598103934665603
            for b in np.asarray(values, "<u8").tobytes():
                h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            return Decimal(h)

        return lists.map(one)

    return listed.select("track_id", fnv(values).alias("signature"))


def revisions(signatures: DataFrame) -> DataFrame:
    """(track_id, generation, revision_id, previous_id) of the generations whose ``signature`` differs from the one before.

    With a column ``conflict``, whether the generation's grid differs from a locked range, also ``state``: PENDING then, else APPLIED.
    """
    order = W.partitionBy("track_id").orderBy("generation")
    changed = signatures.withColumn("was", F.lag("signature").over(order)).filter("was is null or was <> signature")
    n = F.row_number().over(order)
    state = [F.when(F.col("conflict"), PENDING).otherwise(APPLIED).cast("int").alias("state")] if "conflict" in signatures.columns else []
    return changed.select("track_id", "generation", n.alias("revision_id"), (n - 1).alias("previous_id"), *state)


def candidate_sets(tempi: DataFrame) -> DataFrame:
    """(track_id, generation, tempo, candidate_set_id): one more whenever the selected tempo changes."""
    order = W.partitionBy("track_id").orderBy("generation")
    step = F.coalesce((F.col("tempo") != F.lag("tempo").over(order)).cast("int"), F.lit(1))
    return tempi.withColumn("step", step).select("track_id", "generation", "tempo", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("candidate_set_id"))
