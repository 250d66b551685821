"""Resuming from an earlier result: whether it fits, and accumulators made again from its quantised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_CLIPPED, COLUMN_VALID
from ..functions.signal import restored_peak, restored_rms

#: Reasons for which an earlier result (``prior_``) can't seed an analysis, in the order they are looked at.
REASONS = ("sample_rate", "channels", "layout", "identity", "fingerprint", "length", "column_size", "beyond_end")


class SeedConflict(ValueError):
    """``reason`` is one of ``REASONS``."""

    def __init__(self, reason: str):
        super().__init__(f"the earlier result is of another source or geometry: {reason}")
        self.reason = reason


def conflict() -> Column:
    """The first reason against seeding, null where there is none, over columns named as the arguments of ``check``.

    Zero or null is unknown on the earlier result's side for rate and channels, on either side for layouts, fingerprint
    kinds and lengths; what is unknown on a side is no conflict, unless an identity is required.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    differ = lambda c: F.col(f"prior_{c}") != F.col(c)
    both = lambda c: has(f"prior_{c}") & has(c)
    prints = differ("fingerprint_kind") | ~F.col("prior_fingerprint").eqNullSafe(F.col("fingerprint"))
    wrong = {
        "sample_rate": has("prior_sample_rate") & differ("sample_rate"),
        "channels": has("prior_channels") & differ("channels"),
        "layout": both("layout") & differ("layout"),
        "identity": F.col("require_identity") & ~both("fingerprint_kind"),
        "fingerprint": both("fingerprint_kind") & prints,
        "length": F.col("prior_total_frames").isNotNull() & F.col("total_frames").isNotNull() & differ("total_frames"),
        "column_size": differ("frames_per_column"),
        "beyond_end": F.col("total_frames").isNotNull() & (F.col("prior_end") > F.col("total_frames")),
    }
    out = F.lit(None).cast("string")
    for reason in reversed(REASONS):
        out = F.when(F.coalesce(wrong[reason], F.lit(False)), reason).otherwise(out)
    return out


def restored(columns: DataFrame, frames: int, total: DataFrame | None = None) -> DataFrame:
    """Accumulators (as of ``waveform.accumulators``) whose finished columns are ``columns`` again: peaks and root mean squares are read back from their quantised values."""
    rows = columns if total is None else columns.join(total, "track_id")
    whole = F.lit(frames).cast("bigint")
    n = whole if total is None else F.least(whole, F.col("total_frames") - F.col("column_index") * frames)
    level = F.floor(restored_rms(F.col("rms"))).cast("bigint")
    rows = rows.withColumn("n", n).filter((F.col("flags").bitwiseAND(F.lit(COLUMN_VALID)) != 0) & (F.col("n") > 0))
    return rows.select(
        "track_id", "column_index", restored_peak(F.col("minimum")).alias("lo"), restored_peak(F.col("maximum")).alias("hi"),
        (level * level * F.col("n")).alias("sum_squares"), "n", (F.col("flags").bitwiseAND(F.lit(COLUMN_CLIPPED)) != 0).alias("clipped"),
    )


def checked(prior: DataFrame, config: DataFrame) -> DataFrame:
    """``prior`` (track_id, prior_...) joined with ``config`` (track_id, ...); a track whose earlier result doesn't fit ends the query with the reason."""
    both = prior.join(config, "track_id").withColumn("reason", conflict())
    fault = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("seed conflict of track "), F.col("track_id").cast("string"), F.lit(": "), F.col("reason"))))
    return both.filter(fault.cast("string").isNull()).drop("reason")
