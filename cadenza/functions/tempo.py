"""Tempo arithmetic as columns: lags, priors, relations, periods and beat positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation names and codes, and the ratios in the order they are tried.
RELATIONS = {"independent": 0, "half": 1, "double": 2, "three_half": 3, "two_thirds": 4, "third": 5, "triple": 6, "quarter": 7, "quadruple": 8}
RATIOS = ((3, 2, "three_half"), (2, 3, "two_thirds"), (2, 1, "double"), (1, 2, "half"), (3, 1, "triple"), (1, 3, "third"), (4, 1, "quadruple"), (1, 4, "quarter"))
# Ratio classes of corpus evaluation, in the order they are tried.
CLASSES = (("exact", 1, 1), ("half", 1, 2), ("double", 2, 1), ("third", 1, 3), ("triple", 3, 1), ("two_thirds", 2, 3), ("three_half", 3, 2), ("quarter", 1, 4), ("quadruple", 4, 1))
PRIOR_CENTRE, PRIOR_WIDTH = 125_000.0, 0.55
Q32 = 1 << 32


def div(a, b) -> Column:
    """Integer division of non-negative whole numbers."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def tempo_from_lag(lag: Column, sample_rate: int, frames_per_bin: int) -> Column:
    d = lag * F.lit(frames_per_bin).cast("bigint")
    return div(F.lit(60_000 * sample_rate).cast("bigint") + div(d, 2), d).cast("int")


def prior(tempo: Column) -> Column:
    octaves = F.log(tempo / F.lit(PRIOR_CENTRE)) / F.lit(PRIOR_WIDTH)
    return F.exp(F.lit(-0.5) * octaves * octaves)


def refined(tempo: Column, lag: Column, offset: Column) -> Column:
    return F.when(offset == 0, tempo.cast("bigint")).otherwise(F.floor(tempo * lag / (lag + offset) + 0.5).cast("bigint"))


def relation(selected: Column, candidate: Column) -> Column:
    """The first ratio within a fiftieth (and one)."""
    out = F.when((selected == 0) | (candidate == 0) | (selected == candidate), 0)
    for num, den, name in RATIOS:
        expected = div(selected.cast("bigint") * num, den)
        out = out.when(F.abs(candidate - expected) <= div(expected, 50) + 1, RELATIONS[name])
    return out.otherwise(0)


def ratio_class(reported: Column, truth: Column) -> Column:
    """exact within 1 %, the others within 4 % of their ratio."""
    ratio = reported / truth.cast("double")
    out = F.when(reported == 0, "absent")
    for name, num, den in CLASSES:
        want = num / den
        out = out.when(F.abs(ratio - want) <= F.lit((0.01 if name == "exact" else 0.04) * want), name)
    return out.otherwise("other")


def period_q32(tempo: Column, sample_rate: int) -> tuple[Column, Column]:
    """Frames per beat, whole and in 2**-32 frames."""
    n = F.lit(60_000 * sample_rate).cast("bigint")
    return div(n, tempo), div((n % tempo) * F.lit(Q32).cast("bigint"), tempo)


def beat_count(anchor: Column, first: Column, end: Column, whole: Column, frac: Column) -> Column:
    """Beats of a segment, by its period rounded up to whole frames."""
    period = whole + F.when(frac != 0, 1).otherwise(0)
    start = F.when(anchor < first, anchor + div(first - anchor + period - 1, period) * period).otherwise(anchor)
    return F.when((end <= first) | (whole == 0) | (start >= end), 0).otherwise(1 + div(end - 1 - start, period)).cast("bigint")


def beat_position(anchor: Column, k: Column, whole: Column, frac: Column) -> tuple[Column, Column]:
    """Whole and fractional frames of beat ``k`` from a whole anchor; one product, no running sum."""
    wide = lambda c: c.cast("decimal(20,0)")
    unit = F.lit(Q32).cast("decimal(11,0)")
    pos = (wide(anchor) * unit + wide(k) * (wide(whole) * unit + wide(frac)).cast("decimal(20,0)")).cast("decimal(38,0)")
    whole_frame = F.call_function("div", pos, unit)
    return whole_frame, (pos - whole_frame.cast("decimal(20,0)") * unit).cast("bigint")


def scheduler_priority(priority: Column, skips: Column, step: int = 8) -> Column:
    return priority + F.least(skips * step, F.lit(255) - priority)


def filter_coefficient(corner_hz: float, sample_rate: int) -> float:
    return min(1.0, max(0.0, 1.0 - math.exp(-2.0 * math.pi * corner_hz / sample_rate)))
