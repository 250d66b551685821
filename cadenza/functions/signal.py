"""Sample decoding and quantisation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RMS_SCALE = 8_388_608
BAND_SCALE = 32_768


def decode_int(value: Column, bits: int) -> Column:
    """Signed samples to [-1, 1]: negative ones over 2**(bits-1), others over one less."""
    full = 1 << (bits - 1)
    return F.when(value < 0, value / F.lit(float(full))).otherwise(value / F.lit(float(full - 1)))


def clamp(x: Column) -> Column:
    """Finite samples held to [-1, 1]; others, and null, are 0."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def magnitude(x: Column, scale: int) -> Column:
    return F.floor(F.least(F.abs(x), F.lit(1.0)) * F.lit(float(scale))).cast("bigint")


def quantize_peak(x: Column) -> Column:
    return F.when(x <= -1, -32768).when(x >= 1, 32767).otherwise(F.rint(x * 32767.0)).cast("int")


def quantize_rms(sum_squares: Column, n: Column) -> Column:
    """Of sums of squared 2**23 magnitudes."""
    rms = F.sqrt(sum_squares.cast("double") / n) / F.lit(float(RMS_SCALE))
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rms)) * 65535.0).cast("int")


def quantize_band(total: Column, n: Column) -> Column:
    """Of sums of 2**15 magnitudes."""
    return F.least(F.lit(255), F.floor(total * 255 / (n * BAND_SCALE)).cast("int"))


def restored_peak(value: Column) -> Column:
    return value / F.lit(32767.0)


def restored_rms(value: Column) -> Column:
    return value / F.lit(65535.0) * F.lit(float(RMS_SCALE))
