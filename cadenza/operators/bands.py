"""Three-band energy of waveform columns.

The band split is a recurrence over a track's frames.  A stretch of frames is filtered alone after a
warm-up that makes what came before it immaterial (a factor below 2**-40), so long tracks are cut into
stretches that tasks take independently.  A gap ends the recurrence: what follows it starts from silence.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.signal import BAND_SCALE, quantize_band
from ..functions.tempo import div, filter_coefficient

CORNERS = (200.0, 2000.0)


def band_columns(samples: DataFrame, frames: int, sample_rate: int, stretch_columns: int = 256) -> DataFrame:
    """(track_id, column_index, low, mid, high, sample_count)."""
    low, high = (filter_coefficient(c, sample_rate) for c in CORNERS)
    warm = -(-int(math.ceil(40 * math.log(2) / -math.log(1 - low))) // frames) * frames if low < 1 else 0
    size = stretch_columns * frames
    key = dict(samples.dtypes)["track_id"]
    own = div(F.col("frame"), size)
    # a frame also warms up the stretches that start within ``warm`` frames after it
    last = div(F.col("frame") + warm, size)
    rows = samples.select("track_id", "frame", "x", F.explode(F.sequence(own, last)).alias("stretch"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frame, x = pdf["frame"].to_numpy(), pdf["x"].to_numpy()
        cuts = np.flatnonzero(np.diff(frame) != 1) + 1
        runs = [series.bands(part, low, high) for part in np.split(x, cuts)]
        parts = [np.concatenate(p) for p in zip(*runs, strict=True)]
        inside = frame >= int(pdf["stretch"].iloc[0]) * size
        col = frame[inside] // frames
        at, back = np.unique(col, return_inverse=True)
        sums = [np.bincount(back, weights=np.floor(np.minimum(np.abs(p[inside]), 1.0) * BAND_SCALE)).astype(np.int64) for p in parts]
        return pd.DataFrame({"track_id": pdf["track_id"].iloc[0], "column_index": at, "a": sums[0], "b": sums[1], "c": sums[2], "n": np.bincount(back)})

    sums = rows.groupBy("track_id", "stretch").applyInPandas(run, f"track_id {key}, column_index long, a long, b long, c long, n long")
    return sums.select("track_id", "column_index", *(quantize_band(F.col(s), F.col("n")).alias(t) for s, t in (("a", "low"), ("b", "mid"), ("c", "high"))), F.col("n").alias("sample_count"))


def multiband_flux(samples: DataFrame, frames: int, sample_rate: int) -> DataFrame:
    """(track_id, bin, flux): broadband rises and a quarter of the band rises, where the broadband energy rises."""
    b = band_columns(samples, frames, sample_rate)
    from pyspark.sql import Window as W

    from .onset import bins, energy

    e = bins(samples, frames).filter("complete").select("track_id", "bin", energy(F.col("sum_absolute"), F.col("sample_count")).alias("e"))
    order = W.partitionBy("track_id").orderBy("bin")
    both = e.join(b.withColumnRenamed("column_index", "bin"), ["track_id", "bin"])
    rise = lambda c, s=1.0: F.greatest(F.lit(0.0), (F.col(c) - F.lag(c, 1, 0).over(order)) / F.lit(s))
    broad = rise("e")
    return both.select("track_id", "bin", F.when(broad > 0, broad + 0.25 * (rise("low", 255.0) + rise("mid", 255.0) + rise("high", 255.0))).otherwise(0.0).alias("flux"))
