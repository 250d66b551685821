"""Tempo of tracks.  Series of one track meet in one task (a few thousand bins, by the capacity of the evidence); numpy does the lags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Geometry
from ..functions import series
from .onset import bins, evidence, flux


def onset_flux(samples: DataFrame, g: Geometry) -> DataFrame:
    b = bins(samples, g.onset_frames)
    return flux(b, evidence(b, g.onset_capacity))


def _grouped(f: DataFrame, fn, schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        rows = fn(pdf["track_id"].iloc[0], pdf["bin"].to_numpy(), pdf["flux"].to_numpy())
        return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])

    return f.groupBy("track_id").applyInPandas(run, schema)


def _key(f: DataFrame) -> str:
    return dict(f.dtypes)["track_id"]


def lag_scores(f: DataFrame, g: Geometry) -> DataFrame:
    """(track_id, lag, correlation, score) of every lag of the tempo range."""

    def run(track, bin_, x):
        low, high = g.lags(g.onset_frames, len(x))
        c, s = series.weighted(x, low, high, g.sample_rate, g.onset_frames)
        return [(track, low + i, float(c[i]), float(s[i])) for i in range(len(c))]

    return _grouped(f, run, f"track_id {_key(f)}, lag int, correlation double, score double")


def top_lags(scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best lags of each track; of equal scores, to nine digits, the smaller lag."""
    from pyspark.sql import Window as W

    points = F.floor(F.col("score") * 1e9 + 0.5).cast("bigint")
    ranked = scores.select("track_id", "lag", points.alias("score_e9")).withColumn("rank", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("score_e9"), "lag")))
    return ranked.filter(F.col("rank") <= k)


def phase_histogram(f: DataFrame, lag: int) -> DataFrame:
    """(track_id, phase, total): flux by place in the period, from the evidence's start."""
    return f.groupBy("track_id", (F.col("offset") % lag).alias("phase")).agg(F.sum("flux").alias("total"))


def grid_fit(f: DataFrame, lag: int, phase: int) -> DataFrame:
    """(track_id, fit): contrast of flux near the beats and elsewhere."""
    d = (F.col("offset") + lag - phase % lag) % lag
    on = F.least(d, lag - d) <= 1
    m = f.groupBy("track_id").agg(F.avg(F.when(on, F.col("flux"))).alias("a"), F.avg(F.when(~on, F.col("flux"))).alias("b"))
    return m.select("track_id", F.when(F.col("a") + F.col("b") > 1e-12, (F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).otherwise(0.0).alias("fit"))


_TEMPO = "tempo int, confidence int, state int, flags int, lag int, phase int, evidence_first long, evidence_end long"


def estimated(f: DataFrame, g: Geometry, nominal: DataFrame | None = None) -> DataFrame:
    """(track_id, tempo, ..., candidates): the local estimate of each ended track.

    ``nominal`` (track_id, nominal) is the global estimate, taken first, that may promote a candidate.
    """
    key = _key(f)
    schema = f"track_id {key}, {_TEMPO}, candidates array<struct<rank:int,tempo:int,score:int,confidence:int,relation:int>>"
    cols = ["track_id", "tempo", "confidence", "state", "flags", "lag", "phase", "evidence_first", "evidence_end", "candidates"]
    rows = f.withColumn("nominal", F.lit(0)) if nominal is None else f.join(nominal, "track_id", "left").fillna({"nominal": 0})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        got = series.local_tempo(pdf["flux"].to_numpy(), g, int(pdf["nominal"].iloc[0]))
        if got is None:
            return pd.DataFrame(columns=cols, dtype=object)
        candidates = [{"rank": i, **c} for i, c in enumerate(got["candidates"])]
        row = {"track_id": pdf["track_id"].iloc[0], **{c: got[c] for c in ("tempo", "confidence", "state", "flags", "lag", "phase")}}
        first, end = int(pdf["bin"].iloc[0]), int(pdf["bin"].iloc[-1]) + 1
        return pd.DataFrame([row | {"evidence_first": first * g.onset_frames, "evidence_end": end * g.onset_frames, "candidates": candidates}], columns=cols)

    return rows.groupBy("track_id").applyInPandas(run, schema)


def candidates(tempo: DataFrame) -> DataFrame:
    return tempo.select("track_id", F.explode("candidates").alias("c")).select("track_id", "c.rank", "c.tempo", "c.score", "c.confidence", "c.relation")
