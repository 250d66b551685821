"""Rendered drum patterns with a known tempo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Steps of a bar of sixteen at which each voice of a pattern sounds.
PATTERNS = {
    "four_on_floor": {"kick": (0, 4, 8, 12), "snare": (4, 12), "hat": (2, 6, 10, 14), "open": (14,), "bass": (0, 4, 8, 12)},
    "breakbeat": {"kick": (0, 6, 10), "snare": (4, 12, 15), "hat": (0, 2, 4, 6, 8, 10, 12, 14), "bass": (0, 6, 12)},
    "halftime": {"kick": (0, 10), "snare": (8,), "hat": (2, 6, 10, 14), "bass": (0, 8)},
    "sixteenth_hats": {"kick": (0, 6, 8, 14), "snare": (4, 12), "hat": tuple(range(16)), "bass": (0, 6, 8, 12)},
    "ghost_funk": {"kick": (0, 3, 6, 10, 13), "snare": (2, 4, 7, 9, 12, 14), "hat": (0, 2, 3, 4, 6, 7, 8, 10, 11, 12, 14, 15), "bass": (0, 3, 8, 14)},
    "offbeat_bass": {"kick": (0, 4, 8, 12), "snare": (4, 12), "open": (2, 6, 10, 14), "bass": (2, 6, 10, 14)},
}
TEMPI = (90, 100, 110, 120, 126, 128, 140, 150, 160, 174)
PEAK = 0.89


def margin(pattern: str) -> float:
    """How much better a bar fits itself a beat later than at any other shift; of kick and snare."""
    x = np.zeros(16)
    for voice, weight in (("kick", 1.0), ("snare", 0.8)):
        x[list(PATTERNS[pattern].get(voice, ()))] += weight
    r = np.array([(x * np.roll(x, s)).sum() for s in range(16)]) / max(1e-9, (x * x).sum())
    return float(r[4] - max(r[s] for s in range(1, 9) if s != 4))


def render(pattern: str, bpm: float, seconds: float, sample_rate: int, seed: int = 1, jitter_ms: float = 0.0, swing: float = 0.0, drift: float = 0.0) -> np.ndarray:
    """Mono samples with the peak at a fixed level."""
    rng = np.random.default_rng([seed, int(bpm * 1000), sum(pattern.encode())])
    n = int(seconds * sample_rate)
    out = np.zeros(n)

    def voice(kind: str) -> np.ndarray:
        t = np.arange(int({"kick": 0.18, "snare": 0.15, "hat": 0.04, "open": 0.12, "bass": 0.2}[kind] * sample_rate)) / sample_rate
        if kind == "kick":
            return 0.9 * np.sin(2 * np.pi * (50 * t + 60 * 0.03 * (1 - np.exp(-t / 0.03)))) * np.exp(-t / 0.06)
        if kind == "bass":
            return 0.4 * np.sin(2 * np.pi * 55 * t) * np.exp(-t / 0.1)
        noise = rng.standard_normal(len(t))
        return {"snare": 0.5, "hat": 0.25, "open": 0.25}[kind] * noise * np.exp(-t / {"snare": 0.05, "hat": 0.01, "open": 0.04}[kind])

    sounds = {k: voice(k) for k in PATTERNS[pattern]}
    at, step = 0.0, 0
    while at < seconds:
        length = 60 / bpm / 4 * (1 + drift * at / seconds)
        late = swing * length if step % 2 else 0.0
        for kind, steps in PATTERNS[pattern].items():
            if step % 16 in steps:
                i = int((at + late + rng.normal(0, jitter_ms / 1000) if jitter_ms else at + late) * sample_rate)
                if 0 <= i < n:
                    s = sounds[kind][: n - i]
                    out[i : i + len(s)] += s
        at, step = at + length, step + 1
    return out * (PEAK / max(np.abs(out).max(), 1e-9))


def tracks(spark: SparkSession, seconds: float = 20.0, sample_rate: int = 22_050, patterns=tuple(PATTERNS), tempi=TEMPI, **options) -> DataFrame:
    """(track_id, bpm, frame, x): every pattern at every tempo, a task for each."""
    rows = [(f"{p}-{b}", p, float(b)) for p in patterns for b in tempi]
    plan = spark.createDataFrame(rows, "track_id string, pattern string, bpm double").repartition(len(rows))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x = render(r.pattern, r.bpm, seconds, sample_rate, **options)
                yield pd.DataFrame({"track_id": r.track_id, "bpm": r.bpm, "frame": np.arange(len(x)), "x": x})

    return plan.mapInPandas(run, "track_id string, bpm double, frame long, x double")
