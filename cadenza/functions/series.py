"""Numeric kernels over one track's flux series."""

from __future__ import annotations

import math

import numpy as np

from ..config import FINAL, MAX_CANDIDATES, MAX_TEMPO, MIN_TEMPO, PROVISIONAL, STABLE, TEMPO_DOUBLE, TEMPO_HALF, TEMPO_OCTAVE, Geometry
from .tempo import PRIOR_CENTRE, PRIOR_WIDTH, RATIOS, RELATIONS

#: Least scores that count as evidence, the knee of the family ambiguity, and endorsement limits.
MIN_SCORE, MIN_WINDOW_CORRELATION, KNEE = 0.05, 0.04, 0.85
ENDORSE_TOLERANCE, ENDORSE_SCORE, SAME_TEMPO, SEGMENT_BREAK = 0.01, 55_000, 500, 1500


def correlations(flux: np.ndarray, low: int, high: int) -> np.ndarray:
    """Normalised products of the series with itself at lags ``low`` to ``high``; no mean is taken off.

    Sums of squares of all tails and heads come from one cumulative sum.
    """
    n = len(flux)
    squares = np.concatenate([[0.0], np.cumsum(flux * flux)])
    out = np.zeros(max(0, high - low + 1))
    for k, lag in enumerate(range(low, high + 1)):
        if 0 < lag < n:
            left, right = squares[n] - squares[lag], squares[n - lag]
            if left > 1e-12 and right > 1e-12:
                out[k] = float(flux[lag:] @ flux[: n - lag]) / math.sqrt(left * right)
    return out


def tempo_of(lag: int, sample_rate: int, frames: int) -> int:
    d = lag * frames
    return (60_000 * sample_rate + d // 2) // d


def prior(tempo: np.ndarray | float) -> np.ndarray:
    return np.exp(-0.5 * (np.log(np.asarray(tempo, float) / PRIOR_CENTRE) / PRIOR_WIDTH) ** 2)


def weighted(flux: np.ndarray, low: int, high: int, sample_rate: int, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlations and scores, the correlations weighted by the tempo prior."""
    c = correlations(flux, low, high)
    t = np.array([tempo_of(lag, sample_rate, frames) for lag in range(low, high + 1)], float)
    return c, c * prior(t) if len(c) else c


def refinement(flux: np.ndarray, lag: int, beats: int) -> float:
    """Offset of the period from ``lag``, in bins, measured over up to ``beats`` periods."""
    multiple = beats
    while multiple > 1 and multiple * lag > len(flux) // 2:
        multiple -= 1
    if multiple < 2:
        return 0.0
    half = multiple // 2
    lo = max(1, multiple * lag - half)
    c = correlations(flux, lo, min(multiple * lag + half, len(flux) - 1))
    if not len(c) or c.max() <= 0:
        return 0.0
    return float(np.clip((lo + int(c.argmax())) / multiple - lag, -0.5, 0.5))


def with_offset(tempo: int, lag: int, offset: float) -> int:
    return tempo if offset == 0 else int(math.floor(tempo * lag / (lag + offset) + 0.5))


def phase_of(flux: np.ndarray, lag: int) -> int:
    """The first place with the greatest sum of flux at it and every ``lag`` bins on."""
    return int(np.bincount(np.arange(len(flux)) % lag, weights=flux, minlength=lag).argmax())


def grid_fit(flux: np.ndarray, lag: int, phase: int) -> float:
    """Contrast of the mean flux within a bin of the beats and elsewhere."""
    d = (np.arange(len(flux)) - phase) % lag
    on = np.minimum(d, lag - d) <= 1
    if not len(flux) or on.all() or not on.any():
        return 0.0
    a, b = flux[on].mean(), flux[~on].mean()
    return float((a - b) / (a + b)) if a + b > 1e-12 else 0.0


def relation_code(selected: int, candidate: int) -> int:
    if not selected or not candidate or selected == candidate:
        return 0
    for num, den, name in RATIOS:
        expected = selected * num // den
        if abs(candidate - expected) <= expected // 50 + 1:
            return RELATIONS[name]
    return 0


def top_lags(scores: np.ndarray, low: int) -> list[tuple[int, float]]:
    order = np.lexsort((np.arange(len(scores)), -scores))[:MAX_CANDIDATES]
    return [(low + int(i), float(scores[i])) for i in order if scores[i] > 0]


def family_ambiguity(best: tuple[int, float], scores: np.ndarray, low: int) -> float:
    """How near the best lag at a metrical ratio comes to the winner, from the knee on."""
    lag, winner = best
    siblings = [int(lag * den / num + 0.5) for num, den, _ in RATIOS]
    near = max((scores[s - low] for s in siblings if low <= s < low + len(scores) and s != lag), default=0.0)
    return float(np.clip((near / winner - KNEE) / (1 - KNEE), 0, 1)) if near > 0 else 0.0


def local_tempo(flux: np.ndarray, g: Geometry, nominal: int = 0, whole: bool = True) -> dict | None:
    """The selected tempo of a run of onset flux with candidates, confidence, state, flags and phase; None without evidence.

    ``nominal`` is the global estimate, which may bring a well-scored candidate to the front; ``whole`` says
    that the run is the whole, ended track.
    """
    n = len(flux)
    low, high = g.lags(g.onset_frames, n)
    if n < g.min_tempo_bins or high < low:
        return None
    _, scores = weighted(flux, low, high, g.sample_rate, g.onset_frames)
    best = top_lags(scores, low)
    if not best or best[0][1] < MIN_SCORE:
        return None
    found: list[dict] = []
    for lag, score in best:
        tempo = with_offset(tempo_of(lag, g.sample_rate, g.onset_frames), lag, refinement(flux, lag, g.refine_beats))
        if not MIN_TEMPO <= tempo <= MAX_TEMPO or any(abs(tempo - c["tempo"]) <= SAME_TEMPO for c in found):
            continue
        points = min(65_535, int(score / best[0][1] * 65_535 + 0.5))
        found.append({"tempo": tempo, "score": points, "confidence": 25 + points * 70 // 65_535})
    if not found:
        return None
    flags = 0
    backed = [i for i, c in enumerate(found) if i and nominal and c["score"] >= ENDORSE_SCORE and abs(c["tempo"] - nominal) / nominal <= ENDORSE_TOLERANCE]
    if backed:
        pick = max(backed, key=lambda i: (found[i]["score"], -i))
        found.insert(0, found.pop(pick))
        flags |= TEMPO_OCTAVE
    selected = found[0]["tempo"]
    for i, c in enumerate(found):
        c["relation"] = relation_code(selected, c["tempo"])
        if i and c["score"] >= found[0]["score"] * 7 // 10 and c["relation"]:
            flags |= TEMPO_OCTAVE | (TEMPO_HALF if c["relation"] == RELATIONS["half"] else 0) | (TEMPO_DOUBLE if c["relation"] == RELATIONS["double"] else 0)
    ambiguity = family_ambiguity(best[0], scores, low)
    flags |= TEMPO_OCTAVE if ambiguity > 0 else 0
    lag = best[0][0]
    phase = phase_of(flux, lag)
    fit = grid_fit(flux, lag, phase)
    confidence = 35 + int(min(1.0, max(0.0, 2 * fit)) * 50)
    if len(found) > 1 and len(best) > 1:
        confidence += int(max(0.0, 1 - best[1][1] / best[0][1]) * 15)
    confidence = min(100, confidence + (5 if n >= g.stable_tempo_bins else 0))
    confidence = int(confidence * (1 - ambiguity))
    state = STABLE if n >= g.stable_tempo_bins and confidence >= 50 else PROVISIONAL
    return {"tempo": selected, "confidence": confidence, "state": FINAL if whole else state, "flags": flags, "lag": lag, "phase": phase, "fit": fit, "candidates": found}


def window_tempo(flux: np.ndarray, g: Geometry) -> dict | None:
    """The tempo of one analysis window of global flux."""
    n = len(flux)
    low, high = g.lags(g.global_frames, n)
    if n < g.min_window_bins or high < low:
        return None
    c, scores = weighted(flux, low, high, g.sample_rate, g.global_frames)
    if not len(scores) or scores.max() <= 0:
        return None
    at = int(scores.argmax())
    lag = low + at
    if c[at] < MIN_WINDOW_CORRELATION:
        return None
    tempo = with_offset(tempo_of(lag, g.sample_rate, g.global_frames), lag, refinement(flux, lag, g.refine_beats))
    if not MIN_TEMPO <= tempo <= MAX_TEMPO:
        return None
    return {"tempo": tempo, "phase": phase_of(flux, lag), "lag": lag, "score": float(scores[at]), "confidence": min(100, 40 + int(min(1.0, scores[at]) * 50))}


def merged_segments(windows: list[dict], limit: int) -> tuple[list[dict], bool]:
    """Runs of windows (first, end, tempo, phase, confidence) whose tempo stays near the running mean of whole numbers.

    Beyond ``limit`` segments the last one only grows, and the result is degraded.
    """
    out: list[dict] = []
    degraded = False
    for w in windows:
        if out and abs(out[-1]["tempo"] - w["tempo"]) <= SEGMENT_BREAK:
            s, k = out[-1], out[-1]["windows"]
            s.update(tempo=(s["tempo"] * k + w["tempo"]) // (k + 1), confidence=(s["confidence"] * k + w["confidence"]) // (k + 1), end=w["end"], windows=k + 1)
        elif len(out) >= limit:
            out[-1].update(end=w["end"], degraded=True)
            degraded = True
        else:
            out.append({"first": w["first"], "end": w["end"], "anchor": w["first"] + w["phase"], "tempo": w["tempo"], "confidence": w["confidence"], "windows": 1, "degraded": False})
    return out, degraded


def one_pole(x: np.ndarray, a: float, state: float = 0.0, block: int = 256) -> np.ndarray:
    """y[n] = y[n-1] + a (x[n] - y[n-1]), block by block: inside a block one product with the powers of 1 - a."""
    if not len(x) or a >= 1:
        return x.astype(float)
    m = min(block, len(x))
    r = 1.0 - a
    power = r ** np.arange(m + 1)
    lag = np.subtract.outer(np.arange(m), np.arange(m))
    kernel = np.where(lag >= 0, a * power[np.maximum(lag, 0)], 0.0)
    rows = -(-len(x) // m)
    parts = np.zeros(rows * m)
    parts[: len(x)] = x
    local = parts.reshape(rows, m) @ kernel.T
    carry = np.empty(rows)
    for i in range(rows):  # one step for each block
        carry[i] = state
        state = local[i, -1] + power[m] * state
    return (local + carry[:, None] * power[None, 1 : m + 1]).ravel()[: len(x)]


def bands(x: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low, middle and high part: two low passes and what they leave."""
    a, b = one_pole(x, low), one_pole(x, high)
    return a, b - a, x - b
