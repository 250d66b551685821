"""Features, geometry and limits of an analysis, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntFlag


class Feature(IntFlag):
    OVERVIEW = 1 << 0
    DETAIL = 1 << 1
    BANDS = 1 << 2
    BPM = 1 << 3
    LOCAL_GRID = 1 << 4
    GLOBAL_GRID = 1 << 5
    DYNAMIC_TEMPO = 1 << 6
    CONFIDENCE = 1 << 7
    LOCKING = 1 << 8


#: What a feature needs besides itself.
REQUIRES = {
    Feature.DETAIL: Feature.OVERVIEW,
    Feature.BANDS: Feature.OVERVIEW,
    Feature.CONFIDENCE: Feature.OVERVIEW,
    Feature.BPM: Feature.OVERVIEW,
    Feature.LOCAL_GRID: Feature.OVERVIEW | Feature.BPM,
    Feature.GLOBAL_GRID: Feature.OVERVIEW | Feature.BPM,
    Feature.DYNAMIC_TEMPO: Feature.GLOBAL_GRID,
    Feature.LOCKING: Feature.LOCAL_GRID,
}

# States, priorities and flags.
ABSENT, PARTIAL, PROVISIONAL, STABLE, FINAL, FAILED = range(6)
QUEUED, WAITING, RUNNABLE, PARTLY_SATISFIED, SATISFIED, CANCELLED, REQUEST_FAILED = range(7)
BACKGROUND, NORMAL, INTERACTIVE, PLAYBACK = 32, 96, 192, 240
COLUMN_VALID, COLUMN_PROVISIONAL, COLUMN_CLIPPED, COLUMN_BANDS, COLUMN_DEGRADED = 1, 2, 4, 8, 16
TEMPO_HALF, TEMPO_DOUBLE, TEMPO_DYNAMIC, TEMPO_OCTAVE = 1, 2, 8, 128
GRID_DYNAMIC, GRID_DEGRADED, GRID_LOCKED = 2, 128, 256
SEGMENTS, EXPLICIT, HYBRID = 1, 2, 3
PENDING, APPLIED = 1, 2
UNKNOWN_CONFIDENCE = 255

# Limits and rates.
MIN_TEMPO, MAX_TEMPO = 40_000, 300_000
MAX_SEGMENTS, MAX_BEATS, MAX_CANDIDATES = 8, 3072, 3
MAX_PUSH_FRAMES, MAX_REQUESTS, MAX_TILES = 4096, 16, 4
AGE_STEP, MAX_SKIPS = 8, 32
MAX_SAMPLE_RATE = 768_000


def closure(features: Feature | int) -> Feature:
    """The features with everything they need."""
    mask = Feature(features)
    while True:
        wider = mask
        for f, needed in REQUIRES.items():
            if f in wider:
                wider |= needed
        if wider == mask:
            return mask
        mask = wider


def is_coherent(features: Feature | int) -> bool:
    return closure(features) == Feature(features)


MONO, STEREO = 1, 2


def config_error(features: int, sample_rate: int, channels: int, layout: int = 0, frames_per_column: int = 0) -> str | None:
    """Why a configuration is refused; None for a good one.  A column size of 0 is the default, a layout of 0 any."""
    if features & ~int(sum(Feature)):
        return "features"
    if not 0 < sample_rate:
        return "sample_rate"
    if not 1 <= channels <= 8:
        return "channels"
    if (layout == MONO and channels != 1) or (layout == STEREO and channels != 2):
        return "layout"
    n = frames_per_column
    if n and (not 64 <= n <= 65_536 or n & (n - 1)):
        return "frames_per_column"
    if features & Feature.OVERVIEW and channels > 2:
        return "overview_channels"
    return None


def version_code(major: int, minor: int, patch: int) -> int:
    """A version in 32 bits: ten for major and minor each, twelve for the patch."""
    return (major & 0x3FF) << 22 | (minor & 0x3FF) << 12 | patch & 0xFFF


def version_parts(code: int) -> tuple[int, int, int]:
    return code >> 22 & 0x3FF, code >> 12 & 0x3FF, code & 0xFFF


def feature_list(features: Feature | int) -> list[str]:
    """Lower-case names, by bit."""
    return [f.name.lower() for f in Feature if f & features]


def features_named(names: str) -> Feature:
    """The features of a comma-separated list; an unknown name is an error."""
    out = Feature(0)
    for name in filter(None, (n.strip().upper() for n in names.split(","))):
        if name not in Feature.__members__:
            raise ValueError(f"no feature is called {name.lower()}")
        out |= Feature[name]
    return out


@dataclass(frozen=True)
class Geometry:
    """Sizes in frames and bins; the defaults are those of a 44.1 or 48 kHz track."""

    sample_rate: int = 48_000
    channels: int = 1
    frames_per_column: int = 1024
    detail_frames: int = 256
    tile_columns: int = 64
    onset_frames: int = 256
    onset_capacity: int = 4096
    min_tempo_bins: int = 512
    stable_tempo_bins: int = 1024
    global_frames: int = 2048
    global_capacity: int = 16_384
    window_bins: int = 128
    min_window_bins: int = 64
    stable_global_bins: int = 256
    refine_beats: int = 16

    def __post_init__(self):
        n = self.frames_per_column
        if not 64 <= n <= 65_536 or n & (n - 1):
            raise ValueError("frames_per_column must be a power of two from 64 to 65536")
        if not 0 < self.sample_rate <= MAX_SAMPLE_RATE:
            raise ValueError("sample_rate is out of range")
        if not 1 <= self.channels <= 8:
            raise ValueError("1 to 8 channels")

    def lags(self, frames_per_bin: int, bins: int | None = None) -> tuple[int, int]:
        """Least and greatest lag, in bins, of the tempo range; at most half the bins."""
        low = max(1, -(-self.sample_rate * 60 // (300 * frames_per_bin)))
        high = self.sample_rate * 60 // (40 * frames_per_bin)
        if bins is not None and high * 2 >= bins:
            high = bins // 2
        return low, high
