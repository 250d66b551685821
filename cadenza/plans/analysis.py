"""One entry to all features: a configuration over a stream of samples, read as lazy DataFrames.

Nothing runs until a result is used; features that aren't asked for have no plan, and their columns are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FINAL, GRID_DYNAMIC, Feature, Geometry, closure
from ..operators import bands, coverage, grid, onset, scheduler, tempo, waveform

CAPABILITIES = sum(Feature)


@dataclass
class Analysis:
    """``samples`` (track_id, frame, x) of ended tracks; ``total`` (track_id, total_frames) where they end later than their last sample.

    ``seed`` holds overview columns of an earlier result.  All waveform and tempo features are rolled up from one pass over the
    samples, ``fine``; ``keep`` holds on to its result (a few numbers for every 64 frames or more) where several features are read.
    """

    samples: DataFrame
    features: Feature = Feature.OVERVIEW
    geometry: Geometry = field(default_factory=Geometry)
    total: DataFrame | None = None
    seed: DataFrame | None = None
    keep: bool = False

    def __post_init__(self):
        self.features = closure(self.features)

    def _need(self, f: Feature) -> None:
        if f not in self.features:
            raise ValueError(f"{f.name} isn't among the features of this analysis")

    @cached_property
    def _unit(self) -> int:
        g = self.geometry
        return gcd(g.frames_per_column, g.detail_frames, g.onset_frames, g.global_frames)

    @cached_property
    def fine(self) -> DataFrame:
        parts = onset.fine(self.samples, self._unit)
        return parts.persist() if self.keep else parts

    def _columns(self, frames: int) -> DataFrame:
        return waveform.finalized(waveform.complete(waveform.merged(self.fine, frames // self._unit), frames, self.totals))

    def _bins(self, frames: int) -> DataFrame:
        return onset.rolled_bins(self.fine, frames // self._unit, frames)

    @cached_property
    def totals(self) -> DataFrame:
        if self.total is not None:
            return self.total
        return self.fine.groupBy("track_id").agg((F.max("last_frame") + 1).alias("total_frames"))

    @cached_property
    def columns(self) -> DataFrame:
        c = self._columns(self.geometry.frames_per_column)
        return c if self.seed is None else waveform.resumed(self.seed, c)

    def spans(self) -> DataFrame:
        return waveform.spans(self.columns, self.geometry.frames_per_column, self.totals)

    def confidence(self) -> DataFrame:
        self._need(Feature.CONFIDENCE)
        return waveform.confidence(self.columns, self.geometry.frames_per_column, self.totals)

    def detail(self) -> DataFrame:
        self._need(Feature.DETAIL)
        return self._columns(self.geometry.detail_frames)

    def tiles(self) -> DataFrame:
        return waveform.longest_runs(self.detail(), self.geometry.tile_columns)

    def bands(self) -> DataFrame:
        self._need(Feature.BANDS)
        return bands.band_columns(self.samples, self.geometry.frames_per_column, self.geometry.sample_rate)

    @cached_property
    def _windows(self) -> DataFrame:
        g = self.geometry
        b = self._bins(g.global_frames)
        return grid.windows(onset.flux(b, onset.evidence(b, g.global_capacity), g.window_bins), g)

    @cached_property
    def segments(self) -> DataFrame:
        self._need(Feature.GLOBAL_GRID)
        found = grid.with_periods(grid.segments(self._windows, self.geometry), self.geometry)
        # grids that list beats count what they list; constant ones count by arithmetic
        listed = grid.numbered(found).drop("first_beat", "anchor_ordinal")
        if Feature.DYNAMIC_TEMPO in self.features:
            return listed
        several = F.col("flags").bitwiseAND(F.lit(GRID_DYNAMIC)) != 0
        return listed.filter(several).unionByName(found.filter(~several))

    def grid(self) -> DataFrame:
        return grid.grid_summary(self._windows, self.segments, Feature.DYNAMIC_TEMPO in self.features)

    def beats(self) -> DataFrame:
        self._need(Feature.DYNAMIC_TEMPO)
        return grid.beats(self.segments)

    @cached_property
    def tempo(self) -> DataFrame:
        """Local estimates; a global grid among the features endorses their candidates."""
        self._need(Feature.BPM)
        nominal = self.grid().select("track_id", "nominal") if Feature.GLOBAL_GRID in self.features else None
        g = self.geometry
        b = self._bins(g.onset_frames)
        return tempo.estimated(onset.flux(b, onset.evidence(b, g.onset_capacity)), g, nominal)

    def candidates(self) -> DataFrame:
        return tempo.candidates(self.tempo)

    def local_grid(self) -> DataFrame:
        """A segment of constant period over each track's evidence."""
        self._need(Feature.LOCAL_GRID)
        n = self.geometry.onset_frames
        s = self.tempo.select("track_id", F.lit(1).alias("segment_id"), F.col("evidence_first").alias("first_frame"), F.col("evidence_end").alias("end_frame"), (F.col("evidence_first") + F.col("phase") * n).alias("anchor"), "tempo", "confidence", "state", "flags")
        return grid.with_periods(s, self.geometry)

    def feature_state(self, requests: DataFrame, feature: Feature) -> DataFrame:
        """``requests`` (track_id, first_frame, end_frame, ...) with the state of ``feature`` over each range."""
        if feature in (Feature.OVERVIEW, Feature.CONFIDENCE):
            values = self.spans().select("track_id", "first_frame", "end_frame", F.lit(FINAL).alias("state"))
        elif feature in (Feature.BPM, Feature.LOCAL_GRID):
            values = self.tempo.select("track_id", F.col("evidence_first").alias("first_frame"), F.col("evidence_end").alias("end_frame"), "state")
        else:
            values = self.segments.select("track_id", "first_frame", "end_frame", F.lit(FINAL).alias("state"))
        return coverage.feature_state(requests, values)

    def progress(self, requests: DataFrame) -> DataFrame:
        return scheduler.progress(requests, self.columns, self.geometry.frames_per_column)

    def demand(self, requests: DataFrame, accepted: DataFrame) -> DataFrame:
        return scheduler.demand(requests, accepted)

    def lock_conflicts(self, locks: DataFrame) -> DataFrame:
        self._need(Feature.LOCKING)
        return grid.locked_conflicts(locks, self.segments)

    def apply_revision(self, locks: DataFrame) -> DataFrame:
        self._need(Feature.LOCKING)
        return grid.applied(locks, self.segments)
