"""Known signals: columns, bands, tempi and grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.config import COLUMN_CLIPPED, COLUMN_VALID, FINAL, Feature, Geometry, closure, is_coherent
from cadenza.functions import series
from cadenza.operators import bands, grid, onset, seeding, tempo, waveform
from cadenza.plans.analysis import Analysis
from cadenza.sources import synthetic


def frame(spark, tracks: dict[str, np.ndarray]):
    parts = [pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "x": x.astype(float)}) for k, x in tracks.items()]
    return spark.createDataFrame(pd.concat(parts))


def clicks(lag_bins: float, bins: int, frames: int = 256, width: int = 128, level: float = 0.9) -> np.ndarray:
    x = np.zeros(bins * frames)
    at = 0.0
    while at < len(x):
        x[int(at) : int(at) + width] = level
        at += lag_bins * frames
    return x


def test_two_columns(spark):
    x = np.concatenate([np.zeros(64), np.ones(64)])
    rows = waveform.columns(frame(spark, {"a": x}), 64).orderBy("column_index").collect()
    assert [(r.minimum, r.maximum, r.rms, r.flags) for r in rows] == [(0, 0, 0, COLUMN_VALID), (32767, 32767, 65535, COLUMN_VALID | COLUMN_CLIPPED)]


def test_any_partitioning_and_order_gives_the_same_columns(spark):
    x = np.sin(np.arange(5000) / 7.0)
    df = frame(spark, {"a": x, "b": x[:777]})
    total = waveform.totals(df)
    want = waveform.columns(df.repartition(1), 64, total).toPandas().sort_values(["track_id", "column_index"]).reset_index(drop=True)
    got = waveform.columns(df.orderBy(F.rand(3)).repartition(7), 64, total).toPandas().sort_values(["track_id", "column_index"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_gaps_are_absent_and_split_spans(spark):
    x = np.full(64 * 6, 0.5)
    df = frame(spark, {"a": x}).filter("frame < 64 or frame >= 256")
    spans = waveform.spans(waveform.columns(df, 64), 64).orderBy("first_frame").collect()
    assert [(s.first_frame, s.end_frame, s.column_count) for s in spans] == [(0, 64, 1), (256, 384, 2)]


def test_short_last_column_needs_the_end(spark):
    df = frame(spark, {"a": np.full(100, 0.1)})
    assert waveform.columns(df, 64).count() == 1
    assert waveform.columns(df, 64, 100).count() == 2


def test_resume_equals_one_go(spark):
    x = np.cos(np.arange(1000) / 3.0)
    df = frame(spark, {"a": x})
    total = waveform.totals(df)
    whole = {tuple(r) for r in waveform.columns(df, 64, total).collect()}
    first = waveform.columns(df.filter("frame < 512"), 64)
    rest = waveform.columns(df.filter("frame >= 512"), 64, total)
    assert {tuple(r) for r in waveform.resumed(first, rest).collect()} == whole


def test_seed_gives_the_columns_again(spark):
    x = np.cos(np.arange(1000) / 3.0) * 1.01
    df = frame(spark, {"a": x.clip(-1, 1)})
    total = waveform.totals(df)
    whole = waveform.columns(df, 64, total)
    first = waveform.columns(df.filter("frame < 512"), 64)
    joined = waveform.merged(seeding.restored(first, 64, total).unionByName(waveform.accumulators(df.filter("frame >= 512"), 64)))
    assert {tuple(r) for r in waveform.finalized(joined).collect()} == {tuple(r) for r in whole.collect()}


def test_seed_of_another_source_is_refused(spark):
    config = {"track_id": "a", "sample_rate": 48_000, "channels": 1, "layout": 1, "fingerprint_kind": 1, "fingerprint": "x", "require_identity": False, "total_frames": 1000, "frames_per_column": 64}
    prior = {"prior_sample_rate": 48_000, "prior_channels": 1, "prior_layout": 0, "prior_fingerprint_kind": 1, "prior_fingerprint": "x", "prior_total_frames": 1000, "prior_frames_per_column": 64, "prior_end": 512}

    def reason(**change):
        row = config | prior | change
        return spark.createDataFrame([row]).select(seeding.conflict().alias("r")).first().r

    assert reason() is None and reason(prior_sample_rate=0) is None and reason(prior_fingerprint_kind=0) is None
    wrong = {"prior_sample_rate": 44_100, "prior_channels": 2, "prior_layout": 2, "prior_fingerprint": "y", "prior_total_frames": 999, "prior_frames_per_column": 128, "prior_end": 1001}
    assert [reason(**{k: v}) for k, v in wrong.items()] == ["sample_rate", "channels", "layout", "fingerprint", "length", "column_size", "beyond_end"]
    assert reason(require_identity=True, fingerprint_kind=0) == "identity"
    sides = [spark.createDataFrame([{"track_id": "a"} | prior | {"prior_channels": 2}]), spark.createDataFrame([config])]
    with pytest.raises(Exception, match="seed conflict of track a: channels"):
        seeding.checked(*sides).collect()


def test_bands_start_anew_after_a_gap(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-1, 1, 64 * 8), rng.uniform(-1, 1, 64 * 8)
    rows = pd.concat([pd.DataFrame({"track_id": "t", "frame": np.arange(len(a)), "x": a}), pd.DataFrame({"track_id": "t", "frame": np.arange(len(b)) + 1024, "x": b})])
    got = {r.column_index: r[2:5] for r in bands.band_columns(spark.createDataFrame(rows), 64, 44_100).collect()}
    alone = {r.column_index: r[2:5] for r in bands.band_columns(frame(spark, {"t": b}), 64, 44_100).collect()}
    assert {k - 16: v for k, v in got.items() if k >= 16} == alone


def test_features_roll_up_from_one_pass(spark):
    """What an analysis gives is what the operators give on the samples."""
    rng = np.random.default_rng(5)
    g = Geometry(sample_rate=48_000)
    x = frame(spark, {"a": rng.uniform(-1, 1, 5000), "b": np.concatenate([clicks(90, 600), [0.5]])}).filter("not (track_id = 'a' and frame between 2048 and 2100)")
    a = Analysis(x, Feature.DETAIL | Feature.BPM, g, keep=True)
    total = waveform.totals(x)
    same = lambda p, q: assert_rows(p, q.select(*p.columns))
    same(a.columns, waveform.columns(x, g.frames_per_column, total))
    same(a.detail(), waveform.columns(x, g.detail_frames, total))
    same(a._bins(g.onset_frames), onset.bins(x, g.onset_frames))
    same(a._bins(g.global_frames), onset.bins(x, g.global_frames))
    same(a.tempo.select("track_id", "tempo", "confidence"), tempo.estimated(tempo.onset_flux(x, g), g))


def assert_rows(p, q):
    rows = sorted(map(tuple, p.collect()), key=str)
    assert rows and rows == sorted(map(tuple, q.collect()), key=str)


def test_tones_order_bands(spark):
    t = np.arange(3 * 1024) / 44_100
    x = np.concatenate([0.7 * np.sin(2 * np.pi * f * t) for f in (60, 800, 6000)])
    rows = bands.band_columns(frame(spark, {"a": x}), 1024, 44_100).orderBy("column_index").collect()
    for i, name in enumerate(("low", "mid", "high")):
        for r in rows[3 * i + 1 : 3 * i + 3]:
            assert max(("low", "mid", "high"), key=lambda c: r[c]) == name


def test_stretches_of_bands_agree(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, {"a": rng.uniform(-1, 1, 64 * 100)})
    one = bands.band_columns(df, 64, 44_100, stretch_columns=1000).toPandas().sort_values("column_index")
    many = bands.band_columns(df, 64, 44_100, stretch_columns=16).toPandas().sort_values("column_index")
    assert np.abs(one[["low", "mid", "high"]].to_numpy() - many[["low", "mid", "high"]].to_numpy()).max() <= 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=700), st.floats(0.001, 0.999))
def test_one_pole_is_the_recurrence(xs, a):
    y, want = 0.0, []
    for x in xs:
        y += a * (x - y)
        want.append(y)
    np.testing.assert_allclose(series.one_pole(np.array(xs), a), want, atol=1e-9)


@pytest.mark.parametrize("lag", [75, 90, 100, 125, 150, 180, 225, 281])
def test_click_trains(lag):
    g = Geometry(sample_rate=48_000)
    x = clicks(lag, 1024)
    e = np.floor(np.abs(x) * 32768).reshape(-1, 256).sum(axis=1) / (256 * 32768)
    flux = np.maximum(0, np.diff(e, prepend=0.0))
    got = series.local_tempo(flux, g)
    assert got is not None
    want = round(60_000 * 48_000 / (lag * 256))
    tempi = [c["tempo"] for c in got["candidates"]]
    assert min(abs(t - want) for t in tempi) <= 1
    assert got["state"] == FINAL


def test_silence_has_no_tempo(spark):
    assert series.local_tempo(np.zeros(2048), Geometry()) is None
    df = spark.range(256 * 600).selectExpr("'a' as track_id", "id as frame", "0.0D as x")
    assert Analysis(df, Feature.BPM).tempo.count() == 0


def test_sub_bin_period_is_refined():
    g = Geometry(sample_rate=48_000)
    x = clicks(80.5, 2048)
    e = np.floor(np.abs(x) * 32768).reshape(-1, 256).sum(axis=1) / (256 * 32768)
    got = series.local_tempo(np.maximum(0, np.diff(e, prepend=0.0)), g)
    want = 60_000 * 48_000 / 20_608
    assert min(abs(c["tempo"] - want) for c in got["candidates"]) < 200


def test_endorsement_only_reorders():
    g = Geometry(sample_rate=48_000)
    e = np.floor(np.abs(clicks(90, 1024)) * 32768).reshape(-1, 256).sum(axis=1) / (256 * 32768)
    flux = np.maximum(0, np.diff(e, prepend=0.0))
    plain = series.local_tempo(flux, g)
    other = series.local_tempo(flux, g, nominal=plain["candidates"][-1]["tempo"])
    assert sorted(c["tempo"] for c in plain["candidates"]) == sorted(c["tempo"] for c in other["candidates"])


def test_relations_on_both_sides_of_the_tolerance():
    assert series.relation_code(120_000, 60_000) == 1
    assert series.relation_code(120_000, 60_000 + 1201) == 1
    assert series.relation_code(120_000, 60_000 + 1202) == 0
    assert series.relation_code(120_000, 120_000) == 0
    assert series.relation_code(120_000, 180_000) == 3


def test_segments_follow_a_tempo_change(spark):
    """Two tempi in one track: two segments, ordered beats that run on."""
    n = 48_000 * 22
    p, q = (48_000 * 60 / bpm for bpm in (117.188, 156.25))
    pulse = f"case when id < {n} then pmod(id, {p}D) < 192 else pmod(id - {n}, {q}D) < 192 end"
    x = spark.range(2 * n).selectExpr("'a' as track_id", "id as frame", f"if({pulse}, 0.9D, 0.0D) as x")
    a = Analysis(x, Feature.DYNAMIC_TEMPO, Geometry(sample_rate=48_000))
    rows = a.segments.orderBy("segment_id").collect()
    assert len(rows) >= 2
    assert any(115_000 < r.tempo < 120_000 for r in rows) and 150_000 < rows[-1].tempo < 160_000
    beats = a.beats().orderBy("ordinal").collect()
    assert [b.ordinal for b in beats] == list(range(len(beats)))
    assert all(p.whole < q.whole for p, q in zip(beats, beats[1:], strict=False))
    assert a.grid().first().representation == 3


def test_segment_fold_merges_beyond_its_limit():
    rows = [{"first": i, "end": i + 1, "tempo": 60_000 + 5000 * i, "phase": 0, "confidence": 50} for i in range(10)]
    out, degraded = series.merged_segments(rows, 8)
    assert len(out) == 8 and degraded and out[-1]["end"] == 10 and out[-1]["tempo"] == 95_000


def test_evidence_is_the_first_longest_run(spark):
    b = spark.createDataFrame([("a", i, 0, 1, i not in (3, 7)) for i in range(11)], "track_id string, bin long, sum_absolute long, sample_count long, complete boolean")
    r = onset.evidence(b, 100).first()
    assert (r.first_bin, r.end_bin) == (0, 3)


def test_applied_revision_takes_the_first_segment(spark):
    locks = spark.createDataFrame([(1, "a", 10, 20, 100, 0), (2, "a", 90, 95, 100, 0)], "lock_id int, track_id string, first_frame long, end_frame long, tempo int, anchor long")
    segs = spark.createDataFrame([("a", 1, 0, 15, 700, 3), ("a", 2, 15, 40, 800, 4)], "track_id string, segment_id int, first_frame long, end_frame long, tempo int, anchor long")
    got = {r.lock_id: (r.tempo, r.anchor) for r in grid.applied(locks, segs).collect()}
    assert got == {1: (700, 3), 2: (100, 0)}
    assert {r.lock_id: r.conflict for r in grid.locked_conflicts(locks, segs).collect()} == {1: True, 2: False}


def test_closure():
    assert closure(Feature.DYNAMIC_TEMPO) == Feature.DYNAMIC_TEMPO | Feature.GLOBAL_GRID | Feature.BPM | Feature.OVERVIEW
    assert not is_coherent(Feature.BPM) and is_coherent(Feature.OVERVIEW)
    with pytest.raises(ValueError):
        Geometry(frames_per_column=100)


def test_features_that_were_not_asked_for_are_refused(spark):
    with pytest.raises(ValueError):
        Analysis(frame(spark, {"a": np.zeros(10)})).detail()


def test_rendered_patterns_have_their_tempo():
    x = synthetic.render("four_on_floor", 126, 12, 44_100)
    assert abs(np.abs(x).max() - synthetic.PEAK) < 1e-9
    g = Geometry(sample_rate=44_100)
    e = np.abs(x[: len(x) // 256 * 256]).reshape(-1, 256).mean(axis=1)
    got = series.local_tempo(np.maximum(0, np.diff(e, prepend=0.0)), g)
    assert any(abs(c["tempo"] * r - 126_000) < 1300 for c in got["candidates"] for r in (1, 2, 0.5))
    assert synthetic.margin("four_on_floor") > synthetic.margin("halftime")
