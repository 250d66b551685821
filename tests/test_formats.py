"""Containers, audio and annotation files, streams."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.config import FINAL, Geometry
from cadenza.functions import ranges
from cadenza.operators import corpus, coverage, scheduler
from cadenza.plans import io_queries
from cadenza.sources import audio, beatfiles, container
from cadenza.sources import layout as L
from cadenza.streaming import progressive

COL = {"minimum": -5, "maximum": 7, "rms": 9, "flags": 1}


def result(**more) -> dict:
    return {
        "source": {"sample_rate": 48_000, "channels": 2, "layout": 2, "total_frames": 1500},
        "overview": {"frames_per_column": 1024, "column_count": 2, "state": FINAL, "confidence": 100, "spans": [{"first_frame": 0, "end_frame": 1500, "first_column": 0, "columns": [COL, COL]}]},
    } | more


TEMPO = {"state": 4, "confidence": 80, "tempo": 120_000, "candidate_set_id": 1, "evidence_first": 0, "evidence_end": 1500, "first_frame": 0, "end_frame": 1500, "candidates": [{"tempo": 120_000, "score": 65_535, "confidence": 95}, {"tempo": 60_000, "score": 100, "confidence": 25, "relation": 1}]}
RANGES = {f"{r}_{e}": v for r in ("requested", "evidence", "coverage") for e, v in (("first", 0), ("end", 1500))} | {"first_frame": 0, "end_frame": 1500}
LOCAL = RANGES | {"state": 4, "confidence": 80, "period_whole": 24_000, "tempo": 120_000, "segment_id": 1, "segment_state": 4, "segment_confidence": 80, "beat_count": 1}
SEGMENT = {"first_frame": 0, "end_frame": 1500, "period_whole": 24_000, "tempo": 120_000, "segment_id": 1, "revision": 3, "state": 4, "confidence": 80, "beat_count": 1}
GRID = RANGES | {"state": 4, "confidence": 80, "representation": 3, "segments": [SEGMENT], "beats": [{"whole": 0, "ordinal": 0, "revision": 3, "confidence": 80}]}
REVISION = {"state": 2, "confidence": 80, "revision": 3, "first_frame": 0, "end_frame": 1500}
TILE = {"level_id": 1, "tile_index": 0, "first_frame": 0, "end_frame": 512, "first_column": 0, "state": 4, "confidence": 100, "columns": [COL, COL]}
FULL = result(tiles=[TILE], metadata={"producer_name": "us", "creation_unix_time": 1 << 33, "source_id": b"\1\2", "comments": "ü"}, tempo=TEMPO, local=LOCAL, grid=GRID, revision=REVISION)


def test_sizes_follow_from_the_layout():
    one = {"overview": {"frames_per_column": 1024, "column_count": 1, "state": FINAL, "spans": [{"first_frame": 0, "end_frame": 1024, "first_column": 0, "columns": [COL]}]}, "source": FULL["source"] | {"total_frames": 1024}}
    assert len(container.write(one)) == 226
    assert [r.size for r in (L.HEAD, L.DIRECTORY, L.OVERVIEW, L.SPAN, L.COLUMN, L.DETAIL, L.TILE, L.TEMPO, L.CANDIDATE, L.LOCAL, L.GLOBAL, L.SEGMENT, L.BEAT, L.REVISION)] == [96, 40, 48, 32, 10, 16, 48, 56, 16, 144, 96, 80, 40, 80]


def test_checksum_vector():
    assert L.crc32c(b"123456789") == 0xE3069283


# Digests of containers with given contents, made by another writer of the format.
DIGESTS = {
    "overview": (226, "0d954beeb13b9e380ea769800a9a9a0ff44908d202043022fead76929f56ea37"),
    "detail": (346, "8f679125ce2b620983c5199388fa575967fa40a01c263223fc7c5bdf9d3ba209"),
    "tempo": (344, "c89503a97bfe2b39aa89a9475c382bec1da235c21becf812c33f0733ba3f2456"),
    "local": (528, "bd7f83946ea4bd039d85ee721abff1bf2c3d41c33a844aace4659c969f631911"),
    "grid": (680, "a3338f7ec978eabe9977a187c093e942bce8789b5b59fee5e0a1badd242da323"),
}


def test_bytes_are_those_of_the_format():
    """One silent column of 1024 frames at 48 kHz, and a grid of 120 beats a minute over it, section by section."""
    same, whole = {"state": FINAL, "confidence": 90}, {"first_frame": 0, "end_frame": 1024}
    silent = {"minimum": 0, "maximum": 0, "rms": 0, "flags": 1}
    ranges = {f"{r}_{e}": v for r in ("requested", "evidence", "coverage") for e, v in (("first", 0), ("end", 1024))} | whole
    base = {
        "source": {"sample_rate": 48_000, "channels": 1, "layout": 1, "total_frames": 1024},
        "overview": {"frames_per_column": 1024, "column_count": 1, "state": FINAL, "confidence": 0, "spans": [whole | {"first_column": 0, "columns": [silent]}]},
    }
    tempo = whole | same | {"tempo": 120_000, "candidate_set_id": 1, "evidence_first": 0, "evidence_end": 1024, "candidates": [{"tempo": 120_000, "score": 1000, "confidence": 90}]}
    beat = {"period_whole": 24_000, "beat_count": 1, "tempo": 120_000}
    more = {
        "overview": {},
        "detail": {"tiles": [same | {"level_id": 1, "tile_index": 0, "first_frame": 0, "end_frame": 256, "first_column": 0, "columns": [silent]}]},
        "tempo": {"tempo": tempo},
        "local": {"tempo": tempo, "local": ranges | same | beat | {"segment_id": 1, "segment_state": FINAL, "segment_confidence": 90}},
        "grid": {"tempo": tempo, "grid": ranges | same | {"representation": 1, "segments": [whole | same | beat | {"segment_id": 2, "revision": 1}]}, "revision": whole | {"state": 2, "confidence": 90, "revision": 1}},
    }
    for name, sections in more.items():
        data = container.write(base | sections)
        assert (len(data), hashlib.sha256(data).hexdigest()) == DIGESTS[name], name
        assert container.write(container.read(data)) == data


def test_round_trip_is_canonical():
    data = container.write(FULL)
    back = container.read(data)
    assert container.write(back) == data
    assert back["metadata"]["comments"] == "ü" and back["grid"]["beats"][0]["ordinal"] == 0
    assert [s["name"] for s in container.sections(data)[1]] == list(L.ORDER)


def test_every_truncation_and_every_flipped_byte_is_noticed():
    data = container.write(FULL)
    for n in range(len(data)):
        with pytest.raises(container.ContainerError):
            container.read(data[:n])
    names = {96 + 40 * k + j for k in range(1, 7) for j in range(4)}  # an unknown optional section is skipped
    for i in set(range(len(data))) - names:
        bad = bytearray(data)
        bad[i] ^= 0x10
        with pytest.raises(container.ContainerError):
            container.read(bytes(bad))


def patched(data: bytes, at: int, fmt: str, value: int) -> bytes:
    """A file with one header or directory field changed and the header's checksum mended."""
    out = bytearray(data)
    struct.pack_into(fmt, out, at, value)
    struct.pack_into("<I", out, 92, L.crc32c(bytes(out[:92])))
    return bytes(out)


def test_rejections_have_codes():
    data = container.write(FULL)
    for at, fmt, value, code in ((6, "<H", 9, "unsupported"), (16, "<I", 2, "corrupt"), (20, "<I", 99, "limit"), (96 + 4, "<H", 2, "unsupported"), (96 + 6, "<H", 3, "unsupported"), (96 + 36, "<I", 1, "corrupt")):
        with pytest.raises(container.ContainerError) as e:
            container.read(patched(data, at, fmt, value))
        assert e.value.code == code, at
    assert container.read(patched(data, 96 + 36, "<I", 1), strict=False)
    unknown = bytearray(data)
    unknown[96 + 40 : 96 + 44] = b"ZZZZ"  # the detail section under an unknown, optional name
    assert "tiles" not in container.read(bytes(unknown))


def test_contradictions():
    with pytest.raises(container.ContainerError):
        container.write(FULL | {"revision": REVISION | {"state": 1}})
    early = container.write(FULL | {"tempo": TEMPO | {"state": 3}})
    assert container.sections(early)[0]["flags"] & L.PARTIAL_RESULT
    with pytest.raises(container.ContainerError):
        container.read(container.write(result(local=LOCAL)))


def test_cbor():
    for v in (0, 23, 24, 255, 256, 65_536, 1 << 40, "x" * 30, b"ab", {1: "a", 2: b"b", 7: [1, 2]}):
        assert L.cbor_value(L.cbor(v)) == (v, len(L.cbor(v)))
    for bad in (b"\x18\x05", b"\x5f", b"\xa2\x02\x01\x01\x01", b"\xa2\x01\x01\x01\x01", b"\x62\xff\xfe", b"\x81" * 9 + b"\0", b"\x19\x01"):
        with pytest.raises(L.CborError):
            L.cbor_value(bad)


def test_container_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(container.write(FULL))
    (tmp_path / "b.bin").write_bytes(b"nonsense")
    rows = container.scan(spark, f"file://{tmp_path}/*.bin").collect()
    assert sorted((r.section or "") for r in rows) == sorted([*L.ORDER, ""])
    same = container.inspected(container.files(spark, f"file://{tmp_path}/*.bin"), "path").filter("error is null").count()
    assert same == 7


def test_checksums_of_any_length_and_of_short_sections_by_lookups_alone(monkeypatch):
    def plain(data: bytes) -> int:
        r = 0xFFFFFFFF
        for b in data:
            r ^= b
            for _ in range(8):
                r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
        return r ^ 0xFFFFFFFF

    rng = np.random.default_rng(7)
    for n in (0, 1, 9, 92, 511, 512, 513, 1023, 1024, 1025, 2560, 5000):
        data = rng.bytes(n)
        assert (L.crc32c(data), L.crc32c(b"\0" * n)) == (plain(data), plain(b"\0" * n))
    long = rng.bytes((3 << 20) + 77)  # more pieces than are looked up together; a register is linear in the bytes
    zeros = L.crc32c(bytes(len(long)))
    head, tail = long[: 1 << 20] + bytes(len(long) - (1 << 20)), bytes(1 << 20) + long[1 << 20 :]
    assert L.crc32c(long) == L.crc32c(head) ^ L.crc32c(tail) ^ zeros
    monkeypatch.setattr(L, "_advance", None)
    assert L.crc32c(b"123456789") == 0xE3069283


def test_faulty_containers_are_dealt_out_to_many_tasks(spark, tmp_path):
    n = 2000
    pd.DataFrame({"p_partkey": np.arange(n), "p_size": (np.arange(n) % 50 + 1).astype("int32")}).to_parquet(tmp_path / "part.parquet")
    rows = io_queries.container_faults(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) < n / 2


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(1000) / 5.0) * 0.9
    data = audio.wav_bytes(x, 8000)
    assert audio.wav_format(data)["frames"] == 1000
    np.testing.assert_allclose(audio.wav_frames(data, 10, 50), x[10:60], atol=1e-4)
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(data[:40])
    files = audio.wav_files(spark, f"file://{tmp_path}/*.wav")
    assert sorted(r.error is None for r in audio.wav_info(files).collect()) == [False, True]
    got = audio.wav_samples(files.filter("path like '%a.wav'")).toPandas().sort_values("frame")
    np.testing.assert_allclose(got["x"], x, atol=1e-4)


def test_last_block_of_a_short_file_is_pulled_by_its_whole_stretch(spark):
    files = spark.createDataFrame([("a", audio.wav_bytes(np.linspace(-1, 1, 18), 8000)), ("b", audio.wav_bytes(np.zeros(32), 8000))], "path string, content binary")
    for first, end, want in ((20, 29, {"a": [16, 17], "b": [*range(16, 32)]}), (16, 17, {"a": [16, 17], "b": [*range(16, 32)]}), (32, 40, {}), (0, 1, {"a": [*range(16)], "b": [*range(16)]})):
        wanted = spark.createDataFrame([(t, first, end) for t in "ab"], "track_id string, first_frame long, end_frame long")
        got: dict = {}
        for r in audio.pulled(audio.wav_blocks(files, 16), wanted).sort("frame").collect():
            got.setdefault(r.track_id, []).append(r.frame)
        assert got == want


def test_wav_pull_of_short_tracks_is_that_of_its_sql(spark, tmp_path):
    rows = [(n, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=n), user, n % 200 + 0.25) for n, user in enumerate(u for u in range(80) for _ in range(u * 7 % 37 + 1))]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = sorted(map(tuple, io_queries.wav_pull(spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        assert got == sorted(c.execute(io_queries.ORACLE_SQL["wav_pull"]).fetchall())


def test_wav_rejects_inconsistent_formats():
    data = bytearray(audio.wav_bytes(np.zeros(8), 8000))
    data[22] = 3
    with pytest.raises(audio.WavError):
        audio.wav_format(bytes(data))


def beat_bytes(path: str, tempi: list[int]) -> bytes:
    p = path.encode("utf-16-be") + b"\0\0"
    tags = b"PPTH" + struct.pack(">III", 16, 16 + len(p), len(p)) + p
    tags += b"PQTZ" + struct.pack(">IIIII", 24, 24 + 8 * len(tempi), 0, 0, len(tempi)) + b"".join(struct.pack(">HHI", 1, t, 0) for t in tempi)
    return b"PMAI" + struct.pack(">II", 12, 12 + len(tags)) + tags


def test_beat_files(spark):
    rows = spark.createDataFrame([("a", bytearray(beat_bytes("/x.mp3", [12_800, 12_800, 12_700]))), ("b", bytearray(b"PMAI" + b"\0" * 30))], "path string, content binary")
    beats = beatfiles.beat_rows(rows)
    got = corpus.modal_tempo(beats.filter("error is null").select("track", "tempo")).collect()
    assert [(r.track, r.modal, r.distinct, r.share_ppm) for r in got] == [("/x.mp3", 12_800, 2, 666_666)]
    assert beats.filter("error is not null").count() == 1


def test_track_list(spark):
    lines = spark.createDataFrame([("# no",), ("a b.wav 128.5",), ("  ",), ("c.wav\t90",), ("bad x",)], "value string")
    assert {(r.path, r.millibpm) for r in beatfiles.track_list(lines).collect()} == {("a b.wav", 128_500), ("c.wav", 90_000)}


def test_acceptance():
    held = ranges.Accepted()
    assert held.push(0, 100) == (100, "OK")
    assert held.push(50, 10) == (0, "CONFLICT")
    assert held.push(200, 100) == (100, "OK") and held.contiguous_end == 100
    assert held.push(100, 500) == (100, "MORE_WORK")
    assert (held.firsts, held.ends, held.contiguous_end) == ([0], [300], 300)
    assert held.push(5000, 9999) == (4096, "MORE_WORK") and held.push(0, 0) == (0, "INVALID")


def plain_acceptance(blocks: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """Block by block, frame by frame."""
    taken, out = set(), []
    for first, end in blocks:
        if first >= end or first < 0:
            out.append((0, "INVALID"))
        elif first in taken:
            out.append((0, "CONFLICT"))
        else:
            n = 0
            while first + n < end and n < 20 and first + n not in taken:
                n += 1
            taken.update(range(first, first + n))
            out.append((n, "OK" if first + n == end else "MORE_WORK"))
    return out


def test_acceptance_by_regions(spark):
    """A block that meets only rejected ones is taken; regions give what one fold over a track gives."""
    chain = [(0, 10), (5, 20), (15, 25)]
    assert [s for _, s in plain_acceptance(chain)] == ["OK", "CONFLICT", "OK"]
    rng = np.random.default_rng(5)
    some = [(int(f), int(f + n)) for f, n in zip(rng.integers(-3, 400, 120), rng.integers(0, 40, 120), strict=True)]
    tracks = {"a": chain, "b": some, "c": [(0, 1 << 20), ((1 << 18) - 5, (1 << 18) + 5)]}
    rows = [(i, t, f, e) for t, blocks in tracks.items() for i, (f, e) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "request_id long, track_id string, first_frame long, end_frame long")
    got = {(r.track_id, r.request_id): (r.accepted_frames, r.status) for r in coverage.acceptance(df, limit=20).collect()}
    assert got == {(t, i): x for t, blocks in tracks.items() for i, x in enumerate(plain_acceptance(blocks))}


def test_one_track_of_many_ranges(spark):
    """All rows in one track, over many stretches: range joins against plain loops, equal requests kept apart."""
    rng = np.random.default_rng(6)
    size = 1 << 18
    have = [(int(a), int(a) + int(n)) for a, n in zip(np.arange(60) * size // 2, rng.integers(1, size // 3, 60), strict=True)]
    want = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 30 * size, 80), rng.integers(1, 3 * size, 80), strict=True)]
    want += want[:5]
    cols = "track_id string, first_frame long, end_frame long"
    accepted, requests = spark.createDataFrame([("t", *r) for r in have], cols), spark.createDataFrame([("t", *r) for r in want], cols)

    def gap(first, end):
        at = first
        for a, b in have:
            if a <= at < b:
                at = b
        return (None, None) if at >= end else (at, min([a for a, _ in have if a > at and a < end], default=end))

    got = sorted((r.first_frame, r.end_frame, r.missing_first or -1, r.missing_end or -1) for r in coverage.first_missing(requests, accepted).collect())
    assert got == sorted((f, e, *(x or -1 for x in gap(f, e))) for f, e in want)
    columns = spark.createDataFrame([("t", c) for a, b in have for c in range(a // 1024 + 1, b // 1024)], "track_id string, column_index long")
    there = {r.column_index for r in columns.collect()}
    states = Counter((r.first_frame, r.end_frame, r.permille) for r in scheduler.progress(requests, columns, 1024).collect())
    below = lambda f, e: range(f // 1024, (e - 1) // 1024 + 1)
    share = lambda f, e: 1000 if all(c in there for c in below(f, e)) else 500 if any(c in there for c in below(f, e)) else 0
    assert states == Counter((f, e, share(f, e)) for f, e in want)


def test_generations(spark, tmp_path):
    df = spark.range(5)
    root = f"file://{tmp_path}/g"
    assert progressive.publish(spark, df, root, ["id"]) == 1
    assert progressive.publish(spark, df, root, ["id"]) is None
    assert progressive.publish(spark, spark.range(6), root, ["id"]) == 2
    # a generation without its marker doesn't count
    (tmp_path / "g" / "generation=2" / "_SUCCESS").unlink()
    assert progressive.generations(spark, root) == [1] and progressive.publish(spark, spark.range(7), root, ["id"]) == 2
    assert spark.read.parquet(f"{root}/generation=2").count() == 7


def test_coverage_of_duplicates_and_touching_blocks(spark):
    b = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 10, 20), ("a", 30, 40), ("a", 32, 35)], "track_id string, first_frame long, end_frame long")
    assert sorted((r.first_frame, r.end_frame) for r in coverage.accepted_ranges(b).collect()) == [(0, 20), (30, 40)]


def test_ranking_order(spark):
    rows = [(1, "a", 0, 10, 96, 0, 0), (2, "a", 0, 10, 32, 8, 5), (3, "a", 0, 10, 96, 0, 7), (4, "a", 0, 10, 240, 9, 0)]
    r = spark.createDataFrame(rows, "request_id long, track_id string, first_frame long, end_frame long, priority int, skips int, deadline long")
    got = [x.request_id for x in scheduler.ranked(r).orderBy("rank").collect()]
    assert got == [4, 2, 3, 1]


def test_split_keeps_both_parts(spark):
    rows = spark.createDataFrame(pd.DataFrame({"track": range(41), "stratum": ["a"] * 38 + ["b"] * 2 + ["lone"]}))
    got = corpus.split(rows, "s").groupBy("stratum", "fold").count().collect()
    assert {(r.stratum, r.fold, r["count"]) for r in got} == {("a", "holdout", 10), ("a", "development", 28), ("b", "holdout", 1), ("b", "development", 1), ("lone", "development", 1)}
    held = {r.track for r in corpus.split(rows, "s").filter("fold = 'holdout' and stratum = 'a'").collect()}
    order = sorted(range(38), key=lambda t: hashlib.sha256(f"s\0{t}".encode()).hexdigest())
    assert held == set(order[:10])


def corpus_table(spark, rows):
    return spark.createDataFrame([(t, "x", truth, reported, c) for t, truth, reported, c in rows], "track long, stratum string, truth long, reported long, confidence long")


def test_summary_counts_relations(spark):
    """An error a little over one per cent is no hit, nothing reported is no near hit, and a share of nothing is null."""
    rows = corpus_table(spark, [(1, 100_000_000, 101_000_500, 90), (2, 120_000, 120_000, 80), (3, 120_000, 60_000, 76), (4, 120_000, 0, 40), (5, 100_000, 100_100, 60)])
    r = corpus.summary(rows).first()
    assert (r.tracks, r.within_1pct, r.within_01pct, r.octave_errors, r.other_errors, r.high_confidence_errors, r.high_confidence_octave_errors) == (5, 2, 2, 1, 2, 2, 1)
    assert (r.mean_confidence_correct_e3, r.median_drift_e6) == (70_000, 5_000_000)
    sweep = {x.gate: x for x in corpus.thresholds(rows).collect()}
    assert (sweep[95].admitted, sweep[95].precision_ppm, sweep[75].octave_errors, sweep[75].precision_ppm) == (0, None, 1, 333_333)
    assert corpus.thresholds(rows.filter("track = 4")).first().recall_ppm is None


def test_results_of_other_tracks_are_refused(spark):
    base = corpus_table(spark, [(1, 120_000, 120_000, 80), (2, 120_000, 60_000, 80)])
    assert corpus.compared(base, base).first().unchanged == 2
    for other in (base.filter("track = 1"), base.union(base.filter("track = 1")), base.withColumn("track", base.track + 1)):
        with pytest.raises(Exception, match="track"):
            corpus.compared(base, other).collect()


def test_geometry_lags():
    assert Geometry(sample_rate=48_000).lags(256) == (38, 281)
