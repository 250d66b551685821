"""The sectioned result container: canonical writer, validating reader, and both over DataFrames.

A result is a dict: ``source`` (sample_rate, channels, layout, total_frames or None, fingerprint,
fingerprint_kind, producer_version), ``overview`` (frames_per_column, state, confidence, spans with columns),
and optionally ``tiles``, ``metadata``, ``tempo``, ``local``, ``grid`` and ``revision``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import APPLIED, EXPLICIT, FINAL, HYBRID, MAX_BEATS, MAX_CANDIDATES, MAX_SEGMENTS, MAX_TEMPO, MIN_TEMPO, PENDING, PROVISIONAL, SEGMENTS
from . import layout as L

# Metadata keys and the limits of their texts in bytes.
META_KEYS = {1: ("producer_name", 255), 2: ("producer_version", 127), 3: ("backend_name", 255), 4: ("backend_version", 127), 5: ("creation_unix_time", 8), 6: ("source_id", 1024), 7: ("comments", 4096)}


class ContainerError(ValueError):
    """``code`` is corrupt, unsupported, limit or invalid."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _need(ok: bool, message: str, code: str = "corrupt") -> None:
    if not ok:
        raise ContainerError(code, message)


# -- writing


def _overview(o: dict) -> bytes:
    spans, columns, at = [], [], 0
    for s in o["spans"]:
        spans.append(L.SPAN.pack({"first_frame": s["first_frame"], "end_frame": s["end_frame"], "first_column": s["first_column"], "column_count": len(s["columns"]), "data_column": at}))
        columns.append(L.columns(s["columns"]).tobytes())
        at += len(s["columns"])
    start = L.OVERVIEW.size + len(spans) * L.SPAN.size
    head = {"level_id": 0, "frames_per_column": o["frames_per_column"], "origin_frame": 0, "column_count": o["column_count"], "span_count": len(spans), "spans_offset": L.OVERVIEW.size, "columns_offset": start, "flags": o["state"] | o.get("confidence", 255) << 8}
    return L.OVERVIEW.pack(head) + b"".join(spans) + b"".join(columns)


def _tiles(tiles: list[dict]) -> bytes:
    tiles = sorted(tiles, key=lambda t: (t["level_id"], t["tile_index"]))
    at, heads, body = L.DETAIL.size + len(tiles) * L.TILE.size, [], []
    for t in tiles:
        heads.append(L.TILE.pack(t | {"column_count": len(t["columns"]), "columns_offset": at}))
        body.append(L.columns(t["columns"]).tobytes())
        at += len(t["columns"]) * L.COLUMN.size
    return L.DETAIL.pack({"tile_count": len(tiles), "tiles_offset": L.DETAIL.size}) + b"".join(heads) + b"".join(body)


def _metadata(m: dict) -> bytes:
    total, out = 0, {}
    for key, (name, limit) in META_KEYS.items():
        v = m.get(name)
        if v is None:
            continue
        size = 0 if isinstance(v, int) else len(v if isinstance(v, bytes) else v.encode())
        _need(size <= limit, f"{name} is too long", "limit")
        total += size
        out[key] = v
    _need(total <= 8192, "metadata is too long", "limit")
    return L.cbor(out)


def finality(r: dict, check: bool = True) -> bool:
    """Whether every present section is final; a final grid with a pending revision contradicts itself."""
    grid, revision = r.get("grid"), r.get("revision")
    _need(not (check and grid and revision and grid["state"] == FINAL and revision["state"] == PENDING), "a final grid with a pending revision", "invalid")
    states = [r["overview"]["state"], *(t["state"] for t in r.get("tiles") or ()), *(r[k]["state"] for k in ("tempo", "local", "grid") if r.get(k))]
    states += [s["state"] for s in (grid or {}).get("segments", ())]
    return all(s == FINAL for s in states) and not (revision and revision["state"] == PENDING) and r["source"].get("total_frames") is not None


def write(r: dict, listed: bool = False, metadata: bytes | None = None, check: bool = True) -> bytes:
    """The canonical bytes of a result.

    For tests of readers: ``listed`` keeps candidates as they are listed, ``metadata`` stands for that section, and ``check``
    off lets a result through that contradicts itself.
    """
    sections: list[tuple[str, bytes]] = [("WOVR", _overview(r["overview"]))]
    if r.get("tiles"):
        sections.append(("WDTL", _tiles(r["tiles"])))
    if r.get("metadata"):
        sections.append(("META", _metadata(r["metadata"]) if metadata is None else metadata))
    if t := r.get("tempo"):
        # an endorsed candidate may stand first with a lower score
        candidates = t["candidates"] if listed else sorted(t["candidates"], key=lambda c: -c["score"])
        sections.append(("TEMP", L.TEMPO.pack(t | {"payload_version": 1, "candidate_count": len(candidates)}) + b"".join(L.CANDIDATE.pack(c) for c in candidates)))
    if g := r.get("local"):
        sections.append(("LGRD", L.LOCAL.pack(g | {"payload_version": 1, "representation": SEGMENTS, "segment_count": 1})))
    if g := r.get("grid"):
        counts = {"segment_count": len(g["segments"]), "beat_count": len(g.get("beats", ()))}
        sections.append(("GGRD", L.GLOBAL.pack(g | {"payload_version": 1, "coverage_count": 1} | counts) + b"".join(map(L.SEGMENT.pack, g["segments"])) + b"".join(map(L.BEAT.pack, g.get("beats", ())))))
        sections.append(("REVN", L.REVISION.pack(r["revision"] | {"payload_version": 1, "representation": g["representation"]} | counts)))
    s = r["source"]
    known = s.get("total_frames") is not None
    at, entries, body = L.HEADER + L.ENTRY * len(sections), [], []
    for name, data in sections:
        pad = -at % 8
        at += pad
        body += [b"\0" * pad, data]
        entries.append(L.DIRECTORY.pack({"fourcc": name.encode(), "version": 1, "flags": L.REQUIRED if name == "WOVR" else 0, "offset": at, "stored": len(data), "logical": len(data), "crc": L.crc32c(data)}))
        at += len(data)
    flags = (0 if finality(r, check) else L.PARTIAL_RESULT) | (0 if known else L.DURATION_UNKNOWN | L.PARTIAL_RESULT)
    head = L.HEAD.pack(
        {
            "magic": L.MAGIC, "header_size": L.HEADER, "container_version": L.CONTAINER_VERSION, "spec_major": L.SPEC_MAJOR, "spec_minor": L.SPEC_MINOR, "producer_version": s.get("producer_version", 1 << 22), "flags": flags,
            "section_count": len(sections), "directory_offset": L.HEADER, "total_size": at, "total_frames": s["total_frames"] if known else L.UNKNOWN_FRAMES, "sample_rate": s["sample_rate"], "channels": s["channels"],
            "layout": s.get("layout", 0), "fingerprint": s.get("fingerprint", b""), "fingerprint_kind": s.get("fingerprint_kind", 0),
        }
    )
    return head[:92] + L.crc32c(head[:92]).to_bytes(4, "little") + b"".join(entries) + b"".join(body)


# -- reading


def sections(data: bytes, strict: bool = True) -> tuple[dict, list[dict]]:
    """Header and directory of a container whose frame is sound."""
    _need(len(data) <= L.MAX_FILE, "the file is too large", "limit")
    _need(len(data) >= L.HEADER, "truncated header")
    head = L.HEAD.unpack(data)
    _need(head["magic"] == L.MAGIC, "magic")
    _need(head["container_version"] == L.CONTAINER_VERSION, "container version", "unsupported")
    _need(L.HEADER <= head["header_size"] <= len(data), "header size")
    _need(head["crc"] == L.crc32c(data[:92]), "header checksum")
    _need(head["total_size"] == len(data), "file size")
    _need(head["flags"] < 8, "container flags", "unsupported")
    _need(head["spec_major"] == L.SPEC_MAJOR, "specification version", "unsupported")
    _need(0 < head["sample_rate"] <= 768_000 and 1 <= head["channels"] <= 8, "source format")
    unknown = bool(head["flags"] & L.DURATION_UNKNOWN)
    _need(unknown == (head["total_frames"] == L.UNKNOWN_FRAMES), "source duration")
    _need(not unknown or head["flags"] & L.PARTIAL_RESULT, "a complete file of unknown duration")
    _need(head["fingerprint_kind"] in (0, 1, 2), "fingerprint kind", "unsupported")
    _need(head["fingerprint_kind"] or not head["fingerprint"].strip(b"\0"), "fingerprint without a kind")
    first, count = head["directory_offset"], head["section_count"]
    _need(count <= L.MAX_SECTIONS, "sections", "limit")
    _need(first >= head["header_size"] and first % 8 == 0 and first + count * L.ENTRY <= len(data), "directory")
    out, spans = [], []
    for i in range(count):
        e = L.DIRECTORY.unpack(data, first + i * L.ENTRY)
        _need(not (strict and L.DIRECTORY.reserved(e)), "reserved directory field")
        _need(not e["flags"] & 6, "compression or encryption", "unsupported")
        _need(e["flags"] < 8, "section flags", "unsupported")
        _need(e["stored"] == e["logical"], "section sizes")
        _need(e["offset"] % 8 == 0 and e["offset"] >= first + count * L.ENTRY and e["offset"] + e["stored"] <= len(data), "section bounds")
        payload = data[e["offset"] : e["offset"] + e["stored"]]
        _need(e["crc"] == L.crc32c(payload), "section checksum")
        spans.append((e["offset"], e["offset"] + e["stored"]))
        e |= {"name": e["fourcc"].decode("latin-1"), "payload": payload}
        known = e["name"] in L.ORDER
        _need(known or not e["flags"] & L.REQUIRED, f"required section {e['name']}", "unsupported")
        if known:
            _need(e["version"] == 1, "section version", "unsupported")
            _need(bool(e["flags"] & L.REQUIRED) == (e["name"] == "WOVR"), "required flag")
        out.append(e)
    spans.sort()
    _need(all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), "sections overlap")
    if strict:
        edges = [(L.HEADER, first), (first + count * L.ENTRY, spans[0][0] if spans else len(data)), *((a[1], b[0]) for a, b in zip(spans, spans[1:], strict=False))]
        _need(not any(data[a:b].strip(b"\0") for a, b in edges), "padding")
    names = [e["name"] for e in out]
    for n in L.ORDER:
        _need(n == "WDTL" or names.count(n) <= 1, f"{n} twice")
    _need(names.count("WOVR") == 1, "one overview")
    _need("TEMP" in names or not {"LGRD", "GGRD"} & set(names), "a grid without tempo")
    _need(("GGRD" in names) == ("REVN" in names), "a grid or revision alone")
    _need("GGRD" not in names or names.index("REVN") == names.index("GGRD") + 1, "grid and revision apart")
    return head, out


def _checked(record: L.Record, data: bytes, at: int, strict: bool) -> dict:
    _need(at + record.size <= len(data), "truncated record")
    v = record.unpack(data, at)
    _need(not (strict and record.reserved(v)), "reserved field")
    for k in record.held:
        del v[k]
    return v


def _columns(data: bytes, at: int, n: int) -> np.ndarray:
    _need(0 <= at and at + n * L.COLUMN.size <= len(data), "columns out of bounds")
    out = np.frombuffer(data, L.COLUMN_TYPE, n, at)
    flags = out["flags"]
    every, some = int(np.bitwise_and.reduce(flags)), int(np.bitwise_or.reduce(flags))
    _need(every & 1 == 1 and bool((out["minimum"] <= out["maximum"]).all()), "column")
    _need(some < 32, "column flags", "unsupported")
    _need(every & 8 == 8 or not (out["low"] | out["mid"] | out["high"])[flags & 8 == 0].any(), "bands without their flag")
    return out


def _read_overview(data: bytes, end: int | None, strict: bool) -> dict:
    h = _checked(L.OVERVIEW, data, 0, strict)
    n = h["frames_per_column"]
    _need(64 <= n <= 65_536 and not n & (n - 1), "column size")
    _need(h["span_count"] <= L.MAX_SPANS and h["column_count"] <= L.MAX_COLUMNS, "overview size", "limit")
    spans, last_frame, last_column = [], 0, 0
    for i in range(h["span_count"]):
        s = _checked(L.SPAN, data, h["spans_offset"] + i * L.SPAN.size, strict)
        first, count = s["first_column"], s["column_count"]
        _need(count > 0 and first >= last_column and first + count <= h["column_count"], "span columns")
        _need(s["first_frame"] == h["origin_frame"] + first * n and s["first_frame"] >= last_frame, "span start")
        whole = h["origin_frame"] + (first + count) * n
        _need(s["end_frame"] == whole or (end is not None and s["end_frame"] == end and whole - n < end < whole), "span end")
        s["columns"] = _columns(data, h["columns_offset"] + s.pop("data_column") * L.COLUMN.size, count)
        last_frame, last_column = s["end_frame"], first + count
        spans.append({k: v for k, v in s.items() if k != "column_count"})
    return {"frames_per_column": n, "column_count": h["column_count"], "state": h["flags"] & 255, "confidence": h["flags"] >> 8 & 255, "spans": spans}


def _read_tiles(parts: list[bytes], strict: bool) -> list[dict]:
    out, seen = [], set()
    for data in parts:
        h = _checked(L.DETAIL, data, 0, strict)
        ranges = []
        for i in range(h["tile_count"]):
            t = _checked(L.TILE, data, h["tiles_offset"] + i * L.TILE.size, strict)
            key = t["level_id"], t["tile_index"]
            _need(key not in seen, "a tile twice")
            seen.add(key)
            _need(0 < t["column_count"] <= 64 and t["first_frame"] < t["end_frame"], "tile")
            at, n = t.pop("columns_offset"), t.pop("column_count")
            ranges.append((at, at + n * L.COLUMN.size))
            out.append(t | {"columns": _columns(data, at, n)})
        ranges.sort()
        _need(all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False)), "tile columns overlap")
    return out


def _value(state: int, confidence: int, tempo: int | None = None) -> None:
    _need(PROVISIONAL <= state <= FINAL, "feature state")
    _need(confidence <= 100, "confidence")
    _need(tempo is None or MIN_TEMPO <= tempo <= MAX_TEMPO, "tempo range")


def _read_tempo(data: bytes, strict: bool) -> dict:
    t = _checked(L.TEMPO, data, 0, strict)
    _need(t.pop("payload_version") == 1, "tempo payload", "unsupported")
    n = t.pop("candidate_count")
    _need(1 <= n <= MAX_CANDIDATES and len(data) == L.TEMPO.size + n * L.CANDIDATE.size, "tempo size")
    _value(t["state"], t["confidence"], t["tempo"])
    _need(t["evidence_first"] < t["evidence_end"] and t["first_frame"] < t["end_frame"], "tempo ranges")
    t["candidates"] = [_checked(L.CANDIDATE, data, L.TEMPO.size + i * L.CANDIDATE.size, strict) for i in range(n)]
    scores = [c["score"] for c in t["candidates"]]
    _need(scores == sorted(scores, reverse=True), "candidate order")
    _need(all(c["relation"] <= 8 and c["confidence"] <= 100 for c in t["candidates"]), "candidates")
    _need(t["tempo"] in [c["tempo"] for c in t["candidates"]], "selected tempo")
    return t


_RANGES = ("requested", "evidence", "coverage")


def _read_local(data: bytes, tempo: dict, strict: bool) -> dict:
    _need(len(data) == L.LOCAL.size, "local grid size")
    g = _checked(L.LOCAL, data, 0, strict)
    _need(g.pop("payload_version") == 1, "local grid payload", "unsupported")
    _need(g.pop("representation") == SEGMENTS and g.pop("segment_count") == 1, "local grid kind")
    _value(g["state"], g["confidence"], g["tempo"])
    _value(g["segment_state"], g["segment_confidence"])
    _need(g["period_whole"] > 0 and g["first_frame"] < g["end_frame"] and all(g[f"{r}_first"] < g[f"{r}_end"] for r in _RANGES), "local grid ranges")
    _need(g["tempo"] == tempo["tempo"], "local grid tempo")
    return g


def _read_grid(data: bytes, revision_data: bytes, strict: bool) -> tuple[dict, dict]:
    g = _checked(L.GLOBAL, data, 0, strict)
    _need(g.pop("payload_version") == 1, "grid payload", "unsupported")
    n, m = g.pop("segment_count"), g.pop("beat_count")
    _need(1 <= n <= MAX_SEGMENTS and m <= MAX_BEATS and g.pop("coverage_count") == 1, "grid counts", "limit")
    _need(len(data) == L.GLOBAL.size + n * L.SEGMENT.size + m * L.BEAT.size, "grid size")
    _value(g["state"], g["confidence"])
    _need(g["representation"] in (SEGMENTS, EXPLICIT, HYBRID) and (g["representation"] == SEGMENTS) == (m == 0), "grid kind")
    _need(g["first_frame"] < g["end_frame"] and all(g[f"{r}_first"] < g[f"{r}_end"] for r in _RANGES), "grid ranges")
    r = _checked(L.REVISION, revision_data, 0, strict)
    _need(len(revision_data) == L.REVISION.size and r.pop("payload_version") == 1, "revision payload", "unsupported")
    _need(r["revision"] > 0 and r["state"] in (PENDING, APPLIED) and r["flags"] < 8 and r["confidence"] <= 100 and r["first_frame"] < r["end_frame"], "revision")
    _need((r.pop("representation"), r.pop("segment_count"), r.pop("beat_count")) == (g["representation"], n, m), "revision counts")
    at, last = L.GLOBAL.size, g["first_frame"]
    g["segments"], g["beats"] = [], []
    for _ in range(n):
        s = _checked(L.SEGMENT, data, at, strict)
        at += L.SEGMENT.size
        _value(s["state"], s["confidence"], s["tempo"])
        _need(last <= s["first_frame"] < s["end_frame"] <= g["end_frame"] and s["period_whole"] > 0 and s["revision"] == r["revision"], "segment")
        _need(not strict or s["flags"] < 512, "segment flags", "unsupported")
        last = s["end_frame"]
        g["segments"].append(s)
    before = None
    for _ in range(m):
        b = _checked(L.BEAT, data, at, strict)
        at += L.BEAT.size
        now = (b["whole"] << 32) + b["frac_q32"]
        _need(g["first_frame"] <= b["whole"] < g["end_frame"] and b["revision"] == r["revision"] and b["confidence"] <= 100, "beat")
        _need(before is None or (now > before[0] and b["ordinal"] > before[1]), "beat order")
        before = now, b["ordinal"]
        g["beats"].append(b)
    return g, r


def read(data: bytes, strict: bool = True) -> dict:
    """The result in a container; raises ContainerError for anything unsound."""
    head, found = sections(data, strict)
    get = {e["name"]: e["payload"] for e in found}
    total = None if head["flags"] & L.DURATION_UNKNOWN else head["total_frames"]
    out = {
        "source": {"sample_rate": head["sample_rate"], "channels": head["channels"], "layout": head["layout"], "total_frames": total, "fingerprint": head["fingerprint"], "fingerprint_kind": head["fingerprint_kind"], "producer_version": head["producer_version"]},
        "overview": _read_overview(get["WOVR"], total, strict),
    }
    if "WDTL" in get:
        out["tiles"] = _read_tiles([e["payload"] for e in found if e["name"] == "WDTL"], strict)
    if "META" in get:
        try:
            value, end = L.cbor_value(get["META"])
        except L.CborError as e:
            raise ContainerError("corrupt", f"metadata: {e}") from e
        _need(isinstance(value, dict) and end == len(get["META"]) and len(value) <= 64, "metadata")
        for key, (name, limit) in META_KEYS.items():
            v = value.get(key)
            if v is not None:
                kinds = int if key == 5 else (str, bytes) if key == 6 else str
                _need(isinstance(v, kinds) and (key == 5 or len(v if isinstance(v, bytes) else v.encode()) <= limit), f"metadata {name}")
        out["metadata"] = {name: value[key] for key, (name, _) in META_KEYS.items() if key in value}
    if "TEMP" in get:
        out["tempo"] = _read_tempo(get["TEMP"], strict)
    if "LGRD" in get:
        out["local"] = _read_local(get["LGRD"], out["tempo"], strict)
    if "GGRD" in get:
        out["grid"], out["revision"] = _read_grid(get["GGRD"], get["REVN"], strict)
    final = finality(out)
    _need(final or head["flags"] & L.PARTIAL_RESULT, "a complete file with parts that aren't final")
    return out


# -- over DataFrames


def encoded(columns: DataFrame, totals: DataFrame, sample_rate: int, frames: int) -> DataFrame:
    """(track_id, content): a container with the overview of each track; columns of a track meet in one task, as its file does."""
    key = dict(columns.dtypes)["track_id"]
    rows = columns.join(totals, "track_id")
    names = ("minimum", "maximum", "rms", "flags")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("column_index")
        total, index = int(pdf["total_frames"].iloc[0]), pdf["column_index"].to_numpy()
        cols = np.zeros(len(pdf), L.COLUMN_TYPE)
        for c in names:
            cols[c] = pdf[c].to_numpy()
        cuts = np.flatnonzero(np.diff(index) != 1) + 1
        spans = []
        for at, part in zip(np.split(index, cuts), np.split(cols, cuts), strict=True):
            first, last = int(at[0]), int(at[-1])
            spans.append({"first_frame": first * frames, "end_frame": min((last + 1) * frames, total), "first_column": first, "columns": part})
        have, want = len(pdf), -(-total // frames)
        overview = {"frames_per_column": frames, "column_count": want, "state": FINAL if have == want else 3, "confidence": have * 100 // want, "spans": spans}
        source = {"sample_rate": sample_rate, "channels": 1, "layout": 1, "total_frames": total}
        return pd.DataFrame([(pdf["track_id"].iloc[0], write({"source": source, "overview": overview, "metadata": {"producer_name": "cadenza"}}))], columns=["track_id", "content"])

    return rows.groupBy("track_id").applyInPandas(run, f"track_id {key}, content binary")


def inspected(files: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """A row for each section of each file (``key``, content): name, offset, size, checksum; files that fail have one row with their ``error``."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf["content"], strict=True):
                try:
                    read(bytes(content), strict)
                    _, found = sections(bytes(content), strict)
                    out += [(k, e["name"], e["offset"], e["stored"], e["crc"], None) for e in found]
                except ContainerError as e:
                    out.append((k, None, None, None, None, e.code))
            yield pd.DataFrame(out, columns=[key, "section", "offset", "size", "crc", "error"])

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, section string, offset long, size long, crc long, error string")


def described(files: DataFrame, key: str, only: tuple[str, ...] | None = None, strict: bool = True) -> DataFrame:
    """(key, section, json): what each section of each file says, as JSON; without columns, beats and tiles, of which there are numbers.

    ``only`` names sections; SOURC is the header's.  A file that fails has one row with its ``error`` as JSON.
    """
    kind = dict(files.dtypes)[key]
    plain = lambda v: v.hex() if isinstance(v, bytes) else int(v) if isinstance(v, np.integer) else v
    flat = lambda d, *drop: {k: plain(v) for k, v in d.items() if k not in drop}

    def parts(r: dict) -> Iterator[tuple[str, dict]]:
        o = r["overview"]
        yield "SOURC", flat(r["source"])
        yield "WOVR", flat(o, "spans") | {"spans": [flat(s, "columns") | {"columns": len(s["columns"])} for s in o["spans"]]}
        if "tiles" in r:
            yield "WDTL", {"tiles": [flat(t, "columns") | {"columns": len(t["columns"])} for t in r["tiles"]]}
        if "metadata" in r:
            yield "META", flat(r["metadata"])
        if "tempo" in r:
            yield "TEMP", flat(r["tempo"])
        if "local" in r:
            yield "LGRD", flat(r["local"])
        if "grid" in r:
            yield "GGRD", flat(r["grid"], "segments", "beats") | {"segments": [flat(s) for s in r["grid"]["segments"]], "beats": len(r["grid"]["beats"])}
            yield "REVN", flat(r["revision"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf["content"], strict=True):
                try:
                    out += [(k, name, json.dumps(d, ensure_ascii=False)) for name, d in parts(read(bytes(content), strict)) if only is None or name in only]
                except ContainerError as e:
                    out.append((k, None, json.dumps({"error": e.code})))
            yield pd.DataFrame(out, columns=[key, "section", "json"])

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, section string, json string")


def decoded_columns(files: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The overview columns of each file (``key``, content)."""
    kind = dict(files.dtypes)[key]

    names = ("minimum", "maximum", "rms", "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, content in enumerate(batch.column(1)):
                for s in read(content.as_py(), strict)["overview"]["spans"]:
                    cols = s["columns"]
                    at = pa.array(s["first_column"] + np.arange(len(cols)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(len(cols), i))), at, *(pa.array(cols[c].astype(np.int32)) for c in names)], names=[key, "column_index", *names])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, column_index long, minimum int, maximum int, rms int, flags int")


def crc32c_of(content) -> object:
    """The Castagnoli checksum of a binary column."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: L.crc32c(bytes(b)), na_action="ignore")

    return run(content)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of container files, by Spark's own binary reader: any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, section, offset, size, crc, error) of all container files below ``path``."""
    return inspected(files(spark, path), "path", strict)
