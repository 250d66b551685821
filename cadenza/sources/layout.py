"""Fixed record layouts of the result container, and bytes in and out of them."""

from __future__ import annotations

import struct

import numpy as np

# The container's magic, as the bytes of its definition, its versions and limits.
MAGIC = bytes([0x41, 0x50, 0x54, 0x41])
CONTAINER_VERSION, SPEC_MAJOR, SPEC_MINOR = 1, 1, 0
HEADER, ENTRY = 96, 40
UNKNOWN_FRAMES = 2**64 - 1
PARTIAL_RESULT, DURATION_UNKNOWN = 1, 2
REQUIRED = 1
ORDER = ("WOVR", "WDTL", "META", "TEMP", "LGRD", "GGRD", "REVN")
MAX_FILE, MAX_SECTIONS, MAX_SPANS, MAX_COLUMNS = 256 << 20, 64, 65_536, 16 << 20


class Record:
    """A packed little-endian record: names and struct codes in file order; names that start with _ are reserved."""

    def __init__(self, fields: str):
        pairs = [f.rsplit(":", 1) for f in fields.split()]
        self.names = [n for n, _ in pairs]
        self.codec = struct.Struct("<" + "".join(c for _, c in pairs))
        self.size = self.codec.size
        self.blank = [b"" if c.endswith("s") else 0 for _, c in pairs]
        self.held = [n for n in self.names if n.startswith("_")]

    def pack(self, values: dict) -> bytes:
        return self.codec.pack(*map(values.get, self.names, self.blank))

    def unpack(self, data: bytes, offset: int = 0) -> dict:
        return dict(zip(self.names, self.codec.unpack_from(data, offset), strict=True))

    def reserved(self, values: dict) -> bool:
        """Whether a reserved field isn't zero."""
        return any(v.strip(b"\0") if isinstance(v, bytes) else v for v in map(values.get, self.held))


HEAD = Record("magic:4s header_size:H container_version:H spec_major:H spec_minor:H producer_version:I flags:I section_count:I directory_offset:Q total_size:Q total_frames:Q sample_rate:I channels:H layout:H fingerprint:32s fingerprint_kind:I crc:I")
DIRECTORY = Record("fourcc:4s version:H flags:H offset:Q stored:Q logical:Q crc:I _r:I")
OVERVIEW = Record("level_id:I frames_per_column:I origin_frame:Q column_count:I span_count:I spans_offset:Q columns_offset:Q flags:I _r:I")
SPAN = Record("first_frame:Q end_frame:Q first_column:I column_count:I data_column:I _r:I")
COLUMN = Record("minimum:h maximum:h rms:H low:B mid:B high:B flags:B")
DETAIL = Record("tile_count:I flags:I tiles_offset:Q")
TILE = Record("level_id:I tile_index:I first_frame:Q end_frame:Q first_column:I column_count:I columns_offset:Q state:I flags:H confidence:B _r:B")
TEMPO = Record("payload_version:H state:B confidence:B flags:I tempo:I candidate_set_id:I evidence_first:Q evidence_end:Q first_frame:Q end_frame:Q candidate_count:I _r:I")
CANDIDATE = Record("tempo:I score:H confidence:B relation:B flags:I _r:I")
LOCAL = Record(
    "payload_version:H state:B confidence:B flags:I representation:I segment_count:I requested_first:Q requested_end:Q evidence_first:Q evidence_end:Q first_frame:Q end_frame:Q coverage_first:Q coverage_end:Q "
    "anchor_whole:Q anchor_frac:I _a:I anchor_ordinal:q period_whole:Q period_frac:I beat_count:I tempo:I segment_id:I revision:I segment_flags:I segment_state:B segment_confidence:B _b:H _c:I"
)
GLOBAL = Record("payload_version:H state:B confidence:B flags:I representation:I coverage_count:I segment_count:I beat_count:I requested_first:Q requested_end:Q evidence_first:Q evidence_end:Q first_frame:Q end_frame:Q coverage_first:Q coverage_end:Q _r:Q")
SEGMENT = Record("first_frame:Q end_frame:Q anchor_whole:Q anchor_frac:I _a:I anchor_ordinal:q period_whole:Q period_frac:I beat_count:I tempo:I segment_id:I revision:I flags:I state:B confidence:B _r:6s")
BEAT = Record("whole:Q frac_q32:I _a:I ordinal:q revision:I flags:I confidence:B _r:7s")
REVISION = Record("payload_version:H state:B confidence:B flags:I revision:I previous:I representation:I segment_count:I beat_count:I _a:I first_frame:Q end_frame:Q _r:32s")

#: A column as an array element: the same bytes as COLUMN.
COLUMN_TYPE = np.dtype([("minimum", "<i2"), ("maximum", "<i2"), ("rms", "<u2"), ("low", "u1"), ("mid", "u1"), ("high", "u1"), ("flags", "u1")])


def columns(values) -> np.ndarray:
    """Columns, given as an array or as dicts, as an array."""
    if isinstance(values, np.ndarray):
        return values
    return np.frombuffer(b"".join(map(COLUMN.pack, values)), COLUMN_TYPE)


_POLYNOMIAL = 0x82F63B78


def _byte_table() -> np.ndarray:
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> 1) ^ np.where(r & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return r


#: _AHEAD[k][j]: what byte j of a register becomes once 2**k zero bytes have gone by; registers are linear in their bits.
_BYTE = _byte_table()
_AHEAD: list[np.ndarray] = []


def _advance(r: np.ndarray, k: int) -> np.ndarray:
    """Registers after 2**k zero bytes."""
    while len(_AHEAD) <= k:
        one = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
        _AHEAD.append((one >> 8) ^ _BYTE[one & 0xFF] if not _AHEAD else _advance(_advance(one, len(_AHEAD) - 1), len(_AHEAD) - 1))
    t = _AHEAD[k]
    return t[0][r & 0xFF] ^ t[1][r >> 8 & 0xFF] ^ t[2][r >> 16 & 0xFF] ^ t[3][r >> 24]


#: Bytes of a piece, and bytes of pieces looked up together.
_PIECE, _TOGETHER = 1 << 9, 1 << 20


def _after(r: np.ndarray) -> np.ndarray:
    """Registers after 0 to ``_PIECE`` - 1 zero bytes, along a first axis."""
    r = r[None]
    while len(r) < _PIECE:
        r = np.concatenate([r, _advance(r, len(r).bit_length() - 1)])
    return r


#: What bytes become by their places in a piece, the last byte's row first; the places of a piece in that; the start after so many bytes.
_PLACES = _after(_BYTE).ravel()
_PLACE = np.arange(_PIECE)[::-1] * 256
_START = _after(np.uint32(0xFFFFFFFF)).tolist()


def _registers(pieces: np.ndarray) -> np.ndarray:
    """Registers of bytes, whose last axis is a piece or the end of one."""
    return np.bitwise_xor.reduce(_PLACES.take(pieces + _PLACE[_PIECE - pieces.shape[-1] :]), axis=-1)


def crc32c(data: bytes) -> int:
    """The Castagnoli CRC, reflected: each byte's part by its place in a piece, and registers of pieces joined in pairs until one is left."""
    n, bytes_ = len(data), np.frombuffer(data, np.uint8)
    if n < _PIECE:
        return int(_registers(bytes_)) ^ _START[n] ^ 0xFFFFFFFF
    rest = n % _PIECE
    whole = bytes_[rest:].reshape(-1, _PIECE)
    step = _TOGETHER // _PIECE
    levels = len(whole).bit_length()
    r = np.zeros(1 << levels, np.uint32)  # zeros before the first byte change nothing
    for at in range(0, len(whole), step):
        part = _registers(whole[at : at + step])
        r[len(r) - len(whole) + at :][: len(part)] = part
    r[-len(whole) - 1] = _registers(bytes_[:rest])
    for k in range(levels):
        k += _PIECE.bit_length() - 1
        r = _advance(r[0::2], k) ^ r[1::2]
    start = np.array([0xFFFFFFFF], np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            start = _advance(start, k)
    return int(r[0] ^ start[0]) ^ 0xFFFFFFFF


class CborError(ValueError):
    pass


def cbor_head(major: int, value: int) -> bytes:
    """The shortest head."""
    if value < 24:
        return bytes([major << 5 | value])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if value < 1 << 8 * size:
            return bytes([major << 5 | code]) + value.to_bytes(size, "big")
    raise CborError("a head holds 64 bits")


def cbor(value) -> bytes:
    """Deterministic encoding of whole numbers from 0, text, bytes, lists and maps with whole-number keys."""
    if isinstance(value, dict):
        return cbor_head(5, len(value)) + b"".join(cbor(k) + cbor(value[k]) for k in sorted(value))
    if isinstance(value, list):
        return cbor_head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, str):
        raw = value.encode()
        return cbor_head(3, len(raw)) + raw
    if isinstance(value, bytes):
        return cbor_head(2, len(value)) + value
    return cbor_head(0, value)


def cbor_value(data: bytes, at: int = 0, depth: int = 8) -> tuple[object, int]:
    """The value at ``at`` and the place after it; rejects heads that aren't the shortest and map keys out of order."""
    if at >= len(data) or not depth:
        raise CborError("truncated or too deep")
    major, code = data[at] >> 5, data[at] & 31
    at += 1
    if code < 24:
        n = code
    elif code < 28:
        size = 1 << (code - 24)
        if at + size > len(data):
            raise CborError("truncated head")
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if len(cbor_head(major, n)) != size + 1:
            raise CborError("not the shortest head")
    else:
        raise CborError("indefinite length")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise CborError("truncated string")
        raw = data[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError as e:
            raise CborError("not UTF-8") from e
    if n > 256:
        raise CborError("too many items")
    if major == 4:
        items = []
        for _ in range(n):
            v, at = cbor_value(data, at, depth - 1)
            items.append(v)
        return items, at
    if major == 5:
        out: dict = {}
        last = b""
        for _ in range(n):
            begin = at
            k, at = cbor_value(data, at, depth - 1)
            key = data[begin:at]
            if out and key <= last:
                raise CborError("keys out of order or twice")
            last = key
            out[k if not isinstance(k, (dict, list)) else repr(k)], at = cbor_value(data, at, depth - 1)
        return out, at
    if major == 7 and n in (20, 21, 22):
        return {20: False, 21: True, 22: None}[n], at
    raise CborError("unsupported kind")
