"""Annotations: tagged beat-grid files, and lists of tracks with tempi."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BeatFileError(ValueError):
    pass


#: Big-endian sizes after a tag's four letters: of its head, these letters included, and of all of it.
_SIZES = struct.Struct(">4sII")
_BEAT = np.dtype([("beat", ">u2"), ("tempo", ">u2"), ("ms", ">u4")])


def _piece(view: memoryview) -> tuple[bytes, memoryview, memoryview]:
    """The letters, head and body of the tag that ``view`` starts with."""
    if len(view) < _SIZES.size:
        raise BeatFileError("truncated tag")
    letters, head, size = _SIZES.unpack_from(view)
    if not _SIZES.size <= head <= size <= len(view):
        raise BeatFileError("tag sizes")
    return letters, view[_SIZES.size : head], view[head:size]


def _tags(data: bytes) -> Iterator[tuple[bytes, memoryview, memoryview]]:
    """All tags of a file; the file itself is one, with the others as its body."""
    letters, _, rest = _piece(memoryview(data))
    if letters != b"PMAI":
        raise BeatFileError("no file header")
    while rest:
        tag = _piece(rest)
        yield tag
        rest = rest[_SIZES.size + len(tag[1]) + len(tag[2]) :]


def _count(head: memoryview, at: int, body: memoryview, width: int) -> int:
    """A number in a tag's head, of entries of ``width`` bytes that its body must hold."""
    if len(head) < at + 4:
        raise BeatFileError("short tag head")
    n = int.from_bytes(head[at : at + 4], "big")
    if n * width > len(body):
        raise BeatFileError("more entries than bytes")
    return n


def _path(head: memoryview, body: memoryview) -> str:
    raw = bytes(body[: _count(head, 0, body, 1)])
    try:
        return raw.decode("utf-16-be").rstrip("\0")
    except UnicodeDecodeError as e:
        raise BeatFileError("path text") from e


def _tempi(head: memoryview, body: memoryview) -> list[int]:
    beats = np.frombuffer(body, _BEAT, _count(head, 8, body, _BEAT.itemsize))
    if not beats["tempo"].all():
        raise BeatFileError("a tempo of zero")
    return beats["tempo"].tolist()


#: What is read of a file, by tag; of repeated tags the last counts.
_HANDLERS = {b"PPTH": ("path", _path), b"PQTZ": ("tempi", _tempi)}


def beat_file(data: bytes) -> tuple[str, list[int]]:
    """Track path and the beats' tempi in hundredths, of a file of big-endian tags."""
    found: dict = {}
    for letters, head, body in _tags(data):
        if letters in _HANDLERS:
            name, handler = _HANDLERS[letters]
            found[name] = handler(head, body)
    if not found.get("path") or not found.get("tempi"):
        raise BeatFileError("no path or no beats")
    return found["path"], found["tempi"]


def beat_rows(files: DataFrame) -> DataFrame:
    """(path, content) to (path, track, beat, tempo, error): a row for each beat, or one with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "track", "beat", "tempo", "error"]
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    track, tempi = beat_file(bytes(c))
                    yield pd.DataFrame({"path": p, "track": track, "beat": range(len(tempi)), "tempo": tempi, "error": None}, columns=cols)
                except BeatFileError as e:
                    yield pd.DataFrame([(p, None, None, None, str(e))], columns=cols)

    return files.mapInPandas(run, "path string, track string, beat long, tempo long, error string")


def track_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path, millibpm) of lines ``path bpm``: the last blank divides, ``#`` starts a comment line."""
    text = F.trim(F.regexp_replace(value, "\t", " "))
    rows = lines.select(text.alias("line")).filter("line <> '' and not startswith(line, '#')")
    parts = rows.select(F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 1).alias("path"), F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 2).alias("bpm"))
    return parts.filter("path <> ''").select("path", F.round(F.expr("try_cast(bpm as double)") * 1000).cast("int").alias("millibpm")).filter("millibpm > 0")
