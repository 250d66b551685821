"""SentencePiece encoding by lattice sampling, and lossless decoding.

The lattice of a text holds every piece of the vocabulary at every place where it matches.  No piece
crosses from a non-space to a space or over a line break, so the lattice falls apart into segments, and
equal segments share one forward pass.  Forward filtering gives for each end position the total weight of
all segmentations up to it; backward sampling then draws the last piece, the one before, and so on, in
proportion to these weights.  Draws come from a counter-based hash of (seed, row key, place), so a row
gets the same segmentation in any batch, order or attempt.  All of it runs over arrays of segments.

Characters outside the vocabulary, and the literal space mark, become byte pieces.  Decoding joins the
pieces and drops the leading space that encoding adds, and returns the text byte for byte.

Defined results for odd input: a null text has null ``ids``; an empty one has none; repeated rows (equal
key and text) get equal ids; a null key counts as 0; very long texts and segments are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, column
from .vectext import U, Texts, mix, unit

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_BASE = U(0x9E3779B97F4A7C15)
#: Cells of a block's lattice tables.
_CELLS = 1 << 20


@dataclass(frozen=True)
class SamplingRules:
    model: str = MODEL
    #: Inverse temperature: 0 draws all segmentations alike, large values follow the best one.
    alpha: float = 1.0
    seed: int = 0


class Table:
    """64-bit keys to small integers: three levels of direct slots, each for what collides in the one before."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.bits, self.keys, self.levels = U(64 - bits), keys, []
        rest = np.arange(len(keys))
        salt = 0x9E3779B97F4A7C15
        while len(rest):
            slots = np.full(1 << bits, -1, np.int32)
            at = (keys[rest] * U(salt)) >> self.bits
            slots[at[::-1]] = rest[::-1]
            self.levels.append((U(salt), slots))
            rest = rest[slots[at] != rest]
            salt = (salt * 0xD1342543DE82EF95 + 1) % 2**64 | 1

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for salt, slots in self.levels:
            got = slots[(h[todo] * salt) >> self.bits]
            hit = (got >= 0) & (self.keys[np.maximum(got, 0)] == h[todo])
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
            if not len(todo):
                break
        return out


class Pieces:
    """The vocabulary of a SentencePiece model as arrays."""

    def __init__(self, rules: SamplingRules):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=rules.model)
        size = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(size)], np.array([sp.get_score(i) for i in range(size)])
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        plain = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if i not in special and not sp.is_byte(i)}
        assert len(self.byte_ids) == 256 and all(" " not in p.lstrip(" ") and "\n" not in p for p in plain), "segments need byte pieces and pieces that keep to them"
        # merge ranks, as BPE models have for scores, count as places in a Zipf distribution
        logs = np.where(scores < -1e8, -np.log(size), -np.log1p(np.maximum(-scores, 0))) if scores[list(plain.values())].min() < -1000 else scores
        # weights by id; the last two entries are for -2, a character in bytes, and -1, no piece
        self.weights = np.concatenate([np.exp(rules.alpha * (logs - logs[list(plain.values())].max())), [1e-4, 0.0]])
        self.longest = max(map(len, plain))
        known: dict[str, int] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                known.setdefault(p[:k], -1)
            known[p] = i
        self.table = Table(np.array([self.key(p) for p in known], np.uint64))
        self.ids = np.array(list(known.values()), np.int64)
        text = [p.replace(MARK, " ").encode() if i not in special else b"" for i, p in enumerate(pieces)]
        for b, i in self.byte_ids.items():
            text[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.lengths = np.array([len(x) for x in text])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.byte_id = np.array([self.byte_ids[b] for b in range(256)])

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
        return h

    def edges(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids[n, end, length - 1] of the pieces in padded rows of code points; -1: none; -2 - c: character c in bytes."""
        n, width = points.shape
        longest = min(self.longest, width)
        ids = np.full(n * (width + 1) * longest, -1, np.int32)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat, cell, left = points.ravel(), (row * (width + 1) + col + 1) * longest, sizes[row] - col
        at = row * width + col
        h = np.zeros(len(row), np.uint64)
        for k in range(longest):
            h = h * _BASE + flat[at + k] + U(1)
            got = self.table.find(h)
            found = np.where(got >= 0, self.ids[got], -1)
            if k == 0:
                found = np.where(found >= 0, found, -2 - flat[at].astype(np.int64))
            ids[cell + k * (longest + 1)] = found  # it ends k places further on
            go = np.flatnonzero((got >= 0) & (left > k + 1))
            at, h, cell, left = at[go], h[go], cell[go], left[go]
        return ids.reshape(n, width + 1, longest)

    def sample(self, points: np.ndarray, sizes: np.ndarray, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Segmentations of row ``which[i]`` for each draw ``i``: the number of pieces, and for each step, from the last piece on, the draws that take it and its ids."""
        ids = self.edges(points, sizes)
        used = np.flatnonzero((ids != -1).any(axis=(0, 1)))
        ids = ids[:, :, : used[-1] + 1]
        n, ends, longest = ids.shape
        share = self.weights[np.where(ids >= -1, ids, -2)]  # of each piece, by the place where it ends
        # recent[:, k]: total weight of the segmentations up to k + 1 places before the end, over that up to the place before it
        recent = np.zeros((n, longest))
        recent[:, 0] = 1
        for end in range(1, ends):
            terms = recent * share[:, end]
            cum = np.cumsum(terms, axis=1)
            mass = np.where(cum[:, -1:] > 0, cum[:, -1:], 1.0)
            share[:, end] = cum / mass
            recent[:, 1:] = recent[:, :-1] / mass
            recent[:, 0] = 1
        ids, share = ids.reshape(-1, longest), share.reshape(-1, longest).astype(np.float32)
        at = sizes[which]
        base = which * ends
        number = np.zeros(len(which), np.int64)
        live, step, out = np.arange(len(which)), 0, []
        while len(live):
            cell = base[live] + at[live]
            r = unit(mix(seeds[live] + U((step * 0xD1342543DE82EF95) % 2**64))).astype(np.float32)
            k = (share[cell] >= np.minimum(r, np.float32(0.9999999))[:, None]).argmax(axis=1)
            out.append((live, ids[cell, k]))
            number[live] += 1
            at[live] -= k + 1
            live, step = live[at[live] > 0], step + 1
        return number, out

    def encode(self, texts, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and the number of ids of each."""
        t = Texts(pa.array([" " + x if x else "" for x in texts]) if isinstance(texts, list) else pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")))
        data = t.bytes
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        # a segment starts with its text, at a line break and after it, and where spaces start
        space, line, head = data == 0x20, data == 0x0A, t.breaks()[:-1]
        head[1:] |= line[1:] | line[:-1] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(data))
        _, sample_at, occ = np.unique(t.span_hash(starts, stops), return_index=True, return_inverse=True)
        raw = data.tobytes()
        names = [raw[i:j].decode() for i, j in zip(starts[sample_at].tolist(), stops[sample_at].tolist(), strict=True)]
        sizes = np.array([len(x) for x in names])
        docs = t.doc_of(starts)
        doc_sizes = np.bincount(docs, minlength=len(texts))
        place = np.cumsum(sizes[occ])  # a place in the chunk; less the place where its text starts
        ends = np.cumsum(doc_sizes)
        begin = np.concatenate([[0], place])[ends - doc_sizes]
        row = mix(keys.astype(np.int64).view(np.uint64) + U(seed * int(_BASE) % 2**64))
        seeds = mix(row[docs] ^ mix((place - begin[docs]).astype(np.uint64) + _BASE))
        order = np.argsort(sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_rank = np.argsort(rank[occ], kind="stable")
        ranked = rank[occ][by_rank]
        counts = np.zeros(len(occ), np.int64)
        steps, a = [], 0
        while a < len(order):
            cap = 8 if sizes[order[a]] <= 8 else 1 << int(sizes[order[a]] - 1).bit_length()  # lengths that are padded alike
            b = a + max(1, _CELLS // (cap * min(cap, self.longest)))
            b = min(b, int(np.searchsorted(sizes[order], cap, side="right")), len(order))
            block = order[a:b]
            width = int(sizes[block].max())
            points = np.frombuffer("".join([names[i].ljust(width, "\0") for i in block]).encode("utf-32-le"), np.uint32).reshape(len(block), width)
            lo, hi = np.searchsorted(ranked, [a, b])
            mine = by_rank[lo:hi]
            number, taken = self.sample(points, sizes[block], rank[occ[mine]] - a, seeds[mine])
            counts[mine] = number
            steps += [(mine[live], k, ids) for k, (live, ids) in enumerate(taken)]
            a = b
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for live, k, ids in steps:
            flat[first[live] + counts[live] - 1 - k] = ids
        per_doc = np.bincount(docs, weights=counts, minlength=len(texts)).astype(np.int64)
        return self.bytes_for(flat, per_doc)

    def bytes_for(self, flat: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as the ids of their bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, per_doc
        points, back = np.unique(-2 - flat[odd], return_inverse=True)
        coded = [np.array([self.byte_ids[b] for b in chr(c).encode()]) for c in points]
        width = np.ones(len(flat), np.int64)
        width[odd] = np.array([len(c) for c in coded])[back]
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        start = np.cumsum(width) - width
        out = np.repeat(flat, width)
        for j, c in enumerate(coded):
            at = start[odd[back == j]]
            for k, x in enumerate(c):
                out[at + k] = x
        return out, np.bincount(doc, weights=width, minlength=len(per_doc)).astype(np.int64)

    def decode_bytes(self, flat: np.ndarray) -> np.ndarray:
        """The bytes of the ids, side by side."""
        n = self.lengths[flat]
        stop = np.cumsum(n)
        return self.flat[np.arange(int(n.sum())) - np.repeat(stop - n - self.starts[flat], n)]

    def decode(self, ids) -> str:
        """The text of one row's ids: the leading space is the encoder's."""
        ids = np.asarray(ids, np.int64)
        return self.decode_bytes(ids).tobytes().decode()[1:] if len(ids) else ""


def _ids(batches: Iterator[pa.RecordBatch], rules: SamplingRules):
    pieces = Pieces(rules)
    for batch in chunks(batches, limit=2 * CHUNK_BYTES):
        col = column(batch, "text")
        key = column(batch, "row_key").fill_null(0).to_numpy(zero_copy_only=False)
        flat, sizes = pieces.encode(pc.fill_null(col, ""), key, rules.seed)
        yield batch, col, pieces, flat, sizes


def encode(docs: DataFrame, rules: SamplingRules = SamplingRules(), key: str = "doc_id") -> DataFrame:
    """``key`` and the sampled ``ids`` of each text."""

    def run(batches):
        for batch, col, _, flat, sizes in _ids(batches, rules):
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.concatenate([col.is_null().to_numpy(zero_copy_only=False), [False]]))
            yield pa.RecordBatch.from_arrays([column(batch, "row_key"), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], names=[key, "ids"])

    return docs.select(F.col(key).cast("long").alias("row_key"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, rules: SamplingRules = SamplingRules(), key: str = "doc_id") -> DataFrame:
    """``key`` and the ``text`` of each row's ids; null for null ids."""

    def run(batches):
        pieces = Pieces(rules)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("long"), "ids").mapInArrow(run, f"{key} long, text string")


def round_trips(docs: DataFrame, rules: SamplingRules = SamplingRules(), key: str = "doc_id") -> DataFrame:
    """For each row the number of pieces, a digest of the ids and whether decoding them gives the text's bytes."""

    def run(batches):
        for batch, col, pieces, flat, sizes in _ids(batches, rules):
            t = Texts(col)
            filled = np.diff(t.offsets) > 0
            back, width = pieces.decode_bytes(flat), pieces.lengths[flat]
            at = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
            same = np.diff(at) == np.diff(t.offsets) + filled
            if same.all():
                keep = np.ones(len(back), bool)
                keep[at[:-1][filled]] = False
                wrong = np.flatnonzero(back[keep] != t.bytes)
                same[t.doc_of(wrong)] = False
            else:
                same = np.array([back[a:b].tobytes() == (b" " * bool(f) + t.bytes[x:y].tobytes()) for a, b, f, x, y in zip(at, at[1:], filled, t.offsets, t.offsets[1:], strict=False)])
            ids = flat.astype("<i4").tobytes()
            stop = np.cumsum(sizes) * 4
            digest = [zlib.crc32(ids[a:b]) for a, b in zip(np.concatenate([[0], stop]), stop, strict=False)]
            null = col.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column(batch, "row_key"), pa.array(sizes, mask=null), pa.array(np.array(digest, np.int64), mask=null), pa.array(same)], names=[key, "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col(key).cast("long").alias("row_key"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, n_pieces long, ids_crc32 long, lossless boolean")
