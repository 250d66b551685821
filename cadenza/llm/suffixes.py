"""Exact substring dedup by sparse suffix arrays.

Of all suffixes (at word starts) only those at minimiser positions are kept: in every window of
``min_words - gram_words + 1`` consecutive word grams the one with the least hash.  Two documents that
share ``min_words`` words therefore keep the same suffixes inside the passage.  Suffixes whose gram occurs
once can't match and go; the others get the words before and after the gram as context and are sorted globally
by (gram, words after).  Neighbours in that order are compared: the words that they share after the gram tell
for every length which suffixes agree so far to the right.  The same order by the words before, from the nearest
on, extends matches to the left.  Two suffixes match over ``min_words`` words where they agree over some words
before the gram and the rest of the length after it.  A longer match is the union of such windows at its several
minimisers.  Of equal windows the one with the least (doc_id, place) is the first; a word goes only where an equal
one stays at a lesser place, so a copy of every passage is left.

The neighbours of a gram are compared all together as long as there are ``block_rows`` of them at most.
A hotter gram's suffixes would fill one task; there every window of ``min_words`` words whose minimiser is
hot gets a hash of its own, equal hashes are pre-aggregated to their least (doc_id, place) and joined back.
Equal windows have equal minimisers, so either way meets all of them, whatever the partitions.

Defined results for odd input: null and empty texts and texts of fewer than ``min_words`` words have no
rows; rows without an id are left out; rows with equal ids count as one document; a document matches
itself only without overlap; ties are broken by id and place; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpointed, chunks, column
from .vectext import Texts, ngram_hash


@dataclass(frozen=True)
class SuffixRules:
    min_words: int = 50
    gram_words: int = 20
    block_rows: int = 20_000

    @property
    def window(self) -> int:
        return self.min_words - self.gram_words + 1


def window_minimisers(h: np.ndarray, doc: np.ndarray, rules: SuffixRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of ``min_words`` words inside a text, the place of the least gram of each, and all grams' hashes.  Of equal ones the last counts."""
    grams, ok = ngram_hash(h, doc, rules.gram_words)
    w = rules.window
    n = len(h) - rules.min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    inside = doc[:n] == doc[rules.min_words - 1 :]
    # least value of each window and its last place, by doubling
    best, at, size = grams.copy(), np.arange(len(grams)), 1
    while size < w:
        step = min(size, w - size)
        m = len(best) - step
        a, b = best[:m], best[step:]
        right = b <= a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[:m])
        size += step
    return np.flatnonzero(inside), at[:n][inside], grams


def minimisers(h: np.ndarray, doc: np.ndarray, rules: SuffixRules) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word indexes) of the least gram of each window inside a text, and the grams' hashes."""
    _, at, grams = window_minimisers(h, doc, rules)
    chosen = np.zeros(len(h), bool)
    chosen[at] = True
    pos = np.flatnonzero(chosen)
    return pos, grams[pos]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = Texts(column(batch, "text"))
    starts, ends, doc = t.words()
    counts = np.bincount(doc, minlength=t.n)
    return t.span_hash(starts, ends), doc, np.cumsum(counts) - counts


def suffix_rows(docs: DataFrame, rules: SuffixRules, left_out=None) -> DataFrame:
    """(gram, doc_id, pos) of every kept suffix, but for the broadcast, sorted grams ``left_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            h, doc, first = _words(batch)
            pos, gram = minimisers(h, doc, rules)
            if left_out is not None and len(known := left_out.value):
                keep = known[np.minimum(np.searchsorted(known, gram.view(np.int64)), len(known) - 1)] != gram.view(np.int64)
                pos, gram = pos[keep], gram[keep]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), column(batch, "doc_id").take(pa.array(doc[pos])), pa.array((pos - first[doc[pos]]).astype(np.int32))], names=["gram", "doc_id", "pos"])

    return docs.mapInArrow(run, "gram long, doc_id long, pos int")


def hot_windows(docs: DataFrame, hot, rules: SuffixRules) -> DataFrame:
    """(key, doc_id, start) of every window whose minimiser is one of the broadcast, sorted ``hot`` grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            h, doc, first = _words(batch)
            start, at, grams = window_minimisers(h, doc, rules)
            gram = grams[at].view(np.int64)
            start = start[known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram]
            key = ngram_hash(h, doc, rules.min_words)[0][start]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), column(batch, "doc_id").take(pa.array(doc[start])), pa.array((start - first[doc[start]]).astype(np.int32))], names=["key", "doc_id", "start"])

    return docs.mapInArrow(run, "key long, doc_id long, start int")


def hot_matches(docs: DataFrame, hot, rules: SuffixRules) -> DataFrame:
    """(doc_id, start, end, first, other): windows with a hot minimiser that stand elsewhere too, joined by stretches of 32 starts."""
    rows = hot_windows(docs, hot, rules)
    place = F.struct("doc_id", "start")
    firsts = rows.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b")
    # written, so that Spark can split a hot window in the join
    firsts = checkpointed(firsts.select("key", F.col("a.doc_id").alias("first_doc"), F.col("a.start").alias("first_start")))
    # a text matches itself only without overlap
    later = rows.join(firsts, "key").filter((F.col("doc_id") != F.col("first_doc")) | (F.col("start") - F.col("first_start") >= rules.min_words))
    span = lambda doc, start, first, other: F.struct(F.col(doc).alias("doc_id"), F.col(start).alias("start"), F.lit(first).alias("first"), F.col(other).alias("other"))
    both = later.select(F.inline(F.array(span("doc_id", "start", False, "first_doc"), span("first_doc", "first_start", True, "doc_id"))))
    bit = F.expr("shiftleft(1L, start % 32)")
    masks = both.groupBy("doc_id", "first", (F.col("start") / 32).cast("int").alias("stretch")).agg(F.bit_or(bit).alias("mask"), F.min("other").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, stretch = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("mask", "stretch"))
            row, lo, hi = _runs((mask[:, None] >> np.arange(32) & 1).astype(bool))
            at, base = pa.array(row), stretch[row] * 32
            ends = [pa.array(x.astype(np.int32)) for x in (base + lo, base + hi - 1 + rules.min_words)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(at), *ends, column(batch, "first").take(at), column(batch, "other").take(at)], names=["doc_id", "start", "end", "first", "other"])

    return masks.mapInArrow(run, _SPAN)


def contexts(held: DataFrame, rules: SuffixRules) -> DataFrame:
    """(gram, after, before, doc_id, pos): the words after each gram, and before it from the nearest on, as 32-bit prints in bytes."""
    k, w = rules.gram_words, rules.min_words - rules.gram_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            h, doc, first = _words(batch)
            lists = column(batch, "at")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            pos = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.bincount(doc, minlength=batch.num_rows)
            fits = (pos >= 0) & (pos + k <= size[row])
            row, pos = row[fits], pos[fits]
            at = first[row] + pos
            gram, _ = ngram_hash(h, doc, k)
            prints = (h >> np.uint64(32)).astype(">u4")  # bytes in the order of numbers: Spark sorts by them
            step = np.arange(w)
            after, before = at[:, None] + k + step, at[:, None] - 1 - step
            ra, rb = np.minimum(w, size[row] - pos - k), np.minimum(w, pos)
            fa = prints[np.clip(after, 0, len(h) - 1)][step < ra[:, None]]
            fb = prints[np.clip(before, 0, len(h) - 1)][step < rb[:, None]]
            blob = lambda flat, n: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[at].view(np.int64)), blob(fa, ra), blob(fb, rb), column(batch, "doc_id").take(pa.array(row)), pa.array(pos.astype(np.int32))],
                names=["gram", "after", "before", "doc_id", "pos"],
            )

    return held.mapInArrow(run, "gram long, after binary, before binary, doc_id long, pos int")


def _matrix(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` words, and how many of them each has."""
    words = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in blobs), ">u4").reshape(len(blobs), width)
    return words.astype(np.uint32), np.array([len(x) // 4 for x in blobs])


def _agreement(gram: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For rows in sorted ``order``, numbers that are equal where rows of one gram agree in their first 0, 1, ... words: from the words that neighbours share."""
    n, width = words.shape
    a, b = words[order[:-1]], words[order[1:]]
    differ = a != b
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[gram[order[1:]] != gram[order[:-1]]] = -1
    out = np.zeros((n, width + 1), np.int64)
    out[order[1:]] = np.cumsum(shared[:, None] < np.arange(width + 1), axis=0)
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every run of True in the rows."""
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    (row, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return row, lo, hi


def matches(gram, after, before, doc, pos, rules: SuffixRules, presorted: bool = False) -> list[tuple[int, int, int, bool, int]]:
    """Spans (doc, start, end, first, other): the windows of ``min_words`` words around each gram that another of the rows has, joined.

    ``presorted`` rows come in the order of gram and words after it.
    """
    rest = rules.min_words - rules.gram_words
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[back] > 1)
    if not len(keep):
        return []
    order = keep[np.lexsort((pos[keep], doc[keep]))]  # by place, so that the first of equal windows is the least
    gram, doc, pos = gram[order], doc[order], pos[order]
    right, ra = _matrix([after[i] for i in order], rest)
    left, rb = _matrix([before[i] for i in order], rest)
    n = len(order)
    sort = lambda words: np.lexsort((*words.T[::-1], gram))
    ahead = _agreement(gram, right, np.argsort(order, kind="stable") if presorted else sort(right))
    behind = _agreement(gram, left, sort(left))
    later, first = np.zeros((n, rest + 2), bool), np.zeros((n, rest + 2), bool)
    other = np.full(n, np.iinfo(np.int64).max)
    for k in range(rest + 1):  # words of the window before the gram
        at = np.flatnonzero((rb >= k) & (ra >= rest - k))
        key = ahead[at, rest - k] * n + behind[at, k]
        _, head, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        mine, theirs = at, at[head[back]]
        # a text matches itself only without overlap
        good = (mine != theirs) & ((doc[mine] != doc[theirs]) | (pos[mine] - pos[theirs] >= rules.min_words))
        mine, theirs = mine[good], theirs[good]
        later[mine, k] = True
        first[theirs, k] = True
        np.minimum.at(other, mine, doc[theirs])
        np.minimum.at(other, theirs, doc[mine])
    out = []
    for flags, is_first in ((first, True), (later, False)):
        row, lo, hi = _runs(flags[:, : rest + 1])  # runs of windows: words before the gram from lo to hi - 1
        start, end = pos[row] - (hi - 1), pos[row] - lo + rules.min_words
        out += zip(doc[row].tolist(), start.tolist(), end.tolist(), [is_first] * len(row), other[row].tolist(), strict=True)
    return out


_COLUMNS = ("gram", "after", "before", "doc_id", "pos")
_SPAN = "doc_id long, start int, end int, first boolean, other long"


def neighbours(ordered: DataFrame, rules: SuffixRules) -> DataFrame:
    """Matches inside each partition, which holds all suffixes of its grams, one gram after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols):
            spans = matches(np.array(cols[0]), cols[1], cols[2], np.array(cols[3]), np.array(cols[4]), rules, presorted=True) if cols[0] else []
            if spans:
                d, s, e, f, o = zip(*spans, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(f), pa.array(o, pa.int64())], names=["doc_id", "start", "end", "first", "other"])

        held: list[list] = [[] for _ in _COLUMNS]
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [a + column(batch, c).to_pylist() for a, c in zip(held, _COLUMNS, strict=True)]
            # the last gram may go on in the next batch
            cut = int(np.searchsorted(np.array(held[0]), held[0][-1]))
            yield from found([c[:cut] for c in held])
            held = [c[cut:] for c in held]
        yield from found(held)

    return ordered.mapInArrow(run, _SPAN)


def matched(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """(doc_id, start, end, first, other): the matches at every kept suffix, before those of a document are joined."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    rows = suffix_rows(docs, rules)
    twice = rows.groupBy("gram").agg(F.min(F.struct("doc_id", "pos")).alias("a"), F.max(F.struct("doc_id", "pos")).alias("b"), F.count("*").alias("n")).filter("a <> b")
    # written, so that the join has a shuffle of its own on either side and Spark can split a common gram
    twice = checkpointed(twice.select("gram", (F.col("n") > rules.block_rows).alias("hot")))
    # 8 bytes for each ``block_rows`` suffixes of the corpus at most
    hot = np.sort(twice.filter("hot").select("gram").toArrow()["gram"].to_numpy())
    known = spark.sparkContext.broadcast(hot)
    places = checkpointed(suffix_rows(docs, rules, known).join(twice.filter("not hot"), "gram").groupBy("doc_id").agg(F.collect_set("pos").alias("at")))
    held = docs.join(places, "doc_id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = neighbours(contexts(held, rules).repartitionByRange(parts, "gram").sortWithinPartitions("gram", "after"), rules)
    return found.union(hot_matches(docs, known, rules)) if len(hot) else found


def _joined(spans) -> list[list[int]]:
    """Overlapping and touching (start, end) as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def repeats(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """(doc_id, repeated, removable, other_docs): a row for each document with a repeated span.

    ``repeated`` are all its maximal spans, (start, end) in words, end exclusive; ``removable`` those of which
    an equal one stays elsewhere; ``other_docs`` documents met there.
    """
    # per document only: as many spans as it has kept suffixes
    lists = matched(docs, rules).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "first", "other")).alias("spans"))
    pair = pa.list_(pa.list_(pa.int64()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column(batch, "spans").to_pylist()
            every = [_joined({(x["start"], x["end"]) for x in r}) for r in rows]
            later = [_joined({(x["start"], x["end"]) for x in r if not x["first"]}) for r in rows]
            others = [sorted({x["other"] for x in r}) for r in rows]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(every, pair), pa.array(later, pair), pa.array(others, pa.list_(pa.int64()))], names=["doc_id", "repeated", "removable", "other_docs"])

    return lists.mapInArrow(merge, "doc_id long, repeated array<array<long>>, removable array<array<long>>, other_docs array<long>")


def summary(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """``repeats`` with numbers of words and the spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[0], x[1])), ",")
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return repeats(docs, rules).select("doc_id", words("repeated").alias("n_repeated"), words("removable").alias("n_removable"), text("repeated").alias("repeated"), text("removable").alias("removable"))
