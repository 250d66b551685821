"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or at a line break.  A sentence that runs on is
cut by its content, so that copies of a passage without stops, or pasted into a sentence, fall into the same
pieces: from its ``long_words``-th word on it also ends with any word for which the number of bytes times five and
the first byte add up to a multiple of eight.  From every sentence starts one span: the shortest run of at least
``sentences`` sentences and ``min_words`` words.  Spans are hashed word by word (white space does not count) into
128 bits and joined globally; the first occurrence of a hash, by (doc_id, place), stays, and every sentence that
any later occurrence covers is removed.

Hot spans are pre-aggregated before the shuffle, and the join back to the spans is one that Spark can
split, so a span that a third of all documents hold is not one task's work.

Defined results for odd input: null and empty texts have no sentences; rows without an id are left out of
the search and kept whole by ``cleaned``; rows with equal id and text are one document; texts shorter than
a span are never touched; extra columns are ignored by ``removals`` and kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpointed, chunks, column, free_name
from .vectext import U, Texts, mix, powers

_P1, _P2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


@dataclass(frozen=True)
class SpanRules:
    sentences: int = 2
    min_words: int = 20
    long_words: int = 24


def split(t: Texts, rules: SpanRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends, text) and, for each sentence, the index of its first word and of the word after its last."""
    starts, ends, doc = t.words()
    if not len(starts):
        return starts, ends, doc, starts, starts
    last = np.ones(len(starts), bool)
    newlines = np.concatenate([[0], np.cumsum(t.bytes == 10)])
    stop = np.isin(t.bytes[ends - 1], np.frombuffer(b".!?", np.uint8))
    last[:-1] = stop[:-1] | (newlines[starts[1:]] > newlines[ends[:-1]]) | (doc[1:] != doc[:-1])
    after = np.flatnonzero(last) + 1
    into = np.arange(len(starts)) - np.repeat(np.concatenate([[0], after[:-1]]), np.diff(after, prepend=0))
    last |= (into >= rules.long_words) & (((ends - starts) * 5 + t.bytes[starts]) % 8 == 0)
    after = np.flatnonzero(last) + 1
    return starts, ends, doc, np.concatenate([[0], after[:-1]]), after


def spans(t: Texts, rules: SpanRules) -> tuple[np.ndarray, ...]:
    """For each span: its text, first sentence in that text, number of sentences, and two hashes."""
    starts, ends, doc, first, after = split(t, rules)
    none = np.zeros(0, np.int64)
    if len(first) < rules.sentences:
        return none, none, none, none, none
    sdoc = doc[first]
    i = np.arange(len(first))
    # the first sentence end that is far enough in sentences and in words
    j = np.maximum(i + rules.sentences, np.searchsorted(after, first + rules.min_words) + 1)
    ok = j <= len(first)
    ok[ok] &= sdoc[j[ok] - 1] == sdoc[i[ok]]
    i, j = i[ok], j[ok]
    h = t.span_hash(starts, ends)
    out = []
    for base in (_P1, _P2):
        inverse = pow(base, -1, 1 << 64)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ U(base)) * powers(base, len(h)), dtype=np.uint64)])
        out.append(mix((prefix[after[j - 1]] - prefix[first[i]]) * powers(inverse, len(h))[first[i]]).view(np.int64))
    number = np.arange(len(first)) - np.searchsorted(sdoc, sdoc)
    return sdoc[i], number[i], j - i, *out


def span_rows(docs: DataFrame, rules: SpanRules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            d, i, n, h1, h2 = spans(Texts(column(batch, "text")), rules)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), column(batch, "doc_id").take(pa.array(d)), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h1", "h2", "doc_id", "i", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, i int, n int")


def removals(docs: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """One row for each document that loses sentences: (doc_id, sentences, first_docs).

    ``sentences`` are the places removed, in order; ``first_docs`` the documents that keep them.
    """
    rows = span_rows(docs, rules)
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "i")).alias("first"), F.max(F.struct("doc_id", "i")).alias("last")).filter("first <> last").select("h1", "h2", "first")
    later = rows.join(checkpointed(first), ["h1", "h2"]).filter(F.struct("doc_id", "i") > F.col("first"))
    # per document only: as many places as it has sentences
    return later.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("i", F.col("i") + F.col("n") - 1))))).alias("sentences"),
        F.array_sort(F.collect_set("first.doc_id")).alias("first_docs"),
    )


def cleaned(docs: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """``docs`` with the removed sentences cut out of the texts; all columns stay, ``n_chars`` is the new length."""
    names, schema = docs.columns, docs.schema
    key, places = free_name("__id", names), free_name("__cut", names)
    gone = removals(docs, rules).select(F.col("doc_id").alias(key), F.col("sentences").alias(places))
    both = docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left").select(*names, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            cuts = column(batch, places).to_pylist()
            out = batch.drop_columns([places])
            if any(cuts):
                texts = column(out, "text").to_pylist()
                for k, cut in enumerate(cuts):
                    if cut:
                        t = Texts(pa.array([texts[k]]))
                        starts, ends, _, first, after = split(t, rules)
                        keep = np.ones(len(t.bytes), bool)
                        for c in cut:
                            keep[starts[first[c]] : starts[after[c]] if after[c] < len(starts) else len(t.bytes)] = False
                        texts[k] = t.bytes[keep].tobytes().decode()
                cols = [column(out, c) for c in names]
                cols[names.index("text")] = pa.array(texts, pa.string())
                out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out

    out = both.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def summary(docs: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    return removals(docs, rules).select("doc_id", F.size("sentences").cast("long").alias("n_removed"), F.array_join("sentences", ",").alias("sentences"), F.array_join("first_docs", ",").alias("first_docs"))
