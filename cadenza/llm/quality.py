"""Quality rules: distribution divergence from language references.

Each document gets two histograms, over character classes and over the common words of its language.  The
common words of a language are its ``common_words`` most frequent ones, counted over all its documents that are
long enough; its reference is the mean of these documents' normalised histograms.  A document fails when the
Jensen-Shannon distance (base 2, so 0 to 1) between one of its histograms and its language's reference passes a
limit; histograms of short documents are noise, so a minimum length guards each comparison.

Defined results for odd input: a null text has no words and fails the base rule; a null language, one with fewer
than ``min_reference_docs`` documents that are long enough and those beyond the ``max_languages`` with most of them
have no reference of their own, so classes are compared with the mean over all documents that are long enough and
words with none; with no reference at all (an empty table) nothing diverges; null ids and repeated rows are kept as
they are; words with equal counts go by their text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, column, stored
from .vectext import U, Texts, mix, ngram_hash

SYMBOLS = "#*$%&|<>"
#: Character classes, by byte; bytes inside a code point are skipped.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "beyond_ascii")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: Lengths below which a histogram isn't compared.
    min_chars_for_classes: int = 200
    min_words_for_common: int = 100
    #: Jensen-Shannon distances from the reference that are still kept.
    max_class_distance: float = 0.25
    max_common_distance: float = 0.32
    #: Documents a language needs for a reference of its own, and its words that are told apart.
    min_reference_docs: int = 20
    common_words: int = 32
    #: ISO 639 names fewer than 8,000 languages.
    max_languages: int = 8192


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = 9
        elif b >= 0x80:
            table[b] = -1
        elif c in "aeiou":
            table[b] = 0
        elif c.isalpha():
            table[b] = 1 if c.islower() else 2
        elif c.isdigit():
            table[b] = 3
        elif c == "\n":
            table[b] = 5
        elif c.isspace():
            table[b] = 4
        elif c in ".,;:!?":
            table[b] = 6
        elif c in SYMBOLS:
            table[b] = 8
    return table


def _long_enough(t: Texts, doc: np.ndarray, rules: QualityRules) -> np.ndarray:
    """Texts that references are made of."""
    points = np.concatenate([[0], np.cumsum((t.bytes & 0xC0) != 0x80)])
    return (np.bincount(doc, minlength=t.n) >= rules.min_words_for_common) & (np.diff(points[t.offsets]) >= rules.min_chars_for_classes)


def common_words(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(lang, docs, word, rank): the most frequent words of each language, over its documents that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=4 * CHUNK_BYTES):
            t = Texts(column(batch, "text"), lower=True)
            starts, ends, doc = t.words()
            good = np.flatnonzero(_long_enough(t, doc, rules))
            langs = column(batch, "lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = langs.dictionary
            at = np.flatnonzero(np.isin(doc, good))
            _, first, count = np.unique(t.span_hash(starts[at], ends[at]) ^ mix(code[doc[at]].astype(np.uint64) + U(1)), return_index=True, return_counts=True)
            some, raw = at[first], t.bytes.tobytes()
            found = [raw[i:j].decode() for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            owned, each = np.unique(code[good], return_counts=True)  # how many documents, as rows without a word
            lang = names.take(pa.array(np.concatenate([code[doc[some]], owned])))
            yield pa.RecordBatch.from_arrays([lang, pa.array([*found, *[None] * len(owned)], pa.string()), pa.array(np.concatenate([count, each]).astype(np.int64))], names=["lang", "word", "c"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    # Spark takes the first of each language in every partition before these few rows meet
    order = Window.partitionBy("lang").orderBy(F.col("word").isNotNull(), F.desc("c"), "word")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.common_words + 1)
    return best.select("lang", "word", "c", (F.col("rank") - 1).alias("rank"))


def vocabularies(docs: DataFrame, rules: QualityRules) -> dict[str, list[str]]:
    """The common words of each language that has enough documents: ``common_words`` rows for each come to the driver."""
    best: dict[str, list[str]] = {}
    number: dict[str, int] = {}
    for r in sorted(common_words(docs, rules).toLocalIterator(), key=lambda r: r["rank"]):
        if r["word"] is None:
            number[r["lang"]] = r["c"]
        else:
            best.setdefault(r["lang"], []).append(r["word"])
    order = sorted((x for x, n in number.items() if n >= rules.min_reference_docs), key=lambda x: (-number[x], x))
    return {x: best.get(x, []) for x in order[: rules.max_languages]}


FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_counts array<int>, common_counts array<int>"


def _features(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, list[str]], slots: int) -> Iterator[pa.RecordBatch]:
    classes = _class_table()
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    langs = {x: i for i, x in enumerate(vocabulary)}
    # a word's key holds its language; slots are places in the language's list, the last one is for all other words
    every = Texts(pa.array([w for words in vocabulary.values() for w in words], pa.string()))
    owner = np.repeat(np.arange(len(langs)), [len(words) for words in vocabulary.values()]).astype(np.int64)
    places = np.concatenate([np.arange(len(words)) for words in vocabulary.values()] or [np.zeros(0, np.int64)]).astype(np.int64)
    keys = every.span_hash(every.offsets[:-1], every.offsets[1:]) ^ mix(owner.astype(np.uint64) + U(1))
    order = np.argsort(keys)
    keys, places = keys[order], places[order]
    k, v = len(CLASSES), slots + 1
    for batch in chunks(batches):
        t = Texts(column(batch, "text"))
        n, data = t.n, t.bytes
        starts, ends, doc = t.words()
        n_words = np.bincount(doc, minlength=n)
        byte_doc = np.repeat(np.arange(n), np.diff(t.offsets))
        kind = classes[data]
        head = (data & 0xC0) != 0x80
        code_points = np.concatenate([[0], np.cumsum(head)])
        word_chars = np.bincount(doc, weights=code_points[ends] - code_points[starts], minlength=n).astype(np.int64)
        class_counts = np.bincount(byte_doc[head] * k + kind[head], minlength=n * k).reshape(n, k)
        n_symbols = np.bincount(byte_doc[symbol[data]], minlength=n)
        # lines with a word that equal an earlier line of the same text
        ls, le, ldoc = t.lines()
        firsts = np.searchsorted(starts, ls)
        worded = (firsts < len(starts)) & (starts[np.minimum(firsts, len(starts) - 1)] < le) if len(starts) else np.zeros(len(ls), bool)
        ls, le, ldoc = ls[worded], le[worded], ldoc[worded]
        line_key = t.span_hash(ls, le) ^ mix(ldoc.astype(np.uint64) + U(1))
        _, first = np.unique(line_key, return_index=True)
        n_dup = np.bincount(ldoc, minlength=n) - np.bincount(ldoc[first], minlength=n)
        # words inside 3-word windows that the text holds twice or more
        h = t.span_hash(starts, ends)
        tri, ok = ngram_hash(h, doc, 3)
        at = np.flatnonzero(ok)
        _, back, count = np.unique(tri[at] ^ mix(doc[at].astype(np.uint64) + U(1)), return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        cover = np.zeros(len(h), bool)
        for d in range(3):
            cover[twice + d] = True
        n_repeat = np.bincount(doc[cover], minlength=n)
        own = np.array([langs.get(x, -1) for x in column(batch, "lang").to_pylist()], np.int64)
        lowered = Texts(column(batch, "text"), lower=True).span_hash(starts, ends) ^ mix(own[doc].astype(np.uint64) + U(1))
        at = np.minimum(np.searchsorted(keys, lowered), max(len(keys) - 1, 0))
        slot = np.where(keys[at] == lowered, places[at], slots) if len(keys) else np.full(len(doc), slots)
        common = np.bincount(doc * v + slot, minlength=n * v).reshape(n, v)
        ints = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel().astype(np.int32)))
        longs = [pa.array(np.asarray(a, np.int64)) for a in (n_words, word_chars, n_symbols, n_dup, n_repeat)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), *longs, ints(class_counts), ints(common)], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "common_counts"])


def features(docs: DataFrame, vocabulary: dict[str, list[str]], rules: QualityRules) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    run = lambda batches: _features(batches, held.value, rules.common_words)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, FEATURES)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts from a distribution; 0 without counts or without a reference."""
    total = _total(counts)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2)
    terms = F.zip_with(F.transform(counts, lambda c: c / total), reference, both)
    return F.coalesce(F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) / 2)), F.lit(0.0))


def references(feats: DataFrame, rules: QualityRules, languages: list[str]) -> DataFrame:
    """(ref, class_mean, common_mean): mean normalised histograms over all documents that pass the length guards, by language and, with a null ``ref``, over all."""
    k, v = len(CLASSES), rules.common_words + 1
    long = feats.withColumn("chars", _total(F.col("class_counts"))).filter((F.col("n_words") >= rules.min_words_for_common) & (F.col("chars") >= rules.min_chars_for_classes))
    means = lambda c, n, size: F.array(*[F.avg(F.get(c, F.lit(i)) / F.col(n)) for i in range(size)])
    sums = [means("class_counts", "chars", k).alias("class_mean"), means("common_counts", "n_words", v).alias("common_mean")]
    own = long.groupBy(F.col("lang").alias("ref")).agg(*sums).filter(F.col("ref").isin(languages)) if languages else None
    every = long.agg(*sums).select(F.lit(None).cast("string").alias("ref"), "class_mean", F.lit(None).cast("array<double>").alias("common_mean"))
    return every if own is None else own.union(every)


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each document: base figures, distances and the verdict ``kept``."""
    vocabulary = vocabularies(docs, rules)
    feats = stored(features(docs, vocabulary, rules), "quality")
    # a row for each language and one more: at most ``max_languages`` of half a kilobyte
    refs = F.broadcast(references(feats, rules, list(vocabulary)))
    known = F.when(F.col("lang").isin(list(vocabulary)), F.col("lang")) if vocabulary else F.lit(None).cast("string")
    both = feats.withColumn("key", known).join(refs, F.col("key").eqNullSafe(F.col("ref")), "left")
    far = lambda counts, mean, size, least: F.when(size >= least, js_distance(F.col(counts), F.col(mean))).otherwise(0.0)
    both = both.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")),
        "class_distance": far("class_counts", "class_mean", _total(F.col("class_counts")), rules.min_chars_for_classes),
        "common_distance": far("common_counts", "common_mean", F.col("n_words"), rules.min_words_for_common),
    })
    kept = ~F.col("base_failed") & (F.col("class_distance") <= rules.max_class_distance) & (F.col("common_distance") <= rules.max_common_distance)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "common_distance")
