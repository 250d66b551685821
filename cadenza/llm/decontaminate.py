"""Benchmark decontamination by SimHash, with DataFrame functions alone.

Texts are lower-cased words of letters and digits; a shingle is five of them, weighted by how often it
stands in a window.  Windows have the sizes of the benchmark's items.  A window whose similarity to an item
is at least ``similarity`` holds at least ``2 s / (1 + s)`` of the item's shingles, so only windows with
that many shingles from items of their size are fingerprinted; no match is lost by that.  Fingerprints
of windows and items meet in a multi-index: 64 bits in four blocks, where two fingerprints within ``radius``
(at most 15) differ by at most three bits in some block; items stand in each block's index under all
values within three bits.  That gives every pair within the radius, and the exact weighted Jaccard
similarity of the shingles decides.

Defined results for odd input: null texts and texts without a word match nothing; documents without an id
are left out; texts shorter than an item are one window; items of fewer than five words are one shingle;
repeated items are all reported, of tied windows the first; rows with equal ids count as one document;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 4, 16, 3


@dataclass(frozen=True)
class LeakRules:
    shingle_words: int = 5
    similarity: float = 0.8
    radius: int = 15
    #: Rows of the benchmark's shingle table, and ids of documents with windows, up to which they are broadcast; beyond that joins shuffle.
    broadcast_rows: int = 1_000_000


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words by place; all words as one for fewer; none without a word."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


#: SimHash of a column ``h`` of hashes: bit b is set where more shingles, each as often as it occurs, have it set than not.
_SIMHASH = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * aggregate(h, 0, (n, x) -> n + cast((shiftright(x, b) & 1L) as int)) > size(h), shiftleft(1L, b), 0L))"
#: The k-th occurrence of a shingle as an element of its own, so that overlaps of sets are those of multisets.
_ELEMENTS = "transform(h, (x, i) -> xxhash64(x, size(filter(slice(h, 1, i), y -> y = x))))"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: merged projections would put its expression wherever it is used, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prepare(df: DataFrame, key: str, rules: LeakRules) -> DataFrame:
    both = _bound(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), shingle_hashes(w, rules.shingle_words).alias("h")))
    return df.select(F.col(key).cast("long").alias(key), F.col("text")).filter(F.col(key).isNotNull()).select(key, both.alias("b")).select(key, "b.n_words", "b.h")


def _neighbourhood() -> list[int]:
    """Masks of up to BLOCK_ERRORS bits of a block."""
    return [sum(1 << b for b in bits) for k in range(BLOCK_ERRORS + 1) for bits in combinations(range(BLOCK_BITS), k)]


def leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): for each document and item the most similar window."""
    k, s = rules.shingle_words, rules.similarity
    items = checkpointed(_prepare(benchmark, "item_id", rules).filter("n_words > 0").selectExpr("item_id", "n_words as size", "h", f"{_SIMHASH} as fp", f"{_ELEMENTS} as e"))
    masks = F.array(*[F.lit(m) for m in _neighbourhood()])
    wanted = items.select("size", F.explode("h").alias("h")).distinct()
    number = wanted.count()
    wanted = F.broadcast(wanted) if number <= rules.broadcast_rows else wanted
    prepared = _prepare(docs, "doc_id", rules)
    hits = prepared.select("doc_id", "n_words", F.posexplode_outer("h").alias("pos", "h")).join(wanted, "h").select("doc_id", "n_words", "pos", "size")
    # every window that holds the hit; its number of hits is how often it comes up
    hits = hits.withColumn("n", F.greatest(F.col("size") - (k - 1), F.lit(1)))
    last = F.greatest(F.col("n_words") - F.col("size"), F.lit(0))
    low = F.least(F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0)), last)
    starts = hits.select("doc_id", "size", "n", "n_words", F.explode(F.sequence(low, F.least(F.col("pos"), last))).alias("start"))
    held = F.least(F.col("n"), F.greatest(F.col("n_words") - (k - 1), F.lit(1)))
    # |shared| >= s / (1 + s) * (|window| + |item|)
    enough = F.col("shared") >= F.ceil(F.lit(s / (1 + s)) * (held + F.col("n")) - 1e-6)
    windows = starts.groupBy("doc_id", "size", "n", "n_words", "start").agg(F.count("*").alias("shared")).filter(enough)
    per_doc = checkpointed(windows.groupBy("doc_id").agg(F.collect_list(F.struct("size", "n", "start")).alias("windows")))
    # few documents have such windows: the others' texts go before anything is made of them once more
    found = F.broadcast(per_doc.select("doc_id")) if per_doc.count() <= rules.broadcast_rows else per_doc.select("doc_id")
    again = _prepare(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(found, "doc_id", "left_semi"), "doc_id", rules)
    cut = again.join(per_doc, "doc_id").select("doc_id", "h", F.explode("windows").alias("w"))
    both = F.expr(f"element_at(transform(array(slice(h, w.start + 1, w.n)), h -> struct({_SIMHASH} as fp, {_ELEMENTS} as e)), 1)")
    marked = checkpointed(cut.select("doc_id", F.col("w.start").alias("start_word"), F.col("w.size").alias("size"), both.alias("b")).select("doc_id", "start_word", "size", "b.fp", "b.e"))
    part = F.expr(f"cast(shiftrightunsigned(fp, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L as int)")
    blocks = F.explode(F.array(*[F.lit(j) for j in range(BLOCKS)])).alias("block")
    index = items.select("item_id", "fp", blocks).select("item_id", "block", F.explode(F.transform(masks, lambda m: part.bitwiseXOR(m))).alias("value"))
    # windows with one fingerprint meet the index once; its size is thousands of rows an item, which Spark's estimate for
    # a broadcast doesn't see
    prints = marked.select("fp").distinct()
    pairs = prints.select("fp", blocks).select("fp", "block", part.alias("value")).join(index.hint("merge"), ["block", "value"]).select("fp", "item_id").distinct()
    near = pairs.join(items.select("item_id", F.col("fp").alias("ifp"), F.col("e").alias("ie")), "item_id").withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))).filter(F.col("hamming") <= rules.radius)
    shared = F.size(F.array_intersect("e", "ie"))
    scored = marked.join(near, "fp").withColumn("similarity", shared / (F.size("e") + F.size("ie") - shared)).filter(F.col("similarity") >= s - 1e-12)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("n"), "size", "hamming")).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.n")).cast("long").alias("start_word"), F.col("b.size").cast("long").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"), F.round("b.similarity", 9).alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """``docs`` without the documents that hold an item.  All columns stay; rows without an id stay."""
    key = free_name("__leak", docs.columns)
    found = leaks(docs, benchmark, rules).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(key), "left_anti")
