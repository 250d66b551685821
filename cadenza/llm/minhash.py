"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles.  Every shingle has a Poisson process of points
(time, weight, register); the weight axis is cut at 0, 1, 2, 4, 8, ... and each interval has a process of
its own, whose points are thinned by their place inside the interval.  A document takes the points below
its shingle's multiplicity, and register ``i`` holds the earliest time with that register, so two
documents agree in a register with a probability equal to their weighted Jaccard similarity.  Times of a
process come in increasing order, and it ends once they pass the document's latest register.

Registers are banded.  In every band bucket the documents are compared with a pivot, the one that shares
most buckets with others, by exact multiset overlap.  Documents that stay outside their pivot's component may
still be near others of the bucket.  They meet by an exact prefix join: in a pivot's group shingles are
ordered with those the pivot lacks first, a pair at the threshold shares one of the first fifth of either, and
the places of the first shared one bound the overlap, which rules out nearly all pairs around a common
original inside the join.  What is left is compared exactly.  So links are lost neither to hot buckets nor
to a cap, and no bucket is expanded into pairs.

Defined results for odd input: rows with equal ids count as one document; null ids stay out of the result;
texts of fewer than five words are one shingle; null texts and texts without a word are alone in their
class; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpointed, chunks, column, fitted, free_name
from .components import components
from .vectext import U, Texts, mix, ngram_hash, unit


@dataclass(frozen=True)
class NearRules:
    shingle_words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4


def shingles(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the word shingles of all texts, the text of each, and the number of texts."""
    t = Texts(col, lower=True)
    starts, ends, doc = t.words()
    h = t.span_hash(starts, ends)
    key, ok = ngram_hash(h, doc, words)
    n_words = np.bincount(doc, minlength=t.n)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    first = np.cumsum(n_words) - n_words
    extra = np.array([mix(np.array([np.bitwise_xor.reduce(mix(h[first[d] : first[d] + n_words[d]] + np.arange(1, n_words[d] + 1, dtype=np.uint64)))], np.uint64))[0] for d in short], np.uint64)
    return np.concatenate([key[ok], extra]), np.concatenate([doc[ok], short]), t.n


def weighted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with multiplicities, by text."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], doc[at], np.diff(np.append(at, len(key)))


def signatures(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash registers, a row of ``m`` times for each text; infinite for texts without shingles."""
    reg = np.full(n * m, np.inf)
    level_doc, level_key, lo, width, cap = [], [], [], [], []
    start, size, level = 0, 1, 0
    live = np.arange(len(key))
    while len(live):
        level_doc.append(doc[live])
        level_key.append(mix(key[live] + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        lo.append(np.full(len(live), start, float))
        width.append(np.full(len(live), size, float))
        cap.append(weight[live].astype(float))
        start, size, level = start + size, max(1, start + size), level + 1
        live = live[weight[live] > start]
    if not level_doc:
        return reg.reshape(n, m)
    d, k, lo, width, cap = (np.concatenate(x) for x in (level_doc, level_key, lo, width, cap))
    t = np.zeros(len(d))
    step = 0
    while len(d):
        step += 1
        a = mix(k + U(step * 0xD1342543DE82EF95 % 2**64))
        b = mix(a + U(0x9E3779B97F4A7C15))
        t = t - np.log(unit(a)) / (width * m)
        slot = d * m + (b % U(m)).astype(np.int64)
        inside = (lo == 0) | (lo + width * unit(mix(b)) < cap)
        np.minimum.at(reg, slot[inside], t[inside])
        worst = reg.reshape(n, m).max(axis=1)
        go = np.flatnonzero(t <= worst[d])
        d, k, t, lo, width, cap = d[go], k[go], t[go], lo[go], width[go], cap[go]
    return reg.reshape(n, m)


def band_keys(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(reg).view(np.uint64).reshape(len(reg), bands, rows)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(rows):
        acc = mix(acc ^ bits[:, :, r])
    return acc.view(np.int64)


def sketches(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, cls, bands) of the documents with words; ``cls`` is equal for equal shingle multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            key, doc, n = shingles(column(batch, "text"), rules.shingle_words)
            key, doc, weight = weighted(key, doc)
            bands = band_keys(signatures(key, doc, weight, n, rules.bands * rules.rows), rules.bands, rules.rows)
            cls = np.zeros(n, np.uint64)
            np.add.at(cls, doc, mix(key ^ mix(weight.astype(np.uint64))))
            some = np.flatnonzero(np.bincount(doc, minlength=n) > 0)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(some)), pa.array(cls[some].view(np.int64)), pa.ListArray.from_arrays(np.arange(0, len(some) * rules.bands + 1, rules.bands, dtype=np.int32), pa.array(bands[some].ravel()))],
                names=["doc_id", "cls", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(run, "doc_id long, cls long, bands array<long>")


def prints(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, print): the shingle multiset as sorted 32-bit prints, one for each occurrence, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 * CHUNK_BYTES):
            key, doc, n = shingles(column(batch, "text"), rules.shingle_words)
            key, doc, weight = weighted(key, doc)
            nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            full = (mix(np.repeat(key, weight) + nth.astype(np.uint64)) >> U(32)).astype("<u4")
            doc = np.repeat(doc, weight)
            order = np.lexsort((full, doc))
            raw, stop = full[order].tobytes(), np.cumsum(np.bincount(doc, minlength=n)) * 4
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)], pa.binary())], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print binary")


def overlap(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose multisets have a weighted Jaccard similarity of ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = column(batch, "pa"), column(batch, "pb")
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = held.select(F.col("doc_id").alias("a"), F.col("print").alias("pa"))
    b = held.select(F.col("doc_id").alias("b"), F.col("print").alias("pb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


_MASKS = ("m0", "m1", "m2", "m3")


def prefixes(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """For (pivot, doc, comp, rest) the first elements of each document in its pivot's order, with their places, the document's size and how many of its elements the pivot lacks, and which of 256 classes these fall in: (pivot, token, doc, comp, rest, size, own, m0 .. m3, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes, own, masks = [], [], [], []
            for p, q in zip(column(batch, "pd"), column(batch, "pp"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")
                shared = np.isin(p, q)
                need = int(np.ceil(similarity * len(p) - 1e-9))
                tokens.append(np.concatenate([p[~shared], p[shared]])[: len(p) - need + 1].astype(np.int64))
                sizes.append(len(p))
                own.append(len(p) - int(shared.sum()))
                bits = np.zeros(256, np.uint8)
                bits[p[~shared] & 255] = 1
                masks.append(np.packbits(bits).view(np.int64))
            n = np.array([len(t) for t in tokens], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c).take(row) for c in ("pivot", "doc", "comp", "rest")), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])), *(pa.array(np.repeat(np.array(c, np.int32), n)) for c in (sizes, own)), *(pa.array(np.repeat(np.array([m[j] for m in masks], np.int64), n)) for j in range(4)), pa.array(place.astype(np.int32))],
                names=["pivot", "doc", "comp", "rest", "token", "size", "own", *_MASKS, "place"],
            )

    d = held.select(F.col("doc_id").alias("doc"), F.col("print").alias("pd"))
    p = held.select(F.col("doc_id").alias("pivot"), F.col("print").alias("pp"))
    rows = pairs.join(d, "doc").join(p, "pivot").select("pivot", "doc", "comp", "rest", "pd", "pp")
    return rows.mapInArrow(run, "pivot long, doc long, comp long, rest boolean, token long, size int, own int, m0 long, m1 long, m2 long, m3 long, place int")


def left_over(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of one pivot, of different components, one of them at least outside the pivot's, that may reach the threshold."""
    rows = checkpointed(prefixes(pairs, held, similarity))
    x, y = (rows.select("pivot", "token", *(F.col(c).alias(f"{c}_{k}") for c in ("doc", "comp", "rest", "size", "own", *_MASKS, "place"))) for k in ("a", "b"))
    # |shared| >= s / (1 + s) * (|a| + |b|); from the first shared element on at most what is left of those the pivot lacks
    # and of those it has, each by the document that has less
    least = lambda f: F.least(f("a"), f("b"))
    col = lambda c, k: F.col(f"{c}_{k}")
    # an element of a class that the other has none of isn't shared
    alone = lambda k, o: sum(F.bit_count(col(m, k).bitwiseAND(F.bitwise_not(col(m, o)))) for m in _MASKS)
    own = F.least(*(col("own", k) - x for k, o in ("ab", "ba") for x in (col("place", k), alone(k, o)))) + least(lambda k: col("size", k) - col("own", k))
    most = F.when(F.col("place_a") < F.col("own_a"), own).otherwise(least(lambda k: col("size", k) - col("place", k)))
    enough = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-6) <= most
    once = ~F.col("rest_b") | (F.col("doc_a") < F.col("doc_b"))
    return x.filter("rest_a").join(y, ["pivot", "token"]).filter((F.col("comp_a") != F.col("comp_b")) & once & enough).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def _relabelled(label: DataFrame, found: DataFrame) -> DataFrame:
    """``label`` (doc, comp) after the links ``found``: components of components."""
    ca, cb = (label.select(F.col("doc").alias(x), F.col("comp").alias(f"c{x}")) for x in ("a", "b"))
    merged = components(found.join(ca, "a").join(cb, "b").filter("ca <> cb").select("ca", "cb"), "ca", "cb")
    return checkpointed(label.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp")))


def near_classes(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, class_id, text_id, n_links): one row for each document; ``class_id`` is the smallest id of its class, ``text_id`` that of the documents with the same multiset of shingles, and ``n_links`` the number of verified links of that text that hold the class together."""
    base = checkpointed(sketches(docs, rules).groupBy("doc_id").agg(F.min(F.struct("cls", "bands")).alias("s")).select("doc_id", "s.cls", "s.bands"))
    classes = base.groupBy("cls").agg(F.min(F.struct("doc_id", "bands")).alias("s")).select(F.col("s.doc_id").alias("doc"), "s.bands")
    rows = classes.select("doc", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = checkpointed(rows.join(sizes, "bucket"))
    n = members.count()  # bounds all tables of documents and pairs below but those of shingles
    members = fitted(members, n)
    central = members.groupBy("doc").agg(F.sum("size").alias("central"))
    members = fitted(checkpointed(members.join(central, "doc").select("bucket", "doc", "central")), n)
    ids = members.select("doc").distinct()
    held = checkpointed(prints(docs.select("doc_id", "text").join(ids.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"), rules).dropDuplicates(["doc_id"]))
    label = fitted(checkpointed(ids.select("doc", F.col("doc").alias("comp"))), n)
    links = tested = docs.sparkSession.createDataFrame([], "a long, b long")
    first = members.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("doc")).alias("n"))).alias("s")).select("bucket", (-F.col("s.n")).alias("pivot"))
    stars = fitted(checkpointed(members.join(first, "bucket").filter("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("shared"))), n)

    def verify(pairs: DataFrame) -> None:
        nonlocal links, tested, label
        pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        count = pairs.count()
        if not count:
            return
        pairs = fitted(pairs, count)
        found = checkpointed(overlap(pairs, held, rules.similarity))
        found = fitted(found, found.count())
        tested, links = tested.union(pairs), links.union(found)
        if not found.isEmpty():
            label = fitted(_relabelled(label, found), n)

    # each document against the pivot it shares most buckets with, then against the pivots of other components
    best = stars.groupBy("doc").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("n"))).alias("s")).select(F.col("doc").alias("a"), (-F.col("s.n")).alias("b"))
    verify(best)
    others = stars.join(label, "doc").join(label.select(F.col("doc").alias("pivot"), F.col("comp").alias("pc")), "pivot").filter("comp <> pc")
    verify(others.select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    # documents outside their pivot's component, with all that share the pivot
    both = stars.join(label, "doc").join(label.select(F.col("doc").alias("pivot"), F.col("comp").alias("pc")), "pivot").select("pivot", "doc", "comp", (F.col("comp") != F.col("pc")).alias("rest"))
    open_ones = both.groupBy("pivot").agg(F.max("rest").alias("any"), F.count("*").alias("n")).filter("any and n > 1").select("pivot")
    both = fitted(checkpointed(both.join(open_ones, "pivot")), n)
    if not both.isEmpty():
        verify(left_over(both, held, rules.similarity))
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    of_class = base.groupBy("cls").agg(F.min("doc_id").alias("doc")).join(label, "doc", "left").join(degree, "doc", "left").select("cls", F.col("doc").alias("text_id"), F.coalesce("comp", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    worded = base.select("doc_id", "cls").join(of_class, "cls").select("doc_id", "class_id", "text_id", "n_links")
    every = docs.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
    return every.join(worded, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id; rows without an id stay.  All columns stay as they are."""
    key = free_name("__gone", docs.columns)
    gone = near_classes(docs, rules).filter("doc_id <> class_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
