"""Language-model scoring with Elias-Fano n-gram tries.

Counts come from all training documents and all their words; every bigram and trigram seen ``min_count`` times
or more is in the model, whatever the corpus's size.  No task holds them all.  Texts are packed into batches.  Each batch
asks shards for the n-grams that its texts hold, each once and with its count in the batch's training texts; n-grams go
by their first word, those of very frequent words by their first two.  A shard adds the counts up, drops n-grams below ``min_count`` and answers with
counts and with the sums that back-off weights need.  From the answers each batch makes its part of the trie: words,
bigrams and trigrams as monotone sequences (parent * words + id) with pointers from parents to children, in Elias-Fano
code, and logarithms of probabilities and back-off weights as two-byte codes, in a file that is mapped into memory.  A look-up is a successor
search inside the range of its context.  Codes are steps of a fixed size, so a score doesn't depend on the batch.

Probabilities are interpolated absolute discounting down to the add-one unigram distribution over all
training words, so every word has one, in the trie or not:
p(w | h) = max(c(h w) - D, 0) / c(h) + backoff(h) p(w | h'), the first part for kept n-grams.

Counts of the most frequent words go to all tasks (a fixed number of entries); those of the others come with the answers.
Words are told apart by 63 bits of a hash.

Defined results for odd input: a null text counts as empty, with one token, the end; repeated rows come back as often
as they came; a null id is never held out and is kept; with no training token at
all scores use N = V = 0; very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpointed, chunks, column, held_out
from .eliasfano import EliasFano, dump, load, read
from .vectext import Texts, U, mix


@dataclass(frozen=True)
class LMRules:
    #: Most frequent words whose counts every task holds, and those of them that go by a number, the others by their hashes. No result depends on them.
    head: int = 1 << 18
    vocabulary: int = 1 << 18
    min_count: int = 2
    discount: float = 0.75
    hold_modulus: int = 7
    #: Bytes of text in a batch, tokens of it that ask together, and training tokens for each shard.
    batch_bytes: int = 16 * CHUNK_BYTES
    piece: int = 1 << 20
    shard: int = 1 << 21


#: The end token's hash, and the words' codes: the end, the start as a context, frequent words from 2 on, other words' hashes with the top bit set.
END_KEY = np.int64(0x656E64)
END, START, FIRST = 0, 1, 2
TAIL = U(1 << 63)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all tokens in order, an end after each text's words, and the text of each; few texts' bytes are in arrays at once."""
    hashes, docs, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in chunks([batch]):
        t = Texts(column(part, "text"), lower=True)
        starts, ends, doc = t.words()
        at = np.cumsum(np.bincount(doc, minlength=t.n))
        hashes.append(np.insert(t.span_hash(starts, ends).view(np.int64), at, END_KEY))
        docs.append(np.insert(doc, at, np.arange(t.n)) + before)
        before += t.n
    return np.concatenate(hashes), np.concatenate(docs), before


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of every token of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted((tokens(batch)[0] for batch in chunks(batches, limit=4 * CHUNK_BYTES)), "h")

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


#: Steps of a code for a unit of a logarithm.
STEPS = 4096


def _codebook(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in steps from the least one on, and the code of each x; logarithms of 15 digits take no more than two bytes."""
    if not len(x):
        return np.zeros(1), np.zeros(0, np.uint16)
    step = np.rint(x * STEPS).astype(np.int64)
    least, size = step.min(), step.max() - step.min() + 1
    return np.arange(least, least + size) / STEPS, (step - least).astype(np.uint16 if size <= 1 << 16 else np.uint32)


class Trie:
    """Look-ups in the mapped levels."""

    def __init__(self, buffer):
        arrays = load(buffer)
        self.v = int(arrays.pop(0)[0])
        self.grams, self.pointers, self.starts, self.probs, self.backs = {}, {}, {}, {}, {}
        for n in (2, 3):
            self.pointers[n] = read(arrays)
            self.grams[n] = read(arrays)
            self.probs[n] = (arrays.pop(0), arrays.pop(0))
            self.backs[n - 1] = (arrays.pop(0), arrays.pop(0))

    def find(self, n: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in level ``n`` of the children ``word`` of places in the level above; -1: none."""
        if n not in self.starts:
            self.starts[n] = self.pointers[n].access(np.arange(self.pointers[n].n)).astype(np.int64)
        begin, end = (self.starts[n][parent + d] for d in (0, 1))
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(begin < end)
        x = parent[some].astype(np.uint64) * np.uint64(self.v) + word[some].astype(np.uint64)
        at = self.grams[n].successor(x)
        inside = np.flatnonzero((at >= begin[some]) & (at < end[some]))
        some, at = some[inside], at[inside]
        hit = self.grams[n].access(at) == x[inside]
        out[some[hit]] = at[hit]
        return out

    def values(self, u: np.ndarray, w: np.ndarray, unigram: np.ndarray, first: np.ndarray, last: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of the second words ``w`` of bigrams and of the third words ``word`` of trigrams.

        ``unigram``: log10 p of ``w`` without context.  ``first`` and ``last``: a trigram's first and last two words as places among the bigrams.
        """
        bi = self.find(2, u, w)
        (book, code), (back, back_code) = self.probs[2], self.backs[1]
        low = back[back_code[u]] + unigram
        hit = bi >= 0
        low[hit] = book[code[bi[hit]]]
        high, above = low[last], bi[first]
        some = np.flatnonzero(above >= 0)
        book, code = self.backs[2]
        high[some] += book[code[above[some]]]
        # a kept trigram's bigrams are both kept
        some = some[bi[last[some]] >= 0]
        tri = self.find(3, above[some], word[some])
        book, code = self.probs[3]
        high[some[tri >= 0]] = book[code[tri[tri >= 0]]]
        return low, high

    def logs(self, word: np.ndarray, one: np.ndarray, two: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 p of each word after its context (-1: none); ``unigram`` holds log10 p without any."""
        out = unigram.astype(float)
        near, far = np.flatnonzero(one >= 0), np.flatnonzero((one >= 0) & (two >= 0))
        pairs, at = np.unique(np.concatenate([one[near] * self.v + word[near], two[far] * self.v + one[far]]), return_inverse=True)
        single = np.zeros(len(pairs))  # of the pairs that only are contexts it isn't read
        single[at[: len(near)]] = unigram[near]
        last = np.zeros(len(word), np.int64)
        last[near] = at[: len(near)]
        low, high = self.values(pairs // self.v, pairs % self.v, single, at[len(near) :], last[far], word[far])
        out[near] = low[last[near]]
        out[far] = high
        return out


def build(v: int, unigram: np.ndarray, bi: tuple[np.ndarray, np.ndarray], tri: tuple[np.ndarray, np.ndarray], counts: np.ndarray, discount: float, sums: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """The trie's file.  ``unigram`` and ``counts``: probabilities and context counts of ids 0 to v - 1; n-grams packed by words, sorted.

    ``sums``: discounted counts of all that follows each word and each bigram, where the model has n-grams that this trie hasn't.
    """
    (g2, c2), (g3, c3) = bi, tri
    u, w2 = g2 // v, g2 % v
    ctx = np.searchsorted(g2, g3 // v)  # every kept trigram's first two words are a kept bigram
    w3 = g3 % v
    seen = lambda c: np.maximum(c, 1).astype(float)
    sum1, sum2 = sums if sums is not None else (np.bincount(u, weights=c2 - discount, minlength=v), np.bincount(ctx, weights=c3 - discount, minlength=len(g2)))
    gamma1 = np.clip(1 - sum1 / seen(counts), 1e-9, 1)
    p2 = (c2 - discount) / seen(counts[u]) + gamma1[u] * unigram[w2]
    gamma2 = np.clip(1 - sum2 / seen(c2), 1e-9, 1)
    # p(w | second word), for the lower order part of a trigram
    low = np.searchsorted(g2, g3 % (v * v))
    low = np.minimum(low, max(len(g2) - 1, 0))
    mid = (g3 // v) % v
    p_low = np.where(g2[low] == g3 % (v * v), p2[low], gamma1[mid] * unigram[w3]) if len(g3) else np.zeros(0)
    p3 = (c3 - discount) / seen(c2[ctx]) + gamma2[ctx] * p_low if len(g3) else np.zeros(0)
    arrays = [np.array([v], np.int64)]
    for parents, parent, word, p, gamma in ((v, u, w2, p2, gamma1), (len(g2), ctx, w3, p3, gamma2)):
        starts = np.searchsorted(parent, np.arange(parents + 1))
        arrays += EliasFano.encode(starts, max(len(parent), 1)).parts()
        arrays += EliasFano.encode(parent.astype(np.uint64) * np.uint64(v) + word.astype(np.uint64), max(parents * v, 1)).parts()
        arrays += _codebook(np.log10(np.clip(p, 1e-30, 1)))
        arrays += _codebook(np.log10(gamma))
    return dump(arrays)


def mapped(blob: bytes):
    """The bytes as a memory-mapped file without a name: it goes with the process."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _counted(parts: Iterator[np.ndarray], name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(name, c) of the values of all parts; parts are joined once ``limit`` values are there, so that fewer rows are shuffled."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> pa.RecordBatch:
        values, back = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        c = np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(values)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(c)], names=[name, "c"])

    for part in parts:
        held.append(np.unique(part, return_counts=True))
        if sum(len(v) for v, _ in held) >= limit:
            yield joined()
    if held:
        yield joined()


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed string; bytes of the same place stand together."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).reshape(-1).view(a.dtype) if len(a) else a for a in arrays]
    raw = dump(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return [np.ascontiguousarray(a.view(np.uint8).reshape(a.itemsize, len(a)).T).reshape(-1).view(a.dtype) if len(a) else a for a in load(raw)]


def short(c: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    return c.astype(np.uint8 if c.max(initial=0) < 1 << 8 else np.uint32 if c.max(initial=0) < 1 << 32 else np.uint64)


@dataclass(frozen=True)
class Head:
    """What every task holds: the frequent words' hashes, sorted, with their codes; counts by code; codes of words that have many n-grams."""

    keys: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    hot: np.ndarray
    shards: int

    def coded(self, h: np.ndarray) -> np.ndarray:
        """Codes of the words with these hashes."""
        code = h.view(np.uint64) | TAIL
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            code = np.where(self.keys[slot] == h, self.codes[slot], code)
        return np.where(h == END_KEY, U(END), code)


class Piece:
    """Tokens of a batch with their distinct words, bigrams and trigrams, and what is asked of each shard.

    ``words``: codes, sorted.  ``two`` holds bigrams as place of the first word * words + place of the second, ``three`` trigrams as
    place of their first bigram * words + place of the third word, both sorted.
    """

    def __init__(self, code: np.ndarray, one: np.ndarray, two: np.ndarray, inner: np.ndarray, head: Head):
        """Codes of tokens and of the two before each; ``inner``: whether a text's token has two before it."""
        size = len(code)
        first = two[:1][inner[:1]]
        self.words, place = np.unique(np.concatenate([code, one[:1], first, np.array([START], np.uint64)]), return_inverse=True)
        self.v = len(self.words)
        self.w, start = place[:size], place[-1]
        before = np.concatenate([place[size : size + 1], self.w[:-1]])
        self.u = np.where(one == U(START), start, before)
        before = place[size + 1 : size + 1 + len(first)] * self.v + self.u[: len(first)]  # the first token's context, which is no token's bigram here
        self.two, at = np.unique(np.concatenate([self.u * self.v + self.w, before]), return_inverse=True)
        self.at2 = at[:size]
        parent = np.concatenate([at[size:] if len(first) else np.zeros(1, np.int64), self.at2[:-1]])
        self.inner = np.flatnonzero(inner)
        self.three, self.at3 = np.unique(parent[inner] * self.v + self.w[inner], return_inverse=True)
        # shards of the words that others hold the counts of, of bigrams, and of trigrams by their bigrams
        p = U(head.shards)
        own = (mix(self.words) % p).astype(np.int64)
        hot = np.isin(self.words, head.hot)
        u, w = self.two // self.v, self.two % self.v
        shard = np.where(hot[u], (mix(self.words[u] * U(0x9E3779B97F4A7C15) + self.words[w]) % p).astype(np.int64), own[u])
        tails = np.flatnonzero(self.words >= TAIL)
        self.split = []
        parts = []
        for where, of in ((tails, own[tails]), (np.arange(len(self.two)), shard), (np.arange(len(self.three)), shard[self.three // self.v])):
            order = np.argsort(of, kind="stable")
            parts.append((where[order], np.searchsorted(of[order], np.arange(head.shards + 1))))
        for s in range(head.shards):
            self.split.append([where[cuts[s] : cuts[s + 1]] for where, cuts in parts])

    def asks(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, what it is asked) with counts of the tokens that are for training."""
        c1 = np.bincount(self.w, weights=train, minlength=self.v).astype(np.int64)
        c2 = np.bincount(self.at2, weights=train, minlength=len(self.two)).astype(np.int64)
        c3 = np.bincount(self.at3, weights=train[self.inner], minlength=len(self.three)).astype(np.int64)
        rare = np.searchsorted(self.words, TAIL)
        for s, (one, two, three) in enumerate(self.split):
            if not len(one) and not len(two):
                continue
            u, w, z = self.two[two] // self.v, self.two[two] % self.v, self.three[three] % self.v
            below = np.bincount(np.searchsorted(two, self.three[three] // self.v), minlength=len(two))
            # frequent words by their codes, others by their places among those that this shard is told
            told = np.concatenate([one, u, w, z])
            told = np.unique(told[told >= rare])

            def names(x: np.ndarray, told: np.ndarray = told) -> np.ndarray:
                out = self.words[x].astype(np.uint32)
                tail = np.flatnonzero(x >= rare)
                out[tail] = np.searchsorted(told, x[tail]) | 1 << 31
                return out

            yield s, packed([self.words[told], names(one), short(c1[one]), names(u), names(w), short(c2[two]), short(below), names(z), short(c3[three])])


    def logs(self, trie: Trie, unigram: np.ndarray) -> np.ndarray:
        """log10 p of each token; ``unigram``: that of each word without context."""
        last = np.zeros(len(self.three), np.int64)
        last[self.at3] = self.at2[self.inner]
        low, high = trie.values(self.two // self.v, self.two % self.v, unigram[self.two % self.v], self.three // self.v, last, self.three % self.v)
        out = low[self.at2]
        out[self.inner] = high[self.at3]
        return out


def summed(blobs: list[bytes], base: int, rules: LMRules) -> tuple[list[bytes], bytes]:
    """A shard's answers, one for each ask, and the sums of discounted counts after frequent words, to be added to other shards'.

    ``base``: the number of codes of frequent words.
    """
    asks = [unpacked(b) for b in blobs]
    tails, back = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
    starts = np.cumsum([0] + [len(a[0]) for a in asks])

    def names(column: int) -> np.ndarray:
        """The words of all asks as numbers: codes below ``base``, then the others."""
        out = []
        for a, at in zip(asks, starts, strict=False):
            x = a[column].astype(np.int64)
            tail = x >> 31 > 0
            x[tail] = base + back[at + (x[tail] & (1 << 31) - 1)]
            out.append(x)
        return np.concatenate(out)

    whole = lambda column: np.concatenate([a[column].astype(np.int64) for a in asks])
    v = base + len(tails)
    words = names(1)
    c1 = np.bincount(words, weights=whole(2), minlength=v).astype(np.int64)
    two, at2 = np.unique(names(3) * v + names(4), return_inverse=True)
    c2 = np.bincount(at2, weights=whole(5), minlength=len(two)).astype(np.int64)
    parent = np.repeat(at2, whole(6))
    three, at3 = np.unique(parent * v + names(7), return_inverse=True)
    c3 = np.bincount(at3, weights=whole(8), minlength=len(three)).astype(np.int64)
    c2[c2 < rules.min_count] = 0
    c3[c3 < rules.min_count] = 0
    sum1 = np.bincount(two // v, weights=np.where(c2 > 0, c2 - rules.discount, 0), minlength=v)
    sum2 = np.bincount(three // v, weights=np.where(c3 > 0, c3 - rules.discount, 0), minlength=len(two))
    answers, i, j, k = [], 0, 0, 0
    for a in asks:
        x, y, z = words[i : i + len(a[1])], at2[j : j + len(a[3])], at3[k : k + len(a[7])]
        i, j, k = i + len(x), j + len(y), k + len(z)
        kept = y[c2[y] > 0]
        answers.append(packed([short(c1[x]), sum1[x], short(c2[y]), sum2[kept], short(c3[z])]))
    some = np.flatnonzero(sum1[:base])
    return answers, packed([some, sum1[some]])


def rows_of(rows: Iterator[tuple], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """(shard, batch, piece, data) in record batches of about ``limit`` bytes of data."""

    def made() -> pa.RecordBatch:
        kinds = {"shard": pa.int32(), "batch": pa.int64(), "piece": pa.int32(), "data": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def pieces_of(batch: pa.RecordBatch, head: Head, rules: LMRules) -> Iterator[tuple[int, slice, np.ndarray, Piece]]:
    """(number, tokens' places, their texts, piece) of a batch's tokens, ``piece`` of them at most at once."""
    h, doc, _ = tokens(batch)
    code = head.coded(h)
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    one = np.where(first, U(START), np.append(U(START), code[:-1]))
    two = np.append(U(START), one[:-1])
    for k, a in enumerate(range(0, len(h), rules.piece)):
        at = slice(a, min(a + rules.piece, len(h)))
        yield k, at, doc[at], Piece(code[at], one[at], two[at], ~first[at], head)


def score(docs: DataFrame, rules: LMRules = LMRules()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = held_out(F.col("doc_id"), rules.hold_modulus)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held", held)
    counts = checkpointed(word_counts(docs.filter(~F.col("held"))))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    size = min(rules.head, rules.vocabulary)
    top = counts.filter(F.col("h") != int(END_KEY)).orderBy(F.desc("c"), "h").limit(size).toArrow()
    ends = counts.filter(F.col("h") == int(END_KEY)).agg(F.sum("c").alias("c")).first()["c"] or 0
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(h)
    known = np.concatenate([[ends, ends], c]).astype(np.int64)
    shards = max(1, -(-n // rules.shard))
    hot = np.append(np.flatnonzero(known * 8 * shards > n), START).astype(np.uint64)
    shared = sc.broadcast(Head(h[order], (order + FIRST).astype(np.uint64), known, hot, shards))
    base = len(known)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in chunks(batches, limit=rules.batch_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["texts"])

    def opened(blob: bytes) -> pa.RecordBatch:
        # a copy: what Arrow slices keep the offsets of the whole
        return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]

    # written, so that batches keep their numbers; as a checkpoint, whose rows are read one by one: a Parquet reader takes thousands at once, whatever their size
    texts = checkpointed(docs.mapInArrow(pack, "texts binary").select(F.monotonically_increasing_id().alias("batch"), "texts"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(column(rows, "batch").to_pylist(), column(rows, "texts"), strict=True):
                batch = opened(blob.as_py())
                train = ~column(batch, "held").to_numpy(zero_copy_only=False).astype(bool)
                for k, _, doc, piece in pieces_of(batch, shared.value, rules):
                    yield from rows_of((s, number, k, x) for s, x in piece.asks(train[doc].astype(float)))
                pa.default_memory_pool().release_unused()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, *row in zip(*(column(batch, name).to_pylist() for name in ("shard", "batch", "piece", "data")), strict=True):
                held.setdefault(shard, []).append(row)
        for shard in sorted(held):
            rows = sorted(held.pop(shard), key=lambda r: r[:2])
            data, sums = summed([x for *_, x in rows], base, rules)
            yield from rows_of((shard, number, k, x) for (number, k, _), x in zip([*rows, (None, None, None)], [*data, sums], strict=True))

    kinds = "shard int, batch long, piece int, data binary"
    # a shard is a task, which puts the rows in order itself: Spark's sort would hold them all once more
    answers = checkpointed(texts.mapInArrow(ask, kinds).repartitionById(shards, "shard").mapInArrow(answer, kinds))
    after = np.zeros(base)
    for r in answers.filter("batch is null").select("data").orderBy("shard").toLocalIterator():
        at, x = unpacked(bytes(r["data"]))
        after[at] += x
    sums = sc.broadcast(after)
    log_base = float(np.log10(n + v + 1))

    def scored(batch: pa.RecordBatch, got: dict) -> pa.RecordBatch:
        head, after, m = shared.value, sums.value, batch.num_rows
        n_tokens, n_known, base_score, logs = (np.zeros(m) for _ in range(4))
        for k, _, doc, x in pieces_of(batch, head, rules):
            c1, s1, c2, s2, c3 = np.zeros(x.v, np.int64), np.zeros(x.v), np.zeros(len(x.two), np.int64), np.zeros(len(x.two)), np.zeros(len(x.three), np.int64)
            here = np.flatnonzero(x.words < TAIL)
            c1[here], s1[here] = head.counts[x.words[here].astype(np.int64)], after[x.words[here].astype(np.int64)]
            for s, (one, two, three) in enumerate(x.split):
                if (k, s) in got:
                    c1[one], s1[one], c2[two], after2, c3[three] = unpacked(got[k, s])
                    s2[two[c2[two] > 0]] = after2
            have2, have3 = np.flatnonzero(c2), np.flatnonzero(c3)
            three = x.two[x.three[have3] // x.v] * x.v + x.three[have3] % x.v
            trie = Trie(mapped(build(x.v, (c1 + 1.0) / (n + v + 1), (x.two[have2], c2[have2]), (three, c3[have3]), c1, rules.discount, (s1, s2[have2]))))
            unigram = np.log10(c1 + 1.0) - log_base
            one = unigram[x.w]
            n_tokens += np.bincount(doc, minlength=m)
            n_known += np.bincount(doc[c1[x.w] > 0], minlength=m)
            base_score += np.bincount(doc, weights=one, minlength=m)
            logs += np.bincount(doc, weights=x.logs(trie, unigram), minlength=m)
        columns = [column(batch, "doc_id"), column(batch, "held"), *(pa.array(a.astype(np.int64)) for a in (n_tokens, n_known, np.full(m, n))), pa.array(base_score), pa.array(logs)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for rows in batches:
            for shard, number, k, x in zip(*(column(rows, name).to_pylist() for name in ("shard", "batch", "piece", "data")), strict=True):
                held.setdefault(number, {})[k, shard] = x
        for number in sorted(held):
            got = held.pop(number)
            yield scored(opened(got.pop((-1, -1))), got)
            pa.default_memory_pool().release_unused()

    both = answers.filter("batch is not null").unionByName(texts.select(F.lit(-1).alias("shard"), "batch", F.lit(-1).alias("piece"), F.col("texts").alias("data")))
    parts = max(1, 2 * shards)
    return both.repartition(parts, "batch").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
