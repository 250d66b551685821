"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts is the cosine of their sets of character n-grams, all
lengths together.  A long text holds nearly every gram, so texts are cut into even pieces of ``piece_chars``
code points at most, and the kernel of two texts is the mean over their pieces.  Grams are sparse 40-bit keys.  Nyström
landmarks turn the kernel into explicit features and one-versus-rest kernel ridge regression gives each
language a score; all of it is linear in the landmarks' grams, so a model is a table of weights by gram.

The model is fitted on a bounded sample of labelled rows (``fit_per_lang`` for each of the ``max_langs`` most
frequent languages, chosen by a hash of the id); every row is scored, and a text in a language beyond these gets the
one of them that it is most like.

Defined results for odd input: null texts and texts without a letter are ``und`` with score 0; with no
labelled row to learn from every text is ``und``; null ids are scored and count as not held out;
repeated rows get equal results; very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, free_name, held_out
from .vectext import LOWER, U, Texts


@dataclass(frozen=True)
class LanguageRules:
    min_gram: int = 1
    max_gram: int = 4
    #: log2 of the gram keys' space; a piece's number takes the other bits of a 64-bit word.
    bits: int = 40
    #: Longest piece of a text whose grams are taken together, in code points.
    piece_chars: int = 2048
    #: Labelled rows to fit on and landmarks, for each language; languages learned at most.
    fit_per_lang: int = 300
    landmarks_per_lang: int = 24
    max_langs: int = 256
    ridge: float = 1e-2
    #: Steepness of the softmax that turns regression outputs into a score.
    sharpness: float = 8.0


def presence(col: pa.Array, rules: LanguageRules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, gram, weight) of the grams that texts have, for some pieces at a time; each piece has unit length over its text's number of pieces.

    Grams are runs of code points of the ASCII-lower-cased text with white space as one class and digits as another; one that crosses pieces is the earlier one's.
    """
    t = Texts(col)
    folded = np.frombuffer(LOWER[t.bytes].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64) + U(1)
    folded[(folded == 0x21) | (folded >= 0x0A) & (folded < 0x0F)] = 0x21
    folded[(folded >= 0x31) & (folded < 0x3B)] = 0x31
    # the texts' places in code points
    offsets = np.concatenate([[0], np.cumsum((t.bytes & 0xC0) != 0x80)])[t.offsets]
    size = np.diff(offsets)
    count = -(-size // rules.piece_chars)
    text = np.repeat(np.arange(t.n), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[text] + size[text] * number // np.maximum(count[text], 1)
    ends = np.append(begin[1:], len(folded))
    step = max(1, (1 << 18) // rules.piece_chars)
    p = 0
    while p < len(begin):
        q = min(len(begin), max(p + 1, int(np.searchsorted(ends, begin[p] + (1 << 18), side="right"))), p + 16 * step)
        lo, hi = begin[p], ends[q - 1]
        data = folded[lo : hi + rules.max_gram - 1]
        piece = np.repeat(np.arange(q - p, dtype=np.uint64), ends[p:q] - begin[p:q])
        left = np.repeat(offsets[text[p:q] + 1], ends[p:q] - begin[p:q]) - np.arange(lo, hi)  # code points to the end of the text
        keys, code = [], np.zeros(len(data), np.uint64)
        for n in range(1, rules.max_gram + 1):
            m = len(data) - n + 1
            if m <= 0:
                break
            code = code[:m] * U(0xD1342543DE82EF95) + data[n - 1 :]
            if n < rules.min_gram:
                continue
            salt = U(n * 0x632BE59BD9B4E019 % 2**64)  # one gram space for all lengths
            m = min(m, len(piece))
            inside = left[:m] >= n
            key = ((code[:m] + salt) * U(0x9E3779B97F4A7C15)) >> U(64 - rules.bits)
            keys.append((key | piece[:m] << U(rules.bits))[inside])
        held = np.sort(np.concatenate(keys))
        held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
        at = (held >> U(rules.bits)).astype(np.int64)
        weight = 1 / (np.sqrt(np.maximum(np.bincount(at, minlength=q - p), 1)) * count[text[p:q]])
        yield text[p:q][at], held & U((1 << rules.bits) - 1), weight[at]
        p = q


def applied(col: pa.Array, grams: np.ndarray, columns: np.ndarray, rules: LanguageRules, total: np.ndarray | None = None) -> np.ndarray:
    """Products of the texts' presence rows with ``columns``, which has a row for each of the sorted ``grams``; the rows' sums are added to ``total``."""
    out = np.zeros((len(col), columns.shape[1]))
    for text, gram, weight in presence(col, rules):
        if total is not None:
            total += np.bincount(text, weights=weight, minlength=len(col))
        slot = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        hit = grams[slot] == gram
        text, slot, weight = text[hit], slot[hit], weight[hit]
        for k in range(columns.shape[1]):
            out[:, k] += np.bincount(text, weights=weight * columns[slot, k], minlength=len(col))
    return out


@dataclass
class Model:
    langs: list[str]
    #: The landmarks' grams, sorted, and a row of one-versus-rest weights for each.
    grams: np.ndarray
    weights: np.ndarray
    #: 1 where a language's landmarks have the gram.
    known: np.ndarray
    rules: LanguageRules

    def judged(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The largest share, from 0 to 1, of each text's grams that the landmarks of one language have, and by how much the first output leads the second."""
        total, k = np.zeros(len(col)), len(self.langs)
        got = applied(col, self.grams, np.hstack([self.known, self.weights]), self.rules, total)
        best = np.sort(got[:, k:], axis=1)
        lead = best[:, -1] - best[:, -2] if k > 1 else np.full(len(col), np.inf)
        return got[:, :k].max(axis=1) / np.where(total > 0, total, 1), lead

    def outputs(self, col: pa.Array) -> np.ndarray:
        """One-versus-rest outputs: a row for each text, a column for each language."""
        return applied(col, self.grams, self.weights, self.rules)

    def scores(self, col: pa.Array) -> np.ndarray:
        """Their softmax."""
        out = self.outputs(col) * self.rules.sharpness
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def solve(texts: list[str], langs: list[str], rules: LanguageRules) -> Model | None:
    """Kernel ridge regression in Nyström features; projection and landmarks are folded into the weights."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    pick = np.concatenate([np.flatnonzero(y == k)[: rules.landmarks_per_lang] for k in range(len(names))])
    parts = list(presence(pa.array([texts[i] for i in pick]), rules))
    mark, gram, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    grams, slot = np.unique(gram, return_inverse=True)
    # kernels with a few landmarks at a time, which bounds the dense columns
    kernels = []
    for k in range(0, len(pick), 32):
        some = (mark >= k) & (mark < k + 32)
        z = np.zeros((len(grams), min(32, len(pick) - k)))
        np.add.at(z, (slot[some], mark[some] - k), weight[some])
        kernels.append(applied(pa.array(texts), grams, z, rules))
    x = np.concatenate(kernels, axis=1)
    values, vectors = np.linalg.eigh(x[pick])
    top = values > 1e-6 * values.max()
    whiten = vectors[:, top] / np.sqrt(values[top])
    phi = x @ whiten
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    beta = whiten @ np.linalg.solve(phi.T @ phi + rules.ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ target)
    weights = np.stack([np.bincount(slot, weights=weight * beta[mark, k], minlength=len(grams)) for k in range(len(names))], axis=1)
    known = np.zeros(weights.shape)
    known[slot, y[pick][mark]] = 1.0
    return Model(names, grams, weights, known, rules)


def fit(labelled: DataFrame, rules: LanguageRules = LanguageRules()) -> Model | None:
    """Learn from ``text`` and ``lang``.  What reaches the driver is bounded by ``fit_per_lang`` and ``max_langs``."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.select("lang").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rules.max_langs).collect()
    if not counts:
        return None
    # a hash of the id lets about fit_per_lang rows of each language through, whatever their number
    rank = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.25 * rules.fit_per_lang / r["count"]))])
    sample = rows.filter(rank < share[F.col("lang")]).select("doc_id", "text", "lang", rank.alias("rank"))
    got = sample.orderBy("rank", "doc_id").limit(2 * rules.fit_per_lang * len(counts)).collect()
    taken: dict[str, int] = {}
    texts, langs = [], []
    for r in got:
        if taken.get(r["lang"], 0) < rules.fit_per_lang:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            texts.append(r["text"])
            langs.append(r["lang"])
    return solve(texts, langs, rules)


def predict(docs: DataFrame, model: Model | None, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """One row for each document: ``doc_id``, ``lang_pred`` and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n = batch.num_rows
            col = column(batch, "text")
            letters = column(batch, "has_letter").to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(n, "und", object), np.zeros(n)
            for s in range(0, n, 256):
                if model is None:
                    break
                got = model.scores(col.slice(s, 256))
                names[s : s + 256] = np.array(model.langs, object)[got.argmax(axis=1)]
                score[s : s + 256] = got.max(axis=1)
            names[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    has = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), has.alias("has_letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, rules: LanguageRules = LanguageRules(), hold_modulus: int = 4) -> DataFrame:
    """Fit on the rows that aren't held out and predict every row."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), hold_modulus)), rules)
    return predict(docs, model, rules).select("doc_id", held_out(F.col("doc_id"), hold_modulus).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, rules: LanguageRules = LanguageRules(), min_known: float = 0.46, min_lead: float = 0.05, hold_modulus: int = 4) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, ``min_known`` of their grams are those of one language, and the classifier's output for one leads all others by ``min_lead``, however many there are.  All columns stay as they are."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), hold_modulus)), rules)
    schema, letter = docs.schema, free_name("__letter", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flags = column(batch, letter).to_numpy(zero_copy_only=False).astype(bool)
            good = np.zeros(batch.num_rows, bool)
            for s in range(0, batch.num_rows, 256):
                if model is not None:
                    known, lead = model.judged(column(batch, "text").slice(s, 256))
                    good[s : s + 256] = (known >= min_known) & (lead >= min_lead)
            yield batch.drop_columns([letter]).filter(pa.array(good & flags))

    has = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(letter, has).mapInArrow(run, schema)
