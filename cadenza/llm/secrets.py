"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

The patterns give the base spans.  The method adds candidates: runs of key-like characters that stand
shortly after a sensitive word.  A candidate's novelty is its marginal cost, the compressed size of
context and candidate less that of the context alone, with a dictionary of identifiers loaded: a short list of
those that code is full of, and those that most documents of the corpus hold (``identifiers`` of them, of up to 32
characters).  What stands where a candidate could stand isn't counted as an identifier, so that a secret with many
copies doesn't become one.  The context is what surrounds the candidate, with copies of it blanked out.  Names and prose compress
against dictionary and context; random key material doesn't, and is reported, wherever the text has it.

Defined results for odd input: a null or empty text has no spans (the digest is that of the empty
string); very long texts are scanned whole; repeated rows repeat their results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, column

KINDS = ("assign", "access", "hex", "novel")
# The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE_WORDS = (*_ASSIGN_WORDS, "private", "credential", "bearer", "auth", "signature", "access")
_SENSITIVE = re.compile("|".join(_SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z_][A-Za-z0-9_]{7,31}(?![A-Za-z0-9+/_=~-])")

#: Identifiers that code is full of; they prime the compressor, so that they cost next to nothing.
IDENTIFIERS = " ".join(
    """access_token refresh_token client_secret client_id authorization authentication authenticate credentials password_hash
    secret_access_key private_key public_key signature_algorithm bearer_token session_token csrf_token api_key_header
    config configuration settings environment production development localhost username hostname database connection
    application/json content-type text/plain https://www.example.com/ http://localhost:8080/ getElementById addEventListener
    self.assertEqual os.environ.get System.getProperty process.env import from return function class static public void
    const string integer boolean default_value placeholder your_api_key_here changeme example_secret xxxxxxxxxxxxxxxx
    0000000000000000 1111111111111111 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 the of and to in that""".split()
)


@dataclass(frozen=True)
class NoveltyRules:
    level: int = 3
    #: Characters before a candidate that must hold a sensitive word, and those on either side that are its context.
    reach: int = 48
    context: int = 256
    min_chars: int = 16
    #: Marginal compressed bytes for each byte of the candidate.
    min_ratio: float = 0.7
    #: Identifiers of the corpus in the dictionary, and documents that must hold one.
    identifiers: int = 1024
    min_documents: int = 3


def _identifiers(text: str, reach: int) -> set[str]:
    """Identifiers of a text, without those that a sensitive word stands before."""
    found = [(m.start(), m.group()) for m in _IDENTIFIER.finditer(text)]
    lowered = text.lower()
    if any(w in lowered for w in _SENSITIVE_WORDS):
        near = [m.end() for m in _SENSITIVE.finditer(text)]
        places = [bisect.bisect_right(near, at) for at, _ in found]
        found = [x for x, k in zip(found, places, strict=True) if not k or x[0] - near[k - 1] > reach]
    return {x for _, x in found}


def dictionary(docs: DataFrame, rules: NoveltyRules) -> str:
    """The identifiers that prime the compressor, the most frequent ones last; ``rules.identifiers`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=4 * CHUNK_BYTES):
            n: Counter = Counter()
            for x in column(batch, "text").to_pylist():
                n.update(_identifiers(x or "", rules.reach))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["x", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "x string, n long").groupBy("x").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.min_documents)
    best = [r["x"] for r in counts.orderBy(F.desc("n"), "x").limit(rules.identifiers).collect()]
    return " ".join([*reversed(best), IDENTIFIERS])


class Novelty:
    def __init__(self, rules: NoveltyRules, identifiers: str = IDENTIFIERS):
        import zstandard

        self.rules = rules
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=rules.level)
        self.size = lambda data, c=zstandard.ZstdCompressor(level=rules.level, dict_data=primed, write_content_size=False, write_checksum=False): len(c.compress(data))

    def ratio(self, text: str, start: int, end: int) -> float:
        run, n = text[start:end], self.rules.context
        # wide enough for copies that cross the edge; blanks keep the length
        blank = lambda x: x.replace(run, " " * len(run))
        before = blank(text[max(0, start - n - len(run)) : start])[-n:]
        after = blank(text[end : end + n + len(run)])[:n]
        context, candidate = f"{after} {before}".encode("utf-8", "replace"), run.encode("utf-8", "replace")
        return (self.size(context + candidate) - self.size(context)) / max(1, len(candidate))

    def spans(self, text: str) -> list[tuple[int, int]]:
        rules, novel = self.rules, set()
        for m in _RUN.finditer(text):
            s, e = m.span()
            if e - s >= rules.min_chars and m.group() not in novel and _SENSITIVE.search(text, max(0, s - rules.reach), s) and self.ratio(text, s, e) >= rules.min_ratio:
                novel.add(m.group())
        return self.occurrences(text, novel)

    def occurrences(self, text: str, strings: set[str]) -> list[tuple[int, int]]:
        """Every place of the strings, also inside longer runs; they are found by their first ``min_chars`` characters."""
        if not strings:
            return []
        k, heads = self.rules.min_chars, {}
        for x in strings:
            heads.setdefault(x[:k], set()).add(len(x))
        out = []
        for m in _RUN.finditer(text):
            for s in range(m.start(), m.end() - k + 1):
                out += [(s, s + n) for n in heads.get(text[s : s + k], ()) if text[s : s + n] in strings]
        return sorted(out)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def all_spans(text: str | None, novelty: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and novel runs that no base span holds."""
    text = text or ""
    base = _ordered(base_spans(text))
    lowered = text.lower()
    novel = novelty.spans(text) if any(w in lowered for w in _SENSITIVE_WORDS) else []
    extra = [("novel", s, e) for s, e in novel if not any(b <= s and e <= x for _, b, x in base)]
    return base, _ordered(base + extra) if extra else base


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, rules: NoveltyRules = NoveltyRules()) -> DataFrame:
    """One row for each document: ``doc_id``, and ``base`` and ``spans`` as arrays of (kind, start, end) in code points, end exclusive."""
    span = "array<struct<kind:string,start:long,end:long>>"
    primer = docs.sparkSession.sparkContext.broadcast(dictionary(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(rules, primer.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        row = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in chunks(batches):
            found = [all_spans(x, novelty) for x in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([row(b) for b, _ in found], kind), pa.array([row(a) for _, a in found], kind)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def digests(docs: DataFrame, rules: NoveltyRules = NoveltyRules()) -> DataFrame:
    """``scan`` as counts, a digest of the base spans and all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return scan(docs, rules).select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_novel"),
    )


def redact(docs: DataFrame, rules: NoveltyRules = NoveltyRules(), mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mask``; overlapping spans are replaced once.

    The columns stay as they are; ``n_chars``, where there is one, is the new length.
    """
    names, schema = docs.columns, docs.schema
    primer = docs.sparkSession.sparkContext.broadcast(dictionary(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(rules, primer.value)
        for batch in chunks(batches):
            texts = column(batch, "text").to_pylist()
            changed = False
            for i, x in enumerate(texts):
                spans = all_spans(x, novelty)[1]
                if spans:
                    changed, out, at = True, [], 0
                    for _, s, e in spans:
                        if e > at:
                            out += [x[at:s], mask] if s >= at else []
                            at = max(at, e)
                    texts[i] = "".join([*out, x[at:]])
            if changed:
                cols = [column(batch, c) for c in names]
                cols[names.index("text")] = pa.array(texts, pa.string())
                batch = pa.RecordBatch.from_arrays(cols, names=names)
            yield batch

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
