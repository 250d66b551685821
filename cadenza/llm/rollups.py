"""Token counts as delta-maintained rollups.

A rollup lives in a folder: ``ledger/<batch>`` holds the documents a batch changed with their new counts,
``deltas/<batch>`` the batch's signed effect on the totals by (source, lang, tokenizer), and
``commits/<batch>`` says that the batch is complete.  A batch inserts, revises or deletes documents; what a
document counted before comes from the ledger and is taken back, so totals are sums of deltas and never
recounted.  A batch's folders are written under its own name and the commit comes last: a batch that broke
off is simply run again, and one that was committed is not applied twice.

Defined results for odd input: null texts count no tokens; null source or language is a group of its own;
a null id can't be revised or deleted, so such rows are only ever inserted; of several rows of a batch with
one id and tokenizer the one with the largest (op, source, lang, n_tokens) counts; deleting what isn't
there changes nothing; an inserted document that is there already is revised; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder
from .common import chunks, column, stored
from .vectext import Texts

KEYS = ("source", "lang", "tokenizer")
_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@dataclass(frozen=True)
class Tokenizers:
    """Tokenizer versions to count with: byte-level BPE rank files by version, and white-space words."""

    ranks: dict[str, str] = field(default_factory=lambda: {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken"})
    #: The rank files' splitting pattern.
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    words: str | None = "words"


def count_tokens(docs: DataFrame, tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): a row for each document and tokenizer version."""
    names = [*tokenizers.ranks, *([tokenizers.words] if tokenizers.words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoders = []
        for name, path in tokenizers.ranks.items():
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            encoders.append(tiktoken.Encoding(name, pat_str=tokenizers.pattern, mergeable_ranks=ranks, special_tokens={}))
        for batch in chunks(batches):
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            counts = [np.array([len(e.encode_ordinary(x)) for x in texts], np.int64) for e in encoders]
            if tokenizers.words:
                t = Texts(column(batch, "text"))
                counts.append(np.bincount(t.words()[2], minlength=t.n).astype(np.int64))
            for name, n in zip(names, counts, strict=True):
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "source", "lang")), pa.array([name] * batch.num_rows, pa.string()), pa.array(n)], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    cols = [F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang", "text"))]
    return docs.select(*cols).mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


class Rollup:
    """Totals kept in the folder ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, *parts: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        """What committed batches wrote, by one reader however many they are."""
        done = self._batches()
        if not done:
            return self.spark.createDataFrame([], schema + ", batch string")
        return self.spark.read.schema(schema + ", batch string").parquet(f"{self.root}/{kind}").filter(F.col("batch").isin(done))

    def ledger(self) -> DataFrame:
        """The counts of the documents that are there."""
        state = F.struct("batch", "source", "lang", "n_tokens", "alive")
        latest = self._read("ledger", _LEDGER).filter("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(state).alias("s"))
        return latest.filter("s.alive").select("doc_id", "tokenizer", "s.source", "s.lang", "s.n_tokens")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, op, source, lang, tokenizer, n_tokens; op is insert, revise or delete).  False where ``batch`` was committed before.

        Batch names give the order of batches; one that comes before the last committed one is refused.
        """
        done = self._batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]} was committed")
        cols = ("op", "source", "lang", "n_tokens")
        rows = changes.select(F.col("doc_id").cast("long"), "tokenizer", F.col("op"), "source", "lang", F.col("n_tokens").cast("long")).filter("doc_id is not null or op <> 'delete'")
        # rows without an id are groups of their own, so one pass over the changes does for all
        lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("lone")
        new = rows.groupBy("doc_id", "tokenizer", lone).agg(F.max(F.struct(*cols)).alias("s")).select("doc_id", "tokenizer", "s.source", "s.lang", "s.n_tokens", (F.col("s.op") != "delete").alias("alive"))
        new.write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        new = self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger/batch={batch}")
        plus = new.filter("alive").select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        if done:
            old = self.ledger().join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            plus = plus.union(old.select(*KEYS, F.lit(-1).cast("long"), -F.col("n_tokens")))
        deltas = plus.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all groups that hold a document."""
        sums = self._read("deltas", _DELTA).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")


def token_totals(docs: DataFrame, tokenizers: Tokenizers = Tokenizers(), root: str | None = None) -> DataFrame:
    """Totals of ``docs`` through a rollup of its own in the shared folder, as a history of signed batches leaves them.

    The first batch inserts every document, every third in an earlier revision under another source and with another
    count, and for every fifth one more that is deleted later; the second brings the revisions and deletes; then the second
    is played again, as after a crash.  Texts are tokenised once.  What is left are the totals of ``docs``.
    """
    rollup = Rollup(docs.sparkSession, root or new_folder(docs.sparkSession, "token-rollup"))
    counted = stored(count_tokens(docs, tokenizers), "token-counts")
    turn = lambda n: F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) == 0)
    op = lambda name: F.lit(name).alias("op")
    # ids of their own: no document has the bitwise complement of a document's id as long as ids aren't negative
    extra = counted.filter(turn(5) & (F.col("doc_id") >= 0)).withColumn("doc_id", F.bitwise_not("doc_id"))
    earlier = counted.withColumns({"source": F.when(turn(3), "earlier").otherwise(F.col("source")), "n_tokens": F.col("n_tokens") + F.when(turn(3), 11).otherwise(0)})
    rollup.commit("000001", earlier.select("*", op("insert")).union(extra.select("*", op("insert"))))
    second = counted.filter(turn(3)).select("*", op("revise")).union(extra.select("*", op("delete")))
    rollup.commit("000002", second)
    if rollup.commit("000002", second):
        raise RuntimeError("a committed batch was applied twice")
    return rollup.totals()
