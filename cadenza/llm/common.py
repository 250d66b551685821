"""Shared plumbing: table access, checkpoints in the shared folder, Arrow batches cut to bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder, shared_folder

#: Bytes of text that a Python step takes into its arrays at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Bytes of a batch that Spark hands to Python, where a session leaves that to Spark.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold what Spark hands to Python at once to ``BATCH_BYTES``, unless the session's configuration says otherwise."""
    if spark.sparkContext.getConf().get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df``, a checkpoint with ``rows`` rows at most, in no more partitions than these need: what is small afterwards leaves few shuffle files."""
    parts = max(1, -(-rows // each))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own in the shared one and read it again."""
    at = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def held_out(doc_id, modulus: int):
    """True where crc32 of the id's decimal text leaves remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 2, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with about ``limit`` bytes of ``text`` each, one row at least."""
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(lengths, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start, base = end, int(lengths[end - 1])
        pa.default_memory_pool().release_unused()


def free_name(stem: str, columns: list[str]) -> str:
    """``stem``, with underscores after it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
