"""Progressive analysis with Structured Streaming.

Columns and bins are made of parts that commute, so each micro-batch appends its partial accumulators under
its batch id, a batch that is run again replaces its own part, and a read merges them.  Which blocks count is
decided by keyed state: the union of accepted ranges of a track, against which late and repeated blocks are
checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import FINAL, Geometry
from ..functions.ranges import Accepted
from ..operators import onset, waveform


def accumulate(samples: DataFrame, root: str, frames: int, checkpoint: str, available_now: bool = True):
    """Start the query that writes each batch's partial accumulators to ``root/batch=<id>``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        waveform.accumulators(df, frames).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    q = samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def accumulate_all(samples: DataFrame, root: str, g: Geometry, checkpoint: str, available_now: bool = True):
    """Start the query that writes each batch's partial columns, detail columns, onset bins and global bins to ``root/<kind>/batch=<id>``.

    All of them are sums, extremes and counts by place, so parts of batches merge; of bins it is enough to merge the partial sums.
    """
    kinds = {
        "columns": lambda df: waveform.accumulators(df, g.frames_per_column), "detail": lambda df: waveform.accumulators(df, g.detail_frames),
        "onset": lambda df: onset.bins(df, g.onset_frames), "global": lambda df: onset.bins(df, g.global_frames),
    }

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        for kind, parts in kinds.items():
            parts(df).write.mode("overwrite").parquet(f"{root}/{kind}/batch={batch_id}")
        df.unpersist()

    q = samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def bins_snapshot(spark: SparkSession, root: str, kind: str, frames: int) -> DataFrame:
    """The bins of what has been accumulated: as ``onset.bins`` of all samples."""
    parts = spark.read.parquet(f"{root}/{kind}")
    out = parts.groupBy("track_id", "bin").agg(F.sum("sum_absolute").alias("sum_absolute"), F.sum("sample_count").alias("sample_count"))
    return out.withColumn("complete", F.col("sample_count") == frames)


def refresh_due(tracks: DataFrame, min_bins: int = 32) -> DataFrame:
    """(track_id, evidence_end, refreshed_end or 0, ended, state) with ``due``: whether the estimate of a track is to be made anew.

    It is where evidence has moved back, where the input has ended and the estimate isn't final yet, and where ``min_bins`` bins
    have come since the last one.
    """
    back = F.col("evidence_end") < F.col("refreshed_end")
    last = F.col("ended") & (F.coalesce("state", F.lit(0)) != FINAL)
    return tracks.withColumn("due", back | last | (F.col("evidence_end") >= F.col("refreshed_end") + min_bins))


def generation_features(contents: DataFrame) -> DataFrame:
    """(track_id, generation, feature, content) to (track_id, generation, available, changed): masks of the features that a generation has, and of those whose content isn't that of the generation before."""
    order = W.partitionBy("track_id", "feature").orderBy("generation")
    new = ~F.col("content").eqNullSafe(F.lag("content").over(order)) | ~F.coalesce(F.lag("place").over(order) == F.col("place") - 1, F.lit(False))
    placed = contents.withColumn("place", F.dense_rank().over(W.partitionBy("track_id").orderBy("generation")))
    return placed.withColumn("__new", new).groupBy("track_id", "generation").agg(F.bit_or("feature").alias("available"), F.bit_or(F.when(F.col("__new"), F.col("feature")).otherwise(0)).alias("changed"))


def snapshot(spark: SparkSession, root: str, frames: int, total: DataFrame | int | None = None) -> DataFrame:
    """The complete columns of what has been accumulated; the last may be short once the track's end is known."""
    parts = spark.read.parquet(root).drop("batch")
    return waveform.finalized(waveform.complete(waveform.merged(parts), frames, total))


def accepted_blocks(blocks: DataFrame, key: str = "string") -> DataFrame:
    """A stream (track_id, first_frame, frame_count, serial) to (track_id, serial, accepted, status, contiguous_end), in order of ``serial`` inside a batch."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Accepted(*state.get) if state.exists else Accepted()
        out = []
        for r in pd.concat(list(pdfs)).sort_values("serial").itertuples():
            n, status = held.push(int(r.first_frame), int(r.frame_count))
            out.append((k[0], int(r.serial), n, status, held.contiguous_end))
        state.update((held.firsts, held.ends))
        yield pd.DataFrame(out, columns=["track_id", "serial", "accepted", "status", "contiguous_end"])

    return blocks.groupBy("track_id").applyInPandasWithState(
        run, f"track_id {key}, serial long, accepted long, status string, contiguous_end long", "firsts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout
    )


def publish(spark: SparkSession, result: DataFrame, root: str, keys: list[str]) -> int | None:
    """Append ``result`` as the next generation of ``root``; None, and nothing written, where it equals the newest one.

    A generation counts once its writer has left the marker of a whole write; what a broken-off write left behind is
    written over by the next one.
    """
    have = generations(spark, root)
    content = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).alias("h")).first()
    if have:
        newest = spark.read.parquet(f"{root}/generation={have[-1]}")
        if sorted(newest.columns) == sorted(result.columns) and content(result) == content(newest):
            return None
    number = have[-1] + 1 if have else 1
    result.write.mode("overwrite").parquet(f"{root}/generation={number}")
    return number


def generations(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the generations that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
