"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.config import Feature
from cadenza.operators import onset, waveform
from cadenza.plans.analysis import Analysis

HEADLINE = (
    "overview_columns", "overview_multi_track", "overview_spans", "detail_columns", "accepted_ranges", "pcm_demand", "request_ranking", "onset_flux",
    "lag_correlation", "tempo_selected", "segments_running_mean", "beat_expansion", "locked_conflict", "threshold_sweep", "container_roundtrip",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> float:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took = {}
    for name in HEADLINE:
        run(catalog.QUERIES[name](spark, sf_dir))  # compiled once before it counts
        took[name] = run(catalog.QUERIES[name](spark, sf_dir))
    # a stream large enough that start-up doesn't count: frames a second of one track's overview and onset bins
    n = int(os.environ.get("BENCH_FRAMES", "50000000"))
    x = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("frame"), F.sin(F.col("id") / 50.0).alias("x"))
    rates = {name: round(n / run(df)) for name, df in (("overview", waveform.columns(x, 1024, n)), ("onset_bins", onset.bins(x, 256)))}
    # every feature of many tracks of a million frames: columns, detail tiles, tempo, local and global grid, beats
    m = n // 2
    many = spark.range(m).select((F.col("id") / (1 << 20)).cast("long").alias("track_id"), (F.col("id") % (1 << 20)).alias("frame"), (F.sin(F.col("id") / 50.0) * F.when(F.col("id") % 24_000 < 256, 0.9).otherwise(0.05)).alias("x"))
    a = Analysis(many, sum(Feature) & ~Feature.BANDS, keep=True)
    rates["all_features"] = round(m / sum(run(df) for df in (a.columns, a.spans(), a.confidence(), a.tiles(), a.tempo, a.local_grid(), a.segments, a.beats())))
    a.fine.unpersist()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "frames_per_second": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
