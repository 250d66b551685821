"""Queries over configurations, versions, generations and streams of all accumulators, with SQL twins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..config import Geometry, config_error, feature_list, features_named, version_code, version_parts
from ..folders import new_folder
from ..functions.tempo import div
from ..operators import coverage, waveform
from ..sources import container
from ..sources import surrogates as S
from ..streaming import progressive
from . import io_queries, waveform_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_MASKS, _RATES, _CHANNELS, _SIZES = (0, 1, 3, 8, 512), (0, 44_100), (0, 1, 2, 3, 8, 9), (0, 32, 64, 100, 1024, 65_536, 131_072)


@query(
    f"""SELECT mask, rate, channels, layout, size, CASE WHEN mask >= 512 THEN 'features' WHEN rate = 0 THEN 'sample_rate' WHEN channels NOT BETWEEN 1 AND 8 THEN 'channels' WHEN layout = 1 AND channels <> 1 OR layout = 2 AND channels <> 2 THEN 'layout'
    WHEN size NOT IN (0, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536) THEN 'frames_per_column' WHEN mask % 2 = 1 AND channels > 2 THEN 'overview_channels' END AS error
    FROM (SELECT unnest({list(_MASKS)})::BIGINT AS mask), (SELECT unnest({list(_RATES)})::BIGINT AS rate), (SELECT unnest({list(_CHANNELS)})::BIGINT AS channels), (SELECT unnest([0, 1, 2])::BIGINT AS layout), (SELECT unnest({list(_SIZES)})::BIGINT AS size)"""
)
def config_checks(spark, sf_dir):
    rows = [(*c, config_error(*c)) for c in product(_MASKS, _RATES, _CHANNELS, (0, 1, 2), _SIZES)]
    return spark.createDataFrame(rows, "mask bigint, rate bigint, channels bigint, layout bigint, size bigint, error string")


@query("SELECT major, minor, patch, major * 4194304 + minor * 4096 + patch AS code FROM (SELECT unnest([0, 1, 1023])::BIGINT AS major), (SELECT unnest([0, 7, 1023])::BIGINT AS minor), (SELECT unnest([0, 1, 4095])::BIGINT AS patch)")
def version_codes(spark, sf_dir):
    rows = [(*version_parts(version_code(*v)), version_code(*v)) for v in product((0, 1, 1023), (0, 7, 1023), (0, 1, 4095))]
    return spark.createDataFrame(rows, "major bigint, minor bigint, patch bigint, code bigint")


@query(
    """SELECT mask, coalesce((SELECT string_agg(n, ',' ORDER BY b) FROM (VALUES (0, 'overview'), (1, 'detail'), (2, 'bands'), (3, 'bpm'), (4, 'local_grid'), (5, 'global_grid'), (6, 'dynamic_tempo'), (7, 'confidence'), (8, 'locking')) v(b, n) WHERE (mask >> b) & 1 = 1), '') AS names FROM (SELECT unnest(range(512)) AS mask)"""
)
def feature_names(spark, sf_dir):
    """Lists of features and back."""
    names = [(m, ",".join(feature_list(m))) for m in range(512)]
    return spark.createDataFrame([(int(features_named(n)), n) for m, n in names], "mask bigint, names string")


@query("SELECT l_orderkey, l_linenumber, l_partkey, planar, CASE WHEN f < 0 THEN 'negative' WHEN planar AND (l_partkey % 5 = 0 OR n <> 2 OR gap) THEN 'planar' WHEN NOT planar AND (l_partkey % 5 <> 0 OR n > 0) THEN 'interleaved' END AS error FROM (SELECT *, l_partkey * 10 - 50 AS f, l_orderkey % 2 = 0 AS planar, l_suppkey % 4 AS n, l_linenumber = 3 AND l_suppkey % 4 > 0 AS gap FROM lineitem)")
def plane_validation(spark, sf_dir):
    """Blocks of planar and of interleaved sources."""
    n = (F.col("l_suppkey") % 4).cast("int")
    filled = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.lit("p"))).otherwise(F.array().cast("array<string>"))
    planes = F.when((F.col("l_linenumber") == 3) & (n > 0), F.concat(F.array(F.lit(None).cast("string")), filled)).otherwise(filled)
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    b = S.table(spark, sf_dir, "lineitem").select(*keys, (F.col("l_orderkey") % 2 == 0).alias("planar"), (F.col("l_partkey") * 10 - 50).alias("first_frame"), F.lit(10).cast("long").alias("frame_count"), F.when(F.col("l_partkey") % 5 == 0, "d").alias("data"), planes.alias("planes"))
    out = coverage.validated(b.filter("planar"), None, 2).union(coverage.validated(b.filter("not planar")))
    return out.select(*keys, "planar", "error")


@query(
    "SELECT track_id, tile_index, serial, protected, row_number() OVER (PARTITION BY track_id ORDER BY protected DESC, serial DESC, tile_index) AS recency FROM (SELECT c_custkey % 50 AS track_id, c_nationkey::BIGINT AS tile_index, max(c_custkey) AS serial, bool_or(c_custkey % 9 = 0) AS protected FROM customer GROUP BY 1, 2) QUALIFY recency <= 4"
)
def protected_tiles(spark, sf_dir):
    use = S.table(spark, sf_dir, "customer").selectExpr("c_custkey % 50 as track_id", "cast(c_nationkey as bigint) as tile_index", "c_custkey as serial", "c_custkey % 9 = 0 as protected")
    return waveform.recent_tiles(use, 4)


@query("SELECT o_orderkey AS track_id, e < r OR (ended AND s <> 4) OR e - r >= 32 AS due FROM (SELECT o_orderkey, o_custkey % 100 AS e, o_orderkey % 90 AS r, o_orderkey % 7 = 0 AS ended, o_orderkey % 6 AS s FROM orders)")
def refresh_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    t = S.table(spark, sf_dir, "orders").select(k.alias("track_id"), (F.col("o_custkey") % 100).alias("evidence_end"), (k % 90).alias("refreshed_end"), (k % 7 == 0).alias("ended"), (k % 6).alias("state"))
    return progressive.refresh_due(t).select("track_id", "due")


@query(
    """WITH c AS (SELECT DISTINCT l_suppkey AS track_id, l_orderkey // 4000 AS generation, (1 << l_linenumber::INT % 6)::INT AS feature, min(l_quantity::BIGINT // 40) OVER (PARTITION BY l_suppkey, l_orderkey // 4000, l_linenumber::INT % 6) AS content FROM lineitem),
    g AS (SELECT DISTINCT track_id, generation FROM c), p AS (SELECT *, lag(generation) OVER (PARTITION BY track_id ORDER BY generation) AS before FROM g)
    SELECT c.track_id, c.generation, bit_or(c.feature) AS available, bit_or(CASE WHEN q.content IS NOT DISTINCT FROM c.content AND q.track_id IS NOT NULL THEN 0 ELSE c.feature END) AS changed
    FROM c JOIN p USING (track_id, generation) LEFT JOIN c q ON q.track_id = c.track_id AND q.generation = p.before AND q.feature = c.feature GROUP BY 1, 2"""
)
def generation_features(spark, sf_dir):
    """Features that generations have, and those that differ from the generation before."""
    row = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track_id"), div(F.col("l_orderkey"), 4000).alias("generation"), F.expr("shiftleft(1, cast(l_linenumber % 6 as int))").alias("feature"), div(F.col("l_quantity").cast("bigint"), 40).alias("content"))
    return progressive.generation_features(row.groupBy("track_id", "generation", "feature").agg(F.min("content").alias("content")))


_STREAM = Geometry(sample_rate=3000, frames_per_column=64, detail_frames=16, onset_frames=16, global_frames=128)


@query(
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, frame // {n} AS place, sum(floor(least(abs(x), 1.0::DOUBLE) * 32768.0::DOUBLE)::BIGINT)::BIGINT AS total, count(*) AS samples FROM ({S.with_sql('sig_e')} SELECT * FROM sig_e) GROUP BY 2"
        for kind, n in (("onset", 16), ("global", 128))
    )
    + f" UNION ALL SELECT 'detail', column_index, rms, sample_count FROM ({waveform_queries.ORACLE_SQL['detail_columns']})"
)
def stream_accumulators(spark, sf_dir):
    """Onset bins, global bins and detail columns of a stream over the event files: equal to the batch ones."""
    schema = S.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    x = stream.select(F.lit("e").alias("track_id"), F.col("event_id").alias("frame"), S.clamp(F.col("value") / 100.0 - 1.0).alias("x"))
    root = new_folder(spark, "stream-all")
    progressive.accumulate_all(x, f"{root}/parts", _STREAM, f"{root}/checkpoint").awaitTermination()
    bins = [progressive.bins_snapshot(spark, f"{root}/parts", k, n).select(F.lit(k).alias("kind"), F.col("bin").alias("place"), F.col("sum_absolute").alias("total"), F.col("sample_count").alias("samples")) for k, n in (("onset", 16), ("global", 128))]
    fine = progressive.snapshot(spark, f"{root}/parts/detail", 16, waveform.totals(S.event_samples(spark, sf_dir)))
    return bins[0].union(bins[1]).union(fine.select(F.lit("detail"), "column_index", F.col("rms").cast("long"), "sample_count"))


@query(
    f"""{io_queries._SPANS}, n AS (SELECT track_id, count(*) AS columns FROM cols GROUP BY 1) SELECT track_id, 3000::BIGINT AS sample_rate, total AS total_frames, (total + 63) // 64 AS column_count, least(columns * 100 // ((total + 63) // 64), 100)::BIGINT AS confidence, 'cadenza' AS producer FROM n JOIN t USING (track_id)"""
)
def container_fields(spark, sf_dir):
    """Fields of chosen sections of containers, out of their JSON."""
    files = io_queries._containers(spark, sf_dir)[1]
    d = container.described(files, "track_id", ("SOURC", "WOVR", "META"))
    pick = lambda section, name: F.max(F.when(F.col("section") == section, F.get_json_object("json", f"$.{name}")))
    out = d.groupBy("track_id").agg(
        pick("SOURC", "sample_rate").cast("long").alias("sample_rate"), pick("SOURC", "total_frames").cast("long").alias("total_frames"), pick("WOVR", "column_count").cast("long").alias("column_count"),
        pick("WOVR", "confidence").cast("long").alias("confidence"), pick("META", "producer_name").alias("producer"),
    )
    return out


