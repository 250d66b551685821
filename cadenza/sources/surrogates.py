"""Sample streams made from the general test tables, with the same streams as SQL.

Each is (track_id, frame, x); ``SQL`` holds the common table expressions of the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signal import clamp
from ..functions.tempo import div

#: Vectors of 64 elements in a track of the dense stream.
TRACK_VECTORS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense track with clipped samples."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("e").alias("track_id"), F.col("event_id").alias("frame"), clamp(F.col("value") / 100.0 - 1.0).alias("x"))


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user, frames in order of time."""
    e = table(spark, sf_dir, "events")
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("track_id"), frame.cast("bigint").alias("frame"), clamp(F.col("value") / 100.0 - 1.0).alias("x"))


def sparse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each event type, a frame for each second with an event; most frames are missing."""
    e = table(spark, sf_dir, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("track_id"), second.alias("frame"), clamp(F.col("value") / 100.0 - 1.0).alias("x")).groupBy("track_id", "frame").agg(F.min("x").alias("x"))


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense tracks of 500 vectors, element by element."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    frame = (F.col("vec_id") % TRACK_VECTORS) * 64 + F.col("pos")
    return e.select(div(F.col("vec_id"), TRACK_VECTORS).alias("track_id"), frame.alias("frame"), clamp(F.col("v").cast("double")).alias("x"))


def request_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region requests: ranges of 4096 frames on 97 tracks."""
    o = table(spark, sf_dir, "orders")
    first = F.col("o_custkey") * 64
    priority = F.element_at(F.array(*[F.lit(p) for p in (32, 96, 192, 240)]), (F.length("o_orderpriority") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 97).alias("track_id"), first.alias("first_frame"), (first + 4096).alias("end_frame"),
        priority.alias("priority"), (F.col("o_orderkey") % 40).alias("skips"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1000 + 1).otherwise(0).alias("deadline"),
    )


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a true and a reported tempo and a confidence."""
    p = table(spark, sf_dir, "part")
    truth = F.lit(60_000) + (F.floor(F.col("p_retailprice") * 10) % 120_000).cast("bigint")
    num = F.element_at(F.array(*[F.lit(n) for n in (1, 1, 1, 1, 2, 1, 3, 2, 3, 0)]), (F.col("p_size") % 10 + 1).cast("int"))
    den = F.element_at(F.array(*[F.lit(n) for n in (1, 1, 1, 2, 1, 3, 1, 3, 2, 1)]), (F.col("p_size") % 10 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("track"), F.col("p_brand").alias("stratum"), truth.alias("truth"), num.alias("num"), den.alias("den"), F.col("p_size").cast("bigint").alias("size"))
    reported = F.col("size") % 7 * 100 + div(F.col("truth") * F.col("num"), F.col("den"))
    return rows.select("track", "stratum", "truth", F.when(F.col("num") == 0, 0).otherwise(reported).alias("reported"), (F.lit(40) + F.col("track") % 61).alias("confidence"))


SQL = {
    "sig_e": "sig_e AS (SELECT 'e' AS track_id, event_id AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 100.0::DOUBLE - 1.0::DOUBLE)) AS x FROM events)",
    "sig_u": "sig_u AS (SELECT user_id::VARCHAR AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 100.0::DOUBLE - 1.0::DOUBLE)) AS x FROM events)",
    "sig_g": "sig_g AS (SELECT event_type AS track_id, floor(epoch(ts))::BIGINT AS frame, min(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 100.0::DOUBLE - 1.0::DOUBLE))) AS x FROM events GROUP BY ALL)",
    "sig_v": "sig_v AS (SELECT vec_id // 500 AS track_id, (vec_id % 500) * 64 + pos AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))",
    "req": "req AS (SELECT o_orderkey AS request_id, o_custkey % 97 AS track_id, o_custkey * 64 AS first_frame, o_custkey * 64 + 4096 AS end_frame, [32, 96, 192, 240][length(o_orderpriority) % 4 + 1] AS priority, o_orderkey % 40 AS skips, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 + 1 ELSE 0 END AS deadline FROM orders)",
    "corpus": """raw AS (SELECT p_partkey AS track, p_brand AS stratum, 60000 + floor(p_retailprice * 10)::BIGINT % 120000 AS truth, [1, 1, 1, 1, 2, 1, 3, 2, 3, 0][p_size % 10 + 1] AS num, [1, 1, 1, 2, 1, 3, 1, 3, 2, 1][p_size % 10 + 1] AS den, p_size::BIGINT AS size FROM part),
      corpus AS (SELECT track, stratum, truth, CASE WHEN num = 0 THEN 0 ELSE size % 7 * 100 + truth * num // den END AS reported, 40 + track % 61 AS confidence FROM raw)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
