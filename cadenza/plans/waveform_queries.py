"""Queries over columns, coverage and requests, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Feature, closure
from ..functions import signal
from ..functions.ranges import focus, frame_at, intersection, seconds
from ..functions.tempo import div, prior, tempo_from_lag
from ..operators import coverage, onset, scheduler, seeding, waveform
from ..sources import surrogates as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PEAK = "CASE WHEN {0} <= -1 THEN -32768 WHEN {0} >= 1 THEN 32767 ELSE round_even({0} * 32767.0::DOUBLE, 0)::INT END"
_ACC = "min(x) AS lo, max(x) AS hi, sum((floor(least(abs(x), 1.0::DOUBLE) * 8388608.0::DOUBLE)::BIGINT)::HUGEINT * floor(least(abs(x), 1.0::DOUBLE) * 8388608.0::DOUBLE)::BIGINT) AS ss, count(*) AS n, bool_or(abs(x) >= 1) AS clipped"
_FINAL = (
    f"{_PEAK.format('lo')} AS minimum, {_PEAK.format('hi')} AS maximum, "
    "round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sqrt(ss::DOUBLE / n) / 8388608.0::DOUBLE)) * 65535.0::DOUBLE, 0)::INT AS rms, "
    "(1 + CASE WHEN clipped THEN 4 ELSE 0 END)::INT AS flags, n AS sample_count"
)


def _columns_sql(sig: str, frames: int) -> str:
    return f"""{S.with_sql(sig)}, t AS (SELECT track_id, max(frame) + 1 AS total FROM {sig} GROUP BY 1),
      acc AS (SELECT track_id, frame // {frames} AS column_index, {_ACC} FROM {sig} GROUP BY 1, 2),
      cols AS (SELECT acc.* FROM acc JOIN t USING (track_id) WHERE n = least({frames}, total - column_index * {frames}))"""


@query(_columns_sql("sig_e", 64) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def overview_columns(spark, sf_dir):
    x = S.event_samples(spark, sf_dir)
    return waveform.columns(x, 64, waveform.totals(x))


@query(_columns_sql("sig_u", 16) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def overview_multi_track(spark, sf_dir):
    x = S.user_samples(spark, sf_dir)
    return waveform.columns(x, 16, waveform.totals(x))


@query(_columns_sql("sig_v", 1024) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def overview_resolution_64_1024(spark, sf_dir):
    """Columns of 1024 frames as a roll-up of columns of 64."""
    x = S.vector_samples(spark, sf_dir)
    return waveform.finalized(waveform.complete(waveform.merged(waveform.accumulators(x, 64), 16), 1024, waveform.totals(x)))


_RUNS = "(SELECT *, pos - row_number() OVER (PARTITION BY {k} ORDER BY pos) AS run FROM {t})"


@query(
    f"""{S.with_sql("sig_g")}, cols AS (SELECT DISTINCT track_id, frame // 3600 AS pos FROM sig_g),
    runs AS (SELECT track_id, min(pos) AS f, max(pos) AS l, count(*) AS n FROM {_RUNS.format(k="track_id", t="cols")} GROUP BY track_id, run)
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS span_index, f * 3600 AS first_frame, (l + 1) * 3600 AS end_frame, f AS first_column, n AS column_count FROM runs"""
)
def overview_spans(spark, sf_dir):
    cols = waveform.accumulators(S.sparse_samples(spark, sf_dir), 3600)
    return waveform.spans(cols, 3600)


@query(
    _columns_sql("sig_u", 16)
    + """, g AS (SELECT track_id, count(*) AS c FROM cols WHERE column_index % 3 <> 1 GROUP BY 1)
    SELECT track_id, coalesce(c, 0) AS complete, (total + 15) // 16 AS expected, (coalesce(c, 0) * 100 // ((total + 15) // 16))::INT AS confidence FROM t LEFT JOIN g USING (track_id)"""
)
def overview_confidence(spark, sf_dir):
    """Confidence of tracks that have two of three columns."""
    x = S.user_samples(spark, sf_dir)
    total = waveform.totals(x)
    return waveform.confidence(waveform.columns(x, 16, total).filter("column_index % 3 <> 1"), 16, total)


@query(_columns_sql("sig_e", 16) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def detail_columns(spark, sf_dir):
    x = S.event_samples(spark, sf_dir)
    return waveform.columns(x, 16, waveform.totals(x))


@query(_columns_sql("sig_e", 16) + " SELECT track_id, column_index // 64 AS tile_index, min(column_index) AS first_column, count(*) AS column_count FROM cols GROUP BY 1, 2")
def detail_tiles(spark, sf_dir):
    x = S.event_samples(spark, sf_dir)
    return waveform.tiles(waveform.columns(x, 16, waveform.totals(x)), 64)


@query(
    f"""{S.with_sql("sig_g")}, cols AS (SELECT DISTINCT track_id, frame // 3600 // 64 AS tile_index, frame // 3600 AS pos FROM sig_g),
    runs AS (SELECT track_id, tile_index, min(pos) AS f, count(*) AS n FROM {_RUNS.format(k="track_id, tile_index", t="cols")} GROUP BY track_id, tile_index, run)
    SELECT track_id, tile_index, f AS first_column, n AS column_count FROM runs QUALIFY row_number() OVER (PARTITION BY track_id, tile_index ORDER BY n DESC, f) = 1"""
)
def detail_longest_run(spark, sf_dir):
    return waveform.longest_runs(waveform.accumulators(S.sparse_samples(spark, sf_dir), 3600), 64)


@query("SELECT c_custkey % 50 AS track_id, c_nationkey::BIGINT AS tile_index, max(c_custkey) AS serial, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY max(c_custkey) DESC, c_nationkey) AS recency FROM customer GROUP BY 1, c_nationkey QUALIFY recency <= 4")
def detail_recent_tiles(spark, sf_dir):
    use = S.table(spark, sf_dir, "customer").selectExpr("c_custkey % 50 as track_id", "cast(c_nationkey as bigint) as tile_index", "c_custkey as serial")
    return waveform.recent_tiles(use, 4)


@query("SELECT event_id, raw, floor((CASE WHEN raw < 0 THEN raw / 32768.0::DOUBLE ELSE raw / 32767.0::DOUBLE END) * 1000000000 + 0.5)::BIGINT AS x_e9 FROM (SELECT event_id, floor(value * 100)::BIGINT % 65536 - 32768 AS raw FROM events)")
def pcm_s16_decode(spark, sf_dir):
    raw = F.floor(F.col("value") * 100).cast("bigint") % 65536 - 32768
    e = S.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.withColumn("x_e9", F.floor(signal.decode_int(F.col("raw"), 16) * 1e9 + 0.5).cast("bigint"))


@query(
    """SELECT event_id, floor((CASE WHEN r < 0 THEN r / 8388608.0::DOUBLE ELSE r / 8388607.0::DOUBLE END) * 1000000000 + 0.5)::BIGINT AS s24_e9,
    floor((CASE WHEN q < 0 THEN q / 2147483648.0::DOUBLE ELSE q / 2147483647.0::DOUBLE END) * 1000000000 + 0.5)::BIGINT AS s32_e9
    FROM (SELECT event_id, floor(value * 100000)::BIGINT % 16777216 - 8388608 AS r, floor(value * 10000000)::BIGINT % 4294967296 - 2147483648 AS q FROM events)"""
)
def pcm_s24_s32_decode(spark, sf_dir):
    r = F.floor(F.col("value") * 100_000).cast("bigint") % (1 << 24) - (1 << 23)
    q = F.floor(F.col("value") * 10_000_000).cast("bigint") % (1 << 32) - (1 << 31)
    e9 = lambda x: F.floor(x * 1e9 + 0.5).cast("bigint")
    return S.table(spark, sf_dir, "events").select("event_id", e9(signal.decode_int(r, 24)).alias("s24_e9"), e9(signal.decode_int(q, 32)).alias("s32_e9"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 50.0::DOUBLE - 2.0::DOUBLE)) END AS x FROM events")
def f32_clamp(spark, sf_dir):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50.0 - 2.0)
    return S.table(spark, sf_dir, "events").select("event_id", signal.clamp(x).alias("x"))


@query(
    S.with_sql("sig_v") + """ SELECT a.track_id, a.frame // 2 AS frame, floor((a.x + b.x) * 0.5::DOUBLE * 1000000000 + 0.5)::BIGINT AS x_e9
    FROM sig_v a JOIN sig_v b ON a.track_id = b.track_id AND b.frame = a.frame + 1 WHERE a.frame % 2 = 0"""
)
def mono_reduce(spark, sf_dir):
    """Two interleaved channels to one: the mean of each frame's pair."""
    x = S.vector_samples(spark, sf_dir)
    both = x.select("track_id", div(F.col("frame"), 2).alias("frame"), (F.col("frame") % 2).alias("channel"), "x")
    return waveform.mono(both).select("track_id", "frame", F.floor(F.col("x") * 1e9 + 0.5).cast("bigint").alias("x_e9"))


_ACCEPTED = """b AS (SELECT *, max(end_frame) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM req),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_frame > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame) AS island FROM b),
    accepted AS (SELECT track_id, min(first_frame) AS first_frame, max(end_frame) AS end_frame FROM i GROUP BY track_id, island)"""


@query(f"{S.with_sql('req')}, {_ACCEPTED} SELECT * FROM accepted")
def accepted_ranges(spark, sf_dir):
    return coverage.accepted_ranges(S.request_ranges(spark, sf_dir))


@query(
    f"""{S.with_sql("req")}, {_ACCEPTED}, t AS (SELECT track_id, max(end_frame) + 10000 AS total FROM req GROUP BY 1),
    e AS (SELECT * FROM accepted UNION ALL SELECT track_id, total, total FROM t)
    SELECT track_id, coalesce(lag(end_frame) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame), 0) AS first_frame, first_frame AS end_frame FROM e QUALIFY coalesce(lag(end_frame) OVER (PARTITION BY track_id ORDER BY e.first_frame, e.end_frame), 0) < e.first_frame"""
)
def missing_ranges(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir)
    total = r.groupBy("track_id").agg((F.max("end_frame") + 10_000).alias("total_frames"))
    return coverage.missing_ranges(coverage.accepted_ranges(r), total)


#: Blocks one after the other against a list of what was accepted before, which holds accepted parts only.
FOLD = """s AS (SELECT DISTINCT track_id, 0::BIGINT AS n, 0::BIGINT AS serial, 0::BIGINT AS took, '' AS status, CAST([] AS STRUCT(f BIGINT, e BIGINT)[]) AS held FROM b
      UNION ALL SELECT track_id, n, serial, took, CASE WHEN bad THEN 'INVALID' WHEN hit THEN 'CONFLICT' WHEN took = size THEN 'OK' ELSE 'MORE_WORK' END, CASE WHEN took > 0 THEN list_append(held, {'f': f, 'e': f + took}) ELSE held END
      FROM (SELECT *, CASE WHEN bad OR hit THEN 0 ELSE least(size, 4096, coalesce(list_min(list_transform(list_filter(held, lambda r: r.f > f), lambda r: r.f)) - f, 4096)) END AS took
        FROM (SELECT b.track_id, b.n, b.serial, b.f, b.size, s.held, b.size <= 0 OR b.f < 0 AS bad, len(list_filter(s.held, lambda r: r.f <= b.f AND b.f < r.e)) > 0 AS hit FROM s JOIN b ON b.track_id = s.track_id AND b.n = s.n + 1)))"""


@query(
    f"""{S.with_sql("req").replace("WITH", "WITH RECURSIVE", 1)}, b AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY request_id) AS n, request_id AS serial, first_frame - request_id % 7 * 64 AS f, 4096 + request_id % 5 * 64 AS size FROM req), {FOLD}
    SELECT track_id, serial, took AS accepted_frames, status FROM s WHERE n > 0"""
)
def overlap_conflicts(spark, sf_dir):
    """Blocks as pushed in the order of their serial: only what was accepted before can reject or shorten one."""
    r, serial = S.request_ranges(spark, sf_dir), F.col("request_id")
    first = F.col("first_frame") - serial % 7 * 64
    blocks = r.select("track_id", serial.alias("serial"), first.alias("first_frame"), (first + 4096 + serial % 5 * 64).alias("end_frame"))
    return coverage.acceptance(blocks, "serial").drop("first_frame", "end_frame")


@query(
    """SELECT o_orderkey AS track_id, CASE WHEN fin IS NULL THEN 'INVALID' WHEN earlier IS NOT NULL AND earlier = fin THEN 'OK' WHEN earlier IS NOT NULL THEN 'CONFLICT' WHEN known <> fin OR acc > fin THEN 'CONFLICT' ELSE 'OK' END AS status
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 10 END AS known, o_orderkey % 2000 AS acc, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 10 + CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 0 END END AS fin, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey * 10 END AS earlier FROM orders)"""
)
def end_of_input(spark, sf_dir):
    k, end = F.col("o_orderkey"), F.col("o_custkey") * 10
    t = S.table(spark, sf_dir, "orders").select(
        k.alias("track_id"), F.when(k % 3 == 0, end).alias("known_total"), (k % 2000).alias("accepted_end"), F.when(k % 11 != 0, end + F.when(k % 5 == 0, 10).otherwise(0)).alias("final_end"), F.when(k % 4 == 0, end).alias("earlier_end")
    )
    return coverage.ended(t).select("track_id", "status")


@query("SELECT l_orderkey, l_linenumber, n AS frame_count, CASE WHEN n <= 0 THEN 'empty' WHEN f < 0 THEN 'negative' WHEN f + n > 20000 THEN 'beyond_end' END AS error FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT - 3 AS n, l_partkey * 10 - 50 AS f FROM lineitem)")
def block_validation(spark, sf_dir):
    b = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") - 3).alias("frame_count"), (F.col("l_partkey") * 10 - 50).alias("first_frame"))
    return coverage.validated(b, 20_000).select("l_orderkey", "l_linenumber", "frame_count", "error")


_FOCUS = "SELECT request_id, greatest(first_frame + 2000 - 2500, 0) AS rf, first_frame + 2000 + 1000 AS re, 4000 + request_id % 3 * 1000 AS ef, 30000 AS ee FROM req"


@query(f"{S.with_sql('req')}, f AS ({_FOCUS}) SELECT request_id, CASE WHEN least(re, ee) <= greatest(rf, ef) THEN ef ELSE greatest(rf, ef) END AS first_frame, CASE WHEN least(re, ee) <= greatest(rf, ef) THEN ee ELSE least(re, ee) END AS end_frame FROM f")
def focus_intersection(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir)
    a, b = focus(F.col("first_frame") + 2000, F.lit(2500), F.lit(1000))
    first, end = intersection(a, b, F.lit(4000) + F.col("request_id") % 3 * 1000, F.lit(30_000))
    return r.select("request_id", first.cast("bigint").alias("first_frame"), end.cast("bigint").alias("end_frame"))


@query(
    f"""{S.with_sql("req")}, {_ACCEPTED}, v AS (SELECT track_id, first_frame, end_frame, 2 + track_id % 3 AS state FROM accepted),
    q AS (SELECT request_id, track_id, first_frame - 2048 AS first_frame, end_frame - 2048 AS end_frame FROM req)
    SELECT request_id, q.track_id, q.first_frame, q.end_frame, coalesce(max(CASE WHEN v.first_frame <= q.first_frame AND q.end_frame <= v.end_frame THEN v.state END), CASE WHEN count(v.state) > 0 THEN 1 END, 0)::INT AS state
    FROM q LEFT JOIN v ON v.track_id = q.track_id AND v.first_frame < q.end_frame AND q.first_frame < v.end_frame GROUP BY 1, 2, 3, 4"""
)
def feature_state_by_range(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir)
    values = coverage.accepted_ranges(r).withColumn("state", F.lit(2) + F.col("track_id") % 3)
    wanted = r.select("request_id", "track_id", (F.col("first_frame") - 2048).alias("first_frame"), (F.col("end_frame") - 2048).alias("end_frame"))
    return coverage.feature_state(wanted, values)


@query(
    f"""{S.with_sql("req")}, tiles AS (SELECT DISTINCT track_id, first_frame // 2048 AS tile_index, (2 + first_frame // 2048 % 3)::INT AS state FROM req WHERE request_id % 2 = 0),
    w AS (SELECT request_id, track_id, first_frame, end_frame, unnest(range(first_frame // 2048, (end_frame - 1) // 2048 + 1)) AS tile_index FROM req)
    SELECT request_id, track_id, first_frame, end_frame, CASE WHEN count(state) = count(*) THEN min(state) WHEN count(state) > 0 THEN 1 ELSE 0 END AS state
    FROM w LEFT JOIN tiles USING (track_id, tile_index) GROUP BY 1, 2, 3, 4"""
)
def detail_state_by_range(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir).select("request_id", "track_id", "first_frame", "end_frame")
    tile = div(F.col("first_frame"), 2048)
    tiles = r.filter("request_id % 2 = 0").select("track_id", tile.alias("tile_index"), (F.lit(2) + tile % 3).cast("int").alias("state")).distinct()
    return coverage.tile_state(r, tiles, 2048)


_EFFECTIVE = "(priority + least(skips * 8, 255 - priority))::INT"


@query(
    f"""{S.with_sql("req")} SELECT *, {_EFFECTIVE} AS effective_priority,
    row_number() OVER (PARTITION BY track_id ORDER BY {_EFFECTIVE} DESC, (deadline <> 0)::INT DESC, CASE WHEN deadline <> 0 THEN deadline END NULLS LAST, request_id) AS rank FROM req"""
)
def request_ranking(spark, sf_dir):
    return scheduler.ranked(S.request_ranges(spark, sf_dir))


@query(f"{S.with_sql('req')} SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 0 ELSE least(skips + 1, 32) END AS skips FROM req")
def request_aging(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir).select("request_id", "skips")
    return scheduler.aged(r, r.filter("request_id % 5 = 0"))


_HAVE = "have AS (SELECT DISTINCT track_id, first_frame // 1024 AS column_index FROM req WHERE request_id % 3 = 0 UNION SELECT DISTINCT track_id, first_frame // 1024 + 1 FROM req WHERE request_id % 3 = 0)"


_FINE = "fine AS (SELECT DISTINCT track_id, first_frame // 256 + k AS column_index FROM req, (SELECT unnest(range(10)) AS k) WHERE request_id % 64 = 0)"
_MASK = "[1, 2, 3, 8][request_id % 4 + 1]"
_STATUS = "CASE WHEN request_id % 17 = 0 THEN 5 WHEN request_id % 19 = 0 THEN 6 WHEN request_id % 23 = 0 THEN 4 ELSE 0 END"


def _asking(spark, sf_dir):
    """Requests with what they ask for and a status, and the overview and detail columns that are there."""
    k = F.col("request_id")
    r = S.request_ranges(spark, sf_dir).withColumn("features", F.element_at(F.array(*[F.lit(m) for m in (1, 2, 3, 8)]), (k % 4 + 1).cast("int")))
    r = r.withColumn("status", F.when(k % 17 == 0, 5).when(k % 19 == 0, 6).when(k % 23 == 0, 4).otherwise(0))
    third = r.filter("request_id % 3 = 0").select("track_id", div(F.col("first_frame"), 1024).alias("column_index"))
    have = third.union(third.select("track_id", F.col("column_index") + 1)).distinct()
    fine = r.filter("request_id % 64 = 0").select("track_id", F.explode(F.sequence(div(F.col("first_frame"), 256), div(F.col("first_frame"), 256) + 9)).alias("column_index")).distinct()
    return r, have, fine


@query(
    f"""{S.with_sql("req")}, {_HAVE}, {_FINE}, r AS (SELECT *, {_MASK} AS features, {_STATUS} AS status FROM req),
    o AS (SELECT request_id, count(h.track_id) AS have, count(*) AS want FROM (SELECT request_id, track_id, unnest(range(first_frame // 1024, (end_frame - 1) // 1024 + 1)) AS column_index FROM r) LEFT JOIN have h USING (track_id, column_index) GROUP BY 1),
    d AS (SELECT request_id, count(f.track_id) AS have, count(*) AS want FROM (SELECT request_id, track_id, unnest(range(first_frame // 256, (end_frame - 1) // 256 + 1)) AS column_index FROM r) LEFT JOIN fine f USING (track_id, column_index) GROUP BY 1),
    x AS (SELECT r.request_id, features, status, features & 1 <> 0 AS ov, features & 2 <> 0 AS de, o.have = o.want AS oc, o.have > 0 AS os, d.have = d.want AS dc, d.have > 0 AS ds FROM r JOIN o USING (request_id) JOIN d USING (request_id)),
    base AS (SELECT *, CASE WHEN status IN (4, 5, 6) OR NOT ov THEN status WHEN oc THEN 4 WHEN os THEN 3 ELSE 1 END AS first FROM x),
    joint AS (SELECT *, CASE WHEN status IN (5, 6) OR NOT de THEN first WHEN (NOT ov OR first = 4) AND dc THEN 4 WHEN (ov AND first IN (3, 4)) OR ds THEN 3 ELSE 1 END AS state FROM base)
    SELECT request_id, features, state::INT AS state, (CASE WHEN state = 4 THEN 1000 WHEN state = 3 THEN 500 ELSE 0 END)::INT AS permille FROM joint WHERE NOT (status = 4 AND de)"""
)
def request_state(spark, sf_dir):
    """All states of requests for overview, detail, both and neither."""
    r, have, fine = _asking(spark, sf_dir)
    r = r.filter("not (status = 4 and features in (2, 3))").select("request_id", "track_id", "first_frame", "end_frame", "features", "status")
    return scheduler.progress(r, have, 1024, fine, 256).select("request_id", "features", "state", "permille")


_HALF = """half AS (SELECT * FROM req WHERE request_id % 2 = 0),
    hb AS (SELECT *, max(end_frame) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM half),
    hi AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_frame > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame) AS island FROM hb),
    a AS (SELECT track_id, min(first_frame) AS af, max(end_frame) AS ae FROM hi GROUP BY track_id, island)"""


@query(
    f"""{S.with_sql("req")}, {_HALF}, r AS (SELECT *, {_MASK} AS features, {_STATUS} AS status FROM req),
    t AS (SELECT DISTINCT track_id, CASE WHEN track_id % 3 <> 0 THEN 200000 + track_id * 100 END AS total, 5000 AS reach FROM req),
    fo AS (SELECT track_id, greatest(track_id * 900 - 3000, 0) AS ff, track_id * 900 + 9000 AS fe, 192 AS fp FROM t WHERE track_id % 2 = 0),
    best AS (SELECT track_id, request_id, first_frame, end_frame, priority FROM r WHERE features & 1 <> 0 AND status IN (0, 1, 3) AND track_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY priority DESC, request_id) = 1),
    goal AS (SELECT t.track_id, total, coalesce(first_frame, ff, CASE WHEN total IS NULL THEN reach ELSE 0 END) AS f, least(coalesce(end_frame, fe, total, reach + 4096), coalesce(total, 1000000000000)) AS e, coalesce(priority, fp, 32) AS priority, coalesce(request_id, 0) AS token FROM t LEFT JOIN best USING (track_id) LEFT JOIN fo USING (track_id)),
    edge AS (SELECT track_id, unnest([f] || coalesce(list(ae) FILTER (ae > f AND ae < e), [])) AS cand, any_value(f) AS f, any_value(e) AS e, any_value(priority) AS priority, any_value(token) AS token FROM goal LEFT JOIN a USING (track_id) WHERE f < e GROUP BY track_id, f, e),
    gap AS (SELECT edge.track_id, min(cand) AS mf, any_value(e) AS e, any_value(priority) AS priority, any_value(token) AS token FROM edge WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.track_id = edge.track_id AND af <= cand AND cand < ae) GROUP BY 1)
    SELECT gap.track_id, token::BIGINT AS token, mf AS first_frame, least(e, mf + 4096, coalesce((SELECT min(af) FROM a WHERE a.track_id = gap.track_id AND af > mf), e))::BIGINT AS end_frame, priority::INT AS priority FROM gap"""
)
def next_pushes(spark, sf_dir):
    """Open requests before the focus before the whole track; the first gap of the target, one push at most."""
    r, _, _ = _asking(spark, sf_dir)
    t = F.col("track_id")
    tracks = r.select("track_id").distinct().withColumns({"total_frames": F.when(t % 3 != 0, t * 100 + 200_000), "contiguous_end": F.lit(5000).cast("long")})
    focus = tracks.filter("track_id % 2 = 0").select("track_id", (t * 900).alias("playhead"), F.lit(3000).alias("behind"), F.lit(9000).alias("ahead"), F.lit(1).alias("features"), F.lit(192).alias("priority"))
    accepted = coverage.accepted_ranges(r.filter("request_id % 2 = 0"))
    return scheduler.next_pushes(tracks, r.filter("track_id % 5 <> 0"), accepted, focus).drop("feature")


@query(
    f"""{S.with_sql("req")}, {_FINE}, r AS (SELECT *, {_MASK} AS features, {_STATUS} AS status FROM req), t AS (SELECT DISTINCT track_id FROM req),
    best AS (SELECT track_id, request_id, first_frame // 256 AS c0, (end_frame + 255) // 256 AS c1, priority FROM r WHERE features & 2 <> 0 AND status IN (0, 1, 3) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY priority DESC, request_id) = 1),
    col AS (SELECT track_id, request_id, priority, unnest(range(c0, c1)) AS c FROM best), gone AS (SELECT col.* FROM col LEFT JOIN fine f ON f.track_id = col.track_id AND f.column_index = col.c WHERE f.track_id IS NULL),
    run AS (SELECT *, c - row_number() OVER (PARTITION BY track_id ORDER BY c) AS g, min(c) OVER (PARTITION BY track_id) AS m FROM gone)
    SELECT track_id, request_id AS token, min(c) * 256 AS first_frame, least((max(c) + 1) * 256, min(c) * 256 + 4096) AS end_frame, priority::INT AS priority FROM run GROUP BY track_id, request_id, priority, g HAVING min(c) = any_value(m)"""
)
def detail_pushes(spark, sf_dir):
    """Detail goes before the overview: the first run of detail columns that a track's best request lacks."""
    r, _, fine = _asking(spark, sf_dir)
    tracks = r.select("track_id").distinct().withColumns({"total_frames": F.lit(None).cast("long"), "contiguous_end": F.lit(0).cast("long")})
    accepted = coverage.accepted_ranges(r.filter("request_id % 2 = 0"))
    return scheduler.next_pushes(tracks, r, accepted, None, fine, 256).filter("feature = 2").drop("feature")


@query(
    f"""{S.with_sql("req")}, bl AS (SELECT request_id AS block_id, track_id, first_frame + 1000 AS first_frame, first_frame + 2024 AS end_frame FROM req WHERE request_id % 5 = 0),
    fo AS (SELECT DISTINCT track_id, greatest(track_id * 500 - 2000, 0) AS ff, track_id * 500 + 20000 AS fe, 100 AS fp FROM req WHERE track_id % 2 = 0),
    m AS (SELECT block_id, b.track_id, r.request_id, (r.priority + least(r.skips * 8, 255 - r.priority))::INT AS eff, r.deadline FROM bl b JOIN req r ON r.track_id = b.track_id AND r.first_frame < b.end_frame AND b.first_frame < r.end_frame WHERE r.request_id % 2 = 1),
    best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY eff DESC, (deadline <> 0)::INT DESC, CASE WHEN deadline <> 0 THEN deadline END NULLS LAST, request_id) = 1),
    j AS (SELECT b.block_id, b.track_id, best.request_id, best.eff, best.deadline, CASE WHEN fo.ff < b.end_frame AND b.first_frame < fo.fe THEN fp END AS fp FROM bl b LEFT JOIN best USING (block_id) LEFT JOIN fo ON fo.track_id = b.track_id),
    k AS (SELECT block_id, track_id, CASE WHEN fp > coalesce(eff, 0) THEN NULL ELSE request_id END AS request_id, greatest(coalesce(eff, 0), coalesce(fp, 0)) AS e, CASE WHEN fp > coalesce(eff, 0) THEN NULL ELSE deadline END AS deadline FROM j)
    SELECT block_id, track_id, request_id, e AS effective_priority, row_number() OVER (PARTITION BY track_id ORDER BY e DESC, (request_id IS NULL)::INT, (coalesce(deadline, 0) <> 0)::INT DESC, CASE WHEN deadline <> 0 THEN deadline END NULLS LAST, request_id, block_id) AS rank FROM k"""
)
def block_scores(spark, sf_dir):
    """Queued blocks by the best request that overlaps each, or the focus."""
    r = S.request_ranges(spark, sf_dir)
    blocks = r.filter("request_id % 5 = 0").select(F.col("request_id").alias("block_id"), "track_id", (F.col("first_frame") + 1000).alias("first_frame"), (F.col("first_frame") + 2024).alias("end_frame"))
    t = F.col("track_id")
    focus = r.filter("track_id % 2 = 0").select("track_id").distinct().select("track_id", (t * 500).alias("playhead"), F.lit(2000).alias("behind"), F.lit(20_000).alias("ahead"), F.lit(100).alias("priority"))
    return scheduler.scored_blocks(blocks, r.filter("request_id % 2 = 1"), focus).select("block_id", "track_id", "request_id", "effective_priority", "rank")


@query(
    f"""{S.with_sql("req")}, x AS (SELECT track_id, request_id % 40 AS request_id, request_id AS serial, request_id % 13 = 0 AS bad FROM req),
    y AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN row_number() OVER (PARTITION BY track_id, request_id, bad ORDER BY serial) > 1 THEN 'conflict' END AS e FROM x)
    SELECT track_id, request_id, serial, CASE WHEN e IS NULL AND count(*) FILTER (e IS NULL) OVER (PARTITION BY track_id ORDER BY serial ROWS UNBOUNDED PRECEDING) > 16 THEN 'limit' ELSE e END AS error FROM y"""
)
def request_admission(spark, sf_dir):
    k = F.col("request_id")
    r = S.request_ranges(spark, sf_dir).select("track_id", (k % 40).alias("request_id"), k.alias("serial"), "first_frame", F.when(k % 13 == 0, F.col("first_frame")).otherwise(F.col("end_frame")).alias("end_frame"))
    return scheduler.admitted(r).select("track_id", "request_id", "serial", "error")


@query(
    f"""{S.with_sql("req")}, half AS (SELECT * FROM req WHERE request_id % 2 = 0),
    b AS (SELECT *, max(end_frame) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM half),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_frame > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY first_frame, end_frame) AS island FROM b),
    a AS (SELECT track_id, min(first_frame) AS af, max(end_frame) AS ae FROM i GROUP BY track_id, island),
    m AS (SELECT r.request_id, r.track_id, r.first_frame, r.end_frame, r.priority, r.skips, r.deadline, coalesce(max(CASE WHEN af <= r.first_frame THEN ae END), r.first_frame) AS mf, least(coalesce(min(CASE WHEN af > r.first_frame THEN af END), r.end_frame), r.end_frame) AS me
      FROM req r LEFT JOIN a ON a.track_id = r.track_id AND af < r.end_frame AND r.first_frame < ae GROUP BY r.request_id, r.track_id, r.first_frame, r.end_frame, r.priority, r.skips, r.deadline)
    SELECT track_id, request_id, mf AS first_frame, least(me, mf + 4096) AS end_frame FROM m WHERE mf < m.end_frame
    QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY {_EFFECTIVE} DESC, (deadline <> 0)::INT DESC, CASE WHEN deadline <> 0 THEN deadline END NULLS LAST, request_id) = 1"""
)
def pcm_demand(spark, sf_dir):
    r = S.request_ranges(spark, sf_dir)
    return scheduler.demand(r, coverage.accepted_ranges(r.filter("request_id % 2 = 0")))


@query(
    """WITH m AS (SELECT unnest(range(512)) AS mask), a AS (SELECT mask, mask | CASE WHEN mask & 64 <> 0 THEN 32 ELSE 0 END | CASE WHEN mask & 256 <> 0 THEN 16 ELSE 0 END AS c FROM m),
    b AS (SELECT mask, c | CASE WHEN c & 48 <> 0 THEN 8 ELSE 0 END | CASE WHEN c <> 0 THEN 1 ELSE 0 END AS closed FROM a) SELECT mask, bit_count(closed)::BIGINT AS features, closed FROM b"""
)
def feature_closure(spark, sf_dir):
    rows = [(m, int(closure(Feature(m)))) for m in range(512)]
    return spark.createDataFrame(rows, "mask bigint, closed bigint").select("mask", F.bit_count("closed").cast("bigint").alias("features"), "closed")


_BINS = "bins AS (SELECT track_id, frame // {0} AS bin, sum(floor(least(abs(x), 1.0::DOUBLE) * 32768.0::DOUBLE)::BIGINT)::BIGINT AS sum_absolute, count(*) AS sample_count, count(*) = {0} AS complete FROM {1} GROUP BY 1, 2)"


@query(f"{S.with_sql('sig_v')}, {_BINS.format(16, 'sig_v')} SELECT * FROM bins")
def onset_bins(spark, sf_dir):
    return onset.bins(S.vector_samples(spark, sf_dir), 16)


@query(f"{S.with_sql('sig_v')}, {_BINS.format(128, 'sig_v')} SELECT * FROM bins")
def global_bins(spark, sf_dir):
    return onset.bins(S.vector_samples(spark, sf_dir), 128)


_EVIDENCE = """runs AS (SELECT track_id, min(bin) AS f, count(*) AS n FROM (SELECT b.track_id, bin, bin - row_number() OVER (PARTITION BY b.track_id ORDER BY bin) AS run FROM bins b
      JOIN (SELECT track_id, max(bin) AS m FROM bins GROUP BY 1) x ON x.track_id = b.track_id WHERE complete AND bin > m - {0}) GROUP BY track_id, run),
    ev AS (SELECT track_id, f AS first_bin, f + n AS end_bin FROM runs QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f) = 1)"""


@query(
    f"""{S.with_sql("sig_u")}, bins AS (SELECT track_id, frame // 4 AS bin, 0 AS s, count(*) = 4 AND frame // 4 % 5 <> 3 AS complete FROM sig_u GROUP BY track_id, frame // 4),
    {_EVIDENCE.format(4096)} SELECT * FROM ev"""
)
def evidence_run(spark, sf_dir):
    b = onset.bins(S.user_samples(spark, sf_dir), 4).withColumn("complete", F.col("complete") & (F.col("bin") % 5 != 3))
    return onset.evidence(b, 4096)


_E9 = "floor(({0}) * 1000000000 + 0.5)::BIGINT"
FLUX_SQL = f"""{S.with_sql("sig_v")}, {_BINS.format(16, "sig_v")}, {_EVIDENCE.format(4096)},
    en AS (SELECT b.track_id, bin, bin - first_bin AS o, sum_absolute / (sample_count * 32768.0::DOUBLE) AS e FROM bins b JOIN ev USING (track_id) WHERE bin >= first_bin AND bin < end_bin),
    flux AS (SELECT track_id, bin, o, greatest(0.0::DOUBLE, e - lag(e, 1, 0.0::DOUBLE) OVER (PARTITION BY track_id ORDER BY bin)) AS flux FROM en)"""
WINDOW_SQL = FLUX_SQL.replace("frame // 16 AS bin", "frame // 128 AS bin").replace("count(*) = 16", "count(*) = 128").replace(
    "flux AS (SELECT track_id, bin, o,", "flux AS (SELECT track_id, o // 64 AS w, bin, o,"
).replace("OVER (PARTITION BY track_id ORDER BY bin)) AS flux", "OVER (PARTITION BY track_id, o // 64 ORDER BY bin)) AS flux")


@query(f"{FLUX_SQL} SELECT track_id, bin, {_E9.format('flux')} AS flux_e9 FROM flux")
def onset_flux(spark, sf_dir):
    b = onset.bins(S.vector_samples(spark, sf_dir), 16)
    return onset.flux(b, onset.evidence(b, 4096)).select("track_id", "bin", F.floor(F.col("flux") * 1e9 + 0.5).cast("bigint").alias("flux_e9"))


@query(f'{WINDOW_SQL} SELECT track_id, w AS "window", bin, {_E9.format("flux")} AS flux_e9 FROM flux')
def window_flux(spark, sf_dir):
    b = onset.bins(S.vector_samples(spark, sf_dir), 128)
    return onset.flux(b, onset.evidence(b, 4096), 64).select("track_id", "window", "bin", F.floor(F.col("flux") * 1e9 + 0.5).cast("bigint").alias("flux_e9"))


@query("SELECT lag, ((60000::BIGINT * 48000 + lag * 256 // 2) // (lag * 256))::INT AS tempo FROM (SELECT unnest(range(38, 282)) AS lag)")
def tempo_of_lag(spark, sf_dir):
    return spark.range(38, 282).select(F.col("id").alias("lag"), tempo_from_lag(F.col("id"), 48_000, 256).alias("tempo"))


@query("SELECT event_id, floor(event_id / 44100.0::DOUBLE * 1000000000 + 0.5)::BIGINT AS at_e9, floor(value * 44100.0::DOUBLE)::BIGINT AS start_frame, ceil(value * 44100.0::DOUBLE)::BIGINT AS end_frame, round_even(value * 44100.0::DOUBLE, 0)::BIGINT AS nearest FROM events")
def frame_times(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    at = lambda how: frame_at(F.col("value"), 44_100, how)
    return e.select("event_id", F.floor(seconds(F.col("event_id"), 44_100) * 1e9 + 0.5).cast("bigint").alias("at_e9"), at("floor").alias("start_frame"), at("ceil").alias("end_frame"), at("nearest").alias("nearest"))


@query("SELECT rate, corner, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - exp(-2.0::DOUBLE * pi() * corner / rate))) * 1000000000 + 0.5)::BIGINT AS coefficient_e9 FROM (SELECT unnest([8000, 22050, 44100, 48000, 96000])::BIGINT AS rate), (SELECT unnest([200, 2000, 400000])::BIGINT AS corner)")
def filter_coefficients(spark, sf_dir):
    from ..functions.tempo import filter_coefficient

    rows = [(r, c, int(filter_coefficient(float(c), r) * 1e9 + 0.5)) for r in (8000, 22_050, 44_100, 48_000, 96_000) for c in (200, 2000, 400_000)]
    return spark.createDataFrame(rows, "rate bigint, corner bigint, coefficient_e9 bigint")


@query("SELECT rate, greatest(1, (rate * 60 + 300 * 256 - 1) // (300 * 256)) AS low, rate * 60 // (40 * 256) AS high FROM (SELECT unnest([8000, 22050, 44100, 48000, 96000])::BIGINT AS rate)")
def lag_bounds(spark, sf_dir):
    from ..config import Geometry

    return spark.createDataFrame([(r, *Geometry(sample_rate=r).lags(256)) for r in (8000, 22_050, 44_100, 48_000, 96_000)], "rate bigint, low bigint, high bigint")


@query("SELECT tempo, floor(exp(-0.5::DOUBLE * power(ln(tempo / 125000.0::DOUBLE) / 0.55::DOUBLE, 2)) * 1000000 + 0.5)::BIGINT AS prior_e6 FROM (SELECT unnest(range(40000, 300001, 500)) AS tempo)")
def tempo_prior(spark, sf_dir):
    return spark.range(40_000, 300_001, 500).select(F.col("id").alias("tempo"), F.floor(prior(F.col("id")) * 1e6 + 0.5).cast("bigint").alias("prior_e6"))


@query(_columns_sql("sig_e", 64) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def seed_resume(spark, sf_dir):
    """Columns of the first half and then of the rest: the same as in one go."""
    x = S.event_samples(spark, sf_dir)
    half = div(x.agg(F.max("frame").alias("m")).select("m").first()["m"], 128) * 64
    total = waveform.totals(x)
    first = waveform.columns(x.filter(F.col("frame") < half), 64)
    return waveform.resumed(first, waveform.columns(x.filter(F.col("frame") >= half - 64), 64, total))


_SEED = """seed AS (SELECT p_partkey AS track_id, [0, 48000, 44100][k % 3 + 1] AS prior_sample_rate, 48000 AS sample_rate, [0, 1, 2][k // 3 % 3 + 1] AS prior_channels, 1 AS channels, [0, 1, 2][k // 2 % 3 + 1] AS prior_layout, [0, 1][k % 2 + 1] AS layout,
    [0, 1, 1, 2][k // 5 % 4 + 1] AS prior_kind, [1, 0, 1][k % 3 + 1] AS kind, (k // 7 % 3 = 0)::INT AS prior_print, 1 AS print, k % 13 = 0 AS require, CASE WHEN k % 4 <> 0 THEN 1000 + k % 5 // 4 END AS prior_total, CASE WHEN k % 6 <> 0 THEN 1000 END AS total, [1024, 1024, 1024, 512][k // 11 % 4 + 1] AS prior_size, 1024 AS size, 900 + k % 12 * 10 AS prior_end
    FROM (SELECT p_partkey, p_partkey * 7 + p_size AS k FROM part))"""


@query(
    f"""WITH {_SEED} SELECT track_id, CASE WHEN prior_sample_rate <> 0 AND prior_sample_rate <> sample_rate THEN 'sample_rate' WHEN prior_channels <> 0 AND prior_channels <> channels THEN 'channels' WHEN prior_layout <> 0 AND layout <> 0 AND prior_layout <> layout THEN 'layout'
    WHEN require AND (kind = 0 OR prior_kind = 0) THEN 'identity' WHEN kind <> 0 AND prior_kind <> 0 AND (kind <> prior_kind OR prior_print <> print) THEN 'fingerprint' WHEN prior_total <> total THEN 'length' WHEN prior_size <> size THEN 'column_size' WHEN prior_end > total THEN 'beyond_end' END AS reason FROM seed"""
)
def seed_conflicts(spark, sf_dir):
    """Whether earlier results fit the analyses that they are to seed, with the first reason against it."""
    k = F.col("p_partkey") * 7 + F.col("p_size")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    rows = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"), pick((0, 48_000, 44_100), k).alias("prior_sample_rate"), F.lit(48_000).alias("sample_rate"), pick((0, 1, 2), div(k, 3)).alias("prior_channels"), F.lit(1).alias("channels"),
        pick((0, 1, 2), div(k, 2)).alias("prior_layout"), pick((0, 1), k).alias("layout"), pick((0, 1, 1, 2), div(k, 5)).alias("prior_fingerprint_kind"), pick((1, 0, 1), k).alias("fingerprint_kind"),
        (div(k, 7) % 3 == 0).cast("int").alias("prior_fingerprint"), F.lit(1).alias("fingerprint"), (k % 13 == 0).alias("require_identity"), F.when(k % 4 != 0, div(k % 5, 4) + 1000).alias("prior_total_frames"),
        F.when(k % 6 != 0, 1000).alias("total_frames"), pick((1024, 1024, 1024, 512), div(k, 11)).alias("prior_frames_per_column"), F.lit(1024).alias("frames_per_column"), (k % 12 * 10 + 900).alias("prior_end"),
    )
    return rows.select("track_id", seeding.conflict().alias("reason"))


@query(
    _columns_sql("sig_u", 16) + f""", c AS (SELECT track_id, column_index, {_FINAL} FROM cols), r AS (SELECT c.*, floor(rms / 65535.0::DOUBLE * 8388608.0::DOUBLE)::BIGINT AS level, least(16, total - column_index * 16) AS n FROM c JOIN t USING (track_id))
    SELECT track_id, column_index, floor(minimum / 32767.0::DOUBLE * 1000000000 + 0.5)::BIGINT AS lo_e9, floor(maximum / 32767.0::DOUBLE * 1000000000 + 0.5)::BIGINT AS hi_e9, (level::HUGEINT * level * n)::BIGINT AS sum_squares, n, flags & 4 <> 0 AS clipped FROM r"""
)
def seed_accumulators(spark, sf_dir):
    """Accumulators read back from finished columns."""
    x = S.user_samples(spark, sf_dir)
    total = waveform.totals(x)
    e9 = lambda c: F.floor(F.col(c) * 1e9 + 0.5).cast("bigint").alias(f"{c}_e9")
    return seeding.restored(waveform.columns(x, 16, total), 16, total).select("track_id", "column_index", e9("lo"), e9("hi"), "sum_squares", "n", "clipped")


@query(_columns_sql("sig_u", 16) + f" SELECT track_id, column_index, {_FINAL} FROM cols")
def seed_restored(spark, sf_dir):
    """Columns from accumulators that were read back from columns: the same ones."""
    x = S.user_samples(spark, sf_dir)
    total = waveform.totals(x)
    return waveform.finalized(waveform.merged(seeding.restored(waveform.columns(x, 16, total), 16, total)))


@query("SELECT user_id::VARCHAR AS track_id, count(*) AS rows, sha256(string_agg(event_type, ',' ORDER BY ts, event_id)) AS signature, sha256(string_agg(event_type, ',' ORDER BY ts, event_id)) <> sha256(string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (event_id % 10 <> 0)) AS changed FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 10 <> 0) > 0")
def generation_diff(spark, sf_dir):
    """Which tracks a later generation changes, by the hash of their content."""
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("track_id"), "ts", "event_id", "event_type")

    def signed(rows, name):
        content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: r["event_type"]), ",")
        return rows.groupBy("track_id").agg(F.count("*").alias(f"{name}_rows"), F.sha2(content, 256).alias(name))

    both = signed(e, "new").join(signed(e.filter("event_id % 10 <> 0"), "old"), "track_id")
    return both.select("track_id", F.col("new_rows").alias("rows"), F.col("new").alias("signature"), (F.col("new") != F.col("old")).alias("changed"))


