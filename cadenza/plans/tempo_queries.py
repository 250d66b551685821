"""Queries over tempo, grids and corpora, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Geometry
from ..functions.tempo import div, period_q32, relation
from ..operators import bands, corpus, grid, onset, tempo
from ..sources import surrogates as S
from .waveform_queries import FLUX_SQL, WINDOW_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Sizes for the surrogate streams: 16 frames to a bin at 3000 frames a second have the lags of 256 at 48000.
SMALL = Geometry(sample_rate=3000, onset_frames=16, global_frames=128, window_bins=64, min_window_bins=16, min_tempo_bins=64, stable_tempo_bins=1024)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _dense(spark, sf_dir):
    return tempo.onset_flux(S.vector_samples(spark, sf_dir), SMALL)


_LAGS = f"""{FLUX_SQL}, n AS (SELECT track_id, count(*) AS n FROM flux GROUP BY 1),
    l AS (SELECT track_id, n, unnest(range(38, CASE WHEN 281 * 2 >= n THEN n // 2 ELSE 281 END + 1)) AS lag FROM n),
    c AS (SELECT l.track_id, l.lag, sum(a.flux * b.flux) / sqrt(sum(a.flux * a.flux) * sum(b.flux * b.flux)) AS correlation
      FROM l JOIN flux a ON a.track_id = l.track_id AND a.o >= l.lag JOIN flux b ON b.track_id = l.track_id AND b.o = a.o - l.lag GROUP BY 1, 2),
    s AS (SELECT track_id, lag::INT AS lag, correlation, correlation * exp(-0.5::DOUBLE * power(ln(((60000::BIGINT * 3000 + lag * 16 // 2) // (lag * 16)) / 125000.0::DOUBLE) / 0.55::DOUBLE, 2)) AS score FROM c)"""


@query(f"{_LAGS} SELECT track_id, lag, floor(correlation * 1000000 + 0.5)::BIGINT AS correlation_e6, floor(score * 1000000 + 0.5)::BIGINT AS score_e6 FROM s")
def lag_correlation(spark, sf_dir):
    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(f"{c}_e6")
    return tempo.lag_scores(_dense(spark, sf_dir), SMALL).select("track_id", "lag", e6("correlation"), e6("score"))


@query(f"{_LAGS} SELECT track_id, lag, floor(score * 1000000 + 0.5)::BIGINT AS score_e6, row_number() OVER (PARTITION BY track_id ORDER BY floor(score * 1000000000 + 0.5)::BIGINT DESC, lag)::INT AS rank FROM s QUALIFY rank <= 3")
def tempo_top3(spark, sf_dir):
    top = tempo.top_lags(tempo.lag_scores(_dense(spark, sf_dir), SMALL))
    return top.select("track_id", "lag", F.floor(F.col("score_e9") / 1000 + 0.5).cast("bigint").alias("score_e6"), "rank")


@query(f"{FLUX_SQL} SELECT track_id, o % 90 AS phase, floor(sum(flux) * 1000000 + 0.5)::BIGINT AS total_e6 FROM flux GROUP BY 1, 2")
def phase_histogram(spark, sf_dir):
    return tempo.phase_histogram(_dense(spark, sf_dir), 90).select("track_id", "phase", F.floor(F.col("total") * 1e6 + 0.5).cast("bigint").alias("total_e6"))


@query(
    f"""{FLUX_SQL}, d AS (SELECT track_id, flux, (o + 90 - 17) % 90 AS d FROM flux), m AS (SELECT track_id, avg(flux) FILTER (least(d, 90 - d) <= 1) AS a, avg(flux) FILTER (least(d, 90 - d) > 1) AS b FROM d GROUP BY 1)
    SELECT track_id, floor((a - b) / (a + b) * 1000000 + 0.5)::BIGINT AS fit_e6 FROM m"""
)
def grid_fit(spark, sf_dir):
    return tempo.grid_fit(_dense(spark, sf_dir), 90, 17).select("track_id", F.floor(F.col("fit") * 1e6 + 0.5).cast("bigint").alias("fit_e6"))


def _windows(spark, sf_dir):
    b = onset.bins(S.vector_samples(spark, sf_dir), SMALL.global_frames)
    return grid.windows(onset.flux(b, onset.evidence(b, 4096), SMALL.window_bins), SMALL)


_RATIOS = ((3, 2, 3), (2, 3, 4), (2, 1, 2), (1, 2, 1), (3, 1, 6), (1, 3, 5), (4, 1, 8), (1, 4, 7))
_OF = "CASE WHEN {0} = {1} THEN 0 " + " ".join(f"WHEN abs({{1}} - {{0}} * {n} // {d}) <= {{0}} * {n} // {d} // 50 + 1 THEN {c}" for n, d, c in _RATIOS) + " ELSE 0 END"

#: The three best lags; periods measured over up to 16 of them; candidates near one that is kept go.
_CANDIDATES = f"""{_LAGS}, top AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS r, max(score) OVER (PARTITION BY track_id) AS s1 FROM s WHERE score > 0 QUALIFY r <= 3),
    m AS (SELECT top.*, n.n, greatest(1, least(16, n.n // 2 // lag)) AS m FROM top JOIN n USING (track_id) WHERE s1 >= 0.05 AND n.n >= 64),
    q AS (SELECT *, unnest(range(greatest(1, m * lag - m // 2), least(m * lag + m // 2, n - 1) + 1)) AS far FROM m WHERE m >= 2),
    qc AS (SELECT q.track_id, q.r, q.far, any_value(q.m) AS m, any_value(q.lag) AS lag, sum(a.flux * b.flux) / sqrt(sum(a.flux * a.flux) * sum(b.flux * b.flux)) AS c FROM q JOIN flux a ON a.track_id = q.track_id AND a.o >= q.far JOIN flux b ON b.track_id = q.track_id AND b.o = a.o - q.far GROUP BY 1, 2, 3),
    off AS (SELECT track_id, r, CASE WHEN max(c) > 0 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, arg_max(far, (c, -far)) / any_value(m)::DOUBLE - any_value(lag))) ELSE 0 END AS off FROM qc GROUP BY 1, 2),
    t AS (SELECT m.track_id, m.r, m.lag, m.score, m.s1, m.n, CASE WHEN coalesce(off, 0) = 0 THEN t0 ELSE floor(t0 * m.lag / (m.lag + off) + 0.5)::BIGINT END AS tempo FROM (SELECT *, (60000::BIGINT * 3000 + lag * 16 // 2) // (lag * 16) AS t0 FROM m) m LEFT JOIN off USING (track_id, r)),
    w3 AS (SELECT track_id, max(tempo) FILTER (r = 1 AND tempo BETWEEN 40000 AND 300000) AS a, max(tempo) FILTER (r = 2 AND tempo BETWEEN 40000 AND 300000) AS b, max(tempo) FILTER (r = 3 AND tempo BETWEEN 40000 AND 300000) AS c FROM t GROUP BY 1),
    k3 AS (SELECT track_id, a, CASE WHEN a IS NULL OR abs(b - a) > 500 THEN b END AS b, c FROM w3),
    kept AS (SELECT track_id, a IS NOT NULL AS k1, b IS NOT NULL AS k2, c IS NOT NULL AND (a IS NULL OR abs(c - a) > 500) AND (b IS NULL OR abs(c - b) > 500) AS k3 FROM k3),
    cand AS (SELECT t.*, least(65535, floor(score / s1 * 65535 + 0.5))::BIGINT AS points, row_number() OVER (PARTITION BY track_id ORDER BY r) - 1 AS i FROM t JOIN kept USING (track_id) WHERE (r = 1 AND k1) OR (r = 2 AND k2) OR (r = 3 AND k3))"""


@query(
    f"""{_CANDIDATES} SELECT c.track_id, c.i::INT AS rank, c.tempo::INT AS tempo, c.points::INT AS score, (25 + c.points * 70 // 65535)::INT AS confidence, {_OF.format("h.tempo", "c.tempo")} AS relation FROM cand c JOIN cand h ON h.track_id = c.track_id AND h.i = 0"""
)
def tempo_candidates(spark, sf_dir):
    return tempo.candidates(tempo.estimated(_dense(spark, sf_dir), SMALL))


@query(
    f"""{_CANDIDATES}, nom AS (SELECT track_id, tempo + 40 AS nominal FROM cand WHERE i = 1), back AS (SELECT track_id, i FROM cand JOIN nom USING (track_id) WHERE i > 0 AND points >= 55000 AND abs(tempo - nominal) / nominal::DOUBLE <= 0.01 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY points DESC, i) = 1),
    head AS (SELECT c.* FROM cand c LEFT JOIN back USING (track_id) WHERE c.i = coalesce(back.i, 0)),
    rel AS (SELECT c.track_id, c.i, c.points >= h.points * 7 // 10 AS close, {_OF.format("h.tempo", "c.tempo")} AS rel FROM cand c JOIN head h USING (track_id) WHERE c.i <> h.i),
    fl AS (SELECT track_id, bit_or(CASE WHEN close AND rel <> 0 THEN 128 | CASE rel WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END ELSE 0 END) AS f FROM rel GROUP BY 1),
    b AS (SELECT track_id, lag, score, n FROM t WHERE r = 1), sib AS (SELECT b.track_id, max(s.score) AS near FROM b, (SELECT unnest([1.5, 2.0 / 3, 2.0, 0.5, 3.0, 1.0 / 3, 4.0, 0.25]::DOUBLE[]) AS ratio) x JOIN s ON s.track_id = b.track_id AND s.lag = floor(b.lag / ratio + 0.5)::INT AND s.lag <> b.lag GROUP BY 1),
    am AS (SELECT b.*, CASE WHEN near > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (near / score - 0.85) / 0.15)) ELSE 0 END AS amb FROM b LEFT JOIN sib USING (track_id)),
    ph AS (SELECT track_id, arg_max(p, (x, -p)) AS phase FROM (SELECT b.track_id, o % b.lag AS p, sum(flux) AS x FROM b JOIN flux USING (track_id) GROUP BY 1, 2) GROUP BY 1),
    gf AS (SELECT track_id, avg(flux) FILTER (least(d, lag - d) <= 1) AS x, avg(flux) FILTER (least(d, lag - d) > 1) AS y FROM (SELECT b.track_id, b.lag, flux, (o + b.lag - phase) % b.lag AS d FROM b JOIN ph USING (track_id) JOIN flux USING (track_id)) GROUP BY 1),
    conf AS (SELECT am.*, phase, least(100, 35 + floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (x - y) / (x + y))) * 50)::INT + CASE WHEN (SELECT count(*) FROM cand c WHERE c.track_id = am.track_id) > 1 THEN floor(greatest(0.0::DOUBLE, 1 - (SELECT t.score FROM t WHERE t.track_id = am.track_id AND r = 2) / score) * 15)::INT ELSE 0 END + CASE WHEN n >= 1024 THEN 5 ELSE 0 END) AS c0 FROM am JOIN ph USING (track_id) JOIN gf USING (track_id))
    SELECT h.track_id, h.tempo::INT AS tempo, floor(c0 * (1 - amb))::INT AS confidence, 4 AS state, (coalesce(f, 0) | CASE WHEN amb > 0 THEN 128 ELSE 0 END | CASE WHEN back.i IS NOT NULL THEN 128 ELSE 0 END)::INT AS flags, conf.lag, phase::INT AS phase, first_bin * 16 AS evidence_first, end_bin * 16 AS evidence_end
    FROM head h JOIN conf USING (track_id) JOIN ev USING (track_id) LEFT JOIN fl USING (track_id) LEFT JOIN back USING (track_id)"""
)
def tempo_selected(spark, sf_dir):
    """The local estimates; a nominal tempo near the second candidate brings it to the front where its score is good enough."""
    f = _dense(spark, sf_dir)
    nominal = tempo.candidates(tempo.estimated(f, SMALL)).filter("rank = 1").select("track_id", (F.col("tempo") + 40).alias("nominal"))
    return tempo.estimated(f, SMALL, nominal).drop("candidates")


_WLAGS = f"""{WINDOW_SQL}, k AS (SELECT track_id, w, o - min(o) OVER (PARTITION BY track_id, w) AS i, flux, count(*) OVER (PARTITION BY track_id, w) AS n FROM flux),
    l AS (SELECT DISTINCT track_id, w, n, unnest(range(5, CASE WHEN 35 * 2 >= n THEN n // 2 ELSE 35 END + 1)) AS lag FROM k WHERE n >= 16),
    c AS (SELECT l.track_id, l.w, l.lag, sum(a.flux * b.flux) / sqrt(sum(a.flux * a.flux) * sum(b.flux * b.flux)) AS correlation
      FROM l JOIN k a ON a.track_id = l.track_id AND a.w = l.w AND a.i >= l.lag JOIN k b ON b.track_id = l.track_id AND b.w = l.w AND b.i = a.i - l.lag GROUP BY 1, 2, 3),
    s AS (SELECT track_id, w, lag, correlation, correlation * exp(-0.5::DOUBLE * power(ln(((60000::BIGINT * 3000 + lag * 128 // 2) // (lag * 128)) / 125000.0::DOUBLE) / 0.55::DOUBLE, 2)) AS score FROM c)"""


@query(
    f"""{_WLAGS}, best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY track_id, w ORDER BY score DESC, lag) = 1)
    SELECT track_id, w AS "window", floor(score * 1000000 + 0.5)::BIGINT AS score_e6, least(100, 40 + floor(least(1.0::DOUBLE, score) * 50)::INT)::INT AS confidence FROM best WHERE correlation >= 0.04"""
)
def window_tempo(spark, sf_dir):
    return _windows(spark, sf_dir).select("track_id", "window", F.floor(F.col("score") * 1e6 + 0.5).cast("bigint").alias("score_e6"), "confidence")


_WIN = "SELECT track % 40 AS track_id, track // 40 AS ord, (track // 40) * 4 AS first_bin, (track // 40) * 4 + 4 AS end_bin, truth // 4000 * 1000 + 40000 AS tempo, track % 3 AS phase, confidence FROM corpus"


def _steps(spark, sf_dir):
    c = S.corpus_rows(spark, sf_dir)
    at = div(F.col("track"), 40)
    return c.select((F.col("track") % 40).alias("track_id"), (at * 4).alias("first_bin"), (at * 4 + 4).alias("end_bin"), (div(F.col("truth"), 4000) * 1000 + 40_000).cast("int").alias("tempo"), (F.col("track") % 3).cast("int").alias("phase"), F.col("confidence").cast("int").alias("confidence"))


#: Windows one after the other: a segment takes the next one while its tempo is near the running mean of whole numbers; the eighth segment takes all that are left.
_FOLD = f"""w AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY first_bin) AS i FROM ({_WIN})),
    f AS (SELECT track_id, i, 1 AS seg, 1 AS n, tempo, confidence, false AS cut, first_bin, end_bin, phase FROM w WHERE i = 1
      UNION ALL SELECT w.track_id, w.i, CASE WHEN abs(f.tempo - w.tempo) <= 1500 OR f.seg = 8 THEN f.seg ELSE f.seg + 1 END, CASE WHEN abs(f.tempo - w.tempo) <= 1500 THEN f.n + 1 WHEN f.seg = 8 THEN f.n ELSE 1 END,
        CASE WHEN abs(f.tempo - w.tempo) <= 1500 THEN (f.tempo * f.n + w.tempo) // (f.n + 1) WHEN f.seg = 8 THEN f.tempo ELSE w.tempo END, CASE WHEN abs(f.tempo - w.tempo) <= 1500 THEN (f.confidence * f.n + w.confidence) // (f.n + 1) WHEN f.seg = 8 THEN f.confidence ELSE w.confidence END,
        abs(f.tempo - w.tempo) > 1500 AND f.seg = 8, w.first_bin, w.end_bin, w.phase FROM f JOIN w ON w.track_id = f.track_id AND w.i = f.i + 1),
    g AS (SELECT track_id, seg, min(first_bin) * 128 AS first_frame, max(end_bin) * 128 AS end_frame, (min(first_bin) + arg_min(phase, i)) * 128 AS anchor, arg_max(tempo, i) AS tempo, arg_max(confidence, i) AS confidence, max(n) AS windows FROM f GROUP BY 1, 2),
    h AS (SELECT track_id, count(DISTINCT seg) AS segs, bool_or(cut) AS cut FROM f GROUP BY 1)"""
_RECURSIVE = S.with_sql("corpus").replace("WITH", "WITH RECURSIVE", 1)


@query(
    f"""{_RECURSIVE}, {_FOLD} SELECT track_id, seg AS segment_id, first_frame, end_frame, anchor, tempo, confidence, windows AS window_count, CASE WHEN segs > 1 THEN 2 ELSE 0 END + CASE WHEN cut THEN 128 ELSE 0 END AS flags,
    180000000 // tempo AS period_whole, (180000000 % tempo) * 4294967296 // tempo AS period_frac FROM g JOIN h USING (track_id)"""
)
def segments_running_mean(spark, sf_dir):
    return grid.with_periods(grid.segments(_steps(spark, sf_dir), SMALL), SMALL).drop("beat_count")


@query(
    f"""{_RECURSIVE}, {_FOLD} SELECT track_id, arg_max(tempo, (end_frame - first_frame, -seg)) AS nominal, (SELECT sum(confidence)::BIGINT // count(*) FROM w WHERE w.track_id = g.track_id) AS confidence, CASE WHEN count(*) > 1 THEN 3 ELSE 1 END AS representation, count(*) AS segment_count FROM g GROUP BY 1"""
)
def global_grid_summary(spark, sf_dir):
    w = _steps(spark, sf_dir)
    return grid.grid_summary(w, grid.segments(w, SMALL))


@query(
    f"""{S.with_sql("corpus")}, w AS ({_WIN}), b AS (SELECT *, coalesce((abs(tempo - lag(tempo) OVER (PARTITION BY track_id ORDER BY first_bin)) > 1500)::INT, 1) AS new FROM w),
    g AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY first_bin ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM b)
    SELECT track_id, segment_id, min(first_bin) AS first_bin, max(end_bin) AS end_bin, count(*) AS window_count, sum(tempo)::BIGINT // count(*) AS tempo, sum(confidence)::BIGINT // count(*) AS confidence FROM g GROUP BY 1, 2"""
)
def segments_lag_break(spark, sf_dir):
    return grid.lag_break_segments(_steps(spark, sf_dir))


_SEG = "seg AS (SELECT track AS track_id, 1 AS segment_id, 1000 + track % 7 * 400 AS first_frame, 1000 + track % 7 * 400 + 200000 AS end_frame, track % 5 * 700 AS anchor, truth AS tempo, confidence FROM corpus)"


def _segments(spark, sf_dir):
    c = S.corpus_rows(spark, sf_dir)
    first = F.lit(1000) + F.col("track") % 7 * 400
    s = c.select(F.col("track").alias("track_id"), F.lit(1).alias("segment_id"), first.alias("first_frame"), (first + 200_000).alias("end_frame"), (F.col("track") % 5 * 700).alias("anchor"), F.col("truth").alias("tempo"), "confidence")
    return grid.with_periods(s, Geometry())


@query(f"{S.with_sql('corpus')} SELECT track, 2880000000 // truth AS whole, (2880000000 % truth) * 4294967296 // truth AS frac FROM corpus")
def frame_period_q32(spark, sf_dir):
    whole, frac = period_q32(F.col("truth"), 48_000)
    return S.corpus_rows(spark, sf_dir).select("track", whole.alias("whole"), frac.alias("frac"))


@query(
    f"""{S.with_sql("corpus")}, {_SEG}, p AS (SELECT *, 2880000000 // tempo + CASE WHEN 2880000000 % tempo <> 0 AND (2880000000 % tempo) * 4294967296 // tempo <> 0 THEN 1 ELSE 0 END AS period FROM seg),
    q AS (SELECT *, CASE WHEN anchor < first_frame THEN anchor + (first_frame - anchor + period - 1) // period * period ELSE anchor END AS start FROM p)
    SELECT track_id, CASE WHEN start >= end_frame THEN 0 ELSE 1 + (end_frame - 1 - start) // period END AS beat_count FROM q"""
)
def beat_count_of(spark, sf_dir):
    return _segments(spark, sf_dir).select("track_id", "beat_count")


_BEATS = f"""{S.with_sql("corpus")}, {_SEG}, p AS (SELECT *, (2880000000 // tempo)::HUGEINT * 4294967296 + (2880000000 % tempo) * 4294967296 // tempo AS period, anchor::HUGEINT * 4294967296 AS a FROM seg),
    k AS (SELECT *, CASE WHEN first_frame <= anchor THEN 0 ELSE (((first_frame - anchor)::HUGEINT * 4294967296 + period - 1) // period)::BIGINT END AS k0, (((end_frame - anchor)::HUGEINT * 4294967296 + period - 1) // period)::BIGINT AS k1 FROM p)"""


@query(f"{_BEATS}, e AS (SELECT *, unnest(range(k0, k1)) AS k FROM k) SELECT track_id, k - k0 AS ordinal, segment_id, ((a + k * period) // 4294967296)::BIGINT AS whole, ((a + k * period) % 4294967296)::BIGINT AS frac_q32, confidence FROM e WHERE k - k0 < 3072")
def beat_expansion(spark, sf_dir):
    return grid.beats(_segments(spark, sf_dir))


_DENSE = "d AS (SELECT track % 20 AS track_id, track // 20 AS segment_id, track // 20 * 900000 AS first_frame, track // 20 * 900000 + 900000 AS end_frame, track // 20 * 900000 + track % 5 * 700 AS anchor, truth AS tempo, confidence, 2 AS flags FROM corpus WHERE track // 20 < 12)"


@query(
    f"""{S.with_sql("corpus")}, {_DENSE}, p AS (SELECT *, (2880000000 // tempo)::HUGEINT * 4294967296 + (2880000000 % tempo) * 4294967296 // tempo AS period FROM d),
    n AS (SELECT *, ((end_frame - anchor)::HUGEINT * 4294967296 + period - 1) // period - greatest(0, ((first_frame - anchor)::HUGEINT * 4294967296 + period - 1) // period) AS n FROM p),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY track_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY track_id) AS every FROM n)
    SELECT track_id, segment_id, least(n, 3072 - least(before, 3072))::BIGINT AS beat_count, least(before, 3072)::BIGINT AS anchor_ordinal, 2 + CASE WHEN every > 3072 THEN 128 ELSE 0 END AS flags FROM c"""
)
def beat_numbers(spark, sf_dir):
    """Counts of listed beats, up to the limit of a track, and the flag that says that some were cut off."""
    c, at = S.corpus_rows(spark, sf_dir).filter(div(F.col("track"), 20) < 12), div(F.col("track"), 20)
    first = at * 900_000
    s = c.select((F.col("track") % 20).alias("track_id"), at.alias("segment_id"), first.alias("first_frame"), (first + 900_000).alias("end_frame"), (first + F.col("track") % 5 * 700).alias("anchor"), F.col("truth").alias("tempo"), "confidence", F.lit(2).alias("flags"))
    return grid.numbered(grid.with_periods(s, Geometry())).select("track_id", "segment_id", "beat_count", "anchor_ordinal", "flags")


@query(
    f"""{_BEATS}, f AS (SELECT track_id, first_frame + 777 + track_id % 100 * 1000 AS frame, anchor, segment_id, period FROM k)
    SELECT track_id, frame, segment_id, (((frame - anchor)::HUGEINT * 4294967296) // period)::BIGINT AS k, (anchor + ((((frame - anchor)::HUGEINT * 4294967296) // period) * period) // 4294967296)::BIGINT AS beat_frame FROM f WHERE frame >= anchor"""
)
def beat_asof(spark, sf_dir):
    s = _segments(spark, sf_dir)
    frames = s.select("track_id", (F.col("first_frame") + 777 + F.col("track_id") % 100 * 1000).alias("frame"))
    return grid.beat_at(frames, s)


_LOCK = "locks AS (SELECT o_orderkey AS lock_id, o_custkey % 50 AS track_id, o_custkey * 100 AS first_frame, o_custkey * 100 + 3000 AS end_frame, 100000 + o_orderkey % 9 * 200 AS tempo, o_custkey * 100 AS anchor FROM orders)"
_PARTS = "segs AS (SELECT track % 50 AS track_id, track // 50 AS segment_id, track // 50 * 4000 AS first_frame, track // 50 * 4000 + 4000 AS end_frame, 100000 + truth % 11 * 150 AS tempo, track // 50 * 4000 + truth % 3000 AS anchor FROM corpus)"


def _locks(spark, sf_dir):
    o, c = S.table(spark, sf_dir, "orders"), S.corpus_rows(spark, sf_dir)
    first = F.col("o_custkey") * 100
    locks = o.select(F.col("o_orderkey").alias("lock_id"), (F.col("o_custkey") % 50).alias("track_id"), first.alias("first_frame"), (first + 3000).alias("end_frame"), (F.lit(100_000) + F.col("o_orderkey") % 9 * 200).alias("tempo"), first.alias("anchor"))
    at = div(F.col("track"), 50)
    segs = c.select((F.col("track") % 50).alias("track_id"), at.alias("segment_id"), (at * 4000).alias("first_frame"), (at * 4000 + 4000).alias("end_frame"), (F.lit(100_000) + F.col("truth") % 11 * 150).alias("tempo"), (at * 4000 + F.col("truth") % 3000).alias("anchor"))
    return locks, segs


_MET = "FROM locks l LEFT JOIN segs s ON s.track_id = l.track_id AND l.first_frame < s.end_frame AND s.first_frame < l.end_frame"


@query(f"{S.with_sql('corpus')}, {_LOCK}, {_PARTS} SELECT l.lock_id, l.track_id, l.first_frame, l.end_frame, l.tempo, l.anchor, bool_or(coalesce(abs(s.tempo - l.tempo) > 500 OR abs(s.anchor - l.anchor) > 2048, false)) AS conflict {_MET} GROUP BY ALL")
def locked_conflict(spark, sf_dir):
    return grid.locked_conflicts(*_locks(spark, sf_dir))


@query(f"{S.with_sql('corpus')}, {_LOCK}, {_PARTS} SELECT l.lock_id, l.track_id, l.first_frame, l.end_frame, coalesce(arg_min(s.tempo, s.segment_id), l.tempo) AS tempo, coalesce(arg_min(s.anchor, s.segment_id), l.anchor) AS anchor {_MET} GROUP BY l.lock_id, l.track_id, l.first_frame, l.end_frame, l.tempo, l.anchor")
def revision_applied(spark, sf_dir):
    return grid.applied(*_locks(spark, sf_dir))


@query(
    """WITH g AS (SELECT o_custkey AS track_id, o_orderkey AS generation, o_orderpriority AS signature FROM orders), c AS (SELECT *, lag(signature) OVER (PARTITION BY track_id ORDER BY generation) AS was FROM g),
    d AS (SELECT * FROM c WHERE was IS NULL OR was <> signature) SELECT track_id, generation, row_number() OVER (PARTITION BY track_id ORDER BY generation)::INT AS revision_id, (row_number() OVER (PARTITION BY track_id ORDER BY generation) - 1)::INT AS previous_id FROM d"""
)
def revision_history(spark, sf_dir):
    return grid.revisions(S.table(spark, sf_dir, "orders").selectExpr("o_custkey as track_id", "o_orderkey as generation", "o_orderpriority as signature"))


@query(
    """WITH o AS (SELECT o_custkey AS track_id, o_orderkey AS generation, o_orderpriority AS signature, o_orderkey % 3 = 0 AS conflict, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders)
    SELECT track_id, generation, row_number() OVER w::INT AS revision_id, (row_number() OVER w - 1)::INT AS previous_id, CASE WHEN conflict THEN 1 ELSE 2 END AS state FROM o WHERE was IS NULL OR was <> signature WINDOW w AS (PARTITION BY track_id ORDER BY generation)"""
)
def revision_states(spark, sf_dir):
    """Revisions wait where the generation's grid differs from a locked range."""
    return grid.revisions(S.table(spark, sf_dir, "orders").selectExpr("o_custkey as track_id", "o_orderkey as generation", "o_orderpriority as signature", "o_orderkey % 3 = 0 as conflict"))


@query(
    """WITH RECURSIVE g AS (SELECT c_custkey AS track_id, c_custkey % 6 AS state, c_custkey % 7 * 100 AS gf, c_custkey % 7 * 100 + 3000 AS ge, CASE WHEN c_custkey % 4 = 0 THEN 1000 END AS lf, CASE WHEN c_custkey % 4 = 0 THEN 2000 END AS le FROM customer),
    q AS (SELECT o_orderkey AS lock_id, o_custkey AS track_id, o_orderkey % 5 * 500 AS f, o_orderkey % 5 * 500 + o_orderkey % 3 * 1000 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    s AS (SELECT track_id, 0::BIGINT AS i, NULL::BIGINT AS lock_id, lf, le, '' AS status FROM g
      UNION ALL SELECT track_id, i, lock_id, CASE WHEN status = 'ok' THEN f ELSE lf END, CASE WHEN status = 'ok' THEN e ELSE le END, status FROM (SELECT s.track_id, q.i, q.lock_id, q.f, q.e, s.lf, s.le,
        CASE WHEN q.f >= q.e THEN 'invalid' WHEN g.state NOT IN (3, 4) THEN 'invalid_state' WHEN s.lf IS NULL AND (q.f < g.gf OR q.e > g.ge) THEN 'conflict' WHEN s.lf IS NULL THEN 'ok' WHEN q.f = s.lf AND q.e = s.le AND q.f >= g.gf AND q.e <= g.ge THEN 'ok' ELSE 'conflict' END AS status
        FROM s JOIN q ON q.track_id = s.track_id AND q.i = s.i + 1 JOIN g ON g.track_id = s.track_id))
    SELECT lock_id, track_id, status FROM s WHERE i > 0"""
)
def lock_requests(spark, sf_dir):
    """Requests to lock local grids, one after the other for each track."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    first = k % 7 * 100
    grids = S.table(spark, sf_dir, "customer").select(k.alias("track_id"), (k % 6).cast("int").alias("state"), first.alias("first_frame"), (first + 3000).alias("end_frame"), F.when(k % 4 == 0, 1000).alias("locked_first"), F.when(k % 4 == 0, 2000).alias("locked_end"))
    at = o % 5 * 500
    asked = S.table(spark, sf_dir, "orders").select(o.alias("lock_id"), F.col("o_custkey").alias("track_id"), at.alias("first_frame"), (at + o % 3 * 1000).alias("end_frame"))
    return grid.locked(grids, asked).select("lock_id", "track_id", "status")


_MOD = "18446744073709551616::HUGEINT"


@query(
    f"""{S.with_sql("corpus")}, {_DENSE}, p AS (SELECT *, 2880000000 // tempo AS pw, (2880000000 % tempo) * 4294967296 // tempo AS pf FROM d),
    c AS (SELECT *, pw + CASE WHEN pf <> 0 THEN 1 ELSE 0 END AS period FROM p), n AS (SELECT *, 1 + (end_frame - 1 - anchor) // period AS beats FROM c),
    l AS (SELECT track_id, [count(*), CASE WHEN count(*) > 1 THEN sum(beats) ELSE 0 END, CASE WHEN count(*) > 1 THEN 3 ELSE 1 END]::BIGINT[] || flatten(list([first_frame, end_frame, anchor, 0, pw, pf, tempo]::BIGINT[] ORDER BY segment_id)) AS v FROM n GROUP BY 1),
    b AS (SELECT track_id, flatten(list_transform(v, lambda x: list_transform(range(8), lambda i: (x >> (8 * i)::INT) & 255))) AS bytes FROM l)
    SELECT track_id, list_reduce(list_transform(bytes, lambda x: x::HUGEINT), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % {_MOD}, 1469598103934665603::HUGEINT)::DECIMAL(20, 0) AS signature FROM b"""
)
def grid_signature(spark, sf_dir):
    """FNV-1a over segments: what tells whether a generation's grid has changed."""
    c, at = S.corpus_rows(spark, sf_dir).filter(div(F.col("track"), 20) < 12), div(F.col("track"), 20)
    first = at * 900_000
    s = c.select((F.col("track") % 20).alias("track_id"), at.alias("segment_id"), first.alias("first_frame"), (first + 900_000).alias("end_frame"), (first + F.col("track") % 5 * 700).alias("anchor"), F.col("truth").alias("tempo"), "confidence")
    return grid.signatures(grid.with_periods(s, Geometry()))


@query(
    """WITH g AS (SELECT o_custkey AS track_id, o_orderkey AS generation, length(o_orderpriority) AS tempo FROM orders), c AS (SELECT *, coalesce((tempo <> lag(tempo) OVER (PARTITION BY track_id ORDER BY generation))::INT, 1) AS step FROM g)
    SELECT track_id, generation, tempo, sum(step) OVER (PARTITION BY track_id ORDER BY generation ROWS UNBOUNDED PRECEDING)::BIGINT AS candidate_set_id FROM c"""
)
def candidate_set_id(spark, sf_dir):
    return grid.candidate_sets(S.table(spark, sf_dir, "orders").selectExpr("o_custkey as track_id", "o_orderkey as generation", "length(o_orderpriority) as tempo"))


_REL = "CASE WHEN truth = 0 OR reported = 0 OR truth = reported THEN 0 " + " ".join(f"WHEN abs(reported - truth * {n} // {d}) <= truth * {n} // {d} // 50 + 1 THEN {c}" for n, d, c in ((3, 2, 3), (2, 3, 4), (2, 1, 2), (1, 2, 1), (3, 1, 6), (1, 3, 5), (4, 1, 8), (1, 4, 7))) + " ELSE 0 END"
_CLASS = "CASE WHEN reported = 0 THEN 'absent' " + " ".join(
    f"WHEN abs(reported / truth::DOUBLE - {n / d!r}::DOUBLE) <= {(0.01 if c == 'exact' else 0.04) * (n / d)!r}::DOUBLE THEN '{c}'"
    for c, n, d in (("exact", 1, 1), ("half", 1, 2), ("double", 2, 1), ("third", 1, 3), ("triple", 3, 1), ("two_thirds", 2, 3), ("three_half", 3, 2), ("quarter", 1, 4), ("quadruple", 4, 1))
) + " ELSE 'other' END"
_CLASSED = f"{S.with_sql('corpus')}, c AS (SELECT *, {_CLASS} AS relation, floor(abs(reported - truth) * 1000000 / truth)::BIGINT AS error_ppm FROM corpus)"


@query(f"{S.with_sql('corpus')} SELECT track, truth, reported, {_REL} AS relation FROM corpus")
def tempo_relation(spark, sf_dir):
    return S.corpus_rows(spark, sf_dir).select("track", "truth", "reported", relation(F.col("truth"), F.col("reported")).alias("relation"))


@query(f"{_CLASSED} SELECT track, relation, error_ppm FROM c")
def ratio_classify(spark, sf_dir):
    return corpus.classified(S.corpus_rows(spark, sf_dir)).select("track", "relation", "error_ppm")


@query(f"{_CLASSED} SELECT relation, count(*) AS tracks, sum((confidence >= 75)::INT)::BIGINT AS actionable FROM c GROUP BY 1")
def relation_breakdown(spark, sf_dir):
    return corpus.breakdown(S.corpus_rows(spark, sf_dir))


_OCTAVE = "relation NOT IN ('exact', 'absent', 'other')"
_SWEEP = f"""SELECT gate, count(*) FILTER (confidence >= gate) AS admitted, count(*) FILTER (confidence >= gate AND relation = 'exact') AS correct, count(*) FILTER (confidence >= gate AND relation <> 'exact') AS wrong,
    count(*) FILTER (confidence >= gate AND {_OCTAVE}) AS octave_errors, count(*) FILTER (relation = 'exact') AS ok FROM c, (SELECT unnest(range(50, 101, 5))::INT AS gate) GROUP BY 1"""


@query(f"{_CLASSED} SELECT gate, admitted, correct, wrong, octave_errors, CASE WHEN admitted > 0 THEN correct * 1000000 // admitted END AS precision_ppm, CASE WHEN ok > 0 THEN correct * 1000000 // ok END AS recall_ppm FROM ({_SWEEP})")
def threshold_sweep(spark, sf_dir):
    """Gates up to one that nothing passes: its precision is null."""
    return corpus.thresholds(S.corpus_rows(spark, sf_dir), tuple(range(50, 101, 5)))


#: Hits are relations, near hits are within a thousandth and reported; what isn't exact is an octave error or another one.
_SUMMARY = f"""count(*) AS tracks, count(*) FILTER (relation = 'exact') AS within_1pct, count(*) FILTER (reported > 0 AND abs(reported - truth) * 1000 <= truth) AS within_01pct, count(*) FILTER ({_OCTAVE}) AS octave_errors,
    count(*) FILTER (relation IN ('absent', 'other')) AS other_errors, min(confidence) FILTER (relation = 'exact') AS min_confidence_correct, max(confidence) FILTER (relation <> 'exact') AS max_confidence_wrong,
    floor(avg(confidence) FILTER (relation = 'exact') * 1000)::BIGINT AS mean_confidence_correct_e3, floor(avg(confidence) FILTER (relation <> 'exact') * 1000)::BIGINT AS mean_confidence_wrong_e3,
    floor(median(error_ppm) FILTER (relation = 'exact'))::BIGINT AS median_error_ppm, floor(median(0.5::DOUBLE / (abs(reported - truth) / 1000.0::DOUBLE)) FILTER (relation = 'exact' AND reported <> truth) * 1000000 + 0.5)::BIGINT AS median_drift_e6,
    count(*) FILTER (relation <> 'exact' AND confidence >= 75) AS high_confidence_errors, count(*) FILTER ({_OCTAVE} AND confidence >= 75) AS high_confidence_octave_errors"""


@query(f"{_CLASSED} SELECT {_SUMMARY} FROM c")
def corpus_summary(spark, sf_dir):
    return corpus.summary(S.corpus_rows(spark, sf_dir))


@query(
    f"""{_CLASSED}, m AS (SELECT 'all' AS mode, * FROM c UNION ALL SELECT 'lone', * FROM c WHERE track % 5 = 0), s AS (SELECT mode, {_SUMMARY} FROM m GROUP BY 1),
    g AS (SELECT mode, gate, count(*) FILTER (confidence >= gate) AS admitted, count(*) FILTER (confidence >= gate AND relation = 'exact') AS correct FROM m, (SELECT unnest(range(50, 96, 5))::INT AS gate) GROUP BY 1, 2)
    SELECT mode, within_1pct, other_errors, median_drift_e6, (SELECT count(*) FROM g WHERE g.mode = s.mode) AS gates, (SELECT correct FROM g WHERE g.mode = s.mode AND gate = 75) AS correct_75 FROM s"""
)
def corpus_report(spark, sf_dir):
    """A report's JSON, read again."""
    c = S.corpus_rows(spark, sf_dir)
    r = corpus.report({"all": c, "lone": c.filter("track % 5 = 0")})
    get = lambda name: F.get_json_object("summary", f"$.{name}").cast("bigint").alias(name)
    gates = F.from_json("gates", "array<struct<gate:int,correct:bigint>>")
    return r.select("mode", get("within_1pct"), get("other_errors"), get("median_drift_e6"), F.size(gates).cast("bigint").alias("gates"), F.filter(gates, lambda g: g["gate"] == 75)[0]["correct"].alias("correct_75"))


@query(f"{_CLASSED} SELECT stratum, count(*) AS tracks, sum((relation = 'exact')::INT)::BIGINT AS correct FROM c GROUP BY ROLLUP (stratum)")
def population_rollup(spark, sf_dir):
    return corpus.populations(S.corpus_rows(spark, sf_dir), "stratum")


_OTHER = _CLASS.replace("reported", "other")


@query(
    f"""{S.with_sql("corpus")}, o AS (SELECT *, CASE WHEN track % 4 = 0 THEN truth WHEN track % 9 = 0 THEN truth * 2 ELSE reported END AS other FROM corpus),
    c AS (SELECT *, {_CLASS} = 'exact' AS a, {_OTHER} = 'exact' AS b FROM o)
    SELECT sum((NOT a AND b)::INT)::BIGINT AS fixed, sum((a AND NOT b)::INT)::BIGINT AS broken, sum((reported <> other)::INT)::BIGINT AS changed, sum((reported = other)::INT)::BIGINT AS unchanged, (sum((NOT a AND b)::INT) - sum((a AND NOT b)::INT))::BIGINT AS net FROM c"""
)
def fixed_broken(spark, sf_dir):
    a = S.corpus_rows(spark, sf_dir)
    other = F.when(F.col("track") % 4 == 0, F.col("truth")).when(F.col("track") % 9 == 0, F.col("truth") * 2).otherwise(F.col("reported"))
    return corpus.compared(a, a.withColumn("reported", other))


@query(
    f"""{S.with_sql("corpus")}, o AS (SELECT *, CASE WHEN track % 4 = 0 THEN truth WHEN track % 9 = 0 THEN truth * 2 ELSE reported END AS other FROM corpus), c AS (SELECT track, confidence, {_CLASS} AS a, {_OTHER} AS b FROM o)
    SELECT track, CASE WHEN a NOT IN ('exact', 'absent', 'other') AND confidence >= 75 THEN 's4-high-confidence-octave' WHEN a = 'exact' AND b <> 'exact' THEN 'endorsement-broken' WHEN a <> 'exact' AND b = 'exact' THEN 'endorsement-fixed'
    WHEN a = 'exact' THEN 's4-exact-unchanged' WHEN a NOT IN ('absent', 'other') THEN 's4-octave-unresolved' ELSE 's4-other-unresolved' END AS stratum FROM c"""
)
def outcome_strata(spark, sf_dir):
    a = S.corpus_rows(spark, sf_dir)
    other = F.when(F.col("track") % 4 == 0, F.col("truth")).when(F.col("track") % 9 == 0, F.col("truth") * 2).otherwise(F.col("reported"))
    return corpus.strata(a, a.withColumn("reported", other))


#: A share of n tracks is n / 4 and a half, rounded down, but one and all but one at the ends, and none of a lone track.
@query(
    f"""{S.with_sql("corpus")}, c AS (SELECT track, CASE WHEN track % 500 = 0 THEN 'lone ' || track ELSE stratum END AS stratum FROM corpus),
    k AS (SELECT track, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('split' || chr(0) || track::VARCHAR), track) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM c)
    SELECT track, stratum, CASE WHEN n >= 2 AND r <= least(greatest(floor(n * 0.25 + 0.5), 1), n - 1) THEN 'holdout' ELSE 'development' END AS fold FROM k"""
)
def stratified_split(spark, sf_dir):
    lone = F.when(F.col("track") % 500 == 0, F.concat(F.lit("lone "), F.col("track").cast("string"))).otherwise(F.col("stratum"))
    return corpus.split(S.corpus_rows(spark, sf_dir).withColumn("stratum", lone), "split")


@query(
    """WITH b AS (SELECT l_suppkey AS track, 60000 + l_quantity::BIGINT % 7 * 1000 AS tempo FROM lineitem), e AS (SELECT track, tempo, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT track, arg_min(tempo, (-n, tempo)) AS modal, count(*) AS "distinct", max(n) * 1000000 // sum(n)::BIGINT AS share_ppm FROM e GROUP BY 1"""
)
def modal_tempo(spark, sf_dir):
    b = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), (F.lit(60_000) + F.col("l_quantity").cast("bigint") % 7 * 1000).alias("tempo"))
    return corpus.modal_tempo(b)


@query("SELECT p_partkey AS track, 'rbx-' || substr(sha256(lower(p_name)), 1, 16) AS id FROM part")
def opaque_track_id(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), corpus.opaque_id(F.col("p_name")).alias("id"))


@query(f"{S.with_sql('corpus')} SELECT track, floor(0.5::DOUBLE / (abs(reported - truth) / 1000.0::DOUBLE) * 1000000 + 0.5)::BIGINT AS minutes_e6 FROM corpus WHERE reported <> truth")
def drift_minutes(spark, sf_dir):
    m = corpus.minutes_to_half_beat((F.col("reported") - F.col("truth")) / 1000.0)
    return S.corpus_rows(spark, sf_dir).filter("reported <> truth").select("track", F.floor(m * 1e6 + 0.5).cast("bigint").alias("minutes_e6"))


@query(f"{S.with_sql('corpus')} SELECT track::VARCHAR || ',' || stratum || ',' || truth::VARCHAR || ',' || reported::VARCHAR || ';' || (reported * 2)::VARCHAR AS line FROM corpus")
def corpus_csv(spark, sf_dir):
    c = S.corpus_rows(spark, sf_dir).select("track", "stratum", "truth", F.array(F.col("reported"), F.col("reported") * 2).alias("candidates"))
    return corpus.csv_line(c, "candidates")


#: The recurrence by columns: each column's own sum of decayed samples, the state carried from column to column, then every frame of a column.
_POLES = "(1.0::DOUBLE - exp(-2.0::DOUBLE * pi() * {0} / 44100.0::DOUBLE))"
_BANDS = f"""{S.with_sql("sig_v").replace("WITH", "WITH RECURSIVE", 1)}, k AS (SELECT {_POLES.format(200.0)} AS a, {_POLES.format(2000.0)} AS b), c AS (SELECT track_id, frame // 64 AS col, frame % 64 AS j, x, a, b FROM sig_v, k),
    own AS (SELECT track_id, col, sum(a * power(1 - a, 63 - j) * x) AS sa, sum(b * power(1 - b, 63 - j) * x) AS sb, any_value(a) AS a, any_value(b) AS b FROM c GROUP BY 1, 2),
    st AS (SELECT DISTINCT track_id, 0::BIGINT AS col, 0.0::DOUBLE AS ya, 0.0::DOUBLE AS yb FROM c UNION ALL SELECT st.track_id, st.col + 1, power(1 - a, 64) * ya + sa, power(1 - b, 64) * yb + sb FROM st JOIN own ON own.track_id = st.track_id AND own.col = st.col),
    y AS (SELECT c.track_id, c.col, c.j, any_value(c.x) AS x, any_value(power(1 - c.a, c.j + 1) * ya) + sum(c.a * power(1 - c.a, c.j - d.j) * d.x) AS ya, any_value(power(1 - c.b, c.j + 1) * yb) + sum(c.b * power(1 - c.b, c.j - d.j) * d.x) AS yb
      FROM c JOIN c d ON d.track_id = c.track_id AND d.col = c.col AND d.j <= c.j JOIN st ON st.track_id = c.track_id AND st.col = c.col GROUP BY 1, 2, 3),
    s AS (SELECT track_id, col, count(*) AS n, {", ".join(f"sum(floor(least(abs({e}), 1.0::DOUBLE) * 32768.0::DOUBLE)::BIGINT)::BIGINT AS {t}" for e, t in (("ya", "l"), ("yb - ya", "m"), ("x - yb", "h")))} FROM y GROUP BY 1, 2),
    bands AS (SELECT track_id, col AS column_index, {", ".join(f"least(255, {t} * 255 // (n * 32768))::INT AS {name}" for t, name in (("l", "low"), ("m", "mid"), ("h", "high")))}, n AS sample_count FROM s)"""


@query(f"{_BANDS} SELECT * FROM bands")
def band_energy(spark, sf_dir):
    return bands.band_columns(S.vector_samples(spark, sf_dir), 64, 44_100)


@query(
    f"""{_BANDS}, e AS (SELECT track_id, frame // 64 AS bin, sum(floor(least(abs(x), 1.0::DOUBLE) * 32768.0::DOUBLE)::BIGINT)::BIGINT / (count(*) * 32768.0::DOUBLE) AS e FROM sig_v GROUP BY 1, 2 HAVING count(*) = 64),
    r AS (SELECT e.track_id, bin, greatest(0.0::DOUBLE, e - lag(e, 1, 0.0::DOUBLE) OVER w) AS broad, {" + ".join(f"greatest(0.0::DOUBLE, ({c} - lag({c}, 1, 0) OVER w) / 255.0::DOUBLE)" for c in ("low", "mid", "high"))} AS more
      FROM e JOIN bands ON bands.track_id = e.track_id AND column_index = bin WINDOW w AS (PARTITION BY e.track_id ORDER BY bin))
    SELECT track_id, bin, floor(CASE WHEN broad > 0 THEN broad + 0.25 * more ELSE 0 END * 1000000000 + 0.5)::BIGINT AS flux_e9 FROM r"""
)
def multiband_flux(spark, sf_dir):
    return bands.multiband_flux(S.vector_samples(spark, sf_dir), 64, 44_100).select("track_id", "bin", F.floor(F.col("flux") * 1e9 + 0.5).cast("bigint").alias("flux_e9"))
