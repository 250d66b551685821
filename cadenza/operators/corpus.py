"""Accuracy analytics over annotated corpora: (track, stratum, truth, reported, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tempo import ratio_class

ACTIONABLE = 75
OCTAVES = ("half", "double", "third", "triple", "two_thirds", "three_half", "quarter", "quadruple")


def classified(rows: DataFrame) -> DataFrame:
    """With ``relation``, ``octave_error``, and ``error_ppm``, the distance from the truth in millionths."""
    error = F.floor(F.abs(F.col("reported") - F.col("truth")) * 1_000_000 / F.col("truth")).cast("bigint")
    relation = ratio_class(F.col("reported"), F.col("truth"))
    return rows.select("*", relation.alias("relation"), relation.isin(*OCTAVES).alias("octave_error"), error.alias("error_ppm"))


def breakdown(rows: DataFrame) -> DataFrame:
    return classified(rows).groupBy("relation").agg(F.count("*").alias("tracks"), F.sum((F.col("confidence") >= ACTIONABLE).cast("int")).alias("actionable"))


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def thresholds(rows: DataFrame, gates: tuple[int, ...] = (50, 55, 60, 65, 70, 75, 80, 85, 90, 95)) -> DataFrame:
    """(gate, admitted, correct, wrong, octave_errors, precision_ppm, recall_ppm): the rows go once through a fixed list of gates.  A share of nothing is null."""
    c = classified(rows).select("confidence", (F.col("relation") == "exact").alias("ok"), "octave_error")
    each = c.groupBy("confidence", "ok", "octave_error").agg(F.count("*").alias("n"))
    wide = each.select("*", F.explode(F.array(*[F.lit(g) for g in gates])).alias("gate"))
    inside = F.col("confidence") >= F.col("gate")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    out = wide.groupBy("gate").agg(
        total(inside).alias("admitted"), total(inside & F.col("ok")).alias("correct"), total(inside & ~F.col("ok")).alias("wrong"), total(inside & F.col("octave_error")).alias("octave_errors"), total(F.col("ok")).alias("all_correct")
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1_000_000 / F.col(b)).cast("bigint"))
    return out.select("gate", "admitted", "correct", "wrong", "octave_errors", share("correct", "admitted").alias("precision_ppm"), share("correct", "all_correct").alias("recall_ppm"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of ``by``, with counts, confidences, and medians over the correct tracks.

    Correct is the relation ``exact``; what isn't is an octave error or another one.  Medians are of ppm of the truth, and
    of microminutes until the two grids are half a beat apart, over tracks that aren't exactly right.
    """
    c = classified(rows)
    ok, sure, exact_error = F.col("relation") == "exact", F.col("confidence") >= ACTIONABLE, F.abs(F.col("reported") - F.col("truth"))
    thousandth = lambda x: F.floor(x * 1000).cast("bigint")
    drift = minutes_to_half_beat((F.col("reported") - F.col("truth")) / 1000.0)
    return c.groupBy(*by).agg(
        F.count("*").alias("tracks"), _count(ok).alias("within_1pct"), _count((F.col("reported") > 0) & (exact_error * 1000 <= F.col("truth"))).alias("within_01pct"),
        _count(F.col("octave_error")).alias("octave_errors"), _count(~ok & ~F.col("octave_error")).alias("other_errors"),
        F.min(F.when(ok, F.col("confidence"))).alias("min_confidence_correct"), F.max(F.when(~ok, F.col("confidence"))).alias("max_confidence_wrong"),
        thousandth(F.avg(F.when(ok, F.col("confidence")))).alias("mean_confidence_correct_e3"), thousandth(F.avg(F.when(~ok, F.col("confidence")))).alias("mean_confidence_wrong_e3"),
        F.floor(F.median(F.when(ok, F.col("error_ppm")))).cast("bigint").alias("median_error_ppm"), F.floor(F.median(F.when(ok, drift)) * 1_000_000 + 0.5).cast("bigint").alias("median_drift_e6"),
        _count(~ok & sure).alias("high_confidence_errors"), _count(F.col("octave_error") & sure).alias("high_confidence_octave_errors"),
    )


def report(modes: dict[str, DataFrame]) -> DataFrame:
    """(mode, summary, gates): for each named result its summary and its threshold sweep as JSON, null figures kept."""
    keep = {"ignoreNullFields": "false"}
    out = None
    for name, rows in modes.items():
        s, t = summary(rows), thresholds(rows)
        sweep = t.agg(F.array_sort(F.collect_list(F.struct(*t.columns))).alias("gates"))
        one = s.select(F.to_json(F.struct(*s.columns), keep).alias("summary")).join(sweep).select(F.lit(name).alias("mode"), "summary", F.to_json("gates", keep).alias("gates"))
        out = one if out is None else out.unionByName(one)
    return out


def populations(rows: DataFrame, population: str) -> DataFrame:
    """Counts by population and over all of them (null)."""
    return classified(rows).rollup(population).agg(F.count("*").alias("tracks"), F.sum((F.col("relation") == "exact").cast("int")).alias("correct"))


def paired(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each track with ``columns`` of both results, ``a_`` and ``b_`` before their names; a track that a result lacks or holds twice ends the query with an error."""

    def once(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("track").agg(F.count("*").alias(f"__{side}"), F.first(F.struct(*columns)).alias(side))

    both = once(left, "a").join(once(right, "b"), "track", "full")
    fault = lambda what: F.raise_error(F.concat(F.lit(f"{what} track "), F.col("track").cast("string")))
    check = F.when((F.col("__a") > 1) | (F.col("__b") > 1), fault("duplicate")).when(F.col("__a").isNull() | F.col("__b").isNull(), fault("unmatched"))
    return both.filter(check.cast("string").isNull()).select("track", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in columns))


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(fixed, broken, changed, unchanged, net) of two results of the same tracks."""
    both = paired(classified(baseline), classified(candidate), ["reported", "relation"])
    a, b, same = F.col("a_relation") == "exact", F.col("b_relation") == "exact", F.col("a_reported") == F.col("b_reported")
    out = both.agg(_count(~a & b).alias("fixed"), _count(a & ~b).alias("broken"), _count(~same).alias("changed"), _count(same).alias("unchanged"))
    return out.withColumn("net", F.col("fixed") - F.col("broken"))


def strata(baseline: DataFrame, endorsed: DataFrame) -> DataFrame:
    """(track, stratum): what became of each track of a baseline once estimates were endorsed."""
    both = paired(classified(baseline), classified(endorsed), ["relation", "octave_error", "confidence"])
    before, after = F.col("a_relation") == "exact", F.col("b_relation") == "exact"
    kind = F.when(F.col("a_octave_error") & (F.col("a_confidence") >= ACTIONABLE), "s4-high-confidence-octave").when(before & ~after, "endorsement-broken").when(~before & after, "endorsement-fixed")
    kind = kind.when(before, "s4-exact-unchanged").when(F.col("a_octave_error"), "s4-octave-unresolved").otherwise("s4-other-unresolved")
    return both.select("track", kind.alias("stratum"))


def split(rows: DataFrame, seed: str, num: int = 1, den: int = 4) -> DataFrame:
    """(track, stratum, fold): a fixed share of each stratum, by hash order, is held out; both folds get a track at least where there are two, and a lone one is for development.

    Tracks are ranked inside 256 parts of a stratum by the first byte of their hash; the parts' sizes make up for the rest.
    """
    ordered = rows.select("track", "stratum", F.sha2(F.concat_ws(chr(0), F.lit(seed), F.col("track").cast("string")), 256).alias("key")).withColumn("part", F.substring("key", 1, 2))
    parts = ordered.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    whole = W.partitionBy("stratum")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("stratum", "part", before.alias("before"), F.sum("n").over(whole).alias("n"))
    inside = F.row_number().over(W.partitionBy("stratum", "part").orderBy("key", "track"))
    share = F.floor((F.col("n") * num * 2 + den) / (2 * den)).cast("bigint")
    take = F.when(F.col("n") < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("n") - 1, share)))
    ranked = ordered.withColumn("rank", inside).join(parts, ["stratum", "part"])
    return ranked.select("track", "stratum", F.when(F.col("before") + F.col("rank") <= take, "holdout").otherwise("development").alias("fold"))


def modal_tempo(beats: DataFrame) -> DataFrame:
    """(track, modal, distinct, share_ppm): the most frequent tempo of each track's beats, of equal ones the least."""
    each = beats.groupBy("track", "tempo").agg(F.count("*").alias("n"))
    best = each.groupBy("track").agg(F.max(F.struct("n", (-F.col("tempo")).alias("t"))).alias("b"), F.count("*").alias("distinct"), F.sum("n").alias("all"))
    return best.select("track", (-F.col("b.t")).alias("modal"), "distinct", F.floor(F.col("b.n") * 1_000_000 / F.col("all")).cast("bigint").alias("share_ppm"))


def opaque_id(path):
    return F.concat(F.lit("rbx-"), F.substring(F.sha2(F.lower(path), 256), 1, 16))


def minutes_to_half_beat(error_bpm):
    """Minutes until two grids that far apart in tempo drift by half a beat."""
    return F.when(error_bpm != 0, F.lit(0.5) / F.abs(error_bpm))


def csv_line(rows: DataFrame, candidates: str) -> DataFrame:
    """One text row for each track; the list ``candidates`` joined by semicolons."""
    return rows.select(F.concat_ws(",", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ";") if c == candidates else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))
