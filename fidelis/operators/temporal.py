"""Checks of time: order, rates, gaps, jitter and how the clocks of an episode agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fidelis.operators.base import Check, finite, found, intervals, is_rig, minus, once, profile, recorded, representatives


def _timed():
    """Whether a stream's clock measures time; a count of steps passes every check of time by itself."""
    return F.col("clock_kind") == "measured"


def _measured(rec):
    return representatives(profile(rec)).where(_timed())


def clock_measurability(rec, tol):
    s = rec.streams.where("clock_kind = 'step-index'").groupBy("clock_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return found(s, "UNMEASURED_CLOCK", "info", nums=[F.size("names")], texts=["clock_id", F.array_join(F.slice("names", 1, 4), ",")])


def monotonicity(rec, tol):
    bad = intervals(rec).withColumn("i", F.row_number().over(recorded()) - 1).where("d <= 0").groupBy("ep_ord", "st_ord").agg(F.min("i").alias("i"))
    r = _measured(rec).join(bad, ["ep_ord", "st_ord"])
    return found(r, "NON_MONOTONIC", "error", "frame-range", "episode", "name", F.col("i") - 1, "i", nums=["twins"])


def rate_validity(rec, tol):
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").where("declared_rate_hz IS NOT NULL")
    rate = F.col("declared_rate_hz")
    return found(s.where(~(finite(rate) & (rate > 0))), "INVALID_RATE", "error", "stream", "episode", "name", nums=[rate])


def rate_conformance(rec, tol):
    rate = F.col("declared_rate_hz")
    p = profile(rec).where(_timed() & (F.col("n") >= 2) & (F.col("span") > 0) & finite(rate) & (rate > 0))
    p = p.withColumn("observed", (F.col("n") - 1) / (F.col("span") / 1e9))
    return found(p.where(F.abs(F.col("observed") - rate) / rate > tol.rate_deviation), "RATE", "warning", "stream", "episode", "name", nums=["observed", rate])


def gaps(rec, tol):
    rate = F.col("declared_rate_hz")
    period = F.when(finite(rate) & (rate > 0), 1e9 / F.when(rate > 0, rate))
    upper = F.col("upper").cast("double")
    near = (period <= tol.gap_factor * upper) & (upper <= tol.gap_factor * period)
    r = _measured(rec).where("upper > 0").withColumn("expected", F.when(near, period).otherwise(upper)).select("ep_ord", "st_ord", "episode", "name", "expected", "twins")
    d = intervals(rec).where("d > 0").join(r, ["ep_ord", "st_ord"])
    return found(d.where(F.col("d") > tol.gap_factor * F.col("expected")), "GAP", "warning", "time-range", "episode", "name", "prev", "ts", nums=["d", "expected", "twins"])


def jitter(rec, tol):
    r = _measured(rec).where((F.col("n_iv") >= 8) & (F.col("n_pos") == F.col("n_iv")) & (F.col("cv") > tol.jitter_cv))
    return found(r, "JITTER", "warning", "stream", "episode", "name", nums=["cv", "twins"])


def clock_skew(rec, tol):
    """Pairs of streams of one episode: a theta join on spans within the episode."""
    p = profile(rec).where(_timed() & (F.col("span") > 0)).join(is_rig(rec), "ep_ord", "left_anti").select("ep_ord", "episode", "st_ord", "name", "span", "period")
    a, b = p.alias("a"), p.select(*(F.col(c).alias(f"{c}_b") for c in ("ep_ord", "st_ord", "name", "span", "period"))).alias("b")
    drift = F.abs(minus(F.col("span"), F.col("span_b")))
    pairs = a.join(b, (F.col("ep_ord") == F.col("ep_ord_b")) & (F.col("st_ord") < F.col("st_ord_b")) & (drift > tol.clock_skew_ns + F.greatest("period", "period_b")))
    return found(pairs, "CLOCK_SKEW", "error", "episode", "episode", nums=[drift], texts=["name", "name_b"])


def _offset(rec, edge, code, bound):
    p = profile(rec).where(_timed() & (F.col("n") > 0))
    at = F.struct(edge, "st_ord")
    g = p.groupBy("ep_ord", "episode", "clock_id").agg(
        F.count("*").alias("k"), F.min(edge).alias("early"), F.max(edge).alias("late"), F.min_by("name", at).alias("first"), F.max_by("name", at).alias("last"), F.min_by("period", at).alias("p1"), F.max_by("period", at).alias("p2")
    )
    off = minus(F.col("late"), F.col("early"))
    g = g.where("k >= 2").where(off > bound + F.greatest("p1", "p2"))
    return found(g, code, "warning", "episode", "episode", nums=[off], texts=["clock_id", "first", "last"])


def start_offset(rec, tol):
    return _offset(rec, "lo", "START_OFFSET", tol.start_offset_ns)


def end_offset(rec, tol):
    return _offset(rec, "hi", "END_OFFSET", tol.end_offset_ns)


def rate_consistency(rec, tol):
    rate = F.col("declared_rate_hz")
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").where(finite(rate) & (rate > 0))
    w = Window.partitionBy("name").orderBy("ep_ord", "st_ord")
    s = s.withColumn("base", F.first("declared_rate_hz").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found(once(s.where(F.abs(rate - F.col("base")) > 0.01 * F.col("base")), "name"), "RATE_INCONSISTENT", "warning", "stream", "episode", "name", nums=[rate, "base"])


def durations(rec):
    """ep_ord, episode and duration of the episodes that have one: declared, or else the longest measured stream."""
    span = profile(rec).where(_timed() & (F.col("span") > 0)).groupBy("ep_ord").agg(F.max("span").alias("span"))
    declared = minus(F.col("end_ts"), F.col("start_ts"))
    e = rec.episodes.join(span, "ep_ord", "left").withColumn("duration", F.when(F.col("end_ts") > F.col("start_ts"), declared).otherwise(F.col("span")))
    return e.where("duration IS NOT NULL").select("ep_ord", "episode", "duration")


def episode_duration(rec, tol):
    d = durations(rec)
    m = d.agg(F.count("*").alias("k"), F.percentile("duration", 0.5).alias("mid")).where("k >= 4")  # one row
    f = tol.episode_duration_factor
    r = d.crossJoin(F.broadcast(m)).where((F.lit(f) > 1) & ((F.col("duration") < F.col("mid") / f) | (F.col("duration") > F.col("mid") * f)))
    return found(r, "EPISODE_DURATION_OUTLIER", "warning", "episode", "episode", nums=["duration", "mid"])


CHECKS = (
    Check("temporal.clock-measurability", "Clocks that only count steps", {"UNMEASURED_CLOCK": "info"}, clock_measurability),
    Check("temporal.monotonicity", "Times that do not rise", {"NON_MONOTONIC": "error"}, monotonicity),
    Check("temporal.rate-validity", "Declared rates that are no rates", {"INVALID_RATE": "error"}, rate_validity),
    Check("temporal.rate-conformance", "Rates that differ from the declared", {"RATE": "warning"}, rate_conformance),
    Check("temporal.gap", "Gaps in a stream", {"GAP": "warning"}, gaps),
    Check("temporal.jitter", "Uneven steps", {"JITTER": "warning"}, jitter),
    Check("temporal.clock-skew", "Streams of different length", {"CLOCK_SKEW": "error"}, clock_skew),
    Check("temporal.start-offset", "Streams that start apart", {"START_OFFSET": "warning"}, start_offset),
    Check("temporal.end-offset", "Streams that end apart", {"END_OFFSET": "warning"}, end_offset),
    Check("temporal.rate-consistency", "Declared rates that change", {"RATE_INCONSISTENT": "warning"}, rate_consistency),
    Check("temporal.episode-duration", "Episodes of odd length", {"EPISODE_DURATION_OUTLIER": "warning"}, episode_duration),
)
