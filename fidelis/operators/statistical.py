"""Checks of values: stored and recomputed statistics, dimension by dimension."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fidelis.operators.base import Check, finite, found, once

# Ranges of the integer types that are narrow enough to check.
DTYPE_RANGES = {"bool": (0, 1), "uint8": (0, 255), "u8": (0, 255), "int8": (-128, 127), "i8": (-128, 127), "uint16": (0, 65535), "u16": (0, 65535), "int16": (-32768, 32767), "i16": (-32768, 32767), "uint32": (0, 4294967295), "u32": (0, 4294967295), "int32": (-2147483648, 2147483647), "i32": (-2147483648, 2147483647)}


def dimension_stats(values, key: tuple[str, ...], array: str):
    """Per dimension of an array column: n, min, max, mean, std (population), at_min, at_max, non_finite.

    One pass for the moments (mergeable, so partially aggregated before the shuffle) and one for how often the ends
    are met, joined on (key, dim): both sides have one row for each key and dimension.
    """
    x = values.select(*key, F.posexplode(array).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    ok = finite(F.col("v"))
    v = F.when(ok, F.col("v"))
    s = x.groupBy(*key, "dim").agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sum((F.col("v").isNotNull() & ~ok).cast("long")).alias("non_finite"))
    ends = x.join(s.select(*key, "dim", "min", "max"), [*key, "dim"]).where(finite(F.col("v"))).groupBy(*key, "dim").agg(F.sum((F.col("v") == F.col("min")).cast("long")).alias("at_min"), F.sum((F.col("v") == F.col("max")).cast("long")).alias("at_max"))
    return s.join(ends, [*key, "dim"], "left").fillna(0, ["at_min", "at_max"])


def worst_saturation(stats, key: tuple[str, ...]):
    """Of each key, the dimension that meets its ends most; constant ones don't count, and the last wins a tie; else dimension 0."""
    frac = F.greatest("at_min", "at_max") / F.col("n")
    varies = (F.col("n") > 0) & (F.col("min") < F.col("max"))
    row = F.struct("dim", "n", "at_min", "at_max", "min", "max")
    g = stats.groupBy(*key).agg(F.max_by(F.when(varies, row), F.when(varies, F.struct(frac, "dim"))).alias("w"), F.max(F.when(F.col("dim") == 0, row)).alias("zero"))
    return g.select(*key, F.coalesce("w", "zero").alias("w")).select(*key, "w.*")


def _summaries(rec, scalar: str, dims: str):
    """One row for each summary of each stream: dim is -1 for the scalar one."""
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    one = F.array(F.when(F.col(scalar).isNotNull(), F.struct(F.lit(-1).cast("long").alias("dim"), *(F.col(scalar)[k].alias(k) for k in ("min", "max", "mean", "std")))))
    rows = F.concat(F.array_compact(one), F.coalesce(dims, F.array().cast(s.schema[dims].dataType)))
    return s.withColumn("x", F.explode(rows)).select("ep_ord", "st_ord", "episode", "name", "dtype", "x.*")


def value_measurability(rec, tol):
    s = rec.streams
    stored, seen = F.col("stats").isNotNull(), F.col("observed_stats").isNotNull()
    a = s.where(~stored & ~seen).agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 0")
    b = s.where(~stored & seen).agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 0")
    shown = F.array_join(F.slice("names", 1, 4), ",")
    return found(a, "UNMEASURED_VALUES", "info", nums=[F.size("names")], texts=[shown]).union(found(b, "NO_STORED_STATS", "info", nums=[F.size("names")], texts=[shown]))


def tolerance(lo, hi):
    """How far rounding may put a bound off: relative to the larger end, and never over four ranges."""
    t = 1e-9 + F.greatest(F.abs(lo), F.abs(hi)) * 1e-6
    return F.when(hi > lo, F.least(t, 4 * (hi - lo))).otherwise(t)


def range_sanity(rec, tol):
    lo, hi, mean, std = (F.col(c) for c in ("min", "max", "mean", "std"))
    t = tolerance(lo, hi)
    ranges = F.create_map(*(x for k, (a, b) in DTYPE_RANGES.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))))
    r = F.try_element_at(ranges, F.lower("dtype"))
    rule = (
        F.when(~(finite(lo) & finite(hi) & finite(mean) & finite(std)), F.lit(0))
        .when(lo > hi, F.lit(1)).when(std < 0, F.lit(2)).when((mean < lo - t) | (mean > hi + t), F.lit(3))
        .when(std > (hi - lo) / 2 + t, F.lit(4)).when((lo < r["a"]) | (hi > r["b"]), F.lit(5))
        .when((std == 0) & (lo == hi), F.lit(6))
    )
    codes = ("NON_FINITE", "RANGE_INVERTED", "NEGATIVE_STD", "MEAN_OUT_OF_RANGE", "STD_IMPLAUSIBLE", "DTYPE_RANGE", "DEGENERATE")
    x = _summaries(rec, "stats", "dim_stats").withColumn("rule", rule).where("rule IS NOT NULL")
    # The most severe of a stream's summaries, the first among equals.
    x = x.groupBy("ep_ord", "st_ord", "episode", "name").agg(F.min_by(F.struct("rule", "dim", "min", "max", "mean", "std"), F.struct(F.when(F.col("rule") == 6, 1).otherwise(0), "dim")).alias("x")).select("ep_ord", "st_ord", "episode", "name", "x.*")
    code = F.element_at(F.array(*map(F.lit, codes)), F.col("rule") + 1)
    x = once(x, "name", "rule", "dim", "min", "max", "mean", "std")
    return found(x, code, F.when(F.col("rule") == 6, "warning").otherwise("error"), "stream", "episode", "name", nums=["dim", "min", "max", "mean", "std"])


def stored_vs_observed(rec, tol):
    """Observed values outside the stored bounds: by dimension where both have dimensions, else the scalars."""
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(-1).cast("long").alias("dim"), *(F.col(c)[k].alias(k) for k in ("min", "max", "mean", "std")))))
    both = F.col("dim_stats").isNotNull() & F.col("observed_dim_stats").isNotNull()
    key = ["ep_ord", "st_ord", "episode", "name"]
    pick = lambda dims, scalar: F.explode(F.when(both, F.col(dims)).otherwise(one(scalar)))
    a = s.select(*key, pick("dim_stats", "stats").alias("x")).select(*key, "x.dim", F.col("x.min").alias("lo"), F.col("x.max").alias("hi"))
    b = s.select("ep_ord", "st_ord", pick("observed_dim_stats", "observed_stats").alias("y")).select("ep_ord", "st_ord", "y.dim", F.col("y.min").alias("seen_lo"), F.col("y.max").alias("seen_hi"))
    lo, hi = F.col("lo"), F.col("hi")
    slack = lambda x: 1e-6 * F.greatest(F.abs(x), F.lit(1.0))
    stale = finite(lo) & finite(hi) & ((F.col("seen_lo") < lo - slack(lo)) | (F.col("seen_hi") > hi + slack(hi)))
    x = a.join(b, ["ep_ord", "st_ord", "dim"]).where(stale)
    x = x.groupBy(*key).agg(F.min_by(F.struct("dim", "lo", "hi", "seen_lo", "seen_hi"), "dim").alias("x")).select(*key, "x.*")
    return found(once(x, "name", "dim", "lo", "hi", "seen_lo", "seen_hi"), "STATS_STALE", "error", "stream", "episode", "name", nums=["dim", "lo", "hi", "seen_lo", "seen_hi"])


def saturation(rec, tol):
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").select("ep_ord", "st_ord", "episode", "name", "observed_saturation.*")
    frac = F.greatest("at_min", "at_max") / F.when(F.col("n") > 0, F.col("n"))
    ok = (F.col("n") >= tol.saturation_min_samples) & finite(F.col("min")) & finite(F.col("max")) & (F.col("min") != F.col("max"))
    at_max = F.col("at_max") >= F.col("at_min")
    x = s.where(ok & (frac >= tol.saturation_fraction)).withColumn("frac", frac).withColumn("end", F.when(at_max, "maximum").otherwise("minimum")).withColumn("value", F.when(at_max, F.col("max")).otherwise(F.col("min")))
    return found(once(x, "name", "n", "frac", "end", "value", "dim"), "SATURATED", "warning", "stream", "episode", "name", nums=["dim", "frac", "value", "n"], texts=["end"])


def extreme_outlier(rec, tol):
    """Of the best summaries a stream has (observed dimensions, stored ones, then scalars), the most extreme end in standard deviations."""
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(-1).cast("long").alias("dim"), *(F.col(c)[k].alias(k) for k in ("min", "max", "mean", "std")))))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    x = s.withColumn("x", F.explode(F.coalesce(some("observed_dim_stats"), some("dim_stats"), one("observed_stats"), one("stats")))).select("ep_ord", "st_ord", "episode", "name", "x.*")
    lo, hi, mean, std = (F.col(c) for c in ("min", "max", "mean", "std"))
    ok = finite(lo) & finite(hi) & finite(mean) & finite(std) & (std > 0) & (lo <= mean) & (mean <= hi)
    sd = F.when(std > 0, std)
    # The end is told by the distances themselves: different ones can be the same number of deviations once rounded.
    x = x.where(ok).withColumn("up", hi - mean).withColumn("down", mean - lo).withColumn("z", F.greatest(F.col("up") / sd, F.col("down") / sd))
    x = x.groupBy("ep_ord", "st_ord", "episode", "name").agg(F.max_by(F.struct("dim", "z", "up", "down", "min", "max"), F.struct("z", "dim")).alias("x")).select("ep_ord", "st_ord", "episode", "name", "x.*").where(F.col("z") >= tol.outlier_z)
    high = F.col("up") >= F.col("down")
    x = x.withColumn("end", F.when(high, "maximum").otherwise("minimum")).withColumn("value", F.when(high, F.col("max")).otherwise(F.col("min")))
    return found(once(x, "name", "dim", "z", "value"), "OUTLIER", "warning", "stream", "episode", "name", nums=["dim", "z", "value"], texts=["end"])


def non_finite_observed(rec, tol):
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").where("observed_non_finite > 0")
    return found(once(s, "name", "observed_non_finite"), "NON_FINITE_OBSERVED", "error", "stream", "episode", "name", nums=["observed_non_finite"])


CHECKS = (
    Check("statistical.value-measurability", "Values without statistics", {"UNMEASURED_VALUES": "info", "NO_STORED_STATS": "info"}, value_measurability),
    Check("statistical.range-sanity", "Impossible statistics", {"NON_FINITE": "error", "RANGE_INVERTED": "error", "NEGATIVE_STD": "error", "MEAN_OUT_OF_RANGE": "error", "STD_IMPLAUSIBLE": "error", "DTYPE_RANGE": "error", "DEGENERATE": "warning"}, range_sanity),
    Check("statistical.stored-vs-observed", "Stale statistics", {"STATS_STALE": "error"}, stored_vs_observed),
    Check("statistical.saturation", "Values at their ends", {"SATURATED": "warning"}, saturation),
    Check("statistical.extreme-outlier", "Extreme values", {"OUTLIER": "warning"}, extreme_outlier),
    Check("statistical.non-finite-observed", "Values that are not finite", {"NON_FINITE_OBSERVED": "error"}, non_finite_observed),
)
