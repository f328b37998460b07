"""Findings, checks and the profile of streams that many checks read."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.model import Recording, Tolerances

SEVERITIES = ("info", "warning", "error")
RANKS = {"dataset": 0, "episode": 1, "stream": 2, "frame-range": 3, "time-range": 4}
FINDING = "check_id string, category string, severity string, code string, loc_kind string, loc_rank int, episode decimal(20,0), stream string, a long, b long, nums array<double>, texts array<string>"


@dataclass(frozen=True)
class Check:
    """One query of the catalog. ``codes`` maps each code it can emit to its severity."""

    id: str
    title: str
    codes: dict[str, str]
    build: Callable[[Recording, Tolerances], DataFrame]
    version: str = "1"

    @property
    def category(self) -> str:
        return self.id.split(".")[0]

    @property
    def severity(self) -> str:
        return max(self.codes.values(), key=SEVERITIES.index)

    def run(self, rec: Recording, tol: Tolerances | None = None) -> DataFrame:
        return self.build(rec, tol or Tolerances()).select(F.lit(self.id).alias("check_id"), F.lit(self.category).alias("category"), *(F.col(c) for c in ("severity", "code", "loc_kind", "loc_rank", "episode", "stream", "a", "b", "nums", "texts")))


def found(df: DataFrame, code: str | Column, severity: str | Column, kind: str = "dataset", episode=None, stream=None, a=None, b=None, nums=(), texts=()) -> DataFrame:
    """Findings, one for each row of ``df``. Numbers and texts of the message stay columns; the driver writes it."""
    col = lambda x, t: F.lit(None).cast(t) if x is None else (F.col(x) if isinstance(x, str) else x).cast(t)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        lit(severity).alias("severity"), lit(code).alias("code"), F.lit(kind).alias("loc_kind"), F.lit(RANKS[kind]).alias("loc_rank"),
        col(episode, "decimal(20,0)").alias("episode"), col(stream, "string").alias("stream"), col(a, "long").alias("a"), col(b, "long").alias("b"),
        F.array(*(col(x, "double") for x in nums)).cast("array<double>").alias("nums"), F.array(*(col(x, "string") for x in texts)).cast("array<string>").alias("texts"),
    )


def minus(a: Column, b: Column) -> Column:
    """``a - b`` of two times, held at the ends of the range instead of overflowing."""
    top = F.when(a < b, F.lit(-(2**63) + 0)).otherwise(F.lit(2**63 - 1))
    return F.coalesce(F.try_subtract(a, b), F.when(a.isNotNull() & b.isNotNull(), top))


def finite(x: Column) -> Column:
    """True only of numbers that are neither NaN nor infinite: Spark orders NaN highest and equal to itself."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def recorded(key: tuple[str, ...] = ("ep_ord", "st_ord")) -> Window:
    return Window.partitionBy(*key).orderBy("frame_idx")


def intervals(rec: Recording) -> DataFrame:
    """frames with prev (the time before in recorded order) and d (the step from it); null for first frames."""
    f = rec.frames.withColumn("prev", F.lag("ts").over(recorded()))
    return f.withColumn("d", minus(F.col("ts"), F.col("prev")))


def profile(rec: Recording) -> DataFrame:
    """One row for each stream, empty ones too, from a single shuffle of the frames on (ep_ord, st_ord).

    n, lo, hi, span; n_iv, n_pos and all_pos of the steps; median (interpolated) of the positive steps, upper (the
    larger middle) of all; mean and cv (population) of the positive; period; fp, which is equal for equal timelines.
    A recording that a whole run of checks reads keeps it (see ``profiled``).
    """
    if rec.kept is not None:
        return rec.kept
    pos = F.col("d") > 0
    step = F.when(pos, F.col("d"))
    agg = (
        intervals(rec).withColumn("k", F.row_number().over(recorded()))
        .groupBy("ep_ord", "st_ord")
        .agg(
            F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("d").alias("n_iv"), F.count(step).alias("n_pos"),
            F.percentile(step, 0.5).alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)").alias("upper"),
            F.avg(step).alias("mean"), F.stddev_pop(step).alias("std"), F.bit_xor(F.xxhash64("k", "ts")).alias("fp"), F.count("content_hash").alias("n_hashed"),
        )
    )
    s = rec.streams.select("ep_ord", "st_ord", "name", "modality", "declared_rate_hz", "clock_id", "clock_kind").join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    rate = F.col("declared_rate_hz")
    declared = F.when(finite(rate) & (rate > 0), (1e9 / F.when(rate > 0, rate)).cast("long"))
    few = F.when(F.col("n_pos") == 1, F.least(F.coalesce(declared, F.col("median").cast("long")), F.col("median").cast("long"))).otherwise(F.coalesce(declared, F.lit(0)))
    return (
        s.join(agg, ["ep_ord", "st_ord"], "left")
        .fillna(0, ["n", "n_iv", "n_pos", "n_hashed"])
        .withColumn("span", minus(F.col("hi"), F.col("lo")))
        .withColumn("cv", F.when(F.col("n_pos") > 0, F.col("std") / F.col("mean")))
        .withColumn("period", F.when(F.col("n_pos") >= 2, F.col("median").cast("long")).otherwise(few))
    )


@contextmanager
def profiled(rec: Recording):
    """While it is open, the profile is computed once for all checks; it has a row for each stream and may spill to disk."""
    rec.kept = profile(rec).persist()
    try:
        yield rec
    finally:
        rec.kept.unpersist()
        rec.kept = None


def representatives(p: DataFrame) -> DataFrame:
    """Streams of ``profile`` that speak for all with their timeline: the first name; ``twins`` counts the others."""
    w = Window.partitionBy("ep_ord", "fp", "n", "lo", "hi")
    return p.withColumn("twins", F.count("*").over(w) - 1).withColumn("_first", F.min("name").over(w)).where(F.col("name") == F.col("_first")).drop("_first")


def once(df: DataFrame, *key: str) -> DataFrame:
    """The first row in canonical order for each key."""
    w = Window.partitionBy(*key).orderBy("ep_ord", "st_ord")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def is_rig(rec: Recording) -> DataFrame:
    """ep_ord of the episodes of a sensor rig: three rig sensors at least, of two kinds at least."""
    s = rec.streams.where(F.col("modality").isin(*RIG))
    return s.groupBy("ep_ord").agg(F.count("*").alias("n"), F.countDistinct("modality").alias("k")).where("n >= 3 AND k >= 2").select("ep_ord")


# Modalities that belong to a sensor rig, and those of sensors that have a place.
RIG = ("point-cloud", "imu", "gnss", "can-signal", "ego-pose")
SPATIAL = ("point-cloud", "video", "imu", "gnss")
# Texts that stand for no value, in provenance and as a task.
PLACEHOLDERS = ("", "unknown", "n/a", "na", "none", "null", "nil", "todo", "tbd", "unspecified", "placeholder", "-", "--", "?")
PLACEHOLDER_TASKS = ("hold", "up", "down", "left", "right", "n/a", "na", "none", "null", "task", "test", "todo", "-")


def plain(x: Column) -> Column:
    """Without white space (Unicode's too) at its ends, and in lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
