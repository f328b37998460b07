"""Ordinary tables read as recordings, so that every check runs over data that another engine can read too.

``events``: an episode for each user, a stream for each event type, a frame for each event in order of event_id. What a
table of events doesn't declare (rates, clocks, types, tasks) is derived from its keys by fixed rules, with defects.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from fidelis.model import Recording

# Event types in canonical order, a rare one more, and the modalities their streams take in a rig.
KINDS = ("click", "error", "purchase", "signup", "view", "zoom")
MODALITIES = ("can-signal", "imu", "point-cloud", "gnss", "video", "scalar-state")
#: Where episode numbers of copies and of empty episodes begin: multiples of all divisors that the rules below use.
COPIES, EMPTY = 3 * 360_360, 6 * 360_360
#: The time from which planted timelines count, in ns.
BASE = 1_704_067_200_000_000_000


def events(spark: SparkSession, sf_dir: str) -> Recording:
    """All rows of ``events``. Defects are planted by other values, and by rows more, never by rows less."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.expr("user_id + user_id div 16"))
    e = e.withColumn("event_type", F.when(F.col("event_id") % 211 == 5, "zoom").otherwise(F.col("event_type")))
    e = e.unionByName(e.where("user_id % 24 = 7").withColumn("user_id", F.col("user_id") + COPIES))
    # Times as ns; independent of the session's time zone.
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) * 1000")
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    e = e.withColumn("k", k).withColumn("t", ts)
    ts = F.expr(f"CASE WHEN user_id % 14 = 2 THEN {BASE} + (k + k div 10) * 1000000000L WHEN user_id % 22 = 9 THEN {BASE} + (t - {BASE}) div 1000 WHEN event_id % 101 = 7 THEN t - 1000000000000000 ELSE t END")
    hidden = (F.col("user_id") % 12 == 3) & (F.col("event_id") % 5 == 0)
    e = e.select(F.col("user_id").alias("ep_ord"), (F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1).alias("st_ord"), F.col("event_id").alias("frame_idx"), ts.alias("ts"), "value", F.when(~hidden, F.sha2(F.floor(F.col("value") / 25).cast("string"), 256)).alias("content_hash"))
    u, s = F.col("ep_ord"), F.col("st_ord")
    # Findings are told apart by mean and deviation, so equal values must give equal bits however rows are dealt: each
    # stream is added up whole, in the order of its values.
    w = Window.partitionBy("ep_ord", "st_ord").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = e.select("ep_ord", "st_ord", "value", F.row_number().over(w).alias("nth"), F.avg("value").over(w).alias("mean"), F.stddev_pop("value").over(w).alias("std"))
    g = x.groupBy("ep_ord", "st_ord").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("mean", "nth").alias("mean"), F.max_by("std", "nth").alias("std"), F.min(F.floor(F.col("value") / 40)).alias("lo"), F.max(F.floor(F.col("value") / 40)).alias("hi"), F.collect_list(F.floor(F.col("value") / 40)).alias("steps"))
    rate = F.when((u + s) % 7 == 0, None).when((u + s) % 7 == 1, -1.0).otherwise(5e-6 * (1 + u % 3))
    observed = F.struct("min", "max", "mean", F.when(u % 15 == 4, F.col("std") / 100).otherwise(F.col("std")).alias("std"))
    stored = F.when(u % 6 == 1, None).otherwise(F.struct("min", F.when(u % 5 == 0, F.col("max") / 2).otherwise(F.col("max")).alias("max"), "mean", F.when(u % 9 == 0, -F.col("std")).otherwise(F.col("std")).alias("std")))
    at = lambda end: F.size(F.filter("steps", lambda x: x == F.col(end))).cast("long")
    streams = g.select(
        "ep_ord", "st_ord",
        F.array(*map(F.lit, KINDS))[s.cast("int")].alias("name"),
        F.when(u % 2 == 0, F.array(*map(F.lit, MODALITIES))[s.cast("int")]).when(s == 4, "video").otherwise("scalar-state").alias("modality"),
        rate.alias("declared_rate_hz"),
        F.concat(F.lit("clock-"), u % 2).alias("clock_id"),
        F.when((s == 3) & (u % 3 == 0), "step-index").otherwise("measured").alias("clock_kind"),
        F.when(u % 11 == 10, "float32").otherwise("float64").alias("dtype"),
        F.array(F.when(u % 13 == 12, 2).otherwise(1).cast("long")).alias("shape"),
        stored.alias("stats"), observed.alias("observed_stats"),
        F.struct("n", at("lo").alias("at_min"), at("hi").alias("at_max"), F.col("lo").cast("double").alias("min"), F.col("hi").cast("double").alias("max"), F.lit(0).cast("long").alias("dim")).alias("observed_saturation"),
        F.when(u % 10 == 0, s).alias("observed_non_finite"),
        F.when(s != 1, F.concat(F.lit("frame"), s % 4)).alias("frame_id"),
    )
    eps = e.groupBy("ep_ord").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    task = F.when(u % 6 == 0, " ").when(u % 6 == 1, "Todo").when(u % 6 == 2, None).otherwise(F.concat(F.lit("job "), u))
    episodes = eps.select("ep_ord", u.cast("decimal(20,0)").alias("episode"), F.when(u % 4 == 0, F.when(u % 8 == 0, F.col("hi")).otherwise(F.col("lo"))).alias("start_ts"), F.when(u % 4 == 0, F.when(u % 8 == 0, F.col("lo")).otherwise(F.col("hi"))).alias("end_ts"), task.alias("task"), F.when(u % 2 == 1, 13).alias("declared_frame_count"))
    none = lambda t: F.lit(None).cast(t)
    bare = eps.where("ep_ord % 18 = 5").select((u + EMPTY).alias("ep_ord"), (u + EMPTY).cast("decimal(20,0)").alias("episode"), none("long").alias("start_ts"), none("long").alias("end_ts"), none("string").alias("task"), none("int").alias("declared_frame_count"))
    episodes = episodes.unionByName(bare)
    poses = e.where("st_ord = 0").select("ep_ord", F.col("frame_idx").alias("idx"), "ts", (F.col("value") * 1e6).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("frame_idx") % 97 == 0, float("nan")).otherwise(0.0).alias("z"))
    rec = Recording(spark, "events", "table")
    for name, df in (("episodes", episodes), ("streams", streams), ("frames", e), ("ego_poses", poses)):
        rec.put(name, df)
    rec.put("metadata", spark.createDataFrame([("declared_total_episodes", "150"), ("declared_total_frames", "1500")], "key string, value string"))
    rec.put("transforms", spark.createDataFrame([("base", "frame0"), ("base", "frame2"), ("map", "frame3")], "parent_frame string, child_frame string"))
    rec.put("intrinsics", spark.createDataFrame([("side",)], "stream string"))
    rec.put("provenance", spark.createDataFrame([("dataset", 1, "license", "MIT", "known"), ("dataset", 1, "sensor", " N/A ", "asserted"), ("dataset", 2, "clock", None, "known"), ("dataset", 2, "annotator", "crowd", "asserted"), ("dataset", 3, "upstream", "x", "unknown")], "scope_kind string, record_id long, key string, value string, class string"))
    return rec


#: DuckDB: the same recording as common table expressions, and what checks derive from it.
EVENTS_SQL = f"""WITH e1 AS (SELECT user_id + user_id // 16 AS u, CASE WHEN event_id % 211 = 5 THEN 'zoom' ELSE event_type END AS name, event_id AS i, epoch_us(ts) * 1000 AS t, value FROM events),
  e2 AS (SELECT *, row_number() OVER (PARTITION BY u, name ORDER BY i) - 1 AS nth FROM (SELECT * FROM e1 UNION ALL SELECT * REPLACE (u + {COPIES} AS u) FROM e1 WHERE u % 24 = 7)),
  e AS (SELECT u, list_position({list(KINDS)!r}, name) - 1 AS s, name, i, CASE WHEN u % 14 = 2 THEN {BASE} + (nth + nth // 10) * 1000000000 WHEN u % 22 = 9 THEN {BASE} + (t - {BASE}) // 1000 WHEN i % 101 = 7 THEN t - 1000000000000000 ELSE t END AS ts, value,
    CASE WHEN u % 12 = 3 AND i % 5 = 0 THEN NULL ELSE sha256(CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR)) END AS h FROM e2),
  g AS (SELECT u, s, any_value(name) AS name, count(*) AS n, min(value) AS mn, max(value) AS mx, avg(value) AS mean, stddev_pop(value) AS sd, min(floor(value / 40)) AS lo40, max(floor(value / 40)) AS hi40 FROM e GROUP BY u, s),
  st AS (SELECT u, s, name, CASE WHEN u % 2 = 0 THEN {list(MODALITIES)!r}[s + 1] WHEN s = 4 THEN 'video' ELSE 'scalar-state' END AS modality,
    CASE WHEN (u + s) % 7 = 0 THEN NULL WHEN (u + s) % 7 = 1 THEN CAST(-1.0 AS DOUBLE) ELSE CAST('5e-6' AS DOUBLE) * (1 + u % 3) END AS rate, 'clock-' || (u % 2) AS clock,
    CASE WHEN s = 3 AND u % 3 = 0 THEN 'step-index' ELSE 'measured' END AS kind, CASE WHEN u % 11 = 10 THEN 'float32' ELSE 'float64' END AS dtype, CASE WHEN u % 13 = 12 THEN 2 ELSE 1 END AS shape,
    n, mn, mx, mean, sd, lo40, hi40, u % 6 <> 1 AS stored, CASE WHEN u % 5 = 0 THEN mx / 2 ELSE mx END AS smx, CASE WHEN u % 9 = 0 THEN -sd ELSE sd END AS ssd, CASE WHEN u % 15 = 4 THEN sd / 100 ELSE sd END AS osd,
    CASE WHEN u % 10 = 0 THEN s END AS bad, CASE WHEN s <> 1 THEN 'frame' || (s % 4) END AS frame FROM g),
  ep AS (SELECT u, min(ts) AS lo, max(ts) AS hi, CASE WHEN u % 4 = 0 THEN CASE WHEN u % 8 = 0 THEN max(ts) ELSE min(ts) END END AS a, CASE WHEN u % 4 = 0 THEN CASE WHEN u % 8 = 0 THEN min(ts) ELSE max(ts) END END AS z,
    CASE u % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'Todo' WHEN 2 THEN NULL ELSE 'job ' || u END AS task, CASE WHEN u % 2 = 1 THEN 13 END AS declared FROM e GROUP BY u UNION ALL SELECT DISTINCT u + {EMPTY}, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE u % 18 = 5),
  iv AS (SELECT *, ts - prev AS d FROM (SELECT *, lag(ts) OVER (PARTITION BY u, s ORDER BY i) AS prev, row_number() OVER (PARTITION BY u, s ORDER BY i) - 1 AS k FROM e)),
  ag AS (SELECT u, s, count(*) AS n, min(ts) AS lo, max(ts) AS hi, count(d) AS niv, count(*) FILTER (d > 0) AS npos, median(d) FILTER (d > 0) AS med, list_sort(list(d) FILTER (d IS NOT NULL))[count(d) // 2 + 1] AS upper,
    avg(d) FILTER (d > 0) AS mean_d, stddev_pop(d) FILTER (d > 0) AS sd_d, list(ts ORDER BY i) AS line FROM iv GROUP BY u, s),
  pr AS (SELECT st.*, ag.lo, ag.hi, ag.hi - ag.lo AS span, niv, npos, med, upper, mean_d, sd_d, line,
    CASE WHEN npos >= 2 THEN CAST(trunc(med) AS BIGINT) WHEN npos = 1 THEN least(coalesce(CASE WHEN rate > 0 THEN CAST(trunc(1e9 / rate) AS BIGINT) END, CAST(trunc(med) AS BIGINT)), CAST(trunc(med) AS BIGINT)) ELSE coalesce(CASE WHEN rate > 0 THEN CAST(trunc(1e9 / rate) AS BIGINT) END, 0) END AS period
    FROM st JOIN ag USING (u, s)),
  rp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY u, line) - 1 AS twins, min(name) OVER (PARTITION BY u, line) AS first_name FROM pr) WHERE name = first_name),
  rig AS (SELECT u FROM st WHERE modality IN ('point-cloud', 'imu', 'gnss', 'can-signal', 'ego-pose') GROUP BY u HAVING count(*) >= 3 AND count(DISTINCT modality) >= 2)
"""
