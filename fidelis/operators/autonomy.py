"""Checks of sensor rigs: synchrony, dropped frames, poses, calibration and frames of reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.base import SPATIAL, Check, finite, found, intervals, is_rig, minus, once, profile

MIN_FRAMES, MAX_CV, NEAR = 8, 0.40, 0.15


def reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph of pairs (a, b): root is the smallest node it is connected with.

    Each round takes the smallest root of the neighbours and then the root's own root, until nothing changes; paths
    shrink by a factor each round. Rounds are cut by checkpoints where the session has a folder for them.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    root = near.select("node", F.least("node", "m").alias("root"))
    cut = (lambda d: d.checkpoint()) if edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda d: d.persist())
    root = cut(root)
    while True:
        low = both.join(root.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = root.join(low, "node").select("node", F.least("root", "low").alias("up"))
        jump = step.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("root"))
        new = cut(jump)
        if not new.join(root.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count():
            return new
        root = new


def tree(rec):
    return rec.transforms.select(F.col("parent_frame").alias("a"), F.col("child_frame").alias("b"))


def rig_sync(rec, tol):
    p = profile(rec).where("span > 0").join(is_rig(rec), "ep_ord", "left_semi")
    key = F.struct("span", "name")
    g = p.groupBy("ep_ord", "episode").agg(F.count("*").alias("k"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.min_by("period", key).alias("p1"), F.max_by("period", key).alias("p2"))
    d = minus(F.col("hi.span"), F.col("lo.span"))
    g = g.where("k >= 2").where(d > tol.clock_skew_ns + F.greatest("p1", "p2"))
    return found(g, "RIG_SYNC", "error", "episode", "episode", nums=[d], texts=["lo.name", "hi.name"])


def dropped(rec):
    """Streams of ``profile`` with missing, the frames that steps near a multiple of the median leave out."""
    p = profile(rec).where((F.col("n") >= MIN_FRAMES) & (F.col("n_pos") > 0) & (F.col("cv") <= MAX_CV) & (F.col("median") > 0))
    d = intervals(rec).where("d > 0").join(p.select("ep_ord", "st_ord", "median"), ["ep_ord", "st_ord"])
    q = F.col("d") / F.col("median")
    k = F.round(q)
    m = d.groupBy("ep_ord", "st_ord").agg(F.sum(F.when((k >= 2) & (F.abs(q - k) <= NEAR), k - 1).otherwise(0)).cast("long").alias("missing"))
    return p.join(m, ["ep_ord", "st_ord"])


def sequence_complete(rec, tol):
    p = dropped(rec).join(is_rig(rec), "ep_ord", "left_semi")
    return found(p.where(F.col("missing") / (F.col("n") + F.col("missing")) > tol.sequence_drop_fraction), "SEQUENCE_COMPLETE", "warning", "stream", "episode", "name", nums=["missing", "n"])


def ego_pose_continuity(rec, tol):
    w = Window.partitionBy("ep_ord").orderBy("ts", "idx")
    e = rec.ego_poses
    for c in ("ts", "x", "y", "z"):
        e = e.withColumn(f"p_{c}", F.lag(c).over(w))
    e = e.withColumn("dt", minus(F.col("ts"), F.col("p_ts")) / 1e9).where("dt > 0")
    v = F.sqrt(sum((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in "xyz")) / F.col("dt")
    e = e.withColumn("v", v).withColumn("ok", finite(F.col("v")))
    g = e.groupBy("ep_ord").agg(F.sum((~F.col("ok")).cast("long")).alias("bad"), F.sum((F.col("ok") & (F.col("v") > tol.ego_max_speed_mps)).cast("long")).alias("fast"), F.max(F.when(F.col("ok"), F.col("v"))).alias("worst")).join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    return found(g.where("fast > 0"), "EGO_POSE_CONTINUITY", "error", "episode", "episode", nums=["fast", "worst"]).union(found(g.where("bad > 0"), "EGO_POSE_NON_FINITE", "error", "episode", "episode", nums=["bad"]))


def _placed(rec):
    """Spatial sensors of rigs with root, the component of their frame (null: none or not in the tree)."""
    s = rec.streams.where(F.col("modality").isin(*SPATIAL)).join(is_rig(rec), "ep_ord", "left_semi").join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    roots = reachable(tree(rec)).select(F.col("node").alias("frame_id"), "root")
    return s.join(roots, "frame_id", "left"), roots


def sensor_frame_resolution(rec, tol):
    s, _ = _placed(rec)
    any_edge = rec.transforms.limit(1).select(F.lit(1).alias("_e"))
    s = s.crossJoin(F.broadcast(any_edge))
    cameras = s.where("modality = 'video' AND root IS NOT NULL").select("ep_ord", "root").distinct().withColumn("seen", F.lit(1))
    has = cameras.groupBy("ep_ord").agg(F.count("*").alias("cams"))
    s = s.join(cameras, ["ep_ord", "root"], "left").join(has, "ep_ord", "left")
    code = F.when(F.col("frame_id").isNull(), "SENSOR_FRAME_UNDECLARED").when(F.col("root").isNull(), "SENSOR_FRAME_UNKNOWN").when((F.col("modality") != "video") & F.col("cams").isNotNull() & F.col("seen").isNull(), "SENSOR_FRAME_UNRELATED")
    x = once(s.withColumn("code", code).where("code IS NOT NULL"), "name", "code")
    return found(x, F.col("code"), F.when(F.col("code") == "SENSOR_FRAME_UNDECLARED", "warning").otherwise("error"), "stream", "episode", "name", texts=["frame_id"])


def calibration_completeness(rec, tol):
    """Rigs with a cloud or a camera: no transforms, a tree in several parts that no sensor's frame explains, or a camera without intrinsics."""
    s = rec.streams.join(is_rig(rec), "ep_ord", "left_semi").where(F.col("modality").isin("point-cloud", "video"))
    e = s.groupBy("ep_ord").agg(F.count("*").alias("k")).join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    parts = reachable(tree(rec)).agg(F.countDistinct("root").alias("parts"))
    local = s.agg(F.coalesce(F.max(F.col("frame_id").isNotNull().cast("int")), F.lit(0)).alias("framed"))
    g = e.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(local))
    out = found(g.where("parts = 0"), "CALIBRATION_INCOMPLETE", "warning", "episode", "episode", texts=[F.lit("no-transforms")])
    out = out.union(found(g.where("parts > 1 AND framed = 0"), "CALIBRATION_INCOMPLETE", "warning", "episode", "episode", nums=["parts"], texts=[F.lit("disconnected")]))
    lone = s.where("modality = 'video'").join(rec.intrinsics.select(F.col("stream").alias("name")), "name", "left_anti").join(rec.episodes.select("ep_ord", "episode"), "ep_ord")
    return out.union(found(lone, "CALIBRATION_INCOMPLETE", "warning", "stream", "episode", "name", texts=[F.lit("no-intrinsics")]))


CHECKS = (
    Check("autonomy.rig-sync", "Sensors of one rig that cover different times", {"RIG_SYNC": "error"}, rig_sync),
    Check("autonomy.sequence-complete", "Dropped frames", {"SEQUENCE_COMPLETE": "warning"}, sequence_complete),
    Check("autonomy.ego-pose-continuity", "Jumps of the vehicle", {"EGO_POSE_CONTINUITY": "error", "EGO_POSE_NON_FINITE": "error"}, ego_pose_continuity),
    Check("autonomy.calibration-completeness", "Calibration that lacks parts", {"CALIBRATION_INCOMPLETE": "warning"}, calibration_completeness),
    Check("autonomy.sensor-frame-resolution", "Sensors that have no place in the rig", {"SENSOR_FRAME_UNDECLARED": "warning", "SENSOR_FRAME_UNKNOWN": "error", "SENSOR_FRAME_UNRELATED": "error"}, sensor_frame_resolution),
)
