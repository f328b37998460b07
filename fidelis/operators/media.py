"""Checks of media files that belong to streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fidelis.functions.codecs import codec_family
from fidelis.operators.base import Check, found, once


def _media(rec):
    n = rec.frames.groupBy("ep_ord", "st_ord").agg(F.count("*").alias("n"))
    s = rec.streams.where("media IS NOT NULL").join(rec.episodes.select("ep_ord", "episode"), "ep_ord").join(n, ["ep_ord", "st_ord"], "left")
    return s.withColumn("n", F.coalesce("n", F.lit(0))).select("ep_ord", "st_ord", "episode", "name", "n", "media.*")


def media_readable(rec, tol):
    m = _media(rec)
    w = Window.partitionBy("name")
    m = m.withColumn("eps", F.count("*").over(w)).withColumn("gone", F.sum((F.col("status") == "missing").cast("long")).over(w))
    every = F.col("eps") == F.col("gone")
    out = found(once(m.where(every), "name"), "MEDIA_ABSENT", "error", "stream", None, "name", nums=["eps"])
    out = out.union(found(m.where(~every & (F.col("status") == "missing")), "MEDIA_MISSING", "error", "stream", "episode", "name", texts=["uri"]))
    out = out.union(found(m.where("status = 'unreadable'"), "MEDIA_UNREADABLE", "error", "stream", "episode", "name", texts=["uri", "reason"]))
    u = m.where("status = 'unattributable'").groupBy("name").agg(F.countDistinct("episode").alias("k"), F.min_by("reason", "ep_ord").alias("reason"))
    return out.union(found(u, "MEDIA_UNATTRIBUTED", "info", "stream", None, "name", nums=["k"], texts=["reason"]))


def media_conformance(rec, tol):
    m = _media(rec).where("status = 'read'")
    d, o = F.col("declared"), F.col("observed")
    out = None
    if rec.frames_read:
        c = m.where("frame_count IS NOT NULL").withColumn("delta", F.col("frame_count") - F.col("n"))
        g = c.groupBy("name").agg(F.min("delta").alias("d1"), F.max("delta").alias("d2"), F.countDistinct("episode").alias("k"), F.min("episode").alias("episode"))
        same = g.where("d1 = d2 AND d1 <> 0 AND k > 1")
        out = found(same, "FRAME_COUNT_MISMATCH", "warning", "stream", None, "name", nums=["d1", "k"], texts=[F.lit("systematic")])
        each = c.join(same.select("name"), "name", "left_anti").where("delta <> 0")
        out = out.union(found(each, "FRAME_COUNT_MISMATCH", "error", "stream", "episode", "name", nums=["frame_count", "n"], texts=[F.lit("episode")]))

    def rolled(rows, code):
        g = rows.groupBy("name", "detail").agg(F.min_by("episode", "ep_ord").alias("episode"), F.countDistinct("episode").alias("k"))
        return found(g, code, "warning", "stream", "episode", "name", nums=["k"], texts=["detail"])

    size = m.where((d["width"] != o["width"]) | (d["height"] != o["height"])).withColumn("detail", F.format_string("%dx%d/%dx%d", d["width"], d["height"], o["width"], o["height"]))
    a, b = codec_family(d["codec"]), codec_family(o["codec"])
    codec = m.where(a != b).withColumn("detail", F.concat(a, F.lit("/"), b))
    fps = m.where((d["fps"] > 0) & (F.abs(o["fps"] - d["fps"]) / F.when(d["fps"] > 0, d["fps"]) > tol.rate_deviation)).withColumn("detail", F.concat_ws("/", d["fps"].cast("string"), o["fps"].cast("string")))
    for rows, code in ((size, "RESOLUTION_MISMATCH"), (codec, "CODEC_MISMATCH"), (fps, "FPS_MISMATCH")):
        out = rolled(rows, code) if out is None else out.union(rolled(rows, code))
    return out


CHECKS = (
    Check("video.media-readable", "Media files that can't be read", {"MEDIA_ABSENT": "error", "MEDIA_MISSING": "error", "MEDIA_UNREADABLE": "error", "MEDIA_UNATTRIBUTED": "info"}, media_readable),
    Check("video.media-conformance", "Media files that differ from what is declared", {"FRAME_COUNT_MISMATCH": "error", "RESOLUTION_MISMATCH": "warning", "CODEC_MISMATCH": "warning", "FPS_MISMATCH": "warning"}, media_conformance),
)
