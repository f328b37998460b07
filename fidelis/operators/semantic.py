"""Checks of meaning: tasks, stream names and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators.base import PLACEHOLDER_TASKS, Check, found, once, plain


def task_quality(rec, tol):
    e = rec.episodes.where("task IS NOT NULL").withColumn("t", plain(F.col("task")))
    a = found(e.where("t = ''"), "EMPTY_TASK", "warning", "episode", "episode")
    return a.union(found(e.where(F.col("t").isin(*PLACEHOLDER_TASKS)), "PLACEHOLDER_TASK", "info", "episode", "episode", texts=["task"]))


def stream_key_clarity(rec, tol):
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").withColumn("norm", plain(F.col("name")))
    again = s.groupBy("ep_ord", "episode", "name").agg(F.count("*").alias("k"), F.min("st_ord").alias("st_ord")).where("k > 1")
    out = found(once(again, "name"), "DUPLICATE_STREAM_KEY", "error", "stream", "episode", "name", nums=["k"])
    alike = s.groupBy("ep_ord", "episode", "norm").agg(F.array_sort(F.collect_set("name")).alias("names"), F.min("st_ord").alias("st_ord")).where("size(names) > 1")
    each = once(alike, "norm").withColumn("name", F.explode("names"))
    return out.union(found(each, "AMBIGUOUS_STREAM_KEY", "warning", "stream", "episode", "name", nums=[F.size("names")], texts=["norm"]))


def annotation_integrity(rec, tol):
    lab = rec.labels.where("key = 'language'").join(rec.episodes.select("ep_ord", "episode", "start_ts", "end_ts"), "ep_ord")
    seen = rec.frames.groupBy("ep_ord").agg(F.min("ts").alias("f_lo"), F.max("ts").alias("f_hi"))
    span = lab.join(seen, "ep_ord", "left").withColumn("lo", F.least("start_ts", "f_lo")).withColumn("hi", F.greatest("end_ts", "f_hi"))
    out = found(span.where("ts < lo OR ts > hi"), "ANNOTATION_UNALIGNED", "error", "episode", "episode", nums=["ts", "lo", "hi"])
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    g = lab.where("ts IS NOT NULL").groupBy("ep_ord", "episode", "ts").agg(F.countDistinct(value).alias("k")).where("k > 1")
    out = out.union(found(g, "ANNOTATION_CONFLICT", "warning", "episode", "episode", nums=["ts", "k"]))
    return out.union(found(lab.where(value == ""), "EMPTY_ANNOTATION", "warning", "episode", "episode", nums=["ts"]))


CHECKS = (
    Check("semantic.task-quality", "Tasks that say nothing", {"EMPTY_TASK": "warning", "PLACEHOLDER_TASK": "info"}, task_quality),
    Check("semantic.stream-key-clarity", "Streams that are hard to tell apart", {"DUPLICATE_STREAM_KEY": "error", "AMBIGUOUS_STREAM_KEY": "warning"}, stream_key_clarity),
    Check("semantic.annotation-integrity", "Annotations out of place", {"ANNOTATION_UNALIGNED": "error", "ANNOTATION_CONFLICT": "warning", "EMPTY_ANNOTATION": "warning"}, annotation_integrity),
)
