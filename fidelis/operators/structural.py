"""Checks of structure: episodes, streams, declared counts and repeated content."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fidelis.operators.base import Check, found, minus, once, profile, recorded

STUCK_RUN = 5
LISTED = 8
#: Episode numbers that are looked at together.
BUCKET = 4096


def _lengths(rec):
    """ep_ord and length, the frames of its longest stream, of every episode."""
    n = profile(rec).groupBy("ep_ord").agg(F.max("n").alias("length"))
    return rec.episodes.join(n, "ep_ord", "left").withColumn("length", F.coalesce("length", F.lit(0)))


def episode_boundary(rec, tol):
    again = rec.episodes.groupBy("episode").agg(F.count("*").alias("k")).where("k > 1")
    out = found(again, "EPISODE_BOUNDARY", "error", "episode", "episode", nums=["k"], texts=[F.lit("repeated-index")])
    out = out.union(found(rec.episodes.where("start_ts > end_ts"), "EPISODE_BOUNDARY", "error", "episode", "episode", nums=["start_ts", "end_ts"], texts=[F.lit("reversed-bounds")]))
    if rec.frames_read:
        e = _lengths(rec).where("declared_frame_count <> length")
        out = out.union(found(e, "EPISODE_BOUNDARY", "error", "episode", "episode", nums=["declared_frame_count", "length"], texts=[F.lit("declared-length")]))
    return out


def degenerate_episode(rec, tol):
    none = rec.episodes.agg(F.count("*").alias("k")).where("k = 0")
    out = found(none, "EMPTY_DATASET", "error")
    bare = rec.episodes.join(rec.streams, "ep_ord", "left_anti")
    out = out.union(found(bare, "EMPTY_EPISODE", "error", "episode", "episode"))
    if rec.frames_read:
        p = profile(rec)
        out = out.union(found(p.where("n = 0"), "EMPTY_STREAM", "error", "stream", "episode", "name"))
        out = out.union(found(p.where("n = 1"), "SINGLE_FRAME_STREAM", "warning", "stream", "episode", "name"))
    return out


def missing_indices(df, index: str):
    """One row of a column of distinct indices: lo, hi, missing (how many), listed (the first few), by gaps alone.

    Indices are sorted inside buckets of ``BUCKET``; a gap between two buckets shows at the ends of both, so only a row
    for each bucket is ever sorted as a whole.
    """
    d = df.select(F.col(index).cast("decimal(20,0)").alias("i")).distinct().withColumn("b", F.floor(F.col("i") / BUCKET))
    inside = d.select("i", F.lead("i").over(Window.partitionBy("b").orderBy("i")).alias("after"))
    buckets = d.groupBy("b").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    between = buckets.select(F.col("hi").alias("i"), F.lead("lo").over(Window.orderBy("b")).alias("after"))
    gap = F.col("after") - F.col("i") - 1
    some = inside.union(between).where(gap > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(gap, F.lit(LISTED)).cast("int")), lambda k: (F.col("i") + k).cast("decimal(20,0)"))).alias("m")).orderBy("m").limit(LISTED)
    listed = some.agg(F.array_sort(F.collect_list("m")).alias("listed"))
    ends = buckets.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.withColumn("missing", F.col("hi") - F.col("lo") - (F.col("n") - 1)).crossJoin(F.broadcast(listed))


def episode_continuity(rec, tol):
    m = missing_indices(rec.episodes, "episode").where("n >= 2 AND missing > 0")
    return found(m, "EPISODE_INDEX_GAP", "warning", nums=["missing"], texts=[F.array_join(F.transform("listed", lambda x: x.cast("string")), ",")])


def _declared(rec, key):
    return rec.metadata.where(F.col("key") == key).select(F.expr("try_cast(value AS bigint)").alias("declared")).where("declared IS NOT NULL").limit(1)


def declared_episode_count(rec, tol):
    n = rec.episodes.agg(F.count("*").alias("k"))
    return found(_declared(rec, "declared_total_episodes").crossJoin(n).where("declared <> k"), "EPISODE_COUNT_MISMATCH", "error", nums=["declared", "k"])


def declared_frame_count(rec, tol):
    n = _lengths(rec).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("k"))
    bad = _declared(rec, "declared_total_frames").crossJoin(n).where("declared <> k")
    return found(bad if rec.frames_read else bad.where("false"), "FRAME_COUNT_MISMATCH", "error", nums=["declared", "k"])


def shape_consistency(rec, tol):
    w = Window.partitionBy("name").orderBy("ep_ord", "st_ord").rowsBetween(Window.unboundedPreceding, -1)
    shape = F.array_join(F.transform("shape", lambda x: x.cast("string")), "x")
    s = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").withColumn("sh", F.when(F.col("shape").isNotNull(), shape))
    s = s.withColumn("base_dtype", F.first("dtype", ignorenulls=True).over(w)).withColumn("base_shape", F.first("sh", ignorenulls=True).over(w))
    s = s.withColumn("what", F.when(F.col("dtype") != F.col("base_dtype"), "dtype").when(F.col("sh") != F.col("base_shape"), "shape")).where("what IS NOT NULL")
    return found(once(s, "name"), "SHAPE_MISMATCH", "error", "stream", "episode", "name", texts=["what"])


def stream_presence(rec, tol):
    """Names that some episodes lack; how many is a difference of counts, and the first is found by buckets of episodes.

    A name's full buckets (it has as many episodes there as there are) are numbered; the first whose number is not its
    place in the row of all buckets tells the first bucket that isn't full, and only that one's episodes are looked at.
    """
    bucket = F.floor(F.col("episode") / BUCKET).alias("b")
    have = rec.streams.join(rec.episodes.select("ep_ord", "episode"), "ep_ord").select("episode", "name", bucket).distinct()
    eps = have.select("episode", "b").distinct()
    buckets = eps.groupBy("b").agg(F.count("*").alias("t")).withColumn("j", F.row_number().over(Window.orderBy("b")) - 1)
    total = buckets.agg(F.sum("t").alias("total"))
    names = have.groupBy("name").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total)).where("total >= 2 AND k < total")
    full = have.groupBy("name", "b").agg(F.count("*").alias("c")).join(buckets, "b").where("c = t").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("j")) - 1)
    first = full.groupBy("name").agg(F.coalesce(F.min(F.when(F.col("r") != F.col("j"), F.col("r"))), F.count("*")).alias("j"))
    short = names.join(first, "name", "left").withColumn("j", F.coalesce("j", F.lit(0))).join(buckets.select("b", "j"), "j")
    lack = short.join(eps, "b").join(have.select("name", "episode"), ["name", "episode"], "left_anti").groupBy("name", "total", "k").agg(F.min("episode").alias("first"))
    return found(lack, "STREAM_PRESENCE_INCONSISTENT", "warning", "stream", None, "name", nums=["k", "total", "first", F.col("total") - F.col("k")])


def content_measurability(rec, tol):
    p = profile(rec).where("n > 0")
    e = p.groupBy("ep_ord").agg(F.min(F.col("n_hashed") == F.col("n")).alias("full"))
    r = p.agg(F.sum((F.col("n_hashed") < F.col("n")).cast("long")).alias("k")).crossJoin(e.agg(F.max("full").cast("int").alias("some")))
    return found(r.where("k > 0"), "UNFINGERPRINTED_CONTENT", "info", nums=["k", "some"])


def duplicate_episode(rec, tol):
    """Groups of episodes with one signature: an ordered digest of each stream's frames, then of the episode's streams."""
    p = profile(rec).where("n > 0")
    full = rec.streams.select("ep_ord").distinct().join(profile(rec).where("n = 0 OR n_hashed < n").select("ep_ord"), "ep_ord", "left_anti")
    k = rec.frames.withColumn("k", F.row_number().over(recorded()))
    part = lambda seed: F.bit_xor(F.xxhash64("k", "ts", "content_hash", F.lit(seed))).alias(f"h{seed}")  # noqa: E731  every k is another one
    content = k.join(full, "ep_ord", "left_semi").groupBy("ep_ord", "st_ord").agg(part(1), part(2))
    s = p.select("ep_ord", "st_ord", "name", "modality", "declared_rate_hz", "clock_id", "n").join(content, ["ep_ord", "st_ord"]).join(rec.streams.select("ep_ord", "st_ord", "dtype", "shape", "stats"), ["ep_ord", "st_ord"])
    one = F.to_json(F.struct("name", "modality", "declared_rate_hz", "clock_id", "dtype", "shape", "stats", "n", "h1", "h2"))
    sig = s.groupBy("ep_ord").agg(F.array_sort(F.collect_list(one)).alias("streams"))
    lab = rec.labels.groupBy("ep_ord").agg(F.array_sort(F.collect_list(F.to_json(F.struct("key", "value")))).alias("labels"))
    e = rec.episodes.join(sig, "ep_ord").join(lab, "ep_ord", "left").withColumn("sig", F.sha2(F.to_json(F.struct("task", "labels", "streams")), 256))
    g = e.groupBy("sig").agg(F.array_sort(F.collect_list("episode")).alias("eps")).where("size(eps) > 1")
    return found(g, "DUPLICATE_EPISODE", "warning", nums=[F.size("eps")], texts=[F.array_join(F.transform("eps", lambda x: x.cast("string")), ",")])


def stuck_runs(rec):
    """ep_ord, st_ord and run, the longest run of equal hashes, by gaps and islands; a null hash ends a run."""
    w = recorded()
    same = F.col("content_hash").eqNullSafe(F.lag("content_hash").over(w)) & F.col("content_hash").isNotNull()
    f = rec.frames.withColumn("new", F.when(same, 0).otherwise(1))
    f = f.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.where("content_hash IS NOT NULL").groupBy("ep_ord", "st_ord", "island").count().groupBy("ep_ord", "st_ord").agg(F.max("count").alias("run"))


def stuck_stream(rec, tol):
    s = rec.streams.where("modality = 'video'").join(rec.episodes.select("ep_ord", "episode"), "ep_ord").join(stuck_runs(rec), ["ep_ord", "st_ord"])
    return found(s.where(F.col("run") >= STUCK_RUN), "STUCK_STREAM", "warning", "stream", "episode", "name", nums=["run"])


CHECKS = (
    Check("structural.episode-boundary", "Episode bounds and lengths", {"EPISODE_BOUNDARY": "error"}, episode_boundary),
    Check("structural.degenerate-episode", "Empty or nearly empty parts", {"EMPTY_DATASET": "error", "EMPTY_EPISODE": "error", "EMPTY_STREAM": "error", "SINGLE_FRAME_STREAM": "warning"}, degenerate_episode),
    Check("structural.episode-continuity", "Missing episode numbers", {"EPISODE_INDEX_GAP": "warning"}, episode_continuity),
    Check("structural.declared-episode-count", "Number of episodes", {"EPISODE_COUNT_MISMATCH": "error"}, declared_episode_count),
    Check("structural.declared-frame-count", "Number of frames", {"FRAME_COUNT_MISMATCH": "error"}, declared_frame_count),
    Check("structural.shape-consistency", "Types and shapes that change", {"SHAPE_MISMATCH": "error"}, shape_consistency),
    Check("structural.stream-presence", "Streams that some episodes lack", {"STREAM_PRESENCE_INCONSISTENT": "warning"}, stream_presence),
    Check("structural.content-measurability", "Content without fingerprints", {"UNFINGERPRINTED_CONTENT": "info"}, content_measurability),
    Check("structural.duplicate-episode", "Equal episodes", {"DUPLICATE_EPISODE": "warning"}, duplicate_episode),
    Check("structural.stuck-stream", "Frames that repeat", {"STUCK_STREAM": "warning"}, stuck_stream),
)
__all__ = ["CHECKS", "minus"]
