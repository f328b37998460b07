"""Folders of robot episodes: JSON manifests in ``meta``, one Parquet row for each frame of all features in ``data``.

Manifests are small and read on the driver. Frames stay in Spark: selected episodes are a filter that reaches the scan,
order is that of the files and their rows, and each feature of a row becomes one frame of its stream.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.functions import sampling
from fidelis.model import Recording
from fidelis.operators.statistical import dimension_stats, worst_saturation
from fidelis.sources import mp4
from fidelis.sources.registry import Format, Options, SourceError, dataset_id

# Columns that keep the books and are no features; words in names that tell what a feature is.
BOOKS = ("episode_index", "frame_index", "timestamp", "task_index", "index")
MEDIA = (".mp4", ".m4v", ".mov")
TOUCH = ("wrench", "force", "torque", "tactile")


def modality(name: str, dtype: str) -> str:
    if "image" in name or dtype in ("video", "image"):
        return "video"
    if "audio" in name or dtype == "audio":
        return "audio"
    if any(w in name for w in TOUCH):
        return "tactile-force-torque"
    return "action" if name.startswith("action") else "scalar-state"


def _json(path: str, needed: bool = False):
    if not os.path.exists(path):
        if needed:
            raise SourceError(f"no {path}")
        return None
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except ValueError as e:
        raise SourceError(f"{path}: {e}") from None


def _lines(path: str, strict: bool) -> list[dict]:
    out = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for n, line in enumerate(f, 1):
                if line.strip():
                    try:
                        out.append(json.loads(line))
                    except ValueError:
                        if strict:
                            raise SourceError(f"{path}: line {n} is no JSON") from None
    return out


def shards(path: str) -> tuple[list[str], list[str]]:
    """Parquet files under ``data`` in order, and those that lead out of the folder."""
    root, good, out = os.path.realpath(path), [], []
    for folder, _, names in os.walk(os.path.join(path, "data")):
        for n in sorted(names):
            if n.endswith(".parquet"):
                p = os.path.join(folder, n)
                (good if os.path.realpath(p).startswith(root + os.sep) else out).append(p)
    return sorted(good), out


def _stats(raw, dims: bool):
    """(min, max, mean, std) of element 0, or of each dimension if all four are arrays of one length over 1."""
    def flat(x):
        return [float(v) for y in x for v in flat(y)] if isinstance(x, list) else [float(x)]

    try:
        four = [flat(raw[k]) for k in ("min", "max", "mean", "std")]
    except (KeyError, TypeError, ValueError):
        return None
    if not dims:
        return tuple(v[0] for v in four) if all(four) else None
    n = {len(v) for v in four}
    return [(i, *(v[i] for v in four)) for i in range(len(four[0]))] if len(n) == 1 and n != {1} else None


def licence(path: str) -> str | None:
    card = os.path.join(path, "README.md")
    if not os.path.exists(card):
        return None
    with open(card, encoding="utf-8", errors="replace") as f:
        lines = f.read().split("\n")
    if not lines or lines[0].strip() != "---":
        return None
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return None
        if line.startswith("license:"):
            value = line.partition(":")[2].strip().strip("\"'")
            if value:
                return value
            first = lines[i + 1].strip() if i + 1 < len(lines) else ""
            return first[1:].strip().strip("\"'") or None if first.startswith("-") else None
    return None


def declared_media(feature: dict) -> tuple[str | None, int | None, int | None, float | None]:
    """codec, width, height and fps that a video feature declares; the size else from its shape, by the names of its axes."""
    info, shape, names = feature.get("info") or feature.get("video_info") or {}, feature.get("shape"), feature.get("names")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    pixels = lambda x: int(x) if number(x) and 1 <= x < 1 << 63 and x == int(x) else None

    def axis(name: str) -> int | None:
        if not isinstance(shape, list):
            return None
        if isinstance(names, list) and len(names) == len(shape):
            return next((x for n, x in zip(names, shape, strict=True) if str(n).strip().lower().startswith(name)), None)
        last = len(shape) == 2 or len(shape) == 3 and shape[2] in (1, 3, 4)
        return shape[{"height": 0, "width": 1}[name]] if last else None

    codec, fps = info.get("video.codec"), info.get("video.fps")
    return codec if isinstance(codec, str) else None, pixels(info.get("video.width")) or axis("width"), pixels(info.get("video.height")) or axis("height"), float(fps) if number(fps) else None


def video_files(path: str, names: set[str]) -> tuple[list[tuple[str, int, str]], set[str]]:
    """(feature, episode, file) of the files under ``videos``, and features with files that belong to no one episode.

    A file belongs to the feature that a part of its path names. Folders that are links are not gone into.
    """
    found, shared = [], set()
    root = os.path.join(path, "videos")
    for folder, _, files in os.walk(root):
        for n in sorted(files):
            stem, ext = os.path.splitext(n)
            file = os.path.join(folder, n)
            name = next((c for c in os.path.relpath(file, root).split(os.sep) if c in names), None)
            if ext.lower() not in MEDIA or name is None:
                continue
            number = stem.removeprefix("episode_")
            if number != stem and number.isascii() and number.isdigit():
                found.append((name, int(number), file))
            else:
                shared.add(name)
    return found, shared


_PARAMS = pa.struct([("codec", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("fps", pa.float64())])
_PROBED = pa.schema([("ep_ord", pa.int64()), ("st_ord", pa.int64()), ("media", pa.struct([("uri", pa.string()), ("declared", _PARAMS), ("observed", _PARAMS), ("status", pa.string()), ("reason", pa.string()), ("frame_count", pa.int64())]))])
_PARAMS_SQL = "struct<codec:string,width:long,height:long,fps:double>"


def media(seen: DataFrame, path: str, features: dict[str, tuple[int, tuple]]) -> DataFrame:
    """(ep_ord, st_ord, media) of video features (their number, what they declare): tasks read the headers of the files."""
    spark = seen.sparkSession
    files, shared = video_files(path, set(features))
    sibling = {}
    for name, _, file in sorted(files, key=lambda x: (x[0], x[1])):
        sibling.setdefault(name, file)
    kinds = "st_ord long, name string, codec string, width long, height long, fps double, sibling string, shared boolean"
    wanted = spark.createDataFrame([(k, n, *params, sibling.get(n), n in shared) for n, (k, params) in features.items()], kinds)
    there = spark.createDataFrame([(features[n][0], e, f) for n, e, f in files], "st_ord long, ep_ord long, file string")
    rows = seen.crossJoin(F.broadcast(wanted)).join(there, ["ep_ord", "st_ord"], "left").select("ep_ord", "st_ord", "name", "codec", "width", "height", "fps", "sibling", "shared", "file")
    root = os.path.realpath(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ep, st, name, codec, width, height, fps, near, many, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file is None and near:  # as the files beside it are called
                    stem, ext = os.path.splitext(os.path.basename(near))
                    file = os.path.join(os.path.dirname(near), f"episode_{ep:0{len(stem) - len('episode_')}d}{ext}")
                file = file or os.path.join(path, "videos", name)
                status, reason, got = "read", None, {}
                if many:
                    status, reason, file = "unattributable", "media files are not laid out one for each episode", None
                elif not os.path.realpath(file).startswith(root + os.sep):
                    status, reason = "unreadable", "its path leads out of the dataset"
                elif not os.path.isfile(file):
                    status = "missing"
                else:
                    try:
                        got = mp4.probe(file)
                    except mp4.Unreadable as e:
                        status, reason = "unreadable", str(e)
                uri = os.path.relpath(file, path).replace(os.sep, "/") if file else f"videos/**/{name}/"
                out.append({"ep_ord": ep, "st_ord": st, "media": {"uri": uri, "declared": {"codec": codec, "width": width, "height": height, "fps": fps}, "observed": {k: got.get(k) for k in ("codec", "width", "height", "fps")}, "status": status, "reason": reason, "frame_count": got.get("frame_count")}})
            yield pa.RecordBatch.from_pylist(out, schema=_PROBED)

    return rows.mapInArrow(run, f"ep_ord long, st_ord long, media struct<uri:string,declared:{_PARAMS_SQL},observed:{_PARAMS_SQL},status:string,reason:string,frame_count:long>")


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    info = _json(os.path.join(path, "meta", "info.json"), True)
    if not str(info.get("codebase_version", "")).lstrip("v").startswith("3"):
        raise SourceError("only version 3 of the layout is read")
    features = {k: v for k, v in info.get("features", {}).items() if k not in BOOKS}
    fps = float(info.get("fps") or 0) or None
    rec = Recording(spark, dataset_id(path), "lerobot")
    declared = {}
    for row in _lines(os.path.join(path, "meta", "episodes.jsonl"), True):
        if row["episode_index"] in declared:
            raise SourceError(f"episode {row['episode_index']} is declared twice")
        declared[int(row["episode_index"])] = int(row["length"])
    tasks = {int(t["task_index"]): str(t["task"]) for t in _lines(os.path.join(path, "meta", "tasks.jsonl"), False) if "task_index" in t and "task" in t}
    try:
        stored = _json(os.path.join(path, "meta", "stats.json")) or {}
    except SourceError:  # the recording is read all the same, and says that its statistics are not
        stored, broken = {}, ["meta/stats.json"]
    else:
        broken = []
    totals = [(f"declared_{k}", str(info[k])) for k in ("total_episodes", "total_frames") if k in info]
    rec.put("metadata", spark.createDataFrame(totals, "key string, value string"))
    lic = licence(path)
    rec.put("provenance", spark.createDataFrame([("dataset", 0, "license", lic, "known")] if lic else [], "scope_kind string, record_id long, key string, value string, class string"))
    files, rec.unread = shards(path)
    rec.unread += broken
    names = sorted(features)
    number = {n: k for k, n in enumerate(names)}

    streams = [(n, number[n], modality(n, str(f.get("dtype"))), None if f.get("dtype") is None else str(f["dtype"]), f.get("shape"), _stats(stored.get(n), False), _stats(stored.get(n), True)) for n, f in ((n, features[n]) for n in names)]
    stats = T.StructType([T.StructField(k, T.DoubleType()) for k in ("min", "max", "mean", "std")])
    dims = T.ArrayType(T.StructType([T.StructField("dim", T.LongType()), *stats.fields]))
    kinds = T.StructType([T.StructField("name", T.StringType()), T.StructField("st_ord", T.LongType()), T.StructField("modality", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("stats", stats), T.StructField("dim_stats", dims)])
    by_name = spark.createDataFrame(streams, kinds).withColumn("declared_rate_hz", F.lit(fps)).withColumn("clock_id", F.lit("lerobot")).withColumn("clock_kind", F.lit("measured"))

    if o.metadata_only:
        total = int(info.get("total_episodes") or 0)
        if not declared and total > 1_000_000:
            raise SourceError("too many declared episodes to derive them")
        indices = sorted(declared) or list(range(total))
        if len(indices) * len(names) > o.max_frames:
            raise SourceError("more streams than the frame budget")
        rec.coverage = "metadata-only"
        if not declared:  # the episodes were made from the total, which can't be tested by them
            rec.put("metadata", rec.metadata.where("key <> 'declared_total_episodes'"))
        eps = spark.createDataFrame([(i, i, declared.get(i)) for i in indices], "ep_ord long, episode long, declared_frame_count long")
        return rec.put("episodes", eps).put("streams", eps.select("ep_ord").crossJoin(by_name))  # a row for each is what is asked for

    if not files:
        raise SourceError("no data files")
    rows = spark.read.parquet(*files)
    if "episode_index" not in rows.columns:
        raise SourceError("rows without episode_index")
    rows = rows.withColumn("_order", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    if o.sampled:
        indices = sorted(declared) or [r[0] for r in rows.select("episode_index").distinct().collect()]
        chosen = sampling.first(indices, o.first) if o.first is not None else sampling.fraction(indices, o.fraction, o.seed)
        rows, rec.coverage = rows.where(F.col("episode_index").isin(chosen)), "sample"
    have = [n for n in names if n in rows.columns]
    rec.notes = {"omitted": [n for n in names if n not in rows.columns], "unmapped": [c for c in rows.columns if c not in features and c not in BOOKS and c != "_order"]}
    n_rows = rows.agg(F.count("*"), F.min("episode_index")).first()
    if (n_rows[0] or 0) * max(1, len(names)) > o.max_frames:
        raise SourceError("more frames than the frame budget")
    if n_rows[1] is not None and n_rows[1] < 0:
        raise SourceError("a negative episode index")
    step = F.round(F.col("frame_index") / fps * 1e9).cast("long") if fps and "frame_index" in rows.columns else F.lit(None).cast("long")
    if "timestamp" in rows.columns:
        if not isinstance(rows.schema["timestamp"].dataType, (T.DoubleType, T.FloatType)):
            raise SourceError("timestamp is no column of floats")
        t = F.col("timestamp").cast("double")
        ts = F.when(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 9.2e9), F.round(t * 1e9).cast("long")).otherwise(step)
    else:
        ts = step
    # A row is a frame of every declared feature; what has no column (pictures in video files) has no fingerprint.
    digest = lambda n: F.when(F.col(f"`{n}`").isNotNull(), F.sha2(F.to_json(F.struct(F.col(f"`{n}`").alias("v"))), 256)) if n in have else F.lit(None).cast("string")
    cell = lambda n: F.struct(F.lit(number[n]).cast("long").alias("st_ord"), digest(n).alias("content_hash"))
    frames = rows.select(F.col("episode_index").cast("long").alias("ep_ord"), ts.alias("ts"), "_order", F.explode(F.array(*map(cell, names))).alias("c")).select("ep_ord", "c.st_ord", "_order", "ts", "c.content_hash")
    rec.put("frames", frames.withColumn("frame_idx", F.expr("row_number() OVER (PARTITION BY ep_ord, st_ord ORDER BY _order) - 1")))
    seen = rows.select(F.col("episode_index").cast("long").alias("ep_ord")).distinct()
    length = spark.createDataFrame(list(declared.items()), "ep_ord long, declared_frame_count long")
    eps = seen.join(length, "ep_ord", "left")
    if "task_index" in rows.columns and tasks:
        first = rows.groupBy(F.col("episode_index").cast("long").alias("ep_ord")).agg(F.min_by("task_index", "_order").cast("long").alias("task_index"))
        eps = eps.join(first.join(spark.createDataFrame(list(tasks.items()), "task_index long, task string"), "task_index", "left").select("ep_ord", "task"), "ep_ord", "left")
        change = rows.select(F.col("episode_index").cast("long").alias("ep_ord"), F.col("task_index").cast("long").alias("task_index"), ts.alias("ts"), F.expr("lag(task_index) OVER (PARTITION BY episode_index ORDER BY _order)").alias("before")).where("before <> task_index")
        rec.put("labels", change.join(spark.createDataFrame(list(tasks.items()), "task_index long, value string"), "task_index").withColumn("key", F.lit("language")))
    rec.put("episodes", eps.withColumn("episode", F.col("ep_ord")))
    # Recomputed statistics of numeric features: all of them in one pass over (feature, dimension).
    numeric = lambda t: isinstance(t, T.NumericType)
    arrays = []
    for n in have:
        t = rows.schema[n].dataType
        value = F.array(F.col(f"`{n}`").cast("double")) if numeric(t) else F.transform(F.col(f"`{n}`"), lambda x: x.cast("double")) if isinstance(t, T.ArrayType) and numeric(t.elementType) else None
        if value is not None:
            arrays.append(F.struct(F.lit(number[n]).cast("long").alias("st_ord"), value.alias("v")))
    full = seen.crossJoin(F.broadcast(by_name))
    if arrays:
        s = dimension_stats(rows.select(F.explode(F.array(*arrays)).alias("x")).select("x.*"), ("st_ord",), "v")
        one = F.struct("min", "max", "mean", "std")
        o_dims = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("long").alias("dim"), "min", "max", "mean", "std")))
        g = s.groupBy("st_ord").agg(F.max(F.when(F.col("dim") == 0, one)).alias("observed_stats"), o_dims.alias("observed_dim_stats"), F.sum("non_finite").alias("observed_non_finite"))
        w = worst_saturation(s, ("st_ord",)).select("st_ord", F.struct("n", "at_min", "at_max", "min", "max", F.col("dim").cast("long").alias("dim")).alias("observed_saturation"))
        full = full.join(F.broadcast(g.join(w, "st_ord")), "st_ord", "left")  # a row for each feature
    videos = {n: (number[n], declared_media(features[n])) for n in names if features[n].get("dtype") == "video"}
    if videos:
        full = full.join(media(seen, path, videos), ["ep_ord", "st_ord"], "left")
    return rec.put("streams", full)


FORMAT = Format("lerobot", lambda p: os.path.isfile(os.path.join(p, "meta", "info.json")), read, metadata_only=True, samples=True)
