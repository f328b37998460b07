"""Episode datasets in TFRecord shards beside ``dataset_info.json`` and ``features.json``: one record is one episode.

The driver reads the two manifests and numbers the records: tasks walk the length prefixes of a shard each. The records
are rows then (shard, where, how long), whatever shard they come from, and tasks check, parse and hash them, so a large
shard is no single task. The timeline is the step's number; nothing here has a clock.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.functions import sampling
from fidelis.model import Recording
from fidelis.sources.compression import masked_crc32c
from fidelis.sources.registry import Format, Options, SourceError, dataset_id

# Where steps and the name of an episode's source are, and leaves that hold an instruction.
STEPS, SOURCE = "steps/", "episode_metadata/file_path"
INSTRUCTIONS = ("language_instruction", "natural_language_instruction")
#: Episodes that a sample may be ranked among.
RANKED = 1_000_000
_SHARD = re.compile(r"(.*?)\.tfrecord-\d+-of-\d+")


class Malformed(ValueError):
    """Bytes that are no record, or no example."""


@dataclass(frozen=True)
class Leaf:
    path: str
    in_sequence: bool
    dtype: str | None
    shape: tuple[int, ...]
    width: int  # values of one step
    modality: str


def _dims(shape) -> list[int] | None:
    """None where a dimension isn't known."""
    if shape is None:
        return []
    try:
        return [int(str(d).strip()) for d in shape.get("dimensions", [])]
    except (AttributeError, TypeError, ValueError):
        return None


def _dtype(raw) -> str | None:
    return (raw.strip().lower().removeprefix("dt_") or None) if isinstance(raw, str) else None


def leaves(node: dict, path: str = "", inside: bool = False) -> Iterator[Leaf | tuple[str, str]]:
    """The leaves of a tree of features; (path, why) for what is no stream."""
    at = lambda name: f"{path}/{name}" if path else name
    kind = "action" if path.rpartition("/")[2] == "action" else "scalar-state"
    if "featuresDict" in node:
        children = node["featuresDict"].get("features", {})
        if not isinstance(children, dict):
            yield path, "its features are no object"
            return
        for name in sorted(children):
            yield from leaves(children[name], at(name), inside)
    elif "sequence" in node:
        if inside:
            yield path, "a sequence in a sequence is ragged"
        elif "feature" not in node["sequence"]:
            yield path, "a sequence of nothing"
        else:
            yield from leaves(node["sequence"]["feature"], path, True)
    elif "image" in node:
        yield Leaf(path, inside, _dtype(node["image"].get("dtype")), tuple(_dims(node["image"].get("shape")) or ()), 1, "video")
    elif "text" in node:
        yield Leaf(path, inside, "string", (), 1, kind)
    elif "tensor" in node:
        t = node["tensor"]
        dims, encoded = _dims(t.get("shape")), str(t.get("encoding") or "none").strip().lower() not in ("", "none")
        width = 1 if encoded else None if dims is None else int(np.prod(dims, dtype=object)) if dims else 1
        if not width or width < 0 or width >= 1 << 64:
            yield path, "its shape doesn't tell how many values a step has"
        else:
            yield Leaf(path, inside, _dtype(t.get("dtype")), tuple(dims or ()), width, kind)
    elif "classLabel" in node:
        yield Leaf(path, inside, "int64", (), 1, "scalar-state")
    else:
        yield path, "no tensor, image, text or class label"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("a number runs over its end")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & (1 << 64) - 1, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise Malformed("a field of an unknown kind")
        if at > len(data):
            raise Malformed("a field runs over its end")
        yield tag >> 3, kind, value


def _list(kind: int, data: bytes):
    """A list of bytes (1), of floats (2) or of integers (3); numbers may be packed or not."""
    out: list = []
    for number, wire, value in _fields(data):
        if number != 1:
            continue
        if kind == 1 and wire == 2:
            out.append(value)
        elif kind == 2 and wire in (2, 5) and len(value) % 4 == 0:
            out.append(value)
        elif kind == 3 and wire == 0:
            out.append(value)
        elif kind == 3 and wire == 2:
            at = 0
            while at < len(value):
                x, at = _varint(value, at)
                out.append(x)
        else:
            raise Malformed("a list of another kind")
    return np.frombuffer(b"".join(out), "<f4") if kind == 2 else np.array(out, np.uint64) if kind == 3 else out


def example(data: bytes) -> dict[str, list | np.ndarray]:
    """The features of a record; one that is there twice is refused."""
    out: dict[str, list | np.ndarray] = {}
    for number, wire, features in _fields(data):
        if (number, wire) != (1, 2):
            continue
        for number, wire, entry in _fields(features):
            if (number, wire) != (1, 2):
                continue
            key, value = None, b""
            for number, wire, part in _fields(entry):
                if wire == 2 and number in (1, 2):
                    key, value = (part.decode("utf-8"), value) if number == 1 else (key, part)
            if key is None or key in out:
                raise Malformed("a feature without a name, or twice")
            kinds = [(number, part) for number, wire, part in _fields(value) if wire == 2 and number in (1, 2, 3)]
            if len(kinds) > 1:
                raise Malformed("a feature of two kinds")
            out[key] = _list(*kinds[0]) if kinds else []
    return out


def _digest(values, a: int, z: int) -> str:
    h = hashlib.sha256()
    if isinstance(values, np.ndarray):
        h.update(values[a:z].tobytes())
    else:
        for v in values[a:z]:
            h.update(len(v).to_bytes(8, "little") + v)
    return h.hexdigest()


def heads(path: str) -> Iterator[tuple[int, int]]:
    """(begin, length) of the payload of each record of a shard; its length's checksum is tested."""
    size, at = os.path.getsize(path), 0
    with open(path, "rb") as f:
        while at < size:
            f.seek(at)
            head = f.read(12)
            if len(head) < 12:
                raise Malformed(f"record at byte {at}: the shard ends inside its length")
            n, check = struct.unpack("<QI", head)
            if masked_crc32c(head[:8]) != check:
                raise Malformed(f"record at byte {at}: the checksum of its length is wrong")
            if at + 16 + n > size:
                raise Malformed(f"record at byte {at}: {n} bytes are declared, past the end of {size}")
            yield at + 12, n
            at += 16 + n


def steps_of(data: bytes, wanted: list[Leaf]) -> tuple[int, list[tuple[int, int, str]], str | None, list[tuple[int, str]], list[str]]:
    """Of a record: steps; (leaf, step, digest); its source; (step, text) where the instruction begins or changes; its keys."""
    values = example(data)
    count = {}
    for k, leaf in enumerate(wanted):
        if leaf.path in values:
            n = len(values[leaf.path])
            if n % leaf.width:
                raise Malformed(f"{leaf.path} has {n} values, which are no multiple of the {leaf.width} of a step")
            count[k] = n // leaf.width
    if len(set(count.values())) > 1:
        raise Malformed("its features have different numbers of steps")
    steps = next(iter(count.values()), 0)
    frames = [(k, s, _digest(values[wanted[k].path], s * wanted[k].width, (s + 1) * wanted[k].width)) for k in count for s in range(steps)]
    said: list[tuple[int, str]] = []
    for k in count:
        v = values[wanted[k].path]
        if wanted[k].path.rpartition("/")[2] in INSTRUCTIONS and isinstance(v, list):
            before = None
            for s in range(steps):
                try:
                    text = v[s].decode("utf-8").strip()
                except UnicodeDecodeError:
                    continue
                if text and text != before:
                    said.append((s if before is not None else -1, text))
                    before = text
    source = values.get(SOURCE)
    try:
        source = source[0].decode("utf-8").strip() or None if isinstance(source, list) and source else None
    except UnicodeDecodeError:
        source = None
    return steps, frames, source, said, sorted(values)


_FRAMES = pa.schema([("episode", pa.int64()), ("leaf", pa.int64()), ("step", pa.int64()), ("hash", pa.string()), ("text", pa.string())])


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    load = lambda name: json.load(open(os.path.join(path, name), encoding="utf-8"))  # noqa: E731, SIM115
    try:
        info, tree = load("dataset_info.json"), load("features.json")
    except ValueError as e:
        raise SourceError(f"a manifest is no JSON: {e}") from None
    kind = str(info.get("fileFormat") or "tfrecord").strip() or "tfrecord"
    if kind != "tfrecord":
        raise SourceError(f"files of the format {kind} are not read")
    found = list(leaves(tree))
    unmapped = [p for p, _ in (x for x in found if isinstance(x, tuple))] + [x.path for x in found if isinstance(x, Leaf) and x.in_sequence and not x.path.startswith(STEPS)]
    wanted = [x for x in found if isinstance(x, Leaf) and x.in_sequence and x.path.startswith(STEPS)]
    if not wanted:
        raise SourceError("no features of steps, so no timeline")
    # A total only if each split declares all of its shards: a part of it would make a whole dataset look cut off.
    lengths = [s.get("shardLengths") for s in info.get("splits") or []]
    try:
        total = sum(int(n) for x in lengths for n in x) if any(lengths) else None
    except (TypeError, ValueError):
        total = None
    shards = sorted(n for n in os.listdir(path) if _SHARD.fullmatch(n) and os.path.isfile(os.path.join(path, n)))
    if not shards:
        raise SourceError("no shards")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(shard, k, at, n) for k, (at, n) in enumerate(heads(os.path.join(path, name)))]
                for a in range(0, len(rows), 10_000):
                    cols = zip(*rows[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "record", "at", "n"])

    names = spark.createDataFrame(list(enumerate(shards)), "shard long, name string").repartition(len(shards), "shard")
    records = names.mapInArrow(walked, "shard long, record long, at long, n long").persist()
    per_shard = dict(records.groupBy("shard").count().collect())  # a row for each shard
    first, n = [], 0
    for k in range(len(shards)):
        first.append((k, n, shards[k]))
        n += per_shard.get(k, 0)
    begin = F.broadcast(spark.createDataFrame(first, "shard long, first long, name string"))  # a row for each shard
    records = records.join(begin, "shard").select((F.col("first") + F.col("record")).alias("episode"), "name", "at", "n")
    rec = Recording(spark, str(info.get("name") or dataset_id(path)), "rlds")
    if o.sampled:
        if o.fraction is not None and not total:
            raise SourceError("which episodes exist is not declared")
        if (o.first if o.first is not None else total) > RANKED:
            raise SourceError(f"a sample among over {RANKED} episodes")
        chosen = list(range(min(o.first, total if total is not None else o.first))) if o.first is not None else sampling.fraction(list(range(total)), o.fraction, o.seed)
        records, rec.coverage = records.where(F.col("episode").isin(chosen)), "sample"
        total = len(chosen) if total is not None else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for episode, name, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(os.path.join(path, name), "rb") as f:
                    f.seek(at)
                    data, check = f.read(n), f.read(4)
                try:
                    if masked_crc32c(data) != struct.unpack("<I", check)[0]:
                        raise Malformed("the checksum of the payload is wrong")
                    steps, frames, source, said, keys = steps_of(data, wanted)
                except (Malformed, UnicodeDecodeError) as e:
                    raise SourceError(f"{name}, record at byte {at}: {e}") from None
                # Rows of the record itself: its steps and source (-1), texts of instructions (-2), its keys (-3).
                rows = [(episode, -1, steps, None, source), *((episode, -2, s, None, t) for s, t in said), *((episode, -3, 0, None, k) for k in keys), *((episode, k, s, h, None) for k, s, h in frames)]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 10_000], strict=True), _FRAMES, strict=True)], schema=_FRAMES)

    rows = records.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(parsed, "episode long, leaf long, step long, hash string, text string").persist()
    frames = rows.where("leaf >= 0")
    if frames.count() > o.max_frames:
        raise SourceError("more frames than the frame budget")
    order = {x.path: k for k, x in enumerate(sorted(wanted, key=lambda x: x.path))}
    kinds = "leaf long, st_ord long, name string, modality string, dtype string, shape array<long>"
    streams = spark.createDataFrame([(k, order[x.path], x.path.removeprefix(STEPS), x.modality, x.dtype, list(x.shape) or None) for k, x in enumerate(wanted)], kinds)
    eps = rows.where("leaf = -1").select(F.col("episode").alias("ep_ord"), F.col("step").alias("steps"), F.col("text").alias("source"))
    said = rows.where("leaf = -2")
    task = said.where("step = -1").groupBy(F.col("episode").alias("ep_ord")).agg(F.min("text").alias("task"))
    ends = lambda x: F.when(F.col("steps") > 0, x)
    rec.put("episodes", eps.join(task, "ep_ord", "left").select("ep_ord", F.col("ep_ord").alias("episode"), ends(F.lit(0)).alias("start_ts"), ends(F.col("steps") - 1).alias("end_ts"), "task"))
    rec.put("streams", eps.select("ep_ord").crossJoin(F.broadcast(streams)).withColumn("clock_id", F.lit("rlds-step-index")).withColumn("clock_kind", F.lit("step-index")))  # an absent leaf is an empty stream
    numbers = F.broadcast(streams.select("leaf", "st_ord"))
    rec.put("frames", frames.join(numbers, "leaf").select(F.col("episode").alias("ep_ord"), "st_ord", F.col("step").alias("frame_idx"), F.col("step").alias("ts"), F.col("hash").alias("content_hash")))
    rec.put("labels", said.where("step >= 0").select(F.col("episode").alias("ep_ord"), F.lit("language").alias("key"), F.col("text").alias("value"), F.col("step").alias("ts")))
    split = spark.createDataFrame([(k, _SHARD.fullmatch(s)[1].rpartition("-")[2] if "-" in _SHARD.fullmatch(s)[1] else None, s) for k, s in enumerate(shards)], "shard long, split string, name string")
    of = records.join(F.broadcast(split), "name").select(F.col("episode").alias("ep_ord"), F.lit("tfds_split").alias("key"), F.col("split").alias("value")).where("value <> ''")
    own = eps.where("source IS NOT NULL").select("ep_ord", F.lit("upstream").alias("key"), F.col("source").alias("value")).union(of)
    licence = (info.get("redistributionInfo") or info.get("redistribution_info") or {}).get("license")
    top = spark.createDataFrame([("source_format", "rlds")] + ([("license", str(licence))] if licence else []), "key string, value string")
    scope = lambda d, kind, ep: d.select(F.lit(kind).alias("scope_kind"), ep.alias("scope_episode"), (ep + 1).alias("record_id"), "key", "value", F.lit("known").alias("class"))
    rec.put("provenance", scope(top, "dataset", F.lit(-1).cast("long")).withColumn("scope_episode", F.lit(None).cast("long")).unionByName(scope(own, "episode", F.col("ep_ord"))))
    metadata = [("source_format", "rlds"), ("tfds_file_format", kind)] + [(f"tfds_{name}" if name != "citation" else name, str(info[key])) for name, key in (("name", "name"), ("version", "version"), ("module", "moduleName"), ("citation", "citation")) if info.get(key)]
    if total is not None:
        metadata.append(("declared_total_episodes", str(total)))
    rec.put("metadata", spark.createDataFrame(metadata, "key string, value string"))
    declared = {x.path for x in wanted} | {SOURCE}
    keys = [r[0] for r in rows.where("leaf = -3").select("text").distinct().collect()]  # as many as there are features
    rec.notes = {"omitted": [], "unmapped": sorted(unmapped + [k for k in keys if k not in declared])}
    return rec


FORMAT = Format("rlds", lambda p: all(os.path.isfile(os.path.join(p, n)) for n in ("dataset_info.json", "features.json")), read, samples=True)
