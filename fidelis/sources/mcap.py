"""MCAP logs: one episode, a stream for each topic, a frame for each message at its log time.

The driver walks the heads of a file's records by seeks and reads what is small: channels, metadata, attachments' names.
Chunks are rows (where they begin, how long they are) that tasks read, inflate to the declared size at most, and decode,
so frames never pass the driver. Of known messages only the head is read, see ``cdr``.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.model import Recording
from fidelis.sources import cdr, compression, scenario
from fidelis.sources.registry import Format, Options, SourceError, dataset_id

MAGIC = b"\x89MCAP0\r\n"
# Kinds of records.
HEADER, SCHEMA, CHANNEL, MESSAGE, CHUNK, ATTACHMENT, METADATA = 1, 3, 4, 5, 6, 9, 12
# Words in the name of a schema or topic that tell what a stream is, the first that fits.
WORDS = (
    ("video", ("image", "camera", "compressedimage", "video")),
    ("point-cloud", ("pointcloud", "laserscan", "lidar", "radar", "velodyne")),
    ("imu", ("imu",)),
    ("gnss", ("navsatfix", "gnss", "gps", "/fix")),
    ("ego-pose", ("odometry", "odom")),
    ("can-signal", ("can_msgs", "can_frame", "canbus", "/can/")),
    ("audio", ("audio",)),
    ("tactile-force-torque", ("wrench", "force", "torque", "tactile", "contact")),
    ("action", ("command", "/cmd", "action", "setpoint", "control")),
)
ROWS = "chunk long, place long, topic string, schema string, ts long, content_hash string, size long, frame_id string, fields array<struct<name:string,dtype:string>>, camera array<double>, pose array<double>, edges array<struct<parent:string,child:string>>"


def modality(schema: str, topic: str) -> str:
    text = f"{schema} {topic}".lower()
    return next((kind for kind, words in WORDS if any(w in text for w in words)), "scalar-state")


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    if at + 4 + n > len(data):
        raise SourceError("a text runs over the end of its record")
    return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


def _pairs(data: bytes, at: int) -> list[tuple[str, str]]:
    end, out = at + 4 + struct.unpack_from("<I", data, at)[0], []
    at += 4
    while at < end:
        key, at = _text(data, at)
        value, at = _text(data, at)
        out.append((key, value))
    return out


def heads(path: str) -> Iterator[tuple[int, int, int]]:
    """(kind, begin, length) of the records of a file, up to one that the file ends in."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise SourceError("no MCAP file")
        at = len(MAGIC)
        while at + 9 <= size:
            f.seek(at)
            kind, n = struct.unpack("<BQ", f.read(9))
            if n > size:
                raise SourceError(f"a record at byte {at} declares {n} bytes, and the whole file has {size}")
            if at + 9 + n > size:
                return
            yield kind, at + 9, n
            at += 9 + n


def _inner(data: bytes, declared: int) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        if n > declared:
            raise SourceError(f"a record in a chunk declares {n} bytes, and the chunk has {declared}")
        if at + 9 + n > len(data):
            return
        yield kind, data[at + 9 : at + 9 + n]
        at += 9 + n


def unpacked(chunk: bytes) -> tuple[bytes, int]:
    """The records of a chunk, and the size it declares for them."""
    declared = struct.unpack_from("<Q", chunk, 16)[0]
    codec, at = _text(chunk, 28)
    data = chunk[at + 8 :]
    inflate = {"": lambda d, _: d, "zstd": compression.zstd, "lz4": compression.lz4_frame}.get(codec)
    if inflate is None:
        raise SourceError(f"chunks compressed by {codec} are not read")
    try:
        return inflate(data, declared), declared
    except compression.Corrupt as e:
        raise SourceError(f"a chunk is corrupt: {e}") from None


def _schema(body: bytes) -> tuple[int, str]:
    return struct.unpack_from("<H", body)[0], _text(body, 2)[0]


def _channel(body: bytes) -> tuple[int, int, str]:
    number, schema = struct.unpack_from("<HH", body)
    return number, schema, _text(body, 4)[0]


def _message(body: bytes, channels: dict[int, tuple[int, str]], schemas: dict[int, str]) -> tuple:
    """What a row holds from ``topic`` on."""
    number, _, log_time = struct.unpack_from("<HIQ", body)
    if number not in channels:
        raise SourceError(f"a message of channel {number}, which nothing declares")
    schema_id, topic = channels[number]
    schema, data = schemas.get(schema_id, ""), body[22:]
    kind = schema.rpartition("/")[2]
    edges = cdr.read(cdr.transforms, data) if kind == "TFMessage" else None
    return (
        topic, schema, min(log_time, 2**63 - 1), hashlib.sha256(data).hexdigest(), len(data), cdr.read(cdr.frame_id, data),
        cdr.read(cdr.point_fields, data) if kind == "PointCloud2" else None, cdr.read(cdr.camera, data) if kind == "CameraInfo" else None,
        cdr.read(cdr.odometry, data) if kind == "Odometry" else None, edges and [(p, c) for p, c, _ in edges],
    )


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    size = os.path.getsize(path)
    header, pairs, attached, chunks, loose = None, [], [], [], []
    channels: dict[int, tuple[int, str]] = {}
    schemas: dict[int, str] = {}
    declared = 0
    with open(path, "rb") as f:
        body = lambda at, n: (f.seek(at), f.read(n))[1]
        for kind, at, n in heads(path):
            if kind == CHUNK:
                chunks.append((len(chunks), at, n))
                declared += struct.unpack("<Q", body(at + 16, 8))[0] if n >= 24 else 0
                o.expanded(declared, size)
            elif kind == MESSAGE:  # outside chunks: one row each would be many, so neighbours share one
                if loose and loose[-1][1] + loose[-1][2] == at - 9 and loose[-1][2] < 4 << 20:
                    loose[-1][2] += n + 9
                else:
                    loose.append([len(chunks) + len(loose), at - 9, n + 9])
            elif kind == SCHEMA:
                schemas.setdefault(*_schema(body(at, n)))
            elif kind == CHANNEL:
                number, schema, topic = _channel(body(at, n))
                channels.setdefault(number, (schema, topic))
            elif kind == HEADER and header is None:
                profile, end = _text(b := body(at, n), 0)
                header = (profile, _text(b, end)[0])
            elif kind == METADATA:
                name, end = _text(b := body(at, n), 0)
                pairs += [(name, k, v) for k, v in _pairs(b, end)]
            elif kind == ATTACHMENT:
                name, end = _text(b := body(at, min(n, 1 << 16)), 16)
                attached.append((name, _text(b, end)[0]))

    def decoded(whole: bool):
        """Rows of the chunks; of channels and schemas alone, unless ``whole``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, at, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with open(path, "rb") as f:
                        f.seek(at)
                        data = f.read(n)
                    records, most = unpacked(data) if packed else (data, n)
                    own_c, own_s, rows = dict(channels), dict(schemas), []
                    for place, (kind, body) in enumerate(_inner(records, most)):
                        if kind == SCHEMA:
                            own_s.setdefault(*_schema(body))
                        elif kind == CHANNEL:
                            c, s, topic = _channel(body)
                            own_c.setdefault(c, (s, topic))
                        elif kind == MESSAGE and whole:
                            rows.append((number, place, *_message(body, own_c, own_s)))
                    if not whole:
                        rows = [(c, s, topic, own_s.get(s)) for c, (s, topic) in own_c.items()]
                    names = [x.name for x in schema]
                    for a in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in _named(rows[a : a + 10_000])], schema=schema)

        kinds = ROWS if whole else "channel long, schema long, topic string, name string"
        schema = _MESSAGES if whole else pa.schema([("channel", pa.int64()), ("schema", pa.int64()), ("topic", pa.string()), ("name", pa.string())])
        where = [(k, at, n, True) for k, at, n in chunks] + [(k, at, n, False) for k, at, n in loose]
        source = spark.createDataFrame(where, "number long, at long, n long, packed boolean")
        return source.repartition(max(1, min(len(where), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, kinds)

    if not channels and chunks:  # no summary: a channel may be declared in an earlier chunk than its messages
        for r in decoded(False).distinct().collect():  # as many as there are channels
            channels.setdefault(r["channel"], (r["schema"], r["topic"]))
            if r["name"] is not None:
                schemas.setdefault(r["schema"], r["name"])
    rows = decoded(True).persist(StorageLevel.MEMORY_AND_DISK)
    if rows.count() > o.max_frames:
        raise SourceError("more frames than the frame budget")
    o.expanded(rows.agg(F.sum("size")).first()[0] or 0, size)

    rec = Recording(spark, dataset_id(path), "mcap")
    order = F.struct("chunk", "place")
    topics = rows.groupBy("topic").agg(F.min_by("schema", order).alias("schema"), F.min_by("frame_id", F.when(F.col("frame_id").isNotNull(), order)).alias("frame_id"), F.min_by("fields", F.when(F.col("fields").isNotNull(), order)).alias("point_fields"), F.max(F.col("camera").isNotNull()).alias("camera")).orderBy("topic").collect()  # as many as there are topics
    kinds = "st_ord long, name string, modality string, frame_id string, point_fields array<struct<name:string,dtype:string>>"
    streams = spark.createDataFrame([(k, r["topic"], modality(r["schema"], r["topic"]), r["frame_id"], r["point_fields"]) for k, r in enumerate(topics)], kinds)
    rec.put("streams", streams.withColumn("ep_ord", F.lit(0)).withColumn("clock_id", F.lit("mcap-log")).withColumn("clock_kind", F.lit("measured")))
    ends = rows.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    rec.put("episodes", ends.withColumn("ep_ord", F.lit(0)).withColumn("episode", F.lit(0)))
    numbers = F.broadcast(streams.select("st_ord", F.col("name").alias("topic")))  # a row for each topic
    frames = rows.join(numbers, "topic").withColumn("frame_idx", F.expr("row_number() OVER (PARTITION BY st_ord ORDER BY chunk, place) - 1"))
    rec.put("frames", frames.withColumn("ep_ord", F.lit(0)))
    poses = rows.where("pose IS NOT NULL").select(F.lit(0).alias("ep_ord"), F.expr("row_number() OVER (ORDER BY ts, chunk, place) - 1").alias("idx"), "ts", *(F.col("pose")[k].alias(c) for k, c in enumerate("xyz")))
    rec.put("ego_poses", poses)
    rec.put("transforms", rows.select(F.explode("edges").alias("e")).select(F.col("e.parent").alias("parent_frame"), F.col("e.child").alias("child_frame")).distinct())
    rec.put("intrinsics", spark.createDataFrame([(r["topic"],) for r in topics if r["camera"]], "stream string"))

    found, labels = scenario.elements([(k, v) for _, k, v in pairs], os.path.dirname(path))
    metadata = [("source_format", "mcap")]
    if header and header[1].strip():
        metadata.append(("mcap_library", header[1]))
        found.insert(0, ("recorder", header[1], "known"))
    if header and header[0].strip():
        metadata.append(("mcap_profile", header[0]))
    metadata += [(f"mcap_meta.{n}.{k}", v) for n, k, v in pairs if v.strip()] + [(f"mcap_attachment.{n}", kind) for n, kind in attached]
    calibrated = next((n for n, _ in attached if "calib" in n.lower()), None)
    if calibrated and not any(k == "calibration" for k, _, _ in found):
        found.append(("calibration", calibrated, "asserted"))
    found.insert(0, ("source_format", "mcap", "known"))
    rec.put("metadata", spark.createDataFrame(metadata, "key string, value string"))
    rec.put("provenance", spark.createDataFrame([("dataset", 0, *x) for x in found], "scope_kind string, record_id long, key string, value string, class string"))
    rec.put("labels", spark.createDataFrame([(0, k, v) for k, v in labels], "ep_ord long, key string, value string"))
    return rec


_MESSAGES = pa.schema([
    ("chunk", pa.int64()), ("place", pa.int64()), ("topic", pa.string()), ("schema", pa.string()), ("ts", pa.int64()), ("content_hash", pa.string()), ("size", pa.int64()), ("frame_id", pa.string()),
    ("fields", pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string())]))), ("camera", pa.list_(pa.float64())), ("pose", pa.list_(pa.float64())),
    ("edges", pa.list_(pa.struct([("parent", pa.string()), ("child", pa.string())]))),
])


def _named(rows: list[tuple]) -> Iterator[tuple]:
    """Rows whose pairs (point fields, edges) are named structs."""
    for r in rows:
        if len(r) == len(_MESSAGES):
            fields, edges = r[8], r[11]
            yield (*r[:8], fields and [{"name": n, "dtype": d} for n, d in fields], *r[9:11], edges and [{"parent": p, "child": c} for p, c in edges])
        else:
            yield r


FORMAT = Format("mcap", lambda p: p.endswith(".mcap") and os.path.isfile(p), read)
