"""Readers of containers against files that are written here, byte by byte."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

from fidelis.plans import config, engine
from fidelis.sources import cdr, compression, mcap, mp4, registry, rlds, scenario, zarr
from fidelis.sources.registry import Options, SourceError, open_recording

# --- compression


def test_checksums():
    assert compression.crc32c(b"123456789") == 0xE3069283
    data = bytes(np.random.default_rng(1).integers(0, 256, 50_001, dtype=np.uint8))
    table, c = compression._crc32c_table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8
    assert compression.crc32c(data) == c ^ 0xFFFFFFFF
    a = b = 0  # Fletcher's sums, word by word
    for (w,) in struct.iter_unpack(">H", data + b"\0"):
        a = (a + w) % 65535
        b = (b + a) % 65535
    assert compression.fletcher32(data) == b << 16 | a
    assert compression.fletcher32(b"") == compression.fletcher32(b"\0\0") == 0


def test_lz4_and_blosc():
    # Literals, a copy that overlaps itself, and a last run of literals.
    block = b"\x3f" + b"abc" + b"\x03\x00" + b"\x05" + b"\x20" + b"yz"
    want = b"abc" + (b"abc" * 10)[:24] + b"yz"
    assert compression.lz4_block(block, 100) == want
    frame = b"\x04\x22\x4d\x18" + bytes([0x60, 0x40, 0]) + struct.pack("<I", len(block)) + block + struct.pack("<I", 1 << 31 | 4) + b"tail" + bytes(4)
    assert compression.lz4_frame(frame, 100) == want + b"tail"
    for bad in (lambda: compression.lz4_block(block, 10), lambda: compression.lz4_frame(frame[:-9], 100), lambda: compression.lz4_block(b"\x10a\x09\x00", 50), lambda: compression.zstd(zstandard.compress(bytes(1000)), 999), lambda: compression.zstd(b"no", 9), lambda: compression.deflate(zlib.compress(bytes(1000)), 9)):
        with pytest.raises(compression.Corrupt):
            bad()
    items = np.arange(50, dtype="<i4")
    shuffled = items.view(np.uint8).reshape(-1, 4).T.tobytes()
    assert compression.unshuffle(shuffled, 4) == items.tobytes()
    z = zlib.compress(shuffled)
    chunk = bytes([2, 1, 1 | 16 | 3 << 5, 4]) + struct.pack("<III", 200, 200, 24 + len(z)) + struct.pack("<I", 20) + struct.pack("<I", len(z)) + z
    assert compression.blosc(chunk, 200) == items.tobytes()


# --- MCAP


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def record(kind, body):
    return struct.pack("<BQ", kind, len(body)) + body


class Cdr:
    def __init__(self):
        self.b = b""

    def put(self, form, *values):
        size = struct.calcsize(form)
        self.b += bytes(-len(self.b) % size) + struct.pack(f"<{len(values)}{form}", *values)
        return self

    def text(self, s):
        self.put("I", len(s) + 1)
        self.b += s.encode() + b"\0"
        return self

    def header(self, frame):
        return self.put("I", 7, 8).text(frame)

    def done(self):
        return b"\0\1\0\0" + self.b


def drive(codec="", summary=False):
    """A log of a rig: cloud, imu, gnss, odometry, camera info and transforms."""
    kinds = {1: ("sensor_msgs/msg/PointCloud2", "/lidar"), 2: ("sensor_msgs/msg/Imu", "/imu"), 3: ("sensor_msgs/msg/NavSatFix", "/fix"), 4: ("nav_msgs/msg/Odometry", "/pose"), 5: ("sensor_msgs/msg/CameraInfo", "/camera"), 6: ("tf2_msgs/msg/TFMessage", "/tf")}
    declared = b"".join(record(3, struct.pack("<H", k) + text(s) + text("ros2msg") + text("")) + record(4, struct.pack("<HH", k, k) + text(t) + text("cdr") + text("")) for k, (s, t) in kinds.items())
    message = lambda channel, t, data: record(5, struct.pack("<HIQQ", channel, 0, t, t) + data)
    first, second = declared, b""
    tf = Cdr().put("I", 1).header("base").text("lidar").put("d", 0, 0, 1, 0, 0, 0, 1).done()
    first += message(6, 0, tf)
    cam = Cdr().header("cam").put("I", 4, 6).text("plumb_bob").put("I", 2).put("d", 0.1, 0.2).put("d", *range(9)).done()
    first += message(5, 1, cam)
    for k in range(20):
        t = k * 100_000_000
        cloud = Cdr().header("lidar").put("I", 1, 2, 2)
        for name in ("x", "intensity"):
            cloud.text(name).put("I", 0).put("B", 7).put("I", 1)
        part = message(1, t, cloud.done()) + message(2, t, Cdr().header("imu").done() + bytes([k])) + message(3, t, Cdr().header("gps").done()) + message(4, t, Cdr().header("map").text("base").put("d", 500.0 * k, 0, 0, 0, 0, 0, 1).done())
        if k < 10:
            first += part
        else:
            second += part
    chunks = b""
    for data in (first, second):
        packed = {"": data, "zstd": zstandard.compress(data), "lz4": b"\x04\x22\x4d\x18" + bytes([0x60, 0x40, 0]) + struct.pack("<I", 1 << 31 | len(data)) + data + bytes(4)}[codec]
        chunks += record(6, struct.pack("<QQQI", 0, 9, len(data), 0) + text(codec) + struct.pack("<Q", len(packed)) + packed)
    pairs = lambda d: (lambda b: struct.pack("<I", len(b)) + b)(b"".join(text(k) + text(v) for k, v in d.items()))
    meta = record(12, text("drive") + pairs({"license": "MIT", "weather": "rain", "xosc": "cut_in.xosc", "Vehicle_ID": "v7", "sim": " "}))
    attached = record(9, struct.pack("<QQ", 0, 0) + text("calib.yaml") + text("text/yaml") + struct.pack("<Q", 0) + bytes(4))
    tail = record(15, bytes(4)) + (declared if summary else b"") + record(2, bytes(20))
    return mcap.MAGIC + record(1, text("ros2") + text("rec 1.0")) + chunks + meta + attached + tail + mcap.MAGIC


@pytest.mark.parametrize(("codec", "summary"), [("", False), ("zstd", True), ("lz4", False)])
def test_mcap(spark, tmp_path, codec, summary):
    path = tmp_path / "drive.mcap"
    path.write_bytes(drive(codec, summary))
    (tmp_path / "cut_in.xosc").write_text('<?xml version="1.0"?><!-- <FileHeader revMajor="9" revMinor="9"/> --><OpenSCENARIO><FileHeader author="x" revMajor="1" revMinor="2"/></OpenSCENARIO>')
    rec = open_recording(spark, str(path))
    s = {r["name"]: r for r in rec.streams.collect()}
    assert {n: r["modality"] for n, r in s.items()} == {"/lidar": "point-cloud", "/imu": "imu", "/fix": "gnss", "/pose": "ego-pose", "/camera": "video", "/tf": "scalar-state"}
    assert s["/lidar"]["frame_id"] == "lidar" and [tuple(f) for f in s["/lidar"]["point_fields"]] == [("x", "float32"), ("intensity", "float32")]
    frames = rec.frames.where(f"st_ord = {s['/imu']['st_ord']}").orderBy("frame_idx").collect()
    assert [f["ts"] for f in frames] == [k * 100_000_000 for k in range(20)]
    assert frames[3]["content_hash"] == hashlib.sha256(Cdr().header("imu").done() + bytes([3])).hexdigest()
    assert [(p["ts"], p["x"]) for p in rec.ego_poses.orderBy("idx").collect()][:2] == [(0, 0.0), (100_000_000, 500.0)]
    assert [tuple(t) for t in rec.transforms.collect()] == [("base", "lidar")] and [r[0] for r in rec.intrinsics.collect()] == ["/camera"]
    known = {(r["key"], r["value"], r["class"]) for r in rec.provenance.collect()}
    assert {("license", "MIT", "known"), ("platform", "v7", "known"), ("recorder", "rec 1.0", "known"), ("calibration", "calib.yaml", "asserted"), ("scenario_ref", "cut_in.xosc", "known"), ("scenario_version", "1.2", "known")} <= known
    assert [(r["key"], r["value"]) for r in rec.labels.collect()] == [("weather", "rain")]
    v = engine.run(rec, config.parse('only_checks = ["autonomy.ego-pose-continuity", "autonomy.sensor-frame-resolution"]'))
    assert {"EGO_POSE_CONTINUITY", "SENSOR_FRAME_UNKNOWN"} <= {f.code for f in v.findings} and not v.errored


def test_mcap_that_lies(spark, tmp_path):
    path = tmp_path / "x.mcap"
    good = drive("zstd")
    for bad in (
        b"no magic" + good[8:],
        mcap.MAGIC + struct.pack("<BQ", 1, 1 << 40) + bytes(20),
        mcap.MAGIC + record(6, struct.pack("<QQQI", 0, 0, 1 << 40, 0) + text("zstd") + bytes(8)),
        mcap.MAGIC + record(6, struct.pack("<QQQI", 0, 0, 5, 0) + text("zstd") + bytes(8) + zstandard.compress(bytes(100))),
        mcap.MAGIC + record(6, struct.pack("<QQQI", 0, 0, 40, 0) + text("") + bytes(8) + record(5, bytes(31))),
    ):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="MCAP|declares|budget|corrupt|nothing declares"):
            open_recording(spark, str(path)).frames.count()
    path.write_bytes(good)
    for o in (Options(first=1), Options(max_frames=10), Options(metadata_only=True)):
        with pytest.raises(SourceError):
            open_recording(spark, str(path), o)


def test_cdr_ends_early_and_other_encodings():
    whole = Cdr().header("map").text("base").put("d", *range(7)).done()
    assert cdr.read(cdr.odometry, whole) == list(map(float, range(7)))
    assert all(cdr.read(cdr.odometry, whole[:n]) is None for n in range(len(whole)))
    assert cdr.read(cdr.frame_id, b"\0\0" + whole[2:]) is None  # big-endian
    assert cdr.read(cdr.frame_id, Cdr().header("").done()) is None and cdr.read(cdr.frame_id, Cdr().header("x" * 5000).done()) is None
    assert cdr.read(cdr.transforms, Cdr().put("I", 10**9).done()) is None


# --- scenario


def test_versions_and_keys(tmp_path):
    assert [scenario.dotted_version(x) for x in ("esmini 2.37.4", "run_2026.08.16", "v3", "a 2026.1 then 1.9", "1.")] == ["2.37.4", None, None, "1.9", None]
    assert scenario.dimension(" ToD ") == "time_of_day" and scenario.dimension("colour") is None
    assert scenario.provenance_key("SPDX") == "license" and scenario.reference("xodr") == "map_ref"
    assert scenario.header_version("<OpenDRIVE><header revMajor='1' revMinor='7'/>") == "1.7"
    assert scenario.header_version("<!-- <header revMajor='1' revMinor='7'/> -->") is None and scenario.header_version("<header revMajor='x' revMinor='1'>") is None
    (tmp_path / "m.xodr").write_text("<header revMajor='1' revMinor='7'/>")
    found, labels = scenario.elements([("xodr", "m.xodr"), ("map_version", "7"), ("season", "winter"), ("season", "summer"), ("sim", "x 1.2")], str(tmp_path))
    assert dict((k, v) for k, v, _ in found) == {"map_version": "7", "map_ref": "m.xodr", "simulator": "x 1.2"} and labels == [("season", "winter")]
    assert [scenario.sidecar_version(str(tmp_path / "in"), "map_ref", x) for x in ("../m.xodr", "/m.xodr", "m.xosc")] == [None] * 3


# --- MP4


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def movie(frames=20, codec="avc1", width=64, height=48, fps=30, fragmented=False, handler=b"vide", compact=False):
    entry = box(codec, bytes(24), struct.pack(">HH", width, height), bytes(50))
    sizes = box("stz2" if compact else "stsz", bytes(8), struct.pack(">I", frames))
    table = box("stbl", box("stsd", bytes(4), struct.pack(">I", 1), entry), sizes)
    mdia = box("mdia", box("mdhd", bytes(12), struct.pack(">II", fps * 100, frames * 100)), box("hdlr", bytes(8), handler, bytes(12)), box("minf", table))
    return box("ftyp", b"isom") + box("moov", box("trak", bytes(0)), box("trak", mdia), *([box("mvex")] if fragmented else [])) + box("mdat", bytes(9))


def test_mp4(tmp_path):
    def probe(data):
        (tmp_path / "v.mp4").write_bytes(data)
        return mp4.probe(str(tmp_path / "v.mp4"))

    assert probe(movie()) == probe(movie(compact=True)) == {"codec": "avc1", "width": 64, "height": 48, "fps": 30.0, "frame_count": 20}
    assert probe(movie(fragmented=True)) == {"codec": "avc1", "width": 64, "height": 48, "fps": None, "frame_count": None}
    wide = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    assert probe(wide + movie())["frame_count"] == 20
    for data, why in ((b"", "not an MP4"), (b"1234", "truncated box header"), (box("ftyp"), "no moov"), (struct.pack(">I4s", 0, b"mdat") + movie(), "runs to the end"), (movie(handler=b"soun"), "no video track"), (struct.pack(">I4s", 99, b"ftyp"), "only 8 remain"), (struct.pack(">I4s", 4, b"ftyp"), "smaller than")):
        with pytest.raises(mp4.Unreadable, match=why):
            probe(data)


def test_videos_of_robots(spark, tmp_path):
    root = tmp_path / "robot"
    for d in ("meta", "data", "videos/cam", "videos/side"):
        (root / d).mkdir(parents=True)
    camera = {"dtype": "video", "shape": [48, 64, 3], "names": ["height", "width", "channel"], "info": {"video.fps": 30.0, "video.codec": "h264"}}
    features = {"action": {"dtype": "float32", "shape": [1]}, "cam": camera, "side": camera, "none": camera}
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": "v3.0", "fps": 30, "features": features}))
    (root / "meta/stats.json").write_text("{broken")
    n = 4 * 20
    pq.write_table(pa.table({"episode_index": [k // 20 for k in range(n)], "timestamp": [k % 20 / 30 for k in range(n)], "action": pa.array([float(k) for k in range(n)], pa.float32())}), root / "data/a.parquet")
    for e, data in enumerate((movie(), movie(frames=18, width=32), b"broken!")):
        (root / f"videos/cam/episode_{e:03d}.mp4").write_bytes(data)
    (root / "videos/side/file-000.mp4").write_bytes(movie())
    rec = open_recording(spark, str(root))
    m = {(r["ep_ord"], r["name"]): r["media"] for r in rec.streams.collect()}
    assert len(m) == 16 and m[0, "action"] is None and rec.unread == ["meta/stats.json"]
    assert [m[e, "cam"]["status"] for e in range(4)] == ["read", "read", "unreadable", "missing"] and m[3, "cam"]["uri"] == "videos/cam/episode_003.mp4"
    assert m[0, "cam"]["declared"].asDict() == {"codec": "h264", "width": 64, "height": 48, "fps": 30.0} and m[1, "cam"]["observed"]["width"] == 32
    assert m[2, "side"]["status"] == "unattributable" and m[0, "none"]["status"] == "missing"
    v = engine.run(rec, config.parse('only_checks = ["video.media-readable", "video.media-conformance"]'))
    assert {"MEDIA_MISSING", "MEDIA_ABSENT", "MEDIA_UNREADABLE", "MEDIA_UNATTRIBUTED", "FRAME_COUNT_MISMATCH", "RESOLUTION_MISMATCH"} <= {f.code for f in v.findings} and not v.errored


# --- RLDS


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def example(**features):
    out = b""
    for name, v in features.items():
        if isinstance(v, np.ndarray) and v.dtype.kind == "f":
            values = field(2, field(1, v.astype("<f4").tobytes()))
        elif isinstance(v, np.ndarray):
            values = field(3, field(1, b"".join(varint(int(x) & (1 << 64) - 1) for x in v)))
        else:
            values = field(1, b"".join(field(1, x) for x in v))
        out += field(1, field(1, name.replace("__", "/").encode()) + field(2, values))
    return field(1, out)


def shard(*payloads):
    crc = lambda b: struct.pack("<I", compression.masked_crc32c(b))
    return b"".join((n := struct.pack("<Q", len(p))) + crc(n) + p + crc(p) for p in payloads)


@pytest.fixture
def episodes(tmp_path):
    root = tmp_path / "tfds"
    root.mkdir()
    step = {"action": {"tensor": {"shape": {"dimensions": ["2"]}, "dtype": "DT_FLOAT"}}, "image": {"image": {"shape": {"dimensions": ["4", "4", "3"]}, "dtype": "uint8"}}, "language_instruction": {"text": {}}, "gone": {"tensor": {"shape": {}, "dtype": "float32"}}, "ragged": {"sequence": {"feature": {"text": {}}}}}
    (root / "features.json").write_text(json.dumps({"featuresDict": {"features": {"steps": {"sequence": {"feature": {"featuresDict": {"features": step}}}}, "episode_metadata": {"featuresDict": {"features": {"file_path": {"text": {}}}}}}}}))
    (root / "dataset_info.json").write_text(json.dumps({"name": "toy", "version": "1.0", "fileFormat": "tfrecord", "splits": [{"name": "train", "shardLengths": ["2", "1"]}], "redistributionInfo": {"license": "cc-by"}}))
    ep = lambda n, said: example(steps__action=np.arange(2 * n, dtype="f4"), steps__image=[bytes([k]) * 5 for k in range(n)], steps__language_instruction=[x.encode() for x in said], episode_metadata__file_path=[b"raw/a.hdf5"], other=np.array([-1]))
    (root / "toy-train.tfrecord-00000-of-00002").write_bytes(shard(ep(3, ["pick", "pick", "place"]), ep(2, ["go", "go"])))
    (root / "toy-train.tfrecord-00001-of-00002").write_bytes(shard(ep(1, [" "])))
    return root


def test_rlds(spark, episodes):
    rec = open_recording(spark, str(episodes))
    assert rec.dataset_id == "toy"
    e = {r["ep_ord"]: r for r in rec.episodes.collect()}
    assert {k: (r["start_ts"], r["end_ts"], r["task"]) for k, r in e.items()} == {0: (0, 2, "pick"), 1: (0, 1, "go"), 2: (0, 0, None)}
    assert [(r["ep_ord"], r["value"], r["ts"]) for r in rec.labels.collect()] == [(0, "place", 2)]
    s = {r["name"]: r for r in rec.streams.where("ep_ord = 0").collect()}
    assert {n: (r["modality"], r["dtype"], r["shape"]) for n, r in s.items()} == {"action": ("action", "float", [2]), "image": ("video", "uint8", [4, 4, 3]), "language_instruction": ("scalar-state", "string", None), "gone": ("scalar-state", "float32", None)}
    f = {(r["ep_ord"], r["st_ord"], r["frame_idx"]): r["content_hash"] for r in rec.frames.collect()}
    assert len(f) == 3 * (3 + 2 + 1) and f[0, s["action"]["st_ord"], 1] == hashlib.sha256(np.array([2, 3], "<f4").tobytes()).hexdigest()
    assert f[1, s["image"]["st_ord"], 1] == hashlib.sha256(struct.pack("<Q", 5) + b"\1" * 5).hexdigest()
    assert {(r["scope_episode"], r["key"], r["value"]) for r in rec.provenance.collect()} >= {(None, "license", "cc-by"), (2, "upstream", "raw/a.hdf5"), (0, "tfds_split", "train")}
    assert {(r[0], r[1]) for r in rec.metadata.collect()} >= {("declared_total_episodes", "3"), ("tfds_name", "toy")} and rec.notes["unmapped"] == ["other", "steps/ragged"]
    one = open_recording(spark, str(episodes), Options(first=1))
    assert one.coverage == "sample" and [r["ep_ord"] for r in one.episodes.collect()] == [0]


def test_rlds_that_is_broken(spark, episodes):
    path = episodes / "toy-train.tfrecord-00001-of-00002"
    good = path.read_bytes()
    for bad in (good[:5], good[:-3], good[:20] + b"!" + good[21:], b"!" + good[1:], shard(example(steps__action=np.arange(3, dtype="f4"))), shard(example(steps__action=np.arange(2, dtype="f4"), steps__image=[b"", b""])), shard(b"\x0a\x05ab")):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="record at byte|multiple|numbers of steps|field|feature"):
            open_recording(spark, str(episodes))
    (episodes / "dataset_info.json").write_text('{"fileFormat": "riegeli"}')
    with pytest.raises(SourceError):
        open_recording(spark, str(episodes))


def test_feature_trees():
    tree = {"sequence": {"feature": {"featuresDict": {"features": {"a": {"tensor": {"shape": {"dimensions": ["-1"]}}}, "b": {"tensor": {"shape": {"dimensions": ["7"]}, "encoding": "zlib"}}, "c": {"classLabel": {}}, "d": {"dataset": {}}}}}}}
    got = list(rlds.leaves(tree, "steps"))
    assert [x.path if isinstance(x, rlds.Leaf) else x[0] for x in got] == ["steps/a", "steps/b", "steps/c", "steps/d"]
    assert [(x.dtype, x.width) for x in got if isinstance(x, rlds.Leaf)] == [(None, 1), ("int64", 1)]


# --- Zarr


def put(folder, a, chunks, compressor=None, attrs=None, fill=0, skip=(), separator="."):
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": compressor and {"id": compressor}, "fill_value": fill, "filters": None, "order": "C", "dimension_separator": separator}))
    if attrs:
        (folder / ".zattrs").write_text(json.dumps(attrs))
    pack = {None: bytes, "zlib": zlib.compress, "zstd": zstandard.compress}[compressor]
    for at in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunks))):
        if at in skip:
            continue
        block = np.full(chunks, fill, a.dtype)
        part = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        (folder / separator.join(map(str, at))).write_bytes(pack(block.tobytes()))


def test_zarr_replay_buffer(spark, tmp_path):
    root = tmp_path / "push.zarr"
    for d in (root, root / "data", root / "meta"):
        d.mkdir(parents=True)
        (d / ".zgroup").write_text('{"zarr_format": 2}')
    (root / ".zattrs").write_text('{"License": "mit", "task": " push ", "n": [1, 2]}')
    rng = np.random.default_rng(2)
    action, image = rng.normal(size=(25, 3)).astype("f4"), rng.integers(0, 9, (25, 4, 5, 3), dtype=np.uint8)
    action[7, 1] = np.nan
    put(root / "data/action", action, (10, 2), "zlib")
    put(root / "data/img", image, (7, 4, 5, 3), "zstd")
    put(root / "data/timestamp", np.arange(25) / 10, (25,), None, {"units": "s"})
    put(root / "data/lost", np.zeros((25, 2), "<i2"), (5, 2), None, fill=4, skip=[(k, 0) for k in range(5)])
    put(root / "meta/episode_ends", np.array([10, 10, 22]), (2,))
    (root / "data/link").symlink_to(root / "meta")
    rec = open_recording(spark, str(root))
    assert rec.dataset_id == "push" and "link" in rec.notes["unmapped"] and "data/*[22..25]" in rec.notes["unmapped"]
    s = {(r["ep_ord"], r["name"]): r for r in rec.streams.collect()}
    assert {k[1] for k in s if k[0] == 0} == {"action", "img", "timestamp", "lost"} and not any(k[0] == 1 for k in s)
    assert s[0, "img"]["modality"] == "video" and s[0, "action"]["modality"] == "action" and s[0, "action"]["clock_kind"] == "measured"
    assert s[0, "action"]["observed_non_finite"] == 1 and s[2, "action"]["observed_non_finite"] == 0 and s[0, "lost"]["observed_stats"]["min"] == 4
    f = {(r["ep_ord"], r["st_ord"], r["frame_idx"]): r for r in rec.frames.collect()}
    assert f[2, s[2, "action"]["st_ord"], 3]["content_hash"] == hashlib.sha256(action[13].tobytes()).hexdigest()
    assert f[2, s[2, "img"]["st_ord"], 11]["content_hash"] == hashlib.sha256(image[21].tobytes()).hexdigest() and f[2, 0, 0]["ts"] == 1_000_000_000
    e = {r["episode"]: r for r in rec.episodes.collect()}
    assert e[0]["task"] == "push" and (e[2]["start_ts"], e[2]["end_ts"]) == (1_000_000_000, 2_100_000_000)
    assert {(r[0], r[1]) for r in rec.metadata.collect()} >= {("declared_total_episodes", "3"), ("zarr:n", "[1,2]")}
    one = open_recording(spark, str(root), Options(first=1))
    assert one.frames.count() == 40 and one.coverage == "sample"


def test_zarr_groups(spark, tmp_path):
    root = tmp_path / "eps"
    for name, n in (("demo_2", 3), ("demo_10", 4)):
        put(root / name / "obs", np.ones((n, 2)), (2, 2))
        put(root / name / "time", np.arange(n, dtype="<i8"), (2,))
        (root / name / ".zgroup").write_text("{}")
    (root / ".zgroup").write_text("{}")
    rec = open_recording(spark, str(root))
    assert {int(r["episode"]): (r["start_ts"], r["end_ts"]) for r in rec.episodes.collect()} == {2: (0, 2), 10: (0, 3)}
    assert {r["clock_kind"] for r in rec.streams.collect()} == {"step-index"}
    (root / "demo_2/obs/0.0").write_bytes(b"short")
    with pytest.raises(Exception, match="holds 5 bytes"):
        open_recording(spark, str(root)).frames.count()
    assert [zarr.ns_per_unit(x) for x in (" Seconds", "µs", "h", None)] == [10**9, 1000, None, None] and zarr.trailing_number("demo_07") == 7 and zarr.trailing_number("demo") is None


def test_registering_a_reader():
    f = registry.Format("toy", lambda p: p.endswith(".toy"), lambda spark, path, o: None)
    try:
        assert registry.register(f) in registry.formats()
        with pytest.raises(ValueError):
            registry.register(f)
    finally:
        registry._more.clear()


# --- MDF 4


def measurement(path, groups):
    """Groups of (channels, records, cycles, record id size, data kind); a channel is (name, role, sync, kind, bit, byte, bits, flags, conversion)."""
    b = bytearray(64)
    b[:16] = b"MDF     4.10    "

    def block(kind, links, data=b""):
        at = len(b)
        b.extend(kind + bytes(4) + struct.pack("<QQ", 24 + 8 * len(links) + len(data), len(links)) + struct.pack(f"<{len(links)}Q", *links) + data)
        b.extend(bytes(-len(b) % 8))
        return at

    top = block(b"##HD", [0] * 6, bytes(24))
    later = 0
    for channels, length, records, cycles, id_size, kind in reversed(groups):
        after = 0
        for name, role, sync, number, bit, byte, bits, flags, rule in reversed(channels):
            cc = block(b"##CC", [0] * 4, bytes([rule[0]]) + bytes(23) + struct.pack(f"<{len(rule) - 1}d", *rule[1:])) if rule else 0
            tx = block(b"##TX", [], name.encode() + b"\0")
            after = block(b"##CN", [after, 0, tx, 0, cc, 0, 0, 0], struct.pack("<BBBBIII", role, sync, number, bit, byte, bits, flags) + bytes(8))
        cg = block(b"##CG", [0, after, 0, 0, 0, 0], struct.pack("<QQHHIII", 0, cycles, 0, 0, 0, length, 0))
        later = block(b"##DG", [later, cg, block(kind, [], records), 0], bytes([id_size]) + bytes(7))
    struct.pack_into("<Q", b, top + 24, later)
    path.write_bytes(bytes(b))
    return str(path)


def test_mdf4(spark, tmp_path, monkeypatch):
    from fidelis.sources import mdf4

    monkeypatch.setattr(mdf4, "RUN", 100)
    n = 30
    t, speed, count = np.arange(n) / 10, np.arange(n, dtype="<f4"), np.arange(n, dtype=">i2") - 5
    t[7] = np.nan
    speed[3] = np.inf
    record = np.zeros(n, np.dtype([("t", "<f8"), ("speed", "<f4"), ("count", ">i2")]))
    record["t"], record["speed"], record["count"] = t, speed, count
    time = ("t", 2, 1, 4, 0, 0, 64, 0, None)
    channels = [time, ("speed", 0, 0, 4, 0, 8, 32, 0, None), ("count", 0, 0, 3, 0, 12, 16, 0, (1, 100.0, 0.5)), ("speed", 0, 0, 3, 0, 12, 16, 0, (7,)), ("bits", 0, 0, 0, 3, 0, 5, 0, None)]
    path = measurement(tmp_path / "drive.mf4", [(channels, 14, record.tobytes(), n + 9, 0, b"##DT"), ([time], 14, record.tobytes(), n, 0, b"##DZ"), ([("x", 0, 0, 4, 0, 0, 64, 0, None)], 14, record.tobytes(), n, 0, b"##DT"), (channels, 14, record.tobytes(), n, 1, b"##DT")])
    rec = open_recording(spark, path)
    s = {r["name"]: r for r in rec.streams.collect()}
    assert set(s) == {"speed", "count", "speed#2"} and s["speed"]["clock_id"] == "mf4-master#0"
    assert s["count"]["observed_stats"]["min"] == 100 - 2.5 and s["speed#2"]["observed_stats"]["min"] == -5 and s["speed"]["observed_non_finite"] == 1
    f = rec.frames.where(f"st_ord = {s['count']['st_ord']}").orderBy("frame_idx").collect()
    assert [r["ts"] for r in f] == [int(x * 1e9) for x in t if x == x] and f[2]["content_hash"] == hashlib.sha256(struct.pack("<d", 100 - 1.5)).hexdigest()
    notes = " ".join(rec.notes["unmapped"])
    assert all(x in notes for x in ("bits is not decoded", "##DZ", "no time master", "unsorted", "39 records are declared, 30", "type 7"))
    e = rec.episodes.first()
    assert (e["start_ts"], e["end_ts"]) == (0, 2_900_000_000)
    (tmp_path / "old.mdf").write_bytes(b"MDF     3.30    " + bytes(80))
    for bad, o in ((path, Options(max_frames=20)), (path, Options(first=1)), (str(tmp_path / "old.mdf"), Options())):
        with pytest.raises(SourceError):
            open_recording(spark, bad, o)
