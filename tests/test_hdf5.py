"""HDF5 files that are written here, structure by structure, and read back."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from fidelis.sources import compression, hdf5
from fidelis.sources.registry import Options, SourceError, open_recording

NONE = 2**64 - 1
pad = lambda b: b + bytes(-len(b) % 8)


class Writer:
    """Appends structures, children first, and gives their addresses."""

    def __init__(self, version=0):
        self.version, self.b = version, bytearray(96)

    def add(self, data):
        self.b += bytes(-len(self.b) % 8)
        at = len(self.b)
        self.b += data
        return at

    def header(self, messages):
        if self.version < 2:
            body = b"".join(struct.pack("<HHB3x", k, len(pad(d)), 0) + pad(d) for k, d in messages)
            half = 0
            if len(messages) > 3:  # the last message goes to a continuation
                k, d = messages[-1]
                more = struct.pack("<HHB3x", k, len(pad(d)), 0) + pad(d)
                where = self.add(more)
                body = body[: -len(more)] + struct.pack("<HHB3x", hdf5.MORE, 16, 0) + struct.pack("<QQ", where, len(more))
                half = 1
            return self.add(struct.pack("<BBHII4x", 1, 0, len(messages) + half, 1, len(body)) + body)
        body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in messages)
        return self.add(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4))

    def group(self, members, attributes=()):
        messages = [(hdf5.ATTRIBUTE, a) for a in attributes]
        if self.version >= 2:
            link = lambda n, at: bytes([1, 0, len(n)]) + n.encode() + struct.pack("<Q", at)
            return self.header([(hdf5.LINKS, bytes([0, 0]) + struct.pack("<QQ", NONE, NONE)), *((hdf5.LINK, link(n, at)) for n, at in members.items()), *messages])
        names, entries = bytearray(8), b""
        for n, at in sorted(members.items()):
            entries += struct.pack("<QQI20x", len(names), at, 0)
            names += pad(n.encode() + b"\0")
        heap = self.add(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), NONE, self.add(bytes(names))))
        node = self.add(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + entries)
        tree = self.add(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, node, 8))
        return self.header([(hdf5.TABLE, struct.pack("<QQ", tree, heap)), *messages])

    def array(self, a, chunks=None, filters=(), fill=None, skip=(), layout=3, compact=False, attributes=()):
        kind = {"f": b"\x11\x20\x1f\x00", "i": b"\x10\x08\x00\x00", "u": b"\x10\x00\x00\x00"}[a.dtype.kind]
        of = kind + struct.pack("<I", a.dtype.itemsize) + bytes(12)
        messages = [(hdf5.SPACE, bytes([1, a.ndim, 0, 0, 0, 0, 0, 0]) + struct.pack(f"<{a.ndim}Q", *a.shape)), (hdf5.TYPE, of)]
        if fill is not None:
            raw = np.array(fill, a.dtype).tobytes()
            messages.append((hdf5.FILL, bytes([2, 2, 0, 1]) + struct.pack("<I", len(raw)) + raw))
        if compact:
            messages.append((hdf5.LAYOUT, bytes([3, 0]) + struct.pack("<H", a.nbytes) + a.tobytes()))
        elif chunks is None:
            messages.append((hdf5.LAYOUT, bytes([layout, 1]) + struct.pack("<QQ", self.add(a.tobytes()), a.nbytes)))
        else:
            leaves = []
            for at in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunks))):
                if at in skip:
                    continue
                begin = tuple(k * c for k, c in zip(at, chunks))
                block = np.zeros(chunks, a.dtype)
                part = a[tuple(slice(x, x + c) for x, c in zip(begin, chunks))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                data = block.tobytes()
                for f in filters:
                    if f == hdf5.SHUFFLE:
                        data = np.frombuffer(data, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
                    elif f == hdf5.DEFLATE:
                        data = zlib.compress(data)
                    elif f == hdf5.FLETCHER:
                        data += struct.pack("<I", compression.fletcher32(data))
                leaves.append((begin, self.add(data), len(data)))
            key = lambda size, begin: struct.pack(f"<II{a.ndim + 1}Q", size, 0, *begin, 0)
            nodes = []
            for part in (leaves[: len(leaves) // 2], leaves[len(leaves) // 2 :]):  # two leaves under one node
                body = b"".join(key(n, begin) + struct.pack("<Q", at) for begin, at, n in part)
                nodes.append((part[0][0], self.add(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), NONE, NONE) + body + key(0, a.shape))))
            tree = self.add(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(nodes), NONE, NONE) + b"".join(key(0, begin) + struct.pack("<Q", at) for begin, at in nodes) + key(0, a.shape))
            if filters:
                messages.append((hdf5.FILTERS, bytes([1, len(filters)]) + bytes(6) + b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", a.dtype.itemsize, 0) for f in filters)))
            messages.append((hdf5.LAYOUT, bytes([3, 2, a.ndim + 1]) + struct.pack(f"<Q{a.ndim + 1}I", tree, *chunks, a.dtype.itemsize)))
        return self.header(messages + [(hdf5.ATTRIBUTE, x) for x in attributes])

    def attribute(self, name, value):
        scalar = bytes([1, 0, 0, 0, 0, 0, 0, 0])
        if isinstance(value, int):
            of, raw = b"\x10\x08\x00\x00" + struct.pack("<I", 8) + bytes(4), struct.pack("<q", value)
        elif value.startswith("~"):  # of any length, in a global heap
            text = value[1:].encode()
            heap = self.add(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", 16 + 16 + len(pad(text))) + struct.pack("<HHxxxxQ", 1, 1, len(text)) + pad(text))
            of, raw = b"\x19\x01\x00\x00" + struct.pack("<I", 16) + bytes(8), struct.pack("<IQI", len(text), heap, 1)
        else:
            raw = value.encode()
            of = b"\x13\x00\x00\x00" + struct.pack("<I", len(raw))
        label = name.encode() + b"\0"
        return struct.pack("<BBHHH", 1, 0, len(label), len(of), len(scalar)) + pad(label) + pad(of) + pad(scalar) + raw

    def save(self, path, root):
        if self.version < 2:
            head = hdf5.MAGIC + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.b), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        else:
            head = hdf5.MAGIC + bytes([self.version, 8, 8, 0]) + struct.pack("<QQQQI", 0, NONE, len(self.b), root, 0)
        self.b[: len(head)] = head
        path.write_bytes(bytes(self.b))
        return str(path)


def test_demonstrations(spark, tmp_path):
    rng = np.random.default_rng(5)
    w = Writer()
    action, image = rng.normal(size=(25, 3)).astype("<f4"), rng.integers(0, 9, (25, 4, 5, 3)).astype("u1")
    action[4, 2] = np.inf
    stamps = np.arange(25, dtype="<i8") * 50
    one = w.group(
        {
            "actions": w.array(action, (10, 2), (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.FLETCHER)), "obs": w.group({"img": w.array(image, (7, 4, 5, 3), (hdf5.DEFLATE,))}),
            "lost": w.array(np.ones((25, 2), "<i2"), (5, 2), fill=7, skip=[(1, 0)]), "time": w.array(stamps, attributes=[w.attribute("units", "ms")]),
        },
        [w.attribute("num_samples", 25), w.attribute("task", "~stack the blocks")],
    )
    two = w.group({"actions": w.array(action[:6].copy(), (4, 3)), "tiny": w.array(np.arange(4, dtype="<u2"), compact=True)}, [w.attribute("num_samples", 6)])
    data = w.group({"demo_3": one, "demo_12": two}, [w.attribute("total", 31), w.attribute("license", "mit")])
    path = w.save(tmp_path / "demos.hdf5", w.group({"data": data, "mask": w.group({"train": w.array(np.arange(3.0))})}))
    rec = open_recording(spark, path)
    assert rec.format_id == "hdf5" and rec.dataset_id == "demos" and "mask/train" in rec.notes["unmapped"]
    e = {int(r["episode"]): r for r in rec.episodes.collect()}
    assert set(e) == {3, 12} and e[3]["task"] == "stack the blocks" and e[12]["task"] is None
    assert (e[3]["start_ts"], e[3]["end_ts"], e[3]["declared_frame_count"]) == (0, 24 * 50_000_000, 25) and e[12]["declared_frame_count"] is None
    s = {(r["ep_ord"], r["name"]): r for r in rec.streams.collect()}
    ep = {k: e[k]["ep_ord"] for k in e}
    assert s[ep[3], "obs/img"]["modality"] == "video" and s[ep[3], "actions"]["modality"] == "action" and s[ep[3], "actions"]["clock_kind"] == "measured" and s[ep[12], "actions"]["clock_kind"] == "step-index"
    assert s[ep[3], "actions"]["observed_non_finite"] == 1 and s[ep[3], "lost"]["observed_stats"]["max"] == 7 and s[ep[12], "tiny"]["observed_stats"]["max"] == 3
    f = {(r["ep_ord"], r["st_ord"], r["frame_idx"]): r["content_hash"] for r in rec.frames.collect()}
    for name, a in (("actions", action), ("obs/img", image), ("time", stamps)):
        st = s[ep[3], name]["st_ord"]
        assert [f[ep[3], st, k] for k in range(25)] == [hashlib.sha256(r.tobytes()).hexdigest() for r in a]
    assert {(r["key"], r["value"]) for r in rec.provenance.collect()} >= {("license", "mit"), ("upstream", "data/demo_3")}
    assert "declared_total_frames" not in {r["key"] for r in rec.metadata.collect()}  # an episode is ragged
    assert open_recording(spark, path, Options(first=1)).episodes.collect()[0]["episode"] == 3


def test_flat_file_of_the_second_version(spark, tmp_path):
    w = Writer(2)
    a = np.arange(30, dtype="<f8").reshape(15, 2)
    path = w.save(tmp_path / "x.h5", w.group({"state": w.array(a), "old": w.array(a, layout=4)}, [w.attribute("total", 15)]))
    rec = open_recording(spark, path)
    assert [r["name"] for r in rec.streams.collect()] == ["state"] and rec.notes["unmapped"] == ["old: layouts of version 4 are not read"]
    assert rec.frames.count() == 15 and ("declared_total_frames", "15") in {(r[0], r[1]) for r in rec.metadata.collect()}


def test_what_is_refused(spark, tmp_path):
    w = Writer()
    group = w.group({"a": w.array(np.arange(8.0), (4,), (hdf5.FLETCHER,)), "b": w.array(np.arange(8.0), (4,), (4,))})
    path = w.save(tmp_path / "x.hdf5", group)
    good = (tmp_path / "x.hdf5").read_bytes()
    assert any("filter 4" in x for x in open_recording(spark, path).notes["unmapped"])
    at = good.index(np.arange(4.0).tobytes())
    (tmp_path / "x.hdf5").write_bytes(good[:at] + b"\1" + good[at + 1 :])
    with pytest.raises(Exception, match="checksum"):
        open_recording(spark, path).frames.count()
    for bad in (good[:200], good[:8] + b"\x09" + good[9:], good.replace(b"TREE", b"TREX")):
        (tmp_path / "x.hdf5").write_bytes(bad)
        with pytest.raises(SourceError):
            open_recording(spark, path)
