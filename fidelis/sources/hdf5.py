"""HDF5 files: a group of arrays for each episode (below ``data`` if there is one), or one flat episode.

The container's structure (superblock, object headers, groups, attributes) is read on the driver; arrays are read by
tasks, a run of rows at a time, like those of Zarr stores, whose scan this reader shares. What the container may hold but
this reader doesn't know (dense links, layouts of version 4, other filters) is refused or unmapped by name.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.functions import sampling
from fidelis.model import Recording
from fidelis.sources import compression, zarr
from fidelis.sources.registry import Format, Options, SourceError

MAGIC = b"\x89HDF\r\n\x1a\n"
# Kinds of messages of an object header, and filters.
SPACE, LINKS, TYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, TABLE = 1, 2, 3, 4, 5, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
#: Nodes of a tree, levels of it, and chunks of an array.
NODES, DEPTH, CHUNKS = 100_000, 64, 4_000_000


class Container:
    """One file: reads objects by their addresses."""

    def __init__(self, path: str):
        self.path, self.size = path, os.path.getsize(path)
        self.f = open(path, "rb")  # noqa: SIM115  closed with the object
        head = self.at(0, min(96, self.size))
        if head[:8] != MAGIC:
            raise SourceError("no HDF5 file")
        version = head[8]
        if version > 3:
            raise SourceError(f"superblocks of version {version} are not read")
        sizes, start = (13, 24 + 4 * (version == 1)) if version < 2 else (9, 12)
        if tuple(head[sizes : sizes + 2]) != (8, 8):
            raise SourceError("only addresses and lengths of eight bytes are read")
        base = struct.unpack_from("<Q", head, start)[0]
        if base:
            raise SourceError("a file inside another is not read")
        # Behind the base: free space, end, driver; then the entry of the root. Or: extension, end, root.
        self.root = struct.unpack_from("<Q", head, start + (40 if version < 2 else 24))[0]

    def at(self, begin: int, n: int) -> bytes:
        if begin < 0 or n < 0 or begin + n > self.size:
            raise SourceError(f"{n} bytes at {begin} are past the end of {self.path}")
        self.f.seek(begin)
        return self.f.read(n)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(kind, body) of the messages of an object's header and of its continuations."""
        out: list[tuple[int, bytes]] = []
        if self.at(address, 4) == b"OHDR":
            flags = self.at(address + 5, 1)[0]
            begin = address + 6 + 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            n = 1 << (flags & 3)
            blocks, head = [(begin + n, int.from_bytes(self.at(begin, n), "little"))], 4 + 2 * (flags >> 2 & 1)
        else:
            version, _, _, _, n = struct.unpack("<BBHII", self.at(address, 12))
            if version != 1:
                raise SourceError(f"an object header of version {version} at {address}")
            blocks, head = [(address + 16, n)], 8
        for begin, n in blocks:  # grows by continuations
            if len(blocks) > NODES:
                raise SourceError("an object header that never ends")
            data, k = self.at(begin, n), 0
            while k + head <= len(data):
                kind, size = struct.unpack_from("<HH" if head == 8 else "<BH", data, k)
                body = data[k + head : k + head + size]
                k += head + size
                if kind == MORE and len(body) >= 16:
                    where, long = struct.unpack_from("<QQ", body)
                    blocks.append((where, long) if head == 8 else (where + 4, long - 8))
                elif kind:
                    out.append((kind, body))
        return out

    def tree(self, address: int, kind: int, key: int, level: int = 0, seen: list[int] | None = None) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a tree of version 1."""
        seen = [0] if seen is None else seen
        seen[0] += 1
        if level > DEPTH or seen[0] > NODES:
            raise SourceError("a tree that is too deep or too large")
        head = self.at(address, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise SourceError(f"no tree at {address}")
        n = struct.unpack_from("<H", head, 6)[0]
        data = self.at(address + 24, n * (key + 8))
        for k in range(n):
            child = struct.unpack_from("<Q", data, k * (key + 8) + key)[0]
            if head[5]:
                yield from self.tree(child, kind, key, level + 1, seen)
            else:
                yield data[k * (key + 8) : k * (key + 8) + key], child

    def links(self, messages: list[tuple[int, bytes]]) -> list[tuple[str, int]]:
        """(name, address) of the members of a group; links that lead elsewhere are left out."""
        out = []
        for kind, body in messages:
            if kind == TABLE:
                table, heap = struct.unpack_from("<QQ", body)
                if self.at(heap, 4) != b"HEAP":
                    raise SourceError(f"no heap at {heap}")
                size, _, data = struct.unpack("<QQQ", self.at(heap + 8, 24))
                names = self.at(data, size)
                for _, node in self.tree(table, 0, 8):
                    head = self.at(node, 8)
                    if head[:4] != b"SNOD":
                        raise SourceError(f"no table of names at {node}")
                    n = struct.unpack_from("<H", head, 6)[0]
                    for name, address, cache in struct.iter_unpack("<QQI20x", self.at(node + 8, 40 * n)):
                        if cache != 2:  # a soft link
                            out.append((names[name:].partition(b"\0")[0].decode("utf-8"), address))
            elif kind == LINK:
                flags, k = body[1], 2
                hard = not flags & 8 or body[k] == 0
                k += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
                n = 1 << (flags & 3)
                long = int.from_bytes(body[k : k + n], "little")
                if hard:
                    out.append((body[k + n : k + n + long].decode("utf-8"), struct.unpack_from("<Q", body, k + n + long)[0]))
            elif kind == LINKS:
                where = 2 + 8 * (body[1] & 1)
                if struct.unpack_from("<Q", body, where)[0] != 2**64 - 1:
                    raise SourceError("links in a fractal heap are not read")
        return sorted(out)

    def text(self, raw: bytes) -> str:
        """A string of any length, which lies in a global heap."""
        n, heap, index = struct.unpack_from("<IQI", raw)
        head = self.at(heap, 16)
        if head[:4] != b"GCOL":
            raise SourceError(f"no heap at {heap}")
        data, k = self.at(heap, struct.unpack_from("<Q", head, 8)[0]), 16
        while k + 16 <= len(data):
            number, _, size = struct.unpack_from("<HHxxxxQ", data, k)
            if number == index:
                return data[k + 16 : k + 16 + min(n, size)].decode("utf-8", "replace")
            if not number:
                break
            k += 16 + -(-size // 8) * 8
        return ""

    def attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, object]:
        """Single numbers and strings; others are left out."""
        out: dict[str, object] = {}
        for kind, body in messages:
            if kind != ATTRIBUTE:
                continue
            version, _, name, of, space = struct.unpack_from("<BBHHH", body)
            k, wide = 8 + (version == 3), (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
            label = body[k : k + name].partition(b"\0")[0].decode("utf-8", "replace")
            k += wide(name)
            declared, shape = body[k : k + of], dims(body[k + wide(of) : k + wide(of) + space])
            raw = body[k + wide(of) + wide(space) :]
            if shape not in ((), (1,)):
                continue
            if declared[0] & 15 == 9 and declared[1] & 15 == 1:
                out[label] = self.text(raw)
            elif declared[0] & 15 == 3:
                out[label] = raw[: struct.unpack_from("<I", declared, 4)[0]].partition(b"\0")[0].decode("utf-8", "replace")
            elif (t := dtype(declared)) is not None and t.kind in "iuf":
                out[label] = np.frombuffer(raw, t, 1)[0].item()
        return out


def dims(body: bytes) -> tuple[int, ...]:
    version, rank = body[0], body[1]
    return struct.unpack_from(f"<{rank}Q", body, 8 if version == 1 else 4)


def dtype(body: bytes) -> np.dtype | None:
    """Numbers as numpy has them; other types of a known size as bytes; None without one."""
    kind, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    order = ">" if bits & 1 else "<"
    try:
        if kind == 0:
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        if kind == 1:
            return np.dtype(f"{order}f{size}")
    except TypeError:
        pass
    return np.dtype(f"V{size}") if size and kind != 9 else None


@dataclass(frozen=True)
class Dataset:
    """An array of a file, with what tasks need to read its rows."""

    path: str
    file: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: bytes
    layout: tuple  # ("bytes", data), ("place", address) or ("tree", address)
    filters: tuple[tuple[int, tuple[int, ...]], ...]
    units: str | None

    leaf, row_items, numeric, modality = zarr.Array.leaf, zarr.Array.row_items, zarr.Array.numeric, zarr.Array.modality

    def rows(self, run: int, most: int) -> np.ndarray:
        first, last = run * self.chunks[0], min((run + 1) * self.chunks[0], self.shape[0])
        row = self.row_items * self.dtype.itemsize
        if self.layout[0] == "bytes":
            data = self.layout[1][first * row : last * row]
        elif self.layout[0] == "place":
            if self.layout[1] == 2**64 - 1:  # nothing was ever written
                data = self.fill * ((last - first) * self.row_items)
            else:
                data = Container(self.file).at(self.layout[1] + first * row, (last - first) * row)
        else:
            return self._chunked(run, last - first, most)
        return np.frombuffer(data, self.dtype).reshape(last - first, *self.shape[1:])

    def _chunked(self, run: int, n: int, most: int) -> np.ndarray:
        c, size = Container(self.file), int(np.prod(self.chunks, dtype=object)) * self.dtype.itemsize
        if size > most:
            raise SourceError(f"a chunk of {size} bytes is over the decompression budget")
        out = np.frombuffer(self.fill * (n * self.row_items), self.dtype).reshape(n, *self.shape[1:]).copy()
        rank, address = len(self.shape), self.layout[1]
        if address == 2**64 - 1:
            return out
        for k, (key, child) in enumerate(c.tree(address, 1, 8 + 8 * (rank + 1))):
            if k > CHUNKS:
                raise SourceError(f"over {CHUNKS} chunks")
            stored, skip, *at = struct.unpack(f"<II{rank + 1}Q", key)
            if at[0] // self.chunks[0] != run:
                continue
            data = c.at(child, stored)
            for number, (kind, values) in reversed(list(enumerate(self.filters))):
                if skip >> number & 1:
                    continue
                try:
                    if kind == DEFLATE:
                        data = compression.deflate(data, size + 4)
                    elif kind == SHUFFLE:
                        data = compression.unshuffle(data, values[0] if values else self.dtype.itemsize)
                    else:
                        data, check = data[:-4], struct.unpack("<I", data[-4:])[0]
                        if compression.fletcher32(data) != check:
                            raise SourceError(f"{self.path}: the checksum of a chunk is wrong")
                except compression.Corrupt as e:
                    raise SourceError(f"{self.path}: {e}") from None
            if len(data) != size:
                raise SourceError(f"{self.path}: a chunk has {len(data)} bytes of {size}")
            block = np.frombuffer(data, self.dtype).reshape(self.chunks)
            begin = (at[0] - run * self.chunks[0], *at[1:rank])
            part = tuple(slice(b, min(b + w, e)) for b, w, e in zip(begin, self.chunks, out.shape, strict=True))
            out[part] = block[tuple(slice(0, s.stop - s.start) for s in part)]
        return out


def opened(c: Container, path: str, messages: list[tuple[int, bytes]]) -> Dataset:
    body = {kind: b for kind, b in messages if kind != ATTRIBUTE}
    shape, t, layout = dims(body[SPACE]), dtype(body[TYPE]), body.get(LAYOUT)
    if t is None or not shape or layout is None:
        raise SourceError("a single value, or a type that is not read")
    filters: list[tuple[int, tuple[int, ...]]] = []
    if raw := body.get(FILTERS):
        k = 8 if raw[0] == 1 else 2
        for _ in range(raw[1]):
            kind = struct.unpack_from("<H", raw, k)[0]
            named = raw[0] == 1 or kind >= 256
            name = struct.unpack_from("<H", raw, k + 2)[0] if named else 0
            n = struct.unpack_from("<H", raw, k + 4 + 2 * named)[0]
            k += 6 + 2 * named + (-(-name // 8) * 8 if raw[0] == 1 else name)
            filters.append((kind, struct.unpack_from(f"<{n}I", raw, k)))
            k += 4 * (n + (n & 1 if raw[0] == 1 else 0))
        if other := [kind for kind, _ in filters if kind not in (DEFLATE, SHUFFLE, FLETCHER)]:
            raise SourceError(f"the filter {other[0]} is not read")
    version, chunks = layout[0], tuple(shape)
    if version == 3:
        if layout[1] == 0:
            where = ("bytes", layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]])
        elif layout[1] == 1:
            where = ("place", struct.unpack_from("<Q", layout, 2)[0])
        else:
            where, chunks = ("tree", struct.unpack_from("<Q", layout, 3)[0]), struct.unpack_from(f"<{layout[2] - 1}I", layout, 11)
    elif version in (1, 2) and layout[2] in (1, 2):
        where = ("place" if layout[2] == 1 else "tree", struct.unpack_from("<Q", layout, 8)[0])
        if layout[2] == 2:
            chunks = struct.unpack_from(f"<{layout[1] - 1}I", layout, 16)
    else:
        raise SourceError(f"layouts of version {version} are not read")
    if where[0] != "tree":  # runs of rows of about a megabyte
        row = max(1, int(np.prod(shape[1:], dtype=object)) * t.itemsize)
        chunks = (max(1, (1 << 20) // row), *shape[1:])
    if len(chunks) != len(shape) or min(chunks) < 1:
        raise SourceError("its shape and its chunks don't fit")
    fill = b""
    if (raw := body.get(FILL)) and (raw[0] < 3 and raw[0] + raw[3] > 1 or raw[0] == 3 and raw[1] & 32):
        k = 4 if raw[0] < 3 else 2
        fill = raw[k + 4 : k + 4 + struct.unpack_from("<I", raw, k)[0]]
    elif raw := body.get(OLD_FILL):
        fill = raw[4 : 4 + struct.unpack_from("<I", raw)[0]]
    units = c.attributes(messages).get("units")
    return Dataset(path, c.path, tuple(shape), tuple(chunks), t, fill if len(fill) == t.itemsize else bytes(t.itemsize), where, tuple(filters), units if isinstance(units, str) else None)


def walked(c: Container, address: int, prefix: str, arrays: list[Dataset], unmapped: list[str], attrs: dict[str, dict], depth: int = 0) -> None:
    if depth > zarr.DEPTH:
        raise SourceError(f"groups lie deeper than {zarr.DEPTH} levels")
    messages = c.messages(address)
    attrs[prefix] = c.attributes(messages)
    for name, child in c.links(messages):
        path = f"{prefix}{name}"
        inner = c.messages(child)
        if any(kind == LAYOUT for kind, _ in inner):
            try:
                arrays.append(opened(c, path, inner))
            except (SourceError, KeyError, struct.error) as e:
                unmapped.append(f"{path}: {e}")
        elif any(kind in (TABLE, LINK, LINKS) for kind, _ in inner):
            walked(c, child, f"{path}/", arrays, unmapped, attrs, depth + 1)
        else:
            unmapped.append(path)
    if len(arrays) > zarr.ARRAYS:
        raise SourceError(f"over {zarr.ARRAYS} arrays")


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    c = Container(path)
    arrays: list[Dataset] = []
    unmapped: list[str] = []
    attrs: dict[str, dict] = {}
    try:
        walked(c, c.root, "", arrays, unmapped, attrs)
    except struct.error as e:
        raise SourceError(f"the container is corrupt: {e}") from None
    top = "data/" if any(a.path.startswith("data/") for a in arrays) else ""
    below = sorted({a.path[len(top) :].partition("/")[0] for a in arrays if a.path.startswith(top) and "/" in a.path[len(top) :]})
    size = lambda prefix: max((a.shape[0] for a in arrays if a.path.startswith(prefix)), default=0)
    flat = [a.path for a in arrays if a.path.startswith(top) and "/" not in a.path[len(top) :]]
    if below and not (flat and not top):
        numbers = [zarr.trailing_number(g) for g in below]
        own = None not in numbers and len(set(numbers)) == len(numbers)
        cuts = [(numbers[k] if own else k, f"{top}{g}", 0, size(f"{top}{g}/"), f"{top}{g}/") for k, g in enumerate(below)]
        unmapped += flat + [a.path for a in arrays if not a.path.startswith(top)]
        arrays = [a for a in arrays if a.path.startswith(top) and a.path not in flat]
    elif arrays:
        unmapped += [a.path for a in arrays if a.path not in flat]
        arrays = [a for a in arrays if a.path in flat]
        cuts = [(0, top or "/", 0, size(top), top)]
    else:
        raise SourceError("no arrays" + (f": {unmapped[0]}" if unmapped else ""))
    name = os.path.splitext(os.path.basename(os.path.realpath(path)))[0]
    rec = Recording(spark, name, "hdf5")
    if o.sampled:
        every = [x[0] for x in cuts]
        chosen = set(sampling.first(every, o.first) if o.first is not None else sampling.fraction(every, o.fraction, o.seed))
        cuts, rec.coverage = [x for x in cuts if x[0] in chosen], "sample"
    root = attrs.get("", {}) | (attrs.get(top, {}) if top else {})
    task = lambda cut: next((str(v).strip() for k, v in sorted({**root, **attrs.get(cut[4], {})}.items()) if k.lower() in zarr.TASKS and isinstance(v, str) and v.strip()), None)
    most = max(64 << 20, o.max_expansion * c.size)
    zarr.assembled(spark, rec, arrays, cuts, o, most, unmapped, lambda a: a.units, task, "hdf5")
    # Lengths that the file declares count only where every stream of an episode has one length.
    whole = {x[4]: len({a.shape[0] for a in arrays if a.path.startswith(x[4])}) == 1 for x in cuts}
    declared = [(n, int(v)) for n, x in enumerate(cuts) if whole[x[4]] and isinstance(v := attrs.get(x[4], {}).get("num_samples"), (int, float))]
    if declared:
        lengths = spark.createDataFrame(declared, "ep_ord long, declared_frame_count long")
        rec.put("episodes", rec.episodes.drop("declared_frame_count").join(F.broadcast(lengths), "ep_ord", "left"))
    totals = [("declared_total_frames", str(int(root["total"])))] if all(whole.values()) and not o.sampled and isinstance(root.get("total"), (int, float)) else []
    text = lambda v: str(v)[:4096]
    rec.put("metadata", spark.createDataFrame([("source_format", "hdf5"), *((f"hdf5:{k}", text(v)) for k, v in sorted(root.items())), *totals], "key string, value string"))
    lineage = [("dataset", None, 0, "source_format", "hdf5")] + [("dataset", None, 0, zarr.LINEAGE[k.lower()], text(v)) for k, v in sorted(root.items()) if k.lower() in zarr.LINEAGE]
    rec.put("provenance", spark.createDataFrame(lineage + [("episode", x[0], n + 1, "upstream", x[1]) for n, x in enumerate(cuts)], "scope_kind string, scope_episode long, record_id long, key string, value string").withColumn("class", F.lit("known")))
    return rec


def _is_hdf5(path: str) -> bool:
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(8) == MAGIC


FORMAT = Format("hdf5", _is_hdf5, read, samples=True)
