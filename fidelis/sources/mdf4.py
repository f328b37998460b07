"""ASAM MDF 4 measurements: a stream for each channel, on the clock of its group's time master.

The driver walks the chain of blocks (groups, channels, conversions). Records are cut into runs, which tasks read and
decode as strided columns. Sorted groups with plain data blocks, integers and floats at whole bytes, and linear
conversions are read; what else a file holds is named as unmapped.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.model import Recording
from fidelis.sources.registry import Format, Options, SourceError, dataset_id

#: Bytes of records that one task reads at once, and of a block that the driver reads.
RUN, BLOCK = 4 << 20, 64 << 20
# Kinds of numbers of a channel.
KINDS = {0: "<u", 1: ">u", 2: "<i", 3: ">i", 4: "<f", 5: ">f"}


class Blocks:
    """Blocks of a file: a head, links to others, and data."""

    def __init__(self, path: str):
        self.size = os.path.getsize(path)
        self.f = open(path, "rb")  # noqa: SIM115  closed with the object

    def at(self, begin: int, n: int) -> bytes:
        self.f.seek(begin)
        return self.f.read(n)

    def head(self, at: int | None) -> tuple[bytes, int, int] | None:
        """Kind, place of the data and place behind it; None where there is no whole block."""
        raw = self.at(at, 24) if at and at < self.size else b""
        if len(raw) < 24:
            return None
        length, links = struct.unpack_from("<QQ", raw, 8)
        if length < 24 + 8 * links or at + length > self.size:
            return None
        return raw[:4], at + 24 + 8 * links, at + length

    def links(self, at: int) -> list[int]:
        return list(struct.unpack(f"<{(n := (self.head(at)[1] - at - 24) // 8)}Q", self.at(at + 24, 8 * n)))

    def block(self, at: int | None, kind: bytes) -> tuple[list[int], bytes] | None:
        """Links and data of the block, if it is of the kind."""
        head = self.head(at)
        if head is None or head[0] != kind or head[2] - at > BLOCK:
            return None
        return self.links(at), self.at(head[1], head[2] - head[1])

    def text(self, at: int) -> str:
        found = self.block(at, b"##TX")
        return found[1].partition(b"\0")[0].decode("utf-8", "replace").strip() if found else ""


@dataclass(frozen=True)
class Channel:
    name: str
    role: int
    sync: int
    kind: int
    bit: int
    byte: int
    bits: int
    flags: int
    offset: float
    factor: float
    unknown: int | None  # a conversion that isn't applied

    @property
    def dtype(self) -> np.dtype | None:
        wide = (32, 64) if self.kind in (4, 5) else (8, 16, 32, 64)
        return np.dtype(f"{KINDS[self.kind]}{self.bits // 8}") if self.kind in KINDS and not self.bit and self.bits in wide else None

    @property
    def master(self) -> bool:
        return self.role in (2, 3) and self.sync == 1


@dataclass(frozen=True)
class Group:
    number: int
    at: int  # of the records
    length: int  # of one
    count: int
    master: Channel
    channels: tuple[Channel, ...]


def channel(b: Blocks, at: int) -> Channel | None:
    found = b.block(at, b"##CN")
    if not found or len(found[1]) < 12 or len(found[0]) < 5 or not (name := b.text(found[0][2])):
        return None
    role, sync, kind, bit, byte, bits = struct.unpack_from("<BBBBII", found[1])
    flags = struct.unpack_from("<I", found[1], 12)[0] if len(found[1]) >= 16 else 0
    offset, factor, unknown = 0.0, 1.0, None
    if rule := b.block(found[0][4], b"##CC"):
        what = rule[1][0] if rule[1] else 0
        if what == 1 and len(rule[1]) >= 40:
            offset, factor = struct.unpack_from("<dd", rule[1], 24)
        elif what:
            unknown = what
    return Channel(name, role, sync, kind, bit, byte, bits, flags, offset, factor, unknown)


def chain(b: Blocks, at: int, kind: bytes, seen: set[int], unmapped: list[str]) -> Iterator[tuple[int, list[int], bytes]]:
    while at:
        found = b.block(at, kind)
        if at in seen or not found:
            unmapped.append(f"{kind.decode()} @{at}: {'a chain that returns' if at in seen else 'not such a block'}")
            return
        seen.add(at)
        yield at, *found
        at = found[0][0] if found[0] else 0


def groups(b: Blocks, unmapped: list[str]) -> Iterator[Group]:
    top = b.block(64, b"##HD")
    if not top:
        raise SourceError("no header block at byte 64")
    seen: set[int] = set()
    for number, (_, links, data) in enumerate(chain(b, top[0][0], b"##DG", seen, unmapped)):
        note = lambda what, number=number: unmapped.append(f"##DG[{number}]: {what}")
        if data[:1] not in (b"", b"\0"):
            note("records of several groups, unsorted")
            continue
        records = b.head(links[2] if len(links) > 2 else 0)
        if not records or records[0] != b"##DT":
            note(f"no plain data block{', but ' + records[0].decode('latin-1') if records else ''}")
            continue
        found = list(chain(b, links[1], b"##CG", seen, unmapped))
        if not found:
            continue
        if len(found) > 1:
            note("channel groups beyond the first")
        _, links, data = found[0]
        cycles, = struct.unpack_from("<Q", data, 8)
        held, invalid = struct.unpack_from("<II", data, 24)
        channels = []
        at = links[1] if len(links) > 1 else 0
        for place, _, _ in chain(b, at, b"##CN", seen, unmapped):
            one = channel(b, place)
            channels.append(one) if one else note(f"##CN @{place} without a name")
        master = next((c for c in channels if c.master), None)
        length = held + invalid
        if not length or master is None or master.role == 3 or master.dtype is None or master.unknown is not None or master.byte + master.bits // 8 > length:
            note("no time master that can be read" if length else "records of no length")
            continue
        good = []
        for c in channels:
            if c.master:
                continue
            if invalid and c.flags & 3 or c.dtype is None or c.byte + c.bits // 8 > length:
                note(f"{c.name} is not decoded")
                continue
            if c.unknown is not None:
                note(f"{c.name}: a conversion of type {c.unknown} is not applied, its raw values are taken")
            good.append(c)
        there = (records[2] - records[1]) // length
        if cycles > there:
            note(f"{cycles} records are declared, {there} are there")
        yield Group(number, records[1], length, min(cycles, there) if cycles else there, master, tuple(good))


def column(c: Channel, data: bytes, length: int) -> np.ndarray:
    """A channel's values as they stand in records, converted."""
    n = len(data) // length
    wide = c.bits // 8
    raw = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * length).reshape(n, length)[:, c.byte : c.byte + wide])
    values = raw.view(c.dtype)[:, 0].astype(np.float64)
    return values if (c.offset, c.factor) == (0.0, 1.0) else c.offset + c.factor * values


def nanoseconds(seconds: np.ndarray) -> np.ndarray:
    """Whole ns, cut off, held at the ends of the range; times that aren't finite are the caller's to leave out."""
    ns = np.nan_to_num(seconds, posinf=0, neginf=0) * 1e9
    low, high = ns <= -(2.0**63), ns >= 2.0**63
    out = np.where(low | high, 0, ns).astype(np.int64)
    return np.where(high, 2**63 - 1, np.where(low, -(2**63), out))


_ROWS = pa.schema([("st_ord", pa.int64()), ("frame_idx", pa.int64()), ("ts", pa.int64()), ("v", pa.float64()), ("content_hash", pa.string())])


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    b, unmapped = Blocks(path), []
    head = b.at(0, 16)
    if not head.startswith(b"MDF"):
        raise SourceError("no MDF file")
    version = head[8:16].decode("latin-1").strip("\0 ")
    if not version.startswith("4"):
        raise SourceError(f"version {version} is not read")
    try:
        found = list(groups(b, unmapped))
    except struct.error as e:
        raise SourceError(f"the file's blocks are corrupt: {e}") from None
    if sum(g.count * len(g.channels) for g in found) > o.max_frames:
        raise SourceError("more frames than the frame budget")
    names: dict[str, int] = {}
    streams = []
    for k, g in enumerate(found):
        for n, c in enumerate(g.channels):
            name = c.name
            while name in names:  # the next free number
                names[c.name] += 1
                name = f"{c.name}#{names[c.name]}"
            names[name] = 1
            streams.append((len(streams), k, n, name, f"mf4-master#{g.number}"))
    number = {(k, n): st for st, k, n, _, _ in streams}
    runs = [(k, first) for k, g in enumerate(found) for first in range(0, g.count, max(1, RUN // g.length))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = found[k]
                n = min(max(1, RUN // g.length), g.count - first)
                data = Blocks(path).at(g.at + first * g.length, n * g.length)
                seconds = column(g.master, data, g.length)
                ok = np.isfinite(seconds)
                ts, place = nanoseconds(seconds)[ok], np.arange(first, first + n)[ok]
                for c_at, c in enumerate(g.channels):
                    v = column(c, data, g.length)[ok]
                    hashes = [hashlib.sha256(x).hexdigest() for x in (v + 0.0).astype("<f8").reshape(-1, 1).view(np.uint8).reshape(len(v), 8)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), number[k, c_at])), pa.array(place), pa.array(ts), pa.array(v), pa.array(hashes, pa.string())], schema=_ROWS)

    source = spark.createDataFrame(runs, "group long, first long")
    rows = source.repartition(max(1, min(len(runs), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "st_ord long, frame_idx long, ts long, v double, content_hash string").persist()
    rec = Recording(spark, dataset_id(path), "mdf4")
    rec.put("frames", rows.withColumn("ep_ord", F.lit(0)))
    v = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    stats = rows.groupBy("st_ord").agg(F.struct(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias("s"), (F.count("*") - F.count(v)).alias("observed_non_finite"), F.count(v).alias("n"))
    table = spark.createDataFrame([(st, name, clock) for st, _, _, name, clock in streams], "st_ord long, name string, clock_id string")
    seen = stats.select("st_ord", F.when(F.col("n") > 0, F.col("s")).alias("observed_stats"), "observed_non_finite")
    rec.put("streams", table.join(seen, "st_ord", "left").withColumns({"ep_ord": F.lit(0), "modality": F.lit("scalar-state"), "clock_kind": F.lit("measured"), "dtype": F.lit("float64")}))
    rec.put("episodes", rows.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).withColumns({"ep_ord": F.lit(0), "episode": F.lit(0)}))
    rec.put("metadata", spark.createDataFrame([("source_format", "mdf4"), ("mdf_version", version)], "key string, value string"))
    rec.put("provenance", spark.createDataFrame([("dataset", 0, "source_format", "mdf4", "known")], "scope_kind string, record_id long, key string, value string, class string"))
    rec.notes = {"omitted": [], "unmapped": unmapped}
    return rec


def _is_mdf(path: str) -> bool:
    if not path.lower().endswith((".mf4", ".mdf")) or not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(3) == b"MDF"


FORMAT = Format("mdf4", _is_mdf, read)
