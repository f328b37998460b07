"""Zarr 2 stores: replay buffers cut by ``meta/episode_ends``, a group for each episode, or one flat episode.

The driver reads the JSON of arrays and groups, never their chunks. A run of rows of an array (those of one chunk along
its first dimension) is a row of a table; tasks read the chunks of a run, put its rows together and hash them. Rows find
their episodes by the range join, so neither boundaries nor rows are looped over.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions import sampling
from fidelis.model import Recording
from fidelis.operators.statistical import dimension_stats, worst_saturation
from fidelis.sources import compression
from fidelis.sources.registry import Format, Options, SourceError

# Names of timelines, attributes of tasks and of provenance, and units of time in ns.
TIMES = ("timestamp", "timestamps", "time", "times")
TASKS = ("language_instruction", "task")
LINEAGE = {"license": "license", "author": "author", "date": "created"}
UNITS = {
    1_000_000_000: ("s", "sec", "secs", "second", "seconds"),
    1_000_000: ("ms", "millisecond", "milliseconds"),
    1_000: ("us", "µs", "microsecond", "microseconds"),
    1: ("ns", "nanosecond", "nanoseconds"),
}
#: Values of a row up to which each has statistics of its own; arrays, levels and episodes of a store.
WIDE, ARRAYS, DEPTH, EPISODES = 256, 100_000, 16, 1_000_000


def ns_per_unit(units: str | None) -> int | None:
    units = (units or "").strip().lower()
    return next((ns for ns, names in UNITS.items() if units in names), None)


def trailing_number(name: str) -> int | None:
    m = re.search(r"([0-9]+)$", name)
    return int(m[1]) if m and int(m[1]) < 1 << 64 else None


@dataclass(frozen=True)
class Array:
    path: str  # in the store
    folder: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: bytes  # of one item
    codec: str | None
    separator: str

    @property
    def leaf(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def row_items(self) -> int:
        return int(np.prod(self.shape[1:], dtype=object)) if len(self.shape) > 1 else 1

    @property
    def numeric(self) -> bool:
        return self.dtype.kind in "iufb"

    @property
    def modality(self) -> str:
        if self.leaf in ("action", "actions"):
            return "action"
        image = self.dtype == np.uint8 and len(self.shape) == 4 and self.shape[3] in (1, 3, 4)
        return "video" if image else "scalar-state"

    def chunk(self, at: tuple[int, ...], most: int) -> np.ndarray:
        """A whole chunk, in the order of its items; one that isn't stored is full of the fill value."""
        size = int(np.prod(self.chunks, dtype=object)) * self.dtype.itemsize
        name = os.path.join(self.folder, self.separator.join(map(str, at)))
        if not os.path.isfile(name):
            return np.frombuffer(self.fill * (size // self.dtype.itemsize), self.dtype).reshape(self.chunks)
        if os.path.islink(name):
            raise SourceError(f"{name} is a link")
        if size > most:
            raise SourceError(f"a chunk of {size} bytes is over the decompression budget")
        with open(name, "rb") as f:
            data = f.read()
        inflate = {None: lambda d, _: d, "zlib": compression.deflate, "gzip": lambda d, n: compression.deflate(d, n, 31), "zstd": compression.zstd, "lz4": lambda d, n: compression.lz4_block(d[4:], n), "blosc": compression.blosc}[self.codec]
        try:
            data = inflate(data, size)
        except compression.Corrupt as e:
            raise SourceError(f"{name}: {e}") from None
        if len(data) != size:
            raise SourceError(f"{name} holds {len(data)} bytes of {size}")
        return np.frombuffer(data, self.dtype).reshape(self.chunks)

    def rows(self, run: int, most: int) -> np.ndarray:
        """The rows of the run of that number along the first dimension."""
        first, last = run * self.chunks[0], min((run + 1) * self.chunks[0], self.shape[0])
        out = np.empty((last - first, *self.shape[1:]), self.dtype)
        for at in itertools.product(*(range(-(-n // c)) for n, c in zip(self.shape[1:], self.chunks[1:], strict=True))):
            block = self.chunk((run, *at), most)
            where = tuple(slice(k * c, min((k + 1) * c, n)) for k, n, c in zip(at, self.shape[1:], self.chunks[1:], strict=True))
            part = (slice(0, last - first), *(slice(0, s.stop - s.start) for s in where))
            out[(slice(None), *where)] = block[part]
        return out


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except FileNotFoundError:
        return {}
    except ValueError as e:
        raise SourceError(f"{path}: {e}") from None
    return got if isinstance(got, dict) else {}


def opened(folder: str, path: str) -> Array:
    z = _json(os.path.join(folder, ".zarray"))
    try:
        dtype = np.dtype(z["dtype"])
        shape, chunks = tuple(map(int, z["shape"])), tuple(map(int, z["chunks"]))
    except (KeyError, TypeError, ValueError) as e:
        raise SourceError(f"{path}: {e}") from None
    codec = (z.get("compressor") or {}).get("id")
    if z.get("filters") or z.get("order", "C") != "C" or codec not in (None, "zlib", "gzip", "zstd", "lz4", "blosc") or dtype.hasobject or dtype.fields:
        raise SourceError(f"{path}: filters, an order or a codec that is not read")
    if not shape or len(shape) != len(chunks) or min(chunks) < 1 or min(shape) < 0:
        raise SourceError(f"{path}: its shape and its chunks don't fit")
    fill = z.get("fill_value")
    try:
        item = np.array(float(fill) if isinstance(fill, str) and dtype.kind == "f" else fill or 0).astype(dtype).tobytes()
    except (TypeError, ValueError):
        item = b"\0" * dtype.itemsize
    return Array(path, folder, shape, chunks, dtype, item, codec, z.get("dimension_separator", "."))


def found(folder: str, prefix: str, unmapped: list[str], depth: int = 0) -> Iterator[Array]:
    if depth > DEPTH:
        raise SourceError(f"groups lie deeper than {DEPTH} levels")
    for name in sorted(os.listdir(folder)):
        sub, path = os.path.join(folder, name), f"{prefix}/{name}" if prefix else name
        if os.path.islink(sub):
            unmapped.append(path)  # what it leads to is no part of the store
        elif os.path.isfile(os.path.join(sub, ".zarray")):
            try:
                yield opened(sub, path)
            except SourceError:
                unmapped.append(path)
        elif os.path.isfile(os.path.join(sub, ".zgroup")):
            yield from found(sub, path, unmapped, depth + 1)
        elif os.path.isdir(sub):
            unmapped.append(path)


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    inside = lambda *names: os.path.join(path, *names)
    if not any(os.path.isfile(inside(n)) for n in (".zgroup", ".zarray")):
        raise SourceError(f"version {_json(inside('zarr.json')).get('zarr_format', 3)} of the layout is not read")
    attrs, unmapped = _json(inside(".zattrs")), []
    stored = sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if not os.path.islink(os.path.join(d, n)))
    most = max(64 << 20, o.max_expansion * stored)
    name = os.path.basename(os.path.realpath(path)).removesuffix(".zarr")
    data = inside("data") if os.path.isfile(inside("data", ".zgroup")) else path
    arrays = [opened(path, name)] if os.path.isfile(inside(".zarray")) else sorted(found(data, "", unmapped), key=lambda a: a.path)
    if len(arrays) > ARRAYS:
        raise SourceError(f"over {ARRAYS} arrays")

    ends = None
    if os.path.isfile(inside("meta", "episode_ends", ".zarray")):
        a = opened(inside("meta", "episode_ends"), "meta/episode_ends")
        if len(a.shape) != 1 or a.dtype.kind not in "iu":
            raise SourceError("meta/episode_ends is no list of integers")
        if a.shape[0] > EPISODES:
            raise SourceError(f"over {EPISODES} episodes")
        ends = [int(x) for k in range(-(-a.shape[0] // a.chunks[0])) for x in a.rows(k, most)]
        top = max((a.shape[0] for a in arrays), default=0)
        if any(z < y for y, z in zip([0, *ends], ends)) or ends and ends[-1] > top:
            raise SourceError("meta/episode_ends falls, or is past the arrays' rows")
        if ends and ends[-1] < top:
            unmapped.append(f"data/*[{ends[-1]}..{top}]")
        # (index, source, first row, last row, prefix of its arrays)
        cuts = [(k, f"meta/episode_ends[{k}]", y, z, "") for k, (y, z) in enumerate(zip([0, *ends], ends))]
    elif any("/" not in a.path for a in arrays):
        unmapped += [a.path for a in arrays if "/" in a.path]
        arrays = [a for a in arrays if "/" not in a.path]
        cuts = [(0, os.path.basename(data) or "/", 0, max(a.shape[0] for a in arrays), "")]
    else:
        groups = sorted({a.path.partition("/")[0] for a in arrays})
        numbers = [trailing_number(g) for g in groups]
        own = None not in numbers and len(set(numbers)) == len(numbers)
        cuts = [(numbers[k] if own else k, g, 0, max(a.shape[0] for a in arrays if a.path.startswith(g + "/")), g + "/") for k, g in enumerate(groups)]
    if not cuts:
        raise SourceError("no episodes: neither meta/episode_ends nor a group of arrays")
    rec = Recording(spark, name, "zarr")
    if o.sampled:
        every = [c[0] for c in cuts]
        chosen = set(sampling.first(every, o.first) if o.first is not None else sampling.fraction(every, o.fraction, o.seed))
        cuts, rec.coverage = [c for c in cuts if c[0] in chosen], "sample"

    task = next((str(v).strip() for n, v in sorted(attrs.items()) if n.lower() in TASKS and isinstance(v, str) and v.strip()), None)
    assembled(spark, rec, arrays, cuts, o, most, unmapped, lambda a: _json(os.path.join(a.folder, ".zattrs")).get("units"), lambda _: task, "zarr")
    text = lambda v: (v if isinstance(v, str) else json.dumps(v, separators=(",", ":")))[:4096]
    top = [("dataset", None, 0, "source_format", "zarr")] + [("dataset", None, 0, LINEAGE[n.lower()], text(v)) for n, v in sorted(attrs.items()) if n.lower() in LINEAGE]
    own = [("episode", c[0], n + 1, "upstream", c[1]) for n, c in enumerate(cuts)]
    rec.put("provenance", spark.createDataFrame(top + own, "scope_kind string, scope_episode long, record_id long, key string, value string").withColumn("class", F.lit("known")))
    declared = [("declared_total_episodes", str(len(cuts)))] if o.sampled or ends is not None else []
    rec.put("metadata", spark.createDataFrame([("source_format", "zarr"), ("zarr_format", "2"), *((f"zarr:{n}", text(v)) for n, v in sorted(attrs.items())), *declared], "key string, value string"))
    return rec


def assembled(spark: SparkSession, rec: Recording, arrays: list, cuts: list[tuple], o: Options, most: int, unmapped: list[str], units, task, kind: str) -> None:
    """Puts frames, streams, episodes and labels of arrays into ``rec``.

    An array has path, leaf, shape, chunks, dtype, numeric, row_items, modality and rows(run, most). A cut is an episode:
    (index, source, first row, last row, prefix of its arrays). ``units`` tells an array's units, ``task`` a cut's task.
    """
    prefixes = sorted({c[4] for c in cuts})
    used = [(p, k, a) for p in prefixes for k, a in enumerate(arrays) if a.path.startswith(p)]
    # A timeline for each prefix: the first of its arrays by name that is one column with units.
    timeline: dict[str, tuple[int, int]] = {}
    for p, k, a in used:
        if p not in timeline and a.leaf in TIMES and a.numeric and (len(a.shape) == 1 or len(a.shape) == 2 and a.shape[1] == 1):
            ns = ns_per_unit(units(a))
            if ns is None:
                unmapped.append(a.path)  # its numbers can't be placed on a clock
            timeline[p] = (k, ns or 0)
    clocks = {p: (k, ns) for p, (k, ns) in timeline.items() if ns}
    if sum(max(0, min(c[3], a.shape[0]) - c[2]) for c in cuts for p, _, a in used if p == c[4]) > o.max_frames:
        raise SourceError("more frames than the frame budget")

    clock_arrays = {k for k, _ in clocks.values()}
    schema = pa.schema([("array", pa.int64()), ("row", pa.int64()), ("hash", pa.string()), ("v", pa.list_(pa.float64())), ("bad", pa.int64()), ("t", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = arrays[k]
                got = a.rows(part, most)
                n, first = len(got), part * a.chunks[0]
                hashes = [hashlib.sha256(r.tobytes()).hexdigest() for r in got]
                flat = got.reshape(n, -1).astype(np.float64) if a.numeric else None
                values = [None] * n if flat is None or flat.shape[1] > WIDE else list(flat)
                bad = [None] * n if flat is None else (~np.isfinite(flat)).sum(axis=1).tolist()
                if k in clock_arrays and not np.isfinite(flat).all():
                    raise SourceError(f"{a.path} holds a time that is not finite")
                times = flat[:, 0].tolist() if k in clock_arrays else [None] * n
                columns = ([k] * n, range(first, first + n), hashes, values, bad, times)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    runs = [(k, part) for k in sorted({k for _, k, _ in used}) for part in range(-(-arrays[k].shape[0] // arrays[k].chunks[0]))]
    source = spark.createDataFrame(runs, "array long, part long")
    rows = source.repartition(max(1, min(len(runs), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "array long, row long, hash string, v array<double>, bad long, t double").persist()

    st = {p: {k: n for n, k in enumerate(k for q, k, _ in used if q == p)} for p in prefixes}
    covers = lambda p, upto: p in clocks and arrays[clocks[p][0]].shape[0] >= upto
    member, streams = [], []
    for n, (index, _, y, z, p) in enumerate(cuts):
        for k, s in st[p].items():
            a = arrays[k]
            stop = min(z, a.shape[0])
            if stop <= min(y, a.shape[0]):
                continue
            timed = covers(p, stop)
            member.append((k, n, s, y, stop, timed, *(clocks[p] if timed else (None, None))))
            streams.append((n, s, a.path.removeprefix(p), a.modality, f"{kind}-time" if timed else f"{kind}-step-index", "measured" if timed else "step-index", a.dtype.name, list(a.shape[1:]) or None, k))
    if not streams:
        raise SourceError("no arrays under any episode")
    parts = spark.createDataFrame(member, "array long, ep_ord long, st_ord long, start long, stop long, timed boolean, clock long, ns long")
    held = _held(rows, parts)
    times = rows.where("t IS NOT NULL").select(F.col("array").alias("clock"), "row", "t")
    ts = F.when(F.col("timed"), (F.col("t") * F.col("ns")).cast("long")).otherwise(F.col("row") - F.col("start"))
    frames = held.drop("t").join(times, ["clock", "row"], "left").select("ep_ord", "st_ord", (F.col("row") - F.col("start")).alias("frame_idx"), ts.alias("ts"), F.col("hash").alias("content_hash"))
    rec.put("frames", frames)
    base = spark.createDataFrame(streams, "ep_ord long, st_ord long, name string, modality string, clock_id string, clock_kind string, dtype string, shape array<long>, array long")
    key = ("ep_ord", "st_ord")
    s = dimension_stats(held.where("v IS NOT NULL"), key, "v")
    four = F.struct("min", "max", "mean", "std")
    dims = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("long").alias("dim"), "min", "max", "mean", "std")))
    g = s.groupBy(*key).agg(F.max(F.when(F.col("dim") == 0, four)).alias("observed_stats"), dims.alias("observed_dim_stats"))
    w = worst_saturation(s, key).select(*key, F.struct("n", "at_min", "at_max", "min", "max", F.col("dim").cast("long").alias("dim")).alias("observed_saturation"))
    bad = held.where("bad IS NOT NULL").groupBy(*key).agg(F.sum("bad").alias("observed_non_finite"))
    rec.put("streams", base.join(g, [*key], "left").join(w, [*key], "left").join(bad, [*key], "left"))

    eps = spark.createDataFrame([(n, c[0], c[1], task(c), all(x[5] for x in member if x[1] == n) and any(x[1] == n for x in member), c[4] in clocks) for n, c in enumerate(cuts)], "ep_ord long, episode long, source string, task string, timed boolean, clocked boolean")
    edge = frames.groupBy("ep_ord").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    ends_known = F.col("timed") | ~F.col("clocked")
    rec.put("episodes", eps.join(edge, "ep_ord", "left").select("ep_ord", "episode", "task", *(F.when(ends_known, F.col(c)).alias(c) for c in ("start_ts", "end_ts"))))
    rec.put("labels", eps.where("task IS NOT NULL").select("ep_ord", F.lit("language").alias("key"), F.col("task").alias("value")))
    rec.notes = {"omitted": sorted({a.path for _, _, a in used if a.numeric and a.row_items > WIDE}), "unmapped": unmapped}


def _held(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of arrays with the episode that holds them: the range join, within each array."""
    width = 4096
    blocks = parts.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return rows.withColumn("_block", F.floor(F.col("row") / width)).join(blocks, ["array", "_block"]).where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("stop")))


FORMAT = Format("zarr", lambda p: os.path.isdir(p) and any(os.path.isfile(os.path.join(p, n)) for n in (".zgroup", ".zarray", "zarr.json")), read, samples=True)
