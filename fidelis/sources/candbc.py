"""CAN logs with a database of messages: a folder with one ``.dbc`` and at least one ``.log`` or ``.asc``.

The database is small and parsed on the driver. Log lines are parsed and decoded by Spark expressions: the payload's
bits are taken from its reversed hex digits (little-endian) or from them as they stand (big-endian).
"""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.model import Recording
from fidelis.sources.registry import Format, Options, SourceError, dataset_id

_MESSAGE = re.compile(r"BO_ (\d+) (\w+) *: *(\d+)")
_SIGNAL = re.compile(r"SG_ (\w+) *(M|m\d+)? *: *(\d+)\|(\d+)@([01])([+-]) *\(([^,]+),([^)]+)\)")
LINE = r"^\s*\((\d+)\.(\d{1,9})\)\s+\S+\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)"


def database(text: str) -> list[tuple]:
    """(id, name, first bit counted from the payload's last, length, big-endian, signed, factor, offset, selector, selected by)."""
    out, message = [], None
    for line in text.split("\n"):
        if m := _MESSAGE.match(line.strip()):
            message = (int(m[1]) & 0x1FFFFFFF, m[2])
        elif message and (m := _SIGNAL.match(line.strip())):
            out.append((message[0], f"{message[1]}.{m[1]}", int(m[3]), int(m[4]), m[5] == "0", m[6] == "-", float(m[7]), float(m[8]), m[2] == "M", int(m[2][1:]) if m[2] and m[2] != "M" else None))
    return out


def logs(path: str) -> list[str]:
    return sorted(n for ext in ("log", "asc") for n in glob.glob(os.path.join(path, f"*.{ext}")))


def number(raw, length, signed):
    """The number that a string of bits stands for, with the sign carried on."""
    unsigned = F.conv(raw, 2, 10).cast("decimal(20,0)").cast("double")
    return F.when(signed & raw.startswith("1"), unsigned - F.pow(F.lit(2.0), length)).otherwise(unsigned)


def bits(hex_digits, start, length, big):
    """The bits of a signal as a string of 0 and 1, most significant first; null if the payload is too short.

    Little-endian: bit ``start`` is the least significant, counted through the bytes from their low ends, so the bytes
    are taken in reverse. Big-endian: bit ``start`` is the most significant, counted in its byte from the high end.
    """
    pairs = F.filter(F.split(hex_digits, "(?<=\\G..)"), lambda x: x != "")
    byte = lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")
    straight = F.array_join(F.transform(pairs, byte), "")
    turned = F.array_join(F.transform(F.reverse(pairs), byte), "")
    first = F.when(big, F.floor(start / 8) * 8 + 7 - start % 8).otherwise(F.length(turned) - start - length)
    return F.when((first >= 0) & (first + length <= F.length(straight)), F.substring(F.when(big, straight).otherwise(turned), (first + 1).cast("int"), length))


def read(spark: SparkSession, path: str, o: Options) -> Recording:
    with open(glob.glob(os.path.join(path, "*.dbc"))[0], encoding="utf-8", errors="replace") as f:
        signals = database(f.read())
    if not signals:
        raise SourceError("a database without signals")
    table = spark.createDataFrame(signals, "id long, name string, start int, length int, big boolean, signed boolean, factor double, offset double, selector boolean, selected long")
    text = spark.read.text(logs(path)).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_order"))
    part = lambda k: F.regexp_extract("value", LINE, k)
    lines = text.where(F.col("value").rlike(LINE)).select("_order", (part(1).cast("long") * 1_000_000_000 + F.rpad(part(2), 9, "0").cast("long")).alias("ts"), F.conv(part(3), 16, 10).cast("long").bitwiseAND(0x1FFFFFFF).alias("id"), part(4).alias("data"))
    if not lines.limit(1).count():
        raise SourceError("no line of the logs can be parsed")
    rec = Recording(spark, dataset_id(path), "can-dbc")
    raw = bits(F.col("data"), F.col("start"), F.col("length"), F.col("big"))
    value = number(F.col("_bits"), F.col("length"), F.col("signed"))
    # A message's selector is decoded in the line itself, and tells which of the message's other signals are in it.
    selectors = F.broadcast(table.where("selector").select("id", "start", "length", "big", "signed"))  # one for each message at most
    lines = lines.join(selectors, "id", "left").withColumn("_bits", raw).withColumn("_mux", value.cast("long")).select("_order", "ts", "id", "data", "_mux")
    j = lines.join(F.broadcast(table), "id").withColumn("_bits", raw).where("_bits IS NOT NULL").withColumn("_raw", value)  # a database file's signals
    j = j.where("selected IS NULL OR selected = _mux")
    names = sorted({s[1] for s in signals})
    numbers = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, st_ord long")
    j = j.withColumn("v", F.col("_raw") * F.col("factor") + F.col("offset")).join(F.broadcast(numbers), "name")
    frames = j.select(F.lit(0).cast("long").alias("ep_ord"), "st_ord", "ts", "v", "_order", F.sha2(F.col("v").cast("string"), 256).alias("content_hash"))
    if frames.count() > o.max_frames:
        raise SourceError("more frames than the frame budget")
    rec.put("frames", frames.withColumn("frame_idx", F.expr("row_number() OVER (PARTITION BY st_ord ORDER BY _order) - 1")))
    stats = frames.groupBy("st_ord").agg(F.struct(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).alias("observed_stats"))
    rec.put("streams", numbers.join(stats, "st_ord", "left").select(F.lit(0).alias("ep_ord"), "st_ord", "name", F.lit("can-signal").alias("modality"), F.lit("can").alias("clock_id"), F.lit("measured").alias("clock_kind"), "observed_stats"))
    rec.put("episodes", spark.createDataFrame([(0, 0)], "ep_ord long, episode long"))
    undefined = lines.join(F.broadcast(table.select("id").distinct()), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).orderBy("id").limit(100)
    rec.notes = {"undefined": [f"{r['id']}: {r['n']}" for r in undefined.collect()]}
    return rec


FORMAT = Format("can-dbc", lambda p: os.path.isdir(p) and len(glob.glob(os.path.join(p, "*.dbc"))) == 1 and bool(logs(p)), read)
