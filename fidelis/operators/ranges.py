"""Joins of rows with ranges, and of CAN frames with the signals inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices(ends: DataFrame) -> DataFrame:
    """(episode, start, stop) of cumulative ends (episode, stop): each episode begins where the one before ends."""
    w = Window.orderBy("episode")  # a manifest's few rows
    return ends.withColumn("start", F.lag("stop", 1, 0).over(w)).select("episode", "start", "stop")


def in_ranges(rows: DataFrame, at: str, ranges: DataFrame, width: int = 4096) -> DataFrame:
    """``rows`` with the columns of the range (start <= at < stop) that holds them.

    Both sides get the number of a block of ``width`` places, so the join is an equi-join on blocks, not a loop over all
    ranges for each row; a range stands in as many blocks as it covers.
    """
    blocks = ranges.where("start < stop").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return rows.withColumn("_block", F.floor(F.col(at) / width)).join(blocks, "_block").where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).drop("_block")


def intel(payload: Column, start: Column, length: Column, signed: Column) -> Column:
    """The ``length`` bits from bit ``start`` of a little-endian payload of at most 63 bits, with the sign carried on."""
    mask = F.expr("shiftleft(1L, length) - 1")
    raw = F.call_function("shiftright", payload, start).bitwiseAND(mask)
    top = F.expr("shiftleft(1L, length - 1)")
    return F.when(signed & (raw.bitwiseAND(top) != 0), raw - F.expr("shiftleft(1L, length)")).otherwise(raw)


def decoded(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """frames (id, ts, payload) ⋈ signals (id, signal, start, length, signed, factor, offset, mux, mux_value): one row for each value.

    The table of signals is a database file's; a multiplexed signal counts only in frames whose selector has its value.
    """
    j = frames.join(signals, "id")
    sel = F.call_function("shiftright", F.col("payload"), F.col("mux")).bitwiseAND(F.lit(255))
    j = j.where(F.col("mux").isNull() | (sel == F.col("mux_value")))
    return j.withColumn("value", intel(F.col("payload"), F.col("start"), F.col("length"), F.col("signed")) * F.col("factor") + F.col("offset"))


def undefined(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, n): frames that no message defines."""
    return frames.join(signals.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))
