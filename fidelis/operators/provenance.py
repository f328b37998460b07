"""Checks of provenance: what is known about where a dataset comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators.base import PLACEHOLDERS, Check, found, plain

# What a dataset should state, and how severe it is if it doesn't.
EXPECTED = {"license": "warning", "sensor": "info", "clock": "info", "calibration": "info", "annotator": "info", "upstream": "info"}
CLASS_RANK = {"unknown": 0, "asserted": 1, "known": 2}


def real(value, cls):
    """Known or asserted, with a value that is no placeholder."""
    return cls.isin("known", "asserted") & value.isNotNull() & ~plain(value).isin(*PLACEHOLDERS)


def coverage(rec):
    """One row for each expected key: key and class, the strongest class of a real value (unknown if there is none)."""
    keys = rec.spark.createDataFrame([(k,) for k in EXPECTED], "key string")
    rank = F.when(real(F.col("value"), F.col("class")), F.when(F.col("class") == "known", 2).otherwise(1))
    best = rec.provenance.groupBy("key").agg(F.max(rank).alias("r"))
    r = F.coalesce("r", F.lit(0))
    return keys.join(best, "key", "left").select("key", F.when(r == 2, "known").when(r == 1, "asserted").otherwise("unknown").alias("class"))


def completeness(rec, tol):
    p = rec.provenance
    has = F.col("value").isNotNull()
    odd = p.where(((F.col("class") == "unknown") & has) | (F.col("class").isin("known", "asserted") & ~has))
    out = found(odd, "INCONSISTENT", "warning", texts=["scope_kind", "key", "class"])
    empty = p.where(F.col("class").isin("known", "asserted") & has & plain(F.col("value")).isin(*PLACEHOLDERS)).groupBy("key").agg(F.min("value").alias("value"))
    out = out.union(found(empty, "PLACEHOLDER_VALUE", "info", texts=["key", "value"]))
    lack = coverage(rec).where("class = 'unknown'")
    severity = F.when(F.col("key") == "license", "warning").otherwise("info")
    return out.union(found(lack, F.concat(F.lit("MISSING_"), F.upper("key")), severity, texts=["key"]))


CHECKS = (Check("provenance.completeness", "What is stated of the source", {"INCONSISTENT": "warning", "PLACEHOLDER_VALUE": "info"} | {f"MISSING_{k.upper()}": v for k, v in EXPECTED.items()}, completeness),)
