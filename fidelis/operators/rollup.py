"""What is counted over findings, labels and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_episode(findings: DataFrame) -> DataFrame:
    s = lambda x: F.sum((F.col("severity") == x).cast("long"))
    return findings.where("episode IS NOT NULL").groupBy("episode").agg(s("error").alias("errors"), s("warning").alias("warnings"), s("info").alias("infos"))


def worst_episodes(findings: DataFrame, n: int = 10) -> DataFrame:
    return per_episode(findings).orderBy(F.desc("errors"), F.desc("warnings"), F.desc("infos"), "episode").limit(n)


def trust_score(findings: DataFrame, coverage: DataFrame, errored: int = 0) -> DataFrame:
    """One row: data (from findings outside provenance), provenance (per cent of the expected keys), score and grade."""
    s = lambda x: F.coalesce(F.sum((F.col("severity") == x).cast("long")), F.lit(0))
    f = findings.where("category <> 'provenance'").agg(s("error").alias("e"), s("warning").alias("w"))
    c = coverage.agg(F.floor(100 * F.sum((F.col("class") != "unknown").cast("long")) / F.count("*")).cast("long").alias("provenance"))
    data = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("e") - 4 * F.col("w") - 10 * errored))
    out = f.crossJoin(c).select(data.cast("long").alias("data"), "provenance")  # one row each
    out = out.withColumn("score", F.floor((7 * F.col("data") + 3 * F.col("provenance")) / 10).cast("long"))
    g = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return out.withColumn("grade", g)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of both with ``change``: introduced, resolved or unchanged. Whole findings are compared and keep their number."""
    key = F.sha2(F.to_json(F.struct(*old.columns), {"ignoreNullFields": "false"}), 256)
    o, n = old.withColumn("_k", key), new.withColumn("_k", key)
    tag = lambda d, x: d.drop("_k").withColumn("change", F.lit(x))
    return tag(n.join(o, "_k", "left_anti"), "introduced").unionByName(tag(o.join(n, "_k", "left_anti"), "resolved")).unionByName(tag(n.join(o, "_k", "left_semi"), "unchanged"))


def scenario_coverage(labels: DataFrame, sparse: float = 0.1) -> DataFrame:
    """Of each dimension (key) and value: episodes that have it, episodes the dimension covers, and whether it is sparse."""
    l = labels.select("ep_ord", "key", "value").distinct()  # noqa: E741
    covered = l.groupBy("key").agg(F.countDistinct("ep_ord").alias("covered"))
    return l.groupBy("key", "value").agg(F.count("*").alias("episodes")).join(covered, "key").withColumn("sparse", F.col("episodes") < sparse * F.col("covered"))


def ordered_coverage(labels: DataFrame, sparse: float = 0.1) -> DataFrame:
    """``scenario_coverage`` of labels whose keys name one of the six dimensions, in their order, each's most frequent value first."""
    from fidelis.sources.scenario import DIMENSIONS

    spellings = [(s, d, k) for k, (d, names) in enumerate(DIMENSIONS.items()) for s in names]
    named = labels.sparkSession.createDataFrame(spellings, "spelling string, dimension string, place int")
    known = labels.withColumn("spelling", F.lower(F.trim("key"))).join(F.broadcast(named), "spelling")  # a few spellings
    of = scenario_coverage(known.select("ep_ord", F.col("dimension").alias("key"), "value"), sparse)
    place = F.array_position(F.array(*(F.lit(d) for d in DIMENSIONS)), F.col("key"))
    return of.orderBy(place, F.desc("episodes"), "value")


def transitions(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from that of the row before, with it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(state).over(w)).where(F.col("before") != F.col(state))


def repeated_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(first, n) of each group of rows with equal content."""
    return rows.groupBy(F.sha2(content, 256).alias("h")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("first", "n")
