"""What the operators of this subpackage share about tables: keys, tables in the shared folder, names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there


class Scratch:
    """Tables that one run of an operator writes into the shared folder and drops when their last reader has run.

    What is not dropped, as the operator's result is read from it, goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.paths = spark, new_folder(spark, name), {}
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.top)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            drop_folder(self.spark, path)
        # Shuffle files go when the JVM collects the plans that wrote them.
        self.spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it needs to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, key: str = "doc_id", value: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``key`` (long), ``value`` and ``more`` (strings), one row for each key.

    Rows without a key can't be named in a result and are left out; of rows that repeat a key, the smallest value of
    each column counts (null only if all are null). Other columns, whatever their names, are not looked at. Only the
    keys are shuffled to find out whether any repeats; the texts are only if one does.
    """
    df = df.select(F.col(key).cast("long").alias(key), *(F.col(v).cast("string").alias(v) for v in (value, *more))).where(F.col(key).isNotNull())
    again = df.select(key).groupBy(key).count().where("count > 1").limit(1).count()
    return df.groupBy(key).agg(*(F.min(v).alias(v) for v in (value, *more))) if again else df
