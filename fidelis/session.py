"""Sessions, and the package on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def session(app: str = "fidelis", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that queries here assume; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once an application, whatever their own path is."""
    context = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not getattr(context, "_fidelis_batch", False) and not context.getConf().contains(batch) and spark.conf.get(batch) == "10000":
        # Nobody has chosen a size. Rows may be long texts: a batch of them must fit into a worker several times.
        spark.conf.set(batch, "1000")
        context._fidelis_batch = True
    if getattr(context, "_fidelis_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    # Executors fetch the file when they first need it, from the driver, so its folder lives as long as the application.
    context._fidelis_folder = folder = tempfile.TemporaryDirectory()
    path = os.path.join(folder.name, "fidelis_package.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    context._fidelis_shipped = True
