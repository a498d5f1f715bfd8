"""A session with the settings the engine is written for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def session(app: str = "threadloom", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session; *conf* (dots as double underscores) overrides the settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="spark-threadloom-"), "threadloom")
        spark.sparkContext.addPyFile(shutil.make_archive(out, "zip", os.path.dirname(here), "threadloom"))
        _SHIPPED.add(app)
