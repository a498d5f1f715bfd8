"""Cutting lineage with tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only on one machine (a local
master, as in tests) a temporary folder takes its place where it is unset. A written
table survives the loss of any executor and keeps column statistics, which a cached one
does not. Plans that end by writing their result remove their steps (:func:`scope`);
whoever gets a table that is still to be computed calls :func:`discard` after using it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-threadloom-")
    return _OWN[app]


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write *df* to the shared folder and read it back: same rows, no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this session wrote (after the first *since*); call it when no result that reads them is needed any more."""
    every = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths, every[since:] = every[since:], []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Discard at its end what was written inside; for plans whose results are written by then."""
    since = len(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        discard(spark, since)
