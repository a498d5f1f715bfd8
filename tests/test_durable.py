import os

import pytest
from pyspark.sql import functions as F

from threadloom import durable
from threadloom.tables import with_row


def test_written_tables_and_discard(spark):
    df = durable.materialise(spark.range(5).withColumn("x", F.array(F.lit("a"))), "test")
    assert df.count() == 5 and durable.shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and durable.discard(spark) >= 1 and not os.path.exists(path)


def test_scope_removes_its_own_steps_only(spark):
    kept = durable.materialise(spark.range(3), "kept")
    with durable.scope(spark):
        inner = durable.materialise(spark.range(2), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 2
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://h:7077", "none"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        durable.shared_dir(Session())


def test_with_row(spark):
    stats = spark.range(4).agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = with_row(spark.range(2), stats)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(0, 4, 3), (1, 4, 3)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
