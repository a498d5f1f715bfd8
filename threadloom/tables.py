"""Reading the named tables below one root folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table *name* of *root*; only the columns used downstream are scanned."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temp views, one per table, for the SQL surface."""
    for name in names:
        load(spark, root, name).createOrReplaceTempView(name)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table of exactly one row, as a scalar subquery: no join, no broadcast."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")
