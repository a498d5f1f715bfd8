"""Read-only SQL over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run one SELECT; anything that does not start with SELECT is refused."""
    if not text.strip().upper().startswith("SELECT"):
        raise ValueError("only SELECT is allowed")
    return spark.sql(text)


def to_ndjson(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in alphabetical order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(set(df.columns))), {"ignoreNullFields": "false"}).alias("value"))
