"""Places and neighbours within groups of any size.

A window over a group holds all of it in one task. Here rows are sorted in ranges of
(group, order), so a large group is many ranges; each range is worked on its own, and
one row per range and group carries over what comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise


def ranged(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows in ranges of (key, order), numbered by ``_part``; written once, as a second sampling could cut elsewhere."""
    return materialise(df.repartitionByRange(F.col(key).asc(), *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, key: str, out: str, *order: Column) -> DataFrame:
    """Add *out*: 1, 2, ... within each *key* in the given order, which should have no ties."""
    rows = ranged(df, key, *order)
    sizes = rows.groupBy("_part", key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    placed = rows.withColumn(out, here)
    joined = placed.join(starts, (placed["_part"] == starts["_part"]) & F.equal_null(placed[key], starts["_key"]))
    return joined.withColumn(out, F.col("_start") + F.col(out)).select(*df.columns, out)


def with_previous(df: DataFrame, key: str, col: str, out: str, *order: Column) -> DataFrame:
    """Add *out*: the value of *col* in the row before within each *key*, null for the first."""
    rows = ranged(df, key, *order)
    w = Window.partitionBy("_part", key).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn(out, F.lag(col).over(w))
    lasts = rows.withColumn("_n", F.row_number().over(w)).groupBy("_part", key).agg(F.max_by(F.struct(col), "_n")[col].alias("_last"))
    carried = lasts.select("_part", F.col(key).alias("_key"), F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_carried"))
    joined = marked.join(carried, (marked["_part"] == carried["_part"]) & F.equal_null(marked[key], carried["_key"]))
    return joined.withColumn(out, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col(out))).select(*df.columns, out)
