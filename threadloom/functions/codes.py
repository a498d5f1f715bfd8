"""Enumerations and string dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise

# Codes of tools, roles and actors in exports; an unknown tool is 255.
TOOL_CODES = {"Write": 0, "Read": 1, "Bash": 2, "Edit": 3, "Glob": 4, "Grep": 5, "Task": 6}
ROLE_CODES = {"human": 0, "assistant": 1}
ACTOR_CODES = {"human": 0, "agent": 1}
UNKNOWN = 255


def code(value: Column, codes: dict[str, int], unknown: int = UNKNOWN) -> Column:
    """The code of a value, *unknown* for all others and null."""
    out = None
    for k, v in codes.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(unknown)


def uncode(value: Column, codes: dict[str, int]) -> Column:
    """The value of a code; 'Unknown' for all others."""
    out = None
    for k, v in codes.items():
        out = F.when(value == v, k) if out is None else out.when(value == v, k)
    return out.otherwise("Unknown")


def dense_index(df: DataFrame, out: str, *order: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of the unique columns *order*.

    Rows are sorted in ranges, numbered within each, and the sizes of the ranges before
    are added, so no task holds all rows. The ranges are written once, as a second
    sampling could cut them elsewhere.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per range.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_place") - 1).drop("_part", "_place", "_start")


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(idx, value): each distinct value with its index by first appearance; null has none."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))
    return dense_index(firsts, "idx", "first", "value").select("idx", "value")


def encode(df: DataFrame, value: str, dictionary_df: DataFrame, out: str) -> DataFrame:
    """Replace *value* by its index in *out*; null stays null."""
    d = dictionary_df.select(F.col("idx").alias(out), F.col("value").alias(value))
    return df.join(d, value, "left").drop(value)


def decode(df: DataFrame, idx: str, dictionary_df: DataFrame, out: str) -> DataFrame:
    """Replace the index *idx* by its value in *out*; an index out of range becomes ''."""
    d = dictionary_df.select(F.col("idx").alias(idx), F.col("value").alias(out))
    return df.join(d, idx, "left").withColumn(out, F.coalesce(out, F.lit(""))).drop(idx)
