"""A root folder of append-only Parquet tables; state that changes is kept as versions, latest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from threadloom.schemas import KEYS, TRUTH


class Store:
    """The truth tables below one root. Appending never rewrites a file."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table; empty, with its schema, if nothing was written yet."""
        try:
            return self.spark.read.schema(TRUTH[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], TRUTH[name])

    def truth(self) -> dict[str, DataFrame]:
        """The tables an index is derived from."""
        return {n: self.table(n) for n in ("sessions", "turns", "tool_calls", "checkpoints", "files_touched", "checkpoint_sessions")}

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows in the table's columns; rows whose key is there already, or repeated, are left out."""
        cols = [c.split()[0] for c in TRUTH[name].split(", ")]
        rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in TRUTH[name].split(", "))]) if set(cols) <= set(rows.columns) else rows
        if name in KEYS:
            rows = rows.dropDuplicates(KEYS[name]).join(self.table(name).select(*KEYS[name]), KEYS[name], "left_anti").select(*cols)
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def state(self) -> DataFrame:
        """The latest version of each file's cached state."""
        w = Window.partitionBy("file_path").orderBy(F.desc("version"))
        return self.table("checkpoint_state").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def unexported(self) -> DataFrame:
        """Checkpoints that no export batch holds yet."""
        return self.table("checkpoints").join(self.table("exported").select(F.col("checkpoint_id").alias("id")), "id", "left_anti")
