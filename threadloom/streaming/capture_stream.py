"""Streaming capture: transcript lines as they arrive, appended to turns once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom import durable
from threadloom.plans.store import Store
from threadloom.sources import transcripts

LINES = "file_name string, line_no int, raw_line string"


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of line tables (Parquet files of LINES) as they land in *folder*."""
    return spark.readStream.schema(LINES).parquet(folder)


def capture_stream(store: Store, lines: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append the turns of each micro-batch to the store, then stop when all that is there is done.

    Files grow at their end and may come in any number of batches: lines are kept, and
    the files a batch touches are parsed as far as they have come, so places go on where
    they stopped. Ids come from content, so a batch that is run again after a failure
    appends nothing twice.
    """

    def put(batch: DataFrame, _: int) -> None:
        with durable.scope(store.spark):
            new = durable.materialise(batch.select("file_name", "line_no", "raw_line"), "batch")
            store.append("stream_lines", new)
            whole = store.table("stream_lines").join(new.select("file_name").distinct(), "file_name", "left_semi")
            recs = transcripts.records(whole)
            sid = F.sha2(F.concat_ws("|", F.lit("stream"), "file_name"), 256)
            t = transcripts.turns(recs).withColumn("session_id", sid)
            store.append("turns", t.select(F.sha2(F.concat_ws("|", "session_id", "turn_index", "content"), 256).alias("id"), "session_id", "turn_index", "role", "content", "ts"))

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(turns: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window start, role, n_turns) of a stream or table of turns; turns later than *late* are dropped on streams."""
    timed = turns.withColumn("at", F.col("ts").cast("timestamp"))
    w = timed.withWatermark("at", late).groupBy(F.window("at", window), "role").agg(F.count("*").alias("n_turns"))
    return w.select(F.col("window.start").alias("start"), "role", "n_turns")
