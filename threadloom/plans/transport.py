"""Export of what is new, import with dedup, and team merge. Exports are Parquet batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.plans.index import build_index
from threadloom.plans.store import Store
from threadloom.schemas import TRUTH
from threadloom.tables import with_row

#: The version of the layout of a batch.
FORMAT = 1
PARTS = ["sessions", "turns", "tool_calls", "checkpoints", "files_touched", "checkpoint_sessions"]


def delta(checkpoints: DataFrame, links: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of unexported checkpoints: their links to sessions that exist, and those sessions."""
    mine = links.join(checkpoints.select(F.col("id").alias("checkpoint_id")), "checkpoint_id", "left_semi")
    held = sessions.join(mine.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    return mine.join(held.select(F.col("id").alias("session_id")), "session_id", "left_semi"), held


def counters(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows of each table a batch holds."""
    counted = [df.agg(F.count("*").alias(f"n_{name}")) for name, df in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = with_row(out, c)
    return out


def export_delta(store: Store, out: str, batch: str) -> int:
    """Write the unexported checkpoints with all that hangs on them as one batch below *out*; how many they were.

    The batch is written first and marked afterwards, so an interrupted export is
    repeated, never lost. Earlier batches are never touched.
    """
    cps = materialise(store.unexported(), "unexported")
    n = cps.count()
    if n == 0:
        return 0
    links, held = delta(cps, store.table("checkpoint_sessions"), store.table("sessions"))
    ids = held.select(F.col("id").alias("session_id"))
    parts = {
        "sessions": held,
        "turns": store.table("turns").join(ids, "session_id", "left_semi"),
        "tool_calls": store.table("tool_calls").join(ids, "session_id", "left_semi"),
        "checkpoints": cps,
        "files_touched": store.table("files_touched").join(cps.select(F.col("id").alias("checkpoint_id")), "checkpoint_id", "left_semi"),
        "checkpoint_sessions": links,
    }
    counters(parts).withColumn("version", F.lit(FORMAT)).coalesce(1).write.mode("overwrite").parquet(f"{out}/meta/batch={batch}")
    for name, rows in parts.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={batch}")
    store.append("exported", cps.select(F.col("id").alias("checkpoint_id"), F.lit(batch).alias("batch")))
    return n


def read_export(spark: SparkSession, src: str) -> dict[str, DataFrame]:
    """The tables of an export with all its batches."""
    return {name: spark.read.option("basePath", f"{src}/{name}").schema(TRUTH[name]).parquet(f"{src}/{name}/batch=*") for name in PARTS}


def import_batches(store: Store, src: str) -> int:
    """Append the sessions, checkpoints and their rows that the store lacks; the number of new sessions.

    Links count only if their session exists. Imported checkpoints are marked exported,
    so they are not sent back.
    """
    parts = read_export(store.spark, src)
    before = store.table("sessions").count()
    for name in ("sessions", "turns", "tool_calls", "checkpoints", "files_touched"):
        store.append(name, parts[name])
    known = store.table("sessions").select(F.col("id").alias("session_id"))
    store.append("checkpoint_sessions", parts["checkpoint_sessions"].join(known, "session_id", "left_semi"))
    seen = store.table("exported").select("checkpoint_id")
    store.append("exported", parts["checkpoints"].select(F.col("id").alias("checkpoint_id")).distinct().join(seen, "checkpoint_id", "left_anti").withColumn("batch", F.lit("imported")))
    return store.table("sessions").count() - before


def sync_self(store: Store, src: str, index_root: str, root: str = "") -> int:
    """Take one's own exports back into the truth tables, then rebuild the index; the number of new sessions."""
    n = import_batches(store, src)
    build_index(store, index_root, root)
    return n


def merge_team(own: dict[str, DataFrame], others: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of all members for an index; a row whose key an earlier member has is left out."""
    from threadloom.schemas import KEYS

    out = dict(own)
    for other in others:
        for name in own:
            new = other[name].select(*out[name].columns).dropDuplicates(KEYS[name])
            out[name] = out[name].unionByName(new.join(out[name].select(*KEYS[name]), KEYS[name], "left_anti").select(*out[name].columns))
    return out
