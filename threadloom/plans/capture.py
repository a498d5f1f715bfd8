"""Capture: new or grown transcripts of a folder into the truth tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from threadloom import durable
from threadloom.durable import materialise
from threadloom.operators.sessions import WRITING_TOOLS
from threadloom.plans import index
from threadloom.plans.store import Store
from threadloom.sources import scan, transcripts
from threadloom.tables import with_row


@dataclass
class Commit:
    """What version control says about the commit captured for."""

    sha: str
    branch: str
    email: str
    ts: str
    name_status: list[str]
    root: str = ""


def capture(store: Store, folder: str, commit: Commit, index_root: str | None = None) -> int:
    """Capture what changed since the last run; the number of sessions captured.

    The index at *index_root*, if one is built there, is extended by the new sessions.

    A file counts by its content hash, so a second run captures nothing. Ids are derived
    from the content, so a repeated or interrupted run appends no row twice. Files
    without turns and calls give no session; without any session there is no checkpoint.
    """
    with durable.scope(store.spark):
        n = _capture(store, folder, commit)
    if n and index_root and index.read_state(store.spark, index_root):
        index.extend_index(store.spark, store.truth(), index_root, commit.root)
    return n


def _capture(store: Store, folder: str, commit: Commit) -> int:
    spark = store.spark
    files = materialise(scan.changed(scan.file_state(spark, folder), store.state(), store.table("sessions")), "files")
    recs = transcripts.records(transcripts.read_lines(spark, folder).join(files.select("file_name"), "file_name", "left_semi"))
    key = files.select("file_name", "file_hash", F.sha2(F.concat_ws("|", F.lit("session"), "file_hash"), 256).alias("session_id"))
    turns, calls = materialise(transcripts.turns(recs), "turns"), materialise(transcripts.tool_calls(recs), "calls")
    filled = turns.select("file_name").union(calls.select("file_name")).distinct()
    heads = materialise(transcripts.sessions(recs).join(filled, "file_name", "left_semi").join(key, "file_name"), "heads")
    new_state = files.select("file_path", "byte_size", "file_hash").withColumn("version", F.unix_micros(F.current_timestamp()))
    n = heads.count()
    if n:
        by = heads.select("file_name", "session_id")
        ident = lambda tag, col: F.sha2(F.concat_ws("|", F.lit(tag), "session_id", col), 256)
        store.append("turns", turns.join(by, "file_name").select(ident("turn", "turn_index").alias("id"), "session_id", "turn_index", "role", "content", "ts"))
        store.append("tool_calls", calls.join(by, "file_name").select(ident("call", "call_order").alias("id"), "session_id", "call_order", "tool", "path", "cmd_prefix"))
        none = F.lit(None).cast("string")
        store.append(
            "sessions",
            heads.select(
                F.col("session_id").alias("id"), none.alias("parent_session_id"), F.col("file_hash").alias("session_hash"), F.current_timestamp().cast("timestamp_ntz").alias("captured_at"),
                F.lit("human").alias("actor_type"), none.alias("agent_id"), F.lit(commit.email).alias("user_email"), F.coalesce("branch", F.lit(commit.branch)).alias("branch"),
            ),
        )
        head = spark.createDataFrame([(commit.sha, commit.branch, commit.email, commit.ts)], "git_sha string, git_branch string, user_email string, at string")
        # The checkpoint is named after the commit and the sessions it holds.
        names = heads.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("session_id")), "|"), 256).alias("held"))
        cp = with_row(head, names).select(
            F.sha2(F.concat_ws("|", "git_sha", "held"), 256).alias("id"), "git_sha", "git_branch", "user_email", F.col("at").cast("timestamp_ntz").alias("ts"), F.lit("human").alias("actor_type"), none.alias("agent_id")
        )
        cp = materialise(cp, "checkpoint")
        diff = scan.name_status(spark.createDataFrame([(x,) for x in commit.name_status], "value string"))
        wrote = calls.where(F.col("tool").isin(WRITING_TOOLS)).select("path")
        one = cp.select(F.col("id").alias("checkpoint_id"))
        files_now = with_row(scan.touched(diff, wrote, commit.root), one)
        store.append("files_touched", files_now.select(F.sha2(F.concat_ws("|", "checkpoint_id", "file_path"), 256).alias("id"), "checkpoint_id", "file_path", "change_type"))
        store.append("checkpoint_sessions", with_row(heads.select("session_id"), one).select("checkpoint_id", "session_id"))
        store.append("checkpoints", cp)
    store.append("checkpoint_state", new_state)
    return n
