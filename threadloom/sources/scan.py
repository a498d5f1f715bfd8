"""Finding what changed: transcript folders and the incremental file scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transcript_folder(home: str, repo_path: str) -> str:
    """The folder in which a repository's transcripts lie: its path with '-' for all but letters and digits."""
    return f"{home}/.claude/projects/{re.sub('[^a-zA-Z0-9]', '-', repo_path)}"


def file_state(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_name, byte_size, file_hash) of each transcript directly in *folder*; empty files have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("file_hash"))


def changed(files: DataFrame, state: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files whose size or hash differs from the cached *state* and whose hash no session has yet."""
    new = files.join(state.select("file_path", "byte_size", "file_hash"), ["file_path", "byte_size", "file_hash"], "left_anti")
    return new.join(sessions.select(F.col("session_hash").alias("file_hash")), "file_hash", "left_anti")


def name_status(lines: DataFrame, col: str = "value") -> DataFrame:
    """(change_type, file_path) of 'git diff --name-status' lines, split at the first tab only."""
    parts = F.split(F.col(col), "\t", 2)
    return lines.where(F.contains(F.col(col), F.lit("\t"))).select(F.element_at(parts, 1).alias("change_type"), F.element_at(parts, 2).alias("file_path"))


def touched(git_files: DataFrame, tool_files: DataFrame, root: str) -> DataFrame:
    """Files of a commit with those tool calls wrote and git does not list (type 'T'); *root* is cut off at the start only."""
    own = tool_files.select(F.when(F.startswith("path", F.lit(root)), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("path")).alias("file_path")).where("file_path <> ''").distinct()
    extra = own.join(git_files.select("file_path"), "file_path", "left_anti").select(F.lit("T").alias("change_type"), "file_path")
    return git_files.select("change_type", "file_path").unionByName(extra)
