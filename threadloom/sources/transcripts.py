"""Transcripts: lines of polymorphic JSON to sessions, turns and tool calls.

Every step is a column expression over VARIANT: a line that is no JSON object becomes
null and drops out, ``content`` is dispatched on its type, blocks are exploded with
their positions, and places are dense ranks by (line, kind, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import CMD_PREFIX, parse_instant, truncate_bytes

# Fixed value: where plans are kept; their text is a turn of its own.
PLANS = ".claude/plans/"
# Fixed value: a line longer than this ends its file's capture.
MAX_LINE = 10 * 1024 * 1024


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, line_no, raw_line) of each *.jsonl directly in *folder*.

    Files are read whole, so line numbers are exact; a file with an oversized line is
    left out as a whole, an empty file has no lines.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.jsonl").text(folder).select(F.col("_metadata.file_name").alias("file_name"), "value")
    lines = F.split("value", "\n")
    fits = F.forall(lines, lambda ln: F.octet_length(ln) <= MAX_LINE)
    return files.where(fits).select("file_name", F.posexplode(lines).alias("line_no", "raw_line")).where("raw_line <> ''")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _kind(v: Column) -> Column:
    return F.substring(F.schema_of_variant(v), 1, 5)


def _blocks(v: Column) -> Column:
    """The blocks of an array content; null for any other type."""
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _joined(v: Column) -> Column:
    """The text of a content: the string itself, or the text blocks joined by line breaks; '' without any."""
    texts = F.transform(F.filter(_blocks(v), lambda b: (_text(b, "$.type") == "text") & (F.coalesce(_text(b, "$.text"), F.lit("")) != "")), lambda b: _text(b, "$.text"))
    return F.coalesce(F.when(_kind(v) == "STRIN", _text(v, "$")).otherwise(F.array_join(texts, "\n")), F.lit(""))


def records(lines: DataFrame) -> DataFrame:
    """Lines of users and assistants that are JSON objects, main thread only, repeated lines once."""
    v = F.try_parse_json("raw_line")
    r = lines.select("file_name", "line_no", "raw_line").distinct().withColumn("v", v).where(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    r = r.select(
        "file_name",
        "line_no",
        _text(F.col("v"), "$.sessionId").alias("session"),
        _text(F.col("v"), "$.gitBranch").alias("branch"),
        _text(F.col("v"), "$.type").alias("type"),
        parse_instant(_text(F.col("v"), "$.timestamp")).alias("ts"),
        F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False)).alias("side"),
        _text(F.col("v"), "$.message.role").alias("role"),
        F.try_variant_get("v", "$.message.content", "variant").alias("content"),
    )
    return r.where("not side and type is distinct from 'file-history-snapshot'").drop("side")


def _tool_blocks(recs: DataFrame) -> DataFrame:
    b = recs.where("type = 'assistant' and role = 'assistant'").select("file_name", "line_no", "ts", F.posexplode(_blocks(F.col("content"))).alias("pos", "b"))
    b = b.where(_text(F.col("b"), "$.type") == "tool_use")
    first = F.coalesce(F.nullif(_text(F.col("b"), "$.input.file_path"), F.lit("")), _text(F.col("b"), "$.input.path"), F.lit(""))
    return b.select(
        "file_name", "line_no", "ts", "pos",
        F.coalesce(_text(F.col("b"), "$.name"), F.lit("")).alias("tool"),
        F.coalesce(_text(F.col("b"), "$.id"), F.lit("")).alias("use_id"),
        first.alias("path"),
        F.coalesce(_text(F.col("b"), "$.input.command"), F.lit("")).alias("command"),
        F.coalesce(_text(F.col("b"), "$.input.content"), F.lit("")).alias("body"),
    )


def tool_calls(recs: DataFrame) -> DataFrame:
    """(file_name, call_order, tool, path, cmd_prefix): every tool use in order; missing parts are ''."""
    w = Window.partitionBy("file_name").orderBy("line_no", "pos")
    return _tool_blocks(recs).select("file_name", (F.row_number().over(w) - 1).alias("call_order"), "tool", "path", truncate_bytes(F.col("command"), CMD_PREFIX).alias("cmd_prefix"))


def turns(recs: DataFrame) -> DataFrame:
    """(file_name, turn_index, role, content, ts).

    A user line gives the plans read before (as assistant turns) and then its text; an
    assistant line gives the plans it writes, in block order, and then its text. Thinking,
    other tool results and empty texts give none. A plan read is answered once, by the
    first later result of its id.
    """
    said = recs.where("(type = 'user' and role = 'user') or (type = 'assistant' and role = 'assistant')")
    plain = said.select("file_name", "line_no", F.lit(1).alias("kind"), F.lit(0).alias("pos"), F.when(F.col("type") == "user", "human").otherwise("assistant").alias("role"), _joined(F.col("content")).alias("content"), "ts")
    blocks = _tool_blocks(recs).where(F.contains("path", F.lit(PLANS)))
    written = blocks.where("tool in ('Write', 'Edit')").select("file_name", "line_no", F.lit(0).alias("kind"), "pos", F.lit("assistant").alias("role"), F.col("body").alias("content"), "ts")
    reads = blocks.where("tool = 'Read' and use_id <> ''").groupBy("file_name", "use_id").agg(F.min("line_no").alias("use_line"))
    res = recs.where("type = 'user' and role = 'user'").select("file_name", "line_no", "ts", F.posexplode(_blocks(F.col("content"))).alias("pos", "b")).where(_text(F.col("b"), "$.type") == "tool_result")
    res = res.select("file_name", "line_no", "ts", "pos", _text(F.col("b"), "$.tool_use_id").alias("use_id"), _joined(F.try_variant_get("b", "$.content", "variant")).alias("content"))
    w = Window.partitionBy("file_name", "use_id").orderBy("line_no", "pos")
    answered = res.join(reads, ["file_name", "use_id"]).where("line_no > use_line").withColumn("n", F.row_number().over(w)).where("n = 1")
    read = answered.select("file_name", "line_no", F.lit(0).alias("kind"), "pos", F.lit("assistant").alias("role"), "content", "ts")
    every = plain.unionByName(written).unionByName(read).where("content <> ''")
    order = Window.partitionBy("file_name").orderBy("line_no", "kind", "pos")
    return every.select("file_name", (F.row_number().over(order) - 1).alias("turn_index"), "role", "content", "ts")


def sessions(recs: DataFrame) -> DataFrame:
    """(file_name, session, branch, n_lines): the first stated session id and branch of each file, in line order."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line_no"))).alias(c)
    return recs.groupBy("file_name").agg(first("session"), first("branch"), F.count("*").alias("n_lines"))
