"""Rebuilding conversations from message rows (problem 5).

Rows are sessionised: put in order within their session_id, deduplicated by place, and
split where a gap exceeds the inactivity gap, which is calibrated on all gaps of the
corpus; a turn without a role gets the other side's. Each segment is summed up (who
opens it, who closes it, whether a human turn stays without a reply), the summaries are
merged in order, and sessions that are broken, empty or not reciprocal are dropped.

A session may hold a third of all rows, so no step sees a whole session: rows are
grouped by (session, chunk of places); gaps, roles and replies are carried across the
borders of chunks by one row per chunk. Order is turn_index, or ts in sessions that have
no turn_index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise

#: Places per chunk: turns of an indexed session, or the microseconds of one hour.
CHUNK_TURNS, CHUNK_MICROS = 4096, 3_600_000_000
#: The chunk of rows that have neither turn_index nor ts; it comes before all others.
NOWHERE = -(1 << 62)
#: The inactivity gap where the gaps between neighbouring turns show no break: this quantile of them.
GAP_QUANTILE = 0.999
#: Bins of an octave of gaps; the gaps a bin beyond a break holds at least, or the empty bins a break has.
BINS, BEYOND, EMPTY = 2, 20, 4
# Spellings of the two speaker roles, lower case.
HUMAN = ["human", "user"]
ASSISTANT = ["assistant"]


def clean_role(role: Column) -> Column:
    """'human', 'assistant', another stated role in lower case, or '' for null and blank."""
    r = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(r.isin(HUMAN), "human").when(r.isin(ASSISTANT), "assistant").otherwise(r)


def visible(content: Column) -> Column:
    """Whether a text holds anything but white space."""
    return F.coalesce(content.rlike(r"(?U)\S"), F.lit(False))


CHUNK = ["session_id", "timed", "chunk"]


def sessionise(turns: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows in their places, and what each chunk of them comes after; both written once.

    The rows have (session_id, timed, chunk, place, n, role, seen, clash, ts, gap,
    before_role) and *keep*: n counts within the chunk, gap and before_role regard the
    turn before in it. The chunks have gap_in and role_in, which regard the last turn of
    the chunk before. Equal rows fold into one; *clash* tells that a place had two
    different ones, of which the lesser role and content count.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    timed = F.col("turn_index").isNull()
    mark = F.unhex(F.md5(F.coalesce("content", F.lit(""))))
    rows = (
        turns.where("session_id is not null")
        .select(
            "session_id", timed.alias("timed"), F.when(timed, micros).otherwise(F.col("turn_index").cast("long")).alias("place"), clean_role(F.col("role")).alias("role"),
            visible(F.col("content")).alias("seen"), mark.alias("mark"), "ts", *[F.coalesce(c, F.lit("")).alias(c) for c in keep],
        )
        .withColumn("chunk", F.coalesce(F.floor(F.col("place") / F.when(F.col("timed"), F.lit(CHUNK_MICROS)).otherwise(F.lit(CHUNK_TURNS))), F.lit(NOWHERE)))
        .repartition(*CHUNK)
    )
    clash = (F.min("role") != F.max("role")) | (F.min("mark") != F.max("mark"))
    places = rows.groupBy(*CHUNK, "place").agg(clash.alias("clash"), F.min("role").alias("role"), F.max("seen").alias("seen"), F.min("ts").alias("ts"), *[F.min(c).alias(c) for c in keep])
    w = Window.partitionBy(*CHUNK).orderBy("place")
    secs = F.expr("timestampdiff(SECOND, before_ts, ts)")
    placed = places.withColumn("n", F.row_number().over(w)).withColumn("before_ts", F.lag("ts").over(w)).withColumn("before_role", F.lag("role").over(w)).withColumn("gap", secs).drop("before_ts")
    placed = materialise(placed, "placed")
    ends = placed.groupBy(*CHUNK).agg(F.min_by("ts", "place").alias("ts"), F.max_by("ts", "place").alias("last_ts"), F.max_by("role", "place").alias("last_role"))
    w = Window.partitionBy("session_id").orderBy("timed", "chunk")
    ends = ends.withColumn("before_ts", F.lag("last_ts").over(w)).select(*CHUNK, secs.alias("gap_in"), F.lag("last_role").over(w).alias("role_in"))
    return placed, materialise(ends, "ends")


def inactivity(placed: DataFrame, ends: DataFrame) -> float:
    """The inactivity gap in seconds, calibrated on every gap between neighbouring turns; infinite without any."""
    gaps = placed.select("gap").unionByName(ends.select(F.col("gap_in").alias("gap"))).where("gap > 0")
    bins = gaps.groupBy(F.floor(F.log2("gap") * BINS + 1e-9).alias("bin")).count().collect()  # some eighty at most
    limit = gap_break({r["bin"]: r["count"] for r in bins})
    if limit is None:
        limit = gaps.agg(F.percentile_approx("gap", GAP_QUANTILE, 10_000)).head()[0]
    return math.inf if limit is None else float(limit)


def _spoken(placed: DataFrame, ends: DataFrame, limit: float) -> DataFrame:
    """The rows with what their chunk comes after, the inferred role, and the segment within the chunk."""
    rows = placed.join(ends, CHUNK)
    before = F.when(F.col("n") == 1, F.col("role_in")).otherwise(F.col("before_role"))
    other = F.when(before == "human", "assistant").otherwise("human")
    cut = F.coalesce(F.when(F.col("n") == 1, F.col("gap_in")).otherwise(F.col("gap")) > limit, F.lit(False)).cast("int")
    w = Window.partitionBy(*CHUNK).orderBy("place")
    return rows.withColumn("role", F.when(F.col("role") == "", other).otherwise(F.col("role"))).withColumn("cut", cut).withColumn("seg", F.sum("cut").over(w)).drop("gap_in", "role_in", "before_role")


def _merged(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Summaries of parts, in their order, as summaries of what they make up: a human turn that ends one part may be answered in the next."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    open_before = F.coalesce(F.last("closes", ignorenulls=True).over(w), F.lit("")) == "human"
    return parts.withColumn("open_before", open_before).groupBy(*keys).agg(
        F.max("clash").alias("clash"),
        F.max("lost").alias("lost"),
        F.sum("n_places").alias("n_places"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("any_timed").alias("any_timed"),
        F.min("all_timed").alias("all_timed"),
        F.max(F.col("unanswered") | ((F.coalesce("replies", F.lit("")) == "human") & F.col("open_before"))).alias("unanswered"),
        F.max("seen").alias("seen"),
        F.min_by("opens", F.when(F.col("seen"), at)).alias("opens"),
        F.min_by("replies", F.when(F.col("replies").isNotNull(), at)).alias("replies"),
        F.max_by("closes", F.when(F.col("closes").isNotNull(), at)).alias("closes"),
    )


def segments(spoken: DataFrame) -> DataFrame:
    """One summary per (session_id, timed, chunk, seg): opens is the role of the first visible turn,
    replies and closes those of the first and last visible turn of the two speakers."""
    speaks = F.col("seen") & F.col("role").isin("human", "assistant")
    w = Window.partitionBy(*CHUNK, "seg").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(speaks, F.col("role")), ignorenulls=True).over(w)
    return spoken.withColumn("before", before).groupBy(*CHUNK, "seg").agg(
        F.max("clash").alias("clash"),
        F.max(F.col("place").isNull()).alias("lost"),
        F.count("place").alias("n_places"),
        F.min(F.when(~F.col("timed"), F.col("place"))).alias("low"),
        F.max(F.when(~F.col("timed"), F.col("place"))).alias("high"),
        F.max("timed").alias("any_timed"),
        F.min("timed").alias("all_timed"),
        F.max(speaks & (F.col("role") == "human") & (F.coalesce("before", F.lit("")) == "human")).alias("unanswered"),
        F.max("seen").alias("seen"),
        F.min_by("role", F.when(F.col("seen"), F.col("n"))).alias("opens"),
        F.min_by("role", F.when(speaks, F.col("n"))).alias("replies"),
        F.max_by("role", F.when(speaks, F.col("n"))).alias("closes"),
    )


def _verdicts(spoken: DataFrame) -> DataFrame:
    per = _merged(_merged(segments(spoken), CHUNK, ["seg"]), ["session_id"], ["timed", "chunk"])
    hole = F.when(F.col("all_timed"), F.lit(False)).when(F.col("any_timed"), F.lit(True)).otherwise((F.col("low") != 0) | (F.col("high") != F.col("n_places") - 1))
    broken = F.col("clash") | F.col("lost") | hole | ~F.col("seen") | (F.col("opens") != "human") | F.col("unanswered") | (F.coalesce("closes", F.lit("")) == "human")
    return per.select("session_id", F.coalesce(broken, F.lit(True)).alias("broken"))


def judge(turns: DataFrame) -> DataFrame:
    """(session_id, broken): one row per session that has turns.

    Broken are sessions without visible text, with a hole in turn_index, with two
    different rows at one place, whose first visible turn is not human, or with a human
    turn that no assistant turn follows before the next human turn or the end. Equal
    rows count once; a null content equals an empty one, and a null role a blank one,
    which is inferred; a session in which only some rows have a turn_index has a hole;
    a row with neither turn_index nor ts has no place and breaks its session.
    """
    placed, ends = sessionise(turns)
    return _verdicts(_spoken(placed, ends, inactivity(placed, ends)))


def found(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id of each session in *sessions* to be left out, those without any turn too."""
    ids = sessions.select(F.col("id").alias("session_id")).where("session_id is not null").distinct()
    return ids.join(judge(turns), "session_id", "left").where(F.coalesce("broken", F.lit(True))).select("session_id")


def gap_break(counts: dict[int, int]) -> float | None:
    """The gap in seconds at the first break of a histogram {floor(BINS * log2(gap)): n}, None if there is none.

    Beyond the most frequent bin the counts fall; the break is the lowest place before
    they rise to more than twice as much again (the pauses), or a stretch of EMPTY bins.
    """
    if not counts:
        return None
    mode = max(counts, key=lambda b: (counts[b], -b))
    last = max(counts)
    for b in range(mode + 1, last):
        here = counts.get(b, 0)
        beyond = max(range(b + 1, last + 1), key=lambda x: (counts.get(x, 0), -x))
        most = counts.get(beyond, 0)
        if most >= BEYOND and most > 2 * here:
            valley = range(b, beyond)
        elif here == 0 and all(x not in counts for x in range(b, b + EMPTY)):
            valley = range(b, min(x for x in counts if x > b))
        else:
            continue
        low = min(counts.get(x, 0) for x in valley)
        first = next(x for x in valley if counts.get(x, 0) == low)
        end = first
        while end + 1 in valley and counts.get(end + 1, 0) == low:
            end += 1
        return 2.0 ** ((first + end + 1) / 2 / BINS)
    return None


def conversations(turns: DataFrame) -> DataFrame:
    """The kept conversations as rows (session_id, position, segment, role, content, ts).

    ``position`` runs 0, 1, 2, ...; ``segment`` rises by one after each gap longer than
    the inactivity gap. A turn that states no role speaks for the other side of the turn
    before it.
    """
    placed, ends = sessionise(turns, "content")
    limit = inactivity(placed, ends)
    kept = materialise(_verdicts(_spoken(placed.drop("content"), ends, limit)).where("not broken").select("session_id"), "kept")
    # The kept sessions' chunks, so that rows are joined by chunk and no session meets in one task.
    mine = materialise(ends.join(kept, "session_id", "left_semi"), "kept_ends")
    rows = _spoken(placed, mine, limit)
    ws = Window.partitionBy("session_id").orderBy("timed", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = _spoken(placed.drop("content"), mine, limit).groupBy(*CHUNK).agg(F.count("*").alias("n_rows"), F.sum("cut").alias("n_cuts"))
    starts = sums.select(*CHUNK, F.coalesce(F.sum("n_rows").over(ws), F.lit(0)).alias("row0"), F.coalesce(F.sum("n_cuts").over(ws), F.lit(0)).alias("cut0"))
    out = rows.join(starts, CHUNK)
    return out.select("session_id", (F.col("row0") + F.col("n") - 1).alias("position"), (F.col("cut0") + F.col("seg")).alias("segment"), "role", "content", "ts")
