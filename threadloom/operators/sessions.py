"""Model tables and the relational operators over them: facets, files, text, pages, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.functions.text import first_snippet
from threadloom.operators.ranges import numbered, with_previous

# Tools that change files, and the change type of files known from tool calls.
WRITING_TOOLS = ["Write", "Edit", "NotebookEdit"]
FROM_TOOLS = "T"
# What a drill-down says about the session itself.
HEAD = {"author": "user_email", "actor": "actor_type", "branch": "branch", "captured_at": "captured_at"}
# Fixed value: results of a search when no limit is given.
DEFAULT_LIMIT = 20
#: Paths of a session that are paired in one task.
BLOCK = 1024


def links(files_index: DataFrame) -> DataFrame:
    """Distinct (checkpoint_id, session_id)."""
    return files_index.select("checkpoint_id", "session_id").where("checkpoint_id is not null and session_id is not null").distinct()


def latest_checkpoint(linked: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(session_id, checkpoint_id, git_sha, git_branch) of each session's latest checkpoint by (ts, id)."""
    cp = checkpoints.select(F.col("id").alias("checkpoint_id"), "git_sha", "git_branch", "ts").distinct()
    at = F.struct(F.col("ts").isNotNull(), F.col("ts"), F.col("checkpoint_id"))
    per = linked.join(cp, "checkpoint_id").groupBy("session_id").agg(F.max_by(F.struct("checkpoint_id", "git_sha", "git_branch"), at).alias("c"))
    return per.select("session_id", "c.*")


def session_facets(sessions: DataFrame, turns: DataFrame, tool_calls: DataFrame, files_index: DataFrame, checkpoints: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """One row per session: who, where, when, counts of distinct turns, calls and files, latest checkpoint.

    *linked* are the links of sessions to checkpoints, if there are more than the index shows.
    """
    t = turns.select("id", "session_id").distinct().groupBy("session_id").agg(F.count("*").alias("turn_count"))
    c = tool_calls.select("id", "session_id").distinct().groupBy("session_id").agg(F.count("*").alias("tool_call_count"))
    f = files_index.groupBy("session_id").agg(F.count_distinct("file_path").alias("file_count"))
    s = sessions.select(F.col("id").alias("session_id"), "user_email", "branch", "actor_type", "agent_id", "captured_at").distinct()
    out = s.join(latest_checkpoint(links(files_index) if linked is None else linked, checkpoints), "session_id", "left").join(t, "session_id", "left").join(c, "session_id", "left").join(f, "session_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out.select(
        "session_id", "user_email", F.coalesce("git_branch", "branch").alias("git_branch"), "actor_type", "agent_id", "captured_at",
        zero("turn_count"), zero("tool_call_count"), zero("file_count"), "checkpoint_id", "git_sha",
    )


def files_supplement(tool_calls: DataFrame, files_index: DataFrame, root: str = "", linked: DataFrame | None = None) -> DataFrame:
    """Files that tool calls changed and the index lacks: (checkpoint_id, session_id, file_path, change_type 'T').

    Only paths under *root* count, which is cut off wherever it occurs; a writing tool's
    blank path is none. *linked* are the links, if there are more than the index shows.
    """
    calls = tool_calls.where(F.col("tool").isin(WRITING_TOOLS) & (F.length("path") > 0) & F.startswith("path", F.lit(root)))
    path = F.replace("path", F.lit(root), F.lit("")) if root else F.col("path")
    new = calls.join(links(files_index if linked is None else linked), "session_id").select("checkpoint_id", "session_id", path.alias("file_path")).distinct()
    return new.join(files_index.select("checkpoint_id", "session_id", "file_path"), ["checkpoint_id", "session_id", "file_path"], "left_anti").withColumn("change_type", F.lit(FROM_TOOLS))


def file_cooccurrence(tool_calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file_a, file_b, count): pairs of call rows of one session with file_a < file_b.

    Rows fold to (session, path, n) before the join; a pair adds n_a * n_b, which equals
    the count over row pairs and joins far fewer rows. The paths of a session with more
    than *block* of them are cut into blocks, and each pair of blocks is a key of its own.
    """
    per = tool_calls.where("path is not null and path <> ''").groupBy("session_id", "path").agg(F.count("*").alias("n"))
    sizes = per.groupBy("session_id").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
    cut = per.join(sizes, "session_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = materialise(cut.withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks"))), "paths")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    a = cut.select("session_id", F.col("path").alias("file_a"), F.col("n").alias("n_a"), F.col("own").alias("i"), every.alias("j"))
    b = cut.select("session_id", F.col("path").alias("file_b"), F.col("n").alias("n_b"), every.alias("i"), F.col("own").alias("j"))
    pairs = a.join(b, ["session_id", "i", "j"]).where("file_a < file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("count"))


def neighbours_of(edges: DataFrame, pattern: str, k: int) -> DataFrame:
    """The *k* strongest edges that touch a path matching *pattern*."""
    return edges.where(F.col("file_a").rlike(pattern) | F.col("file_b").rlike(pattern)).orderBy(F.desc("count"), "file_a", "file_b").limit(k)


def session_text(turns: DataFrame) -> DataFrame:
    """(session_id, content): all turn texts of a session in order, joined by spaces."""
    rows = turns.select("id", "session_id", "turn_index", "ts", "content").distinct()
    order = F.struct(F.coalesce("turn_index", F.lit(2**31 - 1)).alias("i"), F.col("ts"), F.col("id"), F.coalesce("content", F.lit("")).alias("content"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["content"]), " ").alias("content"))


def first_turns(turns: DataFrame) -> DataFrame:
    """(session_id, turn_index, snippet) of each session's first turn."""
    first = F.min_by(F.struct("turn_index", "content"), F.struct(F.coalesce("turn_index", F.lit(2**31 - 1)), F.col("ts"), F.col("id")))
    return turns.groupBy("session_id").agg(first.alias("t")).select("session_id", F.col("t.turn_index").alias("turn_index"), first_snippet(F.col("t.content")).alias("snippet"))


def session_files(files_index: DataFrame) -> DataFrame:
    """(session_id, file_path), distinct."""
    return files_index.select("session_id", "file_path").where("file_path is not null").distinct()


def turns_page(turns: DataFrame, session_id: str, offset: int = 0, limit: int = 0, role: str | None = None) -> tuple[DataFrame, int, bool]:
    """A page of a session's turns, how many there are in all, and whether more follow; limit 0 gives the rest."""
    if role not in (None, "", "human", "assistant"):
        raise ValueError(f"no such role: {role}")
    rows = turns.where(F.col("session_id") == session_id)
    if role:
        rows = rows.where(F.col("role") == role)
    total = rows.count()
    page = rows.orderBy(F.col("turn_index").asc_nulls_last(), "ts", "id").select("turn_index", "role", "content", "ts").offset(offset)
    page = page.limit(limit) if limit > 0 else page
    shown = min(limit, max(0, total - offset)) if limit > 0 else max(0, total - offset)
    return page, total, limit > 0 and offset + shown < total


def paged(turns: DataFrame, offset: int, limit: int, role: str | None = None) -> DataFrame:
    """The same page of every session at once, each row with the session's total and has_more.

    Each task keeps the first offset + limit rows of a session before they are shuffled,
    so a long session costs no more than any other.
    """
    rows = turns if role is None else turns.where(F.col("role") == role)
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").asc_nulls_last(), "ts", "id")
    page = rows.withColumn("n", F.row_number().over(w)).where((F.col("n") > offset) & (F.col("n") <= offset + limit)).drop("n")
    totals = rows.groupBy("session_id").agg(F.count("*").alias("total"))
    return page.join(totals, "session_id").withColumn("has_more", F.col("total") > offset + limit)


def drill_down(sessions: DataFrame, turns: DataFrame, tool_calls: DataFrame, files: DataFrame, session_id: str, full: bool = False, offset: int = 0, limit: int = 0, role: str | None = None) -> DataFrame:
    """One session as rows (part, place, label, value, total, has_more): its facets, a page of its turns and, if *full*, all its calls and files.

    An unknown session gives no rows. Repeated rows count once.
    """
    page, total, more = turns_page(turns, session_id, offset, limit, role)
    row = lambda part, place, label, value: [F.lit(part).alias("part"), place.cast("int").alias("place"), label.alias("label"), value.alias("value")]
    mine = sessions.where(F.col("id") == session_id)
    head = mine.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.col(c).cast("string").alias("v")) for i, (n, c) in enumerate(HEAD.items())])).alias("h")).distinct()
    parts = [head.select(*row("session", F.col("h.i"), F.col("h.n"), F.col("h.v"))), page.select(*row("turn", F.col("turn_index"), F.col("role"), F.col("content")))]
    if full:
        calls = tool_calls.where(F.col("session_id") == session_id).select("id", "call_order", "tool", "path").distinct()
        named = session_files(files.where(F.col("session_id") == session_id))
        parts += [calls.select(*row("call", F.col("call_order"), F.col("tool"), F.coalesce("path", F.lit("")))), named.select(*row("file", F.lit(None), F.lit("file"), F.col("file_path")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = mine.head() is not None
    return out.where(F.lit(known)).select("*", F.lit(total).cast("bigint").alias("total"), F.lit(more).alias("has_more"))


def checkpoint_log(checkpoints: DataFrame, files_index: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest checkpoints with how many sessions each has; one without any counts 0, and limit 0 gives none."""
    n = links(files_index).groupBy(F.col("checkpoint_id").alias("id")).agg(F.count("*").alias("n_sessions"))
    rows = checkpoints.select("id", "git_sha", "git_branch", "user_email", "ts").distinct().join(n, "id", "left").withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))
    return rows.orderBy(F.col("ts").desc_nulls_last(), "id").limit(limit)


def log_report(log: DataFrame) -> DataFrame:
    """The log as text blocks."""
    text = F.format_string("checkpoint %s\nBranch: %s\nAuthor: %s\nDate:   %s\nSessions: %d\n", "git_sha", "git_branch", "user_email", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "n_sessions")
    return log.select("id", text.alias("report"))


def matches(facets: DataFrame, author: str | None = None, actor: str | None = None, commit: str | None = None) -> Column:
    """The conjunction of the facet filters that are given; a null author counts as ''."""
    ok = F.lit(True)
    if author:
        ok = ok & (F.coalesce("user_email", F.lit("")) == author)
    if actor:
        ok = ok & (F.col("actor_type") == actor)
    if commit:
        ok = ok & F.startswith("git_sha", F.lit(commit))
    return ok


def browse(facets: DataFrame, files: DataFrame, turns: DataFrame, author: str | None = None, actor: str | None = None, commit: str | None = None, file: str | None = None, limit: int = 0) -> DataFrame:
    """Sessions by their facets, newest first, with files and the start of their first turn."""
    rows = facets.where(matches(facets, author, actor, commit))
    if file:
        rows = rows.join(files.where(F.col("file_path").rlike(file)).select("session_id").distinct(), "session_id", "left_semi")
    top = rows.orderBy(F.col("captured_at").desc_nulls_last(), "session_id").limit(limit if limit > 0 else DEFAULT_LIMIT)
    listed = session_files(files).join(top.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))
    starts = first_turns(turns.join(top.select("session_id"), "session_id", "left_semi"))
    return top.join(listed, "session_id", "left").join(starts.select("session_id", "snippet"), "session_id", "left").select(
        "session_id", "user_email", "git_branch", "actor_type", "captured_at", "turn_count", "file_count", F.coalesce("files", F.lit("")).alias("files"), F.coalesce("snippet", F.lit("")).alias("snippet")
    )


def _in_order() -> tuple[Column, ...]:
    return F.col("turn_index").asc_nulls_last(), F.col("ts").asc_nulls_last(), F.col("id").asc()


def turn_deltas(turns: DataFrame) -> DataFrame:
    """(id, session_id, delta_s): whole seconds since the turn before; 0 for the first, unknown or negative."""
    rows = turns.select("id", "session_id", "turn_index", "ts").distinct()
    gap = F.expr("timestampdiff(SECOND, before, ts)")
    return with_previous(rows, "session_id", "ts", "before", *_in_order()).select("id", "session_id", F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("bigint").alias("delta_s"))


def assign_index(turns: DataFrame) -> DataFrame:
    """(id, session_id, position): a dense 0-based place per session."""
    rows = turns.select("id", "session_id", "turn_index", "ts").distinct()
    return numbered(rows, "session_id", "n", *_in_order()).select("id", "session_id", (F.col("n") - 1).cast("bigint").alias("position"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both tables, the one with the largest version per key; *new* wins a tie."""
    cols = [c for c in old.columns if c != key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "_new")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of *old* with every column that *new* has and does not leave null replaced by it; keys only *new* has add no row.

    Of several new rows of a key the largest value of each column counts.
    """
    cols = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in cols])
    return old.join(one, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns])


def dedup_by_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row, by id, of each distinct content hash: (content_hash, id)."""
    return docs.where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("content_hash")).agg(F.min(id_col).alias(id_col))
