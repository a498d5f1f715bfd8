"""Relational operators on a small seeded fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import sessions as ops
from threadloom.plans import search, sqlmode
from threadloom.operators import retrieval
from threadloom.functions.text import query_terms


def at(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


@pytest.fixture(scope="module")
def t(spark):
    mk = spark.createDataFrame
    return {
        "sessions": mk([("s1", None, "h1", at(1), "human", None, "alice@example.org", "feature/auth"), ("s2", None, "h2", at(2), "human", None, "bob@example.org", "feature/db")], "id string, parent_session_id string, session_hash string, captured_at timestamp_ntz, actor_type string, agent_id string, user_email string, branch string"),
        "turns": mk(
            [("t1", "s1", 0, "human", "the login token fails", at(1, 1)), ("t2", "s1", 1, "assistant", "authentication was fixed", at(1, 2)), ("t3", "s1", 2, "human", "thanks", None), ("t4", "s1", 3, "assistant", "done", at(1, 1)),
             ("t5", "s2", 0, "human", "database migration", at(2, 1)), ("t6", "s2", 1, "assistant", "added a column", at(2, 2))],
            "id string, session_id string, turn_index int, role string, content string, ts timestamp_ntz"),
        "calls": mk([("c1", "s1", 0, "Read", "src/auth/a.go", ""), ("c2", "s1", 1, "Edit", "src/auth/b.go", ""), ("c3", "s1", 2, "Edit", "src/auth/b.go", ""), ("c4", "s2", 0, "Write", "", None), ("c5", "s2", 1, "Write", None, None)], "id string, session_id string, call_order int, tool string, path string, cmd_prefix string"),
        "checkpoints": mk([("k1", "aaa111", "main", "alice@example.org", at(3)), ("k2", "bbb222", "main", "bob@example.org", at(4)), ("k3", "ccc333", "main", "bob@example.org", at(5))], "id string, git_sha string, git_branch string, user_email string, ts timestamp_ntz"),
        "files": mk([("k1", "s1", "src/auth/a.go", "M"), ("k1", "s1", "README.md", "M"), ("k2", "s1", "src/auth/a.go", "M"), ("k2", "s2", "db.sql", "A")], "checkpoint_id string, session_id string, file_path string, change_type string"),
    }


def test_facets(t):
    got = {r.session_id: r for r in ops.session_facets(t["sessions"], t["turns"], t["calls"], t["files"], t["checkpoints"]).collect()}
    assert (got["s1"].turn_count, got["s1"].tool_call_count, got["s1"].file_count, got["s1"].checkpoint_id) == (4, 3, 2, "k2")
    assert (got["s2"].turn_count, got["s2"].git_sha, got["s2"].git_branch) == (2, "bbb222", "main")


def test_page(t):
    page, total, more = ops.turns_page(t["turns"], "s1", 0, 2)
    assert ([r.turn_index for r in page.collect()], total, more) == ([0, 1], 4, True)
    page, total, more = ops.turns_page(t["turns"], "s1", 2, 2)
    assert ([r.turn_index for r in page.collect()], total, more) == ([2, 3], 4, False)
    page, total, more = ops.turns_page(t["turns"], "s1", role="human")
    assert (page.count(), total, more) == (2, 2, False)
    assert ops.turns_page(t["turns"], "none")[1] == 0
    with pytest.raises(ValueError):
        ops.turns_page(t["turns"], "s1", role="robot")


def test_log(t):
    assert [(r.id, r.n_sessions) for r in ops.checkpoint_log(t["checkpoints"], t["files"], 2).collect()] == [("k3", 0), ("k2", 2)]
    assert ops.checkpoint_log(t["checkpoints"], t["files"], 0).count() == 0
    assert "Sessions: 0" in ops.log_report(ops.checkpoint_log(t["checkpoints"], t["files"], 1)).head().report


def test_cooccurrence_counts_row_pairs(t):
    assert [tuple(r) for r in ops.file_cooccurrence(t["calls"]).collect()] == [("src/auth/a.go", "src/auth/b.go", 2)]
    assert ops.neighbours_of(ops.file_cooccurrence(t["calls"]), "auth", 5).count() == 1


def test_supplement(t):
    got = {tuple(r) for r in ops.files_supplement(t["calls"], t["files"]).select("checkpoint_id", "session_id", "file_path", "change_type").collect()}
    assert got == {("k1", "s1", "src/auth/b.go", "T"), ("k2", "s1", "src/auth/b.go", "T")}
    rooted = {r.file_path for r in ops.files_supplement(t["calls"], t["files"], "src/").collect()}
    assert rooted == {"auth/b.go"}


def test_deltas_and_places(t):
    assert {r.id: r.delta_s for r in ops.turn_deltas(t["turns"]).collect()} == {"t1": 0, "t2": 3600, "t3": 0, "t4": 0, "t5": 0, "t6": 3600}
    assert {r.id: r.position for r in ops.assign_index(t["turns"]).collect()} == {"t1": 0, "t2": 1, "t3": 2, "t4": 3, "t5": 0, "t6": 1}


def test_hot_session_is_many_ranges(spark):
    """One session holds nearly all rows: places, gaps and pairs are the same, and no task has them all."""
    from threadloom.operators.ranges import numbered, ranged

    rows = [(f"i{k:04d}", "hot" if k % 10 else f"s{k}", k if k % 7 else None, at(1) + dt.timedelta(seconds=(k * k) % 977)) for k in range(1500)]
    turns = spark.createDataFrame(rows, "id string, session_id string, turn_index int, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = ranged(turns, "session_id", F.col("turn_index").asc_nulls_last(), F.col("id").asc()).where("session_id = 'hot'").groupBy("_part").count().collect()
        assert len(per) > 1 and max(r["count"] for r in per) < 1000
        want, gaps, last = {}, {}, {}
        for i, s, k, ts in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[3], r[0])):
            want[i] = 0 if s not in last else want[last[s][0]] + 1
            gaps[i] = 0 if s not in last else max(0, int((ts - last[s][1]).total_seconds()))
            last[s] = (i, ts)
        assert {r.id: r.position for r in ops.assign_index(turns).collect()} == want
        assert {r.id: r.delta_s for r in ops.turn_deltas(turns).collect()} == gaps
        assert numbered(turns.where("false"), "session_id", "n", F.col("id").asc()).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    calls = spark.createDataFrame([(f"s{k % 2}", f"p{(k * k) % 23}") for k in range(300)], "session_id string, path string")
    whole = {tuple(r) for r in ops.file_cooccurrence(calls).collect()}
    assert whole and {tuple(r) for r in ops.file_cooccurrence(calls, block=3).collect()} == whole


def test_drill_down(t):
    got = ops.drill_down(t["sessions"], t["turns"], t["calls"], t["files"], "s1", full=True, offset=1, limit=2).collect()
    assert {(r.part, r.place, r.label, r.value) for r in got if r.part != "session"} == {
        ("turn", 1, "assistant", "authentication was fixed"), ("turn", 2, "human", "thanks"), ("call", 0, "Read", "src/auth/a.go"), ("call", 1, "Edit", "src/auth/b.go"), ("call", 2, "Edit", "src/auth/b.go"),
        ("file", None, "file", "src/auth/a.go"), ("file", None, "file", "README.md"),
    }
    assert {r.total for r in got} == {4} and all(r.has_more for r in got) and {r.label: r.value for r in got if r.part == "session"}["author"] == "alice@example.org"
    assert ops.drill_down(t["sessions"], t["turns"], t["calls"], t["files"], "none", full=True).count() == 0
    page = {r.id: (r.total, r.has_more) for r in ops.paged(t["turns"], 1, 2).collect()}
    assert page == {"t2": (4, True), "t3": (4, True), "t6": (2, False)}


def test_text_and_browse(t):
    assert {r.session_id: r.content for r in ops.session_text(t["turns"]).collect()}["s2"] == "database migration added a column"
    facets = ops.session_facets(t["sessions"], t["turns"], t["calls"], t["files"], t["checkpoints"])
    got = ops.browse(facets, t["files"], t["turns"], file=r"auth/.*\.go$").collect()
    assert [(r.session_id, r.files, r.snippet) for r in got] == [("s1", "README.md,src/auth/a.go", "the login token fails")]
    assert [r.session_id for r in ops.browse(facets, t["files"], t["turns"]).collect()] == ["s2", "s1"]
    assert ops.browse(facets, t["files"], t["turns"], author="nobody").count() == 0
    assert [r.session_id for r in ops.browse(facets, t["files"], t["turns"], commit="bbb").collect()] == ["s2", "s1"]


def test_hybrid_filters_after_fusion(t):
    q = "authentication login token"
    hits = retrieval.bm25_scan(t["turns"], "id", "content", query_terms(q), "session_id", "turn_index")
    latent = retrieval.tfidf_search(retrieval.tfidf(ops.session_text(t["turns"]), "session_id", "content", 1), query_terms(q))
    facets = ops.session_facets(t["sessions"], t["turns"], t["calls"], t["files"], t["checkpoints"])
    all_rows = search.hybrid(t["turns"], hits, latent, None, facets, t["files"], q).collect()
    assert all_rows[0].session_id == "s1" and all_rows[0].score == 1.0 and all_rows[0].snippet == "the login token fails"
    assert search.hybrid(t["turns"], hits, latent, None, facets, t["files"], q, search.Filters(author="bob@example.org")).count() == 0


def test_upsert_and_dedup(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 0, "w"), ("c", 5, "n")], "k string, v int, s string")
    assert {(r.k, r.s) for r in ops.upsert(old, new, "k", "v").collect()} == {("a", "z"), ("b", "y"), ("c", "n")}
    d = spark.createDataFrame([(3, "t"), (1, "t"), (2, "u"), (4, None)], "id int, text string")
    assert sorted(r.id for r in ops.dedup_by_hash(d, "id", "text").collect()) == [1, 2]


def test_patch(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "z", 3)], "k string, s string, v int")
    new = spark.createDataFrame([("a", "new"), ("b", "b1"), ("b", "b2"), ("c", None), ("d", "q")], "k string, s string")
    assert {tuple(r) for r in ops.patch(old, new, "k").collect()} == {("a", "new", 1), ("b", "b2", 2), ("c", "z", 3)}


def test_sql_guard(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sqlmode.run_sql(spark, "  select id from numbers").count() == 3
    for bad in ("WITH x AS (SELECT 1) SELECT * FROM x", "DROP VIEW numbers", "VALUES (1)", "(SELECT 1)"):
        with pytest.raises(ValueError):
            sqlmode.run_sql(spark, bad)
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert sqlmode.to_ndjson(df).head().value == '{"a":null,"b":1}'


def test_empty_tables(t):
    none = {k: v.where("false") for k, v in t.items()}
    assert ops.session_facets(none["sessions"], none["turns"], none["calls"], none["files"], none["checkpoints"]).count() == 0
    assert ops.session_text(none["turns"]).count() == ops.file_cooccurrence(none["calls"]).count() == ops.first_turns(none["turns"]).count() == 0
    assert ops.checkpoint_log(none["checkpoints"], none["files"]).count() == 0
    assert t["turns"].where(F.col("id").isNull()).count() == 0
