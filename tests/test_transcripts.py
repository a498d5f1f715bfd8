"""The transcript parser and capture, export, import, merge."""

import json

import pytest

from threadloom.plans import index, search, transport
from threadloom.plans.capture import Commit, capture
from threadloom.plans.store import Store
from threadloom.sources import scan, transcripts

PLAN = "/home/u/.claude/plans/p.md"


def user(content, **kw):
    return {"type": "user", "sessionId": "S", "gitBranch": "main", "timestamp": "2025-01-01T10:00:00Z", "message": {"role": "user", "content": content}} | kw


def assistant(*blocks, **kw):
    return {"type": "assistant", "sessionId": "S", "timestamp": "2025-01-01T10:00:01.250Z", "message": {"role": "assistant", "content": list(blocks) if blocks[:1] != ("text",) else blocks[1]}} | kw


def use(name, uid="u1", **inp):
    return {"type": "tool_use", "id": uid, "name": name, "input": inp}


def said(text):
    return {"type": "text", "text": text}


def parse(spark, *records):
    rows = [("f.jsonl", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    recs = transcripts.records(spark.createDataFrame(rows, "file_name string, line_no int, raw_line string"))
    turns = [(r.role, r.content) for r in transcripts.turns(recs).orderBy("turn_index").collect()]
    calls = [(r.tool, r.path, r.cmd_prefix) for r in transcripts.tool_calls(recs).orderBy("call_order").collect()]
    return turns, calls, recs


def test_basic(spark):
    turns, calls, recs = parse(
        spark, user("hello"), assistant(said("a"), use("Write", file_path="x.go"), {"type": "thinking", "thinking": "hm"}, said("b")), user([{"type": "tool_result", "tool_use_id": "u1", "content": "ok"}]),
        assistant(said("c"), use("Bash", command="z" * 150)), {"type": "file-history-snapshot"}, user("side", isSidechain=True), assistant("text", "plain"),
    )
    assert turns == [("human", "hello"), ("assistant", "a\nb"), ("assistant", "c"), ("assistant", "plain")]
    assert calls == [("Write", "x.go", ""), ("Bash", "", "z" * 100)]
    s = transcripts.sessions(recs).head()
    assert (s.session, s.branch) == ("S", "main")


def test_malformed_and_empty(spark):
    assert parse(spark, "not json", user("one"), '{"torn', "[]", "null", "")[0] == [("human", "one")]
    assert parse(spark, user(""), user([]), user(None), user({"type": "text", "text": "lone"}), assistant())[:2] == ([], [])
    assert parse(spark, "x")[0] == []


def test_plan_write_comes_before_text(spark):
    turns, calls, _ = parse(spark, assistant(said("text"), use("Write", file_path=PLAN, content="the plan")))
    assert turns == [("assistant", "the plan"), ("assistant", "text")] and calls == [("Write", PLAN, "")]


def test_plan_read_is_answered_once(spark):
    result = {"type": "tool_result", "tool_use_id": "r1", "content": [said("plan text")]}
    turns, calls, _ = parse(spark, assistant(said("look"), use("Read", "r1", path=PLAN)), user([result, said("thanks")]), user([result]))
    assert turns == [("assistant", "look"), ("assistant", "plan text"), ("human", "thanks")] and len(calls) == 1
    assert parse(spark, assistant(use("Read", "r1", file_path="src/a.go")), user([result]))[0] == []


def test_repeated_lines_count_once(spark):
    rows = [("f.jsonl", 0, json.dumps(user("a")))] * 2
    recs = transcripts.records(spark.createDataFrame(rows, "file_name string, line_no int, raw_line string"))
    assert transcripts.turns(recs).count() == 1


def test_name_status_and_touched(spark):
    git = scan.name_status(spark.createDataFrame([("M\ta.go",), ("R100\told\tnew",), ("bad",)], "value string"))
    assert {tuple(r) for r in git.collect()} == {("M", "a.go"), ("R100", "old\tnew")}
    tools = spark.createDataFrame([("/repo/a.go",), ("/repo/b.go",), ("/x/repo/c",), ("",)], "path string")
    assert {tuple(r) for r in scan.touched(git, tools, "/repo/").collect()} == {("M", "a.go"), ("R100", "old\tnew"), ("T", "b.go"), ("T", "/x/repo/c")}
    assert scan.transcript_folder("/h", "/a_b/c") == "/h/.claude/projects/-a-b-c"


@pytest.fixture(scope="module")
def captured(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("capture")
    folder = root / "in"
    folder.mkdir()
    write = lambda name, *rs: (folder / name).write_text("\n".join(json.dumps(r) for r in rs) + "\n")
    write("one.jsonl", user("fix the login token"), assistant(said("authentication fixed"), use("Edit", file_path="/repo/auth.go")))
    write("two.jsonl", user("database migration of the token"), assistant(said("added a login column and fixed it")))
    (folder / "empty.jsonl").write_text("")
    write("notes.txt", user("ignored"))
    store = Store(spark, str(root / "truth"))
    commit = Commit("abc", "main", "a@example.org", "2025-01-02 00:00:00", ["M\tREADME.md"], "/repo/")
    return root, folder, write, store, commit, capture(store, f"file://{folder}", commit)


def test_capture_is_idempotent_and_incremental(spark, captured):
    root, folder, write, store, commit, n = captured
    assert n == 2 and store.table("sessions").count() == 2 and store.table("turns").count() == 4 and store.table("tool_calls").count() == 1
    assert capture(store, f"file://{folder}", commit) == 0 and store.table("sessions").count() == 2
    assert {r.file_path for r in store.table("files_touched").collect()} == {"README.md", "auth.go"}
    # Empty files are not listed by the source, so they have no state either.
    assert store.state().count() == 2 and store.table("checkpoint_sessions").count() == 2
    write("three.jsonl", user("a new one"), assistant(said("yes")))
    assert capture(store, f"file://{folder}", Commit("def", "main", "a@example.org", "2025-01-03 00:00:00", [])) == 1
    assert store.table("checkpoints").count() == 2


def test_export_import_round_trip(spark, captured):
    root, _, _, store, _, _ = captured
    out = str(root / "out")
    n = transport.export_delta(store, out, "b1")
    assert n == store.table("checkpoints").count() and transport.export_delta(store, out, "b2") == 0
    other = Store(spark, str(root / "other"))
    assert transport.import_batches(other, out) == store.table("sessions").count()
    for name in ("sessions", "turns", "tool_calls", "checkpoints", "files_touched", "checkpoint_sessions"):
        assert {tuple(r) for r in other.table(name).collect()} == {tuple(r) for r in store.table(name).collect()}
    assert transport.import_batches(other, out) == 0 and other.unexported().count() == 0
    meta = spark.read.parquet(f"{out}/meta").collect()
    assert [(r.batch, r.n_sessions, r.n_turns) for r in meta] == [("b1", store.table("sessions").count(), store.table("turns").count())]
    third = Store(spark, str(root / "third"))
    assert transport.sync_self(third, out, str(root / "third-index")) == store.table("sessions").count()
    assert index.read_state(spark, str(root / "third-index"))["turn_count"] == str(store.table("turns").count())
    own = {n: store.table(n) for n in transport.PARTS}
    merged = transport.merge_team(own, [transport.read_export(spark, out)])
    assert {n: d.count() for n, d in merged.items()} == {n: d.count() for n, d in own.items()}


def test_index_and_search(spark, captured):
    root, folder, write, store, _, _ = captured
    idx = str(root / "index")
    with pytest.raises(ValueError):
        search.search(spark, idx, "login")
    # An index that is not there is built.
    assert search.search(spark, idx, "zzz", source=store, rank_of_model=8).count() == 0
    counts = index.build_index(store, idx, "/repo/", 8)
    assert counts["session_count"] == store.table("sessions").count() and counts["embedding_dim"] > 0
    got = search.search(spark, idx, "login authentication").collect()
    assert got[0].score == 1.0 and got[0].snippet in ("authentication fixed", "fix the login token")
    assert search.search(spark, idx, "login", search.Filters(file="auth.go")).count() == 2
    assert {r.session_id for r in search.search(spark, idx, " ").collect()} == {r.id for r in store.table("sessions").collect()}
    assert index.extend_index(spark, store.truth(), idx) == 0  # nothing new
    doc = json.loads(search.result_document(search.search(spark, idx, "login", limit=1), "login").head().value)
    assert (doc["mode"], doc["total"], len(doc["results"]), doc["query"]) == ("hybrid", 1, 1, "login")
    none = json.loads(search.result_document(search.search(spark, idx, "", search.Filters(author="nobody")), "", search.Filters(author="nobody")).head().value)
    assert (none["mode"], none["total"], none["results"], none["filters"]["author"]) == ("filter", 0, [], "nobody")


def test_a_session_added_by_capture_is_found(spark, captured):
    root, folder, write, store, commit, _ = captured
    idx = str(root / "grown")
    index.build_index(store, idx, "/repo/", 8)
    assert search.search(spark, idx, "watermelon").count() == 0
    write("four.jsonl", user("plant the watermelon"), assistant(said("watermelon planted"), use("Write", file_path="/repo/melon.go")))
    assert capture(store, f"file://{folder}", Commit("eee", "main", "m@example.org", "2025-01-04 00:00:00", ["A\tseed.txt"], "/repo/"), idx) == 1
    got = search.search(spark, idx, "watermelon").collect()
    assert len(got) == 1 and got[0].user_email == "m@example.org" and "watermelon" in got[0].snippet and got[0].turn_count == 2
    assert search.search(spark, idx, "watermelon", search.Filters(file="melon", author="m@example.org", commit="ee")).count() == 1
    # The same index as one built anew, but for edges and latent vectors.
    anew = str(root / "anew")
    index.build_index(store, anew, "/repo/", 8)
    for name in ("turns_ft", "tool_calls_index", "files_index", "session_facets", "postings"):
        old, new = (index.Index(spark, i, {}).table(name) for i in (idx, anew))
        assert sorted(map(repr, old.collect())) == sorted(map(repr, new.collect())), name
    state = [index.read_state(spark, i) for i in (idx, anew)]
    assert all(state[0][k] == state[1][k] for k in ("session_count", "turn_count", "token_count"))


def test_stream_appends_once(spark, tmp_path):
    from threadloom.streaming import capture_stream as cs

    lines = [("f.jsonl", 0, json.dumps(user("hi"))), ("f.jsonl", 1, json.dumps(assistant(said("yo"))))]
    spark.createDataFrame(lines, cs.LINES).write.parquet(str(tmp_path / "in" / "a"))
    store = Store(spark, str(tmp_path / "truth"))
    for ck in ("c1", "c2"):  # the second run starts over, as after a lost checkpoint
        cs.capture_stream(store, cs.line_stream(spark, str(tmp_path / "in" / "*")), str(tmp_path / ck)).awaitTermination()
    assert store.table("turns").count() == 2
    assert {(r.role, r.n_turns) for r in cs.activity(store.table("turns")).collect()} == {("human", 1), ("assistant", 1)}


def test_a_file_in_two_batches_goes_on_where_it_stopped(spark, tmp_path):
    from threadloom.streaming import capture_stream as cs

    store = Store(spark, str(tmp_path / "truth"))
    says = [user("one"), assistant(said("two")), user("three"), assistant(said("four"))]
    for part in (0, 1):
        lines = [("f.jsonl", i, json.dumps(r)) for i, r in enumerate(says) if i // 2 == part]
        spark.createDataFrame(lines, cs.LINES).write.parquet(str(tmp_path / "in" / f"b{part}"))
        cs.capture_stream(store, cs.line_stream(spark, str(tmp_path / "in" / "*")), str(tmp_path / "ck")).awaitTermination()
    got = [(r.turn_index, r.content) for r in store.table("turns").orderBy("turn_index").collect()]
    assert got == [(0, "one"), (1, "two"), (2, "three"), (3, "four")]
