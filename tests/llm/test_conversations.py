import datetime as dt
import random

import pytest

from threadloom.llm import conversations as conv

SCHEMA = "id string, session_id string, turn_index int, role string, content string, ts timestamp_ntz"
T0 = dt.datetime(2025, 1, 1)


def rows(spec):
    """{session: [(index, role, content, seconds)]} as turn rows."""
    out, n = [], 0
    for s, turns in spec.items():
        for i, role, content, sec in turns:
            n += 1
            out.append((f"t{n}", s, i, role, content, None if sec is None else T0 + dt.timedelta(seconds=sec)))
    return out


def broken(spark, spec, extra_sessions=()):
    turns = spark.createDataFrame(rows(spec), SCHEMA)
    sessions = spark.createDataFrame([(s, "x") for s in [*spec, *extra_sessions]] * 2, "id string, session_id string")
    return {r.session_id for r in conv.found(turns, sessions).collect()}


def test_cases(spark):
    h, a = "human", "assistant"
    ok = {
        "plain": [(0, h, "q", 0), (1, a, "r", 1)],
        "several_answers": [(0, h, "q", 0), (1, a, "r", 1), (2, a, "r2", 2)],
        "spellings": [(0, " User ", "q", 0), (1, "ASSISTANT", "r", 1)],
        "twice": [(0, h, "q", 0), (0, "HUMAN", "q", 9), (1, a, "r", 1)],
        "timed": [(None, h, "q", 0), (None, a, "r", 1), (None, h, "q2", 7200), (None, a, "r2", 9000)],
        "blank_between": [(0, h, "q", 0), (1, h, "  \n", 1), (2, a, "r", 2)],
        "clock_jumps": [(0, h, "q", 500), (1, a, "r", 1)],
        "no_clock": [(0, h, "q", None), (1, a, "r", None)],
    }
    bad = {
        "blank": [(0, h, " ", 0), (1, a, " ", 1)],
        "null_text": [(0, h, None, 0)],
        "hole": [(0, h, "q", 0), (2, a, "r", 1)],
        "from_one": [(1, h, "q", 0), (2, a, "r", 1)],
        "clash": [(0, h, "q", 0), (0, h, "other", 0), (1, a, "r", 1)],
        "role_clash": [(0, h, "q", 0), (0, a, "q", 0), (1, a, "r", 1)],
        "answer_first": [(0, a, "r", 0), (1, h, "q", 1), (2, a, "r", 2)],
        "unanswered_end": [(0, h, "q", 0), (1, a, "r", 1), (2, h, "q2", 2)],
        "unanswered": [(0, h, "q", 0), (1, h, "q2", 1), (2, a, "r", 2)],
        "timed_unanswered": [(None, h, "q", 0), (None, h, "q2", 8000), (None, a, "r", 9000)],
        "half_indexed": [(0, h, "q", 0), (None, a, "r", 1)],
        "system_first": [(0, "system", "s", 0), (1, h, "q", 1), (2, a, "r", 2)],
        "placeless": [(None, h, "q", None), (None, a, "r", 5)],
    }
    assert broken(spark, ok | bad, ["no_turns"]) == set(bad) | {"no_turns"}


def brute(turns):
    idx = {t[0] for t in turns}
    rs = sorted({(i, r, c) for i, r, c, _ in turns})
    if {i for i, _, _ in rs} != set(range(len(rs))) or len(idx) != len(rs):
        return True
    seen = [r for _, r, c in rs if c.strip()]
    return not seen or seen[0] != "human" or seen[-1] == "human" or any(x == y == "human" for x, y in zip(seen, seen[1:]))


@pytest.mark.parametrize("chunk", [2, 4096])
def test_random_sessions_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(conv, "CHUNK_TURNS", chunk)
    rng = random.Random(5)
    spec = {}
    for s in range(120):
        turns = []
        for i in range(rng.randint(1, 9)):
            role = "human" if i % 2 == 0 else "assistant"
            if rng.random() < 0.08:
                role = "human"
            turns.append((i if rng.random() > 0.02 else i + 1, role, rng.choice(["x", "y", "z", " "] if rng.random() < 0.1 else ["x", "y"]), i))
        spec[f"s{s}"] = turns
    assert broken(spark, spec) == {s for s, t in spec.items() if brute(t)}


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK_TURNS", 2)
    monkeypatch.setattr(conv, "GAP_QUANTILE", 0.5)
    spec = {"a": [(i, "user" if i % 2 == 0 else None, f"c{i}", i * 10 + (1000 if i >= 3 else 0)) for i in range(6)], "gone": [(0, "human", "q", 0)]}
    spec["a"] = [(i, r or "assistant", c, s) for i, r, c, s in spec["a"]]
    got = conv.conversations(spark.createDataFrame(rows(spec), SCHEMA)).orderBy("position").collect()
    assert [(r.session_id, r.position, r.role, r.content) for r in got] == [("a", i, "human" if i % 2 == 0 else "assistant", f"c{i}") for i in range(6)]
    assert [r.segment for r in got] == [0, 0, 0, 1, 1, 1]
    assert conv.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gaps_and_roles_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK_TURNS", 3)
    h, a = "human", "assistant"
    spec = {
        "timed": [(None, h, "q", 0), (None, a, "r", 10), (None, h, "q2", 9000), (None, a, "r2", 9010), (None, "", "s", 20000), (None, a, "r3", 20010)],
        "hot": [(i, r, f"c{i}", i * 10 + (5000 if i >= 6 else 0)) for i, r in enumerate([h, a, h, "", a, h, a, a])],
    }
    got = {}
    for r in conv.conversations(spark.createDataFrame(rows(spec), SCHEMA)).orderBy("position").collect():
        got.setdefault(r.session_id, []).append((r.position, r.segment, r.role))
    assert got["timed"] == [(0, 0, h), (1, 0, a), (2, 1, h), (3, 1, a), (4, 2, h), (5, 2, a)]
    assert got["hot"] == [(i, int(i >= 6), r) for i, r in enumerate([h, a, h, a, a, h, a, a])]


def test_break_of_the_gaps():
    bulk = {8: 1000, 14: 10000, 15: 13900, 16: 9585, 17: 410, 18: 114, 19: 13, 20: 8, 21: 7}
    pauses = {23: 103, 24: 177, 32: 10, 40: 76}
    assert conv.gap_break(bulk | pauses) == 2.0**11.25
    assert conv.gap_break(bulk) is None and conv.gap_break({}) is None
