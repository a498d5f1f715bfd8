"""Hybrid search over a stored index against brute force: BM25, LSA by numpy, hashed vectors, fusion."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest

from threadloom.functions.text import query_terms
from threadloom.plans import index, search
from threadloom.plans.embed import HashingEmbedder

TALK = {
    "s1": ["the login token fails", "authentication of the login was repaired", "thanks"],
    "s2": ["database migration adds a column", "the column index was slow"],
    "s3": ["authentication middleware", "token and session of the login"],
    "s4": ["retry queue timeout", "the queue of the retry was drained", "database timeout"],
    "s5": ["session token expired", "middleware drains the session"],
    "s6": ["slow database query", "index migration of the column"],
}
QUERY = "login token timeout"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    mk, at = spark.createDataFrame, dt.datetime(2025, 1, 1)
    turns = [(f"{s}-{i}", s, i, "human" if i % 2 == 0 else "assistant", text, at) for s, texts in TALK.items() for i, text in enumerate(texts)]
    tables = {
        "sessions": mk([(s, None, s, at, "human" if s < "s5" else "agent", None, f"{s}@example.org", "main") for s in TALK], "id string, parent_session_id string, session_hash string, captured_at timestamp_ntz, actor_type string, agent_id string, user_email string, branch string"),
        "turns": mk(turns + turns[:3], "id string, session_id string, turn_index int, role string, content string, ts timestamp_ntz"),
        "tool_calls": mk([("c1", "s1", 0, "Edit", "src/login.go", "")], "id string, session_id string, call_order int, tool string, path string, cmd_prefix string"),
        "checkpoints": mk([("k1", "abc", "main", "a@example.org", at)], "id string, git_sha string, git_branch string, user_email string, ts timestamp_ntz"),
        "files_index": mk([("k1", "s1", "a.go", "M"), ("k1", "s4", "q.go", "M")], "checkpoint_id string, session_id string, file_path string, change_type string"),
    }
    root = str(tmp_path_factory.mktemp("index"))
    index.write_index(spark, tables, root, rank=4, embedder=HashingEmbedder(32))
    return root


def brute():
    turns = {(s, i): query_terms(t) for s, ts in TALK.items() for i, t in enumerate(ts)}
    n, avg = len(turns), sum(map(len, turns.values())) / len(turns)
    bm25 = {}
    for (s, _), ws in turns.items():
        score = 0.0
        for t in set(query_terms(QUERY)):
            tf, df = ws.count(t), sum(t in w for w in turns.values())
            if tf:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        if score:
            bm25[s] = max(bm25.get(s, 0), score)
    counts = {s: Counter(w for t in ts for w in query_terms(t)) for s, ts in TALK.items()}
    df = Counter(t for c in counts.values() for t in c)
    terms = sorted(t for t in df if df[t] >= 2)
    idf = np.array([math.log(len(counts) / df[t]) + 1 for t in terms])
    b = np.array([[(0.5 + 0.5 * c[t] / max(c[x] for x in terms if x in c)) * (t in c) for t in terms] for c in counts.values()]) * idf
    _, sigma, vt = np.linalg.svd(b, full_matrices=False)
    v, sigma = vt[:4].T, sigma[:4]
    q = Counter(query_terms(QUERY))
    folded = (np.array([(0.5 + 0.5 * q[t] / max(q.values())) * (t in q) for t in terms]) * idf) @ v / sigma
    cos = lambda x, y: x @ y / math.sqrt((x @ x) * (y @ y))
    lsa = {s: cos(row @ v, folded) for s, row in zip(counts, b)}
    e = HashingEmbedder(32)
    dense = {s: cos(np.array(e.query(" ".join(ts))), np.array(e.query(QUERY))) for s, ts in TALK.items()}
    out = {}
    for weight, scores in ((0.35, bm25), (0.10, lsa), (0.55, dense)):
        top = max(scores.values())
        for s, x in scores.items():
            if x > 0:
                out[s] = out.get(s, 0) + weight * x / top
    return out


def test_hybrid_search_against_brute_force(spark, built):
    got = search.search(spark, built, QUERY, embedder=HashingEmbedder(32)).collect()
    want = brute()
    assert {r.session_id: r.score for r in got} == pytest.approx({s: round(x, 2) for s, x in want.items()}, abs=0.0101)
    assert [r.session_id for r in got] == sorted(want, key=lambda s: (-round(want[s], 6), s))
    assert got[0].turn_count == len(TALK[got[0].session_id]) and all(r.snippet in TALK[r.session_id] for r in got)


def test_filters_change_no_score(spark, built):
    every = {r.session_id: r.score for r in search.search(spark, built, QUERY, embedder=HashingEmbedder(32)).collect()}
    human = {r.session_id: r.score for r in search.search(spark, built, QUERY, search.Filters(actor="human", file=r"\.go$"), embedder=HashingEmbedder(32)).collect()}
    assert human and human == {s: x for s, x in every.items() if s in ("s1", "s4")}


def test_only_the_buckets_of_the_terms_are_read(spark, built):
    ix = index.open_index(spark, built)
    plan = ix.postings(query_terms("login"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and ix.postings([]).count() == 0
    assert len(ix.postings(query_terms("login")).select("bucket").distinct().collect()) == 1
