import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions.text import query_terms
from threadloom.operators import lsa, retrieval

DOCS = [
    ("d1", "login token authentication session password"),
    ("d2", "authentication middleware verifies the login token"),
    ("d3", "database migration adds a column index"),
    ("d4", "slow database query needs an index migration"),
    ("d5", ""),
    ("d6", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, content string")


def expected_bm25(terms):
    toks = {i: query_terms(t or "") for i, t in DOCS}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ws in toks.items():
        s = 0
        for t in set(terms):
            tf, df = ws.count(t), sum(t in w for w in toks.values())
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        if s:
            out[i] = round(s, 6)
    return out


def test_bm25_index_equals_scan_equals_formula(spark, docs):
    terms = query_terms("authentication database index")
    scan = {r.id: r.score for r in retrieval.bm25_scan(docs, "id", "content", terms).collect()}
    index = {r.id: r.score for r in retrieval.bm25(*retrieval.postings(docs), terms).collect()}
    assert scan == pytest.approx(expected_bm25(terms), abs=2e-6) and index == pytest.approx(scan, abs=2e-6)
    assert retrieval.bm25_scan(docs, "id", "content", ["absent"]).count() == 0
    assert retrieval.bm25_scan(docs.where("false"), "id", "content", terms).count() == 0


def test_best_turn_prefers_score_then_place(spark):
    hits = spark.createDataFrame([("a", "s", 3, 1.0), ("b", "s", 1, 1.0), ("c", "s", 0, 0.5), ("d", "t", None, 0.2), ("e", "u", 0, 0.0)], "id string, session_id string, turn_index int, score double")
    assert {(r.session_id, r.turn_id) for r in retrieval.best_turn(hits).collect()} == {("s", "b"), ("t", "d")}


def test_fusion(spark):
    t = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    lat = spark.createDataFrame([("b", 0.5), ("c", 0.25)], "id string, score double")
    den = spark.createDataFrame([("c", 0.9)], "id string, score double")
    two = {r.id: r.score for r in retrieval.fuse(t, lat).collect()}
    assert two == pytest.approx({"a": 0.4, "b": 0.8, "c": 0.3})
    three = {r.id: r.score for r in retrieval.fuse(t, lat, den).collect()}
    assert three == pytest.approx({"a": 0.35, "b": 0.275, "c": 0.6})
    # No dense score at all: two-way weights.
    assert {r.id: r.score for r in retrieval.fuse(t, lat, den.where("false")).collect()} == pytest.approx(two)


def test_lsa_against_numpy(spark, docs):
    model = lsa.fit_lsa(docs, "id", "content", 3)
    w = retrieval.tfidf(docs.where("content <> ''"), "id", "content").toPandas()
    ids, terms = sorted(set(w.id)), sorted(set(w.term))
    b = np.zeros((len(ids), len(terms)))
    b[[ids.index(i) for i in w.id], [terms.index(t) for t in w.term]] = w.w
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    assert model.sigma == pytest.approx(s[: len(model.sigma)], rel=1e-6)
    vec = {r.id: np.array(r.embedding) for r in model.vectors.collect()}
    full = u[:, : len(model.sigma)] * s[: len(model.sigma)]
    for i, x in enumerate(ids):
        for j, y in enumerate(ids):
            assert vec[x] @ vec[y] == pytest.approx(full[i] @ full[j], abs=1e-6)
    found = {r.id: r.score for r in model.search("authentication login").collect()}
    assert max(found, key=found.get) in ("d1", "d2") and found.get("d1", 0) + found.get("d2", 0) > found.get("d3", 0) + found.get("d4", 0)
    assert model.embed("") == [0.0] * len(model.sigma)


def test_lsa_needs_two_documents(spark, docs):
    assert lsa.fit_lsa(docs.where("id = 'd1'"), "id", "content") is None
    assert lsa.fit_lsa(docs.where("false"), "id", "content") is None


def test_tfidf_weights(spark, docs):
    got = {(r.id, r.term): r.w for r in retrieval.tfidf(docs, "id", "content").collect()}
    counts = {i: Counter(query_terms(t or "")) for i, t in DOCS}
    df = Counter(t for c in counts.values() for t in c)
    n = sum(bool(t) for _, t in DOCS)
    for (i, t), w in got.items():
        top = max(c for x, c in counts[i].items() if df[x] >= 2)
        assert w == pytest.approx((0.5 + 0.5 * counts[i][t] / top) * (math.log(n / df[t]) + 1))
    assert {t for _, t in got} == {t for t, c in df.items() if c >= 2}


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id int, e array<float>")
    assert [(r.id, r.score) for r in retrieval.vector_search(v, "id", "e", [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.6)]
    assert v.select(F.count("*")).head()[0] == 5


def test_tfidf_of_turns_equals_that_of_the_joined_text(spark):
    rows = [("s1", "login token"), ("s1", "token fails"), ("s2", "login again"), ("s2", None), ("s3", ""), ("s4", " "), ("s5", ""), ("s5", ""), ("s6", None)]
    turns = spark.createDataFrame(rows, "id string, content string")
    joined = spark.createDataFrame([("s1", "login token token fails"), ("s2", "login again"), ("s3", ""), ("s4", " "), ("s5", " "), ("s6", None)], "id string, content string")
    got, want = ({(r.id, r.term): r.w for r in retrieval.tfidf(d, "id", "content", 1).collect()} for d in (turns, joined))
    assert got and got == pytest.approx(want)


def test_lsa_keeps_the_most_frequent_terms(spark, docs):
    model = lsa.fit_lsa(docs, "id", "content", 3, most_terms=4)
    df = Counter(t for _, c in DOCS for t in set(query_terms(c or "")))
    assert {r.term for r in model.terms.collect()} == set(sorted((t for t in df if df[t] >= 2), key=lambda t: (-df[t], t))[:4])


def test_embedder_hashes_turns_and_queries_alike(spark):
    from threadloom.plans.embed import HashingEmbedder, dense_scores

    e = HashingEmbedder(64)
    turns = spark.createDataFrame([("a", "login token"), ("a", "again the login"), ("b", "database migration"), ("c", None), ("d", "the of")], "session_id string, content string")
    vectors = e.sessions(turns)
    got = {r.session_id: list(r.embedding) for r in vectors.collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx(e.query("login token again login"), abs=1e-6)
    assert dense_scores(vectors, e, "login token").orderBy(F.desc("score")).head().id == "a"
    assert e.query("") == [0.0] * 64 and dense_scores(vectors, e, "").count() == 0


def test_krylov_factors_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(lsa, "BLOCK", 12)
    rng = np.random.default_rng(5)
    b = (rng.random((150, 90)) < 0.1) * rng.random((150, 90)) + np.outer(rng.random(150), rng.random(90)) * 0.2
    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for r in b]
    values, v = lsa._right_factors(spark.createDataFrame(rows, "idx array<int>, w array<double>"), 90, 15)
    want = np.linalg.svd(b)[1][:15]
    assert values == pytest.approx(want, rel=2e-3) and np.allclose(v.T @ v, np.eye(15), atol=1e-8)
    assert np.linalg.norm(b @ v, axis=0) == pytest.approx(values, rel=1e-6)
