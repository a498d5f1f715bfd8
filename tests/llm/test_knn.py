import datetime as dt

import numpy as np
import pytest

from threadloom.llm import knn
from threadloom.llm.hnsw import Hnsw

SCHEMA = "session_id string, embedding array<float>, model string, generated_at timestamp_ntz"
NOW = dt.datetime(2025, 1, 1)


def topics(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, dim))
    x = c[rng.integers(0, k, n)] + 0.9 * rng.standard_normal((n, dim))
    twins = rng.integers(0, n, n // 20)
    x[rng.permutation(n)[: len(twins)]] = x[twins] + 0.1 * rng.standard_normal((len(twins), dim))
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


def test_graph_recall():
    x = topics(3000, 32, 8, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    g = Hnsw(x, knn._levels(len(x)), 48)
    near = g.search_members(np.arange(len(x)), 11, 96)[1]
    visit = g.search(x[:500], 11, 96)[1]
    recall = np.mean([len(set(true[i]) & set(near[i])) / 10 for i in range(len(x))])
    assert recall > 0.9 and np.mean([len(set(true[i]) & set(visit[i])) / 10 for i in range(500)]) > 0.85
    assert all(layer.dtype == np.int32 and layer.ndim == 2 for layer in g.layers)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_graphs(n):
    x = np.eye(n, 5, dtype=np.float32)
    sims, ids = Hnsw(x, np.zeros(n, int)).search(x, 3, 4)
    assert [i[0] for i in ids] == list(range(n)) and ids.shape == (n, 3)


def test_found_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 200)
    monkeypatch.setattr(knn, "GRAPH", 150)  # cells are split
    monkeypatch.setattr(knn, "SAMPLE", 64)  # four coarse cells
    monkeypatch.setattr(knn, "SLICE", 100)  # graphs are built for shares of their visitors
    x = topics(1500, 24, 6, 2)
    rows = [(f"s{i:04d}", [float(v) for v in e], "m", NOW) for i, e in enumerate(x)]
    bad = [("n1", None, "m", NOW), ("n2", [], "m", NOW), ("n3", [1.0], "m", NOW), ("n4", [0.0] * 24, "m", NOW), ("n5", [float("nan")] * 24, "m", NOW), ("n6", [float("inf")] + [1.0] * 23, "m", NOW), ("n7", [None] + [1.0] * 23, "m", NOW), (None, rows[0][1], "m", NOW), ("s0001", rows[1][1], "other", NOW)]
    df = spark.createDataFrame(rows + rows[:100] + bad, SCHEMA).selectExpr("*", "1 AS rep", "2 AS h1")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    want = {("m", f"s{i:04d}", f"s{j:04d}") for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
    got = {tuple(r) for r in knn.found(df).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 20
    near = knn.neighbours(df, k=5, ef=64, ef_build=48, margin=0.3).where("model = 'm'").toPandas()
    np.fill_diagonal(s, -2)
    true = {f"s{i:04d}": {f"s{j:04d}" for j in r} for i, r in enumerate(np.argsort(-s, axis=1)[:, :5])}
    found = near.groupby("session_id")["neighbour"].apply(set).to_dict()
    assert np.mean([len(true[k] & found.get(k, set())) / 5 for k in true]) >= 0.9
    assert near.groupby("session_id").size().max() <= 5


def test_copies_and_replaced_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.1]
    rows = [("x1", a, "m", NOW), ("x2", a, "m", NOW), ("x3", a, "m", NOW), ("y", b, "m", NOW), ("z", c, "m", NOW), ("z", a, "m", NOW - dt.timedelta(1)), ("y", b, "m", NOW)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in knn.found(df).collect()} == {("m", "x1", "x2"), ("m", "x1", "x3"), ("m", "x2", "x3"), ("m", "y", "z")}
    assert {(r.session_id, r.rep) for r in knn.copies_of(df).collect()} == {("x1", "x1"), ("x2", "x1"), ("x3", "x1")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert knn.found(none).count() == 0 and knn.neighbours(none).count() == 0 and knn.copies_of(none).count() == 0


def test_a_model_of_copies_has_a_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 1)
    monkeypatch.setattr(knn, "SAMPLE", 2)
    rows = [(f"c{i:03d}", [1.0, 2.0], "copies", NOW) for i in range(300)] + [(x, v, "o", NOW) for x, v in (("x", [1.0, 0.0]), ("y", [1.0, 0.1]))]
    near = {(r.model, r.session_id, r.neighbour) for r in knn.neighbours(spark.createDataFrame(rows, SCHEMA), margin=2.0).collect()}
    assert near == {("o", "x", "y"), ("o", "y", "x")}
    assert (knn.EF, knn.EF_BUILD) >= (16, 20)


def test_graphs_and_visits_do_not_grow(spark, monkeypatch):
    """Whatever the number of vectors, shards stay the same size and a vector goes to as many of them."""
    monkeypatch.setattr(knn, "CELL", 100)
    monkeypatch.setattr(knn, "GRAPH", 200)
    monkeypatch.setattr(knn, "SAMPLE", 160)  # ten coarse cells at most
    monkeypatch.setattr(knn, "SLICE", 200)
    monkeypatch.setattr(knn, "VISITS", 3)
    seen = {}
    for n in (2000, 8000):
        rows = [(f"s{i:05d}", v.tolist(), "m", NOW) for i, v in enumerate(topics(n, 16, 12, 3))]
        vectors, digests = knn.usable(spark.createDataFrame(rows, SCHEMA))
        cells = knn.fit(vectors, digests)
        dealt = knn._dealt(vectors, cells, knn.MARGIN).select("shard", "session_id", "part").toPandas()
        searches = dealt[dealt.part != knn.MEMBER].groupby("session_id").size()
        assert len(searches) == n and searches.max() <= 1 + knn.VISITS and (dealt.part == knn.SEARCHER).sum() == n
        seen[n] = (len(cells["m"].fine), dealt.groupby("shard").size().max())
    assert len(cells["m"].coarse) <= 10 and seen[8000][0] > 2.5 * seen[2000][0] and seen[8000][1] <= 600


def test_many_copies_are_a_star(spark, monkeypatch):
    monkeypatch.setattr(knn, "COPIES", 3)
    rows = [(f"a{i}", [1.0, 0.0, 0.0], "m", NOW) for i in range(6)] + [(f"b{i}", [0.99, 0.1, 0.0], "m", NOW) for i in range(2)] + [("c", [0.0, 0.0, 1.0], "m", NOW)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[1:] for r in knn.found(df).collect()}
    assert got == {("a0", f"a{i}") for i in range(1, 6)} | {("a0", "b0"), ("a0", "b1"), ("b0", "b1")}
    assert {(r.session_id, r.rep) for r in knn.copies_of(df).collect()} == {(f"a{i}", "a0") for i in range(6)} | {("b0", "b0"), ("b1", "b0")}
