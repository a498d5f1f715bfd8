import math
import random
from collections import Counter
from itertools import combinations

import pytest

from threadloom.llm import pairs


def tables(spark, baskets):
    files = [(c, f"s{k}", p, "M") for c, ps in baskets.items() for p in ps for k in range(2)]
    return (
        spark.createDataFrame(files, "checkpoint_id string, session_id string, file_path string, change_type string"),
        spark.createDataFrame([(c,) for c in baskets] * 2 + [("empty",)], "id string"),
    )


@pytest.mark.parametrize("block,hot,flush", [(3, 10_000, 200_000), (512, 10_000, 50), (512, 5, 7)])
def test_counts_against_brute_force(spark, monkeypatch, block, hot, flush):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "HOT_RECORDS", hot)
    monkeypatch.setattr(pairs, "FLUSH", flush)
    monkeypatch.setattr(pairs, "STRIPE", 4)
    rng = random.Random(3)
    baskets = {f"c{i}": [f"f{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 12))] for i in range(60)}
    files, cps = tables(spark, baskets)
    sets = {c: set(p) for c, p in baskets.items()}
    n, single = len(baskets) + 1, Counter(x for s in sets.values() for x in s)
    both = Counter(x for s in sets.values() for x in combinations(sorted(s), 2))
    got = {(r.file_a, r.file_b): r for r in pairs.pairs(files, cps).collect()}
    assert {k: r.c for k, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.a, r.b, r.n) == (single[a], single[b], n) and r.lift == pytest.approx(r.c * n / (r.a * r.b)) and r.llr >= 0
    want = {k for k, c in both.items() if c >= 5 and c * n >= 3 * single[k[0]] * single[k[1]]}
    assert {tuple(r) for r in pairs.found(files, cps).collect()} == want
    least = sorted(r.llr for r in got.values())[len(got) // 2]
    assert {(r.file_a, r.file_b) for r in pairs.significant(files, cps, least).collect()} == {k for k, r in got.items() if r.llr >= least and r.lift > 1}


def test_log_likelihood(spark):
    from pyspark.sql import functions as F

    c, a, b, n = 10.0, 20.0, 15.0, 100.0
    cells = [(c, a * b / n), (a - c, a * (n - b) / n), (b - c, (n - a) * b / n), (n - a - b + c, (n - a) * (n - b) / n)]
    want = 2 * sum(o * math.log(o / e) for o, e in cells if o)
    got = spark.range(1).select(pairs.log_likelihood(*[F.lit(x) for x in (c, a, b, n)]).alias("g")).head().g
    assert got == pytest.approx(want)


def test_paths_and_cache(spark):
    files = spark.createDataFrame(
        [("c1", "./a"), ("c1", "a"), ("c1", "old\tb"), ("c1", " "), ("c1", None), (None, "a"), ("c2", "a"), ("c2", "./b"), ("c2", "c"), ("c3", "x\t./c"), ("c3", "a")], "checkpoint_id string, file_path string"
    )
    cps = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    got = {(r.file_a, r.file_b): r.c for r in pairs.pairs(files, cps).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1}
    cache = spark.createDataFrame([("a", "b", 2), ("a", "b", 2), ("c", "a", 2), ("b", "c", 9), ("q", "r", 3)], "file_a string, file_b string, count int")
    diff = {(r.file_a, r.file_b): r.problem for r in pairs.cache_differences(files, cps, cache).collect()}
    assert diff == {("a", "c"): "turned", ("b", "c"): "too high", ("q", "r"): "extra"}
    assert {r.problem for r in pairs.cache_differences(files, cps, cache.where("false")).collect()} == {"missing"}
    none = files.where("false")
    assert pairs.found(none, cps).count() == 0 and pairs.pairs(none, cps.where("false")).count() == 0


def test_every_pair_is_a_query(spark, data):
    from threadloom.llm.queries import QUERIES

    every, twice = ({(r.file_a, r.file_b): r.c for r in QUERIES[n](spark, data).collect()} for n in ("p7_all_pairs", "p7_pairs"))
    assert 1 in every.values() and {k: c for k, c in every.items() if c > 1} == twice
