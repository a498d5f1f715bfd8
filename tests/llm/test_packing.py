import numpy as np
import pytest

from threadloom.llm import packing


@pytest.mark.parametrize("capacity", [10, 97])
def test_sum_of_squares_fits(capacity):
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, capacity + 1, 3000))[::-1]
    bins = packing.sum_of_squares(sizes, capacity)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= capacity and len(fill) == bins.max() + 1
    assert len(fill) <= 1.05 * np.ceil(sizes.sum() / capacity) + np.count_nonzero(sizes > capacity / 2) * 0.6
    assert len(packing.sum_of_squares(np.empty(0, int), capacity)) == 0
    assert list(packing.sum_of_squares(np.array([capacity, capacity]), capacity)) == [0, 1]


def naive(sizes, capacity):
    """The rule, word for word: try every choice and take the least sum of squares."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for choice in [None, *sorted(set(g for g in gaps if g >= s and g < capacity))]:
            after = list(gaps)
            if choice is None:
                after.append(capacity - s)
            else:
                after[after.index(choice)] = choice - s
            counts = np.bincount([g for g in after if 0 < g < capacity], minlength=1)
            score = ((counts**2).sum(), choice is None, choice or 0)
            best = min(best, (score, after)) if best else (score, after)
        gaps = best[1]
        out.append(sum(1 for g in gaps))
    return gaps


def test_rule_against_every_choice():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 12, 25)
        bins = packing.sum_of_squares(sizes, 12)
        got = sorted(12 - np.bincount(bins, weights=sizes).astype(int))
        assert got == sorted(naive(sizes, 12))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    texts = ["", None, "one", "word " * 50, "x " * 333] + [f"some words {i} " * (i % 9 + 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)] + [(2, "one", "l"), (None, "lost", "l")], "doc_id bigint, text string, limit_id string")
    limits = spark.createDataFrame([(1, "a", 16), (2, "b", 64), (2, "b", 64), (3, "c", None), (4, "d", 0)], "limit_id int, label string, max_tokens int")
    rows = packing.pack(docs, limits).collect()
    size = {r.doc_id: r.n_tokens for r in packing.measure(docs).collect()}
    for limit, cap in ((1, 16), (2, 64)):
        mine = [r for r in rows if r.limit_id == limit]
        fill, pieces = {}, {}
        for r in mine:
            if r.container_id is not None:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= cap and set(pieces) == set(size)
        for d, ps in pieces.items():
            ps.sort()
            assert sum(n for _, n in ps) == size[d] and (len(ps) == 1) == (size[d] <= cap or size[d] % cap == 0 and size[d] // cap == 1)
            assert [a for a, _ in ps] == [sum(n for _, n in ps[:i]) for i in range(len(ps))]
    assert {r.limit_id for r in rows} == {1, 2}
    assert packing.fill(packing.pack(docs, limits), limits).count() == 2
    assert packing.pack(docs.where("false"), limits).count() == 0 and packing.pack(docs, limits.where("false")).count() == 0


def test_whole_and_special_texts(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|>"), (2, "a" * 100_000), (3, "é​😀")], "doc_id bigint, text string")
    assert all(r.n_tokens > 1 for r in packing.measure(docs).collect())
