import random

from threadloom.llm import leakage


def brute(docs, items, n):
    """(doc, item): (longest, n_leaked, n_words) by comparing all places."""
    out = {}
    for d, t in docs:
        w = leakage.words(t)
        for i, u in items:
            v = leakage.words(u)
            longest, places = 0, set()
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    if k >= n:
                        longest, places = max(longest, k), places | set(range(a, a + k))
            if longest:
                old = out.get((d, i), (0, set(), 0))
                out[d, i] = (max(longest, old[0]), places | old[1], len(w))
    return {k: (a, len(p), n) for k, (a, p, n) in out.items()}


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["A", "b", "Ç", "d2"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(25)] + [(3, None)]
    docs = [(i, text(rng.randint(0, 80)).replace(" ", rng.choice([" ", "\n", ", ", "_"]))) for i in range(120)] + [(500, None), (501, "")]
    items += [(30, items[0][1][:20]), (30, text(12))]
    df, it = frames(spark, docs, items)
    for n, limit, wave in ((1, 60, 1), (4, 60, 1 << 20), (7, 10**6, 1 << 20), (7, 100, 4000)):
        monkeypatch.setattr(leakage, "AUTOMATON_CHARS", limit)
        monkeypatch.setattr(leakage, "WAVE_BYTES", wave)
        rows = leakage.leaks(df, it, n).collect()
        got = {(r.doc_id, r.item_id): (r.longest, r.n_leaked, r.n_words) for r in rows}
        assert len(got) == len(rows) and got == brute(docs, items, n)


def test_suffix_of_a_match_in_another_item(spark):
    words = [f"w{i}" for i in range(18)]
    df, it = frames(spark, [(1, " ".join(words))], [(7, " ".join(words)), (8, "x y " + " ".join(words[3:]) + " z")])
    assert {r.item_id: (r.longest, r.n_leaked) for r in leakage.leaks(df, it).collect()} == {7: (18, 18), 8: (15, 15)}


def test_clean_is_one_result_whatever_the_automatons(spark, monkeypatch):
    a, b = ([f"{x}{i}" for i in range(20)] for x in "ab")
    rest = [f"c{i}" for i in range(25)]
    items = [(1, " ".join(a)), (2, " ".join(b))] + [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(3, 9)]
    docs = [(1, " ".join(a + b + rest)), (2, " ".join(a + rest)), (3, " ".join(a[:10] + b + a[10:] + rest * 2)), (4, None), (5, "")]
    df, it = frames(spark, docs, items)
    got = []
    for limit, wave in ((10**6, 1 << 27), (60, 1 << 27), (60, 1)):
        monkeypatch.setattr(leakage, "AUTOMATON_CHARS", limit)
        monkeypatch.setattr(leakage, "WAVE_BYTES", wave)
        got.append({r.doc_id: (r.text, r.n_removed) for r in leakage.clean(df, it).collect()})
    assert got[0] == got[1] == got[2] and 1 not in got[0]
    assert got[0][2] == (" " + " ".join(rest), 20) and got[0][3] == (" ".join(a[:10]) + "  " + " ".join(a[10:] + rest * 2), 20)


def test_found_takes_thirteen_words(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    docs = [(1, "zz " + " ".join(words[3:16]).upper() + " zz"), (2, " ".join(words[3:15])), (3, " ".join(words[:12] + ["no"] + words[12:])), (4, "--".join(words))]
    df, it = frames(spark, docs * 2, [(7, item), (7, item), (8, "short one")])
    assert {tuple(r) for r in leakage.found(df, it).collect()} == {(1, 7), (3, 7), (4, 7)} and leakage.found(df, it).count() == 3
    row = next(r for r in leakage.leaks(df, it).collect() if r.doc_id == 4)
    assert (row.longest, row.n_leaked, row.n_words) == (30, 30, 30)
    assert leakage.found(df, it.where("false")).count() == 0 and leakage.found(df.where("false"), it).count() == 0


def test_clean(spark):
    words = [f"w{i}" for i in range(20)]
    docs = [(1, "before. " * 20 + " ".join(words[:13]) + " after it"), (2, " ".join(words)), (3, "nothing"), (4, None), (5, "")]
    df, it = frames(spark, docs, [(7, " ".join(words))])
    got = {r.doc_id: (r.text, r.n_removed) for r in leakage.clean(df, it).collect()}
    assert got == {1: ("before. " * 20 + " after it", 13), 3: ("nothing", 0), 4: (None, 0), 5: ("", 0)}
