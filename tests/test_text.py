import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import codes, text, vectors


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).head().r


@pytest.mark.parametrize(("word", "want"), [("running", "runn"), ("authentication", "authentica"), ("connections", "connection"), ("go", "go"), ("cities", "citi"), ("ééés", "ééé"), ("lies", "lies"), ("tests", "test")])
def test_stem(spark, word, want):
    assert one(spark, text.stem, word) == want
    assert text.query_terms(word) in ([want], [])


def test_tokenize(spark):
    got = one(spark, text.tokenize, "Hello, World! This is a test_case of error 404: not found.")
    assert {"hello", "world", "test", "case", "error", "404", "found"} == set(got)
    assert one(spark, text.tokenize, None) == [] and one(spark, text.tokenize, "") == []
    assert text.query_terms("Hello, World! This is a test_case of error 404") == ["hello", "world", "test", "case", "error", "404"]


def test_truncate_splits_no_character(spark):
    for s in ("a" * 150, "é" * 80, "x" * 99 + "é", "日" * 50, "short", "", None, "x" * 98 + "😀"):
        got = one(spark, lambda c: text.truncate_bytes(c, 100), s)
        want = s if s is None else s.encode()[:100].decode("utf-8", "ignore")
        assert got == want


def test_kwic(spark):
    long = "word " * 60 + "needle in the middle " + "tail " * 60
    df = spark.createDataFrame([(1, "short"), (2, "x " * 250), (3, long), (4, "y" * 500 + "needle" + "z" * 500), (5, None), (6, "")], "id int, t string")
    got = {r.id: r.s for r in text.kwic(df, "t", ["needle"], "s").collect()}
    assert got[1] == "short" and got[5] is None and got[6] == ""
    assert got[2].endswith("...") and len(got[2]) == 303
    assert "needle" in got[3] and got[3].startswith("...") and got[3].endswith("...") and len(got[3]) <= 306
    assert "needle" in got[4]  # a window without any space is cut hard


def test_small_functions(spark):
    assert one(spark, text.sanitise_path, "/home/a_b/c.d") == "-home-a-b-c-d"
    r = spark.range(1).select(text.round2(F.lit(0.125)).alias("a"), text.round2(F.lit(0.124)).alias("b")).head()
    assert (r.a, r.b) == (0.13, 0.12)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_dictionary_round_trip(spark):
    rows = [(i, v) for i, v in enumerate(["b", "a", "b", "c", "a", None, "ü"])]
    df = spark.createDataFrame(rows, "pos int, v string")
    d = codes.dictionary(df, "v", "pos")
    assert {(r.idx, r.value) for r in d.collect()} == {(0, "b"), (1, "a"), (2, "c"), (3, "ü")}
    back = codes.decode(codes.encode(df, "v", d, "ref"), "ref", d, "v")
    assert {(r.pos, r.v) for r in back.collect()} == {(p, v or "") for p, v in rows}
    assert codes.dictionary(df.where("false"), "v", "pos").count() == 0


def test_enum_codes(spark):
    df = spark.createDataFrame([("Write",), ("Grep",), ("Other",), (None,)], "t string")
    got = df.select(codes.code(F.col("t"), codes.TOOL_CODES).alias("c")).select("c", codes.uncode(F.col("c"), codes.TOOL_CODES).alias("t")).collect()
    assert [(r.c, r.t) for r in got] == [(0, "Write"), (5, "Grep"), (255, "Unknown"), (255, "Unknown")]


def test_dense_index_numbers_all_rows(spark):
    got = codes.dense_index(spark.range(1000).withColumn("k", F.xxhash64("id")), "n", "k").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000)) and np.all(np.diff([r.k for r in got]) > 0)
