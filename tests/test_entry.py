"""The driver's contract."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_llm(monkeypatch):
    monkeypatch.setitem(sys.modules, "threadloom.llm", None)
    monkeypatch.delitem(sys.modules, "threadloom.llm.queries", raising=False)
    names = set(importlib.reload(entry).queries())
    assert "p1_found" in names and "p2_found" not in names
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["bm25_turns", "session_facets", "parse_transcript_turns", "sql_rollup", "p1_variants", "p6_hierarchy"])
def test_some_queries(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.count() > 0


def test_every_descendant_is_a_query(spark, data):
    q = entry.queries()
    below = {}
    for r in q["p6_descendants"](spark, data).collect():
        below.setdefault(r.ancestor_id, set()).add(r.descendant_id)
    assert below and {k: len(v) for k, v in below.items()} == {r.session_id: r.n_descendants for r in q["p6_hierarchy"](spark, data).collect() if r.n_descendants}
