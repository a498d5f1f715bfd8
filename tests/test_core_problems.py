"""Problems 1 and 6 on small fixtures."""

import json
import random

import pytest

from threadloom.operators import hierarchy, nested


def nodes(spark, *lines):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "line_id bigint, raw_line string, parent_path string")
    return {(r.line_id, r.parent_path, r.node_path) for r in nested.found(df).collect()}


def test_nested_paths(spark):
    deep = {"message": {"content": [{"type": "text"}, {"input": {"edits": [{"a": 1}, {"b": [{"c": 2}, 3]}]}}]}}
    as_text = {"message": json.dumps({"content": {"input": json.dumps({"todos": [{"x": 1}]})}})}
    assert nodes(spark, json.dumps(deep), json.dumps(as_text)) == {
        (0, "", "content[0]"), (0, "", "content[1]"), (0, "content[1]", "content[1].input.edits[0]"), (0, "content[1]", "content[1].input.edits[1]"),
        (0, "content[1].input.edits[1]", "content[1].input.edits[1].b[0]"), (1, "", "content[0]"), (1, "content[0]", "content[0].input.todos[0]"),
    }


def test_nested_edges(spark):
    assert nodes(spark, None, "", "{", "[]", "null", '{"message": null}', '{"message": "plain"}', '{"message": {"content": "[{}]"}}', '{"a": NaN, "message": {"content": [{}]}}', '{"message": {"content": []}} x') == set()
    assert nodes(spark, '{"message": [[{"a": [{}]}], {}]}') == {(0, "", "[0][0]"), (0, "[0][0]", "[0][0].a[0]"), (0, "", "[1]")}
    assert nodes(spark, '{"message": {"k.x": [{"\\ud800": 1}]}}') == {(0, "", "k.x[0]")}
    assert nodes(spark, '{"message": {"content": ' + "[" * 5000 + "]" * 5000 + "}}") == set()
    assert spark.createDataFrame([], "line_id bigint, raw_line string").transform(nested.found).count() == 0


def test_equal_shapes_share_a_state(spark):
    lines = ['{"message": {"content": [{"type": "t", "x": 1}, {"x": 2, "type": "u"}, {"type": "t", "x": "s"}]}}']
    df = spark.createDataFrame([(0, lines[0])], "line_id bigint, raw_line string")
    got = {r.node_path: r for r in nested.shred(df).collect()}
    assert got["content[0]"].shape == got["content[1]"].shape != got["content[2]"].shape
    assert got["content[0]"].variant == "content:t"
    typed = nested.subtype(nested.shred(df), "content:t", {"x": "bigint"})
    assert sorted((r.node_path, r.x) for r in typed.collect()) == [("content[0]", 1), ("content[2]", None)]
    v = {r.variant: r for r in nested.shapes(nested.shred(df)).collect()}
    assert v["content:t"].n_rows == 2 and v["content:t"].fields == "type,x"
    assert nested.messages(df).head().n_elements == 3


def forest(links):
    out = set()
    for i, p in links.items():
        if not p:
            continue
        cur, seen, depth = i, {i}, 0
        while links.get(cur) in links and links.get(cur):
            cur, depth = links[cur], depth + 1
            if cur in seen:
                cur, depth = "", -1
                break
            seen.add(cur)
        out.add((i, cur, depth))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"N{i:03d}" for i in range(150)]
    links = {x: rng.choice([None, "GONE", *ids[max(0, i - 3) : i + 1], *ids[max(0, i - 3) : i + 1], rng.choice(ids)]) for i, x in enumerate(ids)}
    rows = [(f" {x.lower()}" if rng.random() < 0.3 else x, (p.lower() + " ") if p and rng.random() < 0.3 else p, "x") for x, p in links.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, "N001", "x"), ("N000", " ", "x")], "id string, parent_session_id string, root_id string")
    assert {tuple(r) for r in hierarchy.found(df).collect()} == forest(links)


def test_hierarchy_paths(spark):
    chain = [("A", None), ("B", "A"), ("C", "B"), ("D", "B"), ("X", "Y"), ("Y", "X"), ("Z", "X"), ("S", "S")]
    df = spark.createDataFrame(chain, "id string, parent_session_id string")
    got = {r.session_id: (r.root_id, r.depth, r.path, r.n_descendants) for r in hierarchy.hierarchy(df).collect()}
    assert got["A"] == ("A", 0, "A", 3) and got["D"] == ("A", 2, "A/B/D", 0) and got["B"][3] == 2
    assert all(got[x] == ("", -1, None, 0) for x in "XYZS")
    paths = hierarchy.resolve(hierarchy.parent_pointers(df), with_path=True)
    assert {tuple(r) for r in hierarchy.descendants(paths).collect()} == {("A", "B", 1), ("A", "C", 2), ("A", "D", 2), ("B", "C", 1), ("B", "D", 1)}
    at = {r.session_id: (r.first, r.last) for r in hierarchy.intervals(df).collect()}
    below = {(x, y) for x in at for y in at if at[x][0] < at[y][0] <= at[x][1]}
    assert below == {("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("B", "D")} and not at.keys() & set("XYZS")


def test_hierarchy_empty_and_long_chain(spark):
    schema = "id string, parent_session_id string"
    assert hierarchy.found(spark.createDataFrame([], schema)).count() == 0
    long = [(f"N{i}", f"N{i - 1}" if i else None) for i in range(300)]
    got = {r.session_id: r.depth for r in hierarchy.found(spark.createDataFrame(long, schema)).collect()}
    assert got == {f"N{i}": i for i in range(1, 300)}


def test_no_field_is_lost(spark):
    block = {"type": "t", "x": 1, "y": {"z": [1.5, 2]}, "ok": True, "n": None, "list": ["b", "a"]}
    lines = [{"uuid": "u", "snap": {"k": [7]}, "message": {"role": "user", "content": "plain"}}, {"message": {"usage": {"in": 3}, "content": ["bare", block, {"type": "t", "x": "s", "more": 10**20}]}}, {"message": "word"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line_id bigint, raw_line string")
    top = {r.line_id: r for r in nested.messages(df).collect()}
    assert top[0].content == "plain" and top[0].attrs == {"uuid": "u", "snap.k[0]": "7", "message.role": "user", "message.content": "plain"}
    assert top[1].content is None and top[1].attrs == {"message.usage.in": "3", "message.content[0]": "bare"} and top[2].attrs == {"message": "word"}
    nodes = nested.shred(df, with_kinds=True)
    a, b = sorted(nested.typed(nodes, "content:t").collect(), key=lambda r: r.node_path)
    assert (a.x_number, a.x_text, a.y_z_list, a.ok, a.n, a["list_list"], a.more) == (1, None, [1.5, 2.0], True, None, ["b", "a"], None)
    assert (b.x_number, b.x_text, b.y_z_list, b.ok, b.more) == (None, "s", None, None, "1" + "0" * 20)
    route = {r.shape: r.fields for r in nested.routes(nodes).collect()}
    assert "x:number" in route[a.shape] and "x:text" in route[b.shape]


def test_every_variant_of_the_data_has_its_table(spark, data):
    import __spark_entry__ as entry
    from threadloom.queries.hierarchies import TYPED

    q = entry.queries()
    assert {r.variant for r in q["p1_routes"](spark, data).collect()} <= set(TYPED.values())
    assert {"old_string", "new_string"} <= set(q["p1_edits"](spark, data).columns) and "attrs" in q["p1_elements"](spark, data).columns
