"""Deeply nested records to related flat tables (problem 1).

One pass over each record classifies every object that is an array element with a
bottom-up tree automaton: the state of a node is a function of its label and of the
states of its children, so equal shapes get equal states on every executor. Elements
leave as flat rows that name their parent; a variant (array key and discriminator)
routes each row to a typed subtype table, and the keys all variants share stay
columns of the common table. Nesting has no known depth, which no fixed plan of
explodes can follow; hence one Arrow-batched pass, and no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise

NODE_SCHEMA = (
    "line_id bigint, parent_path string, node_path string, array_key string, position int, depth int, "
    "variant string, shape string, type string, id string, name string, text string, attrs map<string,string>"
)
#: Keys that every variant may have; they stay columns of the common table.
SUPERTYPE = ("type", "id", "name", "text")


def _reject(token: str) -> float:
    raise ValueError(token)


def parse_whole(raw: str | None) -> object:
    """The value of a line that is one JSON text as a whole, else None."""
    if not raw:
        return None
    try:
        return json.loads(raw, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def _decoded(key: str, v: object) -> object:
    """What stands under *key*: JSON text of an input is decoded, a lone content object is an array of one."""
    if key in ("message", "input") and isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        got = parse_whole(v)
        if got is not None:
            v = got
    if key == "content" and isinstance(v, dict):
        v = [v]
    return v


def _state(label: str, parts: object) -> str:
    return hashlib.blake2b(f"{label}{parts}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def _scalar(v: object) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "number"


def _clean(v: object) -> str | None:
    """Scalars as text; lone surrogates, which no table can hold, become '?'."""
    if v is None:
        return None
    return (v if isinstance(v, str) else json.dumps(v)).encode("utf-8", "replace").decode()


def walk(message: object, top: dict | None = None) -> Iterator[dict]:
    """A flat row for each object that is an array element anywhere below *message*.

    The stack is explicit, so nesting is bounded by memory only. Each frame holds the
    open container, the path, the enclosing element and the states its children reached.
    Scalars of the message itself, outside all elements, go to *top* by their path.
    """
    message = _decoded("message", message)
    if not isinstance(message, (dict, list)):
        return
    # frame: value, iterator, path, key of the nearest array, element row or None, child states, owner row, key in owner
    root = [message, None, "", "", None, [], None, ""]
    stack = [root]
    while stack:
        f = stack[-1]
        value, it = f[0], f[1]
        if it is None:
            it = f[1] = iter(value.items() if isinstance(value, dict) else enumerate(value))
        step = next(it, None)
        if step is None:
            stack.pop()
            state = _state("o" if isinstance(value, dict) else "a", sorted(f[5]) if isinstance(value, dict) else sorted({s for _, s in f[5]}))
            row = f[4]
            if row is not None:
                row["shape"] = state
                kind = row["type"]
                row["variant"] = f"{row['array_key'] or 'message'}:{kind}" if kind else row["array_key"] or "message"
                yield row
            if stack:
                stack[-1][5].append((f[7], state))
            continue
        key, v = step
        if isinstance(value, dict):
            v = _decoded(key, v)
            path = f"{f[2]}.{key}" if f[2] else key
            near, own = key, f[4] if f[4] is not None else f[6]
            label = key
        else:
            path, near, own, label = f"{f[2]}[{key}]", f[3], f[6] if f[4] is None else f[4], "[]"
        if isinstance(v, (dict, list)):
            row = None
            if isinstance(v, dict) and isinstance(value, list):
                row = {"parent_path": own["node_path"] if own else "", "node_path": path, "array_key": near, "position": key, "depth": own["depth"] + 1 if own else 1, "attrs": {}, "kinds": {}}
                row |= {k: _clean(v[k]) if isinstance(v.get(k), (str, int, float)) else None for k in SUPERTYPE}
            stack.append([v, None, path, near, row, [], own, label])
        else:
            f[5].append((label, _scalar(v)))
            if own:
                field = path[len(own["node_path"]) + 1 :] if isinstance(value, dict) else path[len(own["node_path"]) :].lstrip(".")
                own["attrs"][field], own["kinds"][field] = _clean(v), _scalar(v)
            elif top is not None:
                top[path] = _clean(v)


def shred(lines: DataFrame, id_col: str = "line_id", raw_col: str = "raw_line", with_kinds: bool = False) -> DataFrame:
    """The common table: one row per array-element object, each naming its parent.

    Lines that are not as a whole one JSON object (torn, foreign, null, empty, an array
    or a bare value, NaN or Infinity) give no rows, nor do messages without such
    elements. Lines delivered twice count under each id. Extra columns are ignored.
    *with_kinds* adds the kind of each value of attrs: text, number, bool or null.
    """
    schema = NODE_SCHEMA + (", kinds map<string,string>" if with_kinds else "")
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for line_id, raw in zip(b.iloc[:, 0], b.iloc[:, 1]):
                record = parse_whole(raw)
                if isinstance(record, dict) and "message" in record:
                    for r in walk(record["message"]):
                        r["line_id"] = line_id
                        r["node_path"], r["parent_path"], r["array_key"] = (_clean(r[k]) for k in ("node_path", "parent_path", "array_key"))
                        r["variant"] = _clean(r["variant"])
                        r["attrs"] = {_clean(k): v for k, v in r["attrs"].items()}
                        if with_kinds:
                            r["kinds"] = {_clean(k): v for k, v in r["kinds"].items()}
                        rows.append(r)
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    return lines.select(F.col(id_col).alias("line_id"), F.col(raw_col).alias("raw_line")).where("line_id is not null").mapInPandas(run, schema)


MESSAGE_SCHEMA = "line_id bigint, session_id string, line_type string, role string, message_id string, content_kind string, n_elements int, content string, attrs map<string,string>"


def _own_fields(record: dict) -> dict[str, str | None]:
    """Every scalar of a line that stands in no element, by its path; those of the message begin with 'message'."""
    out: dict[str, str | None] = {}
    stack = [(k, v) for k, v in reversed(record.items()) if k != "message"]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[{i}]", x) for i, x in reversed([*enumerate(v)])]
        else:
            out[path] = _clean(v)
    if "message" in record:
        m = _decoded("message", record["message"])
        if isinstance(m, (dict, list)):
            top: dict[str, str | None] = {}
            for _ in walk(m, top):
                pass
            out |= {f"message{k}" if k.startswith("[") and isinstance(m, list) else f"message.{k}": v for k, v in top.items()}
        else:
            out["message"] = _clean(m)
    return {_clean(k): v for k, v in out.items()}


def messages(lines: DataFrame) -> DataFrame:
    """The top table: one row per line that is a JSON object, the parent of its elements.

    ``content`` is a content given as text; ``attrs`` has every value of the line that stands in no element.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for line_id, raw in zip(b["line_id"], b["raw_line"]):
                r = parse_whole(raw)
                if not isinstance(r, dict):
                    continue
                m = _decoded("message", r.get("message"))
                body = _decoded("content", m.get("content")) if isinstance(m, dict) else None
                text = [_clean(x) if isinstance(x, str) else None for x in (r.get("sessionId"), r.get("type"), *((m.get("role"), m.get("id")) if isinstance(m, dict) else (None, None)))]
                kind = "blocks" if isinstance(body, list) else "text" if isinstance(body, str) else "none"
                rows.append((line_id, *text, kind, len(body) if isinstance(body, list) else 0, _clean(body) if isinstance(body, str) else None, _own_fields(r)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE_SCHEMA.split(", ")])

    return lines.select("line_id", "raw_line").where("line_id is not null").mapInPandas(run, MESSAGE_SCHEMA)


def shapes(nodes: DataFrame) -> DataFrame:
    """The variants met: how many rows and automaton states each has, and all its fields."""
    counts = nodes.groupBy("variant").agg(F.count("*").alias("n_rows"), F.count_distinct("shape").alias("n_shapes"), F.max("depth").alias("max_depth"))
    fields = (
        nodes.select("variant", F.explode(F.map_keys("attrs")).alias("field"))
        .groupBy("variant", F.regexp_replace("field", r"\[\d+\]", "[]").alias("field"))
        .count()
        .groupBy("variant")
        .agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    )
    return counts.join(fields, "variant", "left").select("variant", "n_rows", "n_shapes", "max_depth", F.coalesce("fields", F.lit("")).alias("fields"))


def subtype(nodes: DataFrame, variant: str, fields: dict[str, str]) -> DataFrame:
    """The typed table of one variant: parent links, supertype keys and *fields* cast to their types."""
    typed = [F.col("attrs")[f].try_cast(t).alias(f.replace(".", "_")) for f, t in fields.items()]
    return nodes.where(F.col("variant") == variant).select("line_id", "parent_path", "node_path", "position", "id", "name", *typed)


def _plain(field: Column) -> Column:
    """A field without positions: each place of an array counts as the same field."""
    return F.regexp_replace(field, r"\[\d+\]", "[]")


def routes(nodes: DataFrame) -> DataFrame:
    """(variant, shape, n_rows, fields): the routing table; *nodes* come with kinds.

    An automaton state fixes the kind of each field, so a row's variant and state tell
    which columns of the variant's typed table (:func:`typed`) hold its values.
    """
    key = ["variant", "shape"]
    counts = nodes.groupBy(*key).agg(F.count("*").alias("n_rows"))
    met = nodes.select(*key, F.explode("kinds").alias("f", "kind")).select(*key, F.concat_ws(":", _plain(F.col("f")), "kind").alias("f")).distinct()
    fields = met.groupBy(*key).agg(F.array_sort(F.collect_list("f")).alias("fields"))
    return counts.join(fields, key, "left").select(*key, "n_rows", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def _listed(field: str, kind: str, to: str) -> Column:
    """The values of a field below an array in their order, null if there are none; nulls keep their place."""
    here = F.filter(F.map_entries("attrs"), lambda e: (_plain(e["key"]) == field) & F.col("kinds")[e["key"]].isin(kind, "null"))
    return F.when(F.size(here) > 0, F.transform(here, lambda e: e["value"].try_cast(to)))


def typed(nodes: DataFrame, variant: str) -> DataFrame:
    """The typed table of one variant with every field it has; *nodes* come with kinds.

    A column for each field and kind met in any state: text, boolean, bigint (double if
    a number has a fraction, text if a number fits neither). A field of one kind keeps
    its name, one of several has the kind in it; a field below an array gives an array.
    ``shape`` is the state that routes a row to its columns. What comes to the driver
    are the fields and kinds, not their values.
    """
    keys = ["line_id", "parent_path", "node_path", "position", "shape"]
    mine = materialise(nodes.where(F.col("variant") == variant).select(*keys, "attrs", "kinds"), "variant")
    v = F.col("value")
    whole = v.rlike(r"^-?\d+$")
    met = (
        mine.select("attrs", F.explode("kinds").alias("f", "kind"))
        .select(_plain(F.col("f")).alias("field"), "kind", F.col("attrs")[F.col("f")].alias("value"))
        .groupBy("field", "kind")
        .agg(F.min(whole & v.try_cast("bigint").isNotNull()).alias("long"), F.max(whole & (F.length(v) > 15)).alias("wide"))
        .orderBy("field", "kind")
        .collect()
    )
    kinds: dict[str, list] = {}
    for r in met:
        kinds.setdefault(r["field"], []).append(r)
    used, out = set(keys), []
    for field, found_kinds in kinds.items():
        valued = [r for r in found_kinds if r["kind"] != "null"] or found_kinds
        for r in valued:
            to = {"bool": "boolean", "number": "bigint" if r["long"] else "string" if r["wide"] else "double"}.get(r["kind"], "string")
            name = re.sub(r"\W+", "_", field.replace("[]", "_list")).strip("_") or "field"
            name = base = name if len(valued) == 1 else f"{name}_{r['kind']}"
            n = 1
            while name.lower() in used:
                n, name = n + 1, f"{base}_{n + 1}"
            used.add(name.lower())
            if "[]" in field:
                out.append(_listed(field, r["kind"], to).alias(name))
            else:
                out.append(F.when(F.col("kinds")[field] == r["kind"], F.col("attrs")[field].try_cast(to)).alias(name))
    return mine.select(*keys, *out)


def found(lines: DataFrame) -> DataFrame:
    """(line_id, parent_path, node_path), distinct: a row delivered twice counts once."""
    return shred(lines).select("line_id", "parent_path", "node_path").distinct()
