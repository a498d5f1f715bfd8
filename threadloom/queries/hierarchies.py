"""Queries of problems 1 and 6."""

from __future__ import annotations

from threadloom.operators import hierarchy, nested
from threadloom.tables import load

#: The typed table of each variant the transcripts have; p1_routes lists the variants and states met.
TYPED = {
    "p1_tool_uses": "content:tool_use",
    "p1_tool_results": "content:tool_result",
    "p1_texts": "content:text",
    "p1_thinking": "content:thinking",
    "p1_images": "content:image",
} | {f"p1_{v}": v for v in ("edits", "todos", "questions", "options", "steps", "after", "parts", "tags")}


def _typed(variant: str):
    return lambda s, d: nested.typed(nested.shred(load(s, d, "transcript_lines"), with_kinds=True), variant)


QUERIES = {
    "p1_found": lambda s, d: nested.found(load(s, d, "transcript_lines")),
    "p1_messages": lambda s, d: nested.messages(load(s, d, "transcript_lines")),
    "p1_elements": lambda s, d: nested.shred(load(s, d, "transcript_lines")),
    "p1_variants": lambda s, d: nested.shapes(nested.shred(load(s, d, "transcript_lines"))),
    "p1_routes": lambda s, d: nested.routes(nested.shred(load(s, d, "transcript_lines"), with_kinds=True)),
    **{name: _typed(variant) for name, variant in TYPED.items()},
    "p6_found": lambda s, d: hierarchy.found(load(s, d, "sessions")),
    "p6_hierarchy": lambda s, d: hierarchy.hierarchy(load(s, d, "sessions")),
    "p6_intervals": lambda s, d: hierarchy.intervals(load(s, d, "sessions")),
    "p6_descendants": lambda s, d: hierarchy.descendants(hierarchy.resolve(hierarchy.parent_pointers(load(s, d, "sessions")), with_path=True)),
}

_TREE = """
WITH RECURSIVE named AS (
  SELECT upper(trim(id)) AS id, max(nullif(upper(trim(parent_session_id)), '')) AS named
  FROM sessions WHERE nullif(trim(id), '') IS NOT NULL GROUP BY 1),
node AS (SELECT n.id, n.named IS NOT NULL AS has_link, p.id AS parent FROM named n LEFT JOIN named p ON n.named = p.id),
tree AS (
  SELECT id, id AS root_id, 0 AS depth, id AS path FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM node n JOIN tree t ON n.parent = t.id)
"""

# Each step opens the values of the last one: those of an object by key, those of an array by place. A message or
# input given as JSON text is decoded, a lone object as content is an array of one. 'own' is the element a value stands in.
_NODES = r"""
WITH RECURSIVE line AS (SELECT line_id, CASE WHEN json_valid(raw_line) THEN CASE WHEN json_type(raw_line) = 'OBJECT' THEN json_extract(raw_line, '$.message') END END AS m FROM transcript_lines WHERE line_id IS NOT NULL),
node AS (
  SELECT line_id, '' AS path, '' AS own, false AS element, CASE WHEN json_type(m) = 'VARCHAR' AND json_valid(m ->> '$') AND regexp_matches(m ->> '$', '^\s*[\[{]') THEN TRY_CAST(m ->> '$' AS JSON) ELSE m END AS v FROM line WHERE m IS NOT NULL
  UNION ALL
  SELECT line_id, path, own, element, CASE WHEN decoded AND key = 'content' AND json_type(w) = 'OBJECT' THEN json_array(w) ELSE w END AS v FROM (
    SELECT line_id, key, key IS NOT NULL AS decoded, CASE WHEN key IS NULL THEN path || '[' || place || ']' WHEN path = '' THEN key ELSE path || '.' || key END AS path,
      CASE WHEN was THEN path ELSE own END AS own, key IS NULL AND json_type(x) = 'OBJECT' AS element,
      CASE WHEN key IN ('input', 'message') AND json_type(x) = 'VARCHAR' AND json_valid(x ->> '$') AND regexp_matches(x ->> '$', '^\s*[\[{]') THEN TRY_CAST(x ->> '$' AS JSON) ELSE x END AS w
    FROM (
      SELECT line_id, path, own, element AS was, NULL AS key, place, json_extract(v, '$[' || place || ']') AS x FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS place FROM node WHERE json_type(v) = 'ARRAY')
      UNION ALL
      SELECT line_id, path, own, element, key, NULL, json_extract(v, '$."' || key || '"') FROM (SELECT *, unnest(json_keys(v)) AS key FROM node WHERE json_type(v) = 'OBJECT')))
  WHERE json_type(w) IN ('OBJECT', 'ARRAY'))
"""

SQL = {
    "p1_found": _NODES + "SELECT DISTINCT line_id, own AS parent_path, path AS node_path FROM node WHERE element",
    "p6_found": _TREE
    + """SELECT n.id AS session_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth
         FROM node n LEFT JOIN tree t ON n.id = t.id WHERE n.has_link""",
    "p6_hierarchy": _TREE
    + """, below AS (SELECT u.anc AS id, count(*) AS n FROM (SELECT id, unnest(string_split(path, '/')) AS anc FROM tree) u WHERE u.anc <> u.id GROUP BY 1)
         SELECT n.id AS session_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth, t.path,
                coalesce(b.n, 0)::BIGINT AS n_descendants
         FROM node n LEFT JOIN tree t ON n.id = t.id LEFT JOIN below b ON b.id = n.id""",
    "p6_intervals": _TREE
    + """, below AS (SELECT u.anc AS id, count(*) AS n FROM (SELECT id, unnest(string_split(path, '/')) AS anc FROM tree) u WHERE u.anc <> u.id GROUP BY 1)
         SELECT t.id AS session_id, root_id, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS first, row_number() OVER (ORDER BY string_split(path, '/')) - 1 + coalesce(b.n, 0) AS last
         FROM tree t LEFT JOIN below b ON b.id = t.id""",
    "p6_descendants": _TREE
    + """SELECT anc AS ancestor_id, id AS descendant_id, (depth - place + 1)::INTEGER AS distance
         FROM (SELECT id, depth, unnest(string_split(path, '/')) AS anc, generate_subscripts(string_split(path, '/'), 1) AS place FROM tree) WHERE place <= depth""",
}
