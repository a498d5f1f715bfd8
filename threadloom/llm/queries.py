"""Queries of the problems tagged llm, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm import conversations, knn, leakage, packing, pairs, pii, residue, secrets
from threadloom.tables import load

QUERIES = {
    "p2_found": lambda s, d: secrets.found(load(s, d, "turns"), load(s, d, "tool_calls")),
    "p2_redacted_turns": lambda s, d: secrets.redact(load(s, d, "turns"), "id", "content"),
    "p2_redacted_commands": lambda s, d: secrets.redact(load(s, d, "tool_calls"), "id", "cmd_prefix", cut=True),
    "p3_found": lambda s, d: knn.found(load(s, d, "session_embeddings")),
    "p3_neighbours": lambda s, d: knn.neighbours(load(s, d, "session_embeddings"), k=10, ef=128, ef_build=48, margin=0.15),
    "p3_copies": lambda s, d: knn.copies_of(load(s, d, "session_embeddings")),
    "p4_found": lambda s, d: pii.found(load(s, d, "turns")),
    "p4_sanitised": lambda s, d: pii.sanitise(load(s, d, "turns")),
    "p5_found": lambda s, d: conversations.found(load(s, d, "turns"), load(s, d, "sessions")),
    "p5_conversations": lambda s, d: conversations.conversations(load(s, d, "turns")),
    "p7_found": lambda s, d: pairs.found(load(s, d, "files_index"), load(s, d, "checkpoints")),
    "p7_pairs": lambda s, d: pairs.pairs(load(s, d, "files_index"), load(s, d, "checkpoints"), min_together=2).withColumns({c: F.round(c, 6) for c in ("lift", "llr")}),
    "p7_all_pairs": lambda s, d: pairs.pairs(load(s, d, "files_index"), load(s, d, "checkpoints")).withColumns({c: F.round(c, 6) for c in ("lift", "llr")}),
    "p7_significant": lambda s, d: pairs.significant(load(s, d, "files_index"), load(s, d, "checkpoints")).withColumns({c: F.round(c, 6) for c in ("lift", "llr")}),
    "p7_cache_differences": lambda s, d: pairs.cache_differences(load(s, d, "files_index"), load(s, d, "checkpoints"), load(s, d, "file_cooccurrence")),
    "p8_containers": lambda s, d: packing.pack(load(s, d, "documents"), load(s, d, "pack_limits")),
    "p8_fill": lambda s, d: packing.fill(packing.pack(load(s, d, "documents"), load(s, d, "pack_limits")), load(s, d, "pack_limits")),
    "p9_found": lambda s, d: leakage.found(load(s, d, "documents"), load(s, d, "eval_items")),
    "p9_leaks": lambda s, d: leakage.leaks(load(s, d, "documents"), load(s, d, "eval_items")),
    "p9_clean": lambda s, d: leakage.clean(load(s, d, "documents"), load(s, d, "eval_items")),
    "p10_found": lambda s, d: residue.found(load(s, d, "documents")),
    "p10_reasons": lambda s, d: residue.judge(load(s, d, "documents")),
    "p10_kept": lambda s, d: residue.kept(load(s, d, "documents")),
}

_MEMBERS = r"""
WITH member AS (
  SELECT DISTINCT checkpoint_id AS record, item FROM (
    SELECT checkpoint_id, regexp_replace(split_part(file_path, chr(9), -1), '^\./', '') AS item FROM files_index)
  WHERE checkpoint_id IS NOT NULL AND trim(item) <> ''),
support AS (SELECT item, count(*) AS n FROM member GROUP BY 1),
total AS (SELECT count(DISTINCT id) AS n FROM checkpoints),
pair AS (
  SELECT x.item AS file_a, y.item AS file_b, count(*) AS c
  FROM member x JOIN member y ON x.record = y.record AND x.item < y.item GROUP BY 1, 2)
"""



def _xlogx(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"


def _pairs_sql(where: str = "") -> str:
    return _MEMBERS + f""", x AS (SELECT file_a, file_b, c, a.n AS a, b.n AS b, total.n AS n FROM pair JOIN support a ON a.item = file_a JOIN support b ON b.item = file_b, total{where})
SELECT file_a, file_b, c, a, b, n, round(c * n::DOUBLE / (a * b), 6) AS lift,
  round(greatest(0, 2 * ({" + ".join(map(_xlogx, ["n", "c", "a - c", "b - c", "n - a - b + c"]))} - {" - ".join(map(_xlogx, ["a", "n - a", "b", "n - b"]))})), 6) AS llr FROM x"""

_TALK = r"""
WITH t AS (
  SELECT DISTINCT session_id, turn_index,
         CASE WHEN lower(trim(role)) IN ('human', 'user') THEN 'human' ELSE coalesce(lower(trim(role)), '') END AS role,
         coalesce(content, '') AS content, CASE WHEN turn_index IS NULL THEN ts END AS ts
  FROM turns),
o AS (SELECT *, regexp_matches(content, '[^\s\x{00A0}\x{0085}\x{000B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') AS seen FROM t),
place AS (
  SELECT session_id, count(*) AS n, count(DISTINCT coalesce(turn_index::VARCHAR, ts::VARCHAR)) AS places, count(turn_index) AS indexed,
         min(turn_index) AS low, max(turn_index) AS high, bool_or(seen) AS seen FROM o GROUP BY 1),
v AS (
  SELECT session_id, role, row_number() OVER w AS k, lead(role) OVER w AS after
  FROM o WHERE seen WINDOW w AS (PARTITION BY session_id ORDER BY turn_index, ts)),
talk AS (
  SELECT session_id, bool_or(role = 'human' AND coalesce(after, 'human') = 'human') AS unanswered, bool_or(k = 1 AND role <> 'human') AS answered_first
  FROM v GROUP BY 1)
"""
_BROKEN = """NOT p.seen OR p.n <> p.places OR p.indexed NOT IN (0, p.n)
   OR (p.indexed > 0 AND (p.low <> 0 OR p.high <> p.places - 1)) OR k.unanswered OR k.answered_first"""

_GRAMS = r"""
WITH doc AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
item AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS ws FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(0, len(ws) - 12)) AS i, unnest(list_transform(range(0, len(ws) - 12), lambda k: array_to_string(ws[k + 1 : k + 13], ' '))) AS gram FROM doc WHERE len(ws) >= 13),
ig AS (SELECT item_id, unnest(range(0, len(ws) - 12)) AS j, unnest(list_transform(range(0, len(ws) - 12), lambda k: array_to_string(ws[k + 1 : k + 13], ' '))) AS gram FROM item WHERE len(ws) >= 13),
hit AS (SELECT doc_id, item_id, i, j FROM dg JOIN ig USING (gram)),
run AS (SELECT doc_id, item_id, max(n) + 12 AS longest FROM (SELECT doc_id, item_id, count(*) AS n FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM hit) GROUP BY doc_id, item_id, i - j, island) GROUP BY 1, 2),
place AS (SELECT DISTINCT doc_id, item_id, unnest(range(i, i + 13)) AS k FROM hit)
"""

SQL = {
    "p9_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_leaks": _GRAMS
    + """SELECT r.doc_id, r.item_id, r.longest::INT AS longest, p.n::INT AS n_leaked, len(d.ws)::INT AS n_words
         FROM run r JOIN (SELECT doc_id, item_id, count(*) AS n FROM place GROUP BY 1, 2) p USING (doc_id, item_id) JOIN doc d USING (doc_id)""",
    "p9_clean": _GRAMS
    + r""", bad AS (SELECT doc_id, list(DISTINCT k) AS ks FROM place GROUP BY 1),
         x AS (SELECT d.doc_id, d.text, coalesce(b.ks, []) AS ks, regexp_extract_all(d.text, '[\p{L}\p{N}]+') AS ws, regexp_split_to_array(d.text, '[\p{L}\p{N}]+') AS gaps FROM documents d LEFT JOIN bad b USING (doc_id))
         SELECT doc_id, CASE WHEN len(ks) = 0 THEN text ELSE array_to_string(list_transform(range(0, len(gaps)), lambda k:
             CASE WHEN list_contains(ks, k - 1) AND list_contains(ks, k) THEN '' ELSE gaps[k + 1] END || CASE WHEN k = len(ws) OR list_contains(ks, k) THEN '' ELSE ws[k + 1] END), '') END AS text, len(ks)::INT AS n_removed
         FROM x WHERE NOT coalesce(len(ks) > 0.5 * len(ws), false)""",
    "p5_found": _TALK
    + """SELECT DISTINCT s.id AS session_id
FROM sessions s LEFT JOIN place p ON s.id = p.session_id LEFT JOIN talk k ON s.id = k.session_id
WHERE p.session_id IS NULL OR """
    + _BROKEN,
    # The gap at the first break of the histogram of all gaps, then running sums of the cuts.
    "p5_conversations": _TALK
    + f""", kept AS (SELECT p.session_id FROM place p LEFT JOIN talk k USING (session_id) WHERE NOT ({_BROKEN})),
row AS (SELECT session_id, turn_index IS NULL AS timed, coalesce(turn_index::BIGINT, epoch_us(ts)) AS spot, min(role) AS role, min(content) AS content, min(ts) AS ts FROM
  (SELECT session_id, turn_index, ts, CASE WHEN lower(trim(role)) IN ('human', 'user') THEN 'human' ELSE coalesce(lower(trim(role)), '') END AS role, coalesce(content, '') AS content
   FROM turns WHERE session_id IS NOT NULL) GROUP BY 1, 2, 3),
step AS (SELECT *, lag(role) OVER w AS before_role, trunc((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0)::BIGINT AS gap FROM row WINDOW w AS (PARTITION BY session_id ORDER BY timed, spot NULLS FIRST)),
bin AS (SELECT floor(2 * log2(gap) + 1e-9)::INT AS b, count(*) AS n FROM step WHERE gap > 0 GROUP BY 1),
ends AS (SELECT (SELECT b FROM bin ORDER BY n DESC, b LIMIT 1) AS mode, (SELECT max(b) FROM bin) AS last),
h AS (SELECT x.b::INT AS b, coalesce(bin.n, 0) AS n FROM (SELECT unnest(range(mode + 1, last + 1)) AS b FROM ends) x LEFT JOIN bin USING (b)),
look AS (SELECT h.b, h.n, max(y.n) AS most, arg_max(y.b, (y.n, -y.b)) AS peak, min(y.b) FILTER (y.n > 0) AS next,
  count(*) FILTER (y.n > 0 AND y.b < h.b + 4) AS near FROM h JOIN h y ON y.b > h.b GROUP BY 1, 2),
brk AS (SELECT b, CASE WHEN most >= 20 AND most > 2 * n THEN peak ELSE next END AS stop FROM look WHERE (most >= 20 AND most > 2 * n) OR (n = 0 AND near = 0) ORDER BY b LIMIT 1),
valley AS (SELECT h.* FROM h, brk WHERE h.b >= brk.b AND h.b < brk.stop),
low AS (SELECT min(n) AS n, (SELECT min(b) FROM valley WHERE n = (SELECT min(n) FROM valley)) AS first FROM valley),
lim AS (SELECT coalesce((SELECT pow(2, (low.first + coalesce((SELECT min(b) FROM valley, low WHERE valley.b > low.first AND valley.n <> low.n) - 1, (SELECT max(b) FROM valley)) + 1) / 4.0) FROM low WHERE low.n IS NOT NULL),
  (SELECT quantile_disc(gap, {conversations.GAP_QUANTILE}) FROM step WHERE gap > 0)) AS s)
SELECT session_id, (row_number() OVER w - 1)::BIGINT AS position, sum(CASE WHEN gap > lim.s THEN 1 ELSE 0 END) OVER w::BIGINT AS segment,
  CASE WHEN role <> '' THEN role WHEN before_role = 'human' THEN 'assistant' ELSE 'human' END AS role, content, ts
FROM step SEMI JOIN kept USING (session_id), lim WINDOW w AS (PARTITION BY session_id ORDER BY timed, spot ROWS UNBOUNDED PRECEDING)""",
    "p7_found": _MEMBERS
    + """SELECT file_a, file_b FROM pair JOIN support a ON a.item = file_a JOIN support b ON b.item = file_b, total
         WHERE c >= 5 AND c * total.n >= 3 * a.n * b.n""",
    "p7_pairs": _pairs_sql(" WHERE c >= 2"),
    "p7_all_pairs": _pairs_sql(),
    "p7_significant": f"SELECT * FROM ({_pairs_sql()}) WHERE llr >= 10.83 AND lift > 1",
    "p7_cache_differences": _MEMBERS
    + """, kept AS (
  SELECT least(file_a, file_b) AS file_a, greatest(file_a, file_b) AS file_b, max("count")::BIGINT AS cached, bool_or(file_a > file_b) AS turned
  FROM file_cooccurrence WHERE file_a IS NOT NULL AND file_b IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (
  SELECT file_a, file_b, cached, c AS counted,
         CASE WHEN cached IS NULL THEN 'missing' WHEN c IS NULL THEN 'extra' WHEN turned THEN 'turned'
              WHEN cached < c THEN 'stale' WHEN cached > c THEN 'too high' END AS problem
  FROM pair FULL JOIN kept USING (file_a, file_b) WHERE cached IS NOT NULL OR c > 1)
WHERE problem IS NOT NULL""",
}
