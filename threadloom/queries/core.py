"""Queries of the core operators over whole tables, and their SQL."""

from __future__ import annotations

from hashlib import sha1
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import durable
from threadloom.functions import codes
from threadloom.functions.text import SUFFIXES, STOPWORDS, iso_utc, kwic, query_terms, sanitise_path, tokenize
from threadloom.functions.vectors import cosine, literal
from threadloom.operators import retrieval
from threadloom.operators import sessions as ops
from threadloom.plans import embed, index, search, transport
from threadloom.plans.store import Store
from threadloom.sources import scan, transcripts
from threadloom.tables import load

QUERY = "retry queue timeout checkpoint"
TERMS = query_terms(QUERY)
PATH = r"auth.*\.go$"
ROOT = "services/"
EMBEDDER = embed.HashingEmbedder()


def rows(name: str, *columns: str):
    """A table as it is, for operators that fold repeated rows themselves; with *columns*, these alone and distinct."""
    if not columns:
        return lambda s, d: load(s, d, name)
    return lambda s, d: load(s, d, name).select(*columns).distinct()


turns, calls, sessions, checkpoints, files = (rows(n) for n in ("turns", "tool_calls", "sessions", "checkpoints", "files_index"))
# Rows whose number counts: only the columns in use are read and compared, ids among them.
said = rows("turns", "id", "session_id", "turn_index", "content")
placed = rows("turns", "id", "session_id", "turn_index", "ts", "role")
called = rows("tool_calls", "id", "session_id", "tool", "path")
touched = rows("files_index", "checkpoint_id", "session_id", "file_path", "change_type")


def texts(s: SparkSession, d: str) -> DataFrame:
    return ops.session_text(turns(s, d))


def hits(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_scan(said(s, d), "id", "content", TERMS, "session_id", "turn_index").orderBy(F.desc("score"), "id").limit(retrieval.CANDIDATES)


def text_scores(s: SparkSession, d: str) -> DataFrame:
    return retrieval.best_turn(hits(s, d)).select(F.col("session_id").alias("id"), "score")


def tfidf_matrix(s: SparkSession, d: str) -> DataFrame:
    return retrieval.tfidf(rows("turns", "id", "session_id", "turn_index", "ts", "content")(s, d), "session_id", "content")


def tfidf_scores(s: SparkSession, d: str) -> DataFrame:
    return retrieval.tfidf_search(tfidf_matrix(s, d), TERMS)


def usable_vectors(s: SparkSession, d: str, model: str) -> DataFrame:
    """(session_id, embedding): the latest usable vector of each session: of the model's most frequent length, finite, not all zero."""
    v = load(s, d, "session_embeddings").where((F.col("model") == model) & F.col("session_id").isNotNull() & (F.size("embedding") > 0))
    dim = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n").scalar()
    good = v.where((F.size("embedding") == dim) & F.expr("exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x))"))
    return good.groupBy("session_id").agg(F.max_by("embedding", F.struct("generated_at", "embedding")).alias("embedding"))


def vector_scores(s: SparkSession, d: str, model: str) -> DataFrame:
    """Scores against the vector of the first session, which stands in for a query's."""
    v = durable.materialise(usable_vectors(s, d, model), "vectors")
    first = v.orderBy("session_id").limit(1).collect()
    return retrieval.vector_search(v, "session_id", "embedding", list(first[0].embedding) if first else [])


def latent_scores(s: SparkSession, d: str) -> DataFrame:
    return vector_scores(s, d, "lsa")


def dense_scores(s: SparkSession, d: str) -> DataFrame:
    return vector_scores(s, d, "nomic")


def facets(s: SparkSession, d: str) -> DataFrame:
    return ops.session_facets(sessions(s, d), turns(s, d), calls(s, d), files(s, d), checkpoints(s, d))


def hybrid(s: SparkSession, d: str, latent, filters: search.Filters | None = None) -> DataFrame:
    return search.hybrid(turns(s, d), hits(s, d), latent(s, d), dense_scores(s, d), facets(s, d), files(s, d), QUERY, filters)


def fused(s: SparkSession, d: str, latent, with_dense: bool) -> DataFrame:
    f = retrieval.fuse(text_scores(s, d), latent(s, d), dense_scores(s, d) if with_dense else None)
    return f.select("id", F.round(F.col("score") + 1e-9, 5).alias("score"))


def truth(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """What the index of the given tables is derived from."""
    return {n: load(s, d, n) for n in ("sessions", "turns", "tool_calls", "checkpoints", "files_index")}


def index_root(s: SparkSession, d: str) -> str:
    return f"{durable.shared_dir(s)}/threadloom-index-{s.sparkContext.applicationId}-{sha1(d.encode()).hexdigest()[:16]}"


def opened(s: SparkSession, d: str) -> index.Index:
    """The stored index of the given tables, built by the first query of a session that needs it."""
    return index.open_index(s, index_root(s, d), lambda: truth(s, d), embedder=EMBEDDER)


def index_build(s: SparkSession, d: str) -> DataFrame:
    counts = index.write_index(s, truth(s, d), index_root(s, d), embedder=EMBEDDER)
    return s.createDataFrame([*counts.items()], "key string, n bigint")


def index_hits(s: SparkSession, d: str) -> DataFrame:
    ix = opened(s, d)
    return retrieval.bm25_stored(ix.postings(TERMS), ix.number("turn_count"), ix.number("token_count"))


def index_search(s: SparkSession, d: str, query: str = QUERY, filters: search.Filters | None = None) -> DataFrame:
    return search.search(s, index_root(s, d), query, filters, embedder=EMBEDDER, source=lambda: truth(s, d))


def drill_down(s: SparkSession, d: str) -> DataFrame:
    """A page of the last session with its calls and files."""
    last = sessions(s, d).agg(F.max("id")).head()[0]
    placed_turns = rows("turns", "id", "session_id", "turn_index", "role", "content", "ts")(s, d)
    return ops.drill_down(sessions(s, d), placed_turns, calls(s, d), files(s, d), last, full=True, offset=1, limit=3)


def round_trip(s: SparkSession, d: str) -> DataFrame:
    """(table, n) of a store that imported what another one, filled from the given tables, exported."""
    root = f"{durable.shared_dir(s)}/threadloom-trip-{uuid4().hex}"
    mine, theirs = Store(s, f"{root}/mine"), Store(s, f"{root}/theirs")
    for name in ("sessions", "turns", "tool_calls", "checkpoints"):
        mine.append(name, load(s, d, name))
    f = touched(s, d).select("checkpoint_id", "file_path", "change_type").distinct()
    mine.append("files_touched", f.select(F.sha2(F.to_json(F.struct(*f.columns)), 256).alias("id"), *f.columns))
    mine.append("checkpoint_sessions", ops.links(files(s, d)))
    transport.export_delta(mine, f"{root}/out", "first")
    transport.import_batches(theirs, f"{root}/out")
    return s.createDataFrame([(n, theirs.table(n).count()) for n in transport.PARTS] + [("unexported", theirs.unexported().count())], "table string, n bigint")


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").head()
    return retrieval.vector_search(e, "vec_id", "embedding", list(q[0]), 20)


def dense_by_label(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    q = list(e.where("vec_id = 0").select("embedding").head()[0])
    scored = e.select("label", F.round(cosine(F.col("embedding"), literal(q)), 6).alias("score")).where("score > 0")
    return scored.groupBy("label").agg(F.max("score").alias("best"), F.count("*").alias("n"))


def dict_round_trip(s: SparkSession, d: str) -> DataFrame:
    f = touched(s, d).where("file_path is not null")
    words = codes.dictionary(f, "file_path", "checkpoint_id")
    coded = codes.encode(f.select("checkpoint_id", "session_id", "file_path"), "file_path", words, "ref")
    return codes.decode(coded, "ref", words, "file_path").groupBy("file_path").agg(F.count("*").alias("n"))


def upsert_state(s: SparkSession, d: str) -> DataFrame:
    c = checkpoints(s, d).where("ts is not null").groupBy("git_branch", "ts").agg(F.max("git_sha").alias("git_sha"))
    cut = F.expr("timestamp_ntz'2025-06-01 00:00:00'")
    keyed = c.groupBy("git_branch", (F.col("ts") < cut).alias("old")).agg(F.max_by(F.struct("ts", "git_sha"), F.struct("ts", "git_sha")).alias("r")).select("git_branch", "old", "r.ts", "r.git_sha")
    return ops.upsert(keyed.where("old").drop("old"), keyed.where("not old").drop("old"), "git_branch", "ts")


def union_merge(s: SparkSession, d: str) -> DataFrame:
    """Two members' sessions that overlap, merged."""
    x = sessions(s, d).select("id", "user_email", "branch").distinct()
    mine, theirs = x.where("branch like 'fix/%'"), x.where("branch is null or branch not like 'fix/c%'")
    return transport.merge_team({"sessions": mine}, [{"sessions": theirs}])["sessions"]


def export_held(s: SparkSession, d: str) -> DataFrame:
    links, held = transport.delta(checkpoints(s, d).where("not exported"), ops.links(files(s, d)), sessions(s, d))
    return links.groupBy("checkpoint_id").agg(F.count("*").alias("n_sessions"))


def export_counters(s: SparkSession, d: str) -> DataFrame:
    """How many rows a batch of the unexported checkpoints holds."""
    cps = checkpoints(s, d).where("not exported").select("id").distinct()
    links, held = transport.delta(cps, ops.links(files(s, d)), sessions(s, d).select("id").distinct())
    mine = placed(s, d).join(held.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return transport.counters({"checkpoints": cps, "sessions": held, "checkpoint_sessions": links, "turns": mine.select("id").distinct()})


def facet_patch(s: SparkSession, d: str) -> DataFrame:
    """Facets with the branch and author that the sessions table states in their place."""
    stated = sessions(s, d).select(F.col("id").alias("session_id"), F.col("branch").alias("git_branch"), F.upper("user_email").alias("user_email"))
    return ops.patch(facets(s, d), stated, "session_id").select("session_id", "git_branch", "user_email", "turn_count")


def import_new(s: SparkSession, d: str) -> DataFrame:
    """Turns of sessions that a store of the sessions before June lacks: the anti join of an import."""
    have = sessions(s, d).where("captured_at < timestamp_ntz'2025-06-01 00:00:00'").select(F.col("id").alias("session_id"))
    return placed(s, d).join(have, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n_turns"))


def name_status(s: SparkSession, d: str) -> DataFrame:
    lines = touched(s, d).where("file_path is not null and change_type is not null").select(F.concat("change_type", F.lit("\t"), "file_path").alias("value"))
    return scan.name_status(lines).groupBy("change_type").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_paths"))


def parsed_turns(s: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(transcripts.records(load(s, d, "transcript_lines"))).drop("ts")


def json_fallback(s: SparkSession, d: str) -> DataFrame:
    """The path of each tool use: file_path, else path."""
    b = transcripts._tool_blocks(transcripts.records(load(s, d, "transcript_lines")))
    return b.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("path") != "").alias("n_path"))


QUERIES = {
    "tokenize_terms": lambda s, d: said(s, d).select("id", F.posexplode(tokenize(F.col("content"))).alias("pos", "term")),
    "term_doc_freq": lambda s, d: retrieval.term_counts(load(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    "postings": lambda s, d: retrieval.postings(said(s, d))[0],
    "bm25_turns": lambda s, d: hits(s, d),
    "bm25_index_turns": lambda s, d: retrieval.bm25(*retrieval.postings(said(s, d)), TERMS),
    "bm25_best_turn": lambda s, d: retrieval.best_turn(hits(s, d)),
    "bm25_documents": lambda s, d: retrieval.bm25_scan(load(s, d, "documents"), "doc_id", "text", TERMS).orderBy(F.desc("score"), "id").limit(20),
    "tfidf_matrix": lambda s, d: tfidf_matrix(s, d).select("id", "term", F.round("w", 6).alias("w")),
    "tfidf_search": tfidf_scores,
    "index_build": index_build,
    "index_postings": lambda s, d: opened(s, d).table("postings").drop("bucket"),
    "index_bm25": index_hits,
    "index_facets": lambda s, d: opened(s, d).table("session_facets"),
    "index_files": lambda s, d: opened(s, d).table("files_index"),
    "index_edges": lambda s, d: opened(s, d).table("file_cooccurrence"),
    "index_search_document": lambda s, d: search.result_document(index_search(s, d), QUERY),
    "index_filter_search": lambda s, d: index_search(s, d, "", search.Filters(file=PATH, actor="human")).drop("snippet"),
    "lsa_vectors": lambda s, d: opened(s, d).vectors(index.LATENT),
    "lsa_search": lambda s, d: opened(s, d).model().search(QUERY),
    "embed_sessions": lambda s, d: EMBEDDER.sessions(turns(s, d).dropDuplicates(["id"])).select("session_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding")),
    "session_drill_down": drill_down,
    "store_round_trip": round_trip,
    "cosine_topk": cosine_topk,
    "dense_by_label": dense_by_label,
    "dense_search": dense_scores,
    "latent_search": latent_scores,
    "fusion_2way": lambda s, d: fused(s, d, latent_scores, False),
    "fusion_3way": lambda s, d: fused(s, d, latent_scores, True),
    "fusion_2way_tfidf": lambda s, d: fused(s, d, tfidf_scores, False),
    "fusion_3way_tfidf": lambda s, d: fused(s, d, tfidf_scores, True),
    "hybrid_search": index_search,
    "hybrid_search_filtered": lambda s, d: index_search(s, d, filters=search.Filters(file=r"\.go$", actor="human")),
    "hybrid_ranked": lambda s, d: hybrid(s, d, latent_scores).drop("snippet"),
    "hybrid_ranked_filtered": lambda s, d: hybrid(s, d, latent_scores, search.Filters(file=r"\.go$", actor="human")).drop("snippet"),
    "hybrid_ranked_tfidf": lambda s, d: hybrid(s, d, tfidf_scores).drop("snippet"),
    "filter_search": lambda s, d: ops.browse(facets(s, d), files(s, d), turns(s, d), actor="human", file=PATH).drop("snippet"),
    "session_text": lambda s, d: texts(s, d).select("session_id", F.sha2("content", 256).alias("digest")),
    "session_totals": lambda s, d: placed(s, d).groupBy("session_id", F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n")),
    "turns_page": lambda s, d: ops.paged(placed(s, d), 2, 5).select("id", "session_id", "turn_index", "total", "has_more"),
    "turns_page_role": lambda s, d: ops.paged(placed(s, d), 0, 3, "human").select("id", "session_id", "turn_index", "total", "has_more"),
    "checkpoint_log": lambda s, d: ops.checkpoint_log(checkpoints(s, d), files(s, d)),
    "log_report": lambda s, d: ops.log_report(ops.checkpoint_log(checkpoints(s, d), files(s, d))),
    "session_facets": facets,
    "files_index_supplement": lambda s, d: ops.files_supplement(calls(s, d), files(s, d)),
    "files_index_supplement_root": lambda s, d: ops.files_supplement(calls(s, d), files(s, d), ROOT),
    "touched_files": lambda s, d: scan.touched(files(s, d).select("change_type", "file_path").where("file_path is not null").distinct(), calls(s, d).where(F.col("tool").isin(ops.WRITING_TOOLS)).select("path"), ROOT),
    "file_cooccurrence": lambda s, d: ops.file_cooccurrence(called(s, d)),
    "cooccurrence_neighbours": lambda s, d: ops.neighbours_of(ops.file_cooccurrence(called(s, d)), PATH, 20),
    "semi_join_regex": lambda s, d: sessions(s, d).select("id", "user_email").distinct().join(files(s, d).where(F.col("file_path").rlike(PATH)).select(F.col("session_id").alias("id")), "id", "left_semi"),
    "content_hash_dedup": lambda s, d: ops.dedup_by_hash(load(s, d, "documents"), "doc_id", "text"),
    "session_files": lambda s, d: ops.session_files(files(s, d)),
    "snippet_first": lambda s, d: ops.first_turns(turns(s, d)).select("session_id", F.sha2("snippet", 256).alias("digest")),
    "snippet_kwic": lambda s, d: kwic(load(s, d, "documents").where("text is not null"), "text", TERMS, "snippet").select("doc_id", "snippet"),
    "turn_deltas": lambda s, d: ops.turn_deltas(turns(s, d)),
    "turn_index_assign": lambda s, d: ops.assign_index(turns(s, d)),
    "upsert_state": upsert_state,
    "union_merge": union_merge,
    "dict_encode": lambda s, d: codes.dictionary(files(s, d), "change_type", "checkpoint_id"),
    "dict_decode": dict_round_trip,
    "enum_codes": lambda s, d: called(s, d).groupBy(codes.code(F.col("tool"), codes.TOOL_CODES).cast("bigint").alias("code")).agg(F.count("*").alias("n")),
    "sanitise_paths": lambda s, d: calls(s, d).where("path <> ''").select(sanitise_path(F.col("path")).alias("name")).distinct(),
    "name_status": name_status,
    "export_delta": export_held,
    "export_counters": export_counters,
    "facet_patch": facet_patch,
    "import_new": import_new,
    "parse_transcript_turns": parsed_turns,
    "parse_transcript_times": lambda s, d: transcripts.turns(transcripts.records(load(s, d, "transcript_lines"))).select("file_name", "turn_index", iso_utc(F.col("ts")).alias("stamp")),
    "parse_transcript_tools": lambda s, d: transcripts.tool_calls(transcripts.records(load(s, d, "transcript_lines"))),
    "parse_transcript_sessions": lambda s, d: transcripts.sessions(transcripts.records(load(s, d, "transcript_lines"))),
    "json_field_fallback": json_fallback,
}


# --- SQL -----------------------------------------------------------------------------------------


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN strlen({w}) > {len(x) + 3} AND ends_with({w}, '{x}') THEN left({w}, length({w}) - {len(x)})" for x in SUFFIXES) + f" ELSE {w} END"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = ", ".join(f"'{t}'" for t in sorted(set(TERMS)))


def _tokens_sql(text: str) -> str:
    runs = rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{Nd}}]+')"
    return f"list_transform(list_filter({runs}, lambda w: strlen(w) >= 2 AND NOT list_contains([{_STOP}], w)), lambda w: {_stem_sql('w')})"


_T = "t AS (SELECT DISTINCT * FROM turns)"
_TOK = f"{_T}, tok AS (SELECT id, session_id, turn_index, {_tokens_sql('content')} AS tokens FROM t)"
_TF = "tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2)"


def _bm25_sql(tok: str) -> str:
    return f"""{_TF}, len AS (SELECT id, len(tokens) AS dl FROM tok), stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len),
mine AS (SELECT * FROM tf WHERE term IN ({_TERMS})), freq AS (SELECT term, count(*) AS df FROM mine GROUP BY 1),
scored AS (SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM mine JOIN freq USING (term) JOIN len USING (id), stat GROUP BY id)"""


_HITS = f"""{_TOK}, {_bm25_sql('tok')}, hit AS (SELECT s.id, k.session_id, k.turn_index, s.score FROM scored s JOIN tok k ON k.id = s.id ORDER BY score DESC, s.id LIMIT 200)"""
_BEST = """best AS (SELECT session_id, id AS turn_id, turn_index, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, coalesce(turn_index, 2147483647), id DESC) AS k
  FROM hit WHERE score > 0) WHERE k = 1)"""
_TEXTS = "doc AS (SELECT session_id AS id, string_agg(coalesce(content, ''), ' ' ORDER BY coalesce(turn_index, 2147483647), ts NULLS FIRST, id) AS content FROM (SELECT DISTINCT id, session_id, turn_index, ts, content FROM turns) GROUP BY 1)"
_TFIDF = f"""doc AS (SELECT session_id AS id, string_agg(content, ' ') AS content FROM (SELECT DISTINCT id, session_id, turn_index, ts, content FROM turns) GROUP BY 1), dtf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_tokens_sql('content')}) AS term FROM doc) GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df FROM dtf GROUP BY 1 HAVING count(*) >= 2), total AS (SELECT count(*)::DOUBLE AS n FROM doc WHERE content <> ''),
matrix AS (SELECT id, term, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY id)) * (ln(n / df) + 1) AS w FROM dtf JOIN vocab USING (term), total),
tfidf AS (SELECT id, round(dot / (norm * sqrt({len(set(TERMS))}.0)), 6) AS score FROM (
  SELECT id, sum(CASE WHEN term IN ({_TERMS}) THEN w ELSE 0 END) AS dot, sqrt(sum(w * w)) AS norm FROM matrix GROUP BY 1) WHERE dot > 0)"""


def _vector_sql(name: str, model: str) -> str:
    """Scores against the vector of the first session, of the latest usable vector of each."""
    return f"""{name}_one AS (SELECT session_id, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY generated_at DESC NULLS LAST, embedding DESC) AS k FROM session_embeddings
  WHERE model = '{model}' AND session_id IS NOT NULL AND len(embedding) = (SELECT len(embedding) AS n FROM session_embeddings WHERE model = '{model}' AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1)
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE k = 1),
{name} AS (SELECT * FROM (SELECT f.session_id AS id, round(list_cosine_similarity(f.e::DOUBLE[], q.e::DOUBLE[]), 6) AS score
  FROM {name}_one f, (SELECT e FROM {name}_one ORDER BY session_id LIMIT 1) q) WHERE score > 0)"""


def _fusion_sql(dense: bool, latent: str = "latent") -> str:
    third = "UNION ALL SELECT id, 2, score FROM dense" if dense else ""
    second = _TFIDF if latent == "tfidf" else _vector_sql("latent", "lsa")
    share = lambda i: f"CASE WHEN m{i} > 0 THEN s{i} / m{i} ELSE 0 END"
    two, three = f"0.4 * {share(0)} + 0.6 * {share(1)}", f"0.35 * {share(0)} + 0.1 * {share(1)} + 0.55 * {share(2)}"
    cols = lambda p: ", ".join(f"coalesce(max(CASE WHEN kind = {i} THEN score END), 0) AS {p}{i}" for i in range(3))
    return f"""{_HITS}, {_BEST}, {second}{', ' + _vector_sql('dense', 'nomic') if dense else ''},
part AS (SELECT session_id AS id, 0 AS kind, score FROM best UNION ALL SELECT id, 1, score FROM {latent} {third}),
per AS (SELECT id, {cols('s')} FROM part GROUP BY 1), tops AS (SELECT {cols('m')} FROM part),
fused AS (SELECT id, CASE WHEN m2 > 0 THEN {three} ELSE {two} END AS score FROM per, tops)"""


_LINK = "link AS (SELECT DISTINCT checkpoint_id, session_id FROM files_index WHERE checkpoint_id IS NOT NULL AND session_id IS NOT NULL)"
_FACETS = f"""{_LINK}, cp AS (SELECT DISTINCT id AS checkpoint_id, git_sha, git_branch, ts FROM checkpoints),
latest AS (SELECT * FROM (SELECT session_id, checkpoint_id, git_sha, git_branch, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, checkpoint_id DESC) AS k FROM link JOIN cp USING (checkpoint_id)) WHERE k = 1),
nt AS (SELECT session_id, count(DISTINCT id) AS n FROM turns GROUP BY 1), nc AS (SELECT session_id, count(DISTINCT id) AS n FROM tool_calls GROUP BY 1),
nf AS (SELECT session_id, count(DISTINCT file_path) AS n FROM files_index GROUP BY 1),
facets AS (SELECT s.id AS session_id, s.user_email, coalesce(l.git_branch, s.branch) AS git_branch, s.actor_type, s.agent_id, s.captured_at,
  coalesce(nt.n, 0) AS turn_count, coalesce(nc.n, 0) AS tool_call_count, coalesce(nf.n, 0) AS file_count, l.checkpoint_id, l.git_sha
  FROM (SELECT DISTINCT id, user_email, branch, actor_type, agent_id, captured_at FROM sessions) s LEFT JOIN latest l ON l.session_id = s.id
  LEFT JOIN nt ON nt.session_id = s.id LEFT JOIN nc ON nc.session_id = s.id LEFT JOIN nf ON nf.session_id = s.id)"""
_EDGES = """c AS (SELECT DISTINCT * FROM tool_calls), edge AS (SELECT a.path AS file_a, b.path AS file_b, count(*)::BIGINT AS "count"
  FROM c a JOIN c b ON a.session_id = b.session_id AND a.path < b.path WHERE a.path <> '' AND b.path <> '' GROUP BY 1, 2)"""
_ORDER = "PARTITION BY session_id ORDER BY turn_index NULLS LAST, ts NULLS LAST, id"
_PAGE = "PARTITION BY session_id ORDER BY turn_index NULLS LAST, ts NULLS FIRST, id"

def _hybrid_sql(where: str, latent: str = "latent") -> str:
    return f"""WITH {_fusion_sql(True, latent)}, {_FACETS}
        SELECT f.session_id, floor(fused.score * 100 + 0.5) / 100 AS score, coalesce(best.turn_index, 0) AS snippet_turn_index, coalesce(u.role, '') AS snippet_role,
               f.user_email, f.git_branch, f.actor_type, f.captured_at, f.turn_count
        FROM fused JOIN facets f ON f.session_id = fused.id LEFT JOIN best ON best.session_id = fused.id LEFT JOIN (SELECT DISTINCT id, role FROM turns) u ON u.id = best.turn_id
        WHERE {where} ORDER BY round(fused.score, 6) DESC, f.session_id LIMIT 20"""


_RECORDS = """line AS (SELECT DISTINCT file_name, line_no, raw_line AS j FROM transcript_lines WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line) END = 'OBJECT'),
rec AS (SELECT file_name, line_no, j, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.message.role') AS role FROM line
  WHERE coalesce(json_extract_string(j, '$.isSidechain'), 'false') <> 'true' AND coalesce(json_extract_string(j, '$.type'), '') <> 'file-history-snapshot')"""
_BLOCKS = """blk AS (SELECT file_name, line_no, type, role, unnest(range(len(x))) AS pos, unnest(x) AS b FROM (
  SELECT *, json_extract(j, '$.message.content[*]') AS x FROM rec WHERE json_type(j, '$.message.content') = 'ARRAY')),
tool AS (SELECT file_name, line_no, pos, coalesce(json_extract_string(b, '$.name'), '') AS tool,
  coalesce(nullif(json_extract_string(b, '$.input.file_path'), ''), json_extract_string(b, '$.input.path'), '') AS path, coalesce(json_extract_string(b, '$.input.command'), '') AS command
  FROM blk WHERE type = 'assistant' AND role = 'assistant' AND json_extract_string(b, '$.type') = 'tool_use')"""

_SAID = f"""{_RECORDS}, {_BLOCKS},
        txt AS (SELECT file_name, line_no, string_agg(json_extract_string(b, '$.text'), chr(10) ORDER BY pos) AS content FROM blk
          WHERE json_extract_string(b, '$.type') = 'text' AND coalesce(json_extract_string(b, '$.text'), '') <> '' GROUP BY 1, 2),
        said AS (SELECT r.file_name, r.line_no, json_extract_string(r.j, '$.timestamp') AS stamp, CASE WHEN r.type = 'user' THEN 'human' ELSE 'assistant' END AS role,
          CASE WHEN json_type(r.j, '$.message.content') = 'VARCHAR' THEN json_extract_string(r.j, '$.message.content') ELSE coalesce(t.content, '') END AS content
          FROM rec r LEFT JOIN txt t USING (file_name, line_no) WHERE (r.type = 'user' AND r.role = 'user') OR (r.type = 'assistant' AND r.role = 'assistant'))"""
_CUT = "left(text, list_max(list_filter(range(0, 301), lambda k: strlen(left(text, k)) <= 300))) || '...'"

SQL = {
    "snippet_first": f"""SELECT session_id, sha256(CASE WHEN strlen(text) <= 300 THEN text ELSE {_CUT} END) AS digest FROM (SELECT session_id, content AS text,
        row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn_index, 2147483647), ts NULLS FIRST, id) AS k FROM turns) WHERE k = 1""",
    "snippet_kwic": f"""WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN strlen(text) > 300 THEN
          list_min(list_filter([{', '.join(f"strpos(lower(text), '{t}')" for t in TERMS)}], lambda x: x > 0)) - 1 END AS hit FROM documents WHERE text IS NOT NULL),
        e AS (SELECT *, least(greatest(hit - 150, 0) + 300, n) AS z FROM d),
        s AS (SELECT *, greatest(least(hit - 150, z - 300), 0) AS a FROM e),
        g AS (SELECT *, strpos(substr(text, a + 1, z - a), ' ') AS gap FROM s),
        h AS (SELECT * REPLACE (CASE WHEN a > 0 AND gap > 0 THEN a + gap ELSE a END AS a) FROM g),
        b AS (SELECT *, strpos(reverse(substr(text, a + 1, z - a)), ' ') AS back FROM h),
        f AS (SELECT * REPLACE (CASE WHEN z < n AND back > 0 THEN z - back + 1 ELSE z END AS z) FROM b)
        SELECT doc_id, CASE WHEN hit IS NOT NULL THEN (CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(text, a + 1, z - a) || (CASE WHEN z < n THEN '...' ELSE '' END)
          WHEN strlen(text) <= 300 THEN text ELSE {_CUT} END AS snippet FROM f""",
    "hybrid_ranked": _hybrid_sql("true"),
    "hybrid_ranked_filtered": _hybrid_sql("f.actor_type = 'human' AND f.session_id IN (SELECT session_id FROM files_index WHERE regexp_matches(file_path, '\\.go$'))"),
    "parse_transcript_tools": f"""WITH {_RECORDS}, {_BLOCKS} SELECT file_name, (row_number() OVER (PARTITION BY file_name ORDER BY line_no, pos) - 1)::INT AS call_order, tool, path,
        left(command, 100) AS cmd_prefix FROM tool""",
    "json_field_fallback": f"WITH {_RECORDS}, {_BLOCKS} SELECT tool, count(*) AS n, count(*) FILTER (WHERE path <> '') AS n_path FROM tool GROUP BY 1",
    # The given lines hold no plans, so plan turns need no statement here.
    "parse_transcript_turns": f"""WITH {_SAID}
        SELECT file_name, (row_number() OVER (PARTITION BY file_name ORDER BY line_no) - 1)::INT AS turn_index, role, content FROM said WHERE content <> ''""",
    "parse_transcript_times": f"""WITH {_SAID}
        SELECT file_name, (row_number() OVER (PARTITION BY file_name ORDER BY line_no) - 1)::INT AS turn_index, strftime(TRY_CAST(stamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM said WHERE content <> ''""",
    "parse_transcript_sessions": f"""WITH {_RECORDS} SELECT file_name, arg_min(json_extract_string(j, '$.sessionId'), line_no) FILTER (WHERE coalesce(json_extract_string(j, '$.sessionId'), '') <> '') AS session,
        arg_min(json_extract_string(j, '$.gitBranch'), line_no) FILTER (WHERE coalesce(json_extract_string(j, '$.gitBranch'), '') <> '') AS branch, count(*) AS n_lines FROM rec GROUP BY 1""",
    "log_report": f"""WITH {_LINK} SELECT id, 'checkpoint ' || coalesce(git_sha, 'null') || chr(10) || 'Branch: ' || coalesce(git_branch, 'null') || chr(10) || 'Author: ' || coalesce(user_email, 'null') || chr(10)
        || 'Date:   ' || coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'null') || chr(10) || 'Sessions: ' || n || chr(10) AS report FROM (SELECT c.id, git_sha, git_branch, user_email, ts, count(l.session_id) AS n
        FROM (SELECT DISTINCT id, git_sha, git_branch, user_email, ts FROM checkpoints) c LEFT JOIN link l ON l.checkpoint_id = c.id GROUP BY ALL ORDER BY ts DESC NULLS LAST, c.id LIMIT 20)""",
    "tokenize_terms": f"WITH {_TOK} SELECT id, (unnest(range(len(tokens))))::INT AS pos, unnest(tokens) AS term FROM tok",
    "term_doc_freq": f"""WITH tok AS (SELECT doc_id AS id, {_tokens_sql('text')} AS tokens FROM documents), {_TF}
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1""",
    "postings": f"WITH {_TOK}, {_TF} SELECT term, id, tf FROM tf",
    "bm25_turns": f"WITH {_HITS} SELECT * FROM hit",
    "bm25_index_turns": f"WITH {_HITS} SELECT id, score FROM hit",
    "bm25_best_turn": f"WITH {_HITS}, {_BEST} SELECT * FROM best",
    "bm25_documents": f"WITH tok AS (SELECT doc_id AS id, {_tokens_sql('text')} AS tokens FROM documents), {_bm25_sql('tok')} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20",
    "tfidf_matrix": f"WITH {_TFIDF} SELECT id, term, round(w, 6) AS w FROM matrix",
    "tfidf_search": f"WITH {_TFIDF} SELECT * FROM tfidf",
    "cosine_topk": """SELECT vec_id AS id, score FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score > 0 ORDER BY score DESC, id LIMIT 20""",
    "dense_by_label": """SELECT label, max(score) AS best, count(*) AS n FROM (SELECT e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score > 0 GROUP BY 1""",
    "dense_search": f"WITH {_vector_sql('dense', 'nomic')} SELECT * FROM dense",
    "latent_search": f"WITH {_vector_sql('latent', 'lsa')} SELECT * FROM latent",
    "fusion_2way_tfidf": f"WITH {_fusion_sql(False, 'tfidf')} SELECT id, round(score + 1e-9, 5) AS score FROM fused",
    "fusion_3way_tfidf": f"WITH {_fusion_sql(True, 'tfidf')} SELECT id, round(score + 1e-9, 5) AS score FROM fused",
    "hybrid_ranked_tfidf": _hybrid_sql("true", "tfidf"),
    "index_build": """SELECT 'session_count' AS key, count(DISTINCT id) AS n FROM sessions UNION ALL SELECT 'turn_count', count(DISTINCT id) FROM turns UNION ALL SELECT 'embedding_dim', 128""",
    "index_postings": f"WITH {_TOK}, {_TF} SELECT term, tf.id, session_id, turn_index, tf, len(tokens)::INT AS dl FROM tf JOIN tok USING (id)",
    "index_bm25": f"WITH {_HITS} SELECT id, session_id, turn_index, score FROM hit",
    "index_facets": f"WITH {_FACETS} SELECT * FROM facets",
    "index_files": f"""WITH {_LINK} SELECT DISTINCT checkpoint_id, session_id, file_path, change_type FROM files_index UNION ALL SELECT DISTINCT l.checkpoint_id, c.session_id, c.path, 'T' FROM tool_calls c JOIN link l USING (session_id)
        WHERE c.tool IN ('Write', 'Edit', 'NotebookEdit') AND length(c.path) > 0
        AND NOT EXISTS (SELECT 1 FROM files_index f WHERE f.checkpoint_id = l.checkpoint_id AND f.session_id = c.session_id AND f.file_path = c.path)""",
    "index_edges": f"WITH {_EDGES} SELECT * FROM edge",
    "embed_sessions": f"""WITH {_TOK}, x AS (SELECT session_id, ('0x' || left(md5(term), 8))::BIGINT % 256 AS place, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS x
          FROM (SELECT session_id, unnest(tokens) AS term FROM tok WHERE session_id IS NOT NULL) GROUP BY 1, 2),
        per AS (SELECT session_id, map_from_entries(list((place, x))) AS m, sqrt(sum(x * x)) AS norm FROM x WHERE x <> 0 GROUP BY 1)
        SELECT session_id, list_transform(range(0, 256), lambda p: round((coalesce(m[p], 0) / norm)::FLOAT::DOUBLE, 5)) AS embedding FROM per""",
    "session_drill_down": """WITH last AS (SELECT max(id) AS id FROM sessions),
        turn AS (SELECT *, row_number() OVER (ORDER BY turn_index NULLS LAST, ts NULLS FIRST, id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT id, turn_index, role, content, ts FROM turns WHERE session_id = (SELECT id FROM last))),
        head AS (SELECT DISTINCT user_email, actor_type, branch, captured_at FROM sessions WHERE id = (SELECT id FROM last)),
        part AS (SELECT 'turn' AS part, turn_index::INT AS place, role AS label, content AS value FROM turn WHERE k > 1 AND k <= 4
          UNION ALL SELECT 'session', 0, 'author', user_email FROM head UNION ALL SELECT 'session', 1, 'actor', actor_type FROM head UNION ALL SELECT 'session', 2, 'branch', branch FROM head
          UNION ALL SELECT 'session', 3, 'captured_at', rtrim(rtrim(strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') FROM head
          UNION ALL SELECT 'call', call_order::INT, tool, coalesce(path, '') FROM (SELECT DISTINCT id, call_order, tool, path FROM tool_calls WHERE session_id = (SELECT id FROM last))
          UNION ALL SELECT DISTINCT 'file', NULL::INT, 'file', file_path FROM files_index WHERE session_id = (SELECT id FROM last) AND file_path IS NOT NULL)
        SELECT part.*, coalesce((SELECT max(n) FROM turn), 0) AS total, coalesce((SELECT max(n) FROM turn), 0) > 4 AS has_more FROM part""",
    "store_round_trip": """WITH link AS (SELECT DISTINCT checkpoint_id, session_id FROM files_index WHERE checkpoint_id IN (SELECT id FROM checkpoints) AND session_id IN (SELECT id FROM sessions))
        SELECT 'sessions' AS "table", count(DISTINCT session_id) AS n FROM link UNION ALL SELECT 'turns', count(DISTINCT id) FROM turns WHERE session_id IN (SELECT session_id FROM link)
        UNION ALL SELECT 'tool_calls', count(DISTINCT id) FROM tool_calls WHERE session_id IN (SELECT session_id FROM link) UNION ALL SELECT 'checkpoints', count(DISTINCT id) FROM checkpoints
        UNION ALL SELECT 'files_touched', count(*) FROM (SELECT DISTINCT checkpoint_id, file_path, change_type FROM files_index WHERE checkpoint_id IN (SELECT id FROM checkpoints))
        UNION ALL SELECT 'checkpoint_sessions', count(*) FROM link UNION ALL SELECT 'unexported', 0""",
    "files_index_supplement_root": f"""WITH {_LINK} SELECT DISTINCT l.checkpoint_id, c.session_id, replace(c.path, '{ROOT}', '') AS file_path, 'T' AS change_type FROM tool_calls c JOIN link l USING (session_id)
        WHERE c.tool IN ('Write', 'Edit', 'NotebookEdit') AND starts_with(c.path, '{ROOT}')
        AND NOT EXISTS (SELECT 1 FROM files_index f WHERE f.checkpoint_id = l.checkpoint_id AND f.session_id = c.session_id AND f.file_path = replace(c.path, '{ROOT}', ''))""",
    "touched_files": f"""WITH git AS (SELECT DISTINCT change_type, file_path FROM files_index WHERE file_path IS NOT NULL)
        SELECT * FROM git UNION ALL SELECT 'T', p FROM (SELECT DISTINCT CASE WHEN starts_with(path, '{ROOT}') THEN substr(path, {len(ROOT) + 1}) ELSE path END AS p FROM tool_calls WHERE tool IN ('Write', 'Edit', 'NotebookEdit'))
        WHERE p <> '' AND p NOT IN (SELECT file_path FROM git)""",
    "fusion_2way": f"WITH {_fusion_sql(False)} SELECT id, round(score + 1e-9, 5) AS score FROM fused",
    "fusion_3way": f"WITH {_fusion_sql(True)} SELECT id, round(score + 1e-9, 5) AS score FROM fused",
    "filter_search": f"""WITH {_FACETS}, listed AS (SELECT session_id, file_path FROM files_index), f AS (SELECT session_id, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS files FROM listed GROUP BY 1)
        SELECT session_id, user_email, git_branch, actor_type, captured_at, turn_count, file_count, coalesce(f.files, '') AS files
        FROM facets LEFT JOIN f USING (session_id) WHERE actor_type = 'human' AND session_id IN (SELECT session_id FROM listed WHERE regexp_matches(file_path, '{PATH}'))
        ORDER BY captured_at DESC NULLS LAST, session_id LIMIT 20""",
    "session_text": f"WITH {_TEXTS} SELECT id AS session_id, sha256(content) AS digest FROM doc",
    "session_totals": f"WITH {_T} SELECT session_id, lower(trim(role)) AS role, count(*) AS n FROM t GROUP BY 1, 2",
    "turns_page": f"WITH {_T} SELECT id, session_id, turn_index, total, total > 7 AS has_more FROM (SELECT *, row_number() OVER ({_PAGE}) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM t) WHERE n > 2 AND n <= 7",
    "turns_page_role": f"WITH {_T} SELECT id, session_id, turn_index, total, total > 3 AS has_more FROM (SELECT *, row_number() OVER ({_PAGE}) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM t WHERE role = 'human') WHERE n <= 3",
    "checkpoint_log": f"""WITH {_LINK} SELECT c.id, git_sha, git_branch, user_email, ts, count(l.session_id) AS n_sessions
        FROM (SELECT DISTINCT id, git_sha, git_branch, user_email, ts FROM checkpoints) c LEFT JOIN link l ON l.checkpoint_id = c.id GROUP BY ALL ORDER BY ts DESC NULLS LAST, c.id LIMIT 20""",
    "session_facets": f"WITH {_FACETS} SELECT * FROM facets",
    "files_index_supplement": f"""WITH {_LINK} SELECT DISTINCT l.checkpoint_id, c.session_id, c.path AS file_path, 'T' AS change_type FROM tool_calls c JOIN link l USING (session_id)
        WHERE c.tool IN ('Write', 'Edit', 'NotebookEdit') AND length(c.path) > 0
        AND NOT EXISTS (SELECT 1 FROM files_index f WHERE f.checkpoint_id = l.checkpoint_id AND f.session_id = c.session_id AND f.file_path = c.path)""",
    "file_cooccurrence": f"WITH {_EDGES} SELECT * FROM edge",
    "cooccurrence_neighbours": f"""WITH {_EDGES} SELECT * FROM edge WHERE regexp_matches(file_a, '{PATH}') OR regexp_matches(file_b, '{PATH}') ORDER BY "count" DESC, file_a, file_b LIMIT 20""",
    "semi_join_regex": f"SELECT id, user_email FROM (SELECT DISTINCT * FROM sessions) WHERE id IN (SELECT session_id FROM files_index WHERE regexp_matches(file_path, '{PATH}'))",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "session_files": "SELECT DISTINCT session_id, file_path FROM files_index WHERE file_path IS NOT NULL",
    "turn_deltas": f"""SELECT id, session_id, greatest(coalesce(trunc(epoch(ts - lag(ts) OVER ({_ORDER})))::BIGINT, 0), 0) AS delta_s
        FROM (SELECT DISTINCT id, session_id, turn_index, ts FROM turns)""",
    "turn_index_assign": f"SELECT id, session_id, row_number() OVER ({_ORDER}) - 1 AS position FROM (SELECT DISTINCT id, session_id, turn_index, ts FROM turns)",
    "upsert_state": """SELECT git_branch, ts, git_sha FROM (SELECT git_branch, ts, git_sha, row_number() OVER (PARTITION BY git_branch ORDER BY ts DESC, git_sha DESC) AS k
        FROM checkpoints WHERE ts IS NOT NULL) WHERE k = 1""",
    "union_merge": """WITH x AS (SELECT DISTINCT id, user_email, branch FROM (SELECT DISTINCT * FROM sessions)) SELECT * FROM x WHERE branch LIKE 'fix/%' OR branch IS NULL OR branch NOT LIKE 'fix/c%'""",
    "dict_encode": """SELECT row_number() OVER (ORDER BY first, value) - 1 AS idx, value FROM (SELECT change_type AS value, min(checkpoint_id) AS first FROM files_index WHERE change_type IS NOT NULL GROUP BY 1)""",
    "dict_decode": "SELECT file_path, count(*) AS n FROM (SELECT DISTINCT * FROM files_index) WHERE file_path IS NOT NULL GROUP BY 1",
    "enum_codes": """SELECT CASE tool WHEN 'Write' THEN 0 WHEN 'Read' THEN 1 WHEN 'Bash' THEN 2 WHEN 'Edit' THEN 3 WHEN 'Glob' THEN 4 WHEN 'Grep' THEN 5 WHEN 'Task' THEN 6 ELSE 255 END::BIGINT AS code,
        count(*) AS n FROM (SELECT DISTINCT * FROM tool_calls) GROUP BY 1""",
    "sanitise_paths": "SELECT DISTINCT regexp_replace(path, '[^a-zA-Z0-9]', '-', 'g') AS name FROM tool_calls WHERE path <> ''",
    "name_status": "SELECT change_type, count(*) AS n, count(DISTINCT file_path) AS n_paths FROM (SELECT DISTINCT * FROM files_index) WHERE file_path IS NOT NULL AND change_type IS NOT NULL GROUP BY 1",
    "export_delta": f"""WITH {_LINK} SELECT checkpoint_id, count(*) AS n_sessions FROM link WHERE checkpoint_id IN (SELECT id FROM checkpoints WHERE NOT exported)
        AND session_id IN (SELECT id FROM sessions) GROUP BY 1""",
    "export_counters": f"""WITH {_LINK}, cp AS (SELECT DISTINCT id FROM checkpoints WHERE NOT exported), l AS (SELECT * FROM link WHERE checkpoint_id IN (FROM cp) AND session_id IN (SELECT id FROM sessions))
        SELECT (SELECT count(*) FROM cp) AS n_checkpoints, (SELECT count(DISTINCT session_id) FROM l) AS n_sessions, (SELECT count(*) FROM l) AS n_checkpoint_sessions,
          (SELECT count(DISTINCT id) FROM turns WHERE session_id IN (SELECT session_id FROM l)) AS n_turns""",
    "facet_patch": f"""WITH {_FACETS}, stated AS (SELECT id AS session_id, max(branch) AS branch, max(upper(user_email)) AS email FROM sessions GROUP BY 1)
        SELECT f.session_id, coalesce(branch, git_branch) AS git_branch, coalesce(email, user_email) AS user_email, turn_count FROM facets f LEFT JOIN stated USING (session_id)""",
    "import_new": """SELECT session_id, count(*) AS n_turns FROM (SELECT DISTINCT * FROM turns)
        WHERE session_id NOT IN (SELECT id FROM sessions WHERE captured_at < TIMESTAMP '2025-06-01' AND id IS NOT NULL) GROUP BY 1""",
}
# The files of an index are those its own table has, with what tool calls add.
SQL["index_filter_search"] = SQL["filter_search"].replace("(SELECT session_id, file_path FROM files_index)", "(SELECT session_id, file_path FROM (" + SQL["index_files"].replace(f"WITH {_LINK} ", "") + "))")
