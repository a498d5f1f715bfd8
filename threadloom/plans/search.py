"""Hybrid search and filter search: over tables as one plan, or over a stored index."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import kwic, query_terms, round2
from threadloom.operators import lsa, retrieval
from threadloom.operators import sessions as ops
from threadloom.plans import index as indexes
from threadloom.plans.embed import Embedder, dense_scores

HIT = "session_id string, turn_id string, turn_index int, score double"


@dataclass
class Filters:
    """What a search may be limited to; file is a regular expression, commit a prefix."""

    file: str | None = None
    author: str | None = None
    actor: str | None = None
    commit: str | None = None


def rank(scored: DataFrame, facets: DataFrame, files: DataFrame, filters: Filters, limit: int) -> DataFrame:
    """The best *limit* scored sessions with their facets. Filters come after fusion, so they change no score; sessions without facets drop out."""
    rows = scored.withColumnRenamed("id", "session_id").join(facets, "session_id").where(ops.matches(facets, filters.author, filters.actor, filters.commit))
    if filters.file:
        rows = rows.join(files.where(F.col("file_path").rlike(filters.file)).select("session_id").distinct(), "session_id", "left_semi")
    top = rows.select("session_id", round2(F.col("score")).alias("score"), F.col("score").alias("exact"), "user_email", "git_branch", "actor_type", "captured_at", "turn_count")
    return top.orderBy(F.round("exact", 6).desc(), "session_id").limit(limit if limit > 0 else ops.DEFAULT_LIMIT)


def assemble(top: DataFrame, best: DataFrame, turns: DataFrame, terms: list[str]) -> DataFrame:
    """Ranked sessions with snippets: of the best turn, else of the first one. *turns* hold at least the turns of these sessions."""
    hit = best.select("session_id", "turn_id")
    text = turns.select(F.col("id").alias("turn_id"), "content", "role", "turn_index").dropDuplicates(["turn_id"])
    starts = ops.first_turns(turns.join(top.select("session_id"), "session_id", "left_semi")).select("session_id", F.col("snippet").alias("start"))
    shown = top.join(hit, "session_id", "left").join(text, "turn_id", "left").join(starts, "session_id", "left")
    return kwic(shown, "content", terms, "window").select(
        "session_id", "score", F.coalesce("window", "start", F.lit("")).alias("snippet"), F.coalesce("turn_index", F.lit(0)).alias("snippet_turn_index"),
        F.coalesce("role", F.lit("")).alias("snippet_role"), "user_email", "git_branch", "actor_type", "captured_at", "turn_count",
    )


def _best(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """The best turn of each session among the candidates, brought in once: at most CANDIDATES rows."""
    cut = hits.orderBy(F.desc("score"), "id").limit(retrieval.CANDIDATES)
    return spark.createDataFrame(retrieval.best_turn(cut).select("session_id", "turn_id", "turn_index", "score").collect(), HIT)


def hybrid(turns: DataFrame, hits: DataFrame, latent: DataFrame, dense: DataFrame | None, facets: DataFrame, files: DataFrame, query: str, filters: Filters | None = None, limit: int = 0) -> DataFrame:
    """Fuse BM25 *hits* (id, session_id, turn_index, score), *latent* and *dense* (id, score) and assemble."""
    best = _best(turns.sparkSession, hits)
    scored = retrieval.fuse(best.select(F.col("session_id").alias("id"), "score"), latent, dense)
    return assemble(rank(scored, facets, files, filters or Filters(), limit), best, turns, query_terms(query))


def search(spark: SparkSession, index_root: str, query: str, filters: Filters | None = None, limit: int = 0, embedder: Embedder | None = None, source: indexes.Source | None = None, rank_of_model: int = lsa.RANK) -> DataFrame:
    """Hybrid search over the index at *index_root*, which is built from *source* where it is not.

    Dense scores are taken if there is an *embedder* and the index has its vectors. An
    empty query is a filter search. Only the postings of the query's terms are read, and
    only the turns of the sessions found.
    """
    ix = indexes.open_index(spark, index_root, source, rank=rank_of_model, embedder=embedder)
    f = filters or Filters()
    if not query.strip():
        return ops.browse(ix.table("session_facets"), ix.table("files_index"), ix.table("turns_ft"), f.author, f.actor, f.commit, f.file, limit)
    terms = query_terms(query)
    best = _best(spark, retrieval.bm25_stored(ix.postings(terms), ix.number("turn_count"), ix.number("token_count")))
    model = ix.model()
    latent = model.search(query) if model else spark.createDataFrame([], "id string, score double")
    dense = dense_scores(ix.vectors(embedder.name), embedder, query) if embedder else None
    scored = retrieval.fuse(best.select(F.col("session_id").alias("id"), "score"), latent, dense)
    top = rank(scored, ix.table("session_facets"), ix.table("files_index"), f, limit)
    rows = top.collect()  # at most the limit
    turns = ix.table("turns_ft").where(F.col("session_id").isin([r.session_id for r in rows]))
    return assemble(spark.createDataFrame(rows, top.schema), best, turns, terms).orderBy(F.desc("score"), "session_id")


def result_document(results: DataFrame, query: str, filters: Filters | None = None) -> DataFrame:
    """One row (value): the results of a search, at most its limit, as one JSON document with query, filters, mode and total."""
    order = [F.desc("score"), "session_id"] if "score" in results.columns else [F.desc("captured_at"), "session_id"]
    rows = [r.value for r in results.orderBy(*order).select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value")).collect()]
    shown = {k: v or "" for k, v in asdict(filters or Filters()).items()}
    spark = results.sparkSession
    parts = F.array(*[F.parse_json(F.lit(r)) for r in rows]) if rows else F.array().cast("array<variant>")
    said = F.struct(parts.alias("results"), F.lit(query).alias("query"), F.struct(*[F.lit(v).alias(k) for k, v in shown.items()]).alias("filters"), F.lit("hybrid" if query.strip() else "filter").alias("mode"), F.lit(len(rows)).alias("total"))
    return spark.range(1).select(F.to_json(said).alias("value"))
