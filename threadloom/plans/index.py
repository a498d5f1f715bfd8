"""The derived index: rebuilt from the truth tables at any time, or extended by new sessions.

Tables are laid out for their readers: postings by a hash of the term and sorted by it,
so a search opens the few row groups of its terms; turns sorted by session, so the turns
of the sessions found are read without a scan. What BM25 needs of a document stands in
the posting, what it needs of the corpus in index_state.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from threadloom import durable
from threadloom.operators import lsa, retrieval
from threadloom.operators import sessions as ops
from threadloom.plans.embed import Embedder
from threadloom.plans.store import Store
from threadloom.schemas import INDEX

#: Directories of postings; more keep each of them small on larger corpora.
TERM_BUCKETS = 32
#: What an index can be built from: a store, tables, or what gives them when they are needed.
Source = Store | dict[str, DataFrame] | Callable[[], dict[str, DataFrame]]
# Fixed value: the name of the model of latent vectors.
LATENT = "lsa-v1"


def bucket_of(term: str, buckets: int) -> int:
    """The bucket of a term, the same on the driver as in :func:`_bucketed`."""
    return crc32(term.encode()) % buckets


def _bucketed(post: DataFrame, buckets: int) -> DataFrame:
    """Postings with their bucket, in ranges of (bucket, term, id): a frequent term is several ranges."""
    with_bucket = post.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int"))
    return with_bucket.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")


def _postings(turns: DataFrame) -> DataFrame:
    """(term, id, session_id, turn_index, tf, dl); a turn without tokens has none."""
    return durable.materialise(retrieval.placed_postings(turns, "id", "content", "session_id", "turn_index"), "postings")


def files_index(files_touched: DataFrame, links: DataFrame, tool_calls: DataFrame, root: str = "") -> DataFrame:
    """(checkpoint_id, session_id, file_path, change_type): touched files by session, with what tool calls add."""
    base = files_touched.select("checkpoint_id", "file_path", "change_type").join(links, "checkpoint_id").select("checkpoint_id", "session_id", "file_path", "change_type")
    return base.unionByName(ops.files_supplement(tool_calls, base, root, links))


def _files(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Files by (checkpoint, session) as truth has them, and the links."""
    if "files_index" in t:
        base = t["files_index"].select("checkpoint_id", "session_id", "file_path", "change_type").distinct()
        return base, ops.links(base)
    links = t["checkpoint_sessions"].select("checkpoint_id", "session_id").distinct()
    return t["files_touched"].select("checkpoint_id", "file_path", "change_type").join(links, "checkpoint_id").select("checkpoint_id", "session_id", "file_path", "change_type"), links


def build_index(store: Store, index_root: str, root: str = "", rank: int = lsa.RANK, embedder: Embedder | None = None) -> dict[str, int]:
    """Rebuild all derived tables below *index_root*; the counts kept in index_state."""
    return write_index(store.spark, store.truth(), index_root, root, rank, embedder)


def _put_state(spark: SparkSession, index_root: str, state: dict[str, str]) -> None:
    rows = spark.createDataFrame([*state.items()], "key string, value string")
    now = spark.range(1).select(F.lit("last_indexed_at").alias("key"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"))
    rows.unionByName(now).coalesce(1).write.mode("overwrite").parquet(f"{index_root}/index_state")


def write_index(spark: SparkSession, t: dict[str, DataFrame], index_root: str, root: str = "", rank: int = lsa.RANK, embedder: Embedder | None = None) -> dict[str, int]:
    """Derive the index of the given truth tables: facets, files, edges, postings, latent vectors.

    *t* holds sessions, turns, tool_calls, checkpoints and either files_touched with
    checkpoint_sessions or files_index. Rows repeated under one id count once. The state
    is written last, so an interrupted build is no index. Steps are discarded at the end.
    """
    with durable.scope(spark):
        put = lambda name, df, by=(): df.write.partitionBy(*by).mode("overwrite").parquet(f"{index_root}/{name}")
        turns = t["turns"].where("id is not null").dropDuplicates(["id"]).select(*_names("turns_ft"))
        put("turns_ft", turns.repartitionByRange("session_id", "turn_index", "id").sortWithinPartitions("session_id", "turn_index", "id"))
        turns = spark.read.schema(INDEX["turns_ft"]).parquet(f"{index_root}/turns_ft")
        calls = durable.materialise(t["tool_calls"].where("id is not null").dropDuplicates(["id"]).select(*_names("tool_calls_index")), "calls")
        put("tool_calls_index", calls)
        base, links = _files(t)
        base = durable.materialise(base, "files")
        put("files_index", base.unionByName(ops.files_supplement(calls, base, root, links)))
        put("session_facets", ops.session_facets(t["sessions"], turns, calls, base, t["checkpoints"], links).select(*_names("session_facets")))
        put("file_cooccurrence", ops.file_cooccurrence(calls))
        post = _postings(turns)
        put("postings", _bucketed(post, TERM_BUCKETS), ["bucket"])
        n_sessions = t["sessions"].where("id is not null").select("id").distinct().count()
        n_turns, n_tokens = turns.count(), post.agg(F.sum("tf")).head()[0] or 0
        model = lsa.fit_lsa(turns, "session_id", "content", rank) if n_sessions >= 2 else None
        vectors = spark.createDataFrame([], INDEX["session_embeddings"])
        stamped = lambda df, name: df.select("session_id", F.col("embedding").cast("array<float>"), F.current_timestamp().alias("generated_at"), F.lit(name).alias("model"))
        if model:
            vectors = vectors.unionByName(stamped(model.vectors.withColumnRenamed("id", "session_id"), LATENT))
            put("lsa_terms", model.terms.select(*_names("lsa_terms")).repartitionByRange("term").sortWithinPartitions("term"))
        if embedder:
            vectors = vectors.unionByName(stamped(embedder.sessions(turns), embedder.name))
        put("session_embeddings", vectors, ["model"])
        counts = {"session_count": n_sessions, "turn_count": n_turns, "embedding_dim": len(model.sigma) if model else 0}
        _put_state(spark, index_root, {k: str(v) for k, v in (counts | {"token_count": n_tokens, "buckets": TERM_BUCKETS}).items()} | {"sigma": json.dumps(model.sigma if model else [])})
    return counts


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in INDEX[table].split(", ")]


@dataclass
class Index:
    """An index as it is read: its state, and its tables by name (empty where none was written)."""

    spark: SparkSession
    root: str
    state: dict[str, str]

    def table(self, name: str) -> DataFrame:
        """A table of the index with its schema."""
        try:
            return self.spark.read.schema(INDEX[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], INDEX[name])

    def number(self, key: str) -> int:
        """A number of the state, 0 if it has none."""
        return int(self.state.get(key, 0))

    def model(self) -> lsa.LsaModel | None:
        """The latent model, if one was fitted."""
        sigma = json.loads(self.state.get("sigma", "[]"))
        if not sigma:
            return None
        return lsa.LsaModel(self.table("lsa_terms"), sigma, self.vectors(LATENT).withColumnRenamed("session_id", "id"))

    def vectors(self, model: str) -> DataFrame:
        """(session_id, embedding) of one model."""
        return self.table("session_embeddings").where(F.col("model") == model).select("session_id", "embedding")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of *terms*; only their buckets are listed, and only their row groups read."""
        terms = sorted(set(terms))
        buckets = sorted({bucket_of(t, self.number("buckets")) for t in terms}) if terms else []
        return self.table("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def read_state(spark: SparkSession, index_root: str) -> dict[str, str]:
    """The state of an index, {} where none is built."""
    try:
        return {r.key: r.value for r in spark.read.schema(INDEX["index_state"]).parquet(f"{index_root}/index_state").collect()}
    except AnalysisException:
        return {}


def open_index(spark: SparkSession, index_root: str, source: Source | None = None, root: str = "", rank: int = lsa.RANK, embedder: Embedder | None = None) -> Index:
    """The index below *index_root*; one that has no state is built first from *source*."""
    state = read_state(spark, index_root)
    if "last_indexed_at" not in state:
        if source is None:
            raise ValueError(f"no index at {index_root} and nothing to build it from")
        write_index(spark, source.truth() if isinstance(source, Store) else source() if callable(source) else source, index_root, root, rank, embedder)
        state = read_state(spark, index_root)
    return Index(spark, index_root, state)


def extend_index(spark: SparkSession, t: dict[str, DataFrame], index_root: str, root: str = "") -> int:
    """Add the sessions the index lacks, so they are found at once; how many they were.

    Their turns, calls, postings and facets are appended, and the files of every link the
    index does not have. Document frequencies are counted at query time and the corpus
    counts are kept in the state. Edges and latent vectors follow at a rebuild.
    """
    ix = open_index(spark, index_root)
    with durable.scope(spark):
        add = lambda name, df, by=(): df.write.partitionBy(*by).mode("append").parquet(f"{index_root}/{name}")
        new = durable.materialise(t["sessions"].where("id is not null").join(ix.table("session_facets").select(F.col("session_id").alias("id")), "id", "left_anti"), "new")
        n = new.select("id").distinct().count()
        ids = new.select(F.col("id").alias("session_id")).distinct()
        fresh = lambda name, table: durable.materialise(t[name].where("id is not null").join(ids, "session_id", "left_semi").dropDuplicates(["id"]).select(*_names(table)), name)
        turns, calls = fresh("turns", "turns_ft"), fresh("tool_calls", "tool_calls_index")
        base, links = _files(t)
        have = ix.table("files_index").select("checkpoint_id", "session_id").distinct()
        new_files = durable.materialise(base.join(have, ["checkpoint_id", "session_id"], "left_anti"), "files")
        supplement = ops.files_supplement(t["tool_calls"], new_files, root, links.join(have, ["checkpoint_id", "session_id"], "left_anti"))
        files = durable.materialise(new_files.unionByName(supplement), "supplemented")
        facets = ops.session_facets(new, turns, calls, base.join(ids, "session_id", "left_semi"), t["checkpoints"], links.join(ids, "session_id", "left_semi"))
        post = _postings(turns)
        tokens, more = post.agg(F.sum("tf")).head()[0] or 0, turns.count()
        add("postings", _bucketed(post, ix.number("buckets")), ["bucket"])
        add("turns_ft", turns.repartitionByRange("session_id", "turn_index", "id").sortWithinPartitions("session_id", "turn_index", "id"))
        add("tool_calls_index", calls)
        add("files_index", files)
        add("session_facets", facets.select(*_names("session_facets")))  # last: a session with facets is in the index
        grown = {"session_count": ix.number("session_count") + n, "turn_count": ix.number("turn_count") + more, "token_count": ix.number("token_count") + tokens}
        _put_state(spark, index_root, {k: v for k, v in ix.state.items() if k != "last_indexed_at"} | {k: str(v) for k, v in grown.items()})
    return n
