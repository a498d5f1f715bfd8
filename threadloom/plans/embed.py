"""Embedders for dense search: an interface, and one that needs no trained model."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import query_terms, tokenize
from threadloom.operators.retrieval import vector_search


class Embedder(Protocol):
    """What a dense search needs: a name for its vectors, vectors of sessions, the vector of a query."""

    name: str

    def sessions(self, turns: DataFrame) -> DataFrame:
        """(session_id, embedding) of the sessions of *turns*."""

    def query(self, text: str) -> list[float]:
        """The vector of a query, comparable with those of sessions."""


class HashingEmbedder:
    """Signed feature hashing: each token adds or takes one at a place its digest names; vectors have unit length.

    Tokens are hashed row by row and summed per session and place, so no session is put
    together. Sessions without tokens, or whose tokens cancel out, have no vector.
    """

    def __init__(self, dim: int = 256) -> None:
        self.dim, self.name = dim, f"hashing-{dim}"

    def _place(self, term: Column) -> Column:
        return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % self.dim

    def _sign(self, term: Column) -> Column:
        return F.when(F.substring(F.md5(term), 9, 1) < "8", 1).otherwise(-1)

    def sessions(self, turns: DataFrame) -> DataFrame:
        terms = turns.where("session_id is not null").select("session_id", F.explode(tokenize(F.col("content"))).alias("term"))
        sums = terms.groupBy("session_id", self._place(F.col("term")).alias("place")).agg(F.sum(self._sign(F.col("term"))).alias("x")).where("x <> 0")
        per = sums.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("at"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        places = F.sequence(F.lit(0).cast("bigint"), F.lit(self.dim - 1).cast("bigint"))
        return per.select("session_id", F.transform(places, lambda p: (F.coalesce(F.col("at")[p], F.lit(0)) / F.col("norm")).cast("float")).alias("embedding"))

    def query(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for term, n in Counter(query_terms(text)).items():
            digest = hashlib.md5(term.encode()).hexdigest()
            out[int(digest[:8], 16) % self.dim] += n if digest[8] < "8" else -n
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm if norm else 0.0 for x in out]


def dense_scores(vectors: DataFrame, embedder: Embedder, query: str) -> DataFrame:
    """(id, score) of stored vectors (session_id, embedding) against a query, above zero only."""
    return vector_search(vectors, "session_id", "embedding", embedder.query(query))
