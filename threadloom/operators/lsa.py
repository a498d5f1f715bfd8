"""Latent semantic analysis: TF-IDF rows, truncated SVD by distributed block Krylov iteration, fold-in of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.functions.codes import dense_index
from threadloom.functions.text import query_terms
from threadloom.operators.retrieval import tfidf, vector_search, with_text
from threadloom.tables import with_row

#: The rank, at most.
RANK = 128
#: Terms of the model, at most: those in the most documents. The driver holds so many rows of the basis (some 300 numbers),
#: each task rows of a block or of the rank (some 200 MB), whatever the number of documents; TF-IDF and BM25 keep all terms.
VOCABULARY = 200_000
#: Columns of a block, blocks at most, and the change (relative to the largest value) that ends the iteration.
BLOCK, PASSES, TOLERANCE = 48, 12, 1e-4


@dataclass
class LsaModel:
    """Vocabulary (term, idx, idf), term vectors (idx, vec), singular values, document vectors (id, embedding)."""

    terms: DataFrame
    sigma: list[float]
    vectors: DataFrame

    def embed(self, text: str) -> list[float]:
        """Fold a query in: q U / s, with tf relative to the most frequent of all its terms, known or not."""
        counts = Counter(query_terms(text))
        if not counts:
            return [0.0] * len(self.sigma)
        top = max(counts.values())
        out = np.zeros(len(self.sigma))
        for r in self.terms.where(F.col("term").isin(list(counts))).select("term", "idf", "vec").collect():
            out += (0.5 + 0.5 * counts[r.term] / top) * r.idf * np.array(r.vec)
        return [float(x) for x in np.divide(out, self.sigma, out=np.zeros_like(out), where=np.array(self.sigma) > 0)]

    def search(self, text: str, k: int | None = None) -> DataFrame:
        """(id, score): documents by cosine with the folded-in query, above zero only."""
        return vector_search(self.vectors, "id", "embedding", self.embed(text), k)


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """(B'B) Q for the sparse rows B: one pass, summed per term with map-side combine."""
    sent, n, width = rows.sparkSession.sparkContext.broadcast(q), *q.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, hit = np.zeros((n, width)), np.zeros(n, dtype=bool)
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                sizes = part["idx"].map(len).to_numpy()
                idx, w = np.concatenate(part["idx"].to_list()), np.concatenate(part["w"].to_list())
                y = np.add.reduceat(sent.value[idx] * w[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
                back = np.repeat(y, sizes, axis=0) * w[:, None]
                at = np.argsort(idx, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(idx[at]) > 0])
                z[idx[at][first]] += np.add.reduceat(back[at], first, axis=0)
                hit[idx] = True
        out = pd.DataFrame(z[hit], columns=[f"c{i}" for i in range(width)])
        out.insert(0, "idx", np.flatnonzero(hit).astype("int32"))
        yield out

    cols = [f"c{i}" for i in range(width)]
    sums = rows.mapInPandas(run, "idx int, " + ", ".join(f"{c} double" for c in cols)).groupBy("idx").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    out = np.zeros((n, width))
    out[sums["idx"].to_numpy()] = sums[cols].to_numpy()
    return out


def _right_factors(rows: DataFrame, n_terms: int, k: int) -> tuple[list[float], np.ndarray]:
    """Singular values and right factors (n_terms, k) of the sparse rows, by block Krylov iteration.

    Each pass over the rows multiplies one block and adds it, made orthogonal to those
    before, to the basis; the values are those of the matrix within the basis. The
    iteration ends when the k leading ones stand still. What comes to the driver is
    bounded by the vocabulary times the basis, whatever the number of documents.
    """
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((n_terms, min(n_terms, BLOCK))))
    basis, images, last = q, np.empty((n_terms, 0)), None
    while True:
        z = _gram_times(rows, q)
        images = np.concatenate([images, z], axis=1)
        inner = basis.T @ images
        values, u = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        top = np.sqrt(np.maximum(values[order], 0))
        still = last is not None and len(last) == len(top) and np.all(np.abs(top - last) <= TOLERANCE * top[0])
        if still or basis.shape[1] >= min(n_terms, PASSES * BLOCK):
            break
        last = top
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        q, r = np.linalg.qr(z)
        q = q[:, np.abs(np.diag(r)) > 1e-9 * top[0] ** 2][:, : n_terms - basis.shape[1]]
        if not q.shape[1]:
            break
        basis = np.concatenate([basis, q], axis=1)
    keep = top > 1e-7 * top[0]
    return [float(x) for x in top[keep]], (basis @ u[:, order])[:, keep]


def fit_lsa(docs: DataFrame, id_col: str, text_col: str, rank: int = RANK, most_terms: int = VOCABULARY) -> LsaModel | None:
    """Fit on documents with text, which may come in several rows; None if fewer than two documents or terms are left.

    Rows of the matrix are documents, columns the vocabulary (terms in two documents or
    more, the *most_terms* most frequent ones of them), so what comes back to the driver
    is bounded by vocabulary times basis, not by the documents.
    """
    weights = materialise(tfidf(docs, id_col, text_col), "weights")
    counts = weights.groupBy("term").agg(F.count("*").alias("df"))
    counts = materialise(counts, "df")
    if counts.count() > most_terms:
        ranked = dense_index(counts.withColumn("rare", -F.col("df")), "place", "rare", "term")
        counts = materialise(ranked.where(F.col("place") < most_terms).select("term", "df"), "frequent")
    vocab = materialise(dense_index(counts, "idx", "term").withColumn("idx", F.col("idx").cast("int")), "vocabulary")
    rows = weights.join(vocab.select("term", "idx"), "term").groupBy("id").agg(F.collect_list("idx").alias("idx"), F.collect_list("w").alias("w"))
    rows = materialise(rows, "rows")
    n_docs, n_terms = rows.count(), vocab.count()
    if n_docs < 2 or n_terms < 2:
        return None
    sigma, v = _right_factors(rows.select("idx", "w"), n_terms, min(rank, n_docs, n_terms))
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": [np.asarray(w) @ sent.value[np.asarray(i)] for i, w in zip(b["idx"], b["w"])]})

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vec=list(sent.value[b["idx"].to_numpy()]))

    idf = with_row(vocab, with_text(docs, id_col, text_col)).select("term", "idx", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    terms = idf.mapInPandas(factors, "term string, idx int, idf double, vec array<double>")
    kind = dict(rows.dtypes)["id"]
    return LsaModel(materialise(terms, "terms"), sigma, materialise(rows.mapInPandas(vectors, f"id {kind}, embedding array<double>"), "vectors"))
