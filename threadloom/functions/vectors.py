"""Vector reductions over array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """The Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if either is null, empty, all zero, or their lengths differ."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    na, nb = norm(a), norm(b)
    return F.when(ok & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def literal(v: list[float]) -> Column:
    """A query vector as a constant column."""
    return F.lit([float(x) for x in v])


def cosines(query: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, vector) to (id, score) with the cosine to one query vector, as :func:`cosine`, above zero only.

    Lambdas over arrays run interpreted, number by number; here a batch is one matrix.
    """
    q = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            fits = np.flatnonzero(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == len(q)) if length else np.empty(0, dtype=np.int64)
            x = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), len(q))
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            score = np.divide(x @ q, norms * length, out=np.zeros(len(fits)), where=norms > 0)
            some = score > 0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(fits[some])), pa.array(score[some])], names=["id", "score"])

    return run
