"""Most similar vectors for every vector (problem 3): an HNSW graph per shard, results merged.

Shards follow the data: k-means cells put neighbours together. Coarse cells are fitted
on a bounded sample; those that would hold more than a graph should are split by centres
fitted, in tasks, on a sample of their own vectors, so a graph stays the same size
however many vectors there are. Every vector is a member of its nearest cell, whose
members form one HNSW graph, and visits at most VISITS cells that are almost as near,
where it only searches. A graph with very many visitors is built several times, each for
a share of them. Exact copies are one member. The answers of all shards visited are
merged per vector. Work grows with the number of vectors, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.llm.hnsw import Hnsw

#: Members a cell should have, and the most it may be expected to have before it is split.
CELL, GRAPH = 4096, 8192
#: Coarse cells are fitted on at most SAMPLE vectors per model, with one cell per SAMPLE_PER_CELL of them at most; a cell is split
#: on SAMPLE_PER_PART of its vectors for each part, SPLIT_SAMPLE at most.
SAMPLE, SAMPLE_PER_CELL, SAMPLE_PER_PART, SPLIT_SAMPLE, ROUNDS = 40_000, 16, 64, 100_000, 10
#: A vector visits the cells whose centre is at most MARGIN less similar than the nearest centre, the nearest VISITS of them.
MARGIN, VISITS = 0.08, 24
#: Visitors a graph should have; the graph of a cell that expects more is built for each such share of them.
SLICE = 32_768
#: Copies of one vector up to which all their pairs are given; of more, each is paired with the first one only (see copies_of).
COPIES = 64
#: Neighbours and beam of a search, and beam at insertion.
K, EF, EF_BUILD = 6, 16, 20
MIN_COSINE = 0.90


#: Rows to leave out up to which they are broadcast (some 60 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def usable(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector, repeated ones as often as they come, and their digests, written once.

    Usable are vectors of the model's full length (its most frequent one; ties go to the
    longer), all finite, not all zero. Null keys and null vectors are left out. The first
    table has the columns (model, session_id, generated_at, vec, h1, h2), the second all
    but vec.
    """
    v = embeddings.where("session_id is not null and model is not null and embedding is not null")
    # NaN sorts above infinity, and null elements are skipped by array_max.
    low, high, inf = F.array_min("embedding"), F.array_max("embedding"), F.lit(float("inf"))
    good = v.where((F.size("embedding") > 0) & (high < inf) & (low > -inf) & ((low != 0) | (high != 0)) & (F.size(F.array_compact("embedding")) == F.size("embedding")))
    rows = good.select("model", "session_id", "generated_at", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), F.col("embedding").alias("vec"))
    digests = materialise(rows.drop("vec"), "digests")
    # One row per model.
    full = F.broadcast(digests.groupBy("model", "dim").count().groupBy("model").agg(F.max(F.struct("count", "dim"))["dim"].alias("dim")))
    return rows.join(full, ["model", "dim"], "left_semi").drop("dim"), digests.join(full, ["model", "dim"], "left_semi").drop("dim")


def current(vectors: DataFrame) -> DataFrame:
    """(model, session_id, h1, h2, differ): the digest that counts for each session, its latest one."""
    h = F.struct("h1", "h2")
    per = vectors.groupBy("model", "session_id").agg(F.max(F.struct("generated_at", "h1", "h2")).alias("m"), (F.min(h) < F.max(h)).alias("differ"))
    return per.select("model", "session_id", "m.h1", "m.h2", "differ")


def copies(now: DataFrame) -> DataFrame:
    """(model, session_id, rep, h1, h2, n): members of each group of n exact copies, by its first session; lone vectors have no row."""
    groups = now.groupBy("model", "h1", "h2").agg(F.min("session_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return now.join(groups, ["model", "h1", "h2"]).select("model", "session_id", "rep", "h1", "h2", "n")


def _single(vectors: DataFrame, digests: DataFrame, now: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of each group of copies, and no vector a session has replaced: vectors and digests.
    Only exceptions are joined, so the vectors themselves are not shuffled here."""
    replaced = digests.join(now.where("differ").withColumnsRenamed({"h1": "n1", "h2": "n2"}), ["model", "session_id"]).where("h1 <> n1 or h2 <> n2")
    out = materialise(replaced.select("model", "session_id", "h1", "h2").unionByName(same.where("session_id <> rep").select("model", "session_id", "h1", "h2")), "exceptions")
    few = out.count() <= BROADCAST_ROWS
    left, right = (t.join(F.broadcast(out) if few else out, ["model", "session_id", "h1", "h2"], "left_anti") for t in (vectors, digests))
    return left, right


def _kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of *k* cells and the share of the sample in each; deterministic."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        s = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c[near[order][first]] = np.where(norm > 0, s / np.maximum(norm, 1e-12), c[near[order][first]])
    return c, np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Cells:
    """The cells of one model: coarse centres, the centres they are split into (themselves, if they are not) and how often each graph is built.

    ``first[c]`` is the first cell of coarse cell c, ``shard[i]`` the first shard of cell i; a row visits *visits* cells at most.
    """

    coarse: np.ndarray
    fine: np.ndarray
    first: np.ndarray
    slices: np.ndarray
    visits: int

    @property
    def shard(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.slices)]

    def near(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's own): the cells each row of *x* goes to, its own one first."""
        sims = x @ self.coarse.T
        q, c = np.nonzero(sims >= sims.max(1, keepdims=True) - margin)
        s = sims[q, c]
        split = self.first[c + 1] - self.first[c] > 1
        rows, cells, near = [q[~split]], [self.first[c[~split]]], [s[~split]]
        for k in np.unique(c[split]):
            at = q[split & (c == k)]
            part = x[at] @ self.fine[self.first[k] : self.first[k + 1]].T
            rows.append(np.repeat(at, part.shape[1]))
            cells.append(np.tile(np.arange(self.first[k], self.first[k + 1]), len(at)))
            near.append(part.ravel())
        q, cell, s = np.concatenate(rows), np.concatenate(cells), np.concatenate(near)
        order = np.lexsort((cell, -s, q))
        q, cell, s = q[order], cell[order], s[order]
        own = np.r_[True, q[1:] != q[:-1]]
        start = np.flatnonzero(own)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = (s >= np.repeat(s[start], np.diff(np.r_[start, len(q)])) - margin) & (rank <= self.visits)
        return q[keep], cell[keep], own[keep]


def _split(vectors: DataFrame, coarse: dict[str, np.ndarray], parts: dict[str, np.ndarray], counts: dict[str, int]) -> dict[tuple[str, int], np.ndarray]:
    """The centres of the parts of each cell that has any, fitted in tasks on a sample of its vectors.

    What comes to the driver, and later to each task, is one centre per CELL vectors.
    """
    share = {m: min(1.0, SAMPLE_PER_PART / CELL, SPLIT_SAMPLE / (p.max() * CELL)) for m, p in parts.items()}
    place, chosen = F.pmod(F.xxhash64("session_id", F.lit(2)), F.lit(1 << 20)), F.lit(False)
    for m, f in share.items():
        chosen = chosen | ((F.col("model") == m) & (place < int((1 << 20) * f) + 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = b.column("model").to_numpy(zero_copy_only=False)
            for model in set(models):
                at = np.flatnonzero(models == model)
                x = _unit(_matrix(b.column("vec").take(pa.array(at)))).astype(np.float32)
                cell = (x @ coarse[model].T).argmax(1)
                ok = parts[model][cell] > 1
                yield pa.RecordBatch.from_arrays([pa.array([model] * int(ok.sum()), pa.string()), pa.array(cell[ok].astype(np.int32)), _lists(x[ok])], names=["model", "cell", "vec"])

    def centres(table: pa.Table) -> pa.Table:
        model, cell = table["model"][0].as_py(), table["cell"][0].as_py()
        x = _matrix(table["vec"])
        c, _ = _kmeans(x[np.lexsort(x.T[::-1])], int(parts[model][cell]))
        return pa.table({"model": pa.array([model] * len(c), pa.string()), "cell": pa.array([cell] * len(c), pa.int32()), "vec": _lists(c)})

    schema = "model string, cell int, vec array<float>"
    found = vectors.where(chosen).select("model", "vec").mapInArrow(assign, schema).groupBy("model", "cell").applyInArrow(centres, schema).toArrow()
    out, models, cell = {}, found["model"].to_numpy(), found["cell"].to_numpy()
    for m in parts:
        for c in np.unique(cell[models == m]):
            out[m, int(c)] = _matrix(found["vec"].filter(pa.array((models == m) & (cell == c)))).astype(np.float32)
    return out


def fit(vectors: DataFrame, digests: DataFrame, margin: float = MARGIN) -> dict[str, Cells]:
    """The cells of each model.

    The sample of a model are the vectors whose session hashes below a threshold that
    leaves at most SAMPLE of them, 256 per cell; one pass takes those of all models.
    *digests* are those of the same vectors. Where none is below it, the first one counts.
    Models are few, each with a bounded sample on the driver.
    """
    counts = {r["model"]: r["count"] for r in digests.groupBy("model").count().collect()}
    wanted = {m: min(SAMPLE, 256 * -(-n // CELL)) for m, n in counts.items()}
    place, chosen = F.pmod(F.xxhash64("session_id"), F.lit(1 << 20)), F.lit(False)
    for m, n in counts.items():
        chosen = chosen | ((F.col("model") == m) & (place < int((1 << 20) * min(1.0, wanted[m] / n)) + 1))
    sample = vectors.where(chosen).limit(2 * sum(wanted.values())).select("model", "session_id", "vec").toArrow().sort_by([("model", "ascending"), ("session_id", "ascending")])
    models, samples, coarse, parts = sample["model"].to_numpy(), {}, {}, {}
    for m, n in counts.items():
        mine = sample.filter(pa.array(models == m))
        if not len(mine):
            mine = vectors.where(F.col("model") == m).orderBy("session_id").limit(1).select("model", "session_id", "vec").toArrow()
        if len(mine):
            x = samples[m] = _unit(_matrix(mine["vec"])).astype(np.float32)
            coarse[m], share = _kmeans(x, min(-(-n // CELL), max(1, len(x) // SAMPLE_PER_CELL)))
            parts[m] = np.where(share * n > GRAPH, np.ceil(share * n / CELL), 1).astype(np.int64)
    split = _split(vectors, coarse, parts, counts) if any((p > 1).any() for p in parts.values()) else {}
    out = {}
    for m, c in coarse.items():
        fine = [split.get((m, k), c[k : k + 1]) for k in range(len(c))]
        first = np.r_[0, np.cumsum([len(f) for f in fine])]
        cells = Cells(c, np.concatenate(fine), first, np.ones(first[-1], dtype=np.int64), VISITS)
        _, cell, own = cells.near(samples[m], margin)
        visitors = np.bincount(cell[~own], minlength=len(cells.fine)) * (counts[m] / len(samples[m]))
        cells.slices = np.maximum(1, np.ceil(visitors / SLICE)).astype(np.int64)
        out[m] = cells
    return out


#: What a row is in its shard: it only searches, it is only a member, or it is a member that searches.
VISITOR, MEMBER, SEARCHER = 0, 1, 2
_SENT = pa.schema([("model", pa.string()), ("shard", pa.int32()), ("session_id", pa.string()), ("part", pa.int8()), ("vec", pa.list_(pa.float32()))])
_ANSWER = "model string, session_id string, neighbour string, cosine double"


def _matrix(col: pa.ChunkedArray | pa.ListArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(x, dtype=np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]), pa.array(flat))


def _dealt(vectors: DataFrame, cells: dict[str, Cells], margin: float) -> DataFrame:
    """Each vector to the shards of the cell it is a member of and of those it visits."""
    sent = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = b.column("model").to_numpy(zero_copy_only=False)
            ids, hashes, vecs = b.column("session_id"), b.column("h").to_numpy(), b.column("vec")
            for model in set(models):
                at = np.flatnonzero(models == model)
                x = _unit(_matrix(vecs.take(pa.array(at)))).astype(np.float32)
                known = sent.value[model]
                q, cell, own = known.near(x, margin)
                # A row searches one shard of each cell, and stands in all shards of its own.
                mine = known.shard[cell] + hashes[at[q]] % known.slices[cell]
                many = np.flatnonzero(own & (known.slices[cell] > 1))
                extra = [(np.full(n - 1, i), np.delete(np.arange(known.shard[c], known.shard[c + 1]), mine[i] - known.shard[c])) for i, c, n in zip(many, cell[many], known.slices[cell[many]])]
                rows = np.concatenate([q, *[q[i] for i, _ in extra]])
                where = np.concatenate([mine, *[s for _, s in extra]])
                part = np.concatenate([np.where(own, SEARCHER, VISITOR), *[np.full(len(s), MEMBER) for _, s in extra]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model] * len(rows), pa.string()), pa.array(where.astype(np.int32)), ids.take(pa.array(at[rows])).cast(pa.string()), pa.array(part.astype(np.int8)), _lists(x[rows])],
                    schema=_SENT,
                )

    keyed = vectors.select("model", "session_id", F.pmod(F.xxhash64("session_id"), F.lit(1 << 30)).alias("h"), "vec")
    return keyed.mapInArrow(run, "model string, shard int, session_id string, part tinyint, vec array<float>")


def _levels(n: int) -> np.ndarray:
    """Layers of the nodes: each higher layer keeps a twelfth of the one below."""
    return np.minimum((-np.log(1 - np.random.default_rng(11).random(n)) / np.log(12)).astype(np.int64), 5)


def _answers(k: int, ef: int, ef_build: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "descending"), ("session_id", "ascending")])
        ids = table["session_id"].to_numpy()
        once = np.r_[True, ids[1:] != ids[:-1]]  # repeated rows come to the same graphs
        if not once.all():
            table, ids = table.filter(pa.array(once)), ids[once]
        part = table["part"].to_numpy()
        n, n_search = int(np.count_nonzero(part != VISITOR)), int(np.count_nonzero(part == SEARCHER))
        x = _matrix(table["vec"])
        found_q, found_n, found_s = [], [], []
        if n:
            graph = Hnsw(x[:n], _levels(n), ef_build)
            for rows, (sims, near) in (
                (np.arange(n_search), graph.search_members(np.arange(n_search), k + 1, ef)),
                (np.arange(n, len(x)), graph.search(x[n:], k, ef)),
            ):
                ok = (near >= 0) & (near != rows[:, None]) & (sims >= least - 1e-4)
                q, j = np.nonzero(ok)
                found_q.append(rows[q])
                found_n.append(near[q, j])
        q = np.concatenate(found_q) if found_q else np.empty(0, np.int64)
        m = np.concatenate(found_n) if found_n else np.empty(0, np.int64)
        # The exact cosine of what was found.
        for a in range(0, len(q), 65536):
            y, z = x[q[a : a + 65536]].astype(np.float64), x[m[a : a + 65536]].astype(np.float64)
            found_s.append(np.einsum("bd,bd->b", y, z) / np.sqrt(np.einsum("bd,bd->b", y, y) * np.einsum("bd,bd->b", z, z)))
        s = np.concatenate(found_s) if found_s else np.empty(0)
        keep = s >= least
        q, m, s = q[keep], m[keep], s[keep]
        model = table["model"][0].as_py() if len(table) else None
        return pa.table({"model": pa.array([model] * len(q), pa.string()), "session_id": pa.array(ids[q], pa.string()), "neighbour": pa.array(ids[m], pa.string()), "cosine": pa.array(s, pa.float64())})

    return run


def _nearest(vectors: DataFrame, digests: DataFrame, same: DataFrame, k: int, ef: int, ef_build: int, margin: float, least: float) -> DataFrame:
    single, of_single = _single(vectors, digests, current(digests), same)
    cells = fit(single, of_single, margin)
    if not cells:
        return single.select("model", "session_id", F.col("session_id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    n_shards = int(sum(c.slices.sum() for c in cells.values()))
    dealt = _dealt(single, cells, margin).repartition(min(max(n_shards, 8), 100_000), "model", "shard")
    answers = dealt.groupBy("model", "shard").applyInArrow(_answers(k, ef, ef_build, least), _ANSWER)
    w = Window.partitionBy("model", "session_id").orderBy(F.desc("cosine"), "neighbour")
    # A neighbour is a member of one graph, which a vector visits once, so no answer comes twice.
    return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(embeddings: DataFrame, k: int = K, ef: int = EF, ef_build: int = EF_BUILD, margin: float = MARGIN, least: float = -1.0) -> DataFrame:
    """(model, session_id, neighbour, cosine, rank): the k nearest of each vector, among one of each group of copies.

    Of differing vectors of one session the latest counts. Rows below the cosine *least*
    are left out. Ties go to the smaller session_id. Copies are told by
    :func:`copies_of`: each has the neighbours of its representative.
    """
    vectors, digests = usable(embeddings)
    return _nearest(vectors, digests, copies(current(digests)), k, ef, ef_build, margin, least)


def copies_of(embeddings: DataFrame) -> DataFrame:
    """(model, session_id, rep) of all members of groups of exact copies."""
    return copies(current(usable(embeddings)[1])).select("model", "session_id", "rep")


def found(embeddings: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """(model, session_a, session_b): pairs of sessions with a cosine of at least *least*, session_a < session_b.

    Copies of one vector have its pairs, and each other, if they are COPIES at most. Of
    more copies the first one has all pairs and each other one is paired with it alone:
    no link between different vectors is lost, and nothing grows with the square of a group.
    """
    vectors, digests = usable(embeddings)
    same = materialise(copies(current(digests)), "copies")
    near = _nearest(vectors, digests, same, K, EF, EF_BUILD, MARGIN, least).select("model", F.col("session_id").alias("x"), F.col("neighbour").alias("y"))
    few = same.where(F.col("n") <= COPIES)
    a = few.select("model", F.col("rep").alias("x"), F.col("session_id").alias("xs"))
    b = few.select("model", F.col("rep").alias("y"), F.col("session_id").alias("ys"))
    spread = near.join(a, ["model", "x"], "left").join(b, ["model", "y"], "left").select("model", F.coalesce("xs", "x").alias("x"), F.coalesce("ys", "y").alias("y"))
    inside = a.join(b, (a["model"] == b["model"]) & (a["x"] == b["y"]) & (a["xs"] < b["ys"])).select(a["model"], F.col("xs").alias("x"), F.col("ys").alias("y"))
    star = same.where((F.col("n") > COPIES) & (F.col("session_id") != F.col("rep"))).select("model", F.col("rep").alias("x"), F.col("session_id").alias("y"))
    pairs = spread.unionByName(inside).unionByName(star)
    return pairs.select("model", F.least("x", "y").alias("session_a"), F.greatest("x", "y").alias("session_b")).where("session_a < session_b").distinct()
