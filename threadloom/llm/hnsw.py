"""A hierarchical navigable small-world graph over one shard, in flat neighbour arrays.

Numpy searches many queries at once: each holds a beam of its *ef* best nodes; a step
expands the best unexpanded node of every beam and merges its neighbours. Rows are
inserted in batches that at most double the graph, which is searched for their
neighbours; rows of one batch see each other directly. Vectors have unit length, so the
inner product is the cosine.
"""

from __future__ import annotations

import numpy as np

#: Neighbours per node on the upper layers and on the ground layer, and beam at insertion.
M, M0, EF_BUILD = 12, 24, 16
#: Rows inserted at once, at most; queries searched at once.
BATCH, QUERIES = 512, 1024


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if sims.shape[1] > k:
        at = np.argpartition(sims, -k, axis=1)[:, -k:]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


def _search_layer(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one layer: (sims, ids) of shape (len(q), ef), best first; -1 pads.

    ``graph`` has one row of neighbours per node (-1 pads); ``start`` holds a few entry
    nodes per query.
    """
    b = len(q)
    sims = np.full((b, ef), -2.0, dtype=np.float32)
    ids = np.full((b, ef), -1, dtype=np.int32)
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True
    w = min(start.shape[1], ef)
    first = start[:, :w]
    sims[:, :w] = np.where(first >= 0, np.einsum("bmd,bd->bm", x[first], q), -2.0)
    ids[:, :w] = first
    rows = np.arange(b)
    seen[rows[:, None], first] = True
    seen[:, n] = True
    todo = ids >= 0
    live = rows
    while len(live):
        s = np.where(todo[live], sims[live], -3.0)
        best = s.argmax(1)
        more = s[np.arange(len(live)), best] > -2.5
        live, best = live[more], best[more]
        if not len(live):
            break
        todo[live, best] = False
        near = graph[ids[live, best]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        any_new = fresh.any(1)
        act, near, fresh = live[any_new], near[any_new], fresh[any_new]
        if not len(act):
            continue
        got = np.einsum("bmd,bd->bm", x[near], q[act])
        got = np.where(fresh & (got > sims[act].min(1)[:, None]), got, -2.0)
        use = (got > -2.0).any(1)
        act, near, got = act[use], near[use], got[use]
        if not len(act):
            continue
        all_s = np.concatenate([sims[act], got], axis=1)
        at = np.argpartition(all_s, -ef, axis=1)[:, -ef:]
        sims[act] = np.take_along_axis(all_s, at, 1)
        ids[act] = np.take_along_axis(np.concatenate([ids[act], near], axis=1), at, 1)
        todo[act] = np.take_along_axis(np.concatenate([todo[act], got > -2.0], axis=1), at, 1)
        ids[act] = np.where(sims[act] > -2.0, ids[act], -1)
        todo[act] &= ids[act] >= 0
    return _top(sims, ids, ef)


class Hnsw:
    """The graph of a shard; ``layers[l]`` is a flat (n, width) array of neighbours, -1 pads."""

    def __init__(self, x: np.ndarray, level: np.ndarray, ef: int = EF_BUILD) -> None:
        n = len(x)
        self.order = np.argsort(-level, kind="stable")  # high levels first, so each layer is a prefix
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        self.x = np.concatenate([self.x, np.zeros((1, x.shape[1]), np.float32)])  # what -1 points to
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)] if n else []
        self.layers = [np.full((n + 1, M0 if k == 0 else M), -1, dtype=np.int32) for k in range(len(self.sizes))]
        self.kept = [np.full(g.shape, -2.0, dtype=np.float32) for g in self.layers]
        done = 0
        while done < n:
            step = min(BATCH, max(64, done), n - done)
            self._insert(done, done + step, ef)
            done += step

    def _insert(self, a: int, z: int, ef: int) -> None:
        q = self.x[a:z]
        start = np.zeros((z - a, 1), dtype=np.int32)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -2.0)
        for k in range(len(self.layers) - 1, -1, -1):
            hold = min(self.sizes[k], a)  # nodes the layer has so far
            top = min(self.sizes[k], z)  # and with this batch
            wide = self.layers[k].shape[1]
            sims = ids = None
            if hold:
                sims, ids = _search_layer(self.x, self.layers[k], q, start, ef, len(self.x) - 1)
                start = ids[:, :4]
            if top > a:
                own_s, own_i = mutual[: top - a, : top - a], np.broadcast_to(np.arange(a, top, dtype=np.int32), (top - a, top - a))
                if sims is not None:
                    own_s, own_i = np.concatenate([sims[: top - a], own_s], 1), np.concatenate([ids[: top - a], own_i], 1)
                best_s, best_i = _top(own_s, own_i, min(wide // 2, own_s.shape[1]))
                best_i = np.where(best_s > -2.0, best_i, -1)
                self._link(k, np.repeat(np.arange(a, top), best_s.shape[1]), best_i.ravel(), best_s.ravel())

    def _link(self, k: int, source: np.ndarray, target: np.ndarray, sims: np.ndarray) -> None:
        """Add edges both ways; a node keeps its nearest neighbours up to the width."""
        ok = target >= 0
        s, t, w = source[ok], target[ok], sims[ok]
        node, other, w = np.concatenate([s, t]), np.concatenate([t, s]).astype(np.int32), np.concatenate([w, w])
        graph, kept = self.layers[k], self.kept[k]
        touched = np.unique(node)
        old_i, old_s = graph[touched], kept[touched]
        node = np.concatenate([node, np.repeat(touched, old_i.shape[1])])
        other, w = np.concatenate([other, old_i.ravel()]), np.concatenate([w, old_s.ravel()])
        ok = other >= 0
        node, other, w = node[ok], other[ok], w[ok]
        at = np.lexsort((other, -w, node))
        node, other, w = node[at], other[at], w[at]
        new = np.ones(len(node), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
        node, other, w = node[new], other[new], w[new]
        first = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1]
        rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
        fit = rank < graph.shape[1]
        graph[touched], kept[touched] = -1, -2.0
        graph[node[fit], rank[fit]], kept[node[fit], rank[fit]] = other[fit], w[fit]

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(sims, rows) of the k nearest of each query, best first; row -1 pads."""
        out_s, out_i = [], []
        for a in range(0, len(q), QUERIES):
            part = np.ascontiguousarray(q[a : a + QUERIES], dtype=np.float32)
            start = np.zeros((len(part), 1), dtype=np.int32)
            for layer in range(len(self.layers) - 1, 0, -1):
                start = _search_layer(self.x, self.layers[layer], part, start, 4, len(self.x) - 1)[1][:, :2]
            s, i = _search_layer(self.x, self.layers[0], part, start, max(ef, k), len(self.x) - 1)
            out_s.append(s[:, :k])
            out_i.append(i[:, :k])
        return self._rows(out_s, out_i, k)

    def search_members(self, rows: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of the graph itself, which start from their own neighbours; a row finds itself too."""
        where = np.empty(len(self.order), dtype=np.int32)
        where[self.order] = np.arange(len(self.order))
        out_s, out_i = [], []
        for a in range(0, len(rows), QUERIES):
            at = where[rows[a : a + QUERIES]]
            s, i = _search_layer(self.x, self.layers[0], self.x[at], at[:, None], max(ef, k), len(self.x) - 1)
            out_s.append(s[:, :k])
            out_i.append(i[:, :k])
        return self._rows(out_s, out_i, k)

    def _rows(self, out_s: list, out_i: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = np.concatenate(out_s) if out_s else np.empty((0, k), np.float32)
        i = np.concatenate(out_i) if out_i else np.empty((0, k), np.int32)
        return s, np.where(i >= 0, self.order[np.clip(i, 0, max(0, len(self.order) - 1))], -1) if len(self.order) else i
