"""A hierarchical navigable small-world graph of unit vectors, as flat neighbour arrays.

Vectors are inserted in batches, each searched against the graph so far for all its members at
once.  The first n/16 vectors, as they were linked when only they were in the graph, are the level
above the whole graph, the first n/256 the one above that, and so on; a search starts at the best
of the few vectors at the top and goes down level by level.
"""

from __future__ import annotations

import numpy as np

DEGREE, FIND, RATIO, TOP, BATCH = 16, 48, 16, 128, 2048


def _dots(vecs: np.ndarray, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vecs[ids], queries[rows])


def beam_search(vecs: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``ef`` best found for each query, best first, -1 where there are fewer.

    ``near`` has the neighbours of each vector of the level, -1 for none; ``entry`` the vectors that
    each search starts from, -1 for none.
    """
    size = len(near)
    ids, sims = np.full((len(queries), ef), -1, np.int32), np.full((len(queries), ef), -np.inf, np.float32)
    step = max(64, min(1024, 32_000_000 // (size + 1)))  # visited marks of one step: 32 MB
    for at in range(0, len(queries), step):
        part = slice(at, at + step)
        ids[part], sims[part] = _beam(vecs, near, queries[part], entry[part], ef, expand, size)
    return ids, sims


def _beam(vecs, near, queries, entry, ef, expand, size):
    count = len(queries)
    seen = np.zeros((count, size + 1), np.uint8)
    out_ids, out_sims = np.full((count, ef), -1, np.int32), np.full((count, ef), -np.inf, np.float32)
    rows = np.arange(count)
    ids, sims, done = out_ids.copy(), out_sims.copy(), np.ones((count, ef), bool)
    fresh = entry.astype(np.int32)
    while True:
        # Keep of the fresh vectors those that no search has met, each once.
        fresh = np.where(fresh < 0, size, fresh)
        first = seen[rows[:, None], fresh] == 0
        column = np.arange(1, fresh.shape[1] + 1, dtype=np.uint8)[None, :]
        marks = np.where(first, column, seen[rows[:, None], fresh])
        seen[rows[:, None], fresh] = marks
        first &= (seen[rows[:, None], fresh] == column) & (fresh < size)
        r, c = np.nonzero(first)
        if len(r):
            found = fresh[r, c]
            like = _dots(vecs, found, queries, rows[r])
            good = like > sims[r, -1]
            r, found, like = r[good], found[good], like[good]
            per = np.bincount(r, minlength=len(rows))
            width = int(per.max(initial=0))
            if width:
                slot = np.arange(len(r)) - np.repeat(np.cumsum(per) - per, per)
                more_ids, more_sims = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), -np.inf, np.float32)
                more_ids[r, slot], more_sims[r, slot] = found, like
                all_ids, all_sims = np.hstack([ids, more_ids]), np.hstack([sims, more_sims])
                all_done = np.hstack([done, more_ids < 0])
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
                ids, sims, done = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        open_ = ~done.all(axis=1)
        if not open_.all():
            ended = rows[~open_]
            out_ids[ended], out_sims[ended] = ids[~open_], sims[~open_]
            if not open_.any():
                return out_ids, out_sims
            rows, ids, sims, done = rows[open_], ids[open_], sims[open_], done[open_]
        pick = np.sort(np.where(done, ef, np.arange(ef)), axis=1)[:, :expand]
        there = pick < ef
        pick = np.minimum(pick, ef - 1)
        chosen = np.where(there, np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        fresh = np.where(chosen[:, :, None] < 0, -1, near[chosen]).reshape(len(rows), -1)


def select(vecs: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates, best first, up to ``degree`` that are nearer to the row's vector
    than to any candidate selected before, so that links lead into different directions."""
    out_ids, out_sims = np.full((len(ids), degree), -1, np.int32), np.full((len(ids), degree), -np.inf, np.float32)
    width = ids.shape[1]
    for at in range(0, len(ids), 1024):
        i, s = ids[at : at + 1024], sims[at : at + 1024]
        v = vecs[np.maximum(i, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        blocked, taken = np.full(i.shape, -np.inf, np.float32), np.zeros(len(i), np.int64)
        for c in range(width):
            ok = (i[:, c] >= 0) & (s[:, c] >= blocked[:, c]) & (taken < degree)
            k = np.flatnonzero(ok)
            out_ids[at + k, taken[k]], out_sims[at + k, taken[k]] = i[k, c], s[k, c]
            taken[k] += 1
            blocked[k] = np.maximum(blocked[k], among[k, c])
    return out_ids, out_sims


class Graph:
    """The graph of ``vecs``; their order should be random."""

    def __init__(self, vecs: np.ndarray, degree: int = DEGREE, find: int = FIND):
        self.vecs, self.degree = np.ascontiguousarray(vecs, np.float32), degree
        n = len(vecs)
        sizes = [n]
        while sizes[-1] > TOP:
            sizes.append(max(1, sizes[-1] // RATIO))
        self.top = sizes[-1]
        self.levels: list[np.ndarray] = []  # the finished levels above, from the top
        self.near, self.sims = np.full((n, degree), -1, np.int32), np.full((n, degree), -np.inf, np.float32)
        begin = 0
        for size in reversed(sizes):
            while begin < size:
                end = min(size, begin + max(TOP, min(BATCH, begin)))
                self._insert(begin, end, find)
                begin = end
            if size < n:
                self.levels.append(self.near[:size].copy())

    def _insert(self, begin: int, end: int, find: int) -> None:
        new = self.vecs[begin:end]
        own = new @ new.T  # the batch's members among each other
        np.fill_diagonal(own, -np.inf)
        k = min(self.degree, end - begin - 1)
        best = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((end - begin, 0), np.int64)
        ids, sims = (best + begin).astype(np.int32), np.take_along_axis(own, best, 1)
        if begin:
            old_ids, old_sims = self._search(new, find, begin)
            ids, sims = np.hstack([old_ids, ids]), np.hstack([old_sims, sims])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :find]
        self.near[begin:end], self.sims[begin:end] = select(self.vecs, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), self.degree)
        self._link_back(begin, end)

    def _link_back(self, begin: int, end: int) -> None:
        new = np.repeat(np.arange(begin, end, dtype=np.int32), self.degree)
        to, like = self.near[begin:end].ravel(), self.sims[begin:end].ravel()
        keep = to >= 0
        new, to, like = new[keep], to[keep], like[keep]
        order = np.lexsort((new, -like, to))
        new, to, like = new[order], to[order], like[order]
        nodes, start, per = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(start, per)
        keep = slot < self.degree
        row = np.repeat(np.arange(len(nodes)), per)[keep]
        width = int(slot[keep].max(initial=-1)) + 1
        more_ids, more_sims = np.full((len(nodes), width), -1, np.int32), np.full((len(nodes), width), -np.inf, np.float32)
        more_ids[row, slot[keep]], more_sims[row, slot[keep]] = new[keep], like[keep]
        known = (self.near[nodes][:, :, None] == more_ids[:, None, :]).any(axis=1) & (more_ids >= 0)
        more_ids[known], more_sims[known] = -1, -np.inf
        ids, sims = np.hstack([self.near[nodes], more_ids]), np.hstack([self.sims[nodes], more_sims])
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids >= 0).sum(axis=1) > self.degree
        self.near[nodes[~full]], self.sims[nodes[~full]] = ids[~full, : self.degree], sims[~full, : self.degree]
        if full.any():
            self.near[nodes[full]], self.sims[nodes[full]] = select(self.vecs, ids[full], sims[full], self.degree)

    def _search(self, queries: np.ndarray, ef: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        top = min(self.top, size)
        few = min(4, top)
        entry = np.argpartition(-(queries @ self.vecs[:top].T), few - 1, axis=1)[:, :few]
        for level in self.levels[1:]:
            entry = beam_search(self.vecs, level, queries, entry, 8)[0]
        return beam_search(self.vecs, self.near[:size], queries, entry, ef)

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``ef`` most similar vectors found, best first."""
        if not len(self.vecs):
            return np.full((len(queries), ef), -1, np.int32), np.full((len(queries), ef), -np.inf, np.float32)
        return self._search(np.ascontiguousarray(queries, np.float32), ef, len(self.vecs))

    def search_own(self, rows: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for vectors of the graph, from their own links; each finds itself too."""
        entry = np.hstack([rows[:, None], self.near[rows]]).astype(np.int32)
        return beam_search(self.vecs, self.near, self.vecs[rows], entry, ef)


def improve(vecs: np.ndarray, queries: np.ndarray, found: np.ndarray, lists: np.ndarray, few: int = 8) -> np.ndarray:
    """The best of what each query found and of the lists of the ``few`` best of these, best first.

    ``found`` has a query's vectors, ``lists`` those of each vector, -1 where there are fewer.
    """
    out = np.full_like(found, -1)
    width = found.shape[1]
    for at in range(0, len(found), 1024):
        own = found[at : at + 1024]
        more = np.where(own[:, :few, None] >= 0, lists[own[:, :few]], -1).reshape(len(own), -1)
        ids = np.sort(np.hstack([own, more]), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.matmul(vecs[np.maximum(ids, 0)], queries[at : at + 1024, :, None])[:, :, 0]
        sims[ids < 0] = -np.inf
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1)
        out[at : at + 1024] = np.where(np.isfinite(np.take_along_axis(sims, best, 1)), np.take_along_axis(ids, best, 1), -1)
    return out


def both_ways(vecs: np.ndarray, lists: np.ndarray, most: int = 16) -> np.ndarray:
    """The lists with, for each vector, the ``most`` nearest of those that list it.

    A vector that few links lead to is hard to find, but it finds its own neighbours.
    """
    to, frm = lists.ravel(), np.repeat(np.arange(len(lists), dtype=np.int32), lists.shape[1])
    keep = (to >= 0) & (to != frm)
    to, frm = to[keep], frm[keep]
    like = np.concatenate([_dots(vecs, frm[i : i + 65536], vecs, to[i : i + 65536]) for i in range(0, len(to), 65536)] or [np.zeros(0, np.float32)])
    order = np.lexsort((-like, to))
    to, frm = to[order], frm[order]
    per = np.bincount(to, minlength=len(lists))
    slot = np.arange(len(to)) - np.repeat(np.cumsum(per) - per, per)
    out = np.full((len(lists), most), -1, np.int32)
    out[to[slot < most], slot[slot < most]] = frm[slot < most]
    return np.hstack([lists, out])
