"""The most similar of some thousand vectors, by comparing all of them in blocks."""

from __future__ import annotations

import numpy as np

#: Queries compared at a time; likenesses of which only the greatest is looked at first.
BLOCK, LANES = 256, 32


def nearest_rows(base: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, likenesses) of the k rows of ``base`` most similar to each query, in any order.

    The k greatest likenesses lie in the k groups of columns with the greatest maxima, so only
    those groups are searched.
    """
    n, k = len(base), min(k, len(base))
    ids, sims = np.empty((len(query), k), np.int64), np.empty((len(query), k), np.float32)
    if not k:
        return ids, sims
    there, groups = np.ascontiguousarray(base.T, np.float32), -(-n // LANES)
    like = np.full((BLOCK, LANES * groups), -np.inf, np.float32)
    lanes = groups * np.arange(LANES)
    for at in range(0, len(query), BLOCK):
        some = np.ascontiguousarray(query[at : at + BLOCK], np.float32)
        here = like[: len(some)]
        here[:, :n] = some @ there
        if groups > 2 * k:
            most = here.reshape(len(some), LANES, groups).max(axis=1)
            top = np.argpartition(most, groups - k, axis=1)[:, groups - k :]
            columns = (top[:, :, None] + lanes).reshape(len(some), -1)
            values = np.take_along_axis(here, columns, 1)
        else:
            columns, values = np.broadcast_to(np.arange(n), (len(some), n)), here[:, :n]
        best = np.argpartition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :]
        ids[at : at + BLOCK] = np.take_along_axis(columns, best, 1)
        sims[at : at + BLOCK] = np.take_along_axis(values, best, 1)
    return ids, sims
