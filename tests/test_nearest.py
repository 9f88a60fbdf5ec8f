import numpy as np
import pandas as pd
import pytest

from lorespark.operators import search


@pytest.mark.parametrize("k, n", [(5, 3000), (50, 7), (1, 1)])
def test_blocks_give_the_best_in_double_precision(monkeypatch, k, n):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 16)
    draw = np.random.default_rng(2)
    v = draw.standard_normal((n, 24)).astype(np.float32)
    v[n // 2 :] = v[: n - n // 2]  # equal ones, of which the smaller ids win
    q, ids = draw.standard_normal((40, 24)), draw.permutation(n)
    best = search.Best(q, k)
    for at in range(0, n, 1000):
        best.add(ids[at : at + 1000], pd.Series(list(v[at : at + 1000])))
    scores = np.round(q @ v.astype(np.float64).T, 6)
    for i in range(len(q)):
        order = np.lexsort((ids, -scores[i]))[:k]
        assert best.ids[i, : len(order)].tolist() == ids[order].tolist()
        assert np.allclose(best.scores[i, : len(order)], scores[i][order], atol=1e-9)
        assert np.isneginf(best.scores[i, len(order) :]).all()


def test_one_odd_vector_takes_nothing_from_others():
    v = [[1.0, 0.0], [float("nan"), 1.0], [0.5, 0.5]]
    best = search.Best(np.array([[1.0, 0.0]]), 2)
    best.add(np.array([1, 2, 3]), pd.Series(v))
    assert best.ids.tolist() == [[1, 3]]
