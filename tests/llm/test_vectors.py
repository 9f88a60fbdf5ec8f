import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lorespark.llm import clusters, hnsw, neighbours, nndescent, vectors

SCHEMA = "vec_id int, dim int, v array<float>"


def blobs(n, groups, seed=0, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = centre[rng.integers(groups, size=n)] + noise * rng.standard_normal((n, 64))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def table(spark, v):
    odd = [(90_001, 64, None), (90_002, 64, []), (90_003, 64, [1.0] * 63), (90_004, 32, [1.0] * 64), (90_005, 64, [0.0] * 64), (90_006, 64, [float("nan")] + [1.0] * 63), (90_007, 64, [float("inf")] + [1.0] * 63), (90_008, None, [1.0] * 64), (None, 64, [1.0] * 64), (90_009, 64, [None] + [1.0] * 63)]
    return spark.createDataFrame([(i, 64, [float(x) for x in row]) for i, row in enumerate(v)] + odd, SCHEMA).repartition(3)


def cosines(v):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


@pytest.fixture(scope="module")
def points():
    v = blobs(700, 14)
    v[100:112] = v[5]  # copies
    v[300] = 3 * v[5]  # same direction, another length
    return v


@pytest.mark.parametrize("rows", [4096, 150])
def test_nearest_against_brute_force(spark, points, rows):
    got = {}
    for r in neighbours.nearest(table(spark, points), shard_rows=rows).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.near_id, r.cosine)
    s, n = cosines(points), len(points)
    assert set(got) == set(range(n))
    hits = 0
    for i in range(n):
        row = s[i].copy()
        row[i] = -9
        want = np.lexsort((np.arange(n), -row))[:5]
        assert len(got[i]) == 5 and i not in {a for a, _ in got[i].values()}
        assert all(abs(s[i, a] - c) < 2e-6 for a, c in got[i].values())
        hits += len({a for a, _ in got[i].values()} & set(want.tolist()))
    assert hits / (5 * n) >= 0.98
    copies = sorted([5, 300, *range(100, 112)])
    assert [a for a, _ in (got[110][k] for k in range(1, 6))] == copies[:5]
    assert [a for a, _ in (got[5][k] for k in range(1, 6))] == copies[1:6]


@pytest.mark.parametrize("rows", [None, 120])
def test_groups_against_brute_force(spark, points, rows):
    v = np.vstack([points, blobs(40, 40, 9), np.repeat(blobs(1, 1, 5), 30, axis=0)])
    s, n = cosines(v), len(v)
    label = np.arange(n)
    for i in range(n):
        for j in np.flatnonzero(s[i, :i] >= 0.8):
            a, b = sorted((label[i], label[j]))
            label[label == b] = a
    got = {r.vec_id: r.first_vec_id for r in clusters.grouped(table(spark, v), shard_rows=rows).collect()}
    assert got == {i: int(label[i]) for i in range(n)}


def test_described_groups(spark, points):
    members = clusters.grouped(table(spark, points))
    for r in clusters.described(members).collect():
        assert r.size > 1 and 1 <= len(r.typical) <= 5


def test_few_and_no_vectors(spark):
    for n in (0, 1, 2, 3):
        df = table(spark, blobs(n, 1) if n else np.zeros((0, 64), np.float32))
        assert neighbours.nearest(df).count() == n * (n - 1)
        assert clusters.grouped(df).filter("vec_id != first_vec_id").count() == max(0, n - 1)


def test_graph_recall():
    v = blobs(4000, 6, 3, 0.08)
    order = np.random.default_rng(1).permutation(len(v))
    graph = hnsw.Graph(v[order])
    s = v[order] @ v[order].T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    found = graph.search_own(np.arange(len(v)), 64)[0][:, 1:6]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(want, found)]) / 5 >= 0.9
    out = graph.search(v[:50], 40)[0][:, 0]
    assert np.allclose(v[order][out], v[:50])


def test_descent_and_communities():
    v = blobs(900, 9, 4)
    ids, sims = nndescent.neighbour_descent(v, 8, 6)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    assert np.mean([len(set(a) & set(np.argsort(-r)[:8])) for a, r in zip(ids, s)]) / 8 >= 0.9
    a, b = [0, 1, 0, 3, 4, 3, 2], [1, 2, 2, 4, 5, 5, 3]  # two triangles with a link
    label = nndescent.communities(6, np.array(a), np.array(b), np.ones(7))
    assert len(set(label[:3])) == 1 == len(set(label[3:])) and label[0] != label[3]


def test_shards_have_partitions_of_their_own(spark):
    for count in (1, 5, 17):
        shards = vectors.Shards(np.zeros((1, 1)), np.zeros(1, int), {}, count)
        rows = [(shards.label(i), i) for i in range(count)]
        df = spark.createDataFrame(rows, "shard int, n int").repartition(count, "shard")
        assert sorted(len(p) for p in df.rdd.glom().collect()) == [1] * count


def bridged(dim=64, size=20, seed=2):
    """Two dense groups that only one pair of their outer members joins."""
    rng = np.random.default_rng(seed)
    p, q = np.eye(dim)[0], 0.81 * np.eye(dim)[0] + np.sqrt(1 - 0.81**2) * np.eye(dim)[1]
    out = [p, q]
    for end, other in ((p, q), (q, p)):
        away = -(other - (other @ end) * end)
        centre = np.cos(0.35) * end + np.sin(0.35) * away / np.linalg.norm(away)
        out += [centre + 0.01 * rng.standard_normal(dim) for _ in range(size)]
    v = np.array(out)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def chain(n, dim=64, seed=3):
    """Vectors each of which only the next and the last one are like."""
    rng, v = np.random.default_rng(seed), [np.eye(dim)[5]]
    for _ in range(n - 1):
        step = rng.standard_normal(dim)
        step -= (step @ v[-1]) * v[-1]
        v.append(0.805 * v[-1] + np.sqrt(1 - 0.805**2) * step / np.linalg.norm(step))
    return np.array(v)


@pytest.mark.parametrize("rows", [None, 50])
def test_groups_of_bridges_and_chains(spark, rows):
    v = np.vstack([bridged(), bridged(seed=7)[:, ::-1], chain(150), blobs(40, 40, 9)]).astype(np.float32)
    v = v[np.random.default_rng(0).permutation(len(v))]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    label = np.arange(len(v))
    for i, j in zip(*np.nonzero(u @ u.T >= 0.8)):
        a, b = sorted((label[i], label[j]))
        label[label == b] = a
    got = {r.vec_id: r.first_vec_id for r in clusters.grouped(table(spark, v), shard_rows=rows).collect()}
    assert got == {i: int(label[i]) for i in range(len(v))}


def test_centroids_take_little_memory(spark):
    sample = blobs(40_000, 40)
    tracemalloc.start()
    centres = vectors.fit_centroids(sample, 1024, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (1024, 64) and most < 60e6  # all likenesses at once are 164 MB and more


@pytest.mark.parametrize("most", [50, 700])
def test_sample_of_lowest_hashes(spark, most):
    v = blobs(700, 14)
    heads = vectors.classes(vectors.valid_vectors(table(spark, v))).heads
    want = [r.vec for r in heads.orderBy(vectors.F.xxhash64("rep"), "rep").limit(most).collect()]
    assert np.allclose(vectors.sampled(heads, most, 700), vectors.unit(want), atol=1e-6)


def test_nearest_of_vectors_like_no_other(spark):
    v = np.vstack([blobs(900, 3, 2, 0.04), np.random.default_rng(6).standard_normal((300, 64))]).astype(np.float32)
    s, hits = cosines(v), 0
    np.fill_diagonal(s, -9)
    got = {}
    for r in neighbours.nearest(table(spark, v), shard_rows=60).collect():  # a group is spread over two shards
        got.setdefault(r.vec_id, set()).add(r.near_id)
    for i in range(900):
        hits += len(got[i] & set(np.lexsort((np.arange(len(v)), -s[i]))[:5].tolist()))
    assert all(len(x) == 5 for x in got.values()) and len(got) == len(v) and hits == 5 * 900


def test_balls_hold_their_members():
    v = np.vstack([blobs(200, 5), [[1.0] + [0.0] * 63, [-1.0] + [0.0] * 63]]).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    root = np.r_[np.arange(200) % 40, 190, 190]  # the last two are opposite, so they have no centre
    names, centre, angle, places = clusters._balls(v, root)
    for name, c, most, some in zip(names, centre, angle, places):
        assert (np.arccos(np.clip(v[root == name] @ c, -1, 1)) <= most).all() and (root[some] == name).all()


def test_tight_groups_are_told_by_their_balls(spark):
    v = np.vstack([blobs(600, 6), np.random.default_rng(8).standard_normal((60, 64))]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frames = [clusters.group_shard(pd.DataFrame({"rep": np.arange(i, len(v), 3), "vec": [x.tobytes() for x in v[i::3]]})) for i in range(3)]
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for f in frames for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    parts = spark.createDataFrame(rows, "rep int, root int, community int, vec binary, centre binary, angle double, few binary")
    balls = parts.filter("centre is not null").select("root", "centre", "angle", "few")
    near = clusters._near_balls(parts, balls, 0.8, "int").distinct()
    assert near.filter("vec is not null").count() == 0  # no vector is compared with members of a ball
    assert near.count() == balls.count() * 2 == 36  # 6 groups in 3 shards, each with the other two


def test_groups_and_typical_members_do_not_depend_on_shards(spark, points):
    df, got = table(spark, points), []
    for rows in (None, 120):
        members = clusters.grouped(df, shard_rows=rows).cache()
        got.append(({tuple(r) for r in members.drop("community").collect()}, sorted((r.first_vec_id, r.size, *r.typical) for r in clusters.described(members).collect())))
    assert got[0] == got[1]
