import numpy as np
import pytest

from stratalith.llm import neighbours as nb


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.round(1 - x @ x.T, 6) + 0.0
    out = {}
    for i, a in enumerate(ids):
        order = sorted((d[i, j], b) for j, b in enumerate(ids) if b != a)
        out[a] = [b for _, b in order[:k]]
    return out


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, dim))
    return (centres[rng.integers(len(centres), size=n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("shard,max_pivots", [(6_000, 16_384), (150, 16_384), (100, 2)])
def test_recall_against_brute_force(spark, shard, max_pivots):
    x = clustered(900)
    ids = list(range(10, 910))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "id int, embedding array<float>, rep int").repartition(3)
    rows = nb.nearest(df, "id", "embedding", shard=shard, max_pivots=max_pivots).collect()
    truth = brute(ids, x.astype(np.float64), 5)
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    hit = sum(len(set(got[i]) & set(truth[i])) for i in ids) / (5 * len(ids))
    assert hit >= 0.97


def test_unusable_vectors_copies_and_ties(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(i, e) for i in range(1, 9)] + [(20, [0.0, 1.0, 0.0]), (21, None), (22, []), (23, [0.0, 0.0, 0.0]), (24, [1.0]), (25, [float("nan"), 0.0, 0.0]), (26, [2.0, 0.0, 0.0]), (None, e), (20, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got: dict[int, list] = {}
    for r in nb.nearest(df, "id", "embedding", dim=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got[1] == [2, 3, 4, 5, 6] and got[3] == [1, 2, 4, 5, 6] and got[8] == [1, 2, 3, 4, 5] and got[26] == [1, 2, 3, 4, 5] and got[20] == [1, 2, 3, 4, 5]
    assert set(got) == {*range(1, 9), 20, 26}
    pairs = {(r.id_a, r.id_b) for r in nb.pairs_of(nb.nearest(df, "id", "embedding", dim=3)).collect()}
    assert (1, 20) in pairs and all(a < b for a, b in pairs)
    assert nb.nearest(df.limit(0), "id", "embedding").count() == 0
    assert nb.nearest(df.where("id between 21 and 23"), "id", "embedding", dim=3).count() == 0
    assert nb.nearest(df.where("id = 1"), "id", "embedding").count() == 0


def test_pruning_keeps_diverse_edges():
    x = clustered(400)
    g = nb.Graph(x / np.linalg.norm(x, axis=1)[:, None], degree=8)
    assert (g.edges[:400] <= 400).all() and (g.count <= g.room).all()
    found, sim = g.search(g.x[:50], 16)
    assert (found[:, 0] == np.arange(50)).mean() > 0.9 and (np.diff(sim, axis=1) <= 1e-6).all()


def test_pivots_grow_with_the_points():
    plan = lambda n: nb.pivot_plan(n, 6_000, 10_000, 16_384)
    assert plan(1) == (1, 10_000) and plan(120_000) == (32, 10_000)
    assert plan(18_750_000) == (5_000, 15_000) and plan(40_000_000) == (10_667, 32_001) and plan(10**10) == (16_384, 49_152)
