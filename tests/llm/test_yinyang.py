"""Clusters against full scans, and tables with odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import yinyang

KIND = "vec_id long, embedding array<float>, q string, cluster int"


def brute(ids, rows, first, rounds):
    q = np.floor(64 * np.array(rows, np.float32).astype(np.float64)).astype(np.int64)
    c = first.copy()
    for r in range(rounds + 1):
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = [int(s) // int((own == k).sum()) for s in q[own == k].sum(0)]
    return {i: (int(a), int(x[a])) for i, a, x in zip(ids, own, d, strict=True)}, c


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_equal_full_scans(spark, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 64))
    rows = (middle[rng.integers(0, 9, 700)] + spread * rng.normal(size=(700, 64))).astype(np.float32)
    rows[600:650] = rows[:50]  # repeated vectors
    rows[650:] = np.round(rows[650:])  # and ties
    df = spark.createDataFrame([(i, r.tolist(), "x", 1) for i, r in enumerate(rows)], KIND).repartition(3)
    kept = yinyang.quantised(df)
    want, centroids = brute(range(700), rows, yinyang.first_centroids(kept, 16), 5)
    table, got = yinyang.clusters(df, 16, 5)
    assert (got == centroids).all()
    assert {r.vec_id: (r.cluster, r.distance) for r in table.collect()} == want
    if spread < 1:
        assert table.agg(F.avg("taken")).first()[0] < 4  # the last round takes few of 16 distances


def test_bounds_hold_over_many_rounds():
    rng = np.random.default_rng(4)
    q = rng.integers(-60, 60, (800, 8))
    c = q[:12].copy()
    group = yinyang.grouped(c)
    assert sorted(set(group)) == list(range(group.max() + 1)) and group.max() == 2
    state, saved = yinyang.scan(q, c, group), 0
    for _ in range(12):
        new = np.array([np.floor(q[state[0] == k].mean(0)) if (state[0] == k).any() else c[k] for k in range(12)]).astype(np.int64)
        moved, c = np.sqrt(((new - c) ** 2).sum(1)), new
        state = yinyang.update(q, *state[:3], c, group, moved)
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        assert (state[1] * (1 + 1e-9) + 1e-9 >= np.sqrt(d.min(1))).all()
        others = np.where(np.arange(12) == state[0][:, None], np.inf, np.sqrt(d))
        for g in range(group.max() + 1):
            assert (state[2][:, g] * (1 - 1e-9) - 1e-9 <= others[:, group == g].min(1)).all()
        saved += 12 * len(q) - state[3].sum()
    assert saved > 0


def test_distances_of_large_components():
    rng = np.random.default_rng(5)
    q, c = (rng.integers(-(1 << 27), 1 << 27, (n, 64)) for n in (20, 5))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    assert yinyang.distances(q, c).tolist() == want and yinyang.between(q, c[[0] * 20]).tolist() == [w[0] for w in want]


def test_odd_vectors(spark):
    one = [0.5] * 64
    rows = [
        (1, one), (1, one), (2, None), (3, []), (4, one[:63]), (5, [*one[:63], None]), (6, [*one[:63], float("nan")]), (7, [*one[:63], float("-inf")]),
        (8, [*one[:63], 3e38]), (None, [-0.001] * 64), (9, [*one, 1.0]), (10, [0.0] * 64),
    ]
    df = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], KIND)
    got = yinyang.summary(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == [-1, 1, 1, 10]
    assert {r.distance for r in got} == {0} and {r.inertia for r in got} == {0} and len({r.centroid_sha256 for r in got}) == 3
    assert got[0].cluster_inertia == 0
    none = yinyang.summary(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="k must"):
        yinyang.summary(df, k=10**6)
    far = spark.createDataFrame([(i, [3e6 * (-1) ** i] * 64, "", 0) for i in range(2)] + [(2, [1e6] * 64, "", 0)], KIND)
    assert [r.vec_id for r in yinyang.summary(far, k=1).collect()] == [2]
