"""op5 on tables and shards smaller than k, with vectors of several lengths, and for factors below one."""

import numpy as np
import pytest

from inkgauge.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def by_brute_force(rows, every, k):
    d = max((len(v) for _, v in rows), default=0)
    full = {i: np.r_[v, np.zeros(d - len(v))] for i, v in rows if any(v)}
    out = []
    for q in full:
        if q % every == 0:
            near = sorted((-float((full[i] * full[q]).sum()), i) for i in full if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("n, shard", [(0, 8192), (1, 8192), (2, 8192), (5, 8192), (20, 8192), (21, 8192), (22, 8192), (40, 8192), (40, 7), (90, 1)])
def test_small_tables_and_shards(spark, n, shard):
    rng = np.random.default_rng(n + shard)
    rows = [(i, rng.integers(-3, 4, rng.integers(1, 4)).astype(float).tolist()) for i in range(n)]
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=4, shard=shard)
    assert sorted(map(tuple, found.collect())) == by_brute_force(rows, 4, 20)


def test_recall_of_a_relaxed_tree():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((64, 32))
    points = centres[rng.integers(0, 64, 8000)] + 0.4 * rng.standard_normal((8000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = neighbours.Shard(np.arange(8000), points, 1.0, 1)
    asked = np.arange(0, 8000, 100)
    exact = np.argsort(-(points[asked] @ points.T) + 10 * (asked[:, None] == np.arange(8000)), axis=1)[:, :20]
    for factor, least in ((1.0, 1.0), (0.5, 0.97), (0.2, 0.9)):
        found = tree.search(asked, points[asked], 20, factor)
        recall = np.mean([len(set(f[0]) & set(e)) / 20 for f, e in zip(found, exact.tolist())])
        assert recall >= least, (factor, recall)
