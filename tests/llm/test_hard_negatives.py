"""op12 against brute force with Python integers."""

import math
import random

import numpy as np
import pytest

from inkgauge.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_brute_force(rows, every):
    kept = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if vec_id % 7 == 0 else label, v)
        kept[vec_id] = min(kept.get(vec_id, own), own)
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items()}
        order = sorted((i for i in rows if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:5]:
            fit = [i for i in order if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:3])]
    return sorted(out)


def table(rng, n, d, size=0.3, step=0.0):
    value = lambda: rng.gauss(size / 4, size) if not step else rng.choice([0.0, step, -step])
    return [(i, [value() for _ in range(d)], rng.randint(0, 3) if i % 3 else 2) for i in range(n)]


@pytest.mark.parametrize(
    "n, d, size, step",
    [(0, 3, 0.3, 0), (1, 3, 0.3, 0), (2, 4, 0.3, 0), (30, 5, 0.3, 0), (300, 16, 0.3, 0), (200, 4, 0, 0.25), (90, 6, 3e4, 0), (60, 3, 1e6, 0)],
)
def test_negatives(spark, monkeypatch, n, d, size, step):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    rows = table(random.Random(n + d), n, d, size, step)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives.mine(df, every=3).collect())) == by_brute_force(rows, 3)


def test_rows_that_take_no_part(spark):
    rows = table(random.Random(4), 80, 4)
    rows += [
        (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 2),
        (None, [0.5] * 4, 1), (204, [0.5] * 4, None), (205, [], 1), (210, [0.7], 2), (211, [0.2] * 6, 1), (3, [0.9] * 4, 0),
        (6, rows[6][1], rows[6][2]), (220, [0.0] * 4, 1), (-6, [0.4, 0.1, 0.0, 0.3], -1), (-7, [0.4, 0.1, 0.0, 0.3], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "'x' AS Label", "2 AS block", "3 AS VEC_ID")
    # -7 shifts like Spark: the remainder keeps the sign
    assert sorted(map(tuple, hard_negatives.mine(df, every=3).collect())) == by_brute_force(rows, 3)


def test_scores_outside_64_bits_are_refused(spark):
    rows = [(i, [1e30, 1e30], i % 2) for i in range(8)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), every=1).collect()


@pytest.mark.parametrize("largest", [1, 40, 300, 70_000, 1 << 40])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest % 97)
    a, c = rng.integers(-largest, largest, (7, 9), endpoint=True), rng.integers(-largest, largest, (50, 9), endpoint=True)
    a[0], a[1], c[0], c[1] = largest, -largest, largest, -largest
    at = hard_negatives.layout(int(np.abs(a).sum(axis=1).max()), largest)
    assert at.word == (largest <= 300) and (not at.word or at.fields * at.bits <= 64 and at.fields >= 2)
    a, c = (x if at.word else x.astype(object) for x in (a, c))
    assert (hard_negatives.products(a, hard_negatives.pack(c, at), 50, at) == a.astype(object) @ c.astype(object).T).all()
