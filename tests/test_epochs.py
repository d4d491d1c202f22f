"""Training by epochs: gradient, history, best epoch, early end and restart."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inkgauge.operators import epochs
from inkgauge.session import work_path


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(4), []
    for i in range(400):
        x = [rng.gauss(0, 1) for _ in range(6)]
        y = int(x[0] * x[1] + x[2] > 0)
        out.append((i, x, y, "val" if i % 4 == 0 else "test" if i % 10 == 1 else "train"))
    df = spark.createDataFrame(out, "doc_id long, x array<double>, label int, split string")
    return df.withColumn("features", array_to_vector("x"))


NETWORK = epochs.Network((6, 12, 2))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    part = epochs.Rows(rng.standard_normal((20, 6)), rng.integers(0, 2, 20).astype(float))
    network, total = epochs.Network((6, 5, 4, 2)), np.zeros(epochs.Network((6, 5, 4, 2)).cells + 1)
    weights = network.start(1) + 0.1 * rng.standard_normal(network.cells)  # away from the corners of the ReLU
    network.add_gradient(weights, part, total)
    assert total[-1] == pytest.approx(network.loss(weights, part)[0])
    for j in range(0, network.cells, 7):
        step = np.zeros(network.cells)
        step[j] = 1e-6
        slope = (network.loss(weights + step, part)[0] - network.loss(weights - step, part)[0]) / 2e-6
        assert slope == pytest.approx(total[j], abs=1e-5)


def test_a_broken_run_goes_on_as_an_unbroken_one(spark, rows):
    table = epochs.mini_batches(rows, 3, "doc_id")
    whole, broken = work_path(spark, "whole"), work_path(spark, "broken")
    told = epochs.train(table, NETWORK, whole, epochs=5).orderBy("epoch").collect()
    for last in (2, 3, 5):
        again = epochs.train(epochs.mini_batches(rows.repartition(5), 3, "doc_id"), NETWORK, broken, epochs=last)
    again = again.orderBy("epoch").collect()
    assert [r.epoch for r in told] == [r.epoch for r in again] == [1, 2, 3, 4, 5]
    for a, b in zip(told, again):
        assert (a.train_samples, a.val_samples) == (b.train_samples, b.val_samples) == (260, 100)
        assert (a.train_loss, a.val_loss, a.val_f1) == pytest.approx((b.train_loss, b.val_loss, b.val_f1), rel=1e-9)
    assert told[-1].train_loss < told[0].train_loss and told[-1].val_f1 > 0.6
    best, weights = epochs.best_weights(spark, whole)
    assert best == max(told, key=lambda r: (r.val_f1, -r.epoch)).epoch
    assert (weights == epochs.saved_epoch(spark, whole, best)["weights"]).all()
    assert epochs.recomputed_history(rows, NETWORK, whole).where(~F.col("recomputed")).count() == 0


def test_early_end(spark, rows):
    table, path = epochs.mini_batches(rows, 1, "doc_id"), work_path(spark, "early")
    told = epochs.train(table, NETWORK, path, epochs=6, patience=1, rate=0.0).collect()
    assert len(told) == 2  # without a step the second epoch is no better
