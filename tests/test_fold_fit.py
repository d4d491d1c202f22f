"""Leave-one-out fits by one optimiser against single fits, and their metrics against the plain ones."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inkgauge.operators import fold_fit, metrics, models, splits, tfidf

SCHEMA = "doc_id long, source string, split string, label int, text string, perplexity double, burstiness double"


def corpus(spark, n=240, sources="abc", seed=3):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(n):
        label = rng.randint(0, 1)
        text = " ".join(rng.choices(words, [1 + label * (j % 3) for j in range(30)], k=rng.randint(0, 25)))
        perplexity = None if i % 17 == 0 else rng.uniform(0.5, 4)
        rows.append((i, rng.choice(sources), rng.choice(["train", "train", "val", "test"]), label, text, perplexity, rng.uniform(0, 9)))
    return spark.createDataFrame(rows, SCHEMA)


def fitted(df, k=40, tol=1e-9, only=None):
    terms = tfidf.T.terms(F.col("text"))
    pool = splits.train_pool(df)
    sizes = {r.held_out_source: r.train_samples for r in splits.holdout_folds(df).orderBy("held_out_source").collect()}
    sizes = {s: n for s, n in sizes.items() if only in (None, s)}
    vocab = tfidf.held_out_vocab(tfidf.term_stats(pool, ["source"], terms), "source", k)
    vocab = vocab.where(F.col("held_out_source").isin(list(sizes))).select("held_out_source", "term", "df").toPandas()
    table = fold_fit.fold_table(vocab, sizes)
    rows = fold_fit.blocks(df, table, "source", terms, size=16)
    return rows, fold_fit.fit_folds(rows, table, tol=tol)


def by_term(result, at):
    named = zip([*result.folds.terms, "perplexity", "burstiness", "intercept"], result.coefficients[at])
    used = [*(result.folds.idf[at] > 0), True, True, True]
    return {t: w for (t, w), u in zip(named, used) if u}


def test_folds_equal_single_fits(spark):
    df = corpus(spark)
    rows, together = fitted(df)
    assert (together.residuals <= 1e-9).all()
    counts = fold_fit.held_out_counts(rows, together)
    scans = []
    for i, source in enumerate(together.folds.names):
        alone = fitted(df, only=source)[1]
        scans.append(alone.scans)
        mine, single = by_term(together, i), by_term(alone, 0)
        assert mine.keys() == single.keys()
        assert max(abs(mine[t] - single[t]) for t in mine) < 1e-6
        # Spark's own fit of the same fold
        train, test = splits.holdout_rows(df, source)
        vocab = tfidf.fit(train, 40)
        ready = features(train, vocab)
        spark_ml = LogisticRegression(regParam=1 / ready.count(), standardization=False, tol=1e-14, maxIter=500)
        model = spark_ml.fit(ready)
        theirs = dict(zip([*vocab.terms, "perplexity", "burstiness"], model.coefficients.toArray()))
        assert {t for t in mine if t != "intercept"} == set(theirs)
        assert max(abs(mine[t] - theirs[t]) for t in theirs) < 1e-4
        assert mine["intercept"] == pytest.approx(model.intercept, abs=1e-3)
        own = models.fit_logistic(ready, tol=1e-9)
        assert np.abs(own.coefficients.toArray() - model.coefficients.toArray()).max() < 1e-4
        m = metrics.binary_metrics(models.predict(model, features(test, vocab))).first()
        tn, fp, fn, tp = counts[i]
        assert (tn + tp) / counts[i].sum() == pytest.approx(m.accuracy)
    # as many scans as the slowest fold needs, not their sum
    assert together.scans <= max(scans) + 3 < sum(scans)


def features(df, vocab):
    filled = vocab.transform(df).withColumn("perplexity", F.coalesce("perplexity", F.lit(0.0)))
    return VectorAssembler(inputCols=["tfidf", "perplexity", "burstiness"], outputCol="features").transform(filled)


def test_gradient_is_that_of_the_loss(spark):
    rows, result = fitted(corpus(spark, 60))
    rng = np.random.default_rng(1)
    points = rng.standard_normal(result.coefficients.shape) * 0.01
    every = np.ones(len(points), bool)
    loss, gradient = fold_fit.losses(rows, result.folds, points, every, 2.0)
    for j in (0, 5, -3, -2, -1):
        step = np.zeros(points.shape)
        step[:, j] = 1e-5
        up, down = (fold_fit.losses(rows, result.folds, points + s * step, every, 2.0)[0] for s in (1, -1))
        assert (up - down) / 2e-5 == pytest.approx(gradient[:, j], rel=1e-4, abs=1e-3)


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(fold_fit, "FAN_IN", 2)
    monkeypatch.setattr(fold_fit, "SLICE", 3)
    rows = [(p, i, np.full(2, float(p + i)).tobytes()) for p in range(9) for i in range(4)]
    df = spark.createDataFrame(rows, "part int, slice int, values binary")
    assert fold_fit._tree_sum(df, 9).tolist() == [36.0 + 9 * i for i in range(4) for _ in range(2)]


def test_held_out_table(spark):
    df = corpus(spark)
    out = models.source_held_out(df, k=40).collect()
    sizes = {r.held_out_source: (r.train_samples, r.test_samples) for r in splits.holdout_folds(df).collect()}
    assert {r.held_out_source: (r.train_samples, r.test_samples) for r in out} == sizes
    assert all(r.status == "ok" and r.residual <= 1e-6 and 0 <= r.f1 <= 1 for r in out)


def test_too_many_folds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_FOLDS", 2)
    with pytest.raises(ValueError, match="sources"):
        models.source_held_out(corpus(spark))
    monkeypatch.setattr(fold_fit, "MAX_CELLS", 50)
    with pytest.raises(ValueError, match="coefficients"):
        fitted(corpus(spark))


def test_norms_in_blocks_change_nothing(spark, monkeypatch):
    df = corpus(spark, 80)
    rows, held = fitted(df)
    monkeypatch.setattr(fold_fit, "NORMS", 0)
    plain, again = fitted(df)
    kept = [[b.norms is not None for b in fold_fit._unpacked([x.select("block").toArrow()], fold_fit.Block)] for x in (rows, plain)]
    assert all(kept[0]) and not any(kept[1])
    assert np.abs(held.coefficients - again.coefficients).max() < 1e-8
    assert (fold_fit.held_out_counts(rows, held) == fold_fit.held_out_counts(plain, again)).all()


def test_a_long_memory_needs_fewer_steps():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    a, b = q * np.logspace(0, 3, 80) @ q.T, rng.standard_normal(80)

    def steps(memory):
        state, n = fold_fit._Fold(np.zeros(80), 0.0, -b, np.ones(80), 1e-6, memory), 0
        while not state.done:
            w, n = state.trial(), n + 1
            state.tell(w @ a @ w / 2 - b @ w, a @ w - b)
        assert np.abs(a @ state.point - b).max() <= 1e-6
        return n

    assert steps(fold_fit.MEMORY) < 0.8 * steps(10)


def test_the_memory_is_bounded_in_numbers(spark, monkeypatch):
    seen = []
    fold = fold_fit._Fold
    monkeypatch.setattr(fold_fit, "_Fold", lambda *args: seen.append(args[-1]) or fold(*args))
    rows, result = fitted(corpus(spark, 40))
    monkeypatch.setattr(fold_fit, "HISTORY", 20 * result.coefficients.size)
    fold_fit.fit_folds(rows, result.folds)
    monkeypatch.setattr(fold_fit, "HISTORY", 0)
    fold_fit.fit_folds(rows, result.folds, max_iter=1)
    assert set(seen) == {fold_fit.MEMORY, 20, 10}


def test_a_sample_of_the_rows_shortens_a_fit():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 40)) @ (np.linalg.qr(rng.standard_normal((40, 40)))[0] * np.logspace(1, -2, 40)).T
    y = (x @ rng.standard_normal(40) + rng.logistic(size=600) > 0).astype(float)
    some, bound = np.arange(0, 600, 3), np.r_[(x**2).sum(axis=0) / 4 + 1, 1, 1, 150]
    rows = fold_fit.Block(
        np.full(200, -1), np.zeros(200, bool), y[some], np.zeros((200, 2)), 40 * np.arange(201), np.tile(np.arange(40), 200), x[some].ravel(), True
    )

    def steps(sampled):
        def found(w):
            z, own = x @ w[:40] + w[-1], np.r_[w[:-1], 0]
            error = 1 / (1 + np.exp(-z)) - y
            return np.logaddexp(0, (1 - 2 * y) * z).sum() + own @ own / 2, np.r_[x.T @ error, 0, 0, error.sum()] + own

        state, n = fold_fit._Fold(np.zeros(43), *found(np.zeros(43)), bound, 1e-6, fold_fit.MEMORY), 0
        if sampled:
            state.use(fold_fit._Sampled(rows, np.ones(40), bound, 3.0))
        while not state.done and n < 500:
            state.tell(*found(state.trial()))
            n += 1
        assert state.residual <= 1e-6
        return n, state.point

    (short, near), (plain, there) = steps(True), steps(False)
    assert 2 * short < plain
    assert np.abs(near - there).max() < 1e-4


def test_kept_blocks_give_the_same_sums(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(rng.standard_normal(4).tolist(), i % 2) for i in range(90)], "v array<double>, label int")
    rows, folds = fold_fit.vector_blocks(df.select("label", array_to_vector("v").alias("features")), "features", "label", size=10)
    point, on = rng.standard_normal((1, 7)), np.ones(1, bool)
    kept = fold_fit._held(rows, 8)
    near, there = fold_fit.losses(rows, folds, point, on, 1.0, kept), fold_fit.losses(rows, folds, point, on, 1.0)
    assert near[0] == pytest.approx(there[0]) and near[1] == pytest.approx(there[1])
    assert len(fold_fit._sample(kept, 90, 1000).label) == 90
    assert fold_fit._held(rows, fold_fit.AT_ONCE) is None or rows.rdd.getNumPartitions() == 1
    kept.unpersist()
    assert fold_fit.fit_folds(rows, folds).residuals[0] <= 1e-6


def test_blocks_of_many_parts_are_kept_in_fewer(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(rng.standard_normal(4).tolist(), i % 2) for i in range(60)], "v array<double>, label int")
    rows, _ = fold_fit.vector_blocks(df.select("label", array_to_vector("v").alias("features")).repartition(40), "features", "label")
    cores = spark.sparkContext.defaultParallelism
    many = rows.repartition(4 * cores)
    monkeypatch.setattr(fold_fit, "AT_ONCE", 8 * cores)  # sums of as many tasks as there are cores
    kept = fold_fit._held(many, 8)
    assert kept is not None and kept.getNumPartitions() == cores
    assert len(fold_fit._sample(kept, 60, 1000).label) == 60
    kept.unpersist()
    assert fold_fit._held(many, 9) is None
