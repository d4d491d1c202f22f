"""Metrics, splits, decisions and models against hand-computed or brute-force results."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from inkgauge.operators import decisions, metrics, models, ngram_model, splits, tfidf
from inkgauge.operators.challenge import build_challenge
from inkgauge.operators.joins import heavy_keys, salted_join
from inkgauge.session import work_path
from inkgauge.sources import sinks

PREDICTIONS = "doc_id long, source string, label int, pred int, prob double"


def predictions(spark, labels, preds, probs, source="s"):
    rows = [(i, source, y, p, q) for i, (y, p, q) in enumerate(zip(labels, preds, probs))]
    return spark.createDataFrame(rows, PREDICTIONS)


def brute_auc(labels, probs):
    pos = [p for y, p in zip(labels, probs) if y == 1]
    neg = [p for y, p in zip(labels, probs) if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics_by_hand(spark):
    m = metrics.metrics(predictions(spark, [1, 1, 0, 0], [1, 0, 1, 0], [0.9, 0.4, 0.6, 0.4])).first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.roc_auc) == (0.5, 0.5, 0.5, 0.5, 0.625)


def test_no_positive_prediction_gives_zero(spark):
    m = metrics.metrics(predictions(spark, [1, 0], [0, 0], [0.1, 0.2])).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_one_class_has_no_auc(spark):
    m = metrics.metrics(predictions(spark, [1, 1], [1, 0], [0.7, 0.2])).first()
    assert m.roc_auc is None and m.recall == 0.5


@pytest.mark.parametrize("shape", ["uniform", "narrow", "one score", "few scores"])
@pytest.mark.parametrize("decimals", [None, 6])
def test_auc_equals_pair_count(spark, shape, decimals):
    rng = np.random.default_rng(7)
    n = 400
    probs = {
        "uniform": rng.random(n),
        "narrow": 1 - rng.random(n) * 1e-4,
        "one score": np.where(rng.random(n) < 0.4, 0.5, rng.random(n)),
        "few scores": rng.integers(0, 4, n) / 4,
    }[shape].round(6)
    labels = (rng.random(n) < 0.3 + 0.4 * probs).astype(int)
    df = predictions(spark, labels.tolist(), labels.tolist(), probs.tolist())
    got = metrics.roc_auc(df, decimals=decimals).first().roc_auc
    assert got == pytest.approx(brute_auc(labels, probs), abs=1e-12)
    flipped = df.withColumn("prob", 1 - F.col("prob"))
    assert metrics.roc_auc(flipped).first().roc_auc == pytest.approx(1 - got, abs=1e-12)


def test_auc_by_source_equals_auc_of_each_source(spark):
    rng = np.random.default_rng(3)
    probs, labels = rng.random(300).round(2), rng.integers(0, 2, 300)
    source = np.where(np.arange(300) % 3 == 0, "big", [f"s{i % 7}" for i in range(300)])
    rows = [(i, str(s), int(y), 1, float(p)) for i, (s, y, p) in enumerate(zip(source, labels, probs))]
    df = spark.createDataFrame(rows, PREDICTIONS)
    got = {r.source: r.roc_auc for r in metrics.metrics_by_source(df).collect()}
    for s in set(source):
        at = source == s
        assert got[str(s)] == pytest.approx(brute_auc(labels[at], probs[at]), abs=1e-12)


def test_roc_points(spark):
    df = predictions(spark, [1, 0, 1, 1, 0, 0], [1] * 6, [0.9, 0.9, 0.8, 0.7, 0.6, 0.1])
    points = sorted(metrics.roc_points(df).collect(), key=lambda r: -r.threshold)
    assert [(r.fpr, r.tpr) for r in points] == [
        (0, 0), (1 / 3, 1 / 3), (1 / 3, 2 / 3), (1 / 3, 1), (2 / 3, 1), (1, 1)
    ]
    bends = sorted(metrics.roc_points(df, drop_intermediate=True).collect(), key=lambda r: -r.threshold)
    assert [(r.fpr, r.tpr) for r in bends] == [(0, 0), (1 / 3, 1 / 3), (1 / 3, 1), (1, 1)]


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(11)
    probs, labels = rng.random(500).round(3), rng.integers(0, 2, 500)
    df = predictions(spark, labels.tolist(), labels.tolist(), probs.tolist())
    rows = metrics.probability_histogram(df).collect()
    for y in (0, 1):
        counts, edges = np.histogram(probs[labels == y], bins=40)
        mine = sorted((r for r in rows if r.label == y), key=lambda r: r.bin)
        assert [r.n for r in mine] == counts.tolist()
        assert [r.lower for r in mine] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_single_value(spark):
    rows = metrics.probability_histogram(predictions(spark, [1, 1], [1, 1], [0.5, 0.5])).where("n > 0").collect()
    assert [(r.bin, r.n) for r in rows] == [(20, 2)]


def test_best_epoch(spark):
    rows = [("a", 1, 0.0), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 0.4), ("b", 1, 0.0)]
    best = metrics.select_best_epoch(spark.createDataFrame(rows, "run string, epoch int, val_f1 double"))
    assert [(r.run, r.best_epoch, r.best_f1) for r in best.collect()] == [("a", 2, 0.5)]


def test_rows_without_probability_are_counted(spark):
    df = predictions(spark, [1, 0], [1, 0], [0.5, None])
    assert tuple(metrics.unscored_rows(df).first()) == (2, 1)
    assert metrics.binary_metrics(df).first().samples == 1


# decisions


def test_gray_zone_boundaries(spark):
    p = [0.39, 0.40, 0.59, 0.60, 0.725, 0.73, 0.85, 0.86]
    df = spark.createDataFrame([(x,) for x in p], "prob double")
    out = [r[0] for r in df.select(decisions.gray_zone(F.col("prob"))).collect()]
    assert out == [
        "likely_human", "uncertain", "uncertain", "edited_ai", "edited_ai", "uncertain", "uncertain", "strong_ai",
    ]


def test_reason_and_tag_differ_at_the_limits(spark):
    df = spark.createDataFrame([(0.85,), (0.40,)], "prob double").withColumn("tag", decisions.gray_zone(F.col("prob")))
    out = df.select("tag", decisions.probability_reason(F.col("prob"), F.col("tag")).alias("r")).collect()
    assert [tuple(r) for r in out] == [("uncertain", "strong_ai_signals"), ("uncertain", "leans_human")]


def test_ties_go_to_ai_in_labels_and_to_human_in_argmax(spark):
    df = spark.createDataFrame([(0.5, [1.0, 1.0])], "prob double, logits array<double>")
    assert df.select(decisions.decision_label(F.col("prob"))).first()[0] == 1
    assert models.softmax_argmax(df).first().pred == 0


# splits


@pytest.mark.parametrize("partitions", [1, 17])
def test_split_is_exact_and_stable(spark, partitions):
    df = spark.range(1010).select(F.col("id").alias("doc_id"), (F.col("id") < 10).cast("int").alias("label"))
    out = splits.stratified_split(df.repartition(partitions))
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {
        (1, "train"): 7, (1, "val"): 2, (1, "test"): 1,
        (0, "train"): 700, (0, "val"): 150, (0, "test"): 150,
    }
    again = splits.stratified_split(df)
    assert out.join(again, ["doc_id", "split"]).count() == 1010


@pytest.mark.parametrize("n", [1, 100, 999, 1000, 5000])
def test_sample_n(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert splits.sample_n(df, n).distinct().count() == min(n, 1000)


def test_folds_skip_sources_with_an_empty_side(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "val"), ("c", "test"), (None, "train")]
    out = splits.holdout_folds(spark.createDataFrame(rows, "source string, split string"))
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1), ("c", 3, 1)}
    one_sided = splits.holdout_folds(spark.createDataFrame([("a", "train"), ("a", "test")], "source string, split string"))
    assert one_sided.count() == 0


# features


def test_salted_join_with_a_heavy_key(spark):
    big = spark.range(3000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    table = big.groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(table, ["k"], "n", 3000, fragments=64)
    assert {r.k: r._salts for r in heavy.collect()} == {"hot": 22}
    out = salted_join(big, table, ["k"], heavy, ["doc"])
    assert out.count() == 3000
    assert out.where("k = 'hot' and n = 1000").count() == 1000


def test_perplexity_by_hand(spark):
    docs = spark.createDataFrame([(0, 0, "a b a"), (1, 1, "a b"), (2, 1, "one")], "doc_id long, fold int, text string")
    out = {r.doc_id: r for r in ngram_model.crossfit_perplexity(docs, folds=2).collect()}
    # fold 0 is scored with fold 1: tokens a b one, pairs (a, b); V = 3
    p_b = 0.7 * 1.0 + 0.3 * 2 / 6
    p_a = 0.3 * 2 / 6
    assert out[0].perplexity == pytest.approx(np.exp(-(np.log(p_b) + np.log(p_a)) / 2))
    # fold 1 is scored with fold 0: tokens a b a, pairs (a, b), (b, a)
    assert out[1].perplexity == pytest.approx(1 / (0.7 * 1.0 + 0.3 * 2 / 6))
    assert 2 not in out
    assert ngram_model.add_perplexity(docs, folds=2).where("doc_id = 2").first().perplexity is None


def test_new_texts_use_all_folds(spark):
    docs = spark.createDataFrame([(0, 0, "a b a"), (1, 1, "a b")], "doc_id long, fold int, text string")
    model = ngram_model.fit(docs, folds=2)
    new = spark.createDataFrame([(7, "a b"), (8, "z q")], "doc_id long, text string")
    out = {r.doc_id: r.perplexity for r in ngram_model.new_text_perplexity(new, model).collect()}
    assert out[7] == pytest.approx(1 / (0.7 * 1.0 + 0.3 * 3 / 7))
    assert out[8] == pytest.approx(7 / 0.3)


def test_saved_language_model(spark):
    docs = spark.createDataFrame([(0, 0, "a b a"), (1, 1, "a b"), (2, 1, "one")], "doc_id long, fold int, text string")
    path = work_path(spark, "saved")
    sinks.save_ngram(ngram_model.fit(docs, folds=2), spark, path)
    again = sinks.load_ngram(spark, path)
    batch = spark.createDataFrame([(7, "a b"), (8, "z q"), (9, None)], "doc_id long, text string")
    many = {r.doc_id: r.perplexity for r in ngram_model.new_text_perplexity(batch, again).collect()}
    one = ngram_model.new_text_perplexity(batch.where("doc_id = 7"), again).first()
    assert set(many) == {7, 8} and one.perplexity == many[7]
    ai = batch.selectExpr("doc_id", "text", "1 AS label", "'s' AS source", "0.0 AS perplexity").where("doc_id < 9")
    edited = {r.doc_id: r for r in build_challenge(ai, language_model=again).collect()}
    direct = ngram_model.new_text_perplexity(build_challenge(ai).select("doc_id", "text"), again)
    assert {k: r.perplexity for k, r in edited.items()} == {r.doc_id: r.perplexity for r in direct.collect()}


def test_a_language_model_is_saved_where_it_lies(spark):
    docs = spark.createDataFrame([(i, i % 2, f"a b w{i}") for i in range(40)], "doc_id long, fold int, text string")
    model, path = ngram_model.fit(docs, folds=2), work_path(spark, "saved")
    spread = replace(model, bigrams=model.bigrams.repartitionByRange(5, "prev", "term"))
    sinks.save_ngram(spread, spark, path)
    again = sinks.load_ngram(spark, path)
    assert again.bigrams.select(F.input_file_name()).distinct().count() == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkgauge_")]
    for name in ("bigrams", "prefixes", "unigrams"):
        assert sorted(getattr(again, name).collect()) == sorted(getattr(model, name).collect())


def test_regular_ids_reach_all_folds(spark):
    ids = spark.range(200).selectExpr("id * 5 AS doc_id")
    assert ngram_model.assign_fold(ids).select("fold").distinct().count() == 5


@pytest.mark.parametrize("label", [None, 2])
def test_labels_that_are_not_binary_are_refused(spark, label):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, label)], "doc_id long, label int")
    with pytest.raises(Exception, match="label is not 0 or 1"):
        splits.stratified_split(df).collect()


def test_documents_without_vector_stay(spark):
    docs = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.4)], "doc_id long, perp_scaled double, burst_scaled double")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = models.hybrid_vector(models.frozen_encoder_features(docs, vectors), dimensions=2).orderBy("doc_id").collect()
    assert [(r.has_vector, list(r.features)) for r in rows] == [(True, [1.0, 2.0, 0.1, 0.2]), (False, [0.0, 0.0, 0.3, 0.4])]


def test_idf(spark):
    stats = spark.createDataFrame([("x", 1, 1), ("y", 3, 3)], "term string, total long, df long")
    out = {r.term: r.idf for r in tfidf.idf(stats, 3).collect()}
    assert out["x"] == pytest.approx(1.693147, abs=1e-6) and out["y"] == 1.0


def test_norms_are_one_or_absent(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "fox den"), (3, "the of")], "doc_id long, text string")
    weights = tfidf.fit(docs).weights(docs)
    norms = {r.doc_id: r.s for r in weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()}
    assert set(norms) == {1, 2}
    assert all(n == pytest.approx(1.0) for n in norms.values())


@pytest.mark.parametrize("k", [1, 3, 50])
def test_held_out_vocabulary_equals_a_refit(spark, k):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = [
        (i, "big" if i % 3 == 0 else f"s{i % 4}", " ".join(rng.choice(words, 12, p=np.arange(30, 0, -1) / 465)))
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = tfidf.held_out_vocab(tfidf.term_stats(docs, ["source"]), "source", k).collect()
    for source in {r[1] for r in rows}:
        refit = tfidf.vocabulary(tfidf.term_stats(docs.where(F.col("source") != source)), k).collect()
        mine = {(r.term, r.total, r.df) for r in got if r.held_out_source == source}
        assert mine == {(r.term, r.total, r.df) for r in refit}


# models


def test_logistic_fit_is_optimal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [1, 3, 0.2, 1, 10]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1, -0.5, 2, 0, 0.05])))).astype(int)
    df = spark.createDataFrame([(int(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    model = models.fit_logistic(df, c=1.0, tol=1e-12)
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-3
    assert abs((p - y).sum()) < 1e-3


def test_mlp_head_keeps_null_rows(spark):
    head = models.MlpHead([(np.array([[1.0], [-1.0]]), np.array([0.5])), (np.array([[2.0, 0.0]]), np.array([0.0, 1.0]))])
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, None), (3, [0.0, 5.0])], "id int, x array<double>")
    out = {r.id: r.logits for r in models.mlp_head_forward(df, head, F.col("x")).collect()}
    assert out == {1: [5.0, 1.0], 2: None, 3: [0.0, 1.0]}


def test_held_out_with_one_class(spark):
    rows = [(i, "ab"[i % 2], "test" if i < 4 else "train", int(i % 2 == 0), f"word{i} common text", 1.0, 2.0) for i in range(12)]
    df = spark.createDataFrame(
        rows, "doc_id long, source string, split string, label int, text string, perplexity double, burstiness double"
    )
    out = models.source_held_out(df).collect()
    assert [(r.held_out_source, r.train_samples, r.test_samples, r.status, r.f1) for r in out] == [
        ("a", 4, 2, "single_class", None), ("b", 4, 2, "single_class", None),
    ]
