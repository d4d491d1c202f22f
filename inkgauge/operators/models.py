"""Classifiers: logistic regression on TF-IDF and stylometry, and a small network on document vectors."""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from inkgauge.functions.columns import sigmoid
from inkgauge.operators import fold_fit, splits, tfidf
from inkgauge.session import ship, stored

MAX_FOLDS = 10_000
BROADCAST_TERMS = 100_000  # most rows of a coefficient table that is sent to every task


def fit_logistic(
    df: DataFrame,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
    features: str = "features",
    label: str = "label",
) -> LogisticRegressionModel:
    """L2 logistic regression that minimises |w|^2/2 + c * sum(loss), intercept unpenalised.

    Raw perplexities are thousands of times larger than the other features, which the estimator of
    Spark ML does not get over in 1000 steps; `fold_fit` scales each coefficient by its curvature.
    """
    rows, folds = fold_fit.vector_blocks(df, features, label)
    fitted = fold_fit.fit_folds(rows, folds, c, tol, max_iter)
    weights, sc = fitted.coefficients[0], df.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(sc, Vectors.dense(weights[:-3])), float(weights[-1])
    )
    return LogisticRegressionModel(java).setFeaturesCol(features)


def predict(model, df: DataFrame, pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Adds the class and the probability of class 1; works for every Spark classifier."""
    out = model.transform(df)
    return out.withColumn(pred, F.col("prediction").cast("int")).withColumn(
        prob, F.get(vector_to_array("probability"), F.lit(1))
    ).drop("rawPrediction", "probability", "prediction")


def coefficient_table(model: LogisticRegressionModel, vocab: tfidf.TfidfModel, like: DataFrame) -> DataFrame:
    """(term, coef) of the TF-IDF part of a model."""
    weights = model.coefficients.toArray()
    rows = [(t, float(w)) for t, w in zip(vocab.terms, weights)]
    return like.sparkSession.createDataFrame(rows, "term string, coef double")


def linear_scores(
    df: DataFrame, model: LogisticRegressionModel, vocab: tfidf.TfidfModel, coefficients: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """(key, label, z, prob) by sums over the sparse entries and the table (term, coef), without the model's code.

    `model` gives the coefficients of both features and the intercept only.
    """
    *_, perplexity, burstiness = model.coefficients.toArray().tolist()
    terms = score_linear(df, vocab.weights(df, key), coefficients, float(model.intercept), key).select(key, F.col("z").alias("_z"))
    z = F.col("_z") + perplexity * F.coalesce("perplexity", F.lit(0.0)) + burstiness * F.coalesce("burstiness", F.lit(0.0))
    return df.select(key, "label", "perplexity", "burstiness").join(terms, key).select(
        key, "label", z.alias("z"), sigmoid(z).alias("prob")
    )


def logistic_residuals(
    train: DataFrame,
    model: LogisticRegressionModel,
    vocab: tfidf.TfidfModel,
    coefficients: DataFrame,
    c: float = 1.0,
    key: str = "doc_id",
) -> DataFrame:
    """(term, residual): how far each coefficient is from the optimum of `fit_logistic`, at least.

    The gradient of |w|^2/2 + c * sum(loss) by coefficient, added up from the training rows, over the
    root of a bound of its curvature. At the optimum all are zero. The two features and the intercept
    are `(perplexity)`, `(burstiness)` and `(intercept)`.
    """
    *_, perplexity, burstiness = model.coefficients.toArray().tolist()
    own = train.sparkSession.createDataFrame(
        [("(perplexity)", perplexity, 1.0), ("(burstiness)", burstiness, 1.0), ("(intercept)", 0.0, 0.0)],
        "term string, coef double, penalty double",
    )
    errors = linear_scores(train, model, vocab, coefficients, key).select(key, (F.col("prob") - F.col("label")).alias("_e"))
    stats = F.array(
        F.struct(F.lit("(perplexity)").alias("term"), F.coalesce("perplexity", F.lit(0.0)).alias("weight")),
        F.struct(F.lit("(burstiness)").alias("term"), F.coalesce("burstiness", F.lit(0.0)).alias("weight")),
        F.struct(F.lit("(intercept)").alias("term"), F.lit(1.0).alias("weight")),
    )
    entries = vocab.weights(train, key).unionByName(train.select(key, F.inline(stats)))
    sums = entries.join(errors, key).groupBy("term").agg(
        F.sum(F.col("weight") * F.col("_e")).alias("_g"), F.sum(F.col("weight") ** 2).alias("_h")
    )
    every = coefficients.select("term", "coef", F.lit(1.0).alias("penalty")).unionByName(own)
    gradient = F.col("coef") + c * F.coalesce("_g", F.lit(0.0))
    curvature = F.col("penalty") + c * F.coalesce("_h", F.lit(0.0)) / 4
    return every.join(sums, "term", "left").select("term", (gradient / F.sqrt(curvature)).alias("residual"))


def score_linear(
    docs: DataFrame, weights: DataFrame, coefficients: DataFrame, intercept: float, key: str = "doc_id"
) -> DataFrame:
    """(key, z, prob) from sparse entries (key, term, weight) and a table (term, coef).

    The sums are formed per document in each task before the shuffle. Coefficients of a vocabulary
    are few and go to the entries; a longer table is joined by term. A document without a known
    term gets the intercept alone.
    """
    if coefficients.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        coefficients = F.broadcast(coefficients)
    sums = weights.join(coefficients, "term").groupBy(key).agg(
        F.sum(F.col("weight") * F.col("coef")).alias("_dot")
    )
    z = F.coalesce("_dot", F.lit(0.0)) + intercept
    return docs.select(key).join(sums, key, "left").select(key, z.alias("z"), sigmoid(z).alias("prob"))


def hybrid_vector(
    df: DataFrame, dimensions: int, document_vector: str = "embedding", output: str = "features"
) -> DataFrame:
    """Document vector followed by the two scaled stylometric features; a missing vector is all zeros."""
    known = F.coalesce(F.col(document_vector).cast("array<double>"), F.array_repeat(F.lit(0.0), dimensions))
    with_vector = df.withColumn("_v", array_to_vector(known))
    assembler = VectorAssembler(inputCols=["_v", "perp_scaled", "burst_scaled"], outputCol=output)
    return assembler.transform(with_vector).drop("_v")


def fit_hybrid(
    df: DataFrame,
    dimensions: int,
    hidden: tuple[int, ...] = (256, 64),
    max_iter: int = 100,
    seed: int = splits.SEED,
) -> MultilayerPerceptronClassificationModel:
    """Network of `dimensions` + 2 inputs, the hidden layers and two outputs."""
    return MultilayerPerceptronClassifier(
        layers=[dimensions + 2, *hidden, 2], maxIter=max_iter, seed=seed, featuresCol="features", labelCol="label"
    ).fit(df)


def network_layers(model: MultilayerPerceptronClassificationModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer the matrix (inputs x outputs) and the bias of a fitted network."""
    weights, sizes, out, at = model.weights.toArray(), model.getLayers(), [], 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        w = weights[at : at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        out.append((w, weights[at : at + n_out]))
        at += n_out
    return out


def network_probability(df: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], output: str = "prob") -> DataFrame:
    """Adds the probability of class 1 by matrix products on `features`, without the model's code."""
    ship(df.sparkSession)

    @F.pandas_udf(ST.DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(layers[0][0])))
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                if i < len(layers) - 1:
                    x = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
            yield pd.Series(1 / (1 + np.exp(np.clip(x[:, 0] - x[:, 1], -700, 700))))

    return df.withColumn(output, probability(vector_to_array("features")))


@dataclass(frozen=True)
class MlpHead:
    """Weights of a feed-forward head: per layer a matrix (inputs x outputs) and a bias."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
        return x


def mlp_head_forward(df: DataFrame, head: MlpHead, inputs: Column, output: str = "logits") -> DataFrame:
    """Adds the logits of a linear-ReLU-...-linear head, one matrix product per Arrow batch."""
    ship(df.sparkSession)

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.dropna()
            scores = iter(head.forward(np.stack(known.to_numpy())) if len(known) else [])
            yield pd.Series([next(scores) if ok else None for ok in batch.notna()], dtype=object)

    return df.withColumn(output, logits(inputs.cast("array<double>")))


def softmax_argmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds `prob` of class 1 and `pred`, the class of the larger logit; equal logits give 0."""
    z0, z1 = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
    top = F.greatest(z0, z1)
    e0, e1 = F.exp(z0 - top), F.exp(z1 - top)
    pred = F.when(z0.isNotNull() & z1.isNotNull(), F.when(z1 > z0, 1).otherwise(0))
    return df.withColumns({"prob": e1 / (e0 + e1), "pred": pred})


def frozen_encoder_features(
    docs: DataFrame, vectors: DataFrame, key: str = "doc_id", vector_key: str = "vec_id"
) -> DataFrame:
    """Documents with their precomputed vector, for training a head on a fixed encoder.

    A document without a vector stays, with `has_vector` false.
    """
    joined = docs.join(vectors.select(F.col(vector_key).alias(key), "embedding"), key, "left")
    return joined.withColumn("has_vector", F.col("embedding").isNotNull())


def score_with(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    columns: list[str],
    schema: str,
    batch_size: int | None = None,
) -> DataFrame:
    """Run a user model over a table in Arrow batches.

    `load` is called once per task and returns the function that scores a batch of `columns`;
    its result must have `schema`. `batch_size` splits larger Arrow batches for the model.
    """
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            step = batch_size or max(len(frame), 1)
            for start in range(0, len(frame), step):
                yield score(frame.iloc[start : start + step])

    return df.select(*columns).mapInPandas(run, schema)


_heads: dict[str, MlpHead] = {}  # of this worker, by digest


def head_digest(head: MlpHead) -> str:
    """Digest of shapes and weights: the version of a head."""
    digest = hashlib.sha256()
    for w, b in head.layers:
        digest.update(f"{w.shape}".encode() + np.ascontiguousarray(w, float).tobytes() + np.asarray(b, float).tobytes())
    return digest.hexdigest()


def head_loader(
    spark: SparkSession, head: MlpHead, key: str, vector: str = "embedding"
) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """For `score_with`: (key, z0, z1, model) of a head with two outputs; `model` is its digest.

    The weights go to the executors once and are unpacked once per worker and version, however many
    tasks the worker runs. A row without a vector has null logits.
    """
    digest, sent = head_digest(head), spark.sparkContext.broadcast(pickle.dumps(head.layers))

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        from inkgauge.operators import models

        if digest not in models._heads:
            models._heads[digest] = models.MlpHead(pickle.loads(sent.value))
        own = models._heads[digest]

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            logits, known = np.full((len(batch), 2), np.nan), batch[vector].notna().to_numpy()
            if known.any():
                logits[known] = own.forward(np.stack(batch[vector][known].to_numpy()).astype(float))
            cells = [pd.array([None if np.isnan(z) else z for z in logits[:, i]], dtype="Float64") for i in (0, 1)]
            return pd.DataFrame({key: batch[key], "z0": cells[0], "z1": cells[1], "model": digest})

        return score

    return load


def score_dataframe(df: DataFrame, model, vocab: tfidf.TfidfModel) -> DataFrame:
    """Apply a saved baseline to any table with text, perplexity and burstiness."""
    return predict(model, tfidf.assemble_features(df, vocab)).drop("features", "tfidf")


def source_held_out(
    df: DataFrame,
    by: str = "source",
    k: int = tfidf.VOCABULARY_SIZE,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
) -> DataFrame:
    """Per held-out source: refit vocabulary and classifier without it, then test on it.

    `df` has split, label, text and both features. The term statistics of all folds come from
    one grouped count, and one optimiser fits all of them, each step one scan of the rows. `residual`
    bounds how far the coefficients are from the optimum. More than MAX_FOLDS sources, or more
    coefficients of all folds than `fold_fit.MAX_CELLS`, are an error.
    """
    spark = df.sparkSession
    words = tfidf.T.remove_stopwords(tfidf.T.tokens(F.col("text")))
    ready = stored(
        df.select(by, "split", "label", "perplexity", "burstiness", words.alias("words")),
        "held-out",
    )
    every = splits.holdout_folds(ready, by)
    folds = every.orderBy("held_out_source").limit(MAX_FOLDS + 1).collect()
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} sources to hold out")
    totals = splits.train_pool(ready).groupBy("label").agg(F.count("*").alias("n")).collect()
    own = splits.train_pool(ready).groupBy(by, "label").agg(F.count("*").alias("n"))
    own = own.join(every.select(F.col("held_out_source").alias(by)), by)
    labels = {(r[by], r["label"]): r["n"] for r in own.collect()}
    classes = {
        f["held_out_source"]: sum(r["n"] > labels.get((f["held_out_source"], r["label"]), 0) for r in totals) for f in folds
    }
    sizes = {f["held_out_source"]: f["train_samples"] for f in folds if classes[f["held_out_source"]] > 1}
    results: dict[str, tuple] = {}
    if sizes:
        stats = tfidf.term_stats(splits.train_pool(ready), [by], words=F.col("words"))
        vocab = tfidf.held_out_vocab(stats, by, k).where(F.col("held_out_source").isin(list(sizes)))
        # at most `k` rows a fold
        table = fold_fit.fold_table(vocab.select("held_out_source", "term", "df").toPandas(), sizes)
        rows = fold_fit.blocks(ready, table, by, tfidf.T.ngrams_1_2(F.col("words")))
        fitted = fold_fit.fit_folds(rows, table, c, tol, max_iter)
        counts = fold_fit.held_out_counts(rows, fitted)
        for name, (tn, fp, fn, tp), residual in zip(sizes, counts, fitted.residuals):
            rate = lambda a, b: float(a / b) if b else 0.0
            rates = rate(tn + tp, tn + fp + fn + tp), rate(tp, tp + fp), rate(tp, tp + fn), rate(2 * tp, 2 * tp + fp + fn)
            results[name] = ("ok", *rates, float(residual))
    single = ("single_class", None, None, None, None, None)
    out = [
        (f["held_out_source"], f["train_samples"], f["test_samples"], *results.get(f["held_out_source"], single)) for f in folds
    ]
    return spark.createDataFrame(
        out,
        "held_out_source string, train_samples long, test_samples long, status string, "
        "accuracy double, precision double, recall double, f1 double, residual double",
    )
