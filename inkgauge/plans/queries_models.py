"""Fitting and applying classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.columns import portable_hash
from inkgauge.operators import epochs, metrics, models, splits, tfidf
from inkgauge.operators.challenge import build_challenge
from inkgauge.plans import oracle_parts as O
from inkgauge.plans.registry import query
from inkgauge.plans.views import Views, as_scored
from inkgauge.session import stored, work_path
from inkgauge.sources import sinks

ROUND = 6


def _test_rows(v: Views) -> DataFrame:
    return v.split().where(F.col("split") == "test")


NEAR = 1e-3  # a coefficient this close to the optimum counts as optimal
SAME = 1e-9


@query(
    "fit_logistic",
    O.with_views(
        """SELECT term, true AS optimal FROM (SELECT term FROM train_stats ORDER BY total DESC, term LIMIT 10000)
UNION ALL SELECT unnest(['(perplexity)', '(burstiness)', '(intercept)']), true""",
        "train_stats",
    ),
)
def fit_logistic(v: Views) -> DataFrame:
    """Per coefficient of the baseline whether the gradient over the train split says that it is optimal."""
    model, vocab = v.baseline()
    train = v.split().where(F.col("split") == "train")
    table = models.coefficient_table(model, vocab, train)
    residuals = models.logistic_residuals(train, model, vocab, table)
    return residuals.select("term", (F.abs("residual") <= NEAR).alias("optimal"))


def _recomputed(v: Views, rows: DataFrame) -> DataFrame:
    """Per row whether the classifier's class and probability are those of its table of coefficients."""
    model, vocab = v.baseline()
    table = models.coefficient_table(model, vocab, rows)
    by_sums = models.linear_scores(rows, model, vocab, table).select("doc_id", F.col("prob").alias("other"))
    by_model = models.score_dataframe(rows, model, vocab).select("doc_id", "label", "pred", "prob")
    same = (F.abs(F.col("prob") - F.col("other")) <= SAME) & (F.col("pred") == (F.col("other") > 0.5).cast("int"))
    return by_model.join(by_sums, "doc_id").select("doc_id", "label", same.alias("same"))


@query("predict_logistic", O.with_views("SELECT doc_id, label, true AS same FROM split WHERE split = 'test'", "split"))
def predict_logistic(v: Views) -> DataFrame:
    """The baseline on the test split, recomputed row by row from the coefficients."""
    return _recomputed(v, _test_rows(v))


@query("save_model", O.with_views("SELECT doc_id, true AS same FROM split WHERE split = 'test'", "split"))
def save_model(v: Views) -> DataFrame:
    """Whether a copy of the baseline, saved and loaded again, gives the same probability."""
    model, vocab = v.baseline()
    path = work_path(v.spark, "copy")
    sinks.save_baseline(model, vocab, v.feats(), path)
    again, vocab_again = sinks.load_baseline(v.spark, path)
    first = models.score_dataframe(_test_rows(v), model, vocab).select("doc_id", "prob")
    second = models.score_dataframe(_test_rows(v), again, vocab_again)
    both = first.join(second.select("doc_id", F.col("prob").alias("prob_again")), "doc_id")
    return both.select("doc_id", (F.col("prob") == F.col("prob_again")).alias("same"))


@query(
    "score_dataframe",
    O.with_views("SELECT doc_id, label, true AS same FROM split WHERE split = 'test' AND label = 1", "split"),
)
def score_dataframe(v: Views) -> DataFrame:
    """The saved baseline on the edited texts of the test split, recomputed row by row."""
    return _recomputed(v, build_challenge(_test_rows(v)))


@query(
    "score_linear",
    O.with_views(
        f"""SELECT c.doc_id, round(z, 6) AS z, round(1 / (1 + exp(-z)), 6) AS prob FROM clean c JOIN (
  SELECT c.doc_id, coalesce(sum(w.weight * (({O.hashed('coef', 'w.term')} % 2001) - 1000) / 1000.0), 0) + 0.25 AS z
  FROM clean c LEFT JOIN weights w USING (doc_id) GROUP BY c.doc_id) s USING (doc_id)""",
        "clean",
        "weights",
    ),
)
def score_linear(v: Views) -> DataFrame:
    clean = v.clean()
    model = tfidf.fit(clean)
    fixed = (F.pmod(portable_hash(splits.SEED, "coef", F.col("term")), F.lit(2001)) - 1000) / 1000.0
    coefficients = model.table(v.spark).select("term", fixed.alias("coef"))
    scored = models.score_linear(clean, model.weights(clean), coefficients, 0.25)
    return scored.withColumns({c: F.round(c, ROUND) for c in ("z", "prob")})


def _with_vectors(v: Views) -> DataFrame:
    # a head reads vectors and features, so the texts need not meet the vectors
    return models.frozen_encoder_features(v.feats().drop("text", "sentence_lengths"), v.table("embeddings"))


@query(
    "frozen_encoder_features",
    O.with_views(
        """SELECT f.doc_id, f.label, e.vec_id IS NOT NULL AS has_vector, len(e.embedding)::INTEGER AS dimensions, round(e.embedding[1]::DOUBLE, 6) AS first_value,
  round(f.perp_scaled, 6) AS perp_scaled, round(f.burst_scaled, 6) AS burst_scaled FROM feats f LEFT JOIN embeddings e ON e.vec_id = f.doc_id""",
        "feats",
    ),
)
def frozen_encoder_features(v: Views) -> DataFrame:
    return _with_vectors(v).select(
        "doc_id",
        "label",
        "has_vector",
        F.size("embedding").alias("dimensions"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), ROUND).alias("first_value"),
        F.round("perp_scaled", ROUND).alias("perp_scaled"),
        F.round("burst_scaled", ROUND).alias("burst_scaled"),
    )


def _hybrid(v: Views):
    """(rows with `split` and `features`, network fitted on the other splits than test)."""

    def make():
        rows = stored(models.hybrid_vector(splits.stratified_split(_with_vectors(v)), dimensions=64), "hybrid-rows")
        return rows, models.fit_hybrid(splits.train_pool(rows), dimensions=64)

    return v._once("hybrid", make)


@query("fit_hybrid", O.with_views("SELECT doc_id, label, true AS same FROM split WHERE split = 'test'", "split"))
def fit_hybrid(v: Views) -> DataFrame:
    """The network on document vectors and stylometry, its test rows recomputed from the saved weights."""
    rows, model = _hybrid(v)
    path = work_path(v.spark, "hybrid")
    sinks.save_hybrid(model, path)
    test = rows.where(F.col("split") == "test")
    layers = models.network_layers(sinks.load_hybrid(path))
    both = models.network_probability(models.predict(model, test), layers, "other")
    same = (F.abs(F.col("prob") - F.col("other")) <= SAME) & (F.col("pred") == (F.col("other") > 0.5).cast("int"))
    return both.select("doc_id", "label", same.alias("same"))


EPOCHS = 4


@query(
    "training_history",
    O.with_views(
        f"""SELECT 'hybrid' AS run, epoch::INTEGER AS epoch, count(*) FILTER (split = 'train') AS train_samples,
  count(*) FILTER (split = 'val') AS val_samples, true AS recomputed FROM split, range(1, {EPOCHS + 1}) e(epoch) GROUP BY epoch""",
        "split",
    ),
)
def training_history(v: Views) -> DataFrame:
    """Four epochs of the hybrid head, the run broken off after two; figures recomputed from the saved weights."""
    rows = stored(models.hybrid_vector(splits.stratified_split(_with_vectors(v)), dimensions=64), "epoch-rows")
    network, path = epochs.Network((66, 16, 2)), work_path(v.spark, "run")
    table = epochs.mini_batches(rows, 4, "doc_id")
    for last in (EPOCHS // 2, EPOCHS):
        epochs.train(table, network, path, epochs=last)
    told = epochs.recomputed_history(rows, network, path)
    return told.select("run", "epoch", "train_samples", "val_samples", "recomputed")


_HEAD = (64, 8, 4, 2)


def _head() -> models.MlpHead:
    layers = []
    for n_in, n_out in zip(_HEAD, _HEAD[1:]):
        i, j = np.meshgrid(np.arange(n_in), np.arange(n_out), indexing="ij")
        layers.append((((i * 7 + j * 5) % 11 - 5) / 20.0, (np.arange(n_out) * 3 % 5 - 2) / 10.0))
    return models.MlpHead(layers)


def _layer_sql(x: str, n_in: int, n_out: int, last: bool) -> str:
    total = (
        f"list_sum(list_transform(range(0, {n_in}), lambda i: {x}[i + 1] * ((((i * 7 + j * 5) % 11) - 5)::DOUBLE / 20)))"
        " + ((j * 3) % 5 - 2)::DOUBLE / 10"
    )
    return f"list_transform(range(0, {n_out}), lambda j: {total if last else f'greatest({total}, 0.0)'})"


def _head_sql(vectors: str) -> str:
    sql = vectors
    for at, (n_in, n_out) in enumerate(zip(_HEAD, _HEAD[1:])):
        sql = f"SELECT vec_id, {_layer_sql('x', n_in, n_out, at == len(_HEAD) - 2)} AS x FROM ({sql})"
    return sql


_LOGITS = _head_sql("SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings")


@query("mlp_head_forward", f"SELECT vec_id, round(x[1], 6) AS z0, round(x[2], 6) AS z1 FROM ({_LOGITS})")
def mlp_head_forward(v: Views) -> DataFrame:
    out = models.mlp_head_forward(v.table("embeddings"), _head(), F.col("embedding"))
    z = [F.round(F.get("logits", F.lit(i)), ROUND).alias(f"z{i}") for i in (0, 1)]
    return out.select("vec_id", *z)


@query(
    "softmax_argmax",
    O.with_views(
        """SELECT doc_id, round(1 / (1 + exp(burst_scaled - perp_scaled)), 6) AS prob,
  CASE WHEN perp_scaled > burst_scaled THEN 1 ELSE 0 END AS pred FROM feats""",
        "feats",
    ),
)
def softmax_argmax(v: Views) -> DataFrame:
    logits = v.feats().withColumn("logits", F.array("burst_scaled", "perp_scaled"))
    return models.softmax_argmax(logits).select("doc_id", F.round("prob", ROUND).alias("prob"), "pred")


@query(
    "select_best_epoch",
    O.with_views(
        """SELECT run, epoch AS best_epoch, val_f1 AS best_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_f1 DESC, epoch) AS rn FROM (
    SELECT source AS run, epoch::INTEGER AS epoch,
      round(coalesce(2.0 * sum((p AND label = 1)::INT) / nullif(sum(p::INT) + sum((label = 1)::INT), 0), 0), 6) AS val_f1
    FROM (SELECT source, label, epoch, prob >= epoch / 10.0 AS p FROM scored, range(1, 10) r(epoch)) GROUP BY ALL) WHERE val_f1 > 0) WHERE rn = 1""",
        "scored",
    ),
)
def select_best_epoch(v: Views) -> DataFrame:
    """Per source the best of nine decision limits, in place of the epochs of a training run."""
    swept = as_scored(v.pred()).select(
        "source", "label", "prob", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("epoch")
    )
    swept = swept.withColumn("pred", (F.col("prob") >= F.col("epoch") / 10.0).cast("int"))
    history = metrics.binary_metrics(swept, ["source", "epoch"]).select(
        F.col("source").alias("run"), "epoch", F.round("f1", ROUND).alias("val_f1")
    )
    return metrics.select_best_epoch(history)


def _text_lengths():
    """Stands in for loading a model; the returned function scores one batch."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "n_chars": batch["text"].str.len(),
                "n_spaces": batch["text"].str.count(" "),
            }
        )

    return score


@query(
    "score_with",
    "SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_spaces FROM documents",
)
def score_with(v: Views) -> DataFrame:
    return models.score_with(
        v.table("documents"), _text_lengths, ["doc_id", "text"], "doc_id long, n_chars long, n_spaces long", batch_size=16
    )


@query(
    "score_with_saved_head",
    f"SELECT vec_id, round(x[1], 6) AS z0, round(x[2], 6) AS z1, true AS same_version FROM ({_LOGITS})",
)
def score_with_saved_head(v: Views) -> DataFrame:
    """A network head, saved and loaded again, over all vectors; the digest says that it is that version."""
    path = work_path(v.spark, "head")
    sinks.save_head(_head(), v.spark, path)
    head = sinks.load_head(v.spark, path)
    load = models.head_loader(v.spark, head, "vec_id")
    schema = "vec_id long, z0 double, z1 double, model string"
    out = models.score_with(v.table("embeddings"), load, ["vec_id", "embedding"], schema)
    logits = [F.round(c, ROUND).alias(c) for c in ("z0", "z1")]
    return out.select("vec_id", *logits, (F.col("model") == models.head_digest(_head())).alias("same_version"))
