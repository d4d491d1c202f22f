"""The edited-text challenge: how models behave on revised machine text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import edits
from inkgauge.functions import text as T
from inkgauge.operators import ngram_model
from inkgauge.operators.metrics import by_model, metrics


def build_challenge(
    df: DataFrame,
    seed: int = edits.SEED,
    key: str = "doc_id",
    strict: bool = True,
    language_model: ngram_model.NgramModel | None = None,
) -> DataFrame:
    """The rows of class 1 with edited text.

    Burstiness is that of the edited text. Perplexity is carried over from the original, or is
    that of the edited text under `language_model`.
    """
    rows = df.where(F.col("label") == 1).withColumn("original_text", F.col("text"))
    edited = rows.withColumn(
        "text", edits.humanise(F.col("original_text"), F.col(key), seed, strict=strict)
    ).withColumns(
        {
            "burstiness": T.burstiness(T.sentence_lengths(F.col("text"))),
            "source": F.concat("source", F.lit("_edited")),
        }
    )
    if language_model:
        scores = ngram_model.new_text_perplexity(edited, language_model, key).select(key, "perplexity")
        edited = edited.drop("perplexity").join(scores, key, "left")
    return edited


def evaluate_challenge(
    scored: DataFrame, models: dict[str, tuple[str, str]], decimals: int | None = None
) -> DataFrame:
    """Metrics per model; the area under the curve is null because only one class is left."""
    return metrics(by_model(scored, models), ["model"], decimals)


def challenge_preview(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], n: int = 100, key: str = "doc_id"
) -> DataFrame:
    """The first `n` rows of the challenge with the predictions that `score` adds.

    The rows are chosen before they are edited and scored.
    """
    columns = [
        "source", "label", "original_text", "text",
        "hybrid_pred", "hybrid_prob", "baseline_pred", "baseline_prob",
    ]
    first = df.where(F.col("label") == 1).orderBy(key).limit(n)
    scored = score(build_challenge(first, key=key))
    return scored.select(key, *[c for c in columns if c in scored.columns])


def robustness_table(clean: DataFrame, edited: DataFrame) -> DataFrame:
    """F1 on clean and edited text per model, from two metric tables; missing values are 0."""
    left = clean.select("model", F.col("f1").alias("clean_f1"))
    right = edited.select("model", F.col("f1").alias("edited_f1"))
    return left.join(right, "model", "full").select(
        "model",
        F.coalesce("clean_f1", F.lit(0.0)).alias("clean_f1"),
        F.coalesce("edited_f1", F.lit(0.0)).alias("edited_f1"),
    )
