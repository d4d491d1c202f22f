"""From a probability and two stylometric signals to labels, tags and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T

# fixed values: names used in exported results
LABEL_NAMES = {1: "AI-Generated", 0: "Human-Written"}
TAG_NAMES = {
    "edited_ai": "Possible Human-Edited AI",
    "strong_ai": "Strong AI Signal",
    "likely_human": "Likely Human-Written",
    "uncertain": "Uncertain / Mixed Signal",
}


def named(code: Column, names: dict) -> Column:
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 200


def decision_label(p: Column) -> Column:
    return F.when(p.isNotNull(), (p >= 0.5).cast("int"))


def gray_zone(p: Column) -> Column:
    tag = (
        F.when((p >= 0.60) & (p <= 0.85) & (confidence(p) <= 45), "edited_ai")
        .when(p > 0.85, "strong_ai")
        .when(p < 0.40, "likely_human")
        .otherwise("uncertain")
    )
    return F.when(p.isNotNull(), tag)


def _bands(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    first, *rest = limits
    out = F.when(value < first[0], first[1])
    for limit, name in rest:
        out = out.when(value < limit, name)
    return F.when(value.isNotNull(), out.otherwise(last))


def probability_band(p: Column) -> Column:
    return _bands(p, [(0.3, "low"), (0.7, "mid")], "high")


def position_band(p: Column) -> Column:
    return _bands(p * 100, [(40, "0-40"), (60, "40-60"), (85, "60-85")], "85-100")


def perplexity_band(perplexity: Column) -> Column:
    return _bands(perplexity, [(40, "predictable"), (65, "mixed")], "varied")


def burstiness_band(burstiness: Column) -> Column:
    return _bands(burstiness, [(2.5, "uniform"), (4.0, "some")], "varied")


def probability_reason(p: Column, tag: Column) -> Column:
    reason = (
        F.when(tag == "edited_ai", "leans_ai_with_edits")
        .when(p >= 0.85, "strong_ai_signals")
        .when(p <= 0.40, "leans_human")
        .otherwise("mixed_signals")
    )
    return F.when(p.isNotNull(), reason)


def short_reason(tag: Column) -> Column:
    return named(
        tag,
        {
            "edited_ai": "ai_structure_human_edits",
            "strong_ai": "predictable_synthetic_pattern",
            "likely_human": "varied_less_machine_like",
            "uncertain": "mixed_evidence",
        },
    )


def signal_flag(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.when(value > limit, "high").otherwise("low"))


def perplexity_flag(perplexity: Column) -> Column:
    return signal_flag(perplexity, 50)


def burstiness_flag(burstiness: Column) -> Column:
    return signal_flag(burstiness, 3)


def decide(df: DataFrame, p: str = "prob") -> DataFrame:
    """Adds `pred_label`, `tag` and `confidence`."""
    return df.withColumns(
        {
            "pred_label": decision_label(F.col(p)),
            "tag": gray_zone(F.col(p)),
            "confidence": confidence(F.col(p)),
        }
    )


def signal_profile(df: DataFrame, key: str = "doc_id", p: str = "prob") -> DataFrame:
    """Four rows per document: each signal on a scale of 0 to 1, with its display text."""

    def capped(value: Column) -> Column:
        return F.when(value.isNotNull(), F.least(value, F.lit(1.0)))

    def signal(name: str, score: Column, display: Column) -> Column:
        return F.struct(F.lit(name).alias("signal"), score.alias("score"), display.alias("display"))

    conf = confidence(F.col(p))
    signals = F.array(
        signal("probability", F.col(p), F.concat(T.fixed_decimals(F.col(p) * 100, 1), F.lit("%"))),
        signal("confidence", capped(conf / 100), F.concat(T.fixed_decimals(conf, 1), F.lit("%"))),
        signal("perplexity", capped(F.col("perplexity") / 80), T.fixed_decimals(F.col("perplexity"), 1)),
        signal("burstiness", capped(F.col("burstiness") / 6), T.fixed_decimals(F.col("burstiness"), 2)),
    )
    return df.select(key, F.explode(signals).alias("_s")).select(key, "_s.*")


def score_batch(df: DataFrame, p: str = "prob", display: bool = False) -> DataFrame:
    """The result table of a batch: preview, probability, label, tag, confidence and signals.

    `display` gives the exported texts instead of numbers and codes.
    """
    scored = decide(df, p)
    preview = T.preview_text(F.col("text")).alias("text")
    if not display:
        return scored.select(
            "doc_id",
            preview,
            F.col(p).alias("probability"),
            F.col("pred_label").alias("label"),
            F.col("tag").alias("interpretation"),
            "confidence",
            "perplexity",
            "burstiness",
        )
    return scored.select(
        "doc_id",
        preview,
        T.as_percent(F.col(p)).alias("probability"),
        named(F.col("pred_label"), LABEL_NAMES).alias("label"),
        named(F.col("tag"), TAG_NAMES).alias("interpretation"),
        F.concat(T.fixed_decimals(F.col("confidence"), 1), F.lit("%")).alias("confidence"),
        T.fixed_decimals(F.col("perplexity"), 1).alias("perplexity"),
        T.fixed_decimals(F.col("burstiness"), 2).alias("burstiness"),
    )
