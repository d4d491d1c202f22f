"""Sentence features and the two stylometric inputs of the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T


def add_sentence_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `sentence_lengths` and `burstiness` without exploding or shuffling."""
    return df.withColumn("sentence_lengths", T.sentence_lengths(F.col(text))).withColumn(
        "burstiness", T.burstiness(F.col("sentence_lengths"))
    )


def sentence_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("n_sentences", F.size("sentence_lengths")).withColumn(
        "mean_sentence_length", T.mean_length(F.col("sentence_lengths"))
    )


def sentence_rhythm(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode("sentence_lengths").alias("_pos", "words")).select(
        key, (F.col("_pos") + 1).alias("sentence_no"), "words"
    )


def skip_perplexity(df: DataFrame) -> DataFrame:
    return df.withColumn("perplexity", F.lit(0.0))


def scaled_perplexity(perplexity: Column) -> Column:
    """A missing perplexity counts as 0.0, as in the run without a language model."""
    return F.log1p(F.coalesce(perplexity, F.lit(0.0))) / 5.0


def scaled_burstiness(burstiness: Column) -> Column:
    return burstiness / 5.0


def scaled_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("perp_scaled", scaled_perplexity(F.col("perplexity"))).withColumn(
        "burst_scaled", scaled_burstiness(F.col("burstiness"))
    )


def feature_means(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("perplexity").alias("mean_perplexity"), F.avg("burstiness").alias("mean_burstiness")
    )
