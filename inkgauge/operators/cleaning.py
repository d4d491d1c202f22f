"""Row filters, exact deduplication and the cleaning step as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T


def min_length(df: DataFrame, n: int = 20, text: str = "text") -> DataFrame:
    return df.where(F.length(text) > n)


def skip_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~T.is_blank(F.col(text)))


def dedup_exact(df: DataFrame, order: list[str | Column], text: str = "text") -> DataFrame:
    """One row per text, the first by `order`.

    A text with very many copies is reduced to one row per map task before the shuffle. The
    8-byte hash in front of the text keeps the sort of the aggregation cheap; equality is
    still decided on the whole text.
    """
    rest = [c for c in df.columns if c != text]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    grouped = df.groupBy(F.xxhash64(text).alias("_h"), F.col(text)).agg(first)
    picked = {c: F.col(f"_first.{c}") for c in rest}
    return grouped.select(*[F.col(text) if c == text else picked[c].alias(c) for c in df.columns])


def clean_long_texts(df: DataFrame, n: int = 20, text: str = "text") -> DataFrame:
    """`clean_text` and `min_length` in one step.

    A filter on the cleaned text would be pushed below the cleaning and clean each text a
    second time; exploding an array of no or one text evaluates the expressions once.
    """
    kept = F.filter(F.array(T.clean_text(F.col(text))), lambda t: F.length(t) > n)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(kept).alias(text)).select(*df.columns)


def clean_corpus(
    df: DataFrame, order: list[str | Column], n: int = 20, text: str = "text"
) -> DataFrame:
    """Clean the text, keep texts longer than `n` code points, keep the first of equal texts."""
    return dedup_exact(clean_long_texts(df, n, text), order, text)


def cleaning_counts(
    df: DataFrame, order: list[str | Column], n: int = 20, text: str = "text"
) -> DataFrame:
    """Rows in, rows long enough, rows left after deduplication; one pass and one shuffle."""
    cleaned = df.select(T.clean_text(F.col(text)).alias(text))
    per_text = cleaned.groupBy(F.xxhash64(text).alias("_h"), F.col(text)).agg(
        F.count("*").alias("_n")
    )
    long_enough = F.length(text) > n
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.when(long_enough, F.col("_n"))), F.lit(0)).alias("long_rows"),
        F.count(F.when(long_enough, 1)).alias("output_rows"),
    )
