"""What a dataset consists of, and how much of it was generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.columns import ratio

SYNTHETIC_MARK = "synthetic"


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def is_synthetic(source: Column, mark: str = SYNTHETIC_MARK) -> Column:
    return F.contains(source, F.lit(mark))


def source_kinds(df: DataFrame, mark: str = SYNTHETIC_MARK) -> DataFrame:
    """(source, kind, n) with kind `synthetic` or `real`."""
    kind = F.when(is_synthetic(F.col("source"), mark), "synthetic").otherwise("real")
    return df.groupBy("source").agg(F.count("*").alias("n")).select("source", kind.alias("kind"), "n")


def synthetic_fraction(df: DataFrame, mark: str = SYNTHETIC_MARK) -> DataFrame:
    synthetic = F.count(F.when(is_synthetic(F.col("source"), mark), 1))
    return df.agg(
        F.count("*").alias("total_samples"),
        ratio(synthetic, F.count("*")).alias("synthetic_fraction"),
    )


def dataset_metadata(df: DataFrame, mark: str = SYNTHETIC_MARK) -> DataFrame:
    """One record about the whole set; the rows are reduced to (source, label) counts first."""
    cells = df.groupBy("source", "label").agg(F.count("*").alias("n"))
    sources = cells.groupBy("source").agg(F.sum("n").alias("n"))
    labels = cells.groupBy(F.col("label").cast("string").alias("label")).agg(F.sum("n").alias("n"))

    def as_map(key: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n"))))

    synthetic = is_synthetic(F.col("source"), mark)
    return sources.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        as_map("source").alias("source_counts"),
        F.sort_array(F.collect_list(F.when(synthetic, F.col("source")))).alias("synthetic_sources"),
        F.sort_array(F.collect_list(F.when(~synthetic, F.col("source")))).alias("real_sources"),
        ratio(F.coalesce(F.sum(F.when(synthetic, F.col("n"))), F.lit(0)), F.sum("n")).alias("synthetic_fraction"),
    ).withColumn("label_counts", labels.agg(as_map("label")).scalar())


def composition_gate(df: DataFrame, mark: str = SYNTHETIC_MARK) -> DataFrame:
    """`warn` when any row comes from a generated source."""
    status = F.when(F.col("synthetic_fraction") > 0, "warn").otherwise("ok")
    return synthetic_fraction(df, mark).select("synthetic_fraction", status.alias("status"))
