"""Writing splits, tables, summaries and models."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.operators.models import MlpHead, coefficient_table
from inkgauge.operators.ngram_model import NgramModel
from inkgauge.operators.tfidf import TfidfModel

_CSV = {"header": True, "quote": '"', "escape": '"'}


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, so that readers of one split skip the others."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def summary_json(summary: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(value): each row as a JSON object. NaN, which JSON does not have, becomes null."""
    columns = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in summary.dtypes
        if c not in drop
    ]
    return summary.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_summary_json(summary: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    summary_json(summary, drop).write.mode("overwrite").text(path)


def save_baseline(model: LogisticRegressionModel, vocab: TfidfModel, like: DataFrame, path: str) -> None:
    """Classifier as a Spark ML model; vocabulary and coefficients also as tables."""
    model.write().overwrite().save(f"{path}/classifier")
    vocab.table(like.sparkSession).write.mode("overwrite").parquet(f"{path}/vocabulary")
    coefficient_table(model, vocab, like).write.mode("overwrite").parquet(f"{path}/coefficients")


def load_baseline(spark: SparkSession, path: str) -> tuple[LogisticRegressionModel, TfidfModel] | None:
    """The saved baseline, or None when there is none, in which case its scoring is skipped."""
    try:
        table = spark.read.parquet(f"{path}/vocabulary")
    except AnalysisException:
        return None
    rows = table.orderBy("term_index").collect()
    vocab = TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])
    return LogisticRegressionModel.load(f"{path}/classifier"), vocab


_NGRAM_TABLES = ("bigrams", "prefixes", "unigrams")


def save_ngram(model: NgramModel, spark: SparkSession, path: str) -> None:
    """The three count tables of a language model, written where they lie, and their totals."""
    for name in _NGRAM_TABLES:
        getattr(model, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    totals = [(model.distinct_pairs, model.tokens_by_fold, model.vocabulary)]
    schema = "distinct_pairs long, tokens_by_fold array<long>, vocabulary long"
    spark.createDataFrame(totals, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def load_ngram(spark: SparkSession, path: str) -> NgramModel:
    """The saved language model; a missing one is an error."""
    totals = spark.read.parquet(f"{path}/totals").first()
    tables = [spark.read.parquet(f"{path}/{name}") for name in _NGRAM_TABLES]
    return NgramModel(*tables, totals["distinct_pairs"], list(totals["tokens_by_fold"]), totals["vocabulary"])


def save_head(head: MlpHead, spark: SparkSession, path: str) -> None:
    """The layers of a head as a table."""
    rows = [(i, *w.shape, w.ravel().tolist(), np.asarray(b).tolist()) for i, (w, b) in enumerate(head.layers)]
    schema = "layer int, inputs int, outputs int, weights array<double>, bias array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> MlpHead:
    """The saved head; a missing one is an error."""
    rows = spark.read.parquet(path).orderBy("layer").collect()
    return MlpHead([(np.array(r["weights"]).reshape(r["inputs"], r["outputs"]), np.array(r["bias"])) for r in rows])


def save_hybrid(model: MultilayerPerceptronClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_hybrid(path: str) -> MultilayerPerceptronClassificationModel:
    """The saved hybrid; a missing one is an error."""
    return MultilayerPerceptronClassificationModel.load(path)
