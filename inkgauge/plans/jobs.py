"""The batch jobs from end to end: build a data set, train, evaluate, hold out, score.

Each job reads tables and writes tables; the next one starts from what the last one wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.operators import (
    challenge,
    cleaning,
    decisions,
    governance,
    metrics,
    models,
    ngram_model,
    splits,
    style,
    tfidf,
)
from inkgauge.operators.joins import heavy_keys, salted_join
from inkgauge.plans.views import add_features, batch_features
from inkgauge.session import stored
from inkgauge.sources import generate, readers, sinks

KEY = "row_id"
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    """A labelled table; `generate_seeds` > 0 allows generated rows when it is missing."""

    name: str
    path: str
    fmt: str = "parquet"
    generate_seeds: int = 0


def _read(spark: SparkSession, source: Source) -> DataFrame:
    if not source.generate_seeds:
        return readers.standardise(readers.read_samples(spark, source.path, source.fmt, required=()), source.name)
    seeds = spark.range(source.generate_seeds).withColumnRenamed("id", "doc_id")
    return readers.load_or_fallback(
        spark, source.path, source.name, lambda: generate.generate_templates(seeds), source.fmt
    )


def build_dataset(
    spark: SparkSession, sources: list[Source], out: str, skip_perplexity: bool = False, fmt: str = "parquet"
) -> DataFrame:
    """Union, clean, add features, split and write; returns the composition gate.

    The key is the digest of the raw text, so it does not depend on how the input is split. Rows
    without a label are counted by source in `unlabelled` and left out. The language model of the
    set is written to `language_model`, for new texts.
    """
    rows = readers.union_sources([_read(spark, s) for s in sources]).withColumn(
        KEY, F.md5(F.coalesce("text", F.lit("")))
    )
    unlabelled = rows.where(F.col("label").isNull()).groupBy("source").agg(F.count("*").alias("rows"))
    sinks.write_table(unlabelled, f"{out}/unlabelled", "csv")
    labelled = rows.where(F.col("label").isNotNull())
    clean = stored(cleaning.clean_corpus(labelled, ["source_rank", KEY, "label"]), "clean")
    if skip_perplexity:
        feats = style.skip_perplexity(style.add_sentence_features(clean))
    else:
        folded = ngram_model.assign_fold(clean, KEY)
        sinks.save_ngram(ngram_model.fit(folded), spark, f"{out}/language_model")
        feats = add_features(folded, KEY, sinks.load_ngram(spark, f"{out}/language_model"))
    table = splits.stratified_split(feats, key=KEY).select(
        KEY, "text", "label", "source", "burstiness", "perplexity", "split"
    )
    sinks.write_splits(table, f"{out}/samples", fmt)
    sinks.write_summary_json(governance.dataset_metadata(clean), f"{out}/dataset_metadata")
    return governance.composition_gate(clean)


def load_dataset(spark: SparkSession, data: str) -> DataFrame:
    return style.scaled_stats(spark.read.parquet(f"{data}/samples"))


def train_baseline(spark: SparkSession, data: str, model_path: str, k: int = tfidf.VOCABULARY_SIZE) -> DataFrame:
    """Fit on the train split and save; writes and returns accuracy and F1 on the validation split."""
    rows = load_dataset(spark, data)
    train = rows.where(F.col("split") == "train")
    vocab = tfidf.fit(train, k)
    ready = stored(tfidf.assemble_features(train, vocab).select("label", "features"), "train")
    model = models.fit_logistic(ready)
    sinks.save_baseline(model, vocab, train, model_path)
    checked = models.score_dataframe(rows.where(F.col("split") == "val"), model, vocab)
    return _training_result(checked, "baseline", model_path)


def _training_result(checked: DataFrame, name: str, model_path: str) -> DataFrame:
    result = metrics.binary_metrics(checked).select(F.lit(name).alias("model"), "accuracy", "f1")
    sinks.write_summary_json(result, f"{model_path}/training_results")
    return result


def baseline_scorer(spark: SparkSession, model_path: str) -> Scorer | None:
    """Adds `pred` and `prob` of the saved baseline; None when it has not been trained."""
    loaded = sinks.load_baseline(spark, model_path)
    return loaded and (lambda df: models.score_dataframe(df, *loaded))


def train_hybrid(
    spark: SparkSession,
    data: str,
    vectors: DataFrame,
    model_path: str,
    dimensions: int,
    hidden: tuple[int, ...] = (256, 64),
    max_iter: int = 100,
) -> DataFrame:
    """As `train_baseline`, for the network on document vectors (`row_id`, `embedding`) and stylometry.

    A document without a vector takes part with zeros; their number by split is written to
    `without_vector`.
    """
    joined = models.frozen_encoder_features(load_dataset(spark, data), vectors, KEY, KEY)
    rows = stored(models.hybrid_vector(joined, dimensions), "hybrid-rows")
    without = rows.groupBy("split").agg(F.count(F.when(~F.col("has_vector"), 1)).alias("rows"))
    sinks.write_table(without, f"{model_path}/without_vector", "csv")
    train = rows.where(F.col("split") == "train").select("label", "features")
    model = models.fit_hybrid(train, dimensions, hidden, max_iter)
    sinks.save_hybrid(model, f"{model_path}/network")
    return _training_result(models.predict(model, rows.where(F.col("split") == "val")), "hybrid", model_path)


def hybrid_scorer(model_path: str, vectors: DataFrame) -> Scorer:
    """Adds `pred` and `prob` of the saved hybrid; a row gets the vector of its `row_id`."""
    model = sinks.load_hybrid(f"{model_path}/network")
    dimensions = model.getLayers()[0] - 2

    def score(df: DataFrame) -> DataFrame:
        joined = models.frozen_encoder_features(df, vectors, KEY, KEY)
        return models.predict(model, models.hybrid_vector(joined, dimensions)).drop("embedding", "features")

    return score


def evaluate(spark: SparkSession, data: str, scorers: dict[str, Scorer], out: str) -> DataFrame:
    """All reports of the named models on the test split; returns the metrics by model.

    The predictions are written once and every report reads them.
    """
    test = load_dataset(spark, data).where(F.col("split") == "test")

    def scored(rows: DataFrame, name: str) -> DataFrame:
        parts = [
            score(rows).withColumn("model", F.lit(m)).drop("features", "tfidf") for m, score in scorers.items()
        ]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part, allowMissingColumns=True)
        return stored(union, name)

    rows = scored(test, "predictions")
    by_model = metrics.metrics(rows, ["model"])
    sinks.write_table(by_model, f"{out}/metrics", "csv")
    comparison = metrics.compare(by_model, list(dict.fromkeys(["baseline", "hybrid", *scorers])))
    sinks.write_table(comparison, f"{out}/model_comparison", "csv")
    sinks.write_summary_json(metrics.comparison_verdict(comparison, "baseline", "hybrid"), f"{out}/verdict")
    for name in scorers:
        own = rows.where(F.col("model") == name)
        sinks.write_table(metrics.metrics_by_source(own), f"{out}/{name}/source_metrics", "csv")
        sinks.write_table(metrics.classification_report(own), f"{out}/{name}/report", "csv")
        sinks.write_table(metrics.confusion_counts(own), f"{out}/{name}/confusion", "csv")
        sinks.write_table(metrics.roc_points(own, drop_intermediate=True), f"{out}/{name}/roc", "csv")
        sinks.write_table(metrics.probability_histogram(own), f"{out}/{name}/histogram", "csv")
        sinks.write_table(metrics.burstiness_vs_probability(own), f"{out}/{name}/burstiness", "csv")
        sinks.write_summary_json(metrics.unscored_rows(own), f"{out}/{name}/unscored")
        errors = metrics.top_errors(own, key=KEY).drop("sentence_lengths")
        sinks.write_table(errors, f"{out}/{name}/misclassified", "csv")
        sinks.write_summary_json(metrics.error_summary(own), f"{out}/{name}/error_summary")

    edited = scored(challenge.build_challenge(test, key=KEY), "challenge")
    edited_metrics = metrics.metrics(edited, ["model"])
    sinks.write_summary_json(edited_metrics, f"{out}/challenge_results")
    sinks.write_table(challenge.robustness_table(by_model, edited_metrics), f"{out}/robustness", "csv")

    def side_by_side(df: DataFrame) -> DataFrame:
        for name, score in scorers.items():
            marks = {"pred": f"{name}_pred", "prob": f"{name}_prob"}
            df = score(df).drop("features", "tfidf", "has_vector").withColumnsRenamed(marks)
        return df

    sinks.write_table(challenge.challenge_preview(test, side_by_side, key=KEY), f"{out}/challenge_preview", "csv")
    sinks.write_summary_json(by_model, f"{out}/evaluation_results")
    return by_model


def held_out(spark: SparkSession, data: str, out: str, **options) -> DataFrame:
    result = models.source_held_out(load_dataset(spark, data), **options)
    sinks.write_table(result.coalesce(1).sortWithinPartitions("held_out_source"), f"{out}/source_held_out", "csv")
    return result


def score_files(
    spark: SparkSession,
    path: str,
    score: Scorer,
    language_model: ngram_model.NgramModel,
    out: str,
    fmt: str = "csv",
    schema: str | None = None,
    key: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Score a batch of texts as they are and write the result table with display texts.

    `language_model` is that of the data set, so a text's result does not depend on the batch.
    Every input row gives one row with `row_id`, the column `key` or else a number in the order
    of files and lines, and with the columns of `keep`.

    Equal texts have equal results, so each text is scored once and joined to its rows; the
    join is salted because one text may hold a large part of them. A row without a text keeps
    its place with null scores.
    """
    raw = readers.read_samples(spark, path, fmt, schema)
    row_id = F.col(key) if key else F.monotonically_increasing_id()
    own = [F.col(c).alias(f"_{c}") for c in keep]
    keyed = raw.select(row_id.alias("row_id"), *own, F.md5("text").alias("doc_id"), "text")
    given = keyed.where(F.col("text").isNotNull())
    texts = stored(cleaning.dedup_exact(given.select("doc_id", "text"), ["doc_id"]), "texts")
    # the scorer reads the text
    features = batch_features(texts, language_model).drop("text").join(texts, "doc_id")
    table = stored(decisions.score_batch(score(features), display=True), "scored-texts")
    copies = given.groupBy("doc_id").agg(F.count("*").alias("n"))
    heavy = heavy_keys(copies, ["doc_id"], "n", given.count())
    numbered = given.drop("text")
    identity = ["row_id", *[f"_{c}" for c in keep]]
    rows = salted_join(numbered, table, ["doc_id"], heavy, ["row_id"]).select(*identity, *table.columns)
    no_text = keyed.where(F.col("text").isNull())
    blank = no_text.select(*identity, *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
    out_table = rows.unionByName(blank).drop("doc_id")
    if not set(keep) & {"row_id", *table.columns}:  # else they stay apart by their underscore
        out_table = out_table.withColumnsRenamed({f"_{c}": c for c in keep})
    sinks.write_table(out_table, out, "csv")
    return readers.read_samples(spark, out, "csv", out_table.schema)
