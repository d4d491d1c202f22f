"""The tables the registered queries start from.

The cleaned corpus and its features are written once per session below the shared folder and
read by all later jobs, the way the stages of the batch job hand their results on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.functions.columns import sigmoid
from inkgauge.operators import cleaning, models, ngram_model, splits, style, tfidf
from inkgauge.operators.decisions import decision_label
from inkgauge.session import stored, work_path
from inkgauge.sources import generate, readers, sinks

DECIMALS = 6
# intercept, weight of scaled perplexity, weight of scaled burstiness
COEFFICIENTS = {"a": (5.0, -1.5, -0.9), "b": (3.0, -0.4, -1.1)}
MODELS = {"baseline": ("pred_a", "prob_a"), "hybrid": ("pred_b", "prob_b")}

_done: dict[tuple[str, str, str], object] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def _once(self, name: str, make):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _done:
            _done[key] = make()
        return _done[key]

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    # corpus

    def base(self) -> DataFrame:
        """Labelled documents."""
        labels = self.table("labels").select("doc_id", F.col("quality").alias("label"))
        return self.table("documents").join(labels, "doc_id").select(
            "doc_id", "text", "label", "source", "lang"
        )

    def clean(self) -> DataFrame:
        return self._once("clean", lambda: stored(cleaning.clean_corpus(self.base(), ["doc_id"]), "clean"))

    def every(self) -> DataFrame:
        """All documents, labelled or not, cleaned."""
        documents = self.table("documents").select("doc_id", "text", "source", "lang")
        return self._once("every", lambda: stored(cleaning.clean_corpus(documents, ["doc_id"]), "every"))

    def every_model(self) -> ngram_model.NgramModel:
        """N-gram counts of all cleaned documents."""
        return self._once("every-model", lambda: ngram_model.fit(ngram_model.assign_fold(self.every())))

    def every_feats(self) -> DataFrame:
        """Features of all cleaned documents; the texts stay where they are."""

        def make() -> DataFrame:
            feats = add_features(self.every(), model=self.every_model())
            return stored(feats.drop("text", "sentence_lengths"), "every-feats")

        return self._once("every-feats", make)

    def language_model(self) -> ngram_model.NgramModel:
        """N-gram counts of the cleaned corpus, saved and loaded again."""
        return sinks.load_ngram(self.spark, self.language_model_path())

    def language_model_path(self) -> str:
        def make() -> str:
            path = work_path(self.spark, "language-model")
            sinks.save_ngram(ngram_model.fit(ngram_model.assign_fold(self.clean())), self.spark, path)
            return path

        return self._once("language-model", make)

    def feats(self) -> DataFrame:
        def make() -> DataFrame:
            return stored(add_features(self.clean(), model=self.language_model()), "feats")

        return self._once("feats", make)

    def pred(self) -> DataFrame:
        return add_predictions(self.feats())

    def split(self) -> DataFrame:
        return splits.stratified_split(self.feats())

    def tested(self) -> DataFrame:
        """Predictions on the test split."""
        return splits.stratified_split(self.pred()).where(F.col("split") == "test")

    # labelled sources

    def sources(self) -> list[DataFrame]:
        """Three labelled tables with the columns (doc_id, turn, text, label, source)."""
        base = self.base().withColumn("turn", F.lit(0).cast("long"))
        bench = self.table("benchmark").select(
            F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("turn"), "text", F.lit(0).alias("label")
        )
        talk = self.table("conversations").select(
            F.col("conv_id").alias("doc_id"),
            "turn",
            "text",
            F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("label"),
        )
        keep = ("doc_id", "turn")
        return [
            readers.tag_source(base, "documents", keep),
            readers.tag_source(bench, "benchmark", keep),
            readers.tag_source(readers.normalise_label(talk), "conversations", keep),
        ]

    def dataset(self) -> DataFrame:
        """The three sources and generated texts, one per document id."""
        made = generate.generate_templates(self.table("documents").select("doc_id"))
        made = made.withColumn("turn", F.lit(0).cast("long"))
        return readers.union_sources([*self.sources(), made])

    def dataset_clean(self) -> DataFrame:
        """The cleaned data set; `row_id` is unique over the sources."""

        def make() -> DataFrame:
            row_id = F.concat_ws(":", "source_rank", "doc_id", "turn")
            rows = self.dataset().withColumn("row_id", row_id)
            clean = cleaning.clean_corpus(rows, ["source_rank", "doc_id", "turn"])
            return stored(ngram_model.assign_fold(clean), "dataset-clean")

        return self._once("dataset-clean", make)

    def dataset_feats(self) -> DataFrame:
        """The cleaned data set with both features."""

        def make() -> DataFrame:
            return stored(add_features(self.dataset_clean(), "row_id"), "dataset-feats")

        return self._once("dataset-feats", make)

    # models

    def vocabulary(self) -> tfidf.TfidfModel:
        """TF-IDF vocabulary of the train split."""
        return self._once(
            "vocabulary", lambda: tfidf.fit(self.split().where(F.col("split") == "train"))
        )

    def baseline(self):
        """(classifier, vocabulary) fitted on the train split, saved and loaded again."""

        def make():
            vocab = self.vocabulary()
            train = self.split().where(F.col("split") == "train")
            rows = stored(tfidf.assemble_features(train, vocab).select("label", "features"), "train")
            path = work_path(self.spark, "baseline")
            sinks.save_baseline(models.fit_logistic(rows), vocab, train, path)
            return path

        return sinks.load_baseline(self.spark, self._once("baseline", make))


def add_features(
    clean: DataFrame, key: str = "doc_id", model: ngram_model.NgramModel | None = None
) -> DataFrame:
    """Both stylometric features of a corpus, raw and scaled; `model` are the counts of this corpus."""
    with_sentences = style.add_sentence_features(clean)
    return style.scaled_stats(ngram_model.add_perplexity(with_sentences, key, model=model))


def batch_features(raw: DataFrame, model: ngram_model.NgramModel, key: str = "doc_id") -> DataFrame:
    """Features of new, uncleaned texts for a result table, under the language model of a corpus.

    The table shows only the start of a text, so the whole text is not carried into the join.
    """
    shown = style.add_sentence_features(raw).withColumn("text", T.preview_text(F.col("text")))
    scores = ngram_model.new_text_perplexity(raw, model, key)
    return style.scaled_stats(shown.join(scores.select(key, "perplexity"), key, "left"))


def add_predictions(feats: DataFrame) -> DataFrame:
    """Two linear models with fixed coefficients over the scaled features.

    The probability is rounded before it is compared with anything; without one there is no class.
    """
    out = feats
    for name, (intercept, perp, burst) in COEFFICIENTS.items():
        z = F.lit(intercept) + perp * F.col("perp_scaled") + burst * F.col("burst_scaled")
        out = out.withColumn(f"prob_{name}", F.round(sigmoid(z), DECIMALS))
        out = out.withColumn(f"pred_{name}", decision_label(F.col(f"prob_{name}")))
    return out


def as_scored(pred: DataFrame, name: str = "a") -> DataFrame:
    """The predictions of one model as `pred` and `prob`."""
    return pred.withColumns({"pred": F.col(f"pred_{name}"), "prob": F.col(f"prob_{name}")})
