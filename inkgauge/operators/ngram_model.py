"""Perplexity of documents under n-gram counts of the corpus itself.

Counts are kept per fold, and a document is scored with the counts of the other folds only
(total minus own fold), so no text is predicted from itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.functions.columns import portable_hash
from inkgauge.operators import ngram_blocks
from inkgauge.operators.splits import SEED
from inkgauge.session import stored

FOLDS = 5
INTERPOLATION = 0.7
MAX_NLL = 100.0


def assign_fold(df: DataFrame, key: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """Adds `fold` by a hash of the key, so that ids in regular steps spread over all folds."""
    hashed = portable_hash(SEED, "fold", F.col(key))
    return df.withColumn("fold", F.pmod(hashed, F.lit(folds)).cast("int"))


def unigram_counts(df: DataFrame, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """(fold, term, n)"""
    return (
        df.select("fold", F.explode(T.lm_tokens(F.col(text), max_tokens)).alias("term"))
        .groupBy("fold", "term")
        .agg(F.count("*").alias("n"))
    )


def bigram_counts(df: DataFrame, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """(fold, prev, term, n)"""
    counted = ngram_blocks.count_pairs(df, T.lm_tokens(F.col(text), max_tokens), _characters(df, text))
    return counted.select("fold", "prev", "term", "n")


def _characters(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]


@dataclass(frozen=True)
class NgramModel:
    """Count tables of a corpus, each with a total and an array of the counts by fold.

    `bigrams` (prev, term, bi, bi_by_fold), `prefixes` (prev, pre, pre_by_fold, followers),
    `unigrams` (term, uni, uni_by_fold, preceders).
    """

    bigrams: DataFrame
    prefixes: DataFrame
    unigrams: DataFrame
    distinct_pairs: int
    tokens_by_fold: list[int]
    vocabulary: int

    @property
    def tokens(self) -> int:
        return sum(self.tokens_by_fold)


def _fold_sums(count_of_fold, folds: int) -> Column:
    return F.array(*[F.sum(count_of_fold(i)) for i in range(folds)])


def fit(
    df: DataFrame, folds: int = FOLDS, text: str = "text", max_tokens: int | None = None
) -> NgramModel:
    """Count the corpus once, keep the counts as tables in the shared folder.

    The first token of a document is counted as a pair with a null `prev`, so the unigram
    and prefix counts follow from the pair counts and the texts are read only once.
    """
    counted = ngram_blocks.count_pairs(df, T.lm_tokens(F.col(text), max_tokens), _characters(df, text), folds, start=True)
    starts_too = stored(counted, "bigrams")
    bigrams = starts_too.where(F.col("prev").isNotNull())

    def marginal(rows: DataFrame, by: str, total: str, width: str) -> DataFrame:
        return rows.groupBy(by).agg(
            F.sum("bi").alias(total),
            _fold_sums(lambda i: F.get("bi_by_fold", F.lit(i)), folds).alias(f"{total}_by_fold"),
            F.count("prev").alias(width),
        )

    prefixes = stored(marginal(bigrams, "prev", "pre", "followers"), "prefixes")
    unigrams = stored(marginal(starts_too, "term", "uni", "preceders"), "unigrams")
    totals = unigrams.agg(
        F.coalesce(F.sum("preceders"), F.lit(0)).alias("pairs"),
        F.count("*").alias("vocabulary"),
        _fold_sums(lambda i: F.get("uni_by_fold", F.lit(i)), folds).alias("by_fold"),
    ).first()
    by_fold = [n or 0 for n in totals["by_fold"]]
    return NgramModel(bigrams, prefixes, unigrams, totals["pairs"], by_fold, totals["vocabulary"])


def _perplexities(
    df: DataFrame, key: str, text: str, model: NgramModel, interpolation: float, max_tokens: int | None
) -> DataFrame:
    """(key, unigram_perplexity, perplexity) of `df` (key, fold, text) under the counts of the other folds."""
    tokens, by_fold, vocabulary = model.tokens, np.array([*model.tokens_by_fold, 0], np.int64), model.vocabulary

    def score(fold: np.ndarray, bi: np.ndarray, pre: np.ndarray, uni: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = (fold >= 0) & (fold < len(by_fold) - 1)
        n_tokens = tokens - by_fold[np.where(known, fold, -1)]
        with np.errstate(divide="raise"):
            add_one = (uni + 1) / (n_tokens + vocabulary)
        conditional = np.where(pre != 0, bi / np.where(pre != 0, pre, 1), 0.0)
        return -np.log(add_one), -np.log(interpolation * conditional + (1.0 - interpolation) * add_one)

    blocks = ngram_blocks.text_blocks(df, key, T.lm_tokens(F.col(text), max_tokens))
    sums = ngram_blocks.with_counts(blocks, model, df.schema[key].dataType.simpleString(), score, "_uni double, _bi double")

    def perplexity(nll: str) -> Column:
        return F.exp(F.least(F.sum(nll) / F.sum("n"), F.lit(MAX_NLL)))

    # a key may stand in several rows
    return sums.groupBy(F.col("key").alias(key)).agg(
        perplexity("_uni").alias("unigram_perplexity"), perplexity("_bi").alias("perplexity")
    )


def crossfit_perplexity(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folds: int = FOLDS,
    interpolation: float = INTERPOLATION,
    max_tokens: int | None = None,
    model: NgramModel | None = None,
) -> DataFrame:
    """(key, unigram_perplexity, perplexity) of every document with at least two tokens.

    The texts are coded in blocks; a block asks for the counts of each different pair and word once.
    """
    model = model or fit(df, folds, text, max_tokens)
    return _perplexities(df, key, text, model, interpolation, max_tokens)


def new_text_perplexity(
    df: DataFrame,
    model: NgramModel,
    key: str = "doc_id",
    text: str = "text",
    interpolation: float = INTERPOLATION,
    max_tokens: int | None = None,
) -> DataFrame:
    """Like `crossfit_perplexity` for texts outside the corpus of `model`; a missing count is 0."""
    alone = df.select(key, text, F.lit(None).cast("int").alias("fold"))
    return _perplexities(alone, key, text, model, interpolation, max_tokens)


def add_perplexity(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Adds `perplexity`; null for documents with fewer than two tokens."""
    folded = df if "fold" in df.columns else assign_fold(df, key, options.get("folds", FOLDS))
    scores = crossfit_perplexity(folded, key, text, **options).select(key, "perplexity")
    return df.join(scores, key, "left")
