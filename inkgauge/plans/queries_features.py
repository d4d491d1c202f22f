"""Perplexity, TF-IDF, splits and the decision layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.operators import decisions, ngram_model, splits, style, tfidf
from inkgauge.plans import oracle_parts as O
from inkgauge.plans.registry import query
from inkgauge.plans.views import Views, add_predictions, as_scored, batch_features

ROUND = 6
# perplexities run to a million, so fewer decimals are the same relative precision
PPL_ROUND = 3


@query("perplexity", O.with_views("SELECT doc_id, round(perplexity, 3) AS perplexity FROM every_feats", "every_feats"))
def perplexity(v: Views) -> DataFrame:
    return v.every_feats().select("doc_id", F.round("perplexity", PPL_ROUND).alias("perplexity"))


@query("lm_unigram_counts", O.with_views("SELECT fold::INTEGER AS fold, term, n FROM eppl_uni", "eppl_uni"))
def lm_unigram_counts(v: Views) -> DataFrame:
    return ngram_model.unigram_counts(ngram_model.assign_fold(v.every()))


@query("lm_bigram_counts", O.with_views("SELECT fold::INTEGER AS fold, prev, term, n FROM eppl_bi", "eppl_bi"))
def lm_bigram_counts(v: Views) -> DataFrame:
    return ngram_model.bigram_counts(ngram_model.assign_fold(v.every()))


@query(
    "lm_crossfit_score",
    O.with_views(
        "SELECT doc_id, round(unigram_perplexity, 3) AS unigram_perplexity, round(perplexity, 3) AS perplexity FROM eppl",
        "eppl",
    ),
)
def lm_crossfit_score(v: Views) -> DataFrame:
    scores = ngram_model.crossfit_perplexity(ngram_model.assign_fold(v.every()), model=v.every_model())
    return scores.withColumns(
        {c: F.round(c, PPL_ROUND) for c in ("unigram_perplexity", "perplexity")}
    )


@query(
    "new_text_perplexity",
    O.with_views(
        "SELECT doc_id, round(unigram_perplexity, 3) AS unigram_perplexity, round(perplexity, 3) AS perplexity FROM rawppl",
        "rawppl",
    ),
)
def new_text_perplexity(v: Views) -> DataFrame:
    """All documents as they are, as texts from outside the corpus."""
    scores = ngram_model.new_text_perplexity(v.table("documents"), v.language_model())
    return scores.withColumns({c: F.round(c, PPL_ROUND) for c in ("unigram_perplexity", "perplexity")})


@query(
    "skip_perplexity",
    O.with_views("SELECT doc_id, 0.0::DOUBLE AS perplexity, round(burstiness, 6) AS burstiness FROM every_style", "every_style"),
)
def skip_perplexity(v: Views) -> DataFrame:
    return style.skip_perplexity(style.add_sentence_features(v.every())).select(
        "doc_id", "perplexity", F.round("burstiness", ROUND).alias("burstiness")
    )


@query(
    "scaled_stats",
    O.with_views("SELECT doc_id, round(perp_scaled, 6) AS perp_scaled, round(burst_scaled, 6) AS burst_scaled FROM every_feats", "every_feats"),
)
def scaled_stats(v: Views) -> DataFrame:
    return v.every_feats().select(
        "doc_id", F.round("perp_scaled", ROUND).alias("perp_scaled"), F.round("burst_scaled", ROUND).alias("burst_scaled")
    )


@query(
    "feature_means",
    O.with_views("SELECT round(avg(perplexity), 3) AS mean_perplexity, round(avg(burstiness), 6) AS mean_burstiness FROM every_feats", "every_feats"),
)
def feature_means(v: Views) -> DataFrame:
    means = style.feature_means(v.every_feats())
    return means.select(
        F.round("mean_perplexity", PPL_ROUND).alias("mean_perplexity"),
        F.round("mean_burstiness", ROUND).alias("mean_burstiness"),
    )


# TF-IDF


@query("term_doc_counts", O.with_views("SELECT doc_id, term, tf FROM every_tf", "every_tf"))
def term_doc_counts(v: Views) -> DataFrame:
    return tfidf.term_doc_counts(v.every())


@query("vocabulary", O.with_views("SELECT term, total, df FROM every_vocab", "every_vocab"))
def vocabulary(v: Views) -> DataFrame:
    return tfidf.vocabulary(tfidf.term_stats(v.every()))


@query(
    "idf",
    O.with_views(
        "SELECT term, df, round(idf, 6) AS idf FROM every_stats", "every_stats"
    ),
)
def idf(v: Views) -> DataFrame:
    texts = v.every()
    weighted = tfidf.idf(tfidf.term_stats(texts), texts.count())
    return weighted.select("term", "df", F.round("idf", ROUND).alias("idf"))


@query("tfidf_fit_transform", O.with_views("SELECT doc_id, term, round(weight, 6) AS weight FROM every_weights", "every_weights"))
def tfidf_fit_transform(v: Views) -> DataFrame:
    texts = v.every()
    return tfidf.fit(texts).weights(texts).withColumn("weight", F.round("weight", ROUND))


_TRAIN_VOCAB = {
    "train_tf": ("SELECT t.* FROM tf t JOIN split s USING (doc_id) WHERE s.split = 'train'", ("tf", "split")),
    "train_vocab": (
        "SELECT *, ln((1.0 + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0 + df)) + 1 AS idf FROM ("
        "SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM train_tf GROUP BY term ORDER BY total DESC, term LIMIT 10000)",
        ("train_tf", "split"),
    ),
    "test_weighted": (
        "SELECT t.doc_id, t.term, t.tf * v.idf AS w FROM tf t JOIN train_vocab v USING (term) JOIN split s USING (doc_id) WHERE s.split = 'test'",
        ("tf", "train_vocab", "split"),
    ),
    "test_weights": (
        "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM test_weighted",
        ("test_weighted",),
    ),
}
O.CTES.update(_TRAIN_VOCAB)


@query(
    "tfidf_transform",
    O.with_views("SELECT doc_id, term, round(weight, 6) AS weight FROM test_weights", "test_weights"),
)
def tfidf_transform(v: Views) -> DataFrame:
    rows = v.split()
    model = tfidf.fit(rows.where(F.col("split") == "train"))
    test = rows.where(F.col("split") == "test")
    return model.weights(test).withColumn("weight", F.round("weight", ROUND))


@query(
    "assemble_features",
    O.with_views(
        """SELECT f.doc_id, (SELECT count(*) FROM vocab)::INTEGER + 2 AS n_features,
  coalesce(w.n, 0) + (coalesce(f.perplexity, 0) <> 0)::INT + (f.burstiness <> 0)::INT AS n_entries,
  round(coalesce(w.total, 0) + coalesce(f.perplexity, 0) + f.burstiness, 3) AS entry_sum
FROM feats f LEFT JOIN (SELECT doc_id, count(*)::INTEGER AS n, sum(weight) AS total FROM weights GROUP BY doc_id) w USING (doc_id)""",
        "feats",
        "weights",
        "vocab",
    ),
)
def assemble_features(v: Views) -> DataFrame:
    feats = v.feats()
    rows = tfidf.assemble_features(feats, tfidf.fit(v.clean())).select(
        "doc_id", F.unwrap_udt("features").alias("f")
    )
    values = F.filter("f.values", lambda x: x != 0)
    return rows.select(
        "doc_id",
        F.coalesce("f.size", F.size("f.values")).alias("n_features"),
        F.size(values).alias("n_entries"),
        F.round(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), PPL_ROUND).alias("entry_sum"),
    )


# splits


@query("stratified_split", O.with_views("SELECT doc_id, label, split FROM split", "split"))
def stratified_split(v: Views) -> DataFrame:
    return splits.stratified_split(v.clean()).select("doc_id", "label", "split")


@query(
    "split_label_counts",
    O.with_views(
        "SELECT split, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai FROM split GROUP BY split", "split"
    ),
)
def split_label_counts(v: Views) -> DataFrame:
    return splits.split_label_counts(splits.stratified_split(v.clean()))


@query("sample_n", f"SELECT doc_id, source, n_chars FROM documents ORDER BY {O.hashed('sample', 'doc_id')}, doc_id LIMIT 150")
def sample_n(v: Views) -> DataFrame:
    return splits.sample_n(v.table("documents").select("doc_id", "source", "n_chars"), 150)


@query("train_pool", O.with_views("SELECT doc_id, split FROM split WHERE split IN ('train', 'val')", "split"))
def train_pool(v: Views) -> DataFrame:
    return splits.train_pool(splits.stratified_split(v.clean())).select("doc_id", "split")


@query(
    "holdout_folds",
    O.with_views(
        """SELECT t.source AS held_out_source, (SELECT count(*) FROM split p WHERE p.split <> 'test' AND p.source <> t.source) AS train_samples, t.n AS test_samples
FROM (SELECT source, count(*) AS n FROM split WHERE split = 'test' GROUP BY source) t""",
        "split",
    ),
)
def holdout_folds(v: Views) -> DataFrame:
    return splits.holdout_folds(splits.stratified_split(v.clean()))


@query(
    "holdout_rows",
    O.with_views(
        """SELECT source AS held_out, doc_id, 'test' AS side FROM split WHERE split = 'test'
  AND source = (SELECT min(source) FROM split WHERE split = 'test')
UNION ALL SELECT (SELECT min(source) FROM split WHERE split = 'test'), doc_id, 'train' FROM split WHERE split <> 'test'
  AND source <> (SELECT min(source) FROM split WHERE split = 'test')""",
        "split",
    ),
)
def holdout_rows(v: Views) -> DataFrame:
    rows = splits.stratified_split(v.clean())
    first = splits.holdout_folds(rows).agg(F.min("held_out_source")).first()[0]
    train, test = splits.holdout_rows(rows, first)
    sides = test.withColumn("side", F.lit("test")).unionByName(train.withColumn("side", F.lit("train")))
    return sides.select(F.lit(first).alias("held_out"), "doc_id", "side")


# decisions


def _scored(v: Views) -> DataFrame:
    return as_scored(v.pred())


def _column(name: str, sql: str, make: Callable[[], Column]) -> None:
    """One derived column over the predictions."""

    @query(name, O.with_views(f"SELECT doc_id, prob, {sql} AS {name} FROM scored", "scored"))
    def run(v: Views) -> DataFrame:
        return _scored(v).select("doc_id", "prob", make().alias(name))


def _p() -> Column:
    return F.col("prob")


_column("confidence", f"round({O.CONFIDENCE}, 6)", lambda: F.round(decisions.confidence(_p()), ROUND))
_column("decision_label", "CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END", lambda: decisions.decision_label(_p()))
_column("gray_zone", O.GRAY_ZONE, lambda: decisions.gray_zone(_p()))
_column(
    "probability_band",
    "CASE WHEN prob < 0.3 THEN 'low' WHEN prob < 0.7 THEN 'mid' ELSE 'high' END",
    lambda: decisions.probability_band(_p()),
)
_column(
    "position_band",
    "CASE WHEN prob * 100 < 40 THEN '0-40' WHEN prob * 100 < 60 THEN '40-60' WHEN prob * 100 < 85 THEN '60-85' ELSE '85-100' END",
    lambda: decisions.position_band(_p()),
)
_column(
    "perplexity_band",
    "CASE WHEN perplexity < 40 THEN 'predictable' WHEN perplexity < 65 THEN 'mixed' WHEN perplexity IS NOT NULL THEN 'varied' END",
    lambda: decisions.perplexity_band(F.col("perplexity")),
)
_column(
    "burstiness_band",
    "CASE WHEN burstiness < 2.5 THEN 'uniform' WHEN burstiness < 4 THEN 'some' ELSE 'varied' END",
    lambda: decisions.burstiness_band(F.col("burstiness")),
)
_column(
    "probability_reason",
    f"CASE WHEN {O.GRAY_ZONE} = 'edited_ai' THEN 'leans_ai_with_edits' WHEN prob >= 0.85 THEN 'strong_ai_signals' WHEN prob <= 0.40 THEN 'leans_human' ELSE 'mixed_signals' END",
    lambda: decisions.probability_reason(_p(), decisions.gray_zone(_p())),
)
_column(
    "short_reason",
    f"CASE {O.GRAY_ZONE} WHEN 'edited_ai' THEN 'ai_structure_human_edits' WHEN 'strong_ai' THEN 'predictable_synthetic_pattern' WHEN 'likely_human' THEN 'varied_less_machine_like' ELSE 'mixed_evidence' END",
    lambda: decisions.short_reason(decisions.gray_zone(_p())),
)


@query(
    "signal_flags",
    O.with_views(
        """SELECT doc_id, CASE WHEN perplexity > 50 THEN 'high' WHEN perplexity IS NOT NULL THEN 'low' END AS perplexity_flag,
  CASE WHEN burstiness > 3 THEN 'high' ELSE 'low' END AS burstiness_flag FROM feats""",
        "feats",
    ),
)
def signal_flags(v: Views) -> DataFrame:
    return v.feats().select(
        "doc_id",
        decisions.perplexity_flag(F.col("perplexity")).alias("perplexity_flag"),
        decisions.burstiness_flag(F.col("burstiness")).alias("burstiness_flag"),
    )


@query(
    "signal_profile",
    O.with_views(
        f"""SELECT doc_id, 'probability' AS signal, prob AS score, format('{{:.1f}}', prob * 100) || '%' AS display FROM scored
UNION ALL SELECT doc_id, 'confidence', round(least(({O.CONFIDENCE}) / 100, 1), 6), format('{{:.1f}}', {O.CONFIDENCE}) || '%' FROM scored
UNION ALL SELECT doc_id, 'perplexity', CASE WHEN perplexity IS NOT NULL THEN round(least(perplexity / 80, 1), 6) END, format('{{:.1f}}', perplexity) FROM scored
UNION ALL SELECT doc_id, 'burstiness', round(least(burstiness / 6, 1), 6), format('{{:.2f}}', burstiness) FROM scored""",
        "scored",
    ),
)
def signal_profile(v: Views) -> DataFrame:
    return decisions.signal_profile(_scored(v)).withColumn("score", F.round("score", ROUND))


@query(
    "format_scores",
    O.with_views(
        f"""SELECT doc_id, format('{{:.2f}}', prob * 100) || '%' AS probability, format('{{:.1f}}', {O.CONFIDENCE}) || '%' AS confidence,
  format('{{:.1f}}', perplexity) AS perplexity, format('{{:.2f}}', burstiness) AS burstiness FROM scored""",
        "scored",
    ),
)
def format_scores(v: Views) -> DataFrame:
    return _scored(v).select(
        "doc_id",
        T.as_percent(_p()).alias("probability"),
        F.concat(T.fixed_decimals(decisions.confidence(_p()), 1), F.lit("%")).alias("confidence"),
        T.fixed_decimals(F.col("perplexity"), 1).alias("perplexity"),
        T.fixed_decimals(F.col("burstiness"), 2).alias("burstiness"),
    )


@query(
    "score_batch",
    O.with_views(
        f"""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text, prob AS probability,
  CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS label, {O.GRAY_ZONE} AS interpretation, round({O.CONFIDENCE}, 6) AS confidence,
  round(perplexity, 3) AS perplexity, round(burstiness, 6) AS burstiness FROM raw_scored""",
        "raw_scored",
    ),
)
def score_batch(v: Views) -> DataFrame:
    """All documents as they are, without cleaning."""
    raw = v.table("documents").select("doc_id", "text")
    scored = add_predictions(batch_features(raw, v.language_model())).withColumn("prob", F.col("prob_a"))
    out = decisions.score_batch(scored)
    return out.withColumns(
        {
            "confidence": F.round("confidence", ROUND),
            "perplexity": F.round("perplexity", PPL_ROUND),
            "burstiness": F.round("burstiness", ROUND),
        }
    )
