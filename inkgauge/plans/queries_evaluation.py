"""Metrics, comparisons and the edited-text challenge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.operators import challenge, metrics, models, splits, tfidf
from inkgauge.plans import oracle_parts as O
from inkgauge.plans.registry import query
from inkgauge.plans.views import DECIMALS, MODELS, Views, add_predictions, as_scored
from inkgauge.operators import style

ROUND = 6


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names if n in df.columns})


def _scored(v: Views) -> DataFrame:
    return as_scored(v.pred())


_CONFUSION = """count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"""


@query(
    "unscored_rows",
    O.with_views(
        "SELECT count(*) AS total, count(*) FILTER (prob IS NULL) AS unscored FROM documents LEFT JOIN scored USING (doc_id)", "scored"
    ),
)
def unscored_rows(v: Views) -> DataFrame:
    """Documents that no metric can use: without a label, too short, or repeated."""
    return metrics.unscored_rows(v.table("documents").select("doc_id").join(_scored(v), "doc_id", "left"))


@query("confusion_counts", O.with_views(f"SELECT {_CONFUSION} FROM scored", "scored"))
def confusion_counts(v: Views) -> DataFrame:
    return metrics.confusion_counts(_scored(v))


@query("binary_metrics", O.with_views(f"SELECT {O.metric_columns()} FROM scored", "scored"))
def binary_metrics(v: Views) -> DataFrame:
    return _rounded(metrics.binary_metrics(_scored(v)), *metrics.METRICS)


@query("roc_auc", O.with_views(O.auc("scored"), "scored"))
def roc_auc(v: Views) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(v), decimals=DECIMALS), "roc_auc")


O.CTES["exact"] = ("SELECT label, round(burst_scaled, 12) AS prob FROM feats", ("feats",))


@query("roc_auc_unrounded", O.with_views(O.auc("exact"), "exact"))
def roc_auc_unrounded(v: Views) -> DataFrame:
    """The same over scores with all their digits."""
    return _rounded(metrics.roc_auc(v.feats().withColumn("prob", F.col("burst_scaled"))), "roc_auc")


_ROC = """SELECT prob AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM roc_rows{where}
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0"""
O.CTES["roc_cells"] = (
    "SELECT prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY prob",
    ("scored",),
)
O.CTES["roc_rows"] = (
    """SELECT prob, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM roc_cells WINDOW w AS (ORDER BY prob DESC)""",
    ("roc_cells",),
)


@query("roc_points", O.with_views(_ROC.format(where=""), "roc_rows"))
def roc_points(v: Views) -> DataFrame:
    return _rounded(metrics.roc_points(_scored(v), DECIMALS), "fpr", "tpr")


@query(
    "roc_points_bends",
    O.with_views(
        _ROC.format(where=" WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"), "roc_rows"
    ),
)
def roc_points_bends(v: Views) -> DataFrame:
    return _rounded(metrics.roc_points(_scored(v), DECIMALS, drop_intermediate=True), "fpr", "tpr")


O.CTES["per_class"] = (
    """SELECT CASE c WHEN 0 THEN 'human' ELSE 'ai' END AS name,
  coalesce(hit::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(truly, 0), 0) AS recall,
  coalesce(2.0 * hit / nullif(said + truly, 0), 0) AS f1, truly AS support
FROM (SELECT c, count(*) FILTER (pred = c AND label = c) AS hit, count(*) FILTER (pred = c) AS said, count(*) FILTER (label = c) AS truly
  FROM scored, range(0, 2) r(c) GROUP BY c)""",
    ("scored",),
)


@query(
    "classification_report",
    O.with_views(
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT name AS class, precision, recall, f1, support FROM per_class
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per_class
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per_class
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg((pred = label)::INT) AS a, count(*) AS n FROM scored))""",
        "scored",
        "per_class",
    ),
)
def classification_report(v: Views) -> DataFrame:
    return _rounded(metrics.classification_report(_scored(v)), "precision", "recall", "f1")


def _histogram_sql(lo: str, hi: str) -> str:
    return f"""SELECT r.label, b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 40), 6) AS lower,
  round(CASE WHEN b.bin = 39 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 40) END, 6) AS upper,
  (SELECT count(*) FROM scored s WHERE s.label = r.label AND s.prob >= lo + b.bin * ((hi - lo) / 40)
    AND (b.bin = 39 OR s.prob < lo + (b.bin + 1) * ((hi - lo) / 40))) AS n
FROM (SELECT label, CASE WHEN l = h THEN l - 0.5 ELSE l END AS lo, CASE WHEN l = h THEN h + 0.5 ELSE h END AS hi
  FROM (SELECT label, {lo} AS l, {hi} AS h FROM scored GROUP BY label)) r, range(0, 40) b(bin)"""


@query("probability_histogram", O.with_views(_histogram_sql("min(prob)", "max(prob)"), "scored"))
def probability_histogram(v: Views) -> DataFrame:
    return _rounded(metrics.probability_histogram(_scored(v)), "lower", "upper")


@query("probability_histogram_shared", O.with_views(_histogram_sql("0.0::DOUBLE", "1.0::DOUBLE"), "scored"))
def probability_histogram_shared(v: Views) -> DataFrame:
    return _rounded(metrics.probability_histogram(_scored(v), shared=True), "lower", "upper")


@query(
    "burstiness_vs_probability",
    O.with_views(
        "SELECT floor(burstiness)::BIGINT AS bin_x, least(floor(prob * 20), 19)::BIGINT AS bin_y, label, count(*) AS n FROM scored GROUP BY ALL",
        "scored",
    ),
)
def burstiness_vs_probability(v: Views) -> DataFrame:
    return metrics.burstiness_vs_probability(_scored(v))


@query("metrics_by_source", O.with_views(O.metrics("scored", "source"), "scored"))
def metrics_by_source(v: Views) -> DataFrame:
    return _rounded(metrics.metrics_by_source(_scored(v), decimals=DECIMALS), *metrics.METRICS)


O.CTES["model_metrics"] = (f"SELECT * FROM ({O.metrics('long', 'model')})", ("long",))
O.CTES["comparison"] = (
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max({m}) FILTER (model = 'baseline') AS baseline, max({m}) FILTER (model = 'hybrid') AS hybrid FROM model_metrics"
        for m in metrics.METRICS
    ),
    ("model_metrics",),
)


def _comparison(v: Views) -> DataFrame:
    return metrics.model_comparison(v.pred(), MODELS, DECIMALS)


@query("model_comparison", O.with_views("SELECT metric, baseline, hybrid FROM comparison", "comparison"))
def model_comparison(v: Views) -> DataFrame:
    return _rounded(_comparison(v), "baseline", "hybrid")


@query(
    "comparison_verdict",
    O.with_views(
        """SELECT CASE WHEN baseline IS NULL OR hybrid IS NULL THEN 'not_available' WHEN hybrid > baseline THEN 'hybrid_better'
  WHEN hybrid < baseline THEN 'baseline_better' ELSE 'tie' END AS verdict, baseline AS baseline_f1, hybrid AS hybrid_f1
FROM comparison WHERE metric = 'f1'""",
        "comparison",
    ),
)
def comparison_verdict(v: Views) -> DataFrame:
    verdict = metrics.comparison_verdict(_comparison(v), "baseline", "hybrid")
    return _rounded(verdict, "baseline_f1", "hybrid_f1")


@query(
    "top_errors",
    O.with_views(
        "SELECT doc_id, source, label, pred, prob, text FROM scored WHERE pred <> label ORDER BY prob DESC, doc_id LIMIT 50", "scored"
    ),
)
def top_errors(v: Views) -> DataFrame:
    return metrics.top_errors(_scored(v)).select("doc_id", "source", "label", "pred", "prob", "text")


@query(
    "error_summary",
    O.with_views(
        """SELECT count(*) AS total, count(*) FILTER (pred <> label) AS errors, count(*) FILTER (label = 0 AND pred = 1) AS false_positives,
  count(*) FILTER (label = 1 AND pred = 0) AS false_negatives FROM scored""",
        "scored",
    ),
)
def error_summary(v: Views) -> DataFrame:
    return metrics.error_summary(_scored(v))


@query("test_split_metrics", O.with_views(O.metrics("tested"), "tested"))
def test_split_metrics(v: Views) -> DataFrame:
    tested = as_scored(v.tested())
    return _rounded(metrics.metrics(tested, decimals=DECIMALS), *metrics.METRICS)


@query(
    "held_out_vocab",
    O.with_views(
        """SELECT held_out_source, term, total, df FROM (
  SELECT *, row_number() OVER (PARTITION BY held_out_source ORDER BY total DESC, term) AS rn FROM (
    SELECT h.lang AS held_out_source, t.term, sum(t.tf)::BIGINT AS total, count(*) AS df
    FROM (SELECT DISTINCT lang FROM clean) h JOIN (SELECT tf.*, c.lang FROM tf JOIN clean c USING (doc_id)) t ON t.lang <> h.lang GROUP BY ALL)) WHERE rn <= 10000""",
        "clean",
        "tf",
    ),
)
def held_out_vocab(v: Views) -> DataFrame:
    """Vocabulary without each language."""
    return tfidf.held_out_vocab(tfidf.term_stats(v.clean(), ["lang"]), "lang")


@query(
    "source_held_out",
    O.with_views(
        """SELECT held_out_source, train_samples, test_samples, CASE WHEN classes > 1 THEN 'ok' ELSE 'single_class' END AS status,
  CASE WHEN classes > 1 THEN true END AS optimal
FROM (SELECT t.source AS held_out_source, count(p.row_id) AS train_samples, any_value(t.n) AS test_samples, count(DISTINCT p.label) AS classes
  FROM (SELECT source, count(*) AS n FROM dataset_split WHERE split = 'test' GROUP BY source) t
  LEFT JOIN dataset_split p ON p.split <> 'test' AND p.source <> t.source GROUP BY t.source) WHERE train_samples > 0""",
        "dataset_split",
    ),
)
def source_held_out(v: Views) -> DataFrame:
    """Baseline refitted without each source of the whole data set: sizes, and whether every fit is optimal."""
    rows = splits.stratified_split(v.dataset_feats(), key="row_id")
    out = models.source_held_out(rows, "source")
    optimal = (F.col("residual") <= 1e-6).alias("optimal")
    return out.select("held_out_source", "train_samples", "test_samples", "status", optimal)


# edited texts


def _challenge(v: Views) -> DataFrame:
    edited = challenge.build_challenge(v.feats())
    return add_predictions(style.scaled_stats(edited))


@query(
    "build_challenge",
    O.with_views(
        "SELECT doc_id, source, label, original_text, text, round(burstiness, 6) AS burstiness, round(perplexity, 3) AS perplexity FROM challenge",
        "challenge",
    ),
)
def build_challenge(v: Views) -> DataFrame:
    return challenge.build_challenge(v.feats()).select(
        "doc_id",
        "source",
        "label",
        "original_text",
        "text",
        F.round("burstiness", ROUND).alias("burstiness"),
        F.round("perplexity", 3).alias("perplexity"),
    )


@query(
    "evaluate_challenge",
    O.with_views(
        f"SELECT model, {O.metric_columns()}, NULL::DOUBLE AS roc_auc FROM challenge_long GROUP BY model", "challenge_long"
    ),
)
def evaluate_challenge(v: Views) -> DataFrame:
    return _rounded(challenge.evaluate_challenge(_challenge(v), MODELS, DECIMALS), *metrics.METRICS)


@query(
    "challenge_preview",
    O.with_views(
        """SELECT doc_id, source, label, original_text, text, pred_b AS hybrid_pred, prob_b AS hybrid_prob, pred_a AS baseline_pred, prob_a AS baseline_prob
FROM challenge ORDER BY doc_id LIMIT 100""",
        "challenge",
    ),
)
def challenge_preview(v: Views) -> DataFrame:
    names = {"pred_a": "baseline_pred", "prob_a": "baseline_prob", "pred_b": "hybrid_pred", "prob_b": "hybrid_prob"}

    def score(edited: DataFrame) -> DataFrame:
        return add_predictions(style.scaled_stats(edited)).withColumnsRenamed(names)

    return challenge.challenge_preview(v.feats(), score)


@query(
    "robustness_table",
    O.with_views(
        """SELECT c.model, c.f1 AS clean_f1, e.f1 AS edited_f1 FROM (SELECT model, f1 FROM model_metrics) c
JOIN (SELECT model, """
        + O.metric_columns()
        + " FROM challenge_long GROUP BY model) e USING (model)",
        "model_metrics",
        "challenge_long",
    ),
)
def robustness_table(v: Views) -> DataFrame:
    clean = metrics.binary_metrics(metrics.by_model(v.pred(), MODELS), ["model"])
    edited = metrics.binary_metrics(metrics.by_model(_challenge(v), MODELS), ["model"])
    return _rounded(challenge.robustness_table(clean, edited), "clean_f1", "edited_f1")
