"""Exact evaluation metrics over a prediction table (label, pred, prob, ...).

The first step of every metric is a partial aggregation, so the rows of one big source or of
one very common score are reduced before they are shuffled.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.columns import ratio

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
_BUCKETS = 1024


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def confusion_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows without a class, or with a probability column but no probability, are not counted."""
    y, pred = F.col("label"), F.col("pred")
    if "prob" in df.columns:
        pred = F.when(F.col("prob").isNotNull(), pred)
    return df.groupBy(*(by or [])).agg(
        _count((y == 0) & (pred == 0)).alias("tn"),
        _count((y == 0) & (pred == 1)).alias("fp"),
        _count((y == 1) & (pred == 0)).alias("fn"),
        _count((y == 1) & (pred == 1)).alias("tp"),
    )


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a zero denominator gives 0."""
    by = by or []
    c = {name: F.col(name) for name in ("tp", "fp", "fn", "tn")}
    rates = [value.alias(name) for name, value in _rates(**c).items()]
    samples = (c["tp"] + c["fp"] + c["fn"] + c["tn"]).alias("samples")
    return confusion_counts(df, by).select(*by, samples, *rates)


def _score_table(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, prob, pos, neg): one row per distinct score."""
    return (
        df.where(F.col("prob").isNotNull() & F.col("label").isNotNull())
        .groupBy(*by, "prob")
        .agg(_count(F.col("label") == 1).alias("pos"), _count(F.col("label") == 0).alias("neg"))
    )


def _bucketed(scores: DataFrame, decimals: int | None) -> DataFrame:
    """Adds `bucket`, monotone in the score.

    Scores rounded to at most six decimals have at most a million distinct values, which
    equal-width buckets divide well enough. Otherwise the bucket limits are quantiles of the
    distinct scores, so that a narrow range with most of the scores is divided as well.
    """
    if decimals is not None and decimals <= 6:
        return scores.withColumn("bucket", F.floor(F.col("prob") * _BUCKETS))
    cuts = scores.stat.approxQuantile("prob", [i / _BUCKETS for i in range(1, _BUCKETS)], 0.25 / _BUCKETS)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol="prob", outputCol="bucket").transform(scores)


def roc_auc(df: DataFrame, by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when a class is missing.

    A positive beats the negatives with a smaller score. Within a bucket these are counted by
    a running sum, and the negatives of all earlier buckets are added per bucket, so no
    window sees more than one bucket of distinct scores or the short table of buckets.
    `decimals` says to how many decimals the scores were rounded, if they were.
    """
    by = by or []
    scores = _bucketed(_score_table(df, by), decimals)
    in_bucket = Window.partitionBy(*by, "bucket").orderBy("prob")
    below = F.coalesce(F.sum("neg").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = F.col("pos").cast("double") * (F.col("_below") + F.col("neg") / 2.0)
    buckets = (
        scores.withColumn("_below", below)
        .groupBy(*by, "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(wins).alias("wins"))
    )
    ordered = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket")
    earlier = F.coalesce(F.sum("neg").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_wins = F.sum(F.col("pos").cast("double") * F.col("_earlier") + F.col("wins"))
    return (
        buckets.withColumn("_earlier", earlier)
        .groupBy(*by)
        .agg(F.try_divide(all_wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))
    )


def metrics(df: DataFrame, by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """`binary_metrics` and `roc_auc` per group."""
    auc = roc_auc(df, by, decimals)
    if by:
        keys = [f"_{c}" for c in by]
        auc = auc.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "roc_auc")
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
        return binary_metrics(df, by).join(auc, same, "left").drop(*keys)
    return binary_metrics(df).withColumn("roc_auc", auc.scalar())


def metrics_by_source(df: DataFrame, by: str = "source", decimals: int | None = None) -> DataFrame:
    return metrics(df.where(F.col(by).isNotNull()), [by], decimals)


def roc_points(df: DataFrame, decimals: int | None = None, drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, starting at (0, 0) above the highest score.

    `drop_intermediate` leaves out points on a straight line between their neighbours.
    """
    scores = _bucketed(_score_table(df, []), decimals)
    in_bucket = Window.partitionBy("bucket").orderBy(F.desc("prob"))
    here = Window.partitionBy("bucket")
    running = in_bucket.rowsBetween(Window.unboundedPreceding, 0)
    buckets = scores.groupBy("bucket").agg(
        F.sum("pos").alias("_bp"),
        F.sum("neg").alias("_bn"),
        F.max_by(F.struct("pos", "neg"), "prob").alias("_first"),
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        "bucket",
        F.coalesce(F.sum("_bp").over(earlier), F.lit(0)).alias("_tp0"),
        F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_fp0"),
        F.sum("_bp").over(Window.partitionBy(F.lit(0))).alias("_p"),
        F.sum("_bn").over(Window.partitionBy(F.lit(0))).alias("_n"),
        F.lead("_first").over(ordered).alias("_next_first"),
        (F.row_number().over(ordered) == 1).alias("_top"),
    )
    # at most one row per bucket
    points = (
        scores.withColumn("_tp", F.sum("pos").over(running))
        .withColumn("_fp", F.sum("neg").over(running))
        .withColumn("_next", F.lead(F.struct("pos", "neg")).over(in_bucket))
        .withColumn("_is_first", F.row_number().over(in_bucket) == 1)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("_next", F.coalesce("_next", "_next_first"))
    )
    if drop_intermediate:
        bends = F.col("_next").isNull() | (F.col("_next") != F.struct("pos", "neg"))
        points = points.where(bends)
    curve = points.select(
        F.col("prob").alias("threshold"),
        F.try_divide((F.col("_fp0") + F.col("_fp")).cast("double"), F.col("_n").cast("double")).alias("fpr"),
        F.try_divide((F.col("_tp0") + F.col("_tp")).cast("double"), F.col("_p").cast("double")).alias("tpr"),
        (F.col("_is_first") & F.col("_top")).alias("_highest"),
    )
    # the start is a second row next to the highest score
    if drop_intermediate:
        start = offsets.where("_top").select(
            F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
        )
        return curve.drop("_highest").unionByName(start)
    row = F.struct("threshold", "fpr", "tpr")
    zero = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    rows = F.when(F.col("_highest"), F.array(zero, row)).otherwise(F.array(row))
    return curve.select(F.explode(rows).alias("_r")).select("_r.*")


def classification_report(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) for both classes, their averages and the accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    one = _rates(tp, fp, fn, tn)
    zero = _rates(tn, fn, fp, tp)
    n1, n0 = tp + fn, tn + fp

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def averaged(combine) -> list[Column]:
        return [combine(zero[m], one[m]) for m in ("precision", "recall", "f1")]

    rows = F.array(
        row("human", zero["precision"], zero["recall"], zero["f1"], n0),
        row("ai", one["precision"], one["recall"], one["f1"], n1),
        row("macro avg", *averaged(lambda a, b: (a + b) / 2), n0 + n1),
        row("weighted avg", *averaged(lambda a, b: ratio(a * n0 + b * n1, n0 + n1)), n0 + n1),
        row("accuracy", *[one["accuracy"]] * 3, n0 + n1),
    )
    return confusion_counts(df).select(F.explode(rows).alias("_r")).select("_r.*")


def probability_histogram(df: DataFrame, bins: int = 40, shared: bool = False) -> DataFrame:
    """(label, bin, lower, upper, n) with equal bins over each class's own range.

    The last bin is closed, a class with a single value gets a range of width one around it,
    and a value is moved to the neighbouring bin when rounding put it beyond an edge.
    `shared` uses the range 0 to 1 for both classes.
    """
    rows = df.where(F.col("prob").isNotNull() & F.col("label").isin(0, 1))
    if shared:
        lo, hi = F.lit(0.0), F.lit(1.0)
    else:
        lo, hi = F.min("prob"), F.max("prob")
    ranges = rows.groupBy("label").agg(lo.alias("lo"), hi.alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ranges = ranges.select("label", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("hi")).otherwise(
            F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins)
        )

    guess = F.least(
        F.floor((F.col("prob") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    ).cast("int")
    # two rows, one per class
    counted = (
        rows.select("label", "prob")
        .join(F.broadcast(ranges), "label")
        .withColumn("_g", guess)
        .withColumn(
            "bin",
            F.when(F.col("prob") < edge(F.col("_g")), F.col("_g") - 1)
            .when((F.col("prob") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
            .otherwise(F.col("_g")),
        )
        .groupBy("label", "bin")
        .agg(F.count("*").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["label", "bin"], "left").select(
        "label",
        "bin",
        edge(F.col("bin")).alias("lower"),
        edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def burstiness_vs_probability(df: DataFrame, x_width: float = 1.0, y_bins: int = 20) -> DataFrame:
    """Counts per (burstiness bin, probability bin, label), the data of the scatter plot."""
    return (
        df.where(F.col("prob").isNotNull())
        .select(
            "label",
            F.floor(F.col("burstiness") / x_width).alias("bin_x"),
            F.least(F.floor(F.col("prob") * y_bins), F.lit(y_bins - 1)).alias("bin_y"),
        )
        .groupBy("bin_x", "bin_y", "label")
        .agg(F.count("*").alias("n"))
    )


def by_model(df: DataFrame, models: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """One row per (row, model) with `pred` and `prob`; `models` maps a name to its two columns."""
    entries = [
        F.struct(F.lit(name).alias("model"), F.col(pred).alias("pred"), F.col(prob).alias("prob"))
        for name, (pred, prob) in models.items()
    ]
    return df.select("label", *(keep or []), F.explode(F.array(*entries)).alias("_m")).select(
        "label", *(keep or []), "_m.*"
    )


def model_comparison(
    df: DataFrame, models: dict[str, tuple[str, str]], decimals: int | None = None
) -> DataFrame:
    """One row per metric, one column per model."""
    return compare(metrics(by_model(df, models), ["model"], decimals), list(models))


def compare(per_model: DataFrame, names: list[str]) -> DataFrame:
    """One row per metric, one column per name, from a table with one row per model; null for a missing model."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = per_model.select("model", F.explode(cells).alias("_c")).select("model", "_c.*")
    return long.groupBy("metric").pivot("model", names).agg(F.first("value"))


def comparison_verdict(comparison: DataFrame, baseline: str, hybrid: str) -> DataFrame:
    b, h = F.col(baseline), F.col(hybrid)
    verdict = (
        F.when(b.isNull() | h.isNull(), "not_available")
        .when(h > b, "hybrid_better")
        .when(h < b, "baseline_better")
        .otherwise("tie")
    )
    f1 = comparison.agg(
        *[F.max(F.when(F.col("metric") == "f1", F.col(c))).alias(c) for c in (baseline, hybrid)]
    )
    return f1.select(verdict.alias("verdict"), b.alias("baseline_f1"), h.alias("hybrid_f1"))


def errors(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred") != F.col("label"))


def top_errors(df: DataFrame, n: int = 50, key: str = "doc_id") -> DataFrame:
    """The `n` misclassified rows with the highest probability, ties by key."""
    return errors(df).orderBy(F.desc("prob"), F.asc(key)).limit(n)


def error_summary(df: DataFrame) -> DataFrame:
    y, pred = F.col("label"), F.col("pred")
    return df.agg(
        F.count("*").alias("total"),
        _count(pred != y).alias("errors"),
        _count((y == 0) & (pred == 1)).alias("false_positives"),
        _count((y == 1) & (pred == 0)).alias("false_negatives"),
    )


def unscored_rows(df: DataFrame) -> DataFrame:
    """Rows that no metric can use because they have no probability."""
    return df.agg(F.count("*").alias("total"), _count(F.col("prob").isNull()).alias("unscored"))


def select_best_epoch(history: DataFrame) -> DataFrame:
    """Per run the earliest epoch with the highest `val_f1`; none if it never exceeds 0."""
    best = F.max(F.struct("val_f1", (-F.col("epoch")).alias("_e")))
    return (
        history.where(F.col("val_f1") > 0)
        .groupBy("run")
        .agg(best.alias("_b"))
        .select("run", (-F.col("_b._e")).alias("best_epoch"), F.col("_b.val_f1").alias("best_f1"))
    )
