"""Deterministic splits, samples and hold-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.columns import portable_hash

SPLITS = ("train", "val", "test")
SEED = 42
_BUCKET_BITS = 16


def position_cuts(
    keyed: DataFrame, groups: list[str], targets: Column, key: str = "doc_id", hashed: str = "_h"
) -> DataFrame:
    """The (hash, key) found at given 0-based positions of each group in hash order.

    `targets` is an array of structs (name, pos) that may use `_n`, the size of the group.
    The hash is uniform, so its upper bits divide the rows evenly: counting those buckets
    tells in which one a position falls, and only that bucket (1/65536 of the rows) is
    sorted. Positions beyond the end of a group give no row.
    """
    keyed = keyed.withColumn("_b", F.shiftright(hashed, 32 - _BUCKET_BITS))
    counts = keyed.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        counts.withColumn("_n", F.sum("_c").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .withColumn("_t", F.explode(targets))
        .where((F.col("_t.pos") >= F.col("_before")) & (F.col("_t.pos") < F.col("_before") + F.col("_c")))
        .select(*groups, "_b", F.col("_t.name").alias("name"), (F.col("_t.pos") - F.col("_before")).alias("_k"))
    )
    # one row per group and target
    in_bucket = keyed.join(F.broadcast(located), [*groups, "_b"])
    nth = Window.partitionBy(*groups, "name").orderBy(hashed, key)
    return (
        in_bucket.withColumn("_r", F.row_number().over(nth))
        .where(F.col("_r") == F.col("_k") + 1)
        .select(*groups, "name", F.struct(F.col(hashed).alias("h"), F.col(key).alias("k")).alias("cut"))
    )


def _below(cut: str, key: str) -> Column:
    here = F.struct(F.col("_h").alias("h"), F.col(key).alias("k"))
    return F.col(cut).isNull() | (here < F.col(cut))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "doc_id",
    seed: int = SEED,
    train_pct: int = 70,
    val_pct: int = 15,
) -> DataFrame:
    """Adds `split`: in every label the first 70 % in hash order train, the next 15 % validate.

    Only (key, label) is read to find the two cut points of each label; the rows themselves,
    texts included, are then labelled in place without a shuffle. Only labels 0 and 1 have cut
    points, so the broadcast table has at most two rows; any other label, null included, is an error.
    """
    hashed = df.withColumn("_h", portable_hash(seed, "split", F.col(key)))

    def first_at_least(pct: int) -> Column:
        return F.ceil(F.col("_n") * pct / F.lit(100)).cast("long")

    targets = F.array(
        F.struct(F.lit("val").alias("name"), first_at_least(train_pct).alias("pos")),
        F.struct(F.lit("test").alias("name"), first_at_least(train_pct + val_pct).alias("pos")),
    )
    binary = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    cuts = position_cuts(hashed.where(binary).select(label, key, "_h"), [label], targets, key)
    per_label = cuts.groupBy(F.col(label).alias("_label")).agg(
        F.max(F.when(F.col("name") == "val", F.col("cut"))).alias("_val"),
        F.max(F.when(F.col("name") == "test", F.col("cut"))).alias("_test"),
    )
    wrong = F.concat(F.lit("label is not 0 or 1: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    split = (
        F.when(~binary, F.raise_error(wrong))
        .when(_below("_val", key), SPLITS[0]).when(_below("_test", key), SPLITS[1]).otherwise(SPLITS[2])
    )
    joined = hashed.join(F.broadcast(per_label), F.col(label) == F.col("_label"), "left")
    return joined.withColumn("split", split).drop("_h", "_label", "_val", "_test")


def split_label_counts(df: DataFrame) -> DataFrame:
    counts = df.groupBy("split").agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("human"),
        F.count(F.when(F.col("label") == 1, 1)).alias("ai"),
    )
    return counts


def sample_n(df: DataFrame, n: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """A reproducible subset of exactly `n` rows, or all rows when there are not more than `n`.

    Finds the key at position `n` of the hash order and keeps the rows before it; nothing is
    sorted as a whole and no row goes through the driver.
    """
    hashed = df.withColumn("_h", portable_hash(seed, "sample", F.col(key))).withColumn("_g", F.lit(0))
    targets = F.array(F.struct(F.lit("end").alias("name"), F.lit(n).cast("long").alias("pos")))
    cut = position_cuts(hashed.select("_g", key, "_h"), ["_g"], targets, key).select("_g", "cut")
    return hashed.join(F.broadcast(cut), "_g", "left").where(_below("cut", key)).drop("_g", "_h", "cut")


def train_pool(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("train", "val"))


def holdout_folds(df: DataFrame, by: str = "source") -> DataFrame:
    """Per source of the test split: rows to train on (pool minus that source) and rows to test.

    Sources with an empty side are left out. Sizes follow from counts per source, no row is
    repeated per fold; `holdout_rows` selects the rows of one fold.
    """
    per_source = df.groupBy(by).agg(
        F.count(F.when(F.col("split") != "test", 1)).alias("_own"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_samples"),
    )
    everything = Window.partitionBy(F.lit(0))
    return (
        per_source.withColumn("train_samples", F.sum("_own").over(everything) - F.col("_own"))
        .where(F.col(by).isNotNull() & (F.col("test_samples") > 0) & (F.col("train_samples") > 0))
        .select(F.col(by).alias("held_out_source"), "train_samples", "test_samples")
    )


def holdout_rows(df: DataFrame, source: str, by: str = "source") -> tuple[DataFrame, DataFrame]:
    """(train rows, test rows) of the fold that holds `source` out."""
    return (
        train_pool(df).where(~F.col(by).eqNullSafe(source)),
        df.where((F.col("split") == "test") & (F.col(by) == source)),
    )
