"""Join that stays balanced when single keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAGMENTS = 4096


def heavy_keys(
    weights: DataFrame, keys: list[str], weight: str, total: int, fragments: int = FRAGMENTS
) -> DataFrame:
    """Keys that carry at least 1/`fragments` of the total weight, with the number of salts each needs.

    At most `fragments` keys can qualify, whatever the size of the data, so the result may be
    broadcast; the salts of all of them add up to at most twice `fragments`.
    """
    share = F.col(weight).cast("double") * fragments / max(total, 1)
    return weights.where(share >= 1).select(*keys, F.ceil(share).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame,
    table: DataFrame,
    keys: list[str],
    heavy: DataFrame,
    spread: list[str | Column],
    how: str = "inner",
) -> DataFrame:
    """Join `big` to `table`, which has one row per key.

    Rows of a heavy key are spread over its salts by the hash of `spread`, and the one row of
    that key in `table` is repeated once per salt. Other keys have the single salt 0.
    """
    heavy = F.broadcast(heavy)
    left = big.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    right = table.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
