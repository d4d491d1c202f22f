"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A column that is used inside a lambda is evaluated again for every element; binding it
    to a lambda variable first keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(items: Column, item: str = "item", count: str = "n") -> Column:
    """Distinct elements of an array with their counts, as an array of structs.

    Counts inside the row, so no shuffle by document is needed afterwards.
    """

    def count_runs(s: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: F.struct(
                F.element_at(s, at).alias(item),
                (F.coalesce(F.get(starts, i + 1), F.size(s) + 1) - at).cast("long").alias(count),
            ),
        )

    def over_sorted(s: Column) -> Column:
        positions = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            positions, lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2))
        )
        return let(starts, lambda st: count_runs(s, st))

    return let(F.sort_array(items), over_sorted)


def portable_hash(seed: int | str, slot: str, key: Column) -> Column:
    """32-bit hash that any engine with md5 can reproduce; uniform over its range."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(slot), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pick(options: list[str], seed: int | str, slot: str, key: Column) -> Column:
    """One of `options`, chosen by the portable hash of `key`."""
    choice = F.pmod(portable_hash(seed, slot, key), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), choice + 1)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
