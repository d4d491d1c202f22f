"""Reading labelled text tables and bringing them to (text, label, source)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# fixed values
TEXT_NAMES = {"tweet", "content", "text"}
LABEL_PARTS = ("label", "account")
POSITIVE_LABELS = ["bot", "1", "ai", "machine"]


MISSING_INPUT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class MissingColumns(ValueError):
    """The input has no column for something that is required."""


def read_samples(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: ST.StructType | str | None = None,
    required: tuple[str, ...] = ("text",),
    multi_line: bool = True,
) -> DataFrame:
    """Read a table and reject it when a required column is missing.

    CSV has a header and doubles quotes to escape them. A file that may have line breaks inside
    quotes can't be split over tasks; without such breaks, `multi_line=False` reads it in parallel.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"')
    df = reader.format(fmt).load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{path} lacks {', '.join(missing)}")
    return df


def resolve_columns(df: DataFrame, text: str | None = None, label: str | None = None) -> DataFrame:
    """Rename the text-like and the label-like column to `text` and `label`.

    An explicit name wins, then the exact name, then the first match in column order.
    """

    def find(wanted: str, explicit: str | None, matches: Callable[[str], bool]) -> str:
        if explicit:
            return explicit
        if wanted in df.columns:
            return wanted
        found = [c for c in df.columns if matches(c.lower())]
        if not found:
            raise MissingColumns(f"no {wanted} column among {', '.join(df.columns)}")
        return found[0]

    text_col = find("text", text, lambda c: c in TEXT_NAMES)
    label_col = find("label", label, lambda c: any(part in c for part in LABEL_PARTS))
    return df.withColumnsRenamed({text_col: "text", label_col: "label"})


def normalise_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Text labels become 1 for the positive names and 0 for all others, null included."""
    if not isinstance(df.schema[label].dataType, ST.StringType):
        return df
    positive = F.lower(F.col(label)).isin(POSITIVE_LABELS)
    return df.withColumn(label, F.when(positive, 1).otherwise(0))


def tag_source(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to (text, label, source) with a constant source."""
    return df.select(*keep, "text", "label", F.lit(name).alias("source"))


def standardise(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return tag_source(normalise_label(resolve_columns(df)), name, keep)


def load_or_fallback(
    spark: SparkSession,
    path: str,
    name: str,
    fallback: Callable[[], DataFrame],
    fmt: str = "parquet",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The table at `path`, or generated rows under the source name `<name>_synthetic`.

    The input is probed at once, because a lazy read would fail only later. Only a missing path,
    a folder without data, or a table without a text or label column leads to the fallback;
    other errors, such as a missing column of `keep`, are real.
    """
    try:
        df = standardise(read_samples(spark, path, fmt, required=()), name, keep)
        df.limit(1).collect()
        return df
    except MissingColumns:
        return tag_source(fallback(), f"{name}_synthetic", keep)
    except AnalysisException as error:
        if error.getCondition() not in MISSING_INPUT:
            raise
        return tag_source(fallback(), f"{name}_synthetic", keep)


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """All rows with `source_rank`, the position of their table in the list."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(dfs)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df)
    return out


