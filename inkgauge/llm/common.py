"""Helpers shared by the operators."""

from __future__ import annotations

import os
import shutil
import string
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkgauge.session import work_path

__all__ = ["ascii_lower", "map_arrow", "matching", "read", "ship", "spent", "stored", "take", "text_key", "texts_of"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
        root = os.path.dirname(package)
        sc.addPyFile(shutil.make_archive(base, "zip", root, os.path.basename(package)))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write `df` below the shared folder and read it back; the job's shuffle files go when it ends.

    Later jobs start from files that survive the loss of an executor. `batch_bytes` bounds the batches
    that Python workers get meanwhile.
    """
    spark = df.sparkSession
    path, conf = work_path(spark, name), {SHUFFLE_CLEANUP: "true"}
    if batch_bytes:
        conf[BATCH_BYTES] = str(batch_bytes)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only.

    Columns are found by their exact name, so a further column whose name differs in case only,
    or equals an internal name, does no harm. Of equal names the first counts.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(by_letter)


def text_key(text: Column) -> Column:
    """A number that tells the texts of one id apart; 0 for null."""
    return F.coalesce(F.xxhash64(text), F.lit(0)).cast("long")


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs`, all columns, with (`how` = left_semi) or without (left_anti) a row in `keys` (doc_id, text_key)."""
    names = docs.columns
    at, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_key", text_key(F.col(text)))
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_other"))
    out = plain.join(keys, F.col(at).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_other")), how)
    return out.drop("_key").toDF(*names)


def texts_of(batch: pa.RecordBatch, column: str = "text", chars: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """(row number of the first, texts) in slices of about `chars` characters, at least one text each."""
    texts, begin, size = batch.column(column), 0, 0
    lengths = pa.compute.utf8_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > begin and size + n > chars:
            yield begin, texts.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, texts.slice(begin).to_pylist()
