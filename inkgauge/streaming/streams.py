"""The scoring and the deduplication of the batch jobs on file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from inkgauge.operators.cleaning import clean_long_texts


def stream_samples(
    spark: SparkSession, path: str, schema: ST.StructType, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_score(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Run the batch scoring on each micro-batch.

    Every batch has a folder of its own that a repeated batch overwrites, so a restart after
    a failure neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedup(
    stream: DataFrame,
    event_time: str = "ts",
    delay: str = "1 hour",
    n: int = 20,
    text: str = "text",
    salts: int = 64,
    key: str = "doc_id",
) -> DataFrame:
    """Clean, drop short texts, and keep one row per text within the watermark.

    The state holds digests, not texts. A text with very many copies is first reduced to one
    row per salt, so that no single task takes all of its copies.
    """
    keyed = clean_long_texts(stream, n, text).withColumns(
        {"_d": F.md5(text), "_s": F.pmod(F.xxhash64(key), F.lit(salts))}
    )
    return (
        keyed.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["_d", "_s"])
        .dropDuplicatesWithinWatermark(["_d"])
        .drop("_d", "_s")
    )


def first_copies(
    stream: DataFrame,
    event_time: str = "ts",
    delay: str = "1 hour",
    keep: str = "1 day",
    n: int = 20,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Clean, drop short texts, and keep the first copy of a text by event time, of equal times the smallest key.

    A text is remembered for `keep` after its latest copy: copies less than `keep` apart are one
    run, and each run gives one row once the watermark, `delay` behind the latest event, has passed
    its end. Then its state goes, so the state holds the runs of the last `delay` and `keep` only,
    one row each. The result does not depend on the order in which rows arrive within `delay`, and
    over a table it gives the first copies of all runs. Of rows later than `delay`, one that came
    `keep` before the watermark is left out, a younger one can begin another run of its text. Rows
    without a time or a text are left out. Copies are merged to one row per task and run before they move.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    clean = clean_long_texts(stream, n, text).where(F.col(event_time).isNotNull())
    rest = [c for c in clean.columns if c not in (event_time, key)]
    row = F.struct(event_time, key, *rest).alias("_row")
    if stream.isStreaming:
        clean = clean.withWatermark(event_time, delay)
    runs = clean.groupBy(F.md5(text).alias("_d"), F.session_window(event_time, keep).alias("_run"))
    return runs.agg(F.min(row)).toDF("_d", "_run", "_row").select(*[f"_row.{c}" for c in clean.columns])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
