"""Exact histogram of encoded lengths and what suffix sums over it answer.

Documents are counted by their number of tokens; every later question (totals, quantiles, totals
after truncation to a context limit) reads the histogram only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, stored, take, texts_of
from inkgauge.llm.encoding import default_path, encoder

BUCKET_BITS = 10


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, documents): how many documents have `length` tokens.

    Null and empty texts have length 0, repeated rows count each, an empty table gives no rows.
    Only `text` is read of `docs`.
    """
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            seen = Counter(len(encode(t or "")) // 4 for _, texts in texts_of(batch) for t in texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n"]
            )

    counted = map_arrow(take(docs, "text"), count, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("documents"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, read as a context limit.

    length, documents, documents_at_least, tokens_at_least (of documents of this length or more),
    tokens_truncated (tokens left if every document is cut to `length`), documents_at_most, and
    share_at_most (share of documents that fit: the quantile of this length). Between two listed
    lengths tokens_truncated is linear, see `truncated_total`.

    The suffix sums run inside ranges of lengths and over the short table of the ranges, so no
    task holds the whole histogram.
    """
    rows = stored(histogram, "histogram").withColumn("_b", F.shiftright("length", BUCKET_BITS))
    tokens = F.col("length") * F.col("documents")
    ranges = rows.groupBy("_b").agg(F.sum("documents").alias("_d"), F.sum(tokens).alias("_t"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "_b",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d_after"),
        F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t_after"),
        F.sum("_d").over(total).alias("_d_all"),
        F.sum("_t").over(total).alias("_t_all"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("length"))
    sums = rows.join(ranges, "_b").select(
        "length",
        "documents",
        (F.sum("documents").over(inside) + F.col("_d_after")).alias("documents_at_least"),
        (F.sum(tokens).over(inside) + F.col("_t_after")).alias("tokens_at_least"),
        "_d_all",
        "_t_all",
    )
    at_most = F.col("_d_all") - F.col("documents_at_least") + F.col("documents")
    cut = F.col("_t_all") - F.col("tokens_at_least") + F.col("length") * F.col("documents_at_least")
    return sums.select(
        "length",
        "documents",
        "documents_at_least",
        "tokens_at_least",
        cut.alias("tokens_truncated"),
        at_most.alias("documents_at_most"),
        (at_most / F.col("_d_all")).alias("share_at_most"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens that are left if every document is cut to `limit`: exact for any limit."""
    row = F.struct("length", "documents_at_least", "tokens_truncated")
    above = table.where(F.col("length") >= limit).agg(F.min_by(row, "length").alias("r")).first()["r"]
    if above is None:
        last = table.agg(F.max("tokens_truncated")).first()[0]
        return int(last or 0)
    return int(above["tokens_truncated"] - (above["length"] - limit) * above["documents_at_least"])


def quantile(table: DataFrame, share: float) -> int | None:
    """The smallest length that at least `share` of the documents do not exceed; None without documents."""
    return table.where(F.col("share_at_most") >= share).agg(F.min("length")).first()[0]
