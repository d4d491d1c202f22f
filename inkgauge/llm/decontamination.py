"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 10 consecutive words of an item. Of the 6 runs of 5 words in a window the one with the
smallest hash is its fingerprint; a document keeps the fingerprints of all its windows (about two
in seven words). Any shared window has the same fingerprint on both sides, so every shared span of
10 words or more is met by the join of fingerprints. Hits are then extended to the windows around
them and compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.columns import let
from inkgauge.llm.common import ascii_lower, matching, stored, take, text_key

WINDOW = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POSITION_BITS = 30  # no string holds more words
NO_KEY = 1 << 40  # fingerprints are below
BROADCAST_DOCUMENTS = 500_000  # keys of 16 bytes, some 30 MB in a hash table


def words_of(text: Column) -> Column:
    """Words of a text, [] for null."""
    words = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _upto(last: Column) -> Column:
    """0..last, [] if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _slice(array: Column, start: Column, length: int) -> Column:
    return F.slice(array, start + 1, F.lit(length))


def fingerprints(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """array<struct<key, at, width>>: the fingerprints of all windows with their first word."""

    def packed(w: Column) -> Column:
        # hash in the upper bits and position in the lower: the smallest is the leftmost smallest
        return F.transform(
            _upto(F.size(w) - gram),
            lambda i: F.shiftleft(F.xxhash64(_slice(w, i, gram)), POSITION_BITS).bitwiseOR(i.cast("long")),
        )

    def winnowed(g: Column) -> Column:
        per_window = window - gram + 1
        least = F.transform(_upto(F.size(g) - per_window), lambda i: F.array_min(_slice(g, i, per_window)))
        mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
        return F.transform(
            F.array_distinct(least),
            lambda x: F.struct(
                F.shiftright(x, POSITION_BITS).alias("key"),
                x.bitwiseAND(mask).cast("int").alias("at"),
                F.lit(window).alias("width"),
            ),
        )

    return let(packed(words), winnowed)


def whole_runs(words: Column, width: int) -> Column:
    """array<struct<key, at, width>>: all runs of `width` words, for items shorter than a window."""
    return F.transform(
        _upto(F.size(words) - width),
        lambda i: F.struct(
            F.shiftright(F.xxhash64(F.lit(width), _slice(words, i, width)), POSITION_BITS).alias("key"),
            i.cast("int").alias("at"),
            F.lit(width).alias("width"),
        ),
    )


def _identity(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "text", text_key(F.col("text")).alias("_text"), words_of(F.col("text")).alias("_w")
    )


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, _text, n_words, hits): fingerprint hits of each document, words counted.

    Every document sends one further row with a key that no item has, so that the words of
    documents without a hit are counted in the same pass.
    """
    size = F.size("_w")
    short = [r[0] for r in items.where((size > 0) & (size < window)).select(size).distinct().collect()]  # below `window` values

    def keys(w: Column) -> Column:
        return F.concat(fingerprints(w, window, gram), *[whole_runs(w, n) for n in sorted(short)])

    item_keys = F.when(size >= window, fingerprints(F.col("_w"), window, gram))
    for n in sorted(short):
        item_keys = item_keys.when(size == n, whole_runs(F.col("_w"), n))
    of_items = stored(items.select(F.explode(item_keys).alias("k")).select("k.key").distinct(), "item-keys")
    spare = F.lit(NO_KEY).cast("long") + F.pmod(F.xxhash64("doc_id", "_text"), F.lit(NO_KEY).cast("long"))
    no_key = F.array(F.struct(spare.alias("key"), F.lit(-1).alias("at"), size.alias("width")))
    rows = _identity(docs).select("doc_id", "_text", F.explode(F.concat(no_key, keys(F.col("_w")))).alias("k"))
    rows = rows.select("doc_id", "_text", "k.key", "k.at", "k.width")
    met = rows.join(of_items.withColumn("_met", F.lit(True)), "key", "left")
    met = met.where(F.col("_met") | (F.col("at") < 0))
    return met.groupBy("doc_id", "_text").agg(
        F.max(F.when(F.col("at") < 0, F.col("width"))).alias("n_words"),
        F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "width"))).alias("hits"),
    )


def extend_hits(docs: DataFrame, items: DataFrame, hits: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, _text, at, width, items): the windows of items that really occur in documents, with all their items."""
    reach = window - gram

    def around(n: Column, hit: Column) -> Column:
        wide = F.sequence(F.greatest(hit["at"] - reach, F.lit(0)), F.least(hit["at"], n - window))
        ats = F.when(hit["width"] == window, wide).otherwise(F.array(hit["at"]))
        return F.transform(ats, lambda i: F.struct(i.alias("at"), hit["width"].alias("width")))

    some = stored(hits.where(F.size("hits") > 0).select("doc_id", "_text", "hits"), "hit-documents")
    both = _join_back(_met(docs, some), some)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: around(F.size("_w"), h))))
    run = F.transform(
        places,
        lambda p: F.struct(
            p["at"].alias("at"), p["width"].alias("width"), F.array_join(F.slice("_w", p["at"] + 1, p["width"]), " ").alias("run")
        ),
    )
    of_docs = both.select("doc_id", "_text", F.explode(run).alias("p")).select("doc_id", "_text", "p.at", "p.width", "p.run").distinct()
    size = F.size("_w")
    of_items = F.transform(
        _upto(F.greatest(size - window, F.lit(0))), lambda i: F.array_join(_slice(F.col("_w"), i, window), " ")
    )
    of_items = items.where(size > 0).select("item_id", F.explode(of_items).alias("run"))
    of_items = of_items.groupBy("run").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return of_docs.join(of_items, "run").select("doc_id", "_text", "at", "width", "items")


def _met(docs: DataFrame, some: DataFrame) -> DataFrame:
    """The documents in `some`, found where they lie: up to BROADCAST_DOCUMENTS keys go to every task.

    Beyond that number all documents stay in, and the join moves them.
    """
    if some.count() > BROADCAST_DOCUMENTS:
        return docs
    return matching(docs, F.broadcast(some.select("doc_id", F.col("_text").alias("text_key")).distinct()), "left_semi")


def _join_back(docs: DataFrame, some: DataFrame) -> DataFrame:
    right = some.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "hits")
    return _identity(docs).join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")))


def covered(places: Column) -> Column:
    """Words covered by sorted struct(at, width)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, p: Column) -> Column:
        end = p["at"] + p["width"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["at"]))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(places, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted array of item ids as strings) per document.

    Rows that repeat both id and text are one document. A null or empty text has no words, a null
    id is an id of its own, items without an id are left out. An empty benchmark hits nothing.
    Only `doc_id`, `text` and `item_id`, `text` are read.
    """
    docs = take(docs, "doc_id", "text")
    items = take(benchmark, "item_id", "text").where("item_id IS NOT NULL")
    items = items.select("item_id", words_of(F.col("text")).alias("_w"))
    hits = stored(find_hits(docs, items, window, gram), "hits")
    found = extend_hits(docs, items, hits, window, gram)
    found = found.groupBy("doc_id", "_text").agg(
        covered(F.sort_array(F.collect_set(F.struct("at", "width")))).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    right = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "n_hit", "items")
    joined = hits.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left")
    return joined.select(
        "doc_id",
        F.col("_text").alias("text_key"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of a benchmark item."""
    hit = decontaminate(docs, benchmark).where("n_hit > 0").select("doc_id", "text_key")
    return matching(docs, stored(hit, "contaminated"), "left_anti")
