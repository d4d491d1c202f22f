"""TF-IDF over unigrams and bigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.functions.columns import run_lengths
from inkgauge.operators import term_blocks
from inkgauge.session import stored

VOCABULARY_SIZE = 10_000
_PARTS = 64


def term_doc_counts(df: DataFrame, key: str = "doc_id", terms: Column | None = None) -> DataFrame:
    """(key, term, tf), counted inside the row."""
    terms = T.terms(F.col("text")) if terms is None else terms
    return df.select(key, F.explode(run_lengths(terms, "term", "tf")).alias("_t")).select(
        key, "_t.term", "_t.tf"
    )


def term_stats(
    df: DataFrame, by: list[str] | None = None, terms: Column | None = None, words: Column | None = None
) -> DataFrame:
    """(by, term, total, df): occurrences and documents per term.

    Without `terms` they are the words and pairs of `words`, the tokens of the text if not given.
    """
    by = by or []
    if terms is None:
        return term_blocks.count_terms(df, by, T.tokens(F.col("text")) if words is None else words, pairs=True)
    return term_blocks.count_terms(df, by, terms)


def vocabulary(stats: DataFrame, k: int = VOCABULARY_SIZE) -> DataFrame:
    """The `k` terms with the highest total, ties in term order."""
    return stats.orderBy(F.desc("total"), F.asc("term")).limit(k)


def idf_weight(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def idf(stats: DataFrame, n_docs: int) -> DataFrame:
    return stats.withColumn("idf", idf_weight(F.lit(n_docs).cast("double"), F.col("df")))


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary. It has at most `k` terms, so it fits on the driver and in each task.

    Documents are turned into vectors row by row, without a shuffle.
    """

    terms: list[str]
    idf: list[float]

    def transform(
        self, df: DataFrame, output: str = "tfidf", terms: Column | None = None
    ) -> DataFrame:
        """Adds the L2-normalised tf-idf vector; unknown terms are dropped."""
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        terms = T.terms(F.col("text")) if terms is None else terms
        counted = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="_terms", outputCol="_tf", minTF=1.0
        ).transform(df.withColumn("_terms", terms))
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted"
        ).transform(counted)
        normed = Normalizer(p=2.0, inputCol="_weighted", outputCol=output).transform(weighted)
        return normed.drop("_terms", "_tf", "_weighted")

    def table(self, spark: SparkSession) -> DataFrame:
        """(term_index, term, idf)"""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term_index int, term string, idf double")

    def weights(self, df: DataFrame, key: str = "doc_id", terms: Column | None = None) -> DataFrame:
        """(key, term, weight), the non-zero entries of the vectors."""
        parts = self.transform(df, terms=terms).select(key, F.unwrap_udt("tfidf").alias("_v"))
        entries = parts.select(key, F.explode(F.arrays_zip("_v.indices", "_v.values")).alias("_e"))
        # at most `k` rows
        names = F.broadcast(self.table(df.sparkSession).select("term_index", "term"))
        return entries.join(names, F.col("_e.indices") == F.col("term_index")).select(
            key, "term", F.col("_e.values").alias("weight")
        )


def from_vocabulary(vocab: DataFrame, n_docs: int) -> TfidfModel:
    """Model from a table (term, df) of at most `k` rows; features are ordered by term."""
    rows = idf(vocab, n_docs).select("term", "idf").collect()
    rows.sort(key=lambda r: r["term"])
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])


def fit(df: DataFrame, k: int = VOCABULARY_SIZE, terms: Column | None = None) -> TfidfModel:
    return from_vocabulary(vocabulary(term_stats(df, terms=terms), k), df.count())


def assemble_features(
    df: DataFrame, model: TfidfModel, output: str = "features", scaled: bool = False
) -> DataFrame:
    """TF-IDF vector followed by perplexity and burstiness, raw unless `scaled`."""
    stats = ["perplexity", "burstiness"]
    out = model.transform(df)
    if scaled:
        stats = ["perp_scaled", "burst_scaled"]
    filled = out.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in stats})
    assembler = VectorAssembler(inputCols=["tfidf", *[f"_{c}" for c in stats]], outputCol=output)
    return assembler.transform(filled).drop(*[f"_{c}" for c in stats])


def _level(total: Column) -> Column:
    """Totals in steps of an eighth of an octave, so any corpus has a few hundred levels."""
    return F.floor(F.log2(total.cast("double")) * 8).cast("int")


def held_out_vocab(per_source: DataFrame, by: str = "source", k: int = VOCABULARY_SIZE) -> DataFrame:
    """(held_out_source, term, total, df): the top `k` terms of the corpus without each source.

    `per_source` is `term_stats(..., by=[by])`. A fold's counts are total minus own. How many terms
    of a fold have totals of which level follows from the levels of all totals, corrected by the
    terms of the source itself. Terms below the level that `k` terms reach are dropped, the others
    meet the folds by level and then their own counts by source and term.
    """
    of_term = Window.partitionBy("term")
    own = per_source.select(
        F.col(by).alias("held_out_source"),
        "term",
        F.sum("total").over(of_term).alias("all_total"),
        F.sum("df").over(of_term).alias("all_df"),
        F.col("total").alias("own_total"),
        F.col("df").alias("own_df"),
        F.col(by).eqNullSafe(F.min(by).over(of_term)).alias("_first"),
    )
    own = stored(own.withColumn("_l", _level(F.col("all_total"))), "own-terms")
    totals = own.where("_first").select("term", "all_total", "all_df", "_l")
    own = own.where(F.col("held_out_source").isNotNull())

    # one entry per level
    shared = totals.groupBy("_l").agg(F.count("*").alias("_n")).agg(F.collect_list(F.struct("_l", "_n"))).scalar()
    left = F.col("all_total") - F.col("own_total")
    moves = F.array(
        F.struct("_l", F.lit(-1).cast("long").alias("_n")),
        F.struct(F.when(left > 0, _level(left)).alias("_l"), F.lit(1).cast("long").alias("_n")),
    )
    moved = own.select("held_out_source", F.explode(moves).alias("_m")).where("_m._l IS NOT NULL")
    moved = moved.groupBy("held_out_source", "_m._l").agg(F.sum("_m._n").alias("_n"))
    every = moved.select("held_out_source").distinct().select("held_out_source", F.inline(shared))
    levels = every.unionByName(moved).groupBy("held_out_source", "_l").agg(F.sum("_n").alias("_n"))
    downward = Window.partitionBy("held_out_source").orderBy(F.desc("_l"))
    reached = levels.withColumn("_n", F.sum("_n").over(downward)).groupBy("held_out_source").agg(
        F.coalesce(F.max(F.when(F.col("_n") >= k, F.col("_l"))), F.min("_l")).alias("_from"), F.max("_l").alias("_to")
    )

    # terms below every fold's level, most of all, need not meet the folds
    lowest = reached.agg(F.min("_from")).scalar()
    frequent = own.where(F.col("_l") >= lowest).select("held_out_source", "term", "own_total", "own_df")

    # a level may hold most terms, so its terms are dealt over parts
    part = F.pmod(F.xxhash64("term"), F.lit(_PARTS)).cast("int")
    wanted = reached.select("held_out_source", F.explode(F.sequence("_from", "_to")).alias("_l")).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    )
    spread = (
        totals.withColumn("_s", part)
        .join(wanted, ["_l", "_s"])
        .join(frequent, ["held_out_source", "term"], "left")
        .select(
            "held_out_source",
            "term",
            (F.col("all_total") - F.coalesce("own_total", F.lit(0))).alias("total"),
            (F.col("all_df") - F.coalesce("own_df", F.lit(0))).alias("df"),
            "_s",
        )
        .where(F.col("total") > 0)
    )
    # first the best `k` of each part of a fold, so that no task sorts a whole fold
    return _top(_top(spread, ["held_out_source", "_s"], k).drop("_s"), ["held_out_source"], k)


def _top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("total"), F.asc("term"))
    return df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
