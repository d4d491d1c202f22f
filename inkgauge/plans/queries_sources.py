"""Sources, sinks, governance and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.operators import decisions, governance, metrics, splits
from inkgauge.plans import oracle_parts as O
from inkgauge.plans.registry import query
from inkgauge.plans.views import DECIMALS, Views, add_predictions, as_scored, batch_features
from inkgauge.session import work_path
from inkgauge.sources import generate, readers, sinks
from inkgauge.streaming import streams

ROUND = 6


def rounded(df: DataFrame, *names: str, digits: int = ROUND) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("read_samples", "SELECT doc_id, text, source FROM documents")
def read_samples(v: Views) -> DataFrame:
    df = readers.read_samples(v.spark, v.path("documents"), required=("text", "source"))
    return df.select("doc_id", "text", "source")


@query("resolve_columns", "SELECT conv_id, turn, text, role AS label FROM conversations")
def resolve_columns(v: Views) -> DataFrame:
    talk = v.table("conversations")
    renamed = talk.select(
        "conv_id", "turn", F.col("role").alias("account_type"), F.col("text").alias("Tweet")
    )
    return readers.resolve_columns(renamed).select("conv_id", "turn", "text", "label")


@query(
    "normalise_label",
    "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label FROM conversations",
)
def normalise_label(v: Views) -> DataFrame:
    talk = v.table("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "Bot").otherwise(F.col("role")).alias("label")
    )
    return readers.normalise_label(talk)


@query("tag_source", O.with_views("SELECT doc_id, text, label, 'documents' AS source FROM base", "base"))
def tag_source(v: Views) -> DataFrame:
    return readers.tag_source(v.base(), "documents", ("doc_id",))


@query(
    "load_or_fallback",
    O.with_views("SELECT doc_id, text, label, 'news_synthetic' AS source FROM filled", "filled"),
)
def load_or_fallback(v: Views) -> DataFrame:
    seeds = v.table("documents").select("doc_id")
    return readers.load_or_fallback(
        v.spark, v.path("news"), "news", lambda: generate.fill_templates(seeds), keep=("doc_id",)
    )


@query("generate_templates", O.with_views("SELECT doc_id, text, label, source FROM made", "made"))
def generate_templates(v: Views) -> DataFrame:
    made = generate.generate_templates(v.table("documents").select("doc_id"))
    return made.select("doc_id", "text", "label", "source")


@query(
    "union_sources",
    O.with_views("SELECT doc_id, turn, text, label, source, source_rank FROM united", "united"),
)
def union_sources(v: Views) -> DataFrame:
    return readers.union_sources(v.sources())


# sinks: written, read back and compared with what was to be written


@query(
    "write_splits",
    O.with_views("SELECT split, label, count(*) AS n FROM split GROUP BY ALL", "split"),
)
def write_splits(v: Views) -> DataFrame:
    path = work_path(v.spark, "splits")
    sinks.write_splits(splits.stratified_split(v.clean()), path)
    return v.spark.read.parquet(path).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "write_table",
    O.with_views(f"SELECT * FROM ({O.metrics('scored', 'source')})", "scored"),
)
def write_table(v: Views) -> DataFrame:
    table = rounded(
        metrics.metrics_by_source(as_scored(v.pred()), decimals=DECIMALS), *metrics.METRICS
    )
    path = work_path(v.spark, "source-metrics")
    sinks.write_table(table, path, "csv")
    return readers.read_samples(v.spark, path, "csv", table.schema, required=("source", "f1"))


@query(
    "write_summary_json",
    O.with_views(
        """SELECT count(*) AS total_samples, round(sum((contains(source, 'synthetic'))::INT)::DOUBLE / count(*), 6) AS synthetic_fraction,
  (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM dataset GROUP BY source)) AS source_counts,
  (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM dataset GROUP BY label)) AS label_counts,
  coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM dataset WHERE contains(source, 'synthetic')), '') AS synthetic_sources,
  coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM dataset WHERE NOT contains(source, 'synthetic')), '') AS real_sources
FROM dataset""",
        "dataset",
    ),
)
def write_summary_json(v: Views) -> DataFrame:
    """The record that was written, maps and lists as text."""
    path = work_path(v.spark, "summary")
    metadata = governance.dataset_metadata(v.dataset_clean())
    sinks.write_summary_json(metadata, path)
    back = v.spark.read.schema(metadata.schema).json(path)

    def pairs(name: str) -> Column:
        entries = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(name)

    return rounded(back, "synthetic_fraction").select(
        "total_samples",
        "synthetic_fraction",
        *[pairs(name) for name in ("source_counts", "label_counts")],
        *[F.array_join(name, ",").alias(name) for name in ("synthetic_sources", "real_sources")],
    )


@query(
    "save_language_model",
    O.with_views("SELECT prev, term, sum(n)::BIGINT AS n FROM ppl_bi GROUP BY ALL", "ppl_bi"),
)
def save_language_model(v: Views) -> DataFrame:
    """The pair counts of the language model after it was saved and loaded again."""
    return v.language_model().bigrams.select("prev", "term", F.col("bi").alias("n"))


# governance


@query("source_counts", O.with_views("SELECT source, count(*) AS n FROM dataset GROUP BY source", "dataset"))
def source_counts(v: Views) -> DataFrame:
    return governance.source_counts(v.dataset_clean())


@query("label_counts", O.with_views("SELECT label, count(*) AS n FROM dataset GROUP BY label", "dataset"))
def label_counts(v: Views) -> DataFrame:
    return governance.label_counts(v.dataset_clean())


@query(
    "synthetic_sources",
    O.with_views(
        "SELECT source, CASE WHEN contains(source, 'synthetic') THEN 'synthetic' ELSE 'real' END AS kind, count(*) AS n FROM dataset GROUP BY ALL",
        "dataset",
    ),
)
def synthetic_sources(v: Views) -> DataFrame:
    return governance.source_kinds(v.dataset_clean())


@query(
    "synthetic_fraction",
    O.with_views(
        "SELECT count(*) AS total_samples, round(coalesce(sum((contains(source, 'synthetic'))::INT), 0)::DOUBLE / greatest(count(*), 1), 6) AS synthetic_fraction FROM dataset",
        "dataset",
    ),
)
def synthetic_fraction(v: Views) -> DataFrame:
    return rounded(governance.synthetic_fraction(v.dataset_clean()), "synthetic_fraction")


def _entries(counts: str) -> Column:
    items = F.transform(
        F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return F.array_join(F.sort_array(items), ",")


@query(
    "dataset_metadata",
    O.with_views(
        """SELECT (SELECT count(*) FROM dataset) AS total_samples,
  (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT source || '=' || count(*) AS e FROM dataset GROUP BY source)) AS source_counts,
  (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT label || '=' || count(*) AS e FROM dataset GROUP BY label)) AS label_counts,
  (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM dataset WHERE contains(source, 'synthetic')) AS synthetic_sources,
  (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM dataset WHERE NOT contains(source, 'synthetic')) AS real_sources,
  (SELECT round(sum((contains(source, 'synthetic'))::INT)::DOUBLE / count(*), 6) FROM dataset) AS synthetic_fraction""",
        "dataset",
    ),
)
def dataset_metadata(v: Views) -> DataFrame:
    return governance.dataset_metadata(v.dataset_clean()).select(
        "total_samples",
        _entries("source_counts").alias("source_counts"),
        _entries("label_counts").alias("label_counts"),
        F.array_join("synthetic_sources", ",").alias("synthetic_sources"),
        F.array_join("real_sources", ",").alias("real_sources"),
        F.round("synthetic_fraction", ROUND).alias("synthetic_fraction"),
    )


@query(
    "composition_gate",
    O.with_views(
        "SELECT round(x, 6) AS synthetic_fraction, CASE WHEN x > 0 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT sum((contains(source, 'synthetic'))::INT)::DOUBLE / count(*) AS x FROM dataset)",
        "dataset",
    ),
)
def composition_gate(v: Views) -> DataFrame:
    return rounded(governance.composition_gate(v.dataset_clean()), "synthetic_fraction")


# streams


def _score(batch: DataFrame, model_path: str) -> DataFrame:
    """Batch scoring under the saved language model, so that a row depends on no other row."""
    model = sinks.load_ngram(batch.sparkSession, model_path)
    scored = add_predictions(batch_features(batch, model)).withColumn("prob", F.col("prob_a"))
    return decisions.score_batch(scored, display=True)


@query(
    "stream_score",
    O.with_views(
        f"""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text,
  format('{{:.2f}}', prob * 100) || '%' AS probability,
  CASE WHEN prob >= 0.5 THEN 'AI-Generated' ELSE 'Human-Written' END AS label,
  CASE {O.GRAY_ZONE} WHEN 'edited_ai' THEN 'Possible Human-Edited AI' WHEN 'strong_ai' THEN 'Strong AI Signal' WHEN 'likely_human' THEN 'Likely Human-Written' ELSE 'Uncertain / Mixed Signal' END AS interpretation,
  format('{{:.1f}}', {O.CONFIDENCE}) || '%' AS confidence, format('{{:.1f}}', perplexity) AS perplexity, format('{{:.2f}}', burstiness) AS burstiness
FROM raw_scored""",
        "raw_scored",
    ),
)
def stream_score(v: Views) -> DataFrame:
    documents = v.table("documents")
    # a pattern, so that a single file is accepted as well as a folder
    stream = streams.stream_samples(v.spark, v.path("document[s]"), documents.schema)
    out = work_path(v.spark, "stream-score")
    model = v.language_model_path()
    streams.stream_score(stream, lambda b: _score(b, model), f"{out}/rows", f"{out}/state").awaitTermination()
    return v.spark.read.parquet(f"{out}/rows").drop("batch")


@query(
    "stream_dedup",
    f"SELECT DISTINCT md5(t) AS digest FROM (SELECT {O.clean('text')} AS t FROM documents JOIN events ON event_id = doc_id) WHERE length(t) > 20",
)
def stream_dedup(v: Views) -> DataFrame:
    documents = v.table("documents")
    times = v.table("events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    stream = streams.stream_samples(v.spark, v.path("document[s]"), documents.schema)
    timed = stream.join(times, "doc_id")
    once = streams.stream_dedup(timed, "ts", "400 days").select(F.md5("text").alias("digest"))
    out = work_path(v.spark, "stream-dedup")
    streams.run_to_parquet(once, f"{out}/rows", f"{out}/state").awaitTermination()
    return v.spark.read.parquet(f"{out}/rows")


@query(
    "stream_first_copies",
    f"""WITH rows_ AS (
  SELECT doc_id, ts, t FROM (SELECT doc_id, ts, {O.clean('text')} AS t FROM documents JOIN events ON event_id = doc_id)
  WHERE length(t) > 20 AND ts IS NOT NULL
), starts AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER same + INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM rows_
  WINDOW same AS (PARTITION BY t ORDER BY ts, doc_id)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY t ORDER BY ts, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM starts
), ended AS (
  SELECT t, run, arg_min(doc_id, (ts, doc_id)) AS doc_id, max(ts) + INTERVAL 1 DAY AS ends FROM runs GROUP BY t, run
)
SELECT doc_id, md5(t) AS digest FROM ended
WHERE ends <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM rows_)""",
)
def stream_first_copies(v: Views) -> DataFrame:
    """First copies of the runs of a text that have ended an hour before the latest event."""
    documents = v.table("documents")
    times = v.table("events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    stream = streams.stream_samples(v.spark, v.path("document[s]"), documents.schema).join(times, "doc_id")
    first = streams.first_copies(stream, "ts", "1 hour", "1 day").select("doc_id", F.md5("text").alias("digest"))
    out = work_path(v.spark, "stream-first-copies")
    streams.run_to_parquet(first, f"{out}/rows", f"{out}/state").awaitTermination()
    return v.spark.read.parquet(f"{out}/rows")
