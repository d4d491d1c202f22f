"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import (
    chats,
    decontamination,
    hard_negatives,
    katz,
    lengths,
    lexical,
    licenses,
    neardup,
    neighbours,
    packing,
    secret_scan,
    suffixes,
    toxicity,
)
from inkgauge.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.drop_repeats(read(spark, sf_dir, "documents"), keep_text=False)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as digests with lengths, spans as text."""
    made = chats.format_preferences(chats.swapped_replies(read(spark, sf_dir, "conversations")))

    def spans(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)

    texts = [F.sha2(n, 256).alias(f"{n}_sha256") for n in ("prompt", "chosen", "rejected")]
    lengths_ = [F.char_length(n).cast("long").alias(f"{n}_chars") for n in ("prompt", "chosen", "rejected")]
    conv, n = F.col("pair_id").alias("conv_id"), F.col("n_common").cast("long").alias("n_common")
    return made.select(conv, n, *lengths_, *texts, spans("chosen_spans"), spans("rejected_spans"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    first = F.transform("base", lambda b: b["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limit_table(lengths.length_histogram(read(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (
        op1_decontamination,
        op2_suffix_dedup,
        op3_toxicity,
        op4_secrets,
        op5_neighbours,
        op6_token_counts,
        op7_near_duplicates,
        op8_preferences,
        op9_licenses,
        op10_packing,
        op11_lexical_search,
        op12_hard_negatives,
        op13_lm_scores,
    )
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS width FROM items WHERE len(w) > 0
), of_items AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i + 1 : i + width], ' ') AS run
  FROM (SELECT item_id, w, width, unnest(range(len(w) - width + 1)) AS i FROM sized)
), widths AS (SELECT DISTINCT width FROM of_items
), of_docs AS (
  SELECT doc_id, i, width, array_to_string(w[i + 1 : i + width], ' ') AS run
  FROM (SELECT doc_id, w, width, unnest(range(len(w) - width + 1)) AS i FROM words, widths WHERE len(w) >= width)
), met AS (
  SELECT doc_id, i, d.width, item_id FROM of_docs d JOIN of_items b ON d.run = b.run AND d.width = b.width
), hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS p FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8_SQL = r"""
WITH talks AS (
  SELECT conv_id, list({'role': regexp_replace(coalesce(role, ''), '\|(\\*)>', '|\\\1>', 'g'),
    'text': regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g')} ORDER BY turn, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), replies AS (
  SELECT conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS at FROM talks
), pairs AS (
  SELECT a.conv_id, a.t AS c,
    CASE WHEN a.at IS NOT NULL AND b.at IS NOT NULL THEN a.t[1 : a.at - 1] || [b.t[b.at]] ELSE a.t END AS r
  FROM replies a LEFT JOIN replies b ON b.conv_id = xor(a.conv_id, 1)
), common AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1,
    least(len(c), len(r))) AS n FROM pairs
), parts AS (
  SELECT conv_id, n, c[1 : n] AS p, c[n + 1 :] AS c, r[n + 1 :] AS r FROM common
), made AS (
  SELECT conv_id, n,
    list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS p,
    list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS c,
    list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS r,
    c AS ct, r AS rt FROM parts
), joined AS (
  SELECT conv_id, n, coalesce(array_to_string(p, ''), '') AS p, coalesce(array_to_string(c, ''), '') AS cs,
    coalesce(array_to_string(r, ''), '') AS rs, c, r, ct, rt FROM made
)
SELECT conv_id, CAST(n AS BIGINT) AS n_common,
  CAST(length(p) AS BIGINT) AS prompt_chars, CAST(length(cs) AS BIGINT) AS chosen_chars,
  CAST(length(rs) AS BIGINT) AS rejected_chars,
  sha256(p) AS prompt_sha256, sha256(cs) AS chosen_sha256, sha256(rs) AS rejected_sha256,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ct) + 1), lambda i: ct[i].role = 'assistant'),
    lambda i: (length(array_to_string(c[1 : i], '')) - length(ct[i].text) - 8) || ':' ||
      length(array_to_string(c[1 : i], ''))), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rt) + 1), lambda i: rt[i].role = 'assistant'),
    lambda i: (length(array_to_string(r[1 : i], '')) - length(rt[i].text) - 8) || ':' ||
      length(array_to_string(r[1 : i], ''))), ','), '') AS rejected_spans
FROM joined
"""

OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT place, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs
), items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id) GROUP BY ALL
), postings AS (
  SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, total GROUP BY term
), scored AS (
  SELECT item_id, place, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN items USING (term), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 20
"""

OP12_SQL = r"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op1_decontamination": OP1_SQL, "op8_preferences": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
