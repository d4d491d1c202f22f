"""Cleaning, sentences, tokens and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import edits, patterns
from inkgauge.functions import text as T
from inkgauge.operators import cleaning, style
from inkgauge.plans import oracle_parts as O
from inkgauge.plans.registry import query
from inkgauge.plans.views import Views
from inkgauge.sources import readers

ROUND = 6


def _pages(v: Views, text: Column) -> DataFrame:
    return v.table("pages").select("page_id", text.alias("text"))


_HTML_URL = "concat(html, ' see ', url, ' end')"


def _html_url() -> Column:
    return F.concat("html", F.lit(" see "), "url", F.lit(" end"))


@query("strip_html", f"SELECT page_id, {O.drop('html', patterns.HTML_TAG)} AS text FROM pages")
def strip_html(v: Views) -> DataFrame:
    return _pages(v, T.strip_html(F.col("html")))


@query("strip_urls", f"SELECT page_id, {O.drop(_HTML_URL, patterns.URL)} AS text FROM pages")
def strip_urls(v: Views) -> DataFrame:
    return _pages(v, T.strip_urls(_html_url()))


@query("strip_handles", f"SELECT doc_id, {O.drop('text', patterns.HANDLE)} AS text FROM documents")
def strip_handles(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.strip_handles(F.col("text")).alias("text"))


@query("strip_hashtags", f"SELECT page_id, {O.drop('html', patterns.HASHTAG)} AS text FROM pages")
def strip_hashtags(v: Views) -> DataFrame:
    return _pages(v, T.strip_hashtags(F.col("html")))


@query("collapse_ws", f"SELECT page_id, {O.collapse('html')} AS text FROM pages")
def collapse_ws(v: Views) -> DataFrame:
    return _pages(v, T.collapse_ws(F.col("html")))


@query("clean_text", f"SELECT page_id, {O.clean(_HTML_URL)} AS text FROM pages")
def clean_text(v: Views) -> DataFrame:
    return _pages(v, T.clean_text(_html_url()))


@query(
    "min_length",
    f"SELECT doc_id, length(t) AS n_chars FROM (SELECT doc_id, {O.clean('text')} AS t FROM documents) WHERE length(t) > 20",
)
def min_length(v: Views) -> DataFrame:
    cleaned = v.table("documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return cleaning.min_length(cleaned).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(
    "dedup_exact",
    O.with_views(
        f"""SELECT doc_id, turn, text, label, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, doc_id, turn) AS rn
FROM (SELECT doc_id, turn, {O.clean('text')} AS text, label, source, source_rank FROM united)) WHERE rn = 1""",
        "united",
    ),
)
def dedup_exact(v: Views) -> DataFrame:
    united = readers.union_sources(v.sources())
    cleaned = united.withColumn("text", T.clean_text(F.col("text")))
    return cleaning.dedup_exact(cleaned, ["source_rank", "doc_id", "turn"]).drop("source_rank")


_CLEAN_DOCUMENTS = f"SELECT doc_id, source, lang, {O.clean('text')} AS text FROM documents"


@query(
    "clean_corpus",
    f"SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM ({_CLEAN_DOCUMENTS}) WHERE length(text) > 20) WHERE rn = 1",
)
def clean_corpus(v: Views) -> DataFrame:
    return cleaning.clean_corpus(v.table("documents").select("doc_id", "text", "source"), ["doc_id"])


@query(
    "clean_corpus_counts",
    f"SELECT count(*) AS input_rows, count(*) FILTER (length(text) > 20) AS long_rows, count(DISTINCT text) FILTER (length(text) > 20) AS output_rows FROM ({_CLEAN_DOCUMENTS})",
)
def clean_corpus_counts(v: Views) -> DataFrame:
    return cleaning.cleaning_counts(v.table("documents"), ["doc_id"])


@query(
    "skip_blank",
    f"""SELECT doc_id, i AS line_no, lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE {O.collapse('lines[i]')} <> ''""",
)
def skip_blank(v: Views) -> DataFrame:
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text"))
    numbered = lines.select("doc_id", (F.col("_p") + 1).cast("long").alias("line_no"), "text")
    return cleaning.skip_blank(numbered)


@query(
    "preview_text",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents",
)
def preview_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.preview_text(F.col("text")).alias("preview"))


@query(
    "sentences",
    f"SELECT doc_id, len(s)::INTEGER AS n_sentences, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents)",
)
def sentences(v: Views) -> DataFrame:
    split = v.table("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


_LENGTHS = f"SELECT doc_id, {O.lengths(O.sentences('text'))} AS lens FROM documents"


def _lengths(v: Views) -> DataFrame:
    return style.add_sentence_features(v.table("documents"))


@query("sentence_lengths", f"SELECT doc_id, array_to_string(lens, ',') AS lengths FROM ({_LENGTHS})")
def sentence_lengths(v: Views) -> DataFrame:
    as_text = F.array_join(F.transform("sentence_lengths", lambda n: n.cast("string")), ",")
    return _lengths(v).select("doc_id", as_text.alias("lengths"))


@query("burstiness", f"SELECT doc_id, round({O.burstiness('lens')}, 6) AS burstiness FROM ({_LENGTHS})")
def burstiness(v: Views) -> DataFrame:
    return _lengths(v).select("doc_id", F.round("burstiness", ROUND).alias("burstiness"))


@query(
    "sentence_stats",
    f"SELECT doc_id, len(lens)::INTEGER AS n_sentences, round(list_avg(lens), 6) AS mean_sentence_length FROM ({_LENGTHS})",
)
def sentence_stats(v: Views) -> DataFrame:
    return style.sentence_stats(_lengths(v)).select(
        "doc_id", "n_sentences", F.round("mean_sentence_length", ROUND).alias("mean_sentence_length")
    )


@query(
    "sentence_rhythm",
    f"SELECT doc_id, i::INTEGER AS sentence_no, lens[i] AS words FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM ({_LENGTHS}))",
)
def sentence_rhythm(v: Views) -> DataFrame:
    return style.sentence_rhythm(_lengths(v))


@query("tokens", f"SELECT doc_id, array_to_string({O.tokens('text')}, ' ') AS tokens FROM documents")
def tokens(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("remove_stopwords", f"SELECT doc_id, array_to_string({O.kept('text')}, ' ') AS tokens FROM documents")
def remove_stopwords(v: Views) -> DataFrame:
    kept = T.remove_stopwords(T.tokens(F.col("text")))
    return v.table("documents").select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(
    "ngrams",
    f"SELECT doc_id, array_to_string({O.ngrams('k')}, '|') AS terms FROM (SELECT doc_id, {O.kept('text')} AS k FROM documents)",
)
def ngrams(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.array_join(T.terms(F.col("text")), "|").alias("terms"))


# edits of machine-like text, one step at a time, over the documents


_EDIT = O.edit_ctes("documents", "all_edit")
O.CTES.update(_EDIT)


@query("phrase_rules", O.with_views("SELECT doc_id, ruled AS text FROM all_edit_ruled", "all_edit_ruled"))
def phrase_rules(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", edits.phrase_rules(F.col("text")).alias("text"))


def _sentences(v: Views) -> DataFrame:
    ruled = edits.phrase_rules(F.col("text"))
    return v.table("documents").select("doc_id", "text", edits.split_keep_punct(ruled).alias("s"))


def _joined(sents: str | Column) -> Column:
    return F.array_join(sents, "|")


@query(
    "split_keep_punct",
    O.with_views("SELECT doc_id, array_to_string(s, '|') AS sentences FROM all_edit_split", "all_edit_split"),
)
def split_keep_punct(v: Views) -> DataFrame:
    return _sentences(v).select("doc_id", _joined("s").alias("sentences"))


@query(
    "soften_opening",
    O.with_views(
        "SELECT doc_id, array_to_string(o, '|') AS sentences FROM all_edit_opened WHERE len(s) > 0", "all_edit_opened"
    ),
)
def soften_opening(v: Views) -> DataFrame:
    opened = edits.soften_opening(F.col("s"), F.col("doc_id"))
    return _sentences(v).where(F.size("s") > 0).select("doc_id", _joined(opened).alias("sentences"))


@query(
    "insert_aside",
    O.with_views(
        "SELECT doc_id, array_to_string(a, '|') AS sentences FROM all_edit_aside WHERE len(s) > 0", "all_edit_aside"
    ),
)
def insert_aside(v: Views) -> DataFrame:
    opened = _sentences(v).where(F.size("s") > 0).withColumn(
        "s", edits.soften_opening(F.col("s"), F.col("doc_id"))
    )
    return opened.select("doc_id", _joined(edits.insert_aside(F.col("s"), F.col("doc_id"))).alias("sentences"))


@query(
    "append_hedge",
    O.with_views(
        f"SELECT doc_id, array_to_string(s, ' ') || {O.pick(edits.HEDGES, 'hedge', 'doc_id')} AS text FROM all_edit_split WHERE len(s) > 0",
        "all_edit_split",
    ),
)
def append_hedge(v: Views) -> DataFrame:
    hedged = edits.append_hedge(F.col("s"), F.col("doc_id"))
    return _sentences(v).where(F.size("s") > 0).select("doc_id", hedged.alias("text"))


@query("contractions", f"SELECT doc_id, {O.contracted('text')} AS text FROM documents")
def contractions(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", edits.contractions(F.col("text")).alias("text"))


@query("humanise", O.with_views("SELECT doc_id, edited AS text FROM all_edit", "all_edit"))
def humanise(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id", edits.humanise(F.col("text"), F.col("doc_id")).alias("text")
    )
