"""Hand-computed rows for the text functions."""

import math

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import edits
from inkgauge.functions import patterns as P
from inkgauge.functions import text as T
from inkgauge.functions.columns import run_lengths
from inkgauge.operators import cleaning, style


def value(spark, make, text):
    row = spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("v")).first()
    return row["v"]





@pytest.mark.parametrize(
    "text, expected",
    [
        ("<b>Hi</b>\t@bob see https://x.io/a?b=1 #tag  now ", "Hi see now"),
        ("mail foo@example.com please reply now", "mail foo.com please reply now"),
        ("a  b\x1cc\x85d", "a b c d"),
        (None, ""),
    ],
)
def test_clean_text(spark, text, expected):
    assert value(spark, lambda t: T.clean_text(t), text) == expected


def test_searches_are_spared_where_nothing_is_found(spark):
    import random

    rng = random.Random(2)
    pieces = [" ", "  ", "\t", "\x1c", "\x85", "\u3000", "\u00a0 ", "a", "é", "<", "b>", "<i>", "@x", "@", "#t", "#", "http", "https://x", "://"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    plain = F.coalesce("text", F.lit(""))
    for pattern in (P.HTML_TAG, P.URL, P.HANDLE, P.HASHTAG):
        plain = F.regexp_replace(plain, pattern, "")
    plain = F.trim(F.regexp_replace(plain, P.SPACE_RUN, " "))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(~plain.eqNullSafe(T.clean_text(F.col("text")))).collect() == []
    # a single space is no match, so words with one space between them are copied at once
    one, more = df.select(F.regexp_count(F.lit(" a b c "), F.lit(P.SPACE_RUN_NOT_PLAIN)), F.regexp_count(F.lit(" \ta  b"), F.lit(P.SPACE_RUN_NOT_PLAIN))).first()
    assert (one, more) == (0, 2)


def test_strip_html_takes_anything_between_angles(spark):
    assert value(spark, lambda t: T.strip_html(t), "if a<b and c>d then") == "if ad then"


def test_min_length_is_strict(spark):
    df = spark.createDataFrame([("x" * 20,), ("é" * 21,)], "text string")
    assert [r.text for r in cleaning.min_length(df).collect()] == ["é" * 21]


def test_dedup_keeps_the_first_source(spark):
    rows = [(5, 1, "same text", 0, "late"), (9, 0, "same text", 1, "early"), (1, 1, "other", 0, "late")]
    df = spark.createDataFrame(rows, "doc_id long, source_rank int, text string, label int, source string")
    kept = {r.text: (r.label, r.source) for r in cleaning.dedup_exact(df, ["source_rank", "doc_id"]).collect()}
    assert kept == {"same text": (1, "early"), "other": (0, "late")}


@pytest.mark.parametrize("partitions", [1, 17])
def test_dedup_of_one_dominant_text(spark, partitions):
    df = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same long text").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    out = cleaning.dedup_exact(df.repartition(partitions), ["doc_id"])
    assert out.count() == 20_001
    assert out.where("text = 'the same long text'").first().doc_id == 0


@pytest.mark.parametrize(
    "text, lengths, burstiness",
    [
        ("One two three. Four!", [3, 1], 1.0),
        ("Pi is 3.14 ok.", [3, 2], 0.5),
        ("a.\nb c.\n\nd e f", [1, 2, 3], math.sqrt(2 / 3)),
        ("no end mark", [3], 0.0),
        ("?!...", [], 0.0),
    ],
)
def test_sentence_features(spark, text, lengths, burstiness):
    row = style.add_sentence_features(spark.createDataFrame([(text,)], "text string")).first()
    assert row.sentence_lengths == lengths
    assert row.burstiness == pytest.approx(burstiness, abs=1e-12)


def test_burstiness_ignores_sentence_order(spark):
    forward = value(spark, lambda t: T.burstiness(T.sentence_lengths(t)), "a b c. d. e f g h i!")
    backward = value(spark, lambda t: T.burstiness(T.sentence_lengths(t)), "e f g h i! d. a b c.")
    assert forward == pytest.approx(backward, abs=1e-12)


def test_null_text_has_null_features(spark):
    df = style.sentence_stats(style.add_sentence_features(spark.createDataFrame([(None,)], "text string")))
    row = df.first()
    assert row.burstiness is None and row.mean_sentence_length is None


def test_preview(spark):
    assert value(spark, lambda t: T.preview_text(t), "a" * 100) == "a" * 100
    assert value(spark, lambda t: T.preview_text(t), "a" * 101) == "a" * 100 + "..."


def test_formats_round_half_to_even(spark):
    assert value(spark, lambda t: T.as_percent(F.lit(0.125)), "") == "12.50%"
    assert value(spark, lambda t: T.fixed_decimals(F.lit(0.125), 2), "") == "0.12"
    assert value(spark, lambda t: T.fixed_decimals(F.lit(12345.25), 1), "") == "12345.2"


def test_terms(spark):
    assert value(spark, lambda t: T.terms(t), "The quick-brown fox, a FOX") == [
        "quick", "brown", "fox", "fox", "quick brown", "brown fox", "fox fox",
    ]
    assert value(spark, lambda t: T.terms(t), "the of") == []


def test_run_lengths(spark):
    counts = value(spark, lambda t: run_lengths(F.split(t, " ")), "b a b c a b")
    assert [(r.item, r.n) for r in counts] == [("a", 2), ("b", 3), ("c", 1)]
    assert value(spark, lambda t: run_lengths(F.array().cast("array<string>")), "") == []


# edits


def test_comma_rules_need_a_letter_after_the_comma(spark):
    assert value(spark, lambda t: edits.phrase_rules(t), "However, it is.") == "However, it is."
    assert value(spark, lambda t: edits.phrase_rules(t), "However,x") == "Honestly,x"
    assert value(spark, lambda t: edits.phrase_rules(t, strict=False), "However, it is.") == "Honestly, it is."


def test_blank_text_is_not_edited(spark):
    assert value(spark, lambda t: edits.humanise(t, F.lit(1)), " \n ") == " \n "


def test_inserted_text_is_contracted_too(spark):
    texts = spark.range(200).select(
        edits.humanise(F.lit("First one. Second one."), F.col("id")).alias("t")
    )
    assert texts.where("t like '% do not %'").count() == 0
    assert texts.where("t like '%People don''t always%'").count() > 0


# fixed values: published pairs of text before and after editing
PUBLISHED_EDITS = [
    (
        "The relationship between remote work and bad luck is well-documented in the city.",
        "I mean, the relationship between remote work and bad luck is well-documented in the city. "
        "At least that is how it feels in practice.",
    ),
    (
        "Recent developments in climate change highlight the need for complex frameworks at school.",
        "I mean, recent developments in climate change highlight the need for complex frameworks at school. "
        "It isn't perfect, though.",
    ),
    (
        "In conclusion, remote work represents a wild opportunity for that influencer.",
        "Honestly, in conclusion, remote work represents a wild opportunity for that influencer. "
        "It isn't perfect, though.",
    ),
    (
        "Recent advancements in renewable energy highlight the potential for connectivity for all. "
        "The integration of green energy grid offers substantial greater efficiency. "
        "Stakeholders across Metropolis are monitoring these developments closely.",
        "Honestly, recent advancements in renewable energy highlight the potential for connectivity for all. "
        "People don't always say it this directly. "
        "The integration of green energy grid offers substantial greater efficiency. "
        "Stakeholders across Metropolis are monitoring these developments closely. "
        "That part matters more than people admit.",
    ),
]


def test_published_edits_are_reachable(spark):
    """Each published before/after pair is what some choice of the random parts gives."""
    pairs = PUBLISHED_EDITS
    df = spark.createDataFrame(pairs, "before string, after string")
    tried = df.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(599)))).select(
        "before", (edits.humanise(F.col("before"), F.col("id")) == F.col("after")).alias("hit")
    )
    found = tried.groupBy("before").agg(F.max("hit").alias("hit"))
    assert found.where("hit").count() == len(pairs)
