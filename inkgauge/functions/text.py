"""Cleaning, sentence and token expressions. All stay inside the JVM and inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions.columns import let
from inkgauge.functions.stopwords import ENGLISH_STOP_WORDS


def _without(text: Column, pattern: str, part: str) -> Column:
    """`text` without matches of a pattern, which all contain `part`; texts that lack it are not searched."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(part)), F.regexp_replace(t, pattern, "")).otherwise(t))


def strip_html(text: Column) -> Column:
    return _without(text, P.HTML_TAG, "<")


def strip_urls(text: Column) -> Column:
    return _without(text, P.URL, "://")


def strip_handles(text: Column) -> Column:
    return _without(text, P.HANDLE, "@")


def strip_hashtags(text: Column) -> Column:
    return _without(text, P.HASHTAG, "#")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, P.SPACE_RUN_NOT_PLAIN, " "))


def clean_text(text: Column) -> Column:
    """Remove tags, URLs, handles and hashtags in that order, then collapse white space."""
    stripped = strip_hashtags(strip_handles(strip_urls(strip_html(F.coalesce(text, F.lit(""))))))
    return collapse_ws(stripped)


def is_blank(text: Column) -> Column:
    return collapse_ws(F.coalesce(text, F.lit(""))) == ""


def preview_text(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Non-blank pieces between runs of `.!?`, with white space collapsed."""
    pieces = F.split(collapse_ws(text), P.SENTENCE_END)
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    """Words per sentence; single spaces separate words after collapsing."""
    return F.transform(sentences(text), lambda s: F.size(F.split(s, " ")))


def burstiness(lengths: Column) -> Column:
    """Population standard deviation of the sentence lengths, 0.0 below two sentences."""

    def deviation(xs: Column) -> Column:
        n = F.size(xs)
        mean = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / n
        return let(
            mean,
            lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / n),
        )

    return let(lengths, lambda xs: F.when(F.size(xs) < 2, F.lit(0.0)).otherwise(deviation(xs)))


def mean_length(lengths: Column) -> Column:
    """Mean of an array of numbers, null when it is empty."""
    return let(
        lengths,
        lambda xs: F.when(
            F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)
        ),
    )


def lm_tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Tokens of the language model: the whole text unless a model context limits it."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(P.LM_TOKEN), F.lit(0))
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def pairs(tokens: Column) -> Column:
    """Adjacent pairs of an array as structs (prev, term)."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) > 1,
            F.zip_with(
                F.slice(t, 1, F.size(t) - 1),
                F.slice(t, 2, F.size(t) - 1),
                lambda a, b: F.struct(a.alias("prev"), b.alias("term")),
            ),
        ).otherwise(F.array().cast("array<struct<prev:string,term:string>>")),
    )


def tokens(text: Column) -> Column:
    """Lower-cased tokens of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM_TOKEN), F.lit(0))


def remove_stopwords(toks: Column, words: list[str] | None = None) -> Column:
    stop = list(ENGLISH_STOP_WORDS if words is None else words)
    return F.filter(toks, lambda t: ~t.isin(stop)) if stop else toks


def ngrams_1_2(toks: Column) -> Column:
    """Unigrams followed by space-joined adjacent bigrams."""
    return let(
        toks,
        lambda t: F.when(
            F.size(t) > 1,
            F.concat(
                t,
                F.zip_with(
                    F.slice(t, 1, F.size(t) - 1),
                    F.slice(t, 2, F.size(t) - 1),
                    lambda a, b: F.concat_ws(" ", a, b),
                ),
            ),
        ).otherwise(t),
    )


def terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens without stop words, as unigrams and bigrams."""
    return ngrams_1_2(remove_stopwords(tokens(text), stopwords))


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))


def as_percent(probability: Column) -> Column:
    return F.concat(fixed_decimals(probability * 100, 2), F.lit("%"))
