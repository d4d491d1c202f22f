"""Edits that make machine-like text look revised by a person, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions.columns import let, pick

# fixed values
PHRASE_RULES = [
    (r"\bHowever,\b", "Honestly,"),
    (r"\bTherefore,\b", "So,"),
    (r"\bIn conclusion,\b", "Basically,"),
    (r"\bIt is important to note that\b", "One thing people forget is"),
    (r"\bMoreover,\b", "Also,"),
    (r"\bAdditionally,\b", "And honestly,"),
    (r"\bOrganizations\b", "A lot of teams"),
    (r"\bindividuals\b", "people"),
]
OPENINGS = ["Honestly, ", "I mean, ", "To be fair, ", "From what I've seen, "]
ASIDES = [
    "People do not always say it this directly.",
    "That is where the conversation gets messy.",
    "In real life, it usually feels less neat than that.",
]
HEDGES = [
    " It is not perfect, though.",
    " At least that is how it feels in practice.",
    " That part matters more than people admit.",
    " It sounds simple, but it really is not.",
]
CONTRACTIONS = [(" do not ", " don't "), (" is not ", " isn't "), (" are not ", " aren't ")]

SEED = 42


def phrase_rules(
    text: Column, rules: list[tuple[str, str]] | None = None, strict: bool = True
) -> Column:
    """Apply the rules in order.

    A rule that ends in a comma and a word boundary only fires when a letter follows the
    comma directly; `strict=False` drops that last boundary.
    """
    for pattern, replacement in PHRASE_RULES if rules is None else rules:
        if not strict and pattern.endswith(r",\b"):
            pattern = pattern[: -len(r"\b")]
        text = F.regexp_replace(text, pattern, replacement)
    return text


def split_keep_punct(text: Column) -> Column:
    """Sentences with their end marks, trimmed, blanks dropped."""
    pieces = F.split(text, r"(?<=[.!?])" + P.SPACE_RUN)
    edges = f"^{P.SPACE_RUN}|{P.SPACE_RUN}$"
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, edges, "")), lambda s: s != "")


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def soften_opening(sents: Column, key: Column, seed: int = SEED) -> Column:
    """A casual opening before the first sentence, whose first letter becomes lower case."""
    first = F.concat(pick(OPENINGS, seed, "opening", key), lower_first(F.get(sents, F.lit(0))))
    return F.concat(F.array(first), F.slice(sents, 2, F.greatest(F.size(sents) - 1, F.lit(0))))


def insert_aside(sents: Column, key: Column, seed: int = SEED) -> Column:
    """With more than one sentence, a remark after the first."""
    with_aside = F.concat(
        F.slice(sents, 1, 1),
        F.array(pick(ASIDES, seed, "aside", key)),
        F.slice(sents, 2, F.greatest(F.size(sents) - 1, F.lit(0))),
    )
    return F.when(F.size(sents) > 1, with_aside).otherwise(sents)


def append_hedge(sents: Column, key: Column, seed: int = SEED) -> Column:
    return F.concat(F.array_join(sents, " "), pick(HEDGES, seed, "hedge", key))


def contractions(text: Column) -> Column:
    for full, short in CONTRACTIONS:
        text = F.replace(text, F.lit(full), F.lit(short))
    return text


def humanise(
    text: Column,
    key: Column,
    seed: int = SEED,
    rules: list[tuple[str, str]] | None = None,
    strict: bool = True,
) -> Column:
    """All edits in order; a text without a sentence is returned as it was."""

    def edited(sents: Column) -> Column:
        opened = let(soften_opening(sents, key, seed), lambda s: insert_aside(s, key, seed))
        return let(opened, lambda s: contractions(append_hedge(s, key, seed)))

    return let(
        split_keep_punct(phrase_rules(text, rules, strict)),
        lambda sents: F.when(F.size(sents) > 0, edited(sents)).otherwise(text),
    )
