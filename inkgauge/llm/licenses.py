"""License scan: ordered signature rules over normalised words, in DataFrame functions only.

A rule is a pattern over the words of a text, with a keyword that must occur before the pattern is
tried, a label, a priority and a confidence. The patterns are names of licenses, tried in several
contexts from a grant ("licensed under the ...") to a bare mention, sentences of license texts,
tags and addresses, and denials ("not licensed under ..."), which have the best priority and no label.
A sweep over the detections from left to right resolves overlaps, see `resolved`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.columns import let
from inkgauge.llm import license_rules
from inkgauge.llm.common import take
from inkgauge.llm.decontamination import words_of
from inkgauge.llm.license_rules import ADDRESSES, BODIES, DENIALS, GRANTED, TAGS

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # on text in any case
# fixed values: phrases and labels that are always reported
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
GRANT = GRANTED + " under (?:the )?"
# an identifier stands after the tag or, in an expression, after other ones of at most 40 characters
TAG = "spdx license identifier"
AFTER_TAG = f"(?<={TAG} |{TAG} [a-z0-9 ]{{1,40}} (?:or|and|with) )"
DENIED = 0.3  # score of a fixed phrase that no standing detection confirms
# (pattern round the name, priority: smaller is better, confidence)
CONTEXTS = (
    (GRANT + r"(?:terms (?:and conditions )?of (?:the )?)?{name}", 1, 0.95),
    (r"(?:subject to|governed by|according to|in accordance with) (?:the )?(?:terms of (?:the )?)?{name}", 2, 0.9),
    (r"(?:see|under|using|with) (?:the )?{name}", 3, 0.8),
    (r"{name} (?:applies|terms|notice|agreement|header)", 4, 0.7),
    (r"{name}", 5, 0.6),
)
# (keyword, pattern) of each name by label and pattern
NAMES = {(label, name): (keyword, name) for label, keyword, name in license_rules.NAMES}
OPEN, CLOSE = "\x01", "\x02"  # no word has them


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence): denials, texts, tags and addresses, names in their contexts."""
    return [
        *(("", keyword, pattern, 0, 0.0) for keyword, pattern in DENIALS),
        *((label, keyword, pattern, 1, 0.9) for label, keyword, pattern in BODIES),
        *((label, TAG, f"{AFTER_TAG}(?:{name})", 1, 0.95) for label, name in TAGS),
        *((label, keyword, pattern, 1, 0.85) for label, keyword, pattern in ADDRESSES),
        *(
            (label, keyword, context.format(name=f"(?:{name})"), priority, confidence)
            for (label, *_), (keyword, name) in NAMES.items()
            for context, priority, confidence in CONTEXTS
        ),
    ]


def hint() -> str:
    """A pattern that occurs in ' ' + text in lower case if any keyword but those of denials does: by first letter, at word starts."""
    words = sorted({max(r[1].split(), key=len, default="") for r in rules() if r[0]})
    if "" in words:  # a keyword without words is in every text
        return ""
    short = [w for w in words if not any(w != v and w.startswith(v) for v in words)]
    by_letter = {c: [w[1:] for w in short if w[0] == c] for c in sorted({w[0] for w in short})}
    return SEPARATOR + "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def places(line: Column, pattern: Column | str) -> Column:
    """array<struct<first, last>>: the words of each match of a pattern in ' word word ... '."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.substring(F.regexp_replace(line, bounded, F.lit(f"{OPEN}$0{CLOSE}")), 2, 2**31 - 1), " ")

    def ends(words: Column) -> Column:
        first = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(OPEN), i)), lambda i: i.isNotNull())
        last = F.filter(F.transform(words, lambda w, i: F.when(w.endswith(CLOSE), i)), lambda i: i.isNotNull())
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    none = F.array().cast("array<struct<first:int,last:int>>")
    return F.when(F.regexp_like(line, bounded), let(marked, ends)).otherwise(none)


def detections(line: Column) -> Column:
    """Matches of all rules whose keyword occurs, sorted by first word, length and priority."""
    by_keyword: dict[str, list[Column]] = {}
    for label, keyword, pattern, priority, confidence in rules():
        rule = F.struct(
            F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence")
        )
        by_keyword.setdefault(keyword.lstrip(), []).append(rule)
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    tried = F.flatten(F.transform(F.filter(table, lambda t: F.contains(line, F.concat(F.lit(" "), t["keyword"]))), lambda t: t["rules"]))
    matches = F.transform(
        tried,
        lambda r: F.transform(
            places(line, r["pattern"]),
            lambda p: F.struct(
                p["first"].alias("first"), (-p["last"]).alias("minus_last"), r["priority"].alias("priority"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        ),
    )
    return F.sort_array(F.flatten(matches))


def resolved(found: Column) -> Column:
    """struct<labels, score> of the detections that stand after one sweep over sorted ones.

    One detection stands at a time. The next one is suppressed if it lies inside that one; if it
    only overlaps, the better priority stays, then the longer, then the earlier, and the other is
    retracted. If it doesn't overlap, the standing one is final. Denials are final without a label.
    """
    start = F.struct(
        F.lit(-1).alias("first"), F.lit(-1).alias("end"), F.lit(0).alias("priority"), F.lit("").alias("label"),
        F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"),
    )

    def final(acc: Column, *standing: Column) -> Column:
        named = acc["label"] != ""
        labels = F.when(named, F.array_union(acc["labels"], F.array(acc["label"]))).otherwise(acc["labels"])
        return F.struct(*standing, labels.alias("labels"), F.greatest(acc["score"], acc["confidence"]).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        last = -d["minus_last"]
        longer = last - d["first"] > acc["end"] - acc["first"]
        better = (d["priority"] < acc["priority"]) | ((d["priority"] == acc["priority"]) & longer)
        standing = (
            d["first"].alias("first"), last.alias("end"), d["priority"].alias("priority"), d["label"].alias("label"),
            d["confidence"].alias("confidence"),
        )
        retracting = F.struct(*standing, acc["labels"].alias("labels"), acc["score"].alias("score"))
        return (
            F.when(d["first"] > acc["end"], final(acc, *standing)).when((last > acc["end"]) & better, retracting).otherwise(acc)
        )

    return F.aggregate(found, start, step, lambda acc: final(acc))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of struct first, last, label), labels (sorted array), score.

    One row per row of `docs`, repeated rows included. A null or empty text has no words and no
    labels; a null id is kept. `base` lists every place of a phrase of BASE, never suppressed; its
    label stays when the text denies it, with a score of DENIED unless something else stands.
    Texts without any keyword get no further than the keyword test.
    """
    docs = take(docs, "doc_id", "text")
    none = F.array().cast("array<struct<first:int,last:int,label:string>>")
    line = F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" "))

    def base_places(line: Column, phrase: str, label: str) -> Column:
        return F.transform(
            places(line, phrase),
            lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.lit(label).alias("label")),
        )

    def findings(line: Column) -> Column:
        base = F.flatten(F.array(*[base_places(line, phrase, label) for phrase, label in BASE.items()]))
        return F.struct(base.alias("base"), resolved(detections(line)).alias("own"))

    seen = F.when(F.regexp_like(F.concat(F.lit(" "), F.lower("text")), F.lit(hint())), let(line, findings))
    rows = docs.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), seen.alias("_f")
    )
    base = F.coalesce("_f.base", none)
    own = F.coalesce("_f.own.labels", F.array().cast("array<string>"))
    labels = F.concat(F.transform(base, lambda b: b["label"]), own)
    confirmed = F.when(F.exists(base, lambda b: F.array_contains(own, b["label"])), 1.0).when(F.size(base) > 0, DENIED)
    score = F.greatest(F.coalesce("_f.own.score", F.lit(0.0)), F.coalesce(confirmed, F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", base.alias("base"), F.array_sort(F.array_distinct(labels)).alias("labels"), score.alias("score")
    )
