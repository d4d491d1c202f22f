"""Labelled texts from templates, for when a real source is not available."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.columns import let, pick, portable_hash
from inkgauge.operators.cleaning import dedup_exact
from inkgauge.operators.splits import SEED, sample_n

TEMPLATES = [
    (0, "Went to {place} with my {person} and the {thing} broke again, what a {mood} day"),
    (0, "Honestly the {thing} at {place} was {mood}. Would I go back? Maybe!"),
    (0, "My {person} keeps asking about {topic} and I have no idea, lol"),
    (0, "{place} at night is so {mood}. Took the {thing} home afterwards."),
    (1, "The role of {topic} in modern society is {quality}. It requires careful analysis at {place}."),
    (1, "Recent studies on {topic} indicate {quality} results. Further work at {place} is recommended."),
    (1, "{topic} provides a {quality} framework for progress. Stakeholders in {region} benefit from it."),
    (1, "An assessment of {topic} identifies several {quality} factors that shape future outcomes."),
]
FILLERS = {
    "place": ["the harbour", "the library", "the old mill", "the market", "the station", "the museum"],
    "person": ["neighbour", "sister", "coach", "flatmate", "uncle"],
    "thing": ["bike", "kettle", "tram", "laptop", "umbrella", "heater", "printer"],
    "mood": ["weird", "lovely", "exhausting", "funny", "quiet"],
    "topic": ["public transport", "soil science", "remote teaching", "ocean policy", "data quality"],
    "quality": ["significant", "robust", "comprehensive", "promising", "consistent"],
}
_SLOT = re.compile(r"\{(\w+)\}")


def _replace_first(text: Column, target: str, value: Column) -> Column:
    def replaced(t: Column) -> Column:
        at = F.instr(t, target)
        rest = F.substr(t, at + len(target))
        return F.when(at > 0, F.concat(F.substr(t, F.lit(1), at - 1), value, rest)).otherwise(t)

    return let(text, replaced)


def fill_templates(
    seeds: DataFrame,
    key: str = "doc_id",
    templates: list[tuple[int, str]] | None = None,
    fillers: dict[str, list[str]] | None = None,
    label_first: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """(key, text, label): one filled template per row of `seeds`.

    A slot is filled at its first occurrence only, and a slot without a filler list stays as
    it is. With `label_first` the label is drawn before a template of that label; otherwise
    the label is that of the drawn template.
    """
    templates = TEMPLATES if templates is None else templates
    fillers = FILLERS if fillers is None else fillers
    k = F.col(key)
    if label_first:
        groups = {lab: [t for t in templates if t[0] == lab] for lab in (0, 1)}
        label = F.pmod(portable_hash(seed, "label", k), F.lit(2)).cast("int")
        chosen = F.when(label == 0, pick([t for _, t in groups[0]], seed, "template", k)).otherwise(
            pick([t for _, t in groups[1]], seed, "template", k)
        )
        drawn = seeds.select(key, chosen.alias("text"), label.alias("label"))
    else:
        at = F.pmod(portable_hash(seed, "template", k), F.lit(len(templates))).cast("int")
        options = F.array(
            *[F.struct(F.lit(t).alias("text"), F.lit(lab).alias("label")) for lab, t in templates]
        )
        drawn = seeds.select(key, F.get(options, at).alias("_t")).select(key, "_t.text", "_t.label")
    used = {slot for _, t in templates for slot in _SLOT.findall(t)}
    for slot in sorted(used & fillers.keys()):
        filled = _replace_first(F.col("text"), "{" + slot + "}", pick(fillers[slot], seed, slot, k))
        drawn = drawn.withColumn("text", filled)
    return drawn


def generate_templates(
    seeds: DataFrame,
    n: int | None = None,
    name: str = "custom_synthetic",
    key: str = "doc_id",
    **options,
) -> DataFrame:
    """(key, text, label, source) with distinct texts; exactly `n` of them when `n` is given.

    Raises when the seeds do not lead to `n` distinct texts.
    """
    distinct = dedup_exact(fill_templates(seeds, key, **options), [key])
    out = distinct.withColumn("source", F.lit(name))
    if n is None:
        return out
    available = out.count()
    if available < n:
        raise ValueError(f"{n} texts asked for, the templates gave {available} distinct ones")
    return sample_n(out, n, key, options.get("seed", SEED))


def _choices(template: str, fillers: dict[str, list[str]]) -> list[str]:
    """Slots of a template that have fillers, each once."""
    return [slot for slot in dict.fromkeys(_SLOT.findall(template)) if slot in fillers]


def combinations(templates: list[tuple[int, str]] | None = None, fillers: dict[str, list[str]] | None = None) -> int:
    """How many filled templates there are."""
    templates = TEMPLATES if templates is None else templates
    fillers = FILLERS if fillers is None else fillers
    return sum(math.prod(len(fillers[slot]) for slot in _choices(t, fillers)) for _, t in templates)


def generate_exact(
    spark: SparkSession,
    n: int,
    name: str = "custom_synthetic",
    key: str = "doc_id",
    templates: list[tuple[int, str]] | None = None,
    fillers: dict[str, list[str]] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(key, text, label, source): exactly `n` different combinations of template and fillers, for any
    `n` up to their number.

    The combinations are numbered. Row i gets the number that a keyed permutation gives to i, and the
    template and fillers that have this number, so nothing is drawn twice or rejected and the rows do
    not depend on the partitioning. Different combinations are different texts unless a template with
    its fillers spells another one. Each slot is one more nested expression; Spark resolves about a dozen.
    """
    templates = TEMPLATES if templates is None else templates
    fillers = FILLERS if fillers is None else fillers
    total = combinations(templates, fillers)
    if n > total:
        raise ValueError(f"{n} texts asked for, there are {total} combinations")
    if total >= 1 << 62:
        raise ValueError(f"{total} combinations are too many to number")
    rng = random.Random(seed)
    factor = next(f for f in iter(lambda: rng.randrange(max(total, 1)) | 1, None) if math.gcd(f, max(total, 1)) == 1)
    shift = rng.randrange(max(total, 1))
    wide = "decimal(19,0)"
    product = F.col(key).cast(wide) * F.lit(factor).cast(wide) + F.lit(shift).cast(wide)
    rows = spark.range(n).withColumnRenamed("id", key)
    rows = rows.withColumn("_code", (product % F.lit(max(total, 1)).cast(wide)).cast("long"))
    text, label, first = F.lit(None).cast("string"), F.lit(None).cast("int"), 0
    for own_label, template in templates:
        slots = _choices(template, fillers)
        size = math.prod(len(fillers[slot]) for slot in slots)
        here = (F.col("_code") >= first) & (F.col("_code") < first + size)
        filled, left = F.lit(template), F.col("_code") - first
        for slot in slots:
            options = F.array(*[F.lit(o) for o in fillers[slot]])
            digit = F.pmod(left, F.lit(len(fillers[slot]))).cast("int")
            filled = _replace_first(filled, "{" + slot + "}", F.get(options, digit))
            left = F.call_function("div", left, F.lit(len(fillers[slot])))
        text, label, first = F.when(here, filled).otherwise(text), F.when(here, own_label).otherwise(label), first + size
    return rows.select(key, text.alias("text"), label.alias("label"), F.lit(name).alias("source"))
