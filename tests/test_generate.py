"""Exactly as many different texts as asked for."""

import pytest

from inkgauge.sources import generate

FILLERS = {"a": ["x", "y", "z"], "b": ["1", "2"], "unused": ["u"]}
TEMPLATES = [(0, "first {a} and {b}, {a} again {c}"), (1, "second {b}"), (1, "third")]


def test_every_number_of_texts(spark):
    total = generate.combinations(TEMPLATES, FILLERS)
    assert total == 3 * 2 + 2 + 1
    expected = {f"first {a} and {b}, {{a}} again {{c}}" for a in "xyz" for b in "12"} | {"second 1", "second 2", "third"}
    for n in (0, 1, 5, total):
        rows = generate.generate_exact(spark, n, templates=TEMPLATES, fillers=FILLERS, seed=n).collect()
        texts = [r.text for r in rows]
        assert len(texts) == len(set(texts)) == n and set(texts) <= expected
        assert all(r.label == (0 if r.text.startswith("first") else 1) for r in rows)
    with pytest.raises(ValueError, match="combinations"):
        generate.generate_exact(spark, total + 1, templates=TEMPLATES, fillers=FILLERS)


def test_all_combinations_of_the_own_templates(spark):
    total = generate.combinations()
    texts = generate.generate_exact(spark, total).select("text")
    assert texts.distinct().count() == total
    again = generate.generate_exact(spark, total).repartition(7).select("text")
    assert texts.exceptAll(again).count() == 0


def test_very_many_combinations(spark):
    fillers = {f"s{i}": [f"{i}-{j}" for j in range(1000)] for i in range(6)}
    template = [(0, " ".join("{" + s + "}" for s in fillers))]
    assert generate.combinations(template, fillers) == 10**18
    rows = generate.generate_exact(spark, 500, templates=template, fillers=fillers).collect()
    assert len({r.text for r in rows}) == 500 and all("{" not in r.text for r in rows)
