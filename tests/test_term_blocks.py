"""Terms counted in blocks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.functions.columns import run_lengths
from inkgauge.operators import ngram_blocks, term_blocks, tfidf

ROWS = [
    (1, "a", "The red fox saw the red fox"), (2, "a", "red FOX; red fox é1 Ωx"), (3, None, "red fox"), (4, "b", None),
    (5, "b", ""), (6, "b", "the of and"), (7, "a", "fox"), (7, "a", "fox"), (None, None, "saw the saw red"),
]


@pytest.mark.parametrize("tokens", [1, 6, 1 << 21])
@pytest.mark.parametrize("by", [[], ["source"], ["source", "doc_id"]])
def test_blocks_count_like_rows(spark, monkeypatch, tokens, by):
    monkeypatch.setattr(ngram_blocks, "BLOCK_TOKENS", tokens)
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string").repartition(2)
    exploded = df.select(*by, F.explode(run_lengths(T.terms(F.col("text")), "term", "tf")).alias("t"))
    wanted = exploded.groupBy(*by, F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("total"), F.count("*").alias("df"))
    for terms in (None, T.terms(F.col("text"))):
        found = tfidf.term_stats(df, by, terms)
        assert found.columns == wanted.columns
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))


def test_a_block_gives_each_term_once(spark):
    df = spark.range(3000).select(F.split(F.lit("red fox red fox"), " ").alias("w")).coalesce(1)
    rows = sorted(map(tuple, term_blocks.count_terms(df, [], F.col("w"), pairs=True).collect()))
    assert rows == [("fox", 6000, 3000), ("fox red", 3000, 3000), ("red", 6000, 3000), ("red fox", 6000, 3000)]


def test_terms_of_many_blocks_come_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_blocks, "BLOCK_TOKENS", 8)
    df = spark.range(300).select(F.split(F.lit("red fox red fox"), " ").alias("w")).repartition(3)
    rows = sorted(map(tuple, term_blocks.count_terms(df, [], F.col("w"), pairs=True).collect()))
    assert rows == [("fox", 600, 300), ("fox red", 300, 300), ("red", 600, 300), ("red fox", 600, 300)]


@pytest.mark.parametrize("size", [1, 150, 1 << 22])
def test_packed_terms_add_up_by_whole_parts(monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(term_blocks, "CELL_BYTES", size)
    monkeypatch.setattr(term_blocks, "ROWS", 2)
    words = pa.array(["é", "", "a b", "c", "dd"])
    rows, wanted = [], Counter()
    for i in range(3):
        total, group = np.arange(5) + i, np.array([0, 1, 1, 0, 1])
        cells = term_blocks._cells(np.array([7, 3, 3, 5, 7]), words, total, total * 0 + 1, group)
        rows += [{"part": p, "cell": c, "_by0": [("x", None)[g] for g in groups]} for p, c, groups in cells]
        for w, t, g in zip(words.to_pylist(), total.tolist(), group):
            wanted[("x", None)[g], w] += t
    table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["part"]))
    found = [(r["_by0"], r["term"], r["total"], r["df"]) for b in term_blocks._in_turn(table, ["_by0"]) for r in b.to_pylist()]
    assert sorted(found, key=str) == sorted(((g, w, n, 3) for (g, w), n in wanted.items()), key=str)


def test_keys_beyond_64_bits_are_numbered():
    import numpy as np

    key = np.array([1 << 60, 5, 1 << 60, 5, 7])
    found = term_blocks._counted(key, np.array([0, 0, 0, 9, 9]), 10)
    assert [x.tolist() for x in found] == [[5, 7, 1 << 60], [2, 1, 2], [2, 1, 1]]


def test_held_out_vocabulary_stores_own_counts_only(spark, monkeypatch):
    names, stored = [], tfidf.stored
    monkeypatch.setattr(tfidf, "stored", lambda df, name: names.append(name) or stored(df, name))
    df = spark.createDataFrame([*[r for r in ROWS if r[2]], (8, "b", "blue fox red")], "doc_id long, source string, text string")
    found = {tuple(r) for r in tfidf.held_out_vocab(tfidf.term_stats(df, ["source"]), "source", 3).collect()}
    assert names == ["own-terms"]
    wanted = set()
    for source in ("a", "b"):  # a row without a source is in every fold
        rest = df.where(~F.col("source").eqNullSafe(source))
        wanted |= {(source, r.term, r.total, r.df) for r in tfidf.vocabulary(tfidf.term_stats(rest), 3).collect()}
    assert found == wanted
