"""N-grams counted and looked up in blocks."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.operators import ngram_blocks, ngram_model


def _texts(spark, n=60):
    rng = np.random.default_rng(3)
    words = ["a", "é", "the", "Ω", "x1", *[f"w{i}" for i in range(40)]]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (3, "the the a"), (None, "a the a"), (None, "the w1")]
    return ngram_model.assign_fold(spark.createDataFrame(rows, "doc_id long, text string"))


def _brute_force(rows):
    bi, pre, uni, size = Counter(), Counter(), Counter(), Counter()
    tokens = [(key, fold, (text or "").lower().split()) for key, fold, text in rows]
    for _, fold, t in tokens:
        for f in (fold, None):
            bi.update((f, *p) for p in zip(t, t[1:]))
            pre.update((f, a) for a in t[:-1])
            uni.update((f, a) for a in t)
            size[f] += len(t)
    vocabulary, sums = len({w for _, w in uni}), {}
    for key, fold, t in tokens:
        for a, b in zip(t, t[1:]):
            others = lambda c, *k: c[(None, *k)] - c[(fold, *k)]  # noqa: E731, B023
            add_one = (others(uni, b) + 1) / (size[None] - size[fold] + vocabulary)
            seen = others(pre, a)
            mixed = 0.7 * (others(bi, a, b) / seen if seen else 0.0) + 0.3 * add_one
            s = sums.setdefault(key, [0.0, 0.0, 0])
            s[0], s[1], s[2] = s[0] - np.log(add_one), s[1] - np.log(mixed), s[2] + 1
    return {k: (np.exp(u / n), np.exp(b / n)) for k, (u, b, n) in sums.items()}, bi


@pytest.mark.parametrize("tokens", [1, 50, 1 << 21])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, tokens):
    monkeypatch.setattr(ngram_blocks, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngram_blocks, "PART_KEYS", 10 * tokens)
    df = _texts(spark).repartition(3)
    wanted, bi = _brute_force([(r.doc_id, r.fold, r.text) for r in df.collect()])
    found = {r.doc_id: (r.unigram_perplexity, r.perplexity) for r in ngram_model.crossfit_perplexity(df).collect()}
    assert set(found) == set(wanted)
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)
    counts = {(r.fold, r.prev, r.term): r.n for r in ngram_model.bigram_counts(df).collect()}
    assert counts == {k: n for k, n in bi.items() if k[0] is not None}


def test_texts_are_stored_as_codes(spark):
    df = ngram_model.assign_fold(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text")))
    blocks = ngram_blocks.text_blocks(df.coalesce(1), "doc_id", F.split("text", " "))
    assert blocks.count() == 1 and blocks.first().n == 8000
    assert len(blocks.first().cell) < 8000  # of 8000 tokens of 5 letters


def test_equal_hashes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(ngram_blocks, "_word_hashes", lambda words: np.ones(len(words), np.uint64))
    with pytest.raises(Exception, match="same hash"):
        ngram_model.crossfit_perplexity(_texts(spark)).collect()
