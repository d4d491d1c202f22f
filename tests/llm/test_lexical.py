"""op11 against brute force over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkgauge.llm import lexical

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def by_brute_force(docs, items, k=20):
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    total, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    queries = {}
    for item, text in items:
        if item is not None and text is not None:
            queries[item] = min(queries.get(item, text), text, key=str.encode)
    out = []
    for item, text in queries.items():
        scores = []
        for doc, c, n in counted:
            m = 75 + 25 * n * total // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out)


def corpus(rng, n, words):
    pool = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    docs = [(i * 3 % 1009, " ".join(rng.choices(pool, odds, k=rng.randint(1, 40)))) for i in range(n)]
    copies = [(2000 + i, docs[7][1]) for i in range(n // 3)] if n > 7 else []  # a third of the rows are one text
    return docs + copies, [(i, " ".join(rng.choices(pool, odds, k=rng.randint(1, 12)))) for i in range(12)]


@pytest.mark.parametrize("n, postings, block, dense", [(5, 1 << 20, 64, 1 << 22), (400, 1 << 20, 8, 1 << 10), (400, 300, 4, 1 << 22)])
def test_ranking(spark, monkeypatch, n, postings, block, dense):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "DENSE", dense)
    docs, items = corpus(random.Random(n + block), n, 60)
    found = lexical.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), postings=postings)
    assert sorted(map(tuple, found.collect())) == by_brute_force(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,!"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (4, "BETA gamma Éa éa"),
        (5, "alpha " * 20_000 + "delta"), (-6, "Alpha, beta"), (7, "123 x-ray ñandú"), (8, "É x"),
    ]
    items = [
        (1, "alpha beta beta"), (1, "delta"), (2, None), (None, "alpha"), (3, ""), (4, "nothing known"), (5, "ray 123 ÑANDÚ ñandú"),
        (6, "é É gamma"), (6, "é É gamma"),
    ]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "'z' AS Text", "2 AS DOC_ID", "3 AS terms")
    i = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS g", "'q' AS TEXT")
    expected = by_brute_force(docs, items)
    for group_bytes in (1 << 20, 12):  # the second makes several groups of items
        found = lexical.rank_documents(d, i, group_bytes=group_bytes).collect()
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert lexical.rank_documents(d.limit(0), i).count() == 0
    assert lexical.rank_documents(d, i.limit(0)).count() == 0


def test_blocks_are_skipped_and_summaries_are_bounds():
    rng = np.random.default_rng(3)
    n, width = 4000, 300
    topic = rng.integers(0, 40, n)
    rows = [np.unique(np.r_[rng.integers(0, 30, 6) + topic[i] * 6 % 250, rng.integers(280, width, 12)]) for i in range(n)]
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    flat = np.concatenate(rows)
    weights = np.sort(rng.integers(1, 9000, width))[::-1].copy()
    shard = lexical.Shard(start, flat, rng.integers(1, 10**6, len(flat)), weights)
    for t in (0, 40, 150, 290):
        b = shard.blocks(t)
        assert sorted(b.documents) == [i for i in range(n) if t in rows[i]]
        for j in range(len(b.rows) - 1):
            most = np.zeros(width, np.int64)
            most[b.terms[b.rows[j] : b.rows[j + 1]]] = b.most[b.rows[j] : b.rows[j + 1]]
            seen = np.zeros(width, np.int64)
            for d in b.documents[b.bounds[j] : b.bounds[j + 1]]:
                np.maximum.at(seen, flat[start[d] : start[d + 1]], shard.impacts[start[d] : start[d + 1]])
            assert (most[t:] == seen[t:]).all() and not most[:t].any()
    for _ in range(30):
        query = np.unique(np.r_[rng.integers(0, 280, 4), rng.integers(280, width, 6)])
        shard.search(query, np.ones(len(query), np.int64), np.arange(n), 20)
    assert shard.opened["skipped"] > 0 and shard.opened["closed"] > shard.opened["visited"]
