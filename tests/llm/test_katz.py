"""op13 against a model of plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import katz

DOCS = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), "<end> "]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


class Plain:
    """Katz backoff as written in textbooks, over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.cut = order, katz.CUT
        self.c = [Counter() for _ in range(order + 1)]
        for words in texts:
            line = ["<begin> ", *words]
            self.c[0][()] += len(words)
            for n in range(1, order + 1):
                for i in range(len(line) - n + 1):
                    if n > 1 or i:
                        self.c[n][tuple(line[i : i + n])] += 1
        self.begins = len(texts)
        self.ratio = [None] + [self.good_turing(Counter(c.values())) for c in self.c[1:]]
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for gram in self.c[n]:
                self.after[gram[:-1]].append(gram[-1])

    def good_turing(self, n):
        k, out = self.cut, {}
        absolute = (n[1] + 0.5) / (n[1] + 2 * n[2] + 1)
        for r in range(1, k + 1):
            d = -1
            if n[1] and n[r] and (k + 1) * n[k + 1] < n[1]:
                share = (k + 1) * n[k + 1] / n[1]
                d = ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share)
            out[r] = d if 0 < d < 1 else 1 - absolute / r
        return out

    def kept(self, gram):
        c = self.c[len(gram)][gram]
        return c * self.ratio[len(gram)][c] if c <= self.cut else c - self.cut * (1 - self.ratio[len(gram)][self.cut])

    def total(self, history):
        return self.begins if history == ("<begin> ",) else self.c[len(history)][history]

    def p(self, w, h):
        if not h:
            if not self.c[0][()]:
                return 1.0
            if (w,) in self.c[1]:
                return self.kept((w,)) / self.c[0][()]
            return 1 - sum(self.kept(g) for g in self.c[1]) / self.c[0][()]
        if (*h, w) in self.c[len(h) + 1]:
            return self.kept((*h, w)) / self.total(h)
        return self.weight(h) * self.p(w, h[1:])

    def weight(self, h):
        seen = self.after[h]
        if not seen:
            return 1.0
        return (1 - sum(self.p(w, h) for w in seen)) / (1 - sum(self.p(w, h[1:]) for w in seen))

    def score(self, words):
        line = ["<begin> ", *words]
        return sum(math.log10(self.p(line[i], tuple(line[max(0, i - self.order + 1) : i]))) for i in range(1, len(line)))


def by_brute_force(docs, order):
    train = [tokens(t) for d, t in docs if not is_held(d)]
    model = Plain(train, order)
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((d, is_held(d), len(words), sum(1 for w in words if counts[w]), n, base, model.score(words)))
    return model, out


def corpus(rng, n, words):
    pool, odds = [f"W{i}" for i in range(words)], [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(rng.choices(pool, odds, k=rng.randint(0, 30)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(n // 3)]  # a third of the rows are one text
    docs += [(5000, None), (5001, ""), (5002, " \n\t"), (None, "w1 w2 zz"), (5003, "ñandú É   w1"), (7, "w1 w2"), (7, "w1 w2")]
    return docs + [(6000 + i, f"w1 new{i} w2 w3") for i in range(8)]


def same(found, expected):
    found = sorted((tuple(r) for r in found), key=lambda r: (str(r[0]), r[2:]))
    expected = sorted(expected, key=lambda r: (str(r[0]), r[2:]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9), a[0]


@pytest.mark.parametrize("order, batch, part", [(1, 400, 50), (2, 1 << 24, 1 << 21), (3, 300, 40), (4, 2000, 1 << 21)])
def test_scores(spark, order, batch, part):
    docs = corpus(random.Random(order), 60, 40)
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS batch", "'x' AS Text", "2 AS DOC_ID", "3 AS part")
    same(katz.score_texts(df, order=order, batch=batch, part=part).collect(), by_brute_force(docs, order)[1])


def test_probabilities_of_a_history_sum_to_one():
    model, _ = by_brute_force(corpus(random.Random(9), 60, 30), 3)
    words = [g[0] for g in model.c[1]] + ["<unknown> "]
    histories = [g for n in (1, 2) for g in model.c[n] if model.after[g]][::7] + [("<begin> ",), ("nothing ", "here "), ()]
    for h in histories:
        assert sum(model.p(w, h) for w in words) == pytest.approx(1.0, abs=1e-9)


def test_count_tables(spark):
    docs = corpus(random.Random(5), 60, 40)
    df = spark.createDataFrame(docs, DOCS).withColumn("held", katz.held_out(F.col("doc_id")))
    model, fitted = by_brute_force(docs, 3)[0], katz.fit(df, batch=500, part=60, tables=True)
    for order, table in enumerate(fitted.counts, 1):
        pieces = table.where("batch IS NULL").orderBy("part").collect()
        keys = [k for p in pieces for k in katz.unpack_keys(p["keys"], p.n).tolist()]
        counts = [c for p in pieces for c in katz.unpack_counts(p.counts, p.n).tolist()]
        assert keys == sorted(set(keys))
        begins = [model.begins] if order == 1 else []
        assert sorted(counts) == sorted([*model.c[order].values(), *begins])
    weights = fitted.weights.where("batch IS NULL").collect()
    found = sorted(w for r in weights for w in np.frombuffer(r.weights, np.float64).tolist())
    lines = [["<begin> ", *tokens(t)] for d, t in docs if is_held(d)]
    ends = [(line, i, n) for line in lines for n in (1, 2) for i in range(n, len(line))]
    asked = {tuple(line[i - n : i]) for line, i, n in ends if tuple(line[i - n : i + 1]) not in model.c[n + 1]}
    expected = sorted(model.weight(h) for h in asked if model.after[h])
    assert found == pytest.approx(expected, rel=1e-9)


def test_places_of_keys_that_share_their_high_bits():
    key = np.array([5, 3, 5, 4, 3, 2**63 + 1, 2**63], np.uint64)
    level = katz._level(key, np.array([True] * 6 + [False]))
    assert level.keys.tolist() == [3, 4, 5, 2**63 + 1] and level.gram.tolist() == [2, 0, 2, 1, 0, 3, -1]


def test_tables_without_training_texts_or_rows(spark):
    held = next(i for i in range(100) if is_held(i))
    got = katz.score_texts(spark.createDataFrame([(held, "a b")], DOCS)).collect()
    assert [tuple(r)[:5] for r in got] == [(held, True, 3, 0, 0)] and got[0].score == 0
    assert katz.score_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(katz, "PIECE", 64)
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("ab  \n\té") for _ in range(rng.choice([5, 2000])))) for i in range(30)]
    for text in ["", " ", "a", *[t for _, t in docs]]:
        hashes, start = katz.hashed_words(text.encode())
        assert len(hashes) == len(tokens(text)) - 1 and len(set(hashes.tolist())) == len(set(tokens(text)[:-1]))
        assert [text.encode()[s:].split()[0] for s in start] == [w.encode() for w in tokens(text)[:-1]]
    same(katz.score_texts(spark.createDataFrame(docs, DOCS)).collect(), by_brute_force(docs, 3)[1])


def test_discounts_lie_between_nothing_and_all():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 12, 8, 5], [1, 50, 2, 7, 0, 9], [0, 3, 3, 3, 3, 3]):
        assert all(0 < x < 1 for x in katz.Discount.of(n).ratios)
