"""Cases that prefilters, gates and cuts of the numbered operators must let through."""

import math
import random
import re._parser as parser
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgauge.llm import common, encoding, licenses, neardup, packing, toxicity
from inkgauge.llm.encoding import WordEncoder, default_path

DOCS = "doc_id long, text string"


# 7


def test_estimate_loses_no_more_than_the_bands():
    for percent, bands, rows in ((75, 36, 4), (60, 36, 4), (75, 20, 5)):
        p, n = percent / 100, bands * rows
        least = math.ceil(neardup.least_estimate(percent, bands, rows) * n)
        lost = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k)) for k in (least, least + 1)]
        assert lost[0] <= (1 - p**rows) ** bands < lost[1]


def test_link_with_a_low_estimate(spark):
    words = "w439 w376 w350 w36 w301 w437 w227 w267"  # 3 of 4 shingles, and 0.611 of the registers equal
    docs = spark.createDataFrame([(1, words.rsplit(" ", 1)[0]), (2, words)], DOCS)
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()} == {(1, 1), (2, 1)}


# 9


def spelled_out(tree):
    """One string per combination of the alternatives and options of a pattern; of a set all, of a repetition least and one more."""
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(c) for kind, x in value for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])])
        elif name == "SUBPATTERN":
            parts.append(spelled_out(value[-1]))
        elif name == "BRANCH":
            parts.append([x for branch in value[1] for x in spelled_out(branch)])
        else:
            assert name == "MAX_REPEAT", name
            parts.append(["".join(x) for n in (value[0], value[0] + 1) for x in product(spelled_out(value[2]), repeat=n)])
    return ["".join(x) for x in product(*parts)]


def test_every_license_name_contains_its_keyword():
    for label, (keyword, name) in licenses.NAMES.items():
        assert [x for x in spelled_out(parser.parse(name)) if keyword not in x] == [], label


def test_license_alternatives_with_and_without_keywords(spark, monkeypatch):
    names = sorted({x for _, name in licenses.NAMES.values() for x in spelled_out(parser.parse(name))})
    docs = spark.createDataFrame([(i, f"this is {x} so") for i, x in enumerate(names)], DOCS)
    scan = lambda: {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    found, rules = scan(), licenses.rules()
    assert [names[i] for i in found if not found[i][0]] == []
    for name, label in (("expat license", "mit"), ("x11 licence", "mit"), ("bsd style license", "bsd")):
        assert found[names.index(name)] == ([label], 0.6)
    monkeypatch.setattr(licenses, "rules", lambda: [(label, " ", *rest) for label, _, *rest in rules])
    assert scan() == found


# 6 and 10


def test_added_tokens_are_one_id():
    own, encoder = Tokenizer.from_file(default_path()), WordEncoder(default_path())
    rng = random.Random(4)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "b's", " ", "  ", "endoftext", "é", "1"]
    texts = ["a <|endoftext|> b", *("".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(2000))]
    for text in texts:
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in own.encode(text, add_special_tokens=False).ids), text
    assert own.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]


# 3


@pytest.mark.parametrize("n, every, marks", [(100, 2, ["grobian", "schuft", "lump", "flegel"]), (60, 10, ["grobian"])])
def test_small_and_balanced_label_tables_give_a_model(spark, n, every, marks):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    docs = [(i, " ".join(rng.choices(words, k=20) + [rng.choice(marks)] * (i % every == 0))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % every == 0)) for i in range(n)], "doc_id long, toxic int")
    d = spark.createDataFrame(docs, DOCS)
    rows = toxicity.score_toxicity(d, toxicity.fit(d, labels)).collect()
    assert [r.doc_id for r in rows if r.predicted != int(r.doc_id % every == 0)] == []


def test_evidence_weighs_in_gradually():
    for n in (2, 5, 50):
        rows, toxic, times = [[0], []], np.array([1.0, 0.0]), np.array([float(n), 1000.0])
        bias, weights = toxicity.fit_weights(rows, toxic, times, 1)
        assert 1 / (1 + math.exp(-bias - weights[0])) == pytest.approx(1 - toxicity.PENALTY / n, abs=1e-3)


# gate of 3


def test_mixed_tricks_reach_the_lattice(spark):
    texts = ["an idiot and a stupid loser said", "the moron is worthless trash", "pathetic scum and a clown"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    restorer = toxicity.Restorer(toxicity.trigram_costs(toxicity.trigram_counts(df)))
    tricks = {
        "i d 1 0 t": "idiot", "m 0 r 0 n": "moron", "1 d i o t": "idiot", "i  d  i  o  t": "idiot", "iiddiioott": "idiot",
        "idiiot": "idiot", "ii dd 1 0 tt": "idiot", "$ c u u m": "scum", "l . 0 . s . e . r": "loser", "m00rr0n": "moron",
        "i1d1i0t": "idiot", "c-l-0-w-n": "clown",
    }
    assert [t for t, word in tricks.items() if word not in restorer.words(f"you {t}, they say")] == []
    assert restorer.words("1 2 3 4 5") == set()


def test_encoder_with_a_full_table(monkeypatch):
    own, rng = Tokenizer.from_file(default_path()), random.Random(6)
    monkeypatch.setattr(encoding, "KEPT_CHUNKS", 20)
    encoder = WordEncoder(default_path())
    pool = ["house", "House,", "don't", "'s'", "x1y2", "été", "STRASSE", "ſo", "...", "a-b", "€5", "œuvre", "andthesering", "\t", "\x0b", "\n"]
    texts = [" ".join(rng.choice(pool) + rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    for text in texts:
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in own.encode(text, add_special_tokens=False).ids), text
    assert 0 < len(encoder.known) <= 20


# memory of a task that packs


def test_batches_are_bounded_while_a_table_is_stored(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("a"), 10_000).alias("text"))
    bounded = common.stored(docs.mapInArrow(sizes, "n long"), "sizes", 1 << 20).collect()
    assert sum(r.n for r in bounded) == 900 and max(r.n for r in bounded) < 200
    assert spark.conf.get(common.BATCH_BYTES, None) is None
    assert packing.BATCH_BYTES <= 8 << 20
