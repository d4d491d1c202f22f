"""Toxicity of whole texts after noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that mix letters with digits or
signs, repeat a letter, or are spelled out letter by letter become lattices of what each
character may stand for, and the best path under the model restores them. Words of the text and
restored words then give features (word beginnings and whole words). A logistic model over them,
with weights of at least 0 and a penalty on their sum, is learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, spent, stored, take, texts_of

SYMBOLS = 28  # boundary, a-z, any other letter
OTHER = 27
FIT_ROWS = 20_000  # labelled rows the features are learned from, at most about so many
FIT_TASKS = 64  # tasks that restore those rows
FEATURES = 5_000  # features a model chooses from at most, strongest first
PENALTY = 0.75  # of a weight of 1; a mark of n documents, all toxic, gives 1 - PENALTY / n, so that one document is too few
STEPS = 1_000  # of the fit at most
PREFIXES = (4, 5, 6)
FOLDS = 5

# what a sign may stand for
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SIGNS = frozenset(STANDS_FOR)
SEPARATORS = " .-_*~"
CACHED, CACHED_CHARS = 100_000, 64  # spans a task remembers, and their greatest length
REPEAT_COST, SIGN_COST, JOIN_COST, BREAK_COST = 0.6, 1.0, 0.3, 8.0
WORD = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1|(.)\2\2")  # a letter twice, or anything three times
# letters or signs for them, each once or repeated, with separators between
_ONE = r"(?:[^\W\d_]|[" + "".join(map(re.escape, STANDS_FOR)) + "])"
SPELLED = re.compile(rf"(?<!\S)(?:({_ONE})\1*[ .\-_*~]+){{2,}}({_ONE})\2*(?![^\W\d_])")
EDGE = "\"'.,;:?!()[]{}<>#%&*$|~-_=+/\\"


_CODE = np.full(256, 0, dtype=np.int64)
_CODE[65:91] = np.arange(1, 27)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = OTHER


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts, as a table of SYMBOLS**3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, texts in texts_of(batch):
                code = _CODE[np.frombuffer("\n".join(["", *(t or "" for t in texts), ""]).encode(), dtype=np.uint8)]
                code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]
                code = np.repeat(code, 1 + (code == 0))  # a boundary counts as two symbols
                if len(code) > 2:
                    total += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = map_arrow(take(docs, "text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SYMBOLS**3)
    table[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return table


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with bigrams and a uniform part."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(axis=0)
    p_bi = (bi + 1.0) / (bi.sum(axis=1, keepdims=True) + SYMBOLS)
    p_tri = (tri + 5.0 * p_bi[None]) / (tri.sum(axis=2, keepdims=True) + 5.0)
    return -np.log(0.9 * p_tri + 0.1 / SYMBOLS)


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def _options(c: str, before: str) -> list[tuple[str, float]]:
    """(what is written, cost) for an observed character; '' for nothing, ' ' for a boundary."""
    if c in STANDS_FOR:
        found = [(x, SIGN_COST) for x in STANDS_FOR[c]] + [(" ", BREAK_COST)]
    elif c.isalpha():
        found = [(c, 0.0)]
    elif c in SEPARATORS:
        return [("", JOIN_COST), (" ", BREAK_COST)]
    else:
        return [("", BREAK_COST), (" ", JOIN_COST)]
    return [*found, ("", REPEAT_COST)] if c == before else found


def restore(span: str, costs: np.ndarray) -> list[str]:
    """Words of the cheapest path through the lattice of `span` (lower case)."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in span:
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in paths.items():
            for written, extra in _options(c, before):
                if not written:
                    key, value = (a, b), (cost + extra, path)
                elif written == " ":
                    key, value = (0, 0), (cost + extra + (costs[a, b, 0] if b else 0.0), (path, written))
                else:
                    # the letter before once more, whatever it is written with
                    if path and path[1] == written and (key := (a, b)) and (key not in step or cost + REPEAT_COST < step[key][0]):
                        step[key] = (cost + REPEAT_COST, path)
                    s = _symbol(written)
                    key, value = (b, s), (cost + extra + costs[a, b, s], (path, written))
                if key not in step or value[0] < step[key][0]:
                    step[key] = value
        paths, before = step, c
    best = min(((cost + (costs[a, b, 0] if b else 0.0), path) for (a, b), (cost, path) in paths.items()), key=lambda x: x[0])[1]
    letters = []
    while best:
        best, c = best
        letters.append(c)
    return "".join(reversed(letters)).split()


class Restorer:
    """Restores the suspicious spans of texts under one character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known = lru_cache(CACHED)(self._span)

    def _span(self, span: str) -> tuple[str, ...]:
        return tuple(restore(span, self.costs))

    def span(self, span: str) -> tuple[str, ...]:
        """Restored words of a span."""
        return self.known(span) if len(span) <= CACHED_CHARS else self._span(span)

    def token(self, token: str) -> list[str]:
        """Words of a token that holds more than letters, as they stand and restored."""
        core = token.strip(EDGE)
        if core.isalpha():
            found = [core]
            # signs at the edge of a token may be letters as well
            if not SIGNS.isdisjoint(token):
                found += self.span(token)
        else:
            found = WORD.findall(token)
            if any(map(str.isalpha, core)):
                found += self.span(core)
        if REPEATED.search(token):
            found += self.span(token)
        return found

    def parts(self, text: str) -> tuple[set[str], set[str]]:
        """Tokens of a text that are words, and the words, as they stand and restored, of all else."""
        low = text.lower()
        tokens = set(low.split())
        plain = {t for t in tokens if t.isalpha()}
        others: set[str] = set()
        for token in tokens - plain:
            others.update(self.token(token))
        for token in filter(REPEATED.search, plain):
            others.update(self.span(token))
        for m in SPELLED.finditer(low):
            if any(map(str.isalpha, m.group())):
                others.update(self.span(m.group()))
        return plain, others

    def words(self, text: str) -> set[str]:
        plain, others = self.parts(text)
        return plain | others


def features(words: set[str]) -> set[str]:
    """Beginnings of words ('^abcd') and whole words ('abcd')."""
    out = set(words)
    for k in PREFIXES:
        out.update("^" + w[:k] for w in words if len(w) >= k)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Costs of the character model, log-odds by feature and without any feature."""

    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf


class Scorer:
    """Scores texts by a model."""

    def __init__(self, model: ToxicityModel):
        self.model, self.restorer = model, Restorer(model.costs)
        # most words begin like no feature
        self.heads = {feature.removeprefix("^")[: PREFIXES[0]] for feature in model.weights}

    def score(self, text: str | None) -> float:
        """Chance that a text with these features is toxic."""
        heads, k, found = self.heads, PREFIXES[0], set()
        for words in self.restorer.parts(text or ""):
            found.update(w for w in words if w[:k] in heads)
        weights = self.model.weights
        # fsum: the same sum on every worker
        odds = self.model.bias + math.fsum(weights[f] for f in features(found) if f in weights)
        return 1.0 / (1.0 + math.exp(-odds)) if odds > -700 else 0.0


def fit_weights(rows: list[list[int]], toxic: np.ndarray, times: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Bias and `size` weights of at least 0 with the least log loss plus PENALTY times their sum.

    Row i has the features `rows[i]` and counts `times[i]` times. Accelerated proximal steps, each
    feature with its own step length, started anew where they lead uphill.
    """
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), lens)
    col = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=int(lens.sum()))
    bound = 0.25 * times * (lens + 1.0)  # of the curvature
    curve = np.append(np.maximum(np.bincount(col, weights=bound[at], minlength=size), 1e-9), bound.sum())
    rate = (times * toxic).sum() / times.sum()
    x = np.append(np.zeros(size), math.log(rate / (1 - rate)))
    penalty = np.append(np.full(size, PENALTY), 0.0)
    least = np.append(np.zeros(size), -math.inf)
    y, t = x, 1.0
    for _ in range(STEPS):
        odds = y[-1] + np.bincount(at, weights=y[col], minlength=len(rows))
        slope = times * (1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700))) - toxic)
        gradient = np.append(np.bincount(col, weights=slope[at], minlength=size), slope.sum()) + penalty
        new = np.maximum(y - gradient / curve, least)
        if np.dot(curve * (y - new), new - x) > 0:
            t, y = 1.0, new
        else:
            after = (1 + math.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / after * (new - x), after
        moved, x = np.abs(new - x).max(), new
        if moved < 1e-7:
            break
    return float(x[-1]), x[:-1]


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents that are not held out, at most.

    Equal texts count once, as toxic if one of them is.
    """
    marked = take(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = rows / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `rows` rows whatever the data
    found = take(docs, "doc_id", "text").join(F.broadcast(marked), "doc_id")
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Character model over all documents; features from at most about `rows` labelled ones.

    No feature needs a fixed number of documents: of those over-represented in toxic documents the
    FEATURES furthest from chance enter, and the fit weighs them.
    """
    costs = trigram_costs(trigram_counts(docs))
    sample = labelled_sample(docs, labels, rows)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            for begin, texts in texts_of(batch):
                found = pa.array([sorted(features(restorer.words(t or ""))) for t in texts], pa.list_(pa.string()))
                labels_ = batch.column("toxic").slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([found, labels_], names=["found", "toxic"])

    # restored once, in tasks of a few hundred rows at most
    sample = map_arrow(sample.repartition(FIT_TASKS), restored, "found array<string>, toxic int")
    sample = stored(sample, "toxicity-sample")
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not total["n"] or total["toxic"] in (0, total["n"]):
        spent(sample)
        return ToxicityModel(costs, {}, math.inf if total["toxic"] else -math.inf)
    rate = total["toxic"] / total["n"]
    counted = sample.select(F.explode("found").alias("feature"), "toxic").groupBy("feature")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    z = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    marks = counted.where("feature <> ''").select("feature", z.alias("z")).where("z > 0")
    names = [r["feature"] for r in marks.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    place = {name: k for k, name in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[f] for f in row if f in place) for row in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], names=["found", "toxic"])

    seen = map_arrow(sample, present, "found array<int>, toxic int").groupBy("found", "toxic").agg(F.count("*").alias("n"))
    seen = sorted((r["found"], r["toxic"], r["n"]) for r in seen.collect())  # the same order in every run
    spent(sample)
    rows_, toxic, times = ([r[k] for r in seen] for k in range(3))
    bias, weights = fit_weights(rows_, np.array(toxic, dtype=np.float64), np.array(times, dtype=np.float64), len(names))
    return ToxicityModel(costs, {n: w for n, w in zip(names, weights.tolist()) if w > 0}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    A null or empty text scores as a text without marking words. A null id is kept and not held
    out. Only `doc_id` and `text` are read.
    """
    docs = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for _, texts in texts_of(batch) for t in texts]
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"])

    scored = map_arrow(docs, run, "doc_id long, score double")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.score(t) < 0.5 for _, texts in texts_of(batch, text) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(plain, run, plain.schema).toDF(*names)
