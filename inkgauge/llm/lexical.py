"""Ranked lexical search with posting lists in blocks of similar documents.

Documents are dealt to shards of bounded size, each an inverted index of its own. The posting list of
a term is clustered by the similarity of its documents (random projections of their impacts, nearest of
evenly spread members), and every block keeps the coordinatewise maximum of its documents' impacts.
A block is skipped only if the product of query and summary, an exact upper bound, is below the score
that the k-th best document has already.

Terms are numbered from the rarest on. A document is looked for in the lists of its query terms in that
order, so a summary holds the coordinates from its own term on: documents with a rarer query term were
met, or ruled out by a bound, in that term's list. Once all remaining terms together can't reach the
k-th score, no further list is opened, and blocks of lists that no query opens are never made.

Items are queries: their terms go to every task, in groups of about GROUP_BYTES of item text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, spent, stored, take

K = 20
GROUP_BYTES = 4 << 20  # item text whose terms are searched at once
POSTINGS = 1 << 20  # postings of a shard, about
BLOCK = 64  # documents of a block, about
DIMENSIONS = 16  # of the space in which documents are compared
DENSE = 1 << 22  # cells in which summaries are made at once
# on UTF-8 bytes: every byte of a character beyond ASCII belongs to a term
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes, A-Z only


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges start .. start + size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Blocks:
    """Blocks of one posting list: documents, and the summaries as sparse rows."""

    documents: np.ndarray
    bounds: np.ndarray  # of `documents` by block
    terms: np.ndarray
    most: np.ndarray
    rows: np.ndarray  # of `terms` by block


@dataclass
class Shard:
    """Impacts of documents by term, as sparse rows; terms ascend within a row."""

    start: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    weights: np.ndarray
    made: dict[int, Blocks] = field(default_factory=dict)
    opened: Counter = field(default_factory=Counter)  # blocks by what happened to them

    def __post_init__(self):
        self.owner = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        by = np.argsort(self.terms, kind="stable")
        self.postings = by  # places by term
        self.lists = np.searchsorted(self.terms[by], np.arange(len(self.weights) + 1))
        self.highest = np.zeros(len(self.weights), np.int64)
        np.maximum.at(self.highest, self.terms, self.impacts)
        plane = np.random.default_rng(1).standard_normal((len(self.weights), DIMENSIONS)).astype(np.float32)
        value = (self.impacts * self.weights[self.terms]).astype(np.float32)
        point = np.add.reduceat(plane[self.terms] * value[:, None], self.start[:-1], axis=0)
        self.points = point / np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-30)

    def blocks(self, term: int) -> Blocks:
        if term not in self.made:
            self.made[term] = self._make(term)
        return self.made[term]

    def _make(self, term: int) -> Blocks:
        places = self.postings[self.lists[term] : self.lists[term + 1]]
        documents, n = self.owner[places], len(places)
        centres = -(-n // BLOCK)
        near = np.zeros(n, np.int64)
        if centres > 1:
            middle = self.points[documents[np.arange(centres) * n // centres]]
            for lo in range(0, n, 1 << 14):
                near[lo : lo + (1 << 14)] = (self.points[documents[lo : lo + (1 << 14)]] @ middle.T).argmax(axis=1)
        by = np.argsort(near, kind="stable")
        places, documents, near = places[by], documents[by], near[by]
        first = np.searchsorted(near, near)  # a larger cluster is cut into several blocks
        cut = np.flatnonzero(np.r_[True, near[1:] != near[:-1]] | ((np.arange(n) - first) % (2 * BLOCK) == 0))
        bounds = np.r_[cut, n]
        # summaries: the coordinates of each document from this term on
        width, own = len(self.weights) - term, np.repeat(np.arange(len(cut)), np.diff(bounds))
        sizes = self.start[documents + 1] - places
        cells = np.maximum(np.cumsum(sizes)[bounds[1:] - 1], width * np.arange(1, len(cut) + 1))
        found: list[tuple] = []
        lo = 0
        while lo < len(cut):
            before = cells[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cells, before + DENSE, side="right")))
            at = slice(bounds[lo], bounds[hi])
            entry = expand(places[at], sizes[at])
            table = np.zeros((hi - lo) * width, np.int64)
            np.maximum.at(table, np.repeat(own[at] - lo, sizes[at]) * width + self.terms[entry] - term, self.impacts[entry])
            full = np.flatnonzero(table)
            found.append((full // width + lo, (full % width + term).astype(np.int32), table[full].astype(np.int32)))
            lo = hi
        block, terms, most = (np.concatenate(x) for x in zip(*found))
        return Blocks(documents, bounds, terms, most, np.searchsorted(block, np.arange(len(cut) + 1)))

    def search(self, terms: np.ndarray, times: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best, equal scores by `ids`; terms ascend."""
        query = np.zeros(len(self.weights), np.int64)
        query[terms] = self.weights[terms] * times
        rest = np.cumsum((query[terms] * self.highest[terms])[::-1])[::-1]
        seen = np.zeros(len(self.start) - 1, bool)
        best, holders, limit = np.empty(0, np.int64), np.empty(0, np.int64), 1
        for i, (t, most) in enumerate(zip(terms.tolist(), rest.tolist())):
            if most < limit:  # equal scores may still win by their id
                left = self.lists[terms[i:] + 1] - self.lists[terms[i:]]
                self.opened["closed"] += int((-(-left // BLOCK)).sum())
                break
            if not self.highest[t]:
                continue
            b = self.blocks(t)
            bound = np.add.reduceat(query[b.terms] * b.most, b.rows[:-1])
            order = np.argsort(-bound, kind="stable")
            at, step = 0, 1
            while at < len(order):
                chosen = order[at : at + step]
                chosen = chosen[bound[chosen] >= limit]
                if not len(chosen):
                    break
                at, step = at + len(chosen), step * 2
                documents = b.documents[expand(b.bounds[chosen], b.bounds[chosen + 1] - b.bounds[chosen])]
                documents = documents[~seen[documents]]
                seen[documents] = True
                if not len(documents):
                    continue
                sizes = self.start[documents + 1] - self.start[documents]
                entry = expand(self.start[documents], sizes)
                score = np.add.reduceat(query[self.terms[entry]] * self.impacts[entry], np.cumsum(sizes) - sizes)
                score, documents = np.r_[best, score], np.r_[holders, documents]
                some = np.flatnonzero(score >= limit)
                some = some[np.lexsort((ids[documents[some]], -score[some]))[:k]]
                best, holders = score[some], documents[some]
                if len(best) == k:
                    limit = max(limit, int(best[-1]))
            self.opened["visited"] += at
            self.opened["skipped"] += len(order) - at
        return list(zip(best.tolist(), holders.tolist()))


def document_vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term: all its terms counted, those in `numbers` listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            ids, n, terms, times = [], [], [], []
            for i in range(len(texts)):
                words = terms_of(texts[i].as_py() or b"")
                if words:
                    found = Counter(map(numbers.get, words))
                    found.pop(None, None)
                    ids.append(batch.column("doc_id")[i].as_py()), n.append(len(words))
                    terms.append(list(found)), times.append(list(found.values()))
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "times"])

    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, n long, terms array<int>, times array<long>")


def shards_of(batches: Iterator[pa.RecordBatch], rank: np.ndarray, weights: np.ndarray, documents: int, words: int, postings: int):
    """(Shard, ids) of every about `postings` postings; `rank` numbers the terms from the rarest on."""
    held: list[pa.RecordBatch] = []
    size = 0

    def make():
        table = pa.Table.from_batches(held).combine_chunks()
        counts = pc.list_value_length(table.column("terms")).to_numpy()
        table, counts = table.filter(pa.array(counts > 0)), counts[counts > 0]
        start = np.r_[0, np.cumsum(counts)].astype(np.int64)
        terms = rank[pc.list_flatten(table.column("terms")).to_numpy()]
        times = pc.list_flatten(table.column("times")).to_numpy()
        m = 75 + 25 * table.column("n").to_numpy() * documents // words
        owner = np.repeat(np.arange(len(counts)), counts)
        by = np.lexsort((terms, owner))
        terms, times = terms[by], times[by]
        impacts = 1_000_000_000 * times // (1000 * times + 12 * m[owner])
        return Shard(start, terms, impacts, weights), table.column("doc_id").to_pylist()

    for batch in batches:
        lengths = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            before = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, before + postings - size, side="right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(lengths[hi - 1] - before)
            lo = hi
            if size >= postings:
                yield make()
                held, size = [], 0
    if size:
        yield make()


def search_group(docs: DataFrame, items: list[tuple[int, bytes]], k: int, postings: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's best documents of each item."""
    numbers: dict[bytes, int] = {}
    queries = [(i, Counter(numbers.setdefault(w, len(numbers)) for w in terms_of(t))) for i, t in items]
    vectors = stored(document_vectors(docs, numbers), "vectors")
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.sum(F.size("terms")).alias("postings")).first()
    documents, words = total["n"], total["words"]
    # at most one row per term of the group
    holding = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    df = np.zeros(len(numbers), np.int64)
    for row in holding.collect():
        df[row["t"]] = row["n"]
    weights = np.array([weight(documents, int(n)) for n in df], dtype=np.int64)
    rare = np.argsort(-weights, kind="stable")
    rank = np.empty(len(rare), np.int64)
    rank[rare] = np.arange(len(rare))
    asked = []
    for item, counts in queries:
        terms = np.array(sorted(rank[list(counts)])) if counts else np.empty(0, np.int64)
        asked.append((item, terms, np.array([counts[int(rare[t])] for t in terms], dtype=np.int64)))
    weights = weights[rare]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids in shards_of(batches, rank, weights, documents, words, postings):
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            out: list[tuple] = []
            for item, terms, times in asked:
                out += [(item, ids[d], score) for score, d in shard.search(terms, times, order, k)]
            arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", "score"])

    dealt = vectors.where(F.size("terms") > 0).repartition(max(1, -(-(total["postings"] or 0) // postings)))
    found = stored(map_arrow(dealt, run, "item_id long, doc_id long, score long"), "found")
    spent(vectors)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, postings: int = POSTINGS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of every item with a score above 0.

    Terms, weights and scores are those of the contract in the README. Documents without a term, null
    texts among them, count nowhere. Rows that repeat a document, or only its id, are documents of
    their own; one without an id comes last among equal scores. Items without an id or text find
    nothing; of items that repeat an id the smallest text counts. Only the id and `text` are read.
    """
    asked = take(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    asked = stored(asked.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")), "items")
    groups = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    grouped = asked.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    found = None
    for g in range(groups):
        rows = [(r["item_id"], r["text"].encode()) for r in grouped.where(F.col("g") == g).collect()]
        part = search_group(docs, rows, k, postings)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
