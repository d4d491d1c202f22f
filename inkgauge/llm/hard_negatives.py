"""Hard negatives by exact integer products, several candidates multiplied at once.

Kronecker packing: the integer components of several candidates, made non-negative by a bias, lie in
separated fields of one wide integer. One multiplication by an anchor's component serves all of them,
and the sum over components holds every candidate's product in its own field. A field is wide enough
for any product that the data can give, so the unpacked scores are exact. While a field needs at most
32 bits the wide integer is a machine word of 64 bits; beyond, a Python integer of any width.

The anchors are a stated query set: blocks of anchors meet blocks of candidates, and only an anchor's
best few of each block go on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, stored, take

SCALE = 256  # components are floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
BLOCK = 8192  # candidates of a block, about
ANCHORS = 1024  # anchors of a block, about
TILE = 32  # anchors multiplied at once
WIDE = 16  # fields of a wide integer that is no machine word
LONG = 1 << 63


@dataclass(frozen=True)
class Layout:
    """Where the fields of a wide integer lie: `bias` is added to components, `half` to sums."""

    bits: int
    fields: int
    bias: int
    word: bool

    @property
    def half(self) -> int:
        return 1 << (self.bits - 1)

    @property
    def kind(self):
        return np.uint64 if self.word else object


def layout(anchor_sum: int, largest: int) -> Layout:
    """`anchor_sum`: largest sum of an anchor's absolute components, `largest`: of a candidate's components."""
    bits = (max(anchor_sum, 1) * 2 * max(largest, 1)).bit_length() + 1
    word = bits <= 32
    return Layout(bits, 64 // bits if word else WIDE, max(largest, 1), word)


def pack(components: np.ndarray, at: Layout) -> np.ndarray:
    """(components, words): `fields` candidates in each wide integer."""
    n, d = components.shape
    words = -(-n // at.fields)
    padded = np.zeros((words * at.fields, d), dtype=components.dtype)
    padded[:n] = components
    biased = (padded + at.bias).astype(at.kind).reshape(words, at.fields, d)
    out = np.zeros((d, words), dtype=at.kind)
    for f in range(at.fields):
        out += (biased[:, f] << at.kind(f * at.bits) if at.word else biased[:, f] * (1 << f * at.bits)).T
    return out


def products(anchors: np.ndarray, packed: np.ndarray, n: int, at: Layout) -> np.ndarray:
    """(anchors, n): exact inner products, one multiplication per anchor component and wide integer."""
    start = sum(at.half << f * at.bits for f in range(at.fields))
    total = np.full((len(anchors), packed.shape[1]), start, dtype=at.kind)
    factors = anchors.astype(np.int64).view(np.uint64) if at.word else anchors  # modulo 2^64 a sum keeps its fields
    for i in range(packed.shape[0]):
        total += factors[:, i, None] * packed[i]
    mask = (1 << at.bits) - 1
    out = np.empty((len(anchors), packed.shape[1], at.fields), dtype=np.int64 if at.word else object)
    for f in range(at.fields):
        if at.word:
            out[:, :, f] = ((total >> np.uint64(f * at.bits)) & np.uint64(mask)).astype(np.int64)
        else:
            out[:, :, f] = (total >> f * at.bits) & mask
    lifted = at.half + at.bias * anchors.sum(axis=1)
    return out.reshape(len(anchors), -1)[:, :n] - lifted[:, None]


def components(vectors: list, d: int, word: bool) -> np.ndarray:
    """floor(SCALE * x), missing components of shorter vectors 0; Python integers where words are too short."""
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * SCALE)
    if word:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, `label` shifted for every seventh id, one row per id."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = take(vectors, "vec_id", "label", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    one = rows.withColumn("label", moved).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def _plan(rows: DataFrame, every: int) -> tuple[Layout, int, int, int]:
    """Layout, dimension, number of rows and of anchors."""
    whole = F.transform("v", lambda x: F.abs(F.floor(F.lit(float(SCALE)) * x).cast("double")) + 1)
    size, anchor = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x), F.col("vec_id") % every == 0
    got = rows.agg(
        F.max(F.when(anchor, size)).alias("sum"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest"),
        F.max(F.array_max(F.transform("v", lambda x: F.when(F.abs(x) > 2.0**40, F.abs(x))))).alias("huge"),
        F.max(F.size("v")).alias("d"),
        F.count("*").alias("n"),
        F.count(F.when(anchor, 1)).alias("anchors"),
    ).first()
    largest = int((got["largest"] or 0.0) * SCALE) + 1
    most = int(got["sum"] or 0.0) if got["huge"] is None else (got["d"] or 1) * largest
    return layout(most, largest), max(got["d"] or 0, 1), got["n"], got["anchors"]


def candidate_blocks(rows: DataFrame, at: Layout, d: int, blocks: int) -> DataFrame:
    """(block, ids, labels, packed): rows by label, so that one label's rows share wide integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            own = batch.column("block").to_numpy()
            for b in np.unique(own):
                parts.setdefault(int(b), []).append(batch.filter(pa.array(own == b)))
        for b, found in parts.items():
            t = pa.Table.from_batches(found)
            ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
            by = np.lexsort((ids, labels))
            values = components(t.column("v").to_pylist(), d, at.word)[by]
            blob = pickle.dumps((ids[by], labels[by], pack(values, at)))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["block", "packed"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return stored(map_arrow(dealt.repartition(blocks, "block"), run, "block int, packed binary"), "packed")


def _meet(asked: DataFrame, packed: DataFrame, blocks: int, n: int, run, schema: str) -> DataFrame:
    """Blocks of about ANCHORS rows of `asked` with every candidate block."""
    groups = max(1, -(-n // ANCHORS))
    rows = F.collect_list(F.struct(*asked.columns)).alias("asked")
    dealt = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("g")).agg(rows)
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return map_arrow(dealt.join(packed.hint("shuffle_hash"), "block").select("asked", "packed"), run, schema)


def _each(batches: Iterator[pa.RecordBatch], at: Layout, d: int):
    """(anchors as a table of columns, their components, ids, labels, packed) of every meeting."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked = batch.column("asked")[i].values
            columns = {f.name: asked.field(j) for j, f in enumerate(asked.type)}
            values = components(columns.pop("v").to_pylist(), d, at.word)
            yield columns, values, *pickle.loads(batch.column("packed")[i].as_py())


def _longs(values: list) -> pa.Array:
    if any(not -LONG <= x < LONG for x in values):
        raise OverflowError("components so large that a score leaves 64 bits")
    return pa.array([int(x) for x in values], pa.int64())


def positives(rows: DataFrame, packed: DataFrame, at: Layout, d: int, blocks: int, n: int, every: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, values, ids, labels, words in _each(batches, at, d):
            names, own = columns["vec_id"].to_numpy(), columns["label"].to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for label in np.unique(own):
                lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
                first = lo // at.fields
                for rows_ in np.array_split(np.flatnonzero(own == label), -(-int((own == label).sum()) // TILE)):
                    part = words[:, first : -(-hi // at.fields)]
                    score = products(values[rows_], part, part.shape[1] * at.fields, at)
                    score = score[:, lo - first * at.fields : hi - first * at.fields]
                    for r, s in zip(rows_, score):
                        for j in _first(s, ids[lo:hi], POSITIVES + 1):
                            if ids[lo + j] != names[r]:
                                out[0].append(int(names[r])), out[1].append(int(ids[lo + j])), out[2].append(s[j])
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _longs(out[2])]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "positive_id", "positive_score"])

    asked = rows.where(F.col("vec_id") % every == 0)
    found = _meet(asked, packed, blocks, n, run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= POSITIVES).drop("_r")


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(scores) > 4 * k and scores.dtype != object:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= limit)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)


def mine(vectors: DataFrame, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. Rows without an id or label and vectors
    that are null or hold null or non-finite components take no part; of rows that repeat an id the
    one with the smallest label, then vector, counts. Shorter vectors are filled up with zeros, an
    empty one has score 0 with all. Ties go to the smaller id. An anchor without positives or a
    positive without negatives in its range gives no row. Scores outside 64 bits raise an
    OverflowError. Only `vec_id`, `label` and `embedding` are read.
    """
    rows = stored(usable(vectors), "vectors")
    at, d, n, anchors = _plan(rows, every)
    blocks = max(1, -(-n // BLOCK))
    packed = candidate_blocks(rows, at, d, blocks)
    best = positives(rows, packed, at, d, blocks, anchors, every)
    kept = F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id"))).alias("pos")
    asked = rows.where(F.col("vec_id") % every == 0).join(best.groupBy(F.col("anchor_id").alias("vec_id")).agg(kept), "vec_id")
    names_ = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, values, ids, labels, words in _each(batches, at, d):
            names, own, pos = columns["vec_id"].to_numpy(), columns["label"].to_numpy(), columns["pos"].to_pylist()
            out: list[tuple] = []
            for lo in range(0, len(names), TILE):
                tile = range(lo, min(lo + TILE, len(names)))
                score = products(values[tile.start : tile.stop], words, len(ids), at)
                for r, s in zip(tile, score):
                    other = np.flatnonzero(labels != own[r])
                    for p in pos[r]:
                        # 50 p <= 100 s <= 95 p, bounds rounded to integers
                        low, high = -(-LOW * p["score"] // 100), HIGH * p["score"] // 100
                        fit = other[(s[other] >= low) & (s[other] <= high)] if low <= high else other[:0]
                        for j in _first(s[fit], ids[fit], NEGATIVES):
                            out.append((int(names[r]), p["id"], int(ids[fit[j]]), p["score"], s[fit[j]]))
            arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
            arrays.append(_longs([o[4] for o in out]))
            yield pa.RecordBatch.from_arrays(arrays, names=names_)

    found = _meet(asked, packed, blocks, anchors, run, ", ".join(f"{c} long" for c in names_))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), *names_[2:])
