"""Near-duplicate groups by HyperMinHash registers, banding and verification on full sets.

A register keeps the number of leading zeros and the next mantissa bits of the smallest hash in
its bucket; each bucket hashes the whole set under its own function, so that short texts leave no
bucket empty. Bands of registers bring candidates together, the collision-corrected Jaccard
estimate drops most that are not alike, and the rest is verified on the full shingle sets.

Texts with equal sets are one class and enter once. In a band the class with the most company is
the centre and is paired with the others, never all with all; where verified links leave a band in
several components, the pairs between different components that the estimate allows follow, drawn
from blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, matching, stored, take, text_key
from inkgauge.llm.components import components
from inkgauge.llm.shingles import WIDTH, mix, shingle_sets
from inkgauge.llm.suffixes import _flat

PERCENT = 75  # of the union that two sets share at least
BANDS = 36
ROWS = 4  # registers of a band; a link at the threshold is missed with probability 1e-6
MANTISSA = 10
BLOCK = 512
SEED = 20261201


def _factors(n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, size=(n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(documents, n) registers of non-empty sets: 6 bits of leading zeros, MANTISSA bits after the first one."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), dtype=np.uint16)
    for j, (factor, shift) in enumerate(_factors(n)):
        least = np.minimum.reduceat((flat ^ shift) * factor, starts)
        fraction, exponent = np.frexp(least.astype(np.float64))
        mantissa = np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).clip(0).astype(np.uint16)
        out[:, j] = ((64 - exponent).clip(0, 63).astype(np.uint16) << MANTISSA) | mantissa
    return out


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the registers that are equal by chance.

    Two different minima fall into one cell of relative width 2**-MANTISSA with the probability
    n_a n_b / (n_a + n_b)**2 / (2 ln 2) / 2**MANTISSA.
    """
    a, b = n_a.astype(np.float64), n_b.astype(np.float64)
    chance = a * b / (a + b) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int, bands: int, rows: int) -> float:
    """The estimate a pair needs: one at the threshold falls below it no more often than the bands miss it.

    With k of n registers equal the estimate is at least (k - 1/2) / n, whatever the chance taken off.
    """
    p, n = percent / 100, bands * rows
    missed = (1 - p**rows) ** bands
    below, k = 0.0, 0
    while k < n:
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > missed:
            break
        k += 1
    return (k - 0.5) / n


def sketch(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc_id, text_key, n, class, registers): `class` is a digest of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _flat(batch, "bytes")
            for lo in range(0, len(bounds) - 1, 256):
                cut = bounds[lo : lo + 257]
                sets = shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], width)
                some = [i for i, s in enumerate(sets) if len(s)]
                found = registers([sets[i] for i in some], bands * rows) if some else []
                packed = dict(zip(some, (r.tobytes() for r in found)))
                part = batch.slice(lo, len(sets))
                columns = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([packed.get(i) for i in range(len(sets))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "class", "registers"])

    return map_arrow(docs, run, "doc_id long, text_key long, n long, class binary, registers binary")


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, number, class): one row per band of registers; `band` tells contents and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = _flat(batch, "registers")
            table = data.view(np.uint16).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            code = np.full(table.shape[:2], 1, dtype=np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
            for j in range(rows):
                code = mix(code * np.uint64(1 << 16) + table[:, :, j])
            names = batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            number = pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows))
            columns = [pa.array(code.ravel().view(np.int64)), number, names]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "number", "class"])

    return map_arrow(classes.select("class", "registers"), run, "band long, number int, class binary")


def _alike(pairs: DataFrame, classes: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate allow a link."""
    least = least_estimate(percent, bands, rows)
    right = classes.select("class", "n", "registers")
    for side in ("a", "b"):
        named = right.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}"))
        pairs = pairs.join(named, side)
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_flat(batch, c)[0].view(np.uint16).reshape(batch.num_rows, -1) for c in ("r_a", "r_b"))
                value = estimate((a == b).mean(axis=1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                keep = pa.array(value >= least)
                yield batch.select(["a", "b"]).filter(keep)

    return map_arrow(pairs.where(near).select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a binary, b binary")


def texts_of_classes(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(class, bytes): the text of the first document of each class in `needed`."""
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("_i"), F.col("text_key").alias("_k"), "bytes")
    first = classes.join(needed.distinct(), "class")
    first = first.select("class", F.coalesce("doc_id", F.lit(-1)).alias("_i"), F.col("text_key").alias("_k"))
    return stored(texts.join(first, ["_i", "_k"]).groupBy("class").agg(F.first("bytes").alias("bytes")), "texts")


def linked(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * shared >= percent * (len(own) + len(other) - shared)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs of classes that are linked on their full sets."""
    pairs = stored(pairs, "candidates")
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    texts = texts_of_classes(docs, classes, needed)
    both = pairs.join(texts.select(F.col("class").alias("b"), F.col("bytes").alias("t_b")), "b")
    both = both.join(texts.select(F.col("class").alias("a"), F.col("bytes").alias("t_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in batches:
            keep = []
            for a, t_a, t_b in zip(batch.column("a"), batch.column("t_a"), batch.column("t_b")):
                if a.as_py() != name:
                    name, own = a.as_py(), _set(t_a, width)
                keep.append(linked(own, _set(t_b, width), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "t_a", "t_b"), run, "a binary, b binary")


def _set(text: pa.Scalar, width: int) -> np.ndarray:
    data = np.frombuffer(text.as_py(), dtype=np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), width)[0]


def _cross_links(members: DataFrame, percent: int, bands: int, rows: int, width: int) -> DataFrame:
    """Links that join different components meeting in a band.

    `members` has (band, number, i, j, block, class, component, n, registers, bytes); a group (band,
    i, j) holds two blocks of bounded size, or one if i = j. A pair is looked at in the first band
    it shares only. Of the links of a group as many are given as it takes to join its members.
    """
    least = least_estimate(percent, bands, rows)

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        table = group.combine_chunks().to_batches()[0]
        sig = _flat(table, "registers")[0].view(np.uint16).reshape(table.num_rows, bands, -1)
        n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        root = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
        names, texts, number = table.column("class"), table.column("bytes"), table.column("number")[0].as_py()
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sets: dict[int, np.ndarray] = {}

        def full(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = _set(texts[row], width)
            return sets[row]

        a, b = [], []
        for k in range(table.num_rows - 1):
            other = np.arange(k + 1, table.num_rows)
            size = (100 * np.minimum(n[other], n[k])) >= percent * np.maximum(n[other], n[k])
            other = other[size & (root[other] != root[k]) & (one | (block[other] != block[k]))]
            if not len(other):
                continue
            equal = sig[other] == sig[k]
            value = estimate(equal.mean(axis=(1, 2)), n[other], np.full(len(other), n[k]))
            here = equal.all(axis=2).argmax(axis=1) == number
            allowed = here & (value >= least)
            for row in other[allowed][np.argsort(-value[allowed], kind="stable")].tolist():
                if root[row] != root[k] and linked(full(k), full(row), percent):
                    root[root == root[row]] = root[k]
                    a.append(k)
                    b.append(row)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
            if not len(key):
                continue
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                group = tuple(key[lo])
                if group != last and kept:
                    yield from links(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(lo, hi - lo))
                last = group
        if kept:
            yield from links(pa.Table.from_batches(kept))

    return map_arrow(members, run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of `docs`.

    A null or empty text, or one of white space, has no shingles and is its own group. Rows with
    the same id are kept or dropped together if their texts are alike. A document without an id
    belongs to the group of its text; its group's id is null if no member has one, and it is kept
    then. Only `doc_id` and `text` are read.
    """
    plain = take(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
    )
    rows_of = stored(sketch(plain, bands, rows, width), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = rows_of.where("n > 0").groupBy("class").agg(
        F.min(own).alias("first"), F.max("n").alias("n"), F.max("registers").alias("registers")
    )
    classes = stored(classes.select("class", "first.doc_id", "first.text_key", "n", "registers"), "classes")
    keys = band_keys(classes, bands, rows)
    sizes = keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(sizes, "band"), "members")
    company = members.groupBy("class").agg(F.sum("size").alias("company"))
    centres = members.join(company, "class").groupBy("band").agg(F.max(F.struct("company", "class")).alias("c"))
    members = stored(members.join(centres.select("band", F.col("c.class").alias("centre")), "band"), "members")
    stars = members.where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    links = stored(verified(_alike(stars, classes, percent, bands, rows), plain, classes, percent, width), "links")
    found = stored(components(links), "components")

    rest = members.where("class <> centre").join(found.withColumnRenamed("node", "class"), "class", "left")
    label = F.coalesce("component", "class").alias("component")
    rest = stored(rest.select("band", "number", "class", "size", label), "rest")
    apart = rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rest = stored(rest.join(apart.select("band"), "band"), "apart")
    texts = texts_of_classes(plain, classes, rest.select("class"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    rest = rest.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    ends = F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j")
    rest = rest.select("band", "number", *ends, "block", "class", "component")
    rest = rest.join(classes.select("class", "n", "registers"), "class").join(texts, "class")
    dealt = rest.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stored(_cross_links(dealt, percent, bands, rows, width), "links")
    if not more.isEmpty():
        found = stored(components(links.unionByName(more)), "components")

    grouped = classes.join(found.withColumnRenamed("node", "class"), "class")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    grouped = grouped.join(least, "component").select("class", "group_id")
    of_class = classes.join(grouped, "class", "left").select("class", F.coalesce("group_id", "doc_id").alias("group_id"))
    out = rows_of.select("doc_id", "text_key", "n", "class").join(of_class, "class", "left")
    group = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("group_id"))
    return out.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        group.alias("component_id"),
        F.coalesce(F.col("doc_id") == group, group.isNull()).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group; rows that repeat an id and text stay together."""
    kept = near_duplicates(docs).where("kept").select("doc_id", "text_key").distinct()
    return matching(docs, stored(kept, "kept"), "left_semi")
