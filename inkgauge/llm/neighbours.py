"""Nearest neighbours by inner product with vantage-point trees, one tree per shard.

The largest inner product becomes a smallest distance: with M the largest norm, every vector gets
one more coordinate sqrt(M^2 - |x|^2), queries get 0. A shard is a bounded number of vectors and has
its own tree; blocks of queries meet every shard, and each query's best of all shards is merged.
The triangle inequality prunes; `factor` below one prunes more than is safe, one is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_arrow, stored, take

K = 20
FACTOR = 1.0
SHARD = 8192  # vectors of a tree, about
QUERIES = 1024  # queries of a block, about
LEAF = 256
SLACK = 1e-9  # nearness is compared with room for rounding, then computed exactly


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of finite numbers that are not zero, as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = take(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0.0))


def build_tree(points: np.ndarray, rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """(nodes, order): node = (vantage row, limit, inner, outer) or (None, lo, hi); leaves are ranges of `order`."""
    nodes: list[tuple] = []
    order: list[np.ndarray] = []
    size = 0

    def make(rows: np.ndarray) -> int:
        nonlocal size
        at = len(nodes)
        nodes.append(())
        if len(rows) <= LEAF:
            order.append(rows)
            nodes[at] = (None, size, size + len(rows))
            size += len(rows)
            return at
        vantage = int(rows[rng.integers(len(rows))])
        distance = np.linalg.norm(points[rows] - points[vantage], axis=1)
        by = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        limit = float(distance[by[half]])
        nodes[at] = (vantage, limit, make(rows[by[:half]]), make(rows[by[half:]]))
        return at

    make(np.arange(len(points)))
    return nodes, np.concatenate(order) if order else np.empty(0, np.int64)


class Shard:
    """A tree over vectors with the extra coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int):
        rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0.0))
        points = np.column_stack([vectors, rest])
        self.nodes, order = build_tree(points, np.random.default_rng(seed))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.nodes = [(n[0] if n[0] is None else int(place[n[0]]), *n[1:]) for n in self.nodes]
        self.ids, self.points = ids[order], points[order]

    def search(self, names: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[tuple]:
        """Per query (ids, products) of all that can be among its k nearest of this shard."""
        q = np.column_stack([queries, np.zeros(len(queries))])
        q_square = (q**2).sum(axis=1)
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
        best = np.full((len(names), k), np.inf)  # squared distances of the nearest so far

        def leaf(lo: int, hi: int, active: np.ndarray) -> None:
            points = self.points[lo:hi]
            square = q_square[active, None] + (points**2).sum(axis=1)[None] - 2 * q[active] @ points.T
            square[names[active, None] == self.ids[None, lo:hi]] = np.inf
            top = np.partition(np.concatenate([best[active], square], axis=1), k - 1, axis=1)[:, :k]
            best[active] = top
            limit = top.max(axis=1)
            room = SLACK * (1 + q_square[active])
            # the query itself is infinitely far: it stays out while fewer than k are found, too
            row, column = np.nonzero((square <= (limit + room)[:, None]) & np.isfinite(square))
            for r in np.unique(row):
                at = column[row == r]
                kept[active[r]].append((lo + at, square[r, at]))

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            vantage, *rest = self.nodes[node]
            if vantage is None:
                leaf(*rest, active)
                return
            limit, inner, outer = rest
            distance = np.linalg.norm(q[active] - self.points[vantage], axis=1)
            near = distance < limit
            visit(inner, active[near])
            visit(outer, active[~near])
            gap = np.abs(distance - limit) - 1e-7 * (1 + distance)
            reach = np.sqrt(np.maximum(best[active].max(axis=1), 0.0)) * factor
            open_ = gap <= reach
            visit(outer, active[near & open_])
            visit(inner, active[~near & open_])

        visit(0, np.arange(len(names)))
        out = []
        for i, parts in enumerate(kept):
            if not parts:
                out.append((np.empty(0, np.int64), np.empty(0)))
                continue
            at = np.concatenate([p[0] for p in parts])
            square = np.concatenate([p[1] for p in parts])
            at = at[square <= best[i].max() + SLACK * (1 + q_square[i])]
            product = (self.points[at, :-1] * queries[i]).sum(axis=1)
            ids = self.ids[at]
            first = np.lexsort((ids, -product))[:k]
            out.append((ids[first], product[first]))
        return out


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, tree): every vector is in one tree of about `shard` vectors."""
    totals = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    shards = max(1, -(-totals["n"] // shard))
    largest = float(np.sqrt(totals["m"] or 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            own = batch.column("shard").to_numpy()
            for s in np.unique(own):
                parts.setdefault(int(s), []).append(batch.filter(pa.array(own == s)))
        for s, found in parts.items():
            rows = pa.Table.from_batches(found)
            ids = rows.column("vec_id").to_numpy()
            matrix = np.array(rows.column("v").to_pylist(), dtype=np.float64)
            by = np.argsort(ids, kind="stable")
            tree = pickle.dumps(Shard(ids[by], matrix[by], largest, s))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([tree], pa.binary())], names=["shard", "tree"])

    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    dealt = vectors.withColumn("shard", own).repartition(shards, "shard")
    return stored(map_arrow(dealt, run, "shard int, tree binary"), "trees")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest of each row whose id is divisible by `every`.

    Ties go to the smaller id; a query never finds its own id. Rows without an id and vectors that
    are null, zero or hold null or non-finite components take no part; of rows that repeat an id
    the smallest vector counts. Shorter vectors are filled up with zeros. Only `vec_id` and
    `embedding` are read.
    """
    rows = stored(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))))
    queries = rows.where(F.col("vec_id") % every == 0)
    index = build_index(rows, shard)
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = queries.groupBy(block).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))  # about QUERIES rows each
    last = index.agg(F.max("shard")).first()[0] or 0  # a shard without a vector has no row
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = asked.join(index.hint("shuffle_hash"), "shard").select("q", "shard", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("shard")[i].as_py() != number:
                    number, tree = batch.column("shard")[i].as_py(), pickle.loads(batch.column("tree")[i].as_py())
                asked = batch.column("q")[i].values
                names = asked.field(0).to_numpy(zero_copy_only=False)
                matrix = np.array(asked.field(1).to_pylist(), dtype=np.float64)
                found = tree.search(names, matrix, k, factor)
                size = [len(f[0]) for f in found]
                columns = [np.repeat(names, size), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = map_arrow(met, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
