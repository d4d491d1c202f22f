"""Logistic regressions of all leave-one-out folds by one optimiser that reads every row once per step.

A row trains every fold but that of its own source. The folds share the term counts of a row; each has
its own vocabulary and inverse document frequencies, so its vector is made from the counts when the row
is read. A step evaluates the loss and gradient of all folds at their trial points in one scan: a task
adds up its rows' gradients, the sums meet in a tree, and the driver moves every fold by its own L-BFGS
step. The scans needed are those of the slowest fold, whatever the number of folds.

The steps of a fold are preconditioned with the curvature of a bounded sample of its rows. That only
chooses where to look: losses, gradients and the end of the search are those of all rows.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.session import ship, stored

MAX_CELLS = 1 << 24  # coefficients of all folds together; they go to every task
BLOCK = 2048  # rows of a block
SLICE = 1 << 16  # coefficients whose sums meet in one group
FAN_IN = 64  # partial sums that one group adds up
MEMORY = 100  # steps that L-BFGS looks back; fewer if they are more than HISTORY numbers, but 10 at least
HISTORY = 1 << 24
NORMS = 32  # folds up to which a block holds the norms of its rows
AT_ONCE = 1 << 21  # numbers of all partial sums that the driver adds up itself, without a shuffle
SAMPLE = 1024  # rows, about, whose curvature preconditions the steps
PRODUCTS = 1 << 23  # products of two such rows of all folds together; more folds have fewer rows each
FEWEST = 64  # rows of a fold that are worth it
UNSEEN = 0.01  # share of the bound of the curvature that the sample is taken to miss
ROUNDING = 1e-12  # of the loss: an increase this small is no increase


@dataclass(frozen=True)
class Folds:
    """Names, terms that any fold uses, and per fold the weight of each (0: not in its vocabulary)."""

    names: list[str]
    terms: list[str]
    idf: np.ndarray

    @property
    def dimension(self) -> int:
        """Terms, perplexity, burstiness, intercept."""
        return len(self.terms) + 3


def fold_table(vocabulary: pd.DataFrame, sizes: dict[str, int]) -> Folds:
    """Folds from (held_out_source, term, df) and the number of training rows by fold."""
    names, terms = list(sizes), sorted(set(vocabulary["term"]))
    idf = np.zeros((len(names), len(terms)))
    row = vocabulary["held_out_source"].map({n: i for i, n in enumerate(names)})
    column = vocabulary["term"].map({t: i for i, t in enumerate(terms)})
    n = vocabulary["held_out_source"].map(sizes).to_numpy(float)
    idf[row.to_numpy(int), column.to_numpy(int)] = np.log((n + 1) / (vocabulary["df"].to_numpy(float) + 1)) + 1
    return Folds(names, terms, idf)


@dataclass
class Block:
    """Rows with their term counts as sparse rows; `fold` is the fold that holds the row out, or -1.

    If `ready` the entries are feature values instead of counts.
    """

    fold: np.ndarray
    test: np.ndarray
    label: np.ndarray
    stats: np.ndarray  # perplexity, burstiness
    start: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    ready: bool = False
    norms: np.ndarray | None = None  # of the rows' vectors, by fold

    def norm(self, fold: int, idf: np.ndarray) -> np.ndarray:
        """Lengths of the tf-idf vectors under the weights of one fold; 1 for an empty one."""
        if self.ready:
            return np.ones(len(self.label))
        if self.norms is not None:
            return self.norms[fold]
        norm = np.sqrt(self.sums((self.counts * idf[self.terms]) ** 2))
        return np.where(norm > 0, norm, 1.0)

    def spread(self, by_row: np.ndarray) -> np.ndarray:
        """The value of its row for each entry."""
        return np.repeat(by_row, np.diff(self.start))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of the entries, by row."""
        filled = np.flatnonzero(np.diff(self.start))
        out = np.zeros(len(self.start) - 1)
        if len(filled):
            out[filled] = np.add.reduceat(values, self.start[filled])
        return out

    def only(self, use: np.ndarray) -> Block:
        """Some rows, without their norms."""
        entries = np.repeat(use, np.diff(self.start))
        start = np.r_[0, np.cumsum(np.diff(self.start)[use])]
        own = self.fold[use], self.test[use], self.label[use], self.stats[use], start, self.terms[entries], self.counts[entries]
        return Block(*own, self.ready)

    def scores(self, fold: int, idf: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Linear scores under one fold."""
        return self.sums(self.counts * (idf * w[:-3])[self.terms]) / self.norm(fold, idf) + self.stats @ w[-3:-1] + w[-1]


def vector_blocks(rows: DataFrame, features: str, label: str, size: int = BLOCK) -> tuple[DataFrame, Folds]:
    """Blocks of rows with ready vectors, stored, and the one fold that all of them train."""
    vector = F.unwrap_udt(features)
    dense = vector["type"] == 1
    entries = F.when(dense, F.sequence(F.lit(0), F.size(vector["values"]) - 1)).otherwise(vector["indices"])
    first = rows.select(F.when(dense, F.size(vector["values"])).otherwise(vector["size"]).alias("d")).first()
    d = first["d"] if first else 0
    plain = rows.select(
        F.lit(-1).alias("fold"), F.lit(False).alias("test"), F.col(label).cast("double").alias("label"),
        F.lit(0.0).alias("perplexity"), F.lit(0.0).alias("burstiness"), entries.alias("terms"), vector["values"].alias("counts"),
    )
    folds = Folds(["all"], [str(i) for i in range(d)], np.ones((1, d)))
    return _stored_blocks(plain, size, folds, ready=True), folds


def blocks(rows: DataFrame, folds: Folds, by: str, terms: Column, size: int = BLOCK) -> DataFrame:
    """(block) of `rows` (by, split, label, perplexity, burstiness, ...), stored."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in folds.names]), F.col(by)).cast("int") - 1, F.lit(-1))
    counted = CountVectorizerModel.from_vocabulary(folds.terms, inputCol="_terms", outputCol="_tf", minTF=1.0).transform(
        rows.withColumn("_terms", terms)
    )
    plain = counted.withColumn("_v", F.unwrap_udt("_tf")).select(
        place.alias("fold"),
        (F.col("split") == "test").alias("test"),
        F.col("label").cast("double").alias("label"),
        F.coalesce("perplexity", F.lit(0.0)).alias("perplexity"),
        F.coalesce("burstiness", F.lit(0.0)).alias("burstiness"),
        F.col("_v.indices").alias("terms"),
        F.col("_v.values").alias("counts"),
    )
    return _stored_blocks(plain, size, folds, ready=False)


def _stored_blocks(plain: DataFrame, size: int, folds: Folds, ready: bool) -> DataFrame:
    ship(plain.sparkSession)
    sent = plain.sparkSession.sparkContext.broadcast(folds.idf) if not ready and len(folds.names) <= NORMS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                number = lambda name: part.column(name).to_numpy(zero_copy_only=False)
                lengths = np.diff(part.column("terms").offsets.to_numpy())
                made = Block(
                    number("fold"), number("test").astype(bool), number("label"),
                    np.column_stack([number("perplexity"), number("burstiness")]), np.r_[0, np.cumsum(lengths)],
                    part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy(), ready,
                )
                if sent is not None:
                    made.norms = np.array([made.norm(f, idf) for f, idf in enumerate(sent.value)])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(made))], pa.binary())], names=["block"])

    return stored(plain.mapInArrow(run, "block binary"), "fold-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator:
    for batch in batches:
        for cell in batch.column("block"):
            yield kind(**pickle.loads(cell.as_py()))


def _tree_sum(partial: DataFrame, partitions: int) -> np.ndarray:
    """Sum of the vectors (part, slice, values) over all parts; no group adds up more than FAN_IN of them."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py()) for v in rows.column("values")], axis=0)
        return pa.table([[rows.column("up")[0].as_py()], [rows.column("slice")[0].as_py()], [total.tobytes()]], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("values", pa.binary())])
    while partitions > 1:
        partitions = -(-partitions // FAN_IN)
        up = partial.withColumn("up", (F.col("part") / FAN_IN).cast("int"))
        partial = up.groupBy("up", "slice").applyInArrow(add, "part int, slice int, values binary")
    found = sorted((r["slice"], bytes(r["values"])) for r in partial.collect())
    return np.concatenate([np.frombuffer(v) for _, v in found]) if found else np.empty(0)


def _held(table: DataFrame, cells: int) -> RDD | None:
    """The blocks where the executors keep them, on disk if they have to, when the partial sums are few numbers.

    A scan of them is one stage without a plan, which for blocks is most of its time.
    """
    rows = table.rdd
    parts = AT_ONCE // max(cells, 1)
    if parts < min(rows.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism):
        return None
    # no more sums than the driver adds up, and still a task for each core
    return rows.coalesce(min(parts, rows.getNumPartitions())).map(lambda r: r["block"]).persist(StorageLevel.MEMORY_AND_DISK)


def _plain_sum(held: RDD, sent, add: Callable[[object, object, np.ndarray], None], cells: int, kind: type) -> np.ndarray:
    """Sums of the tasks, added up in their order."""

    def run(packed: Iterator[bytes]) -> Iterator[bytes]:
        total = np.zeros(cells)
        for cell in packed:
            add(kind(**pickle.loads(cell)), sent.value, total)
        yield total.tobytes()

    total = np.zeros(cells)
    for part in held.mapPartitions(run).collect():  # at most AT_ONCE numbers
        total += np.frombuffer(part)
    return total


def sum_over_blocks(
    table: DataFrame,
    shared,
    add: Callable[[object, object, np.ndarray], None],
    cells: int,
    kind: type = Block,
    held: RDD | None = None,
) -> np.ndarray:
    """`add(block, shared, total)` for every block, totals of all tasks added up; `shared` goes to every task.

    `held` are the blocks of `table` as `_held` keeps them.
    """
    ship(table.sparkSession)
    sc = table.sparkSession.sparkContext
    sent = sc.broadcast(shared)  # at most MAX_CELLS numbers, see `fit_folds`
    if held is not None:
        try:
            return _plain_sum(held, sent, add, cells, kind)
        finally:
            sent.destroy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), np.zeros(cells)
        for block in _unpacked(batches, kind):
            add(block, sent.value, total)
        for i, lo in enumerate(range(0, cells, SLICE)):
            arrays = [pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([total[lo : lo + SLICE].tobytes()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "slice", "values"])

    partial = table.mapInArrow(run, "part int, slice int, values binary")
    try:
        total = _tree_sum(partial, table.rdd.getNumPartitions())
    finally:
        sent.destroy()
    return total if len(total) else np.zeros(cells)


def losses(
    table: DataFrame, folds: Folds, points: np.ndarray, active: np.ndarray, c: float, held: RDD | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient) of the active folds at `points`: |w|^2 / 2 + c * sum of log losses, in one scan."""
    idf, d = folds.idf, folds.dimension

    def add(block: Block, shared, total: np.ndarray) -> None:
        idf, w, on = shared
        gradient, loss = total[: len(on) * d].reshape(len(on), d), total[len(on) * d :]
        for i, f in enumerate(on):
            use = ~block.test & (block.fold != f)
            z = block.scores(f, idf[i], w[i])
            sign = 2 * block.label - 1
            loss[i] += np.logaddexp(0.0, -sign * z)[use].sum()
            residual = np.where(use, 1 / (1 + np.exp(-np.clip(z, -700, 700))) - block.label, 0.0)
            by_term = np.bincount(block.terms, block.counts * block.spread(residual / block.norm(f, idf[i])), d - 3)
            gradient[i, : d - 3] += idf[i] * by_term
            gradient[i, -3:-1] += residual @ block.stats
            gradient[i, -1] += residual.sum()

    on = np.flatnonzero(active)
    total = sum_over_blocks(table, (idf[on], points[on], on), add, len(on) * (d + 1), held=held)
    loss, gradient = np.full(len(active), np.nan), np.full(points.shape, np.nan)
    w = points[on].copy()
    w[:, -1] = 0.0  # the intercept is not penalised
    gradient[on] = c * total[: len(on) * d].reshape(len(on), d) + w
    loss[on] = c * total[len(on) * d :] + (w**2).sum(axis=1) / 2
    return loss, gradient


def curvatures(table: DataFrame, folds: Folds, c: float, held: RDD | None = None) -> np.ndarray:
    """Per fold and coefficient a bound of the second derivative."""
    d = folds.dimension

    def add(block: Block, idf, total: np.ndarray) -> None:
        squares = total.reshape(len(idf), d)
        for f in range(len(idf)):
            use = (~block.test & (block.fold != f)).astype(float)
            by_term = np.bincount(block.terms, block.counts**2 * block.spread(use / block.norm(f, idf[f]) ** 2), d - 3)
            squares[f, : d - 3] += idf[f] ** 2 * by_term
            squares[f, -3:-1] += use @ block.stats**2
            squares[f, -1] += use.sum()

    squares = sum_over_blocks(table, folds.idf, add, len(folds.names) * d, held=held).reshape(len(folds.names), d)
    bound = c * squares / 4
    bound[:, :-1] += 1.0
    return np.maximum(bound, 1e-12)


class _Sampled:
    """Second derivatives of one fold's loss as a sample of its rows has them, solved for a vector.

    They are a diagonal plus rows^T weights rows, so a system as large as the sample is solved. The
    diagonal is the penalty and the share UNSEEN of the bound.
    """

    def __init__(self, rows: Block, idf: np.ndarray, bound: np.ndarray, weight: float):
        n, d = len(rows.label), len(bound)
        lengths = np.diff(rows.start)
        values = rows.counts * idf[rows.terms] / rows.spread(rows.norm(0, idf))
        own = np.column_stack([rows.stats, np.ones(n)])
        self.row = np.r_[np.repeat(np.arange(n), lengths), np.repeat(np.arange(n), 3)]
        self.column = np.r_[rows.terms, np.tile(np.arange(d - 3, d), n)].astype(np.int64)
        self.value = np.r_[values, own.ravel()]
        self.weight = weight
        penalty = np.r_[np.ones(d - 1), 0.0]
        self.diagonal = np.maximum(penalty + UNSEEN * (bound - penalty), 1e-12)
        order = np.argsort(self.column, kind="stable")
        ends = np.searchsorted(self.column[order], np.arange(0, d + SAMPLE, SAMPLE))
        self.products = np.zeros((n, n))
        for i, lo in enumerate(range(0, d, SAMPLE)):
            at = order[ends[i] : ends[i + 1]]
            part = np.zeros((n, min(SAMPLE, d - lo)))
            np.add.at(part, (self.row[at], self.column[at] - lo), self.value[at])
            self.products += (part / self.diagonal[lo : lo + SAMPLE]) @ part.T

    def _times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.products))

    def move(self, point: np.ndarray) -> None:
        """Weights of the rows at a point."""
        p = 1 / (1 + np.exp(-np.clip(self._times(point), -700, 700)))
        self.root = np.sqrt(self.weight * np.maximum(p * (1 - p), 1e-6))
        self.inverse = np.linalg.inv(np.eye(len(p)) + self.products * np.outer(self.root, self.root))

    def solve(self, q: np.ndarray) -> np.ndarray:
        u = q / self.diagonal
        inner = self.root * (self.inverse @ (self.root * self._times(u)))
        return u - np.bincount(self.column, self.value * inner[self.row], len(q)) / self.diagonal


def _sample(held: RDD, rows: float, size: int) -> Block | None:
    """About `size` of `rows` training rows, any rows of all blocks."""
    share = min(1.0, size / max(rows, 1.0))

    def take(part: int, packed: Iterator[bytes]) -> Iterator[Block]:
        chosen = np.random.default_rng(part)
        for cell in packed:
            block = Block(**pickle.loads(cell))
            yield block.only((chosen.random(len(block.label)) < share) & ~block.test)

    found = [x for x in held.mapPartitionsWithIndex(take).collect() if len(x.label)]
    if not found:
        return None
    joined = {c: np.concatenate([getattr(x, c) for x in found]) for c in ("fold", "test", "label", "stats", "terms", "counts")}
    start = np.r_[0, np.cumsum(np.concatenate([np.diff(x.start) for x in found]))]
    return Block(**joined, start=start, ready=found[0].ready)


def _precondition(held: RDD, states: list[_Fold], folds: Folds, curvature: np.ndarray, c: float) -> None:
    """Give each fold the curvature of a sample of its rows."""
    rows = 4 * curvature[:, -1] / c  # that train each fold
    size = min(SAMPLE, int((PRODUCTS / len(states)) ** 0.5))
    if size < FEWEST or rows.max() < 1:
        return
    # a row trains all folds but one
    found = _sample(held, rows.max(), size)
    for f, state in enumerate(states):
        if found is not None and (own := found.only(found.fold != f)).label.size:
            state.use(_Sampled(own, folds.idf[f], curvature[f], c * rows[f] / len(own.label)))


class _Fold:
    """L-BFGS of one fold, asked for trial points and told what was found there."""

    def __init__(self, point: np.ndarray, loss: float, gradient: np.ndarray, curvature: np.ndarray, tol: float, memory: int = 10):
        self.point, self.loss, self.gradient, self.curvature, self.tol = point, loss, gradient, curvature, tol
        self.steps: deque = deque(maxlen=memory)
        self.stuck, self.sampled = False, None
        self._turn()

    def use(self, sampled: _Sampled) -> None:
        """Precondition the steps from here on."""
        self.sampled = sampled
        self._turn()

    def _solve(self, q: np.ndarray) -> np.ndarray:
        return q / self.curvature if self.sampled is None else self.sampled.solve(q)

    @property
    def residual(self) -> float:
        """Largest gradient in units of the root of the curvature; bounds the distance to the optimum."""
        return float(np.abs(self.gradient / np.sqrt(self.curvature)).max())

    @property
    def done(self) -> bool:
        return self.stuck or self.residual <= self.tol

    def _turn(self) -> None:
        if self.sampled is not None:
            self.sampled.move(self.point)
        q, used = self.gradient.copy(), []
        for s, y, sy in reversed(self.steps):
            a = (s @ q) / sy
            q -= a * y
            used.append(a)
        q = self._solve(q)
        if self.steps:
            s, y, sy = self.steps[-1]
            q *= sy / (y @ self._solve(y))
        for (s, y, sy), a in zip(self.steps, reversed(used)):
            q += (a - (y @ q) / sy) * s
        self.direction, self.size = -q, 1.0
        self.slope = float(self.gradient @ self.direction)

    def trial(self) -> np.ndarray:
        return self.point + self.size * self.direction

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        t = self.size
        if loss <= self.loss + 1e-4 * t * self.slope + ROUNDING * abs(self.loss):
            s, y = t * self.direction, gradient - self.gradient
            if s @ y > 0:
                self.steps.append((s, y, s @ y))
            self.point, self.loss, self.gradient = self.point + s, loss, gradient
            self._turn()
        elif t < 1e-10:
            if self.steps:  # start again without memory before giving up
                self.steps.clear()
                self._turn()
            else:
                self.stuck = True
        else:
            # the lowest point of the parabola through what is known, within limits
            lowest = -self.slope * t * t / (2 * (loss - self.loss - self.slope * t))
            self.size = min(max(lowest, 0.1 * t), 0.5 * t) if np.isfinite(lowest) else 0.1 * t


@dataclass(frozen=True)
class Fitted:
    """Coefficients by fold (terms, perplexity, burstiness, intercept), what is left of the gradient, and scans."""

    folds: Folds
    coefficients: np.ndarray
    residuals: np.ndarray
    scans: int


def fit_folds(table: DataFrame, folds: Folds, c: float = 1.0, tol: float = 1e-6, max_iter: int = 1000) -> Fitted:
    """Minimise every fold's |w|^2 / 2 + c * sum of log losses over its training rows.

    Ends when each gradient is at most `tol` in units of the root of its curvature, which bounds the
    distance of a coefficient to the optimum, or after `max_iter` scans.
    """
    k, d = len(folds.names), folds.dimension
    if k * d > MAX_CELLS:
        raise ValueError(f"{k} folds of {d} coefficients are more than {MAX_CELLS} numbers")
    points, every = np.zeros((k, d)), np.ones(k, bool)
    if not k:
        return Fitted(folds, points, np.zeros(0), 0)
    ship(table.sparkSession)
    held = _held(table, k * (d + 1))
    try:
        curvature = curvatures(table, folds, c, held)
        loss, gradient = losses(table, folds, points, every, c, held)
        memory = max(10, min(MEMORY, HISTORY // (k * d)))
        states = [_Fold(points[f], loss[f], gradient[f], curvature[f], tol, memory) for f in range(k)]
        if held is not None and c > 0:
            _precondition(held, states, folds, curvature, c)
        scans = 1
        while scans < max_iter and any(active := np.array([not s.done for s in states])):
            points = np.array([s.trial() for s in states])
            loss, gradient = losses(table, folds, points, active, c, held)
            for f in np.flatnonzero(active):
                states[f].tell(float(loss[f]), gradient[f])
            scans += 1
    finally:
        if held is not None:
            held.unpersist()
    return Fitted(folds, np.array([s.point for s in states]), np.array([s.residual for s in states]), scans)


def held_out_counts(table: DataFrame, fitted: Fitted) -> np.ndarray:
    """(folds, 4): true negatives, false positives, false negatives, true positives of each fold's own test rows."""
    folds = fitted.folds

    def add(block: Block, shared, total: np.ndarray) -> None:
        idf, w = shared
        for f in np.unique(block.fold[block.test & (block.fold >= 0)]):
            use = block.test & (block.fold == f)
            positive = block.scores(f, idf[f], w[f]) > 0
            total[4 * f : 4 * f + 4] += np.bincount((2 * block.label + positive)[use].astype(int), minlength=4)

    found = sum_over_blocks(table, (folds.idf, fitted.coefficients), add, 4 * len(folds.names))
    return found.reshape(-1, 4)
