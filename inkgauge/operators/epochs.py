"""Training by epochs with a stored history, choice of the best epoch, and restart after the last one.

The rows are written once as blocks by mini-batch, a hash of their key, so a step reads its files only.
A step is one synchronous update: the tasks add up the gradients of their rows, the sums meet in a tree,
and the driver, which holds the few weights, moves them (Adam). After each epoch the validation rows are
scored, and the weights, the state of the optimiser and one row of history are written.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.columns import portable_hash
from inkgauge.operators import fold_fit
from inkgauge.operators.metrics import select_best_epoch
from inkgauge.operators.splits import SEED
from inkgauge.session import ship, work_path

HISTORY = "run string, epoch int, train_samples long, val_samples long, train_loss double, val_loss double, val_accuracy double, val_f1 double"
VALIDATION = -1  # the mini-batch number of validation rows


@dataclass
class Rows:
    """Feature rows of one mini-batch with their labels."""

    x: np.ndarray
    y: np.ndarray


@dataclass(frozen=True)
class Network:
    """A linear-ReLU-...-linear network with two outputs; its weights are one flat vector."""

    sizes: tuple[int, ...]

    @property
    def cells(self) -> int:
        return sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = [[rng.standard_normal(a * b) * np.sqrt(2 / a), np.zeros(b)] for a, b in zip(self.sizes, self.sizes[1:])]
        return np.concatenate([p for pair in parts for p in pair])

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(matrix, bias) by layer, as views of `weights`."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of every layer, then the logits."""
        layers, seen = self.layers(weights), [x]
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i < len(layers) - 1:
                x = np.maximum(x, 0.0)
            seen.append(x)
        return seen

    def loss(self, weights: np.ndarray, rows: Rows) -> tuple[float, np.ndarray]:
        """Sum of cross entropies, and the probability of class 1."""
        z = self.forward(weights, rows.x)[-1]
        margin = z[:, 1] - z[:, 0]
        return float(np.logaddexp(0.0, -(2 * rows.y - 1) * margin).sum()), 1 / (1 + np.exp(-np.clip(margin, -700, 700)))

    def add_gradient(self, weights: np.ndarray, rows: Rows, total: np.ndarray) -> None:
        """Adds the gradient of the summed loss, then the loss, to `total`."""
        seen = self.forward(weights, rows.x)
        loss, p = self.loss(weights, rows)
        total[-1] += loss
        delta = np.column_stack([rows.y - p, p - rows.y])
        for (w, _), (dw, db), x in zip(
            reversed(self.layers(weights)), reversed(self.layers(total[: self.cells])), reversed(seen[:-1])
        ):
            dw += x.T @ delta
            db += delta.sum(axis=0)
            delta = (delta @ w.T) * (x > 0)


def mini_batches(rows: DataFrame, batches: int, key: str, features: str = "features", label: str = "label", seed: int = SEED) -> DataFrame:
    """(block, slot) of the train and validation rows, stored in a folder by mini-batch."""
    slot = F.when(F.col("split") == "val", VALIDATION).otherwise(F.pmod(portable_hash(seed, "epoch", F.col(key)), F.lit(batches)))
    plain = rows.where(F.col("split").isin("train", "val")).select(
        slot.cast("int").alias("slot"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            slots, y = batch.column("slot").to_numpy(), batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for s in np.unique(slots):
                made = pickle.dumps(Rows(x[slots == s], y[slots == s]).__dict__)
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary()), pa.array([s], pa.int32())], names=["block", "slot"])

    ship(rows.sparkSession)
    path = work_path(rows.sparkSession, "mini-batches")
    plain.mapInArrow(run, "block binary, slot int").write.partitionBy("slot").parquet(path)
    return rows.sparkSession.read.schema("block binary, slot int").parquet(path)


def _checked(table: DataFrame, network: Network, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """(summed loss, true negatives, false positives, false negatives, true positives) of the validation rows."""

    def add(rows: Rows, weights: np.ndarray, total: np.ndarray) -> None:
        loss, p = network.loss(weights, rows)
        total[0] += loss
        total[1:] += np.bincount((2 * rows.y + (p > 0.5)).astype(int), minlength=4)

    found = fold_fit.sum_over_blocks(table.where(F.col("slot") == VALIDATION), weights, add, 5, Rows)
    return float(found[0]), found[1:]


def saved_epoch(spark: SparkSession, path: str, epoch: int) -> dict[str, np.ndarray]:
    """Weights and optimiser state after an epoch."""
    rows = spark.read.parquet(f"{path}/weights/epoch={epoch}").collect()
    return {r["name"]: np.array(r["numbers"]) for r in rows}


def history(spark: SparkSession, path: str) -> DataFrame:
    """The epochs finished so far."""
    return spark.read.schema(HISTORY).parquet(f"{path}/history/*")


def _finished(spark: SparkSession, path: str, run: str) -> list:
    try:
        return history(spark, path).where(F.col("run") == run).orderBy("epoch").collect()
    except AnalysisException:  # nothing has been written yet
        return []


def train(
    table: DataFrame,
    network: Network,
    path: str,
    run: str = "hybrid",
    epochs: int = 10,
    patience: int | None = None,
    rate: float = 0.01,
    seed: int = SEED,
) -> DataFrame:
    """Train on `mini_batches` up to epoch number `epochs`; the history, also found at `path`.

    Goes on after the last epoch in `path`, if there is one, and gives what an unbroken run gives.
    Ends early when `val_f1` has not risen for `patience` epochs. The history row of an epoch is
    written after its weights, so an epoch that was broken off is repeated. The weights are on the
    driver and go to every task: more than `fold_fit.MAX_CELLS` are an error.
    """
    spark = table.sparkSession
    if network.cells > fold_fit.MAX_CELLS:
        raise ValueError(f"more than {fold_fit.MAX_CELLS} weights")
    slots = table.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("slot") != VALIDATION).orderBy("slot").collect()
    done = _finished(spark, path, run)
    if done:
        state = saved_epoch(spark, path, done[-1]["epoch"])
    else:
        state = {"weights": network.start(seed), "mean": np.zeros(network.cells), "square": np.zeros(network.cells), "steps": np.zeros(1)}
    scores = [r["val_f1"] for r in done]

    def add(rows: Rows, weights: np.ndarray, total: np.ndarray) -> None:
        network.add_gradient(weights, rows, total[:-1])
        total[-1] += len(rows.y)

    for epoch in range(len(done) + 1, epochs + 1):
        if patience is not None and len(scores) > patience and max(scores[-patience:]) <= max(scores[:-patience]):
            break
        loss = rows = 0.0
        for slot in np.random.default_rng([seed, epoch]).permutation([r["slot"] for r in slots]).tolist():
            total = fold_fit.sum_over_blocks(table.where(F.col("slot") == slot), state["weights"], add, network.cells + 2, Rows)
            gradient = total[: network.cells] / total[-1]
            loss, rows, state["steps"] = loss + total[-2], rows + total[-1], state["steps"] + 1
            state["mean"] = 0.9 * state["mean"] + 0.1 * gradient
            state["square"] = 0.999 * state["square"] + 0.001 * gradient**2
            t = state["steps"][0]
            step = state["mean"] / (1 - 0.9**t) / (np.sqrt(state["square"] / (1 - 0.999**t)) + 1e-8)
            state["weights"] = state["weights"] - rate * step
        val_loss, (tn, fp, fn, tp) = _checked(table, network, state["weights"])
        n = tn + fp + fn + tp
        mean = lambda a, b: float(a / b) if b else 0.0
        scores.append(mean(2 * tp, 2 * tp + fp + fn))
        saved = spark.createDataFrame([(k, v.tolist()) for k, v in state.items()], "name string, numbers array<double>")
        saved.write.mode("overwrite").parquet(f"{path}/weights/epoch={epoch}")
        row = (run, epoch, int(rows), int(n), mean(loss, rows), mean(val_loss, n), mean(tn + tp, n), scores[-1])
        spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/history/{run}-{epoch}")
    return history(spark, path)


def best_weights(spark: SparkSession, path: str, run: str = "hybrid") -> tuple[int, np.ndarray] | None:
    """(epoch, weights) of the earliest epoch with the highest `val_f1`; None if it never exceeds 0."""
    best = select_best_epoch(history(spark, path).where(F.col("run") == run)).first()
    return best and (best["best_epoch"], saved_epoch(spark, path, best["best_epoch"])["weights"])


def recomputed_history(rows: DataFrame, network: Network, path: str, run: str = "hybrid") -> DataFrame:
    """The history with `recomputed`: whether the saved weights of the epoch give its validation figures.

    The weights of all epochs are applied to the validation rows by plain matrix products, and the
    figures are counted from the rows.
    """
    from inkgauge.operators.models import MlpHead, mlp_head_forward, softmax_argmax

    spark = rows.sparkSession
    told = history(spark, path).where(F.col("run") == run)
    val, found = rows.where(F.col("split") == "val"), None
    for epoch in [r["epoch"] for r in told.select("epoch").collect()]:
        head = MlpHead(network.layers(saved_epoch(spark, path, epoch)["weights"]))
        scored = softmax_argmax(mlp_head_forward(val, head, vector_to_array("features")))
        hit = lambda p, y: F.sum(((F.col("pred") == p) & (F.col("label") == y)).cast("int"))
        f1 = 2 * hit(1, 1) / F.nullif(2 * hit(1, 1) + hit(1, 0) + hit(0, 1), F.lit(0))
        counted = scored.agg(F.count("*").alias("_n"), ((hit(0, 0) + hit(1, 1)) / F.count("*")).alias("_a"), f1.alias("_f"))
        counted = counted.withColumn("epoch", F.lit(epoch))
        found = counted if found is None else found.unionByName(counted)
    near = lambda a, b: F.abs(F.col(a) - F.coalesce(F.col(b), F.lit(0.0))) < 1e-12
    same = (F.col("val_samples") == F.col("_n")) & near("val_accuracy", "_a") & near("val_f1", "_f")
    return told.join(F.broadcast(found), "epoch").withColumn("recomputed", same).drop("_n", "_a", "_f")
