"""A multi-layer perceptron regressor by data-parallel gradients.

Columns and target are standardised (population deviation) by one aggregate. The
rows are written once, each as the bytes of its numbers; each step is one pass over
them, in which every task sums loss and gradient of its own rows, and a second level
sums the tasks, so that the driver gets at most ``FAN`` vectors of the model's size
whatever the rows. A reader, a cached column and an Arrow batch hold a fixed number
of rows, so a row of the written table is one listing: a task holds one batch and the
layers of at most ``BLOCK`` listings. The driver holds parameters and the state of
the Adam rule, nothing that grows with the data.

The loss is half the mean squared error and ``alpha`` / (2 n) times the squared
weights. A tenth of the rows (a hash of the id) is held back: a run stops after
``patience`` steps without a gain of ``TOL`` there and keeps its best parameters.

Steps use all training rows rather than small batches of them: a step is a Spark
job, and thousands of small ones an epoch would be all scheduling. ``max_iter``
counts steps; ``batch_size`` has no meaning here.

``search`` draws points of ``GRID`` and fits each on every fold; the rows of a fold
are prepared once for all points, which run side by side.

Rows whose target or a feature is null or not finite are left out of the fit and
get a null prediction. A constant column has weight on zeros only. An empty
training table is an error; without rows held back the training loss is watched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import CV_FOLDS, SEARCH_ITER, SPLIT_SEED
from ..operators.split import fold_of
from ..sources.io import parquet_roundtrip
from .models import PARALLEL_FITS, grid_points, held_back

BLOCK, FAN = 4096, 16
#: The grid of the model comparison, without the size of the batches.
GRID = {"hidden": [(100,), (200,), (100, 50), (200, 100), (256, 128, 64)], "activation": ["relu", "tanh"],
        "alpha": [0.001, 0.01, 0.1], "rate": [0.001, 0.005, 0.01]}
#: Least gain of the held-back loss (of a target of deviation 1) that counts.
TOL = 1e-4
Weights = list[tuple[np.ndarray, np.ndarray]]


def init(sizes: list[int], seed: int = SPLIT_SEED) -> Weights:
    """Uniform start values within the square root of 6 over the units at both ends of a layer."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = math.sqrt(6.0 / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in weights])


def shaped(values: np.ndarray, sizes: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((values[at:at + a * b].reshape(a, b), values[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, weights: Weights, activation: str) -> list[np.ndarray]:
    """Outputs of every layer, the input first; the last layer is linear."""
    layers = [x]
    for i, (w, b) in enumerate(weights):
        z = layers[-1] @ w + b
        if i < len(weights) - 1:
            z = np.maximum(z, 0.0) if activation == "relu" else np.tanh(z)
        layers.append(z)
    return layers


def gradient(x: np.ndarray, y: np.ndarray, weights: Weights, activation: str) -> tuple[float, np.ndarray]:
    """(sum of half the squared errors, its gradient) over the rows of one block."""
    layers = forward(x, weights, activation)
    delta = layers[-1] - y[:, None]
    loss = 0.5 * float((delta * delta).sum())
    out = []
    for i in range(len(weights) - 1, -1, -1):
        out.append((layers[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = delta @ weights[i][0].T
            delta = delta * ((layers[i] > 0) if activation == "relu" else (1.0 - layers[i] ** 2))
    return loss, flat(out[::-1])


@dataclass
class Mlp:
    features: list[str]
    weights: Weights
    activation: str
    mean: np.ndarray  # of the features, then of the target
    std: np.ndarray
    steps: int
    best_step: int
    held_loss: list[float]
    n_fits: int | None = None  # of the search, if it comes from one

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``prediction``; weights travel with the task, rows stay where they are."""
        weights, activation = self.weights, self.activation
        mean, std = self.mean, self.std

        @pandas_udf("double")
        def score(rows):
            import pandas as pd

            out = np.full(len(rows), np.nan)
            ok = rows.notna().to_numpy()
            if ok.any():
                x = (np.stack(rows[ok].to_numpy()).astype(float) - mean[:-1]) / std[:-1]
                out[ok] = forward(x, weights, activation)[-1][:, 0] * std[-1] + mean[-1]
            return pd.Series(out)  # NaN becomes null

        return df.select(*keep, score(_vector(self.features)).alias("prediction"))


def _finite(c):
    d = F.col(c).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def _vector(cols: list[str]):
    """The columns as one array, null if one of them is null or not finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & _finite(c)
    return F.when(ok, F.array(*[F.col(c).cast("double") for c in cols]))


def _moments(rows: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    aggs = [f(F.col(c).cast("double")) for c in cols for f in (F.avg, F.stddev_pop)]
    r = rows.agg(F.count("*"), *aggs).first()
    if not r[0]:
        raise ValueError("no row to fit on")
    std = np.array([v if v else 1.0 for v in r[2::2]], dtype=float)
    return int(r[0]), np.array(r[1::2], dtype=float), std


def _blocks(rows: DataFrame, mean: np.ndarray | float = 0.0, std: np.ndarray | float = 1.0) -> DataFrame:
    """``held, v`` from ``held, v``: the standardised values of each row as bytes, the target last."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = (np.asarray(batch.column(1).flatten()).reshape(n, -1) - mean) / std
            ends = np.arange(n + 1, dtype=np.int32) * np.int32(8 * v.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(v)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["held", "v"])

    return rows.select("held", "v").mapInArrow(run, "held boolean, v binary")


def _values(column: pa.Array) -> np.ndarray:
    """The rows of a batch as a matrix, not copied."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.float64, count=int(ends[-1] - ends[0]) // 8, offset=int(ends[0])).reshape(len(column), -1)


def _step(blocks: DataFrame, weights: Weights, activation: str, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """((training loss, held-back loss), gradient): sums over all rows at these parameters."""
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                total = np.zeros(2 + sum(w.size + b.size for w, b in weights))
            values, held = _values(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for part in (False, True):
                where = np.flatnonzero(held == part)
                for lo in range(0, len(where), BLOCK):
                    block = values[where[lo:lo + BLOCK]]
                    if part:
                        total[1] += 0.5 * float(((forward(block[:, :-1], weights, activation)[-1][:, 0] - block[:, -1]) ** 2).sum())
                    else:
                        loss, grad = gradient(block[:, :-1], block[:, -1], weights, activation)
                        total[0] += loss
                        total[2:] += grad
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    def add(batches):
        total = None
        for batch in batches:
            for row in batch.column(0):
                v = np.asarray(row.values)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    sums = blocks.mapInArrow(run, "total array<double>")
    if tasks > FAN:  # the second level: the driver gets FAN vectors, not one a task
        sums = sums.withColumn("to", F.spark_partition_id() % F.lit(FAN)).repartition(FAN, "to").select("total")
        sums = sums.mapInArrow(add, "total array<double>")
    total = np.sum([np.asarray(r[0]) for r in sums.collect()], axis=0)
    return total[:2], total[2:]


@dataclass
class Prepared:
    """Rows to fit on, standardised and written."""
    blocks: DataFrame
    features: list[str]
    n: int
    n_held: int
    mean: np.ndarray
    std: np.ndarray
    tasks: int


def prepare(train: DataFrame, features: list[str], label: str = "price", id_col: str = "id") -> Prepared:
    cols = [*features, label]
    rows = train.select(F.coalesce(held_back(id_col), F.lit(False)).alias("held"), _vector(cols).alias("v")).where("v is not null")
    usable = train.where(_vector(cols).isNotNull())
    _, mean, std = _moments(usable, cols)
    blocks = parquet_roundtrip(train.sparkSession, _blocks(rows, mean, std))
    counts = {r["held"]: int(r["n"]) for r in blocks.groupBy("held").agg(F.count("*").alias("n")).collect()}
    if not counts.get(False, 0):
        raise ValueError("no row to fit on")
    tasks = blocks.select(F.spark_partition_id()).distinct().count()
    return Prepared(blocks, list(features), counts[False], counts.get(True, 0), mean, std, tasks)


def descend(rows: Prepared, hidden: tuple = (256, 128, 64), activation: str = "relu", alpha: float = 0.1, rate: float = 0.005,
            max_iter: int = 500, patience: int = 15, seed: int = SPLIT_SEED) -> Mlp:
    """Fit on prepared rows."""
    n, n_held = rows.n, rows.n_held
    sizes = [len(rows.features), *hidden, 1]
    params = flat(init(sizes, seed))
    decay = flat([(np.ones_like(w), np.zeros_like(b)) for w, b in shaped(params, sizes)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    best, best_loss, best_step, waited, history = params, math.inf, 0, 0, []
    step = 0
    for step in range(1, max_iter + 1):
        losses, grad = _step(rows.blocks, shaped(params, sizes), activation, rows.tasks)
        watched = float(losses[1]) / n_held if n_held else float(losses[0]) / n
        history.append(watched)
        waited = 0 if watched < best_loss - TOL else waited + 1
        if watched < best_loss:
            best, best_loss, best_step = params, watched, step
        if waited >= patience:
            break
        grad = grad / n + alpha / n * decay * params
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Mlp(rows.features, shaped(best, sizes), activation, rows.mean, rows.std, step, best_step, history)


def fit(train: DataFrame, features: list[str], label: str = "price", hidden: tuple = (256, 128, 64), activation: str = "relu",
        alpha: float = 0.1, rate: float = 0.005, max_iter: int = 500, patience: int = 15, id_col: str = "id",
        seed: int = SPLIT_SEED) -> Mlp:
    """Fit on ``train``; see the module's text."""
    if activation not in ("relu", "tanh"):
        raise ValueError(f"activation {activation!r}: relu or tanh")
    return descend(prepare(train, features, label, id_col), hidden, activation, alpha, rate, max_iter, patience, seed)


def search(train: DataFrame, features: list[str], label: str = "price", n_iter: int | None = SEARCH_ITER, folds: int = CV_FOLDS,
           parallelism: int = PARALLEL_FITS, grid: dict | None = None, max_iter: int = 500, patience: int = 15,
           id_col: str = "id") -> tuple[Mlp, dict, float]:
    """M16 for M13: every drawn point on every fold, the best by mean RMSE fitted again on all rows.

    Returns (model, its parameters, mean RMSE). A fold without a row to score does not count; ties go to the first point.
    """
    points = grid_points(GRID if grid is None else grid, n_iter)
    fold = fold_of(id_col, folds)
    errors = [[] for _ in points]
    for f in range(folds):
        rows, held = prepare(train.where(fold != f), features, label, id_col), train.where(fold == f)

        def one(point):
            scored = descend(rows, **point, max_iter=max_iter, patience=patience).predict(held, [label])
            return scored.agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0]

        with ThreadPool(max(1, parallelism)) as pool:
            for i, e in enumerate(pool.map(inheritable_thread_target(train.sparkSession)(one), points, chunksize=1)):
                if e is not None:
                    errors[i].append(float(e))
    means = [sum(e) / len(e) if e else math.inf for e in errors]
    best = min(range(len(points)), key=means.__getitem__)
    model = fit(train, features, label, **points[best], max_iter=max_iter, patience=patience, id_col=id_col)
    model.n_fits = folds * len(points)
    return model, points[best], means[best]
