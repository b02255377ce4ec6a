"""Learning operators M2–M18 on Spark ML.

Every model is a ``Pipeline``: ``VectorAssembler`` over the spec's feature
names (bound by name) -> optional scaler -> estimator, optionally wrapped in
a log-price target (M14: ``SQLTransformer`` before and after). Searches use
the stable folds (T2), which do not change with partitioning.

Re-aimed boosters (M10–M12): Spark ML has one gradient-boosted tree family
(``GBTRegressor``). It has no leaf L1/L2 penalty, no leaf-wise growth and no
ordered boosting, so those settings of the original configurations have no
equivalent; depth, rounds, step size, row and column sampling are mapped.
Published RMSE numbers of those libraries are not claimed.

Boosting is fitted on all rows and runs all its rounds. Histogram boosting alone
holds a tenth of the rows back (a hash of the id) and stops after 10 rounds
without a gain there, as the original does: it is fitted with 20 rounds, then with
twice as many until such a stop lies within them, and once more with the rounds up
to the stop. Rounds are the same whatever the number asked for, so that this is
the model of one run with patience, for at most four times its rounds.

Ridge and lasso come from the sums of products of one pass (``operators/moments``).
A search fits once per fold and setting at the largest number of rounds; smaller
numbers are read off the errors of its first rounds. Independent fits run side by
side.
"""

from __future__ import annotations

import ast
import itertools
import math
import random
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, SEARCH_ITER, SPLIT_SEED
from ..operators.aggregates import regression_kpis
from ..operators import moments
from ..operators.knn import knn_regress, knn_search
from ..operators.split import fold_of, is_test
from ..sources.io import parquet_roundtrip

SEED = SPLIT_SEED
#: Split statistics that a tree learner may hold in each task, by default; smaller heaps take more passes.
TREE_MEM_MB = 256
#: Fits that run at the same time: each is a chain of small jobs that leaves most cores idle.
PARALLEL_FITS = 8
#: Rounds without a gain on the rows held back after which histogram boosting stops, and the gain that counts.
PATIENCE, GAIN = 10, 1e-7


@dataclass
class Candidate:
    name: str
    make: callable  # (n_train, y_std) -> estimator
    scale: bool = False
    log_target: bool = False
    grid: dict = field(default_factory=dict)  # param name -> values (reference grids)
    line: str | None = None  # "ridge" or "lasso": solved from moments
    patient: bool = False  # stops by patience


def _linear(n, ystd):
    return LinearRegression(regParam=0.0, solver="normal", standardization=False)


def _tree(n, ystd):
    return DecisionTreeRegressor(maxDepth=10, minInstancesPerNode=2, maxBins=256, seed=SEED)


def _forest(n, ystd):
    return RandomForestRegressor(numTrees=200, maxDepth=15, minInstancesPerNode=1, featureSubsetStrategy="all",
                                 maxBins=128, seed=SEED)


def n_trees(model: PipelineModel) -> int | None:
    """Number of trees of the fitted estimator; None if it is no ensemble."""
    return next((s.getNumTrees for s in model.stages if hasattr(s, "getNumTrees")), None)


def _gbt(rounds, step, depth, subsample=1.0, features="all", min_inst=1, bins=128):
    def make(n, ystd):
        return GBTRegressor(maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=subsample,
                            featureSubsetStrategy=features, minInstancesPerNode=min_inst, maxBins=bins, seed=SEED)
    return make


def held_back(id_col: str = "id"):
    """True for a tenth of the rows, by a hash of the id."""
    return F.pmod(F.xxhash64(id_col), F.lit(10)) == 0


def stop_round(errors: list[float], patience: int = PATIENCE, gain: float = GAIN) -> int | None:
    """Rounds run until ``patience`` of them in a row brought no gain on the best error; None if that never happens."""
    best, since = float("inf"), 0
    for i, e in enumerate(errors):
        if e < best - gain:
            best, since = e, 0
        else:
            since += 1
            if since >= patience:
                return i + 1
    return None


def _boost_grid(rounds, steps, depths, samples, features=None, min_inst=None) -> dict:
    """The original boosters' grids as far as Spark has the parameter (no leaf penalties, leaf counts, child weights)."""
    grid = {"maxIter": rounds, "stepSize": steps, "maxDepth": depths, "subsamplingRate": samples}
    return grid | ({"featureSubsetStrategy": features} if features else {}) | ({"minInstancesPerNode": min_inst} if min_inst else {})


_XGB_SAMPLES = ([0.85, 0.9, 0.95], ["0.85", "0.9", "0.95"])

CANDIDATES: dict[str, Candidate] = {c.name: c for c in [
    Candidate("linear_regression", _linear, scale=True),
    Candidate("linear_regression_log", _linear, log_target=True),
    Candidate("ridge", None, scale=True, line="ridge", grid={"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}),
    Candidate("ridge_unscaled", None, line="ridge", grid={"alpha": [0.1, 1.0, 5.0]}),
    Candidate("lasso", None, scale=True, line="lasso", grid={"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}),
    Candidate("decision_tree", _tree, grid={"maxDepth": [5, 10, 15, 20], "minInstancesPerNode": [1, 2, 4]}),
    Candidate("random_forest", _forest, grid={"numTrees": [100, 200, 300], "maxDepth": [10, 15, 20],
                                              "minInstancesPerNode": [1, 2]}),
    Candidate("xgboost_tuned", _gbt(1200, 0.04, 7, 0.9, "0.9"),
              grid=_boost_grid([1000, 1200, 1400], [0.03, 0.04, 0.05], [6, 7, 8], *_XGB_SAMPLES)),
    Candidate("xgboost_log_enhanced", _gbt(1300, 0.03, 7, 0.9, "0.9"), log_target=True,
              grid=_boost_grid([1100, 1300, 1500], [0.025, 0.03, 0.035], [6, 7, 8], *_XGB_SAMPLES)),
    Candidate("xgboost_improved", _gbt(1400, 0.028, 7, 0.9, "0.9"),
              grid=_boost_grid([1200, 1400, 1600], [0.026, 0.028, 0.03], [6, 7, 8], *_XGB_SAMPLES)),
    Candidate("lightgbm_tuned", _gbt(900, 0.05, 6, 0.85, "0.85"),
              grid=_boost_grid([700, 900, 1100], [0.03, 0.05, 0.07], [5, 6, 7], [0.8, 0.85, 0.9], ["0.8", "0.85", "0.9"], [10, 15, 20])),
    Candidate("catboost_tuned", _gbt(700, 0.05, 8), grid=_boost_grid([600, 800, 1000], [0.03, 0.05, 0.07], [6, 8, 10], [0.8, 0.9, 1.0])),
    Candidate("sklearn_gbr", _gbt(400, 0.05, 4, 0.9, "sqrt", 2)),
    Candidate("histgb_tuned", _gbt(400, 0.1, 12, min_inst=10, bins=256), patient=True, grid={
        "maxIter": [200, 400, 600, 800], "stepSize": [0.03, 0.05, 0.08, 0.1], "maxDepth": [6, 8, 10, 12],
        "minInstancesPerNode": [10, 20, 30]}),
]}

STACK_BASES = ["xgboost_improved", "catboost_tuned", "lightgbm_tuned", "xgboost_log_enhanced"]
#: The original benchmark's candidates and its stack, without the perceptron.
BENCHMARK = ["linear_regression", "ridge", "lasso", "knn", "decision_tree", "random_forest", "xgboost_tuned",
             "xgboost_log_enhanced", "xgboost_improved", "lightgbm_tuned", "catboost_tuned", "sklearn_gbr", "histgb_tuned",
             "stacking_ensemble"]
#: All of the original benchmark, in its order.
LEADERBOARD = [*BENCHMARK[:-1], "mlp_tuned", BENCHMARK[-1]]


def _pipeline(c: Candidate, features: list[str], label: str, n: int, ystd: float, est=None) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features" if c.scale else "features")]
    if c.scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    est = est or c.make(n, ystd)
    target = label
    if c.log_target:
        stages.append(SQLTransformer(statement=f"SELECT *, log1p({label}) AS _log_label FROM __THIS__"))
        target = "_log_label"
    est.setFeaturesCol("features").setLabelCol(target).setPredictionCol("_raw_pred" if c.log_target else "prediction")
    stages.append(est)
    if c.log_target:
        stages.append(SQLTransformer(statement="SELECT *, expm1(_raw_pred) AS prediction FROM __THIS__"))
    return Pipeline(stages=stages)


def _label_stats(train: DataFrame, label: str) -> tuple[int, float]:
    r = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    return int(r["n"]), float(r["s"] or 1.0)


def _line_model(line: moments.Line, features: list[str]) -> PipelineModel:
    """The line as a pipeline that can be saved: one projection."""
    terms = [f"{line.intercept!r}D"] + [f"{float(w)!r}D * `{c}`" for c, w in zip(features, line.coef) if w]
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS prediction FROM __THIS__")])


def _patient(c: Candidate, train: DataFrame, features: list[str], label: str, params: dict, mem_mb: int) -> PipelineModel:
    """Boosting that stops by patience on the rows held back, after ``maxIter`` rounds at the latest."""
    own, held = train.where(~held_back()).persist(), train.where(held_back()).persist()
    most = params.get("maxIter") or c.make(0, 1.0).getMaxIter()
    rounds = min(2 * PATIENCE, most)
    while True:
        model = _pipeline(c, features, label, 0, 1.0, _estimator(c, 0, 1.0, params | {"maxIter": rounds}, mem_mb)).fit(own)
        stop = stop_round(_errors(model, held))
        if stop is not None or rounds == most:
            break
        rounds = min(2 * rounds, most)
    if stop is not None and stop < rounds:
        model = _pipeline(c, features, label, 0, 1.0, _estimator(c, 0, 1.0, params | {"maxIter": stop}, mem_mb)).fit(own)
    own.unpersist()
    held.unpersist()
    return model


def _errors(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Mean squared error of a boosted model after each of its rounds."""
    last = next(s for s in model.stages if isinstance(s, GBTRegressionModel))
    ready = rows
    for s in model.stages:
        if s is last:
            return last.evaluateEachIteration(ready, "squared")
        ready = s.transform(ready)


def fit(name: str, train: DataFrame, features: list[str], label: str = "price",
        params: dict | None = None, mem_mb: int = TREE_MEM_MB) -> PipelineModel:
    """Fit one candidate (optionally with explicit grid parameters) on all rows of ``train``."""
    c, params = CANDIDATES[name], params or {}
    if c.line:
        m = moments.fold_moments(train, features, label)[0]
        return _line_model(moments.SOLVERS[c.line](m, params.get("alpha", 1.0), c.scale), features)
    if c.patient:
        return _patient(c, train, features, label, params, mem_mb)
    n, ystd = _label_stats(train, label)
    return _pipeline(c, features, label, n, ystd, _estimator(c, n, ystd, params, mem_mb)).fit(train)


def _estimator(c: Candidate, n: int, ystd: float, params: dict, mem_mb: int = TREE_MEM_MB):
    est = c.make(n, ystd)
    if est.hasParam("maxMemoryInMB"):
        est._set(maxMemoryInMB=mem_mb)
    for k, v in params.items():
        est._set(**{k: v})
    return est


def grid_points(grid: dict, n_iter: int | None = None, seed: int = SEED) -> list[dict]:
    """M15 (all combinations) or M16 (a seeded sample of ``n_iter`` combinations, fewer if the grid is smaller)."""
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if n_iter is None or n_iter >= len(combos):
        return combos
    return random.Random(seed).sample(combos, n_iter)


def _rmse(model: PipelineModel, rows: DataFrame, label: str) -> float:
    return float(predict(model, rows, [label]).agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0])


def _search_errors(c: Candidate, name: str, data: DataFrame, features: list[str], label: str, points: list[dict],
                   folds: int, parallelism: int, mem_mb: int) -> tuple[list[list[float]], int]:
    """RMSE of every point on every fold, and the number of fits.

    Points that differ in ``maxIter`` alone are one fit at the largest, whose first rounds answer for the others;
    this does not hold on a log target, where the errors of the rounds are of the logarithm.
    """
    boosted = "maxIter" in c.grid and not c.log_target
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        key = tuple((k, v) for k, v in sorted(p.items()) if k != "maxIter") if boosted else (i,)
        groups.setdefault(key, []).append(i)
    jobs = [(f, key) for f in range(folds) for key in groups]

    def one(job):
        f, key = job
        mine = groups[key]
        train, held = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        params = points[mine[0]] if not boosted else dict(key) | {"maxIter": max(points[i]["maxIter"] for i in mine)}
        model = fit(name, train, features, label, params, mem_mb)
        if not boosted:
            return {mine[0]: _rmse(model, held, label)}
        errors = _errors(model, held)
        return {i: math.sqrt(errors[min(points[i]["maxIter"], len(errors)) - 1]) for i in mine}

    table = [[math.nan] * folds for _ in points]
    with ThreadPool(max(1, parallelism)) as pool:
        for (f, _), got in zip(jobs, pool.map(inheritable_thread_target(data.sparkSession)(one), jobs, chunksize=1)):
            for i, e in got.items():
                table[i][f] = e
    return table, len(jobs)


def cv_search(name: str, train: DataFrame, features: list[str], label: str = "price",
              n_iter: int | None = SEARCH_ITER, folds: int = CV_FOLDS, parallelism: int = PARALLEL_FITS,
              grid: dict | None = None, mem_mb: int = TREE_MEM_MB) -> tuple[PipelineModel, dict, float]:
    """K-fold search by RMSE over stable folds; refit the best on all training rows.

    Returns (model, best params, mean CV RMSE); the model's ``n_fits`` is the number of fits of the search.
    """
    c = CANDIDATES[name]
    points = grid_points(grid if grid is not None else c.grid, n_iter)
    if not points:
        return fit(name, train, features, label, None, mem_mb), {}, float("nan")
    if c.line:
        by_fold = moments.fold_moments(train, features, label, fold_of("id", folds))
        line, alpha, error = moments.search(c.line, by_fold, [p["alpha"] for p in points], c.scale)
        model = _line_model(line, features)
        model.n_fits = 1
        return model, {"alpha": alpha}, error
    data = train.withColumn("fold", fold_of("id", folds)).persist()
    table, fits = _search_errors(c, name, data, features, label, points, folds, parallelism, mem_mb)
    means = [sum(row) / len(row) for row in table]
    best = min(range(len(points)), key=lambda i: means[i])
    model = fit(name, data, features, label, points[best], mem_mb)
    model.n_fits = fits
    data.unpersist()
    return model, points[best], means[best]


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").cast("double").alias("prediction"))


def _with_prediction(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` and one more column, the model's prediction; a projection, no join."""
    return model.transform(df).select(*df.columns, F.col("prediction").cast("double").alias(name))


def stack(train: DataFrame, features: list[str], bases: list[str], label: str = "price",
          folds: int = CV_FOLDS, alphas: tuple = (0.1, 1.0, 5.0), parallelism: int = PARALLEL_FITS,
          params: dict | None = None):
    """Out-of-fold base predictions + passthrough inputs -> ridge meta model (alpha by CV, inputs unscaled).

    Base predictions are chained onto the same rows, and the meta table is
    written once for the search. Of the independent base fits, ``parallelism``
    run at a time. Returns ``score(df, keep) -> keep, prediction``, whose ``trees``
    holds the number of trees of each base. ``params`` holds settings by base.
    """
    data = train.withColumn("fold", fold_of("id", folds)).persist()
    names = {b: f"p_{b}" for b in bases}
    jobs = [(k, b) for k in [*range(folds), None] for b in bases]  # None: on all rows

    def fit_one(job):
        k, b = job
        return fit(b, data if k is None else data.where(F.col("fold") != k), features, label, (params or {}).get(b))

    with ThreadPool(parallelism) as pool:
        fitted = dict(zip(jobs, pool.map(inheritable_thread_target(data.sparkSession)(fit_one), jobs)))
    oof = None
    for k in range(folds):
        part = data.where(F.col("fold") == k)
        for b in bases:
            part = _with_prediction(fitted[k, b], part, names[b])
        oof = part if oof is None else oof.unionByName(part)
    meta_train = parquet_roundtrip(data.sparkSession, oof.drop("fold"))
    meta, _, _ = cv_search("ridge_unscaled", meta_train, features + list(names.values()), label, n_iter=None,
                           folds=folds, grid={"alpha": list(alphas)})
    full = {b: fitted[None, b] for b in bases}
    data.unpersist()

    def score(df: DataFrame, keep: list[str]) -> DataFrame:
        for b, m in full.items():
            df = _with_prediction(m, df, names[b])
        return predict(meta, df, keep)

    score.trees = {b: n_trees(m) for b, m in full.items()}
    return score


#: A row of the board.
KPI = ("model string, rmse double, mae double, r2 double, mape double, fit_seconds double, params string, n_trees int, "
       "n_fits int")


def _kept(spark, path: str) -> DataFrame | None:
    """The row that an earlier run left there, if any."""
    try:
        return spark.read.schema(KPI).parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def benchmark(features_df: DataFrame, features: list[str], names: list[str], label: str = "price",
              search: bool = False, folder: str | None = None, parallelism: int = PARALLEL_FITS,
              mem_mb: int = TREE_MEM_MB) -> DataFrame:
    """Fit every candidate on the training part, score the test part, KPI table sorted by RMSE.

    ``knn`` is always searched, over k and weights as in the original comparison (p is 2 there; M5 alone has both);
    ``mlp_tuned`` is the perceptron of M13; ``stacking_ensemble`` stacks ``STACK_BASES`` with the settings found before it.
    With a ``folder``, each row is written there as soon as it is known (and the model beside it, where it is one
    that can be saved); a run that finds rows there goes on after them.
    """
    from . import mlp

    spark = features_df.sparkSession
    train = features_df.where(~is_test("id")).persist()
    test = features_df.where(is_test("id")).persist()
    rows, found = [], {}
    for name in names:
        kept = _kept(spark, f"{folder}/{name}.kpi") if folder else None
        kept = kept.first() if kept is not None else None
        if kept:
            rows.append(tuple(kept))
            found[name] = ast.literal_eval(kept["params"])
            continue
        t0 = time.time()
        model, fits = None, None
        if name == "knn":
            params, _ = knn_search(train, features, ps=(2,), label=label)
            scored = knn_regress(train, test, features, label=label, **params).join(test.select("id", label), "id")
        elif name == "mlp_tuned":
            net, params, _ = mlp.search(train, features, label, parallelism=parallelism) if search else (
                mlp.fit(train, features, label), {}, None)
            scored, fits = net.predict(test, ["id", label]), net.n_fits
        elif name == "stacking_ensemble":
            score, params = stack(train, features, STACK_BASES, label, parallelism=parallelism, params=found), {}
            scored = score(test, ["id", label])
        elif search and CANDIDATES[name].grid:
            model, params, _ = cv_search(name, train, features, label, parallelism=parallelism, mem_mb=mem_mb)
        else:
            model, params = fit(name, train, features, label, None, mem_mb), {}
        secs = time.time() - t0
        found[name] = params
        if model is not None:
            scored, fits = predict(model, test, ["id", label]), getattr(model, "n_fits", None)
        k = regression_kpis(scored, y=label).first()
        rows.append((name, float(k["rmse"]), float(k["mae"]), float(k["r2"]), float(k["mape"]), secs,
                     str(params), n_trees(model) if model is not None else None, fits))
        if folder:
            if model is not None:
                model.write().overwrite().save(f"{folder}/{name}.model")
            spark.createDataFrame(rows[-1:], KPI).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.kpi")
    train.unpersist()
    test.unpersist()
    return spark.createDataFrame(rows, KPI).orderBy("rmse")
