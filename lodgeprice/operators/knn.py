"""Z-score scaling (M1), k-nearest similar listings (J4) and the k-NN regressor (M5).

The neighbours come from ``neighbours.nearest_rows``: blocks of rows with bounding
boxes, an upper bound from each query's own cell, and only the blocks within it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, KNN_FEATURES, SIMILAR_K
from ..functions.text import first_number, money
from .filters import complete_knn_rows
from .neighbours import nearest_rows
from .quantiles import exact_medians
from .split import fold_of

# the original grid of the regressor
KNN_KS, KNN_WEIGHTS, KNN_PS = (3, 5, 7, 10, 15), ("uniform", "distance"), (1, 2)


def knn_table(raw: DataFrame) -> DataFrame:
    """P6 input: id + the 7 similarity features from raw listings (outliers included), no nulls."""
    df = raw.select("id", "latitude", "longitude", "accommodates", "bedrooms", "beds",
                    first_number("bathrooms_text").alias("bathrooms_numeric"), money("price").alias("price_clean"))
    return complete_knn_rows(df.select("id", *[F.col(c).cast("double").alias(c) for c in KNN_FEATURES]))


def zscore_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M1 fit: mean and population std per column; a zero std scales by 1 (as the original scaler)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m_{i}"], row[f"s_{i}"]
        out[c] = (0.0 if m is None else float(m), 1.0 if (s is None or s == 0 or math.isnan(s)) else float(s))
    return out


def zscore(df: DataFrame, stats: dict[str, tuple[float, float]], keep: list[str]) -> DataFrame:
    """M1 transform: (x - mean) / std per column, one projection."""
    return df.select(*keep, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in stats.items()])


def _vectors(df: DataFrame, cols: list[str], id_col: str, group: Column | None = None) -> DataFrame:
    """``id, grp, v`` as the block search takes them; rows with a null in a feature have no distance and are left out."""
    whole = df.where(" and ".join(f"`{c}` is not null" for c in cols))
    return whole.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if group is None else group).cast("int").alias("grp"),
                        F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))


def nearest(queries: DataFrame, candidates: DataFrame, cols: list[str], k: int, qid: str = "qid",
            cid: str = "id", p: int = 2) -> DataFrame:
    """Top-k candidates per query by Minkowski distance (p = 1 or 2); ties by candidate id.

    Ids are whole numbers, distinct in ``queries``. Returns ``(qid, cid, dist, rank)`` for ranks 1..min(k, n).
    """
    found = nearest_rows(_vectors(queries, cols, qid), _vectors(candidates, cols, cid), len(cols), k, p)
    return found.select(F.col("qid").alias(qid), F.posexplode("near").alias("rank", "n")).select(
        qid, F.col("n.cid").alias(cid), F.col("n.dist").alias("dist"), (F.col("rank") + 1).alias("rank"))


def similar_ids(raw: DataFrame, focus: DataFrame, k: int = SIMILAR_K, focus_id: str = "qid") -> DataFrame:
    """For each focus row, the k (= min(100, n)) most similar listings in z-scored feature space.

    ``focus`` has ``focus_id`` and any of the 7 feature columns; null focus
    values take the column median of the candidate table.
    """
    bundle = knn_table(raw).persist()
    stats = zscore_stats(bundle, KNN_FEATURES)
    med = exact_medians(bundle, KNN_FEATURES)
    fcols = []
    for c in KNN_FEATURES:
        given = F.col(c).cast("double") if c in focus.columns else F.lit(None).cast("double")
        fcols.append(F.coalesce(given, F.lit(med[c])).alias(c))
    f = focus.select(F.col(focus_id).alias("qid"), *fcols)
    zb = zscore(bundle, stats, ["id"])
    zf = zscore(f, stats, ["qid"])
    out = nearest(zf, zb, KNN_FEATURES, k, qid="qid", cid="id").withColumnRenamed("qid", focus_id)
    bundle.unpersist()
    return out


def _estimate(k: int, weights: str) -> Column:
    """The prediction from the first ``k`` of ``near``, an array of (dist, label) in order."""
    use = F.slice("near", 1, k)

    def mean(rows, weight):
        zero = F.lit(0.0)
        top = F.aggregate(rows, zero, lambda s, n: s + weight(n) * n["label"])
        return F.when(F.size(rows) > 0, top / F.aggregate(rows, zero, lambda s, n: s + weight(n)))

    plain = mean(use, lambda n: F.lit(1.0))
    if weights == "uniform":
        return plain
    same = F.filter(use, lambda n: n["dist"] == 0)
    return F.when(F.size(same) > 0, mean(same, lambda n: F.lit(1.0))).otherwise(mean(use, lambda n: 1.0 / n["dist"]))


def _labelled(found: DataFrame, labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """``qid, near``: neighbours as (dist, label), in order."""
    long = found.select("qid", F.posexplode_outer("near").alias("rank", "n"))
    own = labels.select(F.col(id_col).cast("long").alias("cid"), F.col(label).cast("double").alias("label"))
    both = long.select("qid", "rank", "n.dist", "n.cid").join(own, "cid", "left")
    rows = both.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(
        F.col("cid").isNotNull(), F.struct("rank", "dist", "label")))).alias("near"))
    return rows.select("qid", F.transform("near", lambda n: F.struct(n["dist"], n["label"])).alias("near"))


def knn_regress(train: DataFrame, test: DataFrame, features: list[str], k: int = 5, weights: str = "uniform",
                p: int = 2, label: str = "price", id_col: str = "id") -> DataFrame:
    """M5: z-score on train, k nearest train rows per test row, uniform or 1/distance weighted mean.

    With ``distance`` weights, a test row with zero-distance neighbours gets the
    mean label of those neighbours (as the original estimator does).
    """
    scale = [s for _, s in zscore_stats(train, features).values()]
    found = nearest_rows(_vectors(test, features, id_col), _vectors(train, features, id_col), len(features), k, p, {0: scale})
    return _labelled(found, train, label, id_col).select(F.col("qid").alias(id_col), _estimate(k, weights).alias("prediction"))


def knn_search(train: DataFrame, features: list[str], ks=KNN_KS, weights=KNN_WEIGHTS, ps=KNN_PS, folds: int = CV_FOLDS,
               label: str = "price", id_col: str = "id", points: list[tuple] | None = None) -> tuple[dict, float]:
    """M15 for M5: the grid point of the lowest mean RMSE over the stable folds, and that RMSE.

    ``points`` (k, weights, p) replaces the whole grid, as in M16.

    One pass per ``p`` answers all folds: a row looks for neighbours outside its own fold, scaled by the deviations
    of the rows outside it (means cancel in distances). All k and weights are read off the same neighbours. Ties go
    to the first point.
    """
    wanted = points if points is not None else [(k, w, p) for p in ps for k in ks for w in weights]
    data = train.withColumn("_fold", fold_of(id_col, folds)).persist()
    sums = data.groupBy("_fold").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features)
                                       for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()
    scales = {}
    for f in range(folds):
        rest = [r for r in sums if r["_fold"] != f]
        scales[f] = [_pooled_std([(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rest]) for i in range(len(features))]
    scores = {}
    for p in sorted({p for _, _, p in wanted}):
        points = [(k, w) for k, w, q in wanted if q == p]
        vectors = _vectors(data, features, id_col, F.col("_fold"))
        near = _labelled(nearest_rows(vectors, vectors, len(features), max(k for k, _ in points), p, scales, apart=True), data, label, id_col)
        guess = near.select("qid", *[_estimate(k, w).alias(f"g{i}") for i, (k, w) in enumerate(points)])
        own = data.select(F.col(id_col).cast("long").alias("qid"), "_fold", F.col(label).alias("_y"))
        rows = guess.join(own, "qid").groupBy("_fold").agg(
            *[F.sqrt(F.avg((F.col(f"g{i}") - F.col("_y")) ** 2)).alias(f"r{i}") for i in range(len(points))]).collect()
        for i, (k, w) in enumerate(points):
            errors = [r[f"r{i}"] for r in sorted(rows, key=lambda r: r["_fold"]) if r[f"r{i}"] is not None]
            scores[k, w, p] = sum(errors) / len(errors)
    data.unpersist()
    k, w, p = min(scores, key=scores.get)
    return {"k": k, "weights": w, "p": p}, scores[k, w, p]


def _pooled_std(parts: list) -> float:
    """Population deviation of several parts from their (count, mean, variance); 1 if there is none."""
    parts = [(n, m, v) for n, m, v in parts if n]
    total = sum(n for n, _, _ in parts)
    if not total:
        return 1.0
    mean = sum(n * m for n, m, _ in parts) / total
    var = sum(n * (v + (m - mean) ** 2) for n, m, v in parts) / total
    return math.sqrt(var) if var > 0 else 1.0
