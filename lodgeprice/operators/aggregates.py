"""Aggregations G1–G14. Scalar results come back as one-row DataFrames; every
aggregate here is a single pass with map-side partial aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import DEFAULT_AVERAGES
from ..functions.scalar import days_between
from .quantiles import exact_quantiles

#: Most 0/1 columns that one category may become in the wide feature table.
FLAG_COLUMNS = 10_000


def distinct_table(df: DataFrame, col: str) -> DataFrame:
    """The distinct non-null values of a column, as a table of any size."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def distinct_values(df: DataFrame, col: str, most: int = FLAG_COLUMNS) -> list[str]:
    """G3 for column names: the sorted domain of a category, one future 0/1 column a value.

    A table of more than ``most`` flags cannot be planned, so such a column is an
    error here; nothing is cut. ``distinct_table`` has no such bound.
    """
    rows = distinct_table(df, col).orderBy(col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {col} has more than {most} distinct values, too many for 0/1 columns")
    return [r[0] for r in rows]


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """G4 (table form): frequency per non-null value, most frequent first, ties by value."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )


def top_values(df: DataFrame, col: str, n: int) -> list[str]:
    """The n most frequent non-null values (ties broken by value, ascending)."""
    return [r[0] for r in value_counts(df, col).limit(n).collect()]


def safe_means(features: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """G1: the 13-key default table; mean of non-nulls, else the fixed default.

    ``num_listings`` comes from the raw table's listing count, the rest from the
    feature table (column names mapped as the original does).
    """
    source_of = {
        "host_experience_days": "host_experience",
        "review_scores_rating": "review_scores_rating",
        "review_scores_accuracy": "review_scores_accuracy",
        "review_scores_cleanliness": "review_scores_cleanliness",
        "review_scores_checkin": "review_scores_checkin",
        "review_scores_communication": "review_scores_communication",
        "review_scores_location": "review_scores_location",
        "review_scores_value": "review_scores_value",
        "number_of_reviews": "number_of_reviews",
        "bedrooms": "bedrooms",
        "beds": "beds",
        "bathrooms": "bathrooms",
    }
    exprs = []
    for key, src in source_of.items():
        mean = F.avg(F.col(src).cast("double")) if src in features.columns else F.lit(None).cast("double")
        exprs.append(F.coalesce(mean, F.lit(DEFAULT_AVERAGES[key])).alias(key))
    feats = features.agg(*exprs)
    if raw is not None and "host_total_listings_count" in raw.columns:
        nl = raw.agg(F.coalesce(F.avg(F.col("host_total_listings_count").cast("double")),
                                F.lit(DEFAULT_AVERAGES["num_listings"])).alias("num_listings"))
    else:
        nl = feats.sparkSession.range(1).select(F.lit(DEFAULT_AVERAGES["num_listings"]).alias("num_listings"))
    row = {**feats.first().asDict(), **nl.first().asDict()}
    ordered = [(k, float(row[k])) for k in DEFAULT_AVERAGES]
    return features.sparkSession.createDataFrame([tuple(v for _, v in ordered)], ", ".join(f"{k} double" for k, _ in ordered))


def raw_means(raw: DataFrame) -> DataFrame:
    """The 13-key default table from raw listings, one pass: plain column means, host experience from its dates.

    Without ``last_scraped`` the experience counts to today. The review and
    listing-count rules follow the original; a key whose column is missing or
    holds no value takes its fixed default.
    """
    source_of = {k: k for k in DEFAULT_AVERAGES} | {"num_listings": "host_total_listings_count"}
    if "host_experience" in raw.columns:
        source_of["host_experience_days"] = "host_experience"
    elif "host_since" in raw.columns:
        until = "last_scraped" if "last_scraped" in raw.columns else F.current_date()
        raw = raw.withColumn("host_experience_days", days_between("host_since", until))
    return raw.agg(*[
        F.coalesce(F.avg(F.col(src).cast("double")) if src in raw.columns else F.lit(None), F.lit(DEFAULT_AVERAGES[key])).alias(key)
        for key, src in source_of.items()])


def host_experience_mean(raw: DataFrame) -> DataFrame:
    """Mean days from host_since to last_scraped; unparsable dates are skipped."""
    return raw.agg(F.avg(days_between("host_since", "last_scraped").cast("double")).alias("host_experience_days"))


def regression_kpis(df: DataFrame, y: str = "price", p: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Rmse, mae, r2, mape (%) in one pass; ``by`` groups (e.g. M20's ``set``)."""
    e = F.col(p).cast("double") - F.col(y).cast("double")
    yd = F.col(y).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / (F.var_pop(yd) * F.count(yd))).alias("r2"),
        (F.avg(F.abs(e) / F.greatest(F.abs(yd), F.lit(1e-8))) * 100).alias("mape"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def scoring_summary(df: DataFrame, y: str = "price", p: str = "prediction") -> DataFrame:
    """Count, rmse, mean actual, mean predicted."""
    e = F.col(p) - F.col(y)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
    )


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column mean, std (fallback when not > 0), binary (values in {0,1}), non_negative.

    Every task folds its rows into one row a column, batch by batch; those rows are merged by
    column. (A wide aggregate of four functions a column is too large for generated code.)
    """
    part = "i int, n double, mean double, m2 double, mn double, bin boolean"
    names = [f.split()[0] for f in part.split(", ")]

    def partial(batches):
        total: dict[int, tuple] = {}
        for b in batches:
            for i in range(len(cols) if b.num_rows else 0):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                own = _column_part(x, bool(np.isin(x, (0.0, 1.0)).all()) and len(x) == b.num_rows)
                total[i] = _merged_parts(total[i], own) if i in total else own
        if total:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (i, *t))) for i, t in total.items()], schema=_PART)

    def merge(table):
        rows = [tuple(r.values()) for r in table.to_pylist()]
        i, total = rows[0][0], rows[0][1:]
        for r in rows[1:]:
            total = _merged_parts(total, r[1:])
        return pa.Table.from_pylist([dict(zip(names, (i, *total)))], schema=_PART)

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(partial, part)
    found = parts.groupBy("i").applyInArrow(merge, part)
    stacked = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, col string").join(found, "i", "left").select(
        "i", "col", F.when(F.col("n") > 0, F.col("mean")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("s"),
        F.when(F.col("n") > 0, F.col("mn")).alias("mn"), F.col("bin").alias("binary"))
    std = F.when(F.col("s") > 0, F.col("s")).otherwise(F.greatest(F.abs(F.col("mean")) * 0.1, F.lit(1e-3)))
    return stacked.orderBy("i").select("col", "mean", std.alias("std"), F.coalesce("binary", F.lit(True)).alias("binary"),
                                       (F.col("mn") >= 0).alias("non_negative"))


_PART = pa.schema([("i", pa.int32()), ("n", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64()), ("mn", pa.float64()),
                   ("bin", pa.bool_())])


def _column_part(x: np.ndarray, binary: bool) -> tuple:
    """(count, mean, squared deviations, least value, binary) of some values; NaN counts as the largest."""
    if not len(x):
        return 0.0, 0.0, 0.0, float("inf"), binary
    with np.errstate(invalid="ignore"):
        mean = x.mean()
        low = float("nan") if np.isnan(x).all() else np.nanmin(x)
        return float(len(x)), float(mean), float(((x - mean) ** 2).sum()), float(low), binary


def _merged_parts(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return (*(a if a[0] else b)[:4], a[4] and b[4])
    n, gap = a[0] + b[0], b[1] - a[1]
    low = min(x for x in (a[3], b[3]) if x == x) if a[3] == a[3] or b[3] == b[3] else a[3]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, low, a[4] and b[4]


def error_summary(df: DataFrame, y: str = "price", p: str = "prediction") -> DataFrame:
    """Absolute error mean/median/p90; relative error mean/median in percent."""
    ae = F.abs(F.col(p) - F.col(y))
    errs = df.select(ae.alias("abs_err"), (ae / F.greatest(F.col(y), F.lit(1e-6))).alias("rel_err"))
    means = errs.agg(F.avg("abs_err").alias("m_abs"), F.avg("rel_err").alias("m_rel"), F.count("abs_err").alias("n")).first()
    med_abs, p90_abs = exact_quantiles(errs, "abs_err", [0.5, 0.9])
    (med_rel,) = exact_quantiles(errs, "rel_err", [0.5])
    spark = df.sparkSession
    return spark.createDataFrame(
        [(int(means["n"]), means["m_abs"], med_abs, p90_abs,
          None if means["m_rel"] is None else means["m_rel"] * 100,
          None if med_rel is None else med_rel * 100)],
        "n long, abs_err_mean double, abs_err_median double, abs_err_p90 double, rel_err_mean_pct double, "
        "rel_err_median_pct double",
    )


def terciles(df: DataFrame, col: str = "price_clean") -> tuple[float | None, float | None]:
    """Exact linear-interpolated 1/3 and 2/3 quantiles."""
    lo, hi = exact_quantiles(df, col, [1 / 3, 2 / 3])
    return lo, hi


def leaderboard(metrics: DataFrame) -> DataFrame:
    """G11 + O2: label without '.joblib', sorted by rmse, gap to the best in percent, rank."""
    best = metrics.agg(F.min("rmse")).first()[0]
    return (
        metrics.select(
            "model", "rmse",
            F.regexp_replace("model", r"\.joblib$", "").alias("label"),
            ((F.col("rmse") / F.lit(best) - 1.0) * 100).alias("pct_over_best"),
        )
        # the registry holds one row per model (tens of rows), so a global window is fine here
        .withColumn("rank", F.rank().over(Window.orderBy("rmse")))
        .orderBy("rmse", "model")
    )


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from min to max; the last bin is closed."""
    b = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = df.where(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    return edges.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_summary(df: DataFrame, col: str) -> DataFrame:
    """q1, median, q3 and whiskers (extreme values within 1.5·IQR of the box)."""
    q1, med, q3 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    spark = df.sparkSession
    if q1 is None:
        return spark.createDataFrame([], "q1 double, median double, q3 double, whisker_lo double, whisker_hi double")
    iqr = q3 - q1
    x = F.col(col)
    w = df.agg(
        F.min(F.when(x >= F.lit(q1 - 1.5 * iqr), x)).alias("whisker_lo"),
        F.max(F.when(x <= F.lit(q3 + 1.5 * iqr), x)).alias("whisker_hi"),
    ).first()
    return spark.createDataFrame([(q1, med, q3, w["whisker_lo"], w["whisker_hi"])],
                                 "q1 double, median double, q3 double, whisker_lo double, whisker_hi double")


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of ``col``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
