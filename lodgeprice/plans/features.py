"""U2 ``engineer_features`` and U3 ``build_request_features``.

Both use the same column functions; ``mode`` selects the training or serving
rule where the original differs (std ddof, null listing count, property other,
accommodates 0 handling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AMENITIES, DEFAULT_AVERAGES, MAX_DISTANCE_KM, REVIEW_COLUMNS, ROOM_TYPES, SERVED_FEATURE_ORDER
from ..functions.encode import amenity_names, multi_hot, one_hot, one_hot_top
from ..functions.geo import landmark_distances, landmark_names
from ..functions.rowstats import row_mean, row_min, row_std, row_sum
from ..functions.scalar import fill_default, per_person, threshold_flag
from ..functions.text import column_name, slug, slug_col
from .preprocess import FeatureSpec

DERIVED = [
    "bedroom_density", "beds_per_person", "bathrooms_per_person", "total_rooms",
    "avg_dist_to_landmark", "review_score_std", "min_dist_to_landmark", "total_amenities",
]


def derived_columns(mode: str = "train") -> list:
    """F13–F18 as column expressions over an encoded table."""
    dists = landmark_names()
    return [
        per_person("bedrooms", mode=mode).alias("bedroom_density"),
        per_person("beds", mode=mode).alias("beds_per_person"),
        per_person("bathrooms", mode=mode).alias("bathrooms_per_person"),
        (F.col("bedrooms") + F.col("bathrooms")).alias("total_rooms"),
        row_mean(dists).alias("avg_dist_to_landmark"),
        row_std(REVIEW_COLUMNS, ddof=1 if mode == "train" else 0).alias("review_score_std"),
        row_min(dists).alias("min_dist_to_landmark"),
        row_sum(amenity_names()).alias("total_amenities"),
    ]


def engineer_features(pre: DataFrame) -> DataFrame:
    """The preprocessed table plus the 8 derived columns."""
    return pre.select("*", *derived_columns("train"))


def feature_columns(spec: FeatureSpec) -> list[str]:
    """Model input names, bound by name (not by position)."""
    return spec.base_feature_columns() + DERIVED


def serving_spec() -> FeatureSpec:
    """The category lists the serving side knows (its option lists)."""
    from ..constants import NEIGHBOURHOODS, PROPERTY_TYPES

    return FeatureSpec(room_types=list(ROOM_TYPES), districts=list(NEIGHBOURHOODS),
                       top_property_types=list(PROPERTY_TYPES[:-1]))


def build_request_features(req: DataFrame, spec: FeatureSpec, averages: dict[str, float] | None = None,
                           keep: list[str] | None = None) -> DataFrame:
    """Request rows -> feature rows with the spec's feature names.

    Missing numbers: the request's value, else the average table (F19), else
    the fixed default. ``use_averages`` does not change the result: every
    field is filled either way, as in the original.
    """
    avg = {**DEFAULT_AVERAGES, **(averages or {})}

    def filled(c: str, key: str):
        return fill_default(c, F.lit(avg.get(key)), F.lit(DEFAULT_AVERAGES[key]))

    keep = keep or ["req_id"]
    base = req.select(
        *keep,
        "latitude", "longitude", "neighbourhood", "room_type", "property_type",
        F.col("accommodates").cast("int").alias("accommodates"),
        filled("bedrooms", "bedrooms").alias("bedrooms"),
        filled("beds", "beds").alias("beds"),
        filled("bathrooms", "bathrooms").alias("bathrooms"),
        filled("number_of_reviews", "number_of_reviews").alias("number_of_reviews"),
        filled("host_experience_days", "host_experience_days").alias("host_experience"),
        threshold_flag(F.col("num_listings"), fill=F.coalesce(F.lit(avg.get("num_listings")), F.lit(1.0))).alias(
            "is_professional_host"),
        *[filled(c, c).alias(c) for c in REVIEW_COLUMNS],
        F.coalesce(F.col("amenities"), F.array().cast("array<string>")).alias("_amen"),
    )
    req_slug = slug_col("neighbourhood", "district", collapse=False)
    district_flags = [
        F.coalesce(req_slug == F.lit(name[len("is_"):]), F.lit(False)).cast("int").alias(name)
        for name in [column_name("is_", d, "district") for d in spec.districts]
    ]
    encoded = base.select(
        *keep, "latitude", "longitude", "accommodates", "bedrooms", "beds", "bathrooms", "number_of_reviews",
        "host_experience", "is_professional_host", *REVIEW_COLUMNS,
        *one_hot("room_type", spec.room_types, "is_", "room"),
        *district_flags,
        *landmark_distances("latitude", "longitude"),
        *multi_hot("_amen", AMENITIES),
        *one_hot_top("property_type", spec.top_property_types, mode="serve"),
    )
    out = encoded.select("*", *derived_columns("serve"))
    return out.select(*keep, "latitude", "longitude", *feature_columns(spec))


def served_features(req: DataFrame, averages: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """U3 for a model that was trained elsewhere and reads by position: ``keep``, then the features in the served order."""
    keep = keep or ["req_id"]
    out = build_request_features(req, serving_spec(), averages, keep)
    missing = set(SERVED_FEATURE_ORDER) - set(out.columns)
    if missing:
        raise ValueError(f"features that the serving lists don't give: {sorted(missing)}")
    return out.select(*keep, *SERVED_FEATURE_ORDER)


def district_key(name: str) -> str:
    """Serving-side district key of a display name (no underscore collapsing)."""
    return "is_" + slug(name, "district")


__all__ = [
    "DERIVED", "MAX_DISTANCE_KM", "build_request_features", "derived_columns", "engineer_features",
    "feature_columns", "served_features", "serving_spec", "district_key",
]
