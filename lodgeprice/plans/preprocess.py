"""U1 ``preprocess``: raw listings -> wide numeric table.

Steps: P1 keep columns -> F3 host experience -> F4 professional host -> F1
price -> P4 drop null price -> P5 price <= 3000 -> F8 room/district one-hot ->
J5 landmark distances -> F10/F11 amenities -> F2 bathrooms -> F9 property
top-15 -> F12 median imputation -> F6 names.

The data-dependent parts (category domains, top-15, medians) are fitted once
into a small :class:`FeatureSpec`; the transform is then a single projection
that Catalyst keeps in one whole-stage-codegen span.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KEEP_COLUMNS, MAX_TRAIN_PRICE, REVIEW_COLUMNS, TOP_PROPERTY_TYPES
from ..functions.encode import amenity_names, multi_hot, one_hot, one_hot_top
from ..functions.geo import landmark_distances, landmark_names
from ..functions.scalar import days_since, threshold_flag
from ..functions.text import column_name, first_number, json_list, money
from ..operators.aggregates import distinct_values, top_values
from ..operators.quantiles import exact_medians
from ..operators.sparse_onehot import SparseOneHot, vector_column
from ..sources.io import spread_roundtrip

# Columns that may hold nulls after encoding and are imputed by their median.
IMPUTED_COLUMNS = (
    ["host_experience", "accommodates", "bedrooms", "beds", "number_of_reviews"]
    + REVIEW_COLUMNS + ["bathrooms"]
)


@dataclass
class FeatureSpec:
    """Fitted, data-dependent part of preprocessing (small; lives on the driver)."""

    room_types: list[str]
    districts: list[str]
    top_property_types: list[str]
    medians: dict[str, float] = field(default_factory=dict)

    def room_columns(self) -> list[str]:
        return [column_name("is_", v, "room") for v in self.room_types]

    def district_columns(self) -> list[str]:
        return [column_name("is_", v, "district") for v in self.districts]

    def property_columns(self) -> list[str]:
        return [column_name("property_", v, "property") for v in self.top_property_types] + ["property_other"]

    def base_feature_columns(self) -> list[str]:
        return (
            ["accommodates", "bedrooms", "beds", "number_of_reviews"] + REVIEW_COLUMNS
            + ["host_experience", "is_professional_host"]
            + self.room_columns() + self.district_columns() + landmark_names() + amenity_names()
            + ["bathrooms"] + self.property_columns()
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "FeatureSpec":
        return FeatureSpec(**json.loads(text))


def clean(raw: DataFrame) -> DataFrame:
    """Keep columns, derive host fields, parse and bound the price."""
    df = raw.select(*KEEP_COLUMNS)  # a missing column is an analysis error, as intended
    return (
        df.withColumn("host_experience", days_since("host_since"))
        .withColumn("is_professional_host", threshold_flag("host_total_listings_count"))
        .withColumn("price", money("price"))
        .drop("host_since", "host_total_listings_count")
        .where(F.col("price").isNotNull())
        .where(F.col("price") <= F.lit(MAX_TRAIN_PRICE))
    )


def fit_domains(cleaned: DataFrame, top_n: int = TOP_PROPERTY_TYPES) -> FeatureSpec:
    """G3 + G4: observed room types and districts (sorted), top-n property types."""
    return FeatureSpec(
        room_types=distinct_values(cleaned, "room_type"),
        districts=distinct_values(cleaned, "neighbourhood_group_cleansed"),
        top_property_types=top_values(cleaned, "property_type", top_n),
    )


def encode(cleaned: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    """Encodings and distances in one projection (no imputation yet); ``keep`` names raw columns to pass on."""
    passthrough = [*(keep or []), "id", "price", "accommodates", "bedrooms", "beds", "number_of_reviews"] + REVIEW_COLUMNS + [
        "host_experience", "is_professional_host"]
    parsed = cleaned.withColumn("_amen", json_list("amenities"))  # parsed once for all 20 flags
    return parsed.select(
        *passthrough,
        *one_hot("room_type", spec.room_types, "is_", "room"),
        *one_hot("neighbourhood_group_cleansed", spec.districts, "is_", "district"),
        *landmark_distances("latitude", "longitude"),
        *multi_hot("_amen"),
        first_number("bathrooms_text").alias("bathrooms"),
        *one_hot_top("property_type", spec.top_property_types, mode="train"),
    )


def impute(encoded: DataFrame, medians: dict[str, float]) -> DataFrame:
    """fill each column's nulls with its median (columns with no value stay null)."""
    fill = {c: v for c, v in medians.items() if v is not None and c in encoded.columns}
    if not fill:
        return encoded
    # fillna casts the value to the column's type, which would cut a median between two whole numbers
    between = {c: F.col(c).cast("double") for c, v in fill.items() if not float(v).is_integer()}
    return encoded.withColumns(between).fillna(fill) if between else encoded.fillna(fill)


def imputed_columns(spec: FeatureSpec) -> list[str]:
    return IMPUTED_COLUMNS + landmark_names()


def fit(raw: DataFrame, fit_rows: DataFrame | None = None) -> FeatureSpec:
    """Fit domains, top-15 and medians.

    Default (as the original): on all kept rows before any split. Pass
    ``fit_rows`` (e.g. the training part of the raw table) to fit without leakage.
    """
    # several passes (domains, top-15, median rounds) read the cleaned rows: keep them once
    cleaned = clean(fit_rows if fit_rows is not None else raw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_cleaned(cleaned)
    finally:
        cleaned.unpersist()


def _fit_cleaned(cleaned: DataFrame) -> FeatureSpec:
    spec = fit_domains(cleaned)
    spec.medians = exact_medians(encode(cleaned, spec), imputed_columns(spec))
    return spec


def preprocess(raw: DataFrame, spec: FeatureSpec | None = None) -> tuple[DataFrame, FeatureSpec]:
    """The whole preprocessing; returns the table and the spec used.

    Without a spec the cleaned rows are written once, for the fit and for every pass
    over the result: joins and text parsing behind ``raw`` run a single time.
    """
    if spec:
        cleaned = clean(raw)
    else:
        cleaned = spread_roundtrip(raw.sparkSession, clean(raw))
        spec = _fit_cleaned(cleaned)
    return impute(encode(cleaned, spec), spec.medians), spec


#: Categories that become sparse vectors in ``preprocess_sparse``.
SPARSE_COLUMNS = ["room_type", "neighbourhood_group_cleansed", "property_type"]


def preprocess_sparse(raw: DataFrame, columns: list[str] = SPARSE_COLUMNS,
                      flags: SparseOneHot | None = None, medians: dict[str, float] | None = None):
    """U1 for categories of any size: ``id, price, features`` as one vector; and the slots and medians used.

    ``features`` holds the numeric columns, distances and amenities of U1, imputed as there, then one
    sparse 0/1 vector per category with all of its values (no "other"). A numeric column without any
    value becomes NaN.
    """
    numbers = FeatureSpec([], [], [])
    names = [c for c in numbers.base_feature_columns() if c != "property_other"]
    cleaned = clean(raw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        flags = flags or SparseOneHot.fit(cleaned, columns)
        medians = medians or exact_medians(encode(cleaned, numbers), imputed_columns(numbers))
    finally:
        cleaned.unpersist()
    filled = impute(encode(clean(raw), numbers, keep=columns), medians)
    vectors = VectorAssembler(inputCols=names + [vector_column(c) for c in columns], outputCol="features", handleInvalid="keep")
    return vectors.transform(flags.transform(filled)).select("id", "price", "features"), flags, medians
