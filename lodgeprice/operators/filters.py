"""Row filters and validations P4–P14 (P1–P3 are plain ``select``s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    KNN_FEATURES, MAX_ACCOMMODATES, MAX_BATHROOMS, MAX_BEDROOMS, MAX_BEDS, MAX_TRAIN_PRICE, NEIGHBOURHOOD_TO_RAW,
)


def drop_null_price(df: DataFrame, col: str = "price") -> DataFrame:
    """P4."""
    return df.where(F.col(col).isNotNull())


def price_upper_bound(df: DataFrame, col: str = "price", bound: float = MAX_TRAIN_PRICE) -> DataFrame:
    """P5: inclusive upper bound only."""
    return df.where(F.col(col) <= F.lit(bound))


def complete_knn_rows(df: DataFrame, cols: list[str] = KNN_FEATURES) -> DataFrame:
    """Id plus features, rows with any null dropped."""
    return df.select("id", *cols).dropna(how="any")


def raw_district(name) -> Column:
    """Serving district name -> raw name; unmapped names pass through."""
    mapping = F.create_map(*[x for kv in NEIGHBOURHOOD_TO_RAW.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(mapping[c], c)


def equality_filters(df: DataFrame, neighbourhood: str | None = None, bedrooms: float | None = None,
                     beds: float | None = None, accommodates: int | None = None) -> DataFrame:
    """Optional equality filters; a filter is skipped when its value is None ('' for district)."""
    if neighbourhood:
        df = df.where(F.col("neighbourhood_group_cleansed") == raw_district(F.lit(neighbourhood)))
    if bedrooms is not None:
        df = df.where(F.col("bedrooms") == F.lit(float(bedrooms)))
    if beds is not None:
        df = df.where(F.col("beds") == F.lit(float(beds)))
    if accommodates is not None:
        df = df.where(F.col("accommodates") == F.lit(accommodates))
    return df


def price_range(df: DataFrame, price_min: float | None = None, price_max: float | None = None,
                col: str = "price_clean") -> DataFrame:
    """Inclusive on both ends; each side optional."""
    if price_min is not None:
        df = df.where(F.col(col) >= F.lit(float(price_min)))
    if price_max is not None:
        df = df.where(F.col(col) <= F.lit(float(price_max)))
    return df


def min_rating(df: DataFrame, rating_min: float | None = None) -> DataFrame:
    """A missing rating counts as 0."""
    if rating_min is None:
        return df
    return df.where(F.coalesce(F.col("review_scores_rating"), F.lit(0.0)) >= F.lit(float(rating_min)))


def type_filters(df: DataFrame, property_type: str | None = None, room_type: str | None = None) -> DataFrame:
    """P10: exact raw strings; skipped when empty."""
    if property_type:
        df = df.where(F.col("property_type") == F.lit(property_type))
    if room_type:
        df = df.where(F.col("room_type") == F.lit(room_type))
    return df


def mappable(df: DataFrame) -> DataFrame:
    """Both coordinates present."""
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def limit_violation() -> Column:
    """First failing upper limit, in order guests, bedrooms, beds, bathrooms; null passes."""
    return (
        F.when(F.col("accommodates") > MAX_ACCOMMODATES, F.lit(f"Guests exceeds maximum of {MAX_ACCOMMODATES}."))
        .when(F.col("bedrooms") > MAX_BEDROOMS, F.lit(f"Bedrooms exceeds maximum of {MAX_BEDROOMS}."))
        .when(F.col("beds") > MAX_BEDS, F.lit(f"Beds exceeds maximum of {MAX_BEDS}."))
        .when(F.col("bathrooms") > MAX_BATHROOMS, F.lit(f"Bathrooms exceeds maximum of {MAX_BATHROOMS}."))
    )


def limit_violation_sql() -> str:
    return (
        f"case when accommodates > {MAX_ACCOMMODATES} then 'Guests exceeds maximum of {MAX_ACCOMMODATES}.' "
        f"when bedrooms > {MAX_BEDROOMS} then 'Bedrooms exceeds maximum of {MAX_BEDROOMS}.' "
        f"when beds > {MAX_BEDS} then 'Beds exceeds maximum of {MAX_BEDS}.' "
        f"when bathrooms > {MAX_BATHROOMS} then 'Bathrooms exceeds maximum of {MAX_BATHROOMS}.' end"
    )
