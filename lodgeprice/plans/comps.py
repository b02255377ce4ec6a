"""U6 ``comps``, U7 ``focus_marker``, U8 ``comps_filters``: comparable listings tiered by price.

Plan: scan -> training rows -> optional filters -> optional similar-id
semi-join -> exact terciles (two scalars) -> tier projection -> mappable rows.
The terciles come from the distributed selection in ``operators.quantiles``;
only two numbers return to the driver and go back as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPS_COLUMNS, MAX_TRAIN_PRICE, SIMILAR_K
from ..functions.scalar import display_int, display_text, price_tier
from ..functions.text import money
from ..operators import filters as P
from ..operators.aggregates import terciles
from ..operators.split import is_test
from ..session import scratch_path

def training_listings(raw: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Raw rows whose id is in the training part of the feature table.

    With ``features`` given this is a left-semi join on id. Without it the
    same rows are selected by predicate: the feature table is the raw table
    after the price rules, and the split is a function of the id, so no join
    (and no shuffle) is needed.
    """
    if features is not None:
        train_ids = features.select("id").where(~is_test("id"))
        return raw.join(train_ids, "id", "left_semi")
    price = money("price")
    return raw.where(price.isNotNull() & (price <= F.lit(MAX_TRAIN_PRICE))).where(~is_test("id"))


def comps(raw: DataFrame, neighbourhood: str | None = None, bedrooms: float | None = None, beds: float | None = None,
          accommodates: int | None = None, price_min: float | None = None, price_max: float | None = None,
          rating_min: float | None = None, property_type: str | None = None, room_type: str | None = None,
          similar_ids: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """J1 -> P7 -> F1 -> P8 -> P9 -> P10 -> J3 -> G10 -> F20 -> P11 -> F23."""
    df = training_listings(raw, features).select(*COMPS_COLUMNS)
    df = P.equality_filters(df, neighbourhood, bedrooms, beds, accommodates)
    df = df.withColumn("price_clean", money("price"))
    df = P.price_range(df, price_min, price_max)
    df = P.min_rating(df, rating_min)
    df = P.type_filters(df, property_type, room_type)
    if similar_ids is not None and not similar_ids.isEmpty():  # J3: an empty similar set means no filter
        df = df.join(similar_ids.select("id").distinct(), "id", "left_semi")
    low, high = terciles(df, "price_clean")
    out = P.mappable(df).select(
        "id", "latitude", "longitude", "price", "price_clean",
        price_tier("price_clean", F.lit(low).cast("double"), F.lit(high).cast("double")).alias("tier"),
        display_text("neighbourhood_group_cleansed").alias("neighbourhood"),
        display_text("property_type").alias("property_type"),
        display_text("room_type").alias("room_type"),
        display_int("bedrooms").alias("bedrooms"),
        F.col("beds"),
        display_text("bathrooms_text").alias("bathrooms"),
        F.col("accommodates"),
        display_text("review_scores_rating").alias("review"),
        display_int("number_of_reviews").alias("num_reviews"),
    )
    return out


def focus_marker(spark, lat: float | None, lng: float | None, price: float | None, **details) -> DataFrame | None:
    """The user's own property as one extra 'blue' row; None unless lat and lng are given."""
    if lat is None or lng is None:
        return None
    row = {"latitude": float(lat), "longitude": float(lng), "price_clean": None if price is None else float(price),
           "tier": "blue"}
    for k in ("bedrooms", "beds", "bathrooms", "accommodates"):
        v = details.get(k)
        row[k] = "N/A" if not v else str(v)  # 0 shows as N/A
    return spark.createDataFrame([row], "latitude double, longitude double, price_clean double, tier string, "
                                        "bedrooms string, beds string, bathrooms string, accommodates string")


def focus_markers(requests: DataFrame, price_col: str | None = None) -> DataFrame:
    """U7 for a table of requests: one 'blue' row per request with both coordinates.

    Display rule of the marker: a missing or zero value shows as 'N/A'.
    """
    def shown(c: str):
        v = F.col(c)
        return F.when(v.isNull() | (v == 0), F.lit("N/A")).otherwise(v.cast("string")).alias(c)

    price = F.col(price_col).cast("double") if price_col else F.lit(None).cast("double")
    return requests.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "req_id", "latitude", "longitude", price.alias("price_clean"), F.lit("blue").alias("tier"),
        shown("bedrooms"), shown("beds"), shown("bathrooms"), shown("accommodates"))


def with_focus(comps_df: DataFrame, marker: DataFrame | None) -> DataFrame:
    """Comps rows plus the marker row (missing columns null)."""
    if marker is None:
        return comps_df
    return comps_df.select("latitude", "longitude", "price_clean", "tier", F.col("bedrooms"),
                           F.col("beds").cast("string").alias("beds"), F.col("bathrooms"),
                           F.col("accommodates").cast("string").alias("accommodates")).unionByName(marker)


FILTERED = ["neighbourhood_group_cleansed", "bedrooms", "beds", "accommodates"]
FILTER_COLUMNS = {
    "neighbourhood": ("neighbourhood_group_cleansed", "string"),
    "bedrooms": ("bedrooms", "double"),
    "beds": ("beds", "double"),
    "accommodates": ("accommodates", "int"),
}


def comps_filters(requests: DataFrame, same_district: bool = False, same_bedrooms: bool = False,
                  same_beds: bool = False, same_capacity: bool = False) -> tuple[DataFrame, list[str]]:
    """U8: "same district / bedrooms / beds / capacity" toggles turn request values into filters.

    Returns the filter table ``(req_id, <listing column>...)`` and the active
    listing columns. District names are mapped to raw names (J6); an empty
    district means no district filter, as in the original.
    """
    active = []
    cols = [F.col("req_id")]
    if same_district:
        active.append("neighbourhood_group_cleansed")
        cols.append(F.when(F.col("neighbourhood") != "", P.raw_district("neighbourhood")).alias("neighbourhood_group_cleansed"))
    for flag, key in ((same_bedrooms, "bedrooms"), (same_beds, "beds"), (same_capacity, "accommodates")):
        if flag:
            col, typ = FILTER_COLUMNS[key]
            active.append(col)
            cols.append(F.col(key).cast(typ).alias(col))
    return requests.select(*cols), active


def comps_batch(raw: DataFrame, filters: DataFrame, active: list[str]) -> DataFrame:
    """U8 batch: for every distinct filter combination, the matching training listings and their tier.

    A null filter value means "not applied". The result is keyed by combination
    (columns ``f_<listing column>``), once each, however many requests share it;
    ``filters`` itself says which combination a request uses. Combinations are
    handled by which columns they fill (at most 2^4 patterns, the empty one
    included), each an equi-join on those columns. Terciles come from the
    (value, count) table of each group, so a hot district is combined before it
    meets in one place.
    """
    base = training_listings(raw).select("id", *FILTERED, "latitude", "longitude", money("price").alias("price_clean"))
    path = scratch_path(raw.sparkSession, "comps-base")
    base.write.parquet(path)
    base = raw.sparkSession.read.schema(base.schema).parquet(path).withColumn("f_all", F.lit(1))
    combos = filters.select(*active).distinct()
    out = None
    for mask in range(2 ** len(active)):
        cols = [c for i, c in enumerate(active) if mask >> i & 1]
        wanted = combos
        for c in active:
            wanted = wanted.where(F.col(c).isNotNull() if c in cols else F.col(c).isNull())
        wanted = wanted.select(*cols, F.lit(1).alias("f_all")).distinct()
        keys = cols or ["f_all"]
        prices = base.groupBy(*keys, "price_clean").agg(F.count("*").alias("n"))
        groups = prices.groupBy(*keys).agg(F.percentile("price_clean", F.array(F.lit(1 / 3), F.lit(2 / 3)), F.col("n")).alias("q"))
        if not cols:
            groups = F.broadcast(groups)  # one row
        part = base.join(groups.join(wanted.select(*keys), keys), keys).where(
            F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
            *[(F.col(c) if c in cols else F.lit(None).cast(base.schema[c].dataType)).alias(f"f_{c}") for c in active],
            "id", "price_clean", price_tier("price_clean", F.col("q")[0], F.col("q")[1]).alias("tier"))
        out = part if out is None else out.unionByName(part)
    return out


def comps_per_request(batch: DataFrame, filters: DataFrame, active: list[str]) -> DataFrame:
    """Every request with its combination and the number of comps found for it (0 included)."""
    size = batch.groupBy(*[f"f_{c}" for c in active]).agg(F.count("*").alias("n_comps"))
    same = None
    for c in active:
        term = filters[c].eqNullSafe(size[f"f_{c}"])
        same = term if same is None else same & term
    return filters.join(size, same, "left").select(
        "req_id", *[filters[c].alias(f"f_{c}") for c in active], F.coalesce("n_comps", F.lit(0)).alias("n_comps"))


#: Filters of a map request: listing columns that must be equal, and ranges.
EQUAL_FILTERS = {"neighbourhood_group_cleansed": "string", "bedrooms": "double", "beds": "double", "accommodates": "int",
                 "property_type": "string", "room_type": "string"}
RANGE_FILTERS = ("price_min", "price_max", "rating_min")
#: Price bins for each doubling of the price.
BINS = 4


def _bin(price):
    return F.floor(F.log2(F.greatest(price, F.lit(0.0)) + 1) * BINS).cast("int")


def comps_by_filters(raw: DataFrame, filters: DataFrame, similar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """U8 with every filter of the map: the requests' combinations, and the tiered comps of each combination.

    ``filters`` holds ``req_id`` and any of ``EQUAL_FILTERS`` (raw values) and ``RANGE_FILTERS``; null or missing:
    not applied, and a missing rating of a listing counts as 0. ``similar(req_id, id)`` is the advanced mode: a
    request with rows there sees these listings only, one without sees all. Returns ``(req_id, combo)`` and
    ``(combo, id, latitude, longitude, price_clean, tier)``; a combination is named by its smallest request, and
    terciles are taken before rows without coordinates go.

    Combinations are joined by the columns they fill, pattern by pattern as far as patterns occur, and by price bin
    where they have a price range; rows are compared with the exact limits afterwards.
    """
    spark = raw.sparkSession
    price = money("price")
    base = training_listings(raw).select("id", *[F.col(c).cast(t).alias(c) for c, t in EQUAL_FILTERS.items()], "latitude", "longitude",
                                         price.alias("price_clean"), F.coalesce("review_scores_rating", F.lit(0.0)).alias("_rating"),
                                         _bin(price).alias("_bin"))
    path = scratch_path(spark, "comps-base")
    base.write.parquet(path)
    base = spark.read.schema(base.schema).parquet(path)

    def given(c, kind):
        return F.col(c).cast(kind) if c in filters.columns else F.lit(None).cast(kind)

    wants = filters.select("req_id", *[given(c, t).alias(f"f_{c}") for c, t in EQUAL_FILTERS.items()],
                           *[given(c, "double").alias(c) for c in RANGE_FILTERS])
    if similar is None:
        wants = wants.withColumn("own", F.lit(None).cast(wants.schema["req_id"].dataType))
    else:
        path = scratch_path(spark, "comps-similar")  # read three times below
        similar.write.parquet(path)
        similar = spark.read.schema(similar.schema).parquet(path)
        wants = wants.join(similar.select("req_id", F.col("req_id").alias("own")).distinct(), "req_id", "left")
    names = [c for c in wants.columns if c != "req_id"]
    combos = wants.groupBy(*names).agg(F.min("req_id").alias("combo"))
    path = scratch_path(spark, "comps-combos")
    combos.write.parquet(path)
    combos = spark.read.schema(combos.schema).parquet(path)
    same = None
    for c in names:
        term = wants[c].eqNullSafe(combos[c])
        same = term if same is None else same & term
    asked = wants.join(combos, same).select("req_id", "combo")

    ranged = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    pattern = F.concat_ws(",", *[F.when(F.col(f"f_{c}").isNotNull(), F.lit(c)) for c in EQUAL_FILTERS],
                          F.when(ranged, F.lit("_bin")))
    within = ((F.col("price_min").isNull() | (F.col("price_clean") >= F.col("price_min")))
              & (F.col("price_max").isNull() | (F.col("price_clean") <= F.col("price_max")))
              & (F.col("rating_min").isNull() | (F.col("_rating") >= F.col("rating_min"))))
    shared = combos.where("own is null").withColumn("pattern", pattern)
    kept = ["combo", "id", "latitude", "longitude", "price_clean"]
    found = None
    for row in shared.select("pattern").distinct().collect():  # at most 2^7, a handful in practice
        keys = [k for k in row["pattern"].split(",") if k]
        mine = shared.where(F.col("pattern") == row["pattern"])
        cols = [F.col(f"f_{k}").alias(k) for k in keys if k != "_bin"]
        if "_bin" in keys:
            last = F.coalesce(F.col("price_max"), F.lit(float(MAX_TRAIN_PRICE)))
            lows, highs = _bin(F.coalesce("price_min", F.lit(0.0))), _bin(last)
            cols.append(F.explode(F.when(lows <= highs, F.sequence(lows, highs)).otherwise(F.array().cast("array<int>"))).alias("_bin"))
        mine = mine.select("combo", *RANGE_FILTERS, *cols)
        if keys:
            part = base.join(mine, keys)
        else:  # by rating alone, or nothing at all: each listing meets the ratings it may have
            marks = [r[0] for r in mine.select("rating_min").distinct().orderBy("rating_min").collect()]  # distinct limits
            fits = F.array(*[F.when(F.lit(m).cast("double").isNull() | (F.col("_rating") >= F.lit(m)), F.lit(i)) for i, m in enumerate(marks)])
            number = F.coalesce(*[F.when(F.col("rating_min").eqNullSafe(F.lit(m).cast("double")), F.lit(i)) for i, m in enumerate(marks)])
            part = base.withColumn("_mark", F.explode(F.array_compact(fits))).join(
                F.broadcast(mine.withColumn("_mark", number)), "_mark")  # one row a limit
        part = part.where(within).select(*kept)
        found = part if found is None else found.unionByName(part)
    if similar is not None:
        alone = combos.where("own is not null")
        part = similar.distinct().join(base, "id").join(alone, F.col("req_id") == F.col("combo")).where(within)
        for c in EQUAL_FILTERS:
            part = part.where(F.col(f"f_{c}").isNull() | (F.col(c) == F.col(f"f_{c}")))
        part = part.select(*kept)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = base.join(combos.where("false"), F.lit(False)).select(*kept)
    path = scratch_path(spark, "comps-found")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    prices = found.groupBy("combo", "price_clean").agg(F.count("*").alias("n"))
    limits = prices.groupBy("combo").agg(F.percentile("price_clean", F.array(F.lit(1 / 3), F.lit(2 / 3)), F.col("n")).alias("q"))
    tiered = found.join(limits, "combo").withColumn("tier", price_tier("price_clean", F.col("q")[0], F.col("q")[1]))
    return asked, P.mappable(tiered).select(*kept, "tier")


__all__ = ["SIMILAR_K", "FILTER_COLUMNS", "comps", "comps_batch", "comps_by_filters", "comps_filters", "comps_per_request", "focus_marker", "focus_markers", "training_listings",
           "with_focus"]
