"""Registered queries: one per inventory operator, each with its DuckDB oracle when SQL can express it.

Every query reads the test tables (through the derived ``listings`` /
``requests`` views) over whole tables. Doubles are rounded to 6 digits on both
sides so engine-level last-bit differences do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sqltext as S
from .constants import DEFAULT_AVERAGES, KNN_FEATURES, REVIEW_COLUMNS
from .functions import encode as E
from .functions import geo as G
from .functions import rowstats as RS
from .functions import scalar as SC
from .functions import text as TX
from .operators import aggregates as A
from .operators import filters as P
from .operators import split as SP
from .plans import comps as C
from .sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = fx.with_views(sql)
        return fn
    return deco


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and doubles inside arrays) for engine-independent comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def listings(spark, sf):
    return fx.listings(spark, sf)


def requests(spark, sf):
    return fx.requests(spark, sf)


# ---------------------------------------------------------------------------
# Flagship (entry): training listings -> exact terciles -> tier -> count per tier
# ---------------------------------------------------------------------------

@query("u06_comps_tier_counts", """
with t as (select id, latitude, longitude, """ + S.money("price") + """ as price_clean from listings
           where """ + S.money("price") + """ is not null and """ + S.money("price") + """ <= 3000
             and not (""" + SP.split_sql() + """)),
q as (select quantile_cont(price_clean, 1/3) lo, quantile_cont(price_clean, 2/3) hi from t)
select case when price_clean <= lo then 'red' when price_clean <= hi then 'orange' else 'green' end as tier,
       count(*) as n
from t, q where latitude is not null and longitude is not null group by 1
""")
def u06_comps_tier_counts(spark, sf):
    c = C.comps(listings(spark, sf))
    return c.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------

LISTING_SCHEMA = (
    "id bigint, host_since date, last_scraped string, host_total_listings_count double, price string, "
    "accommodates int, bedrooms double, beds double, room_type string, neighbourhood_group_cleansed string, "
    "latitude double, longitude double, amenities string, bathrooms_text string, property_type string, "
    "number_of_reviews int, review_scores_rating double, review_scores_accuracy double, "
    "review_scores_cleanliness double, review_scores_checkin double, review_scores_communication double, "
    "review_scores_location double, review_scores_value double"
)


@query("s01_csv_roundtrip", "select * from listings")
def s01_csv_roundtrip(spark, sf):
    from .sources import io
    return (io.csv_roundtrip(spark, listings(spark, sf), LISTING_SCHEMA))


@query("s01_csv_splits", """
select id, price, room_type || chr(10) || '"' || amenities || '",' || chr(10) || coalesce(bathrooms_text, '') as text
from listings
""")
def s01_csv_splits(spark, sf):
    """S1 with line ends, quotes and commas inside fields, read by as many tasks as the files have splits."""
    from .session import scratch_path
    from .sources import io
    from .sources.csv_split import read_csv_splits
    rows = listings(spark, sf).select("id", "price", F.concat(
        "room_type", F.lit('\n"'), "amenities", F.lit('",\n'), F.coalesce("bathrooms_text", F.lit(""))).alias("text"))
    path = scratch_path(spark, "csv")
    io.write_csv(rows, path)
    return read_csv_splits(spark, path, "id bigint, price string, text string")


@query("s02_split_parquet_roundtrip", f"""
select id, case when {SP.split_sql()} then 'test' else 'train' end as "set" from listings
""")
def s02_split_parquet_roundtrip(spark, sf):
    from .sources import io
    return io.parquet_roundtrip(spark, SP.split_table(listings(spark, sf)))


@query("s07_options", """
select 'room_type' as field, room_type as value from listings where room_type is not null
union select 'neighbourhood', neighbourhood_group_cleansed from listings where neighbourhood_group_cleansed is not null
union select 'property_type', property_type from listings where property_type is not null
union select 'amenity', a from (select unnest(""" + S.json_list("amenities") + """) a from listings) where a is not null
""")
def s07_options(spark, sf):
    from .sources import io
    return io.options(listings(spark, sf))


# ---------------------------------------------------------------------------
# 2.2 projection, filters, validation
# ---------------------------------------------------------------------------

@query("p01_keep_columns", "select id, host_since, host_total_listings_count, price, accommodates, bedrooms, beds, "
       "room_type, neighbourhood_group_cleansed, latitude, longitude, amenities, bathrooms_text, review_scores_rating, "
       "property_type, number_of_reviews, review_scores_accuracy, review_scores_cleanliness, review_scores_checkin, "
       "review_scores_communication, review_scores_location, review_scores_value from listings")
def p01_keep_columns(spark, sf):
    from .constants import KEEP_COLUMNS
    return (listings(spark, sf).select(*KEEP_COLUMNS))


@query("p04_drop_null_price", f"select id, {S.money('price')} as price from listings where {S.money('price')} is not null")
def p04_drop_null_price(spark, sf):
    df = listings(spark, sf).select("id", TX.money("price").alias("price"))
    return P.drop_null_price(df)


@query("p05_price_upper_bound", f"select id, {S.money('price')} as price from listings where {S.money('price')} <= 3000")
def p05_price_upper_bound(spark, sf):
    df = listings(spark, sf).select("id", TX.money("price").alias("price"))
    return P.price_upper_bound(P.drop_null_price(df))


@query("p06_knn_rows", f"""
select * from (select id, latitude, longitude, cast(accommodates as double) as accommodates, bedrooms, beds,
  {S.first_number('bathrooms_text')} as bathrooms_numeric, {S.money('price')} as price_clean from listings)
where latitude is not null and longitude is not null and accommodates is not null and bedrooms is not null
  and beds is not null and bathrooms_numeric is not null and price_clean is not null
""")
def p06_knn_rows(spark, sf):
    from .operators.knn import knn_table
    return (knn_table(listings(spark, sf)))


def _comps_base_sql() -> str:
    m = S.money("price")
    return (f"select * from listings where {m} is not null and {m} <= 3000 and not ({SP.split_sql()})")


@query("p07_equality_filters", f"""
select id from ({_comps_base_sql()}) where neighbourhood_group_cleansed = 'Tempelhof - Schöneberg'
  and bedrooms = 2 and accommodates = 3
""")
def p07_equality_filters(spark, sf):
    df = C.training_listings(listings(spark, sf))
    return P.equality_filters(df, neighbourhood="Tempelhof-Schoeneberg", bedrooms=2, accommodates=3).select("id")


@query("p08_price_range", f"""
select id, {S.money('price')} as price_clean from ({_comps_base_sql()})
where {S.money('price')} >= 100 and {S.money('price')} <= 180
""")
def p08_price_range(spark, sf):
    df = C.training_listings(listings(spark, sf)).select("id", TX.money("price").alias("price_clean"))
    return (P.price_range(df, 100, 180))


@query("p09_min_rating", f"select id from ({_comps_base_sql()}) where coalesce(review_scores_rating, 0) >= 4.5")
def p09_min_rating(spark, sf):
    return P.min_rating(C.training_listings(listings(spark, sf)), 4.5).select("id")


@query("p10_type_filters", f"""
select id from ({_comps_base_sql()}) where property_type = 'Type 12' and room_type = 'Private room'
""")
def p10_type_filters(spark, sf):
    return P.type_filters(C.training_listings(listings(spark, sf)), "Type 12", "Private room").select("id")


@query("p11_mappable", "select id from listings where latitude is not null and longitude is not null")
def p11_mappable(spark, sf):
    return P.mappable(listings(spark, sf)).select("id")


@query("p12_limit_validation", f"select req_id, {P.limit_violation_sql()} as reject_reason from requests")
def p12_limit_validation(spark, sf):
    return requests(spark, sf).select("req_id", P.limit_violation().alias("reject_reason"))


@query("p14_request_clamp", """
select req_id,
  greatest(1, least(15, coalesce(nullif(cast(accommodates as double), 0), 1))) as guests,
  greatest(0, least(10, coalesce(bedrooms, 0))) as bedrooms,
  greatest(0, least(10, coalesce(beds, 0))) as beds,
  greatest(0, least(5, coalesce(bathrooms, 0))) as bathrooms,
  coalesce(host_experience_days, 0) as host_experience_days,
  coalesce(nullif(num_listings, 0), 1) as num_listings,
  coalesce(number_of_reviews, 0) as number_of_reviews,
  coalesce(nullif(review_scores_rating, 0), 1) as review_scores_rating
from requests
""")
def p14_request_clamp(spark, sf):
    r = requests(spark, sf)
    return (r.select(
        "req_id",
        SC.clamp_field("accommodates", 1, 15, 1, zero_is_missing=True).alias("guests"),
        SC.clamp_field("bedrooms", 0, 10, 0).alias("bedrooms"),
        SC.clamp_field("beds", 0, 10, 0).alias("beds"),
        SC.clamp_field("bathrooms", 0, 5, 0).alias("bathrooms"),
        F.coalesce("host_experience_days", F.lit(0.0)).alias("host_experience_days"),
        F.coalesce(F.when(F.col("num_listings") != 0, F.col("num_listings")), F.lit(1.0)).alias("num_listings"),
        F.coalesce("number_of_reviews", F.lit(0.0)).alias("number_of_reviews"),
        F.coalesce(F.when(F.col("review_scores_rating") != 0, F.col("review_scores_rating")), F.lit(1.0)).alias(
            "review_scores_rating"),
    ))


@query("p15_price_floor", f"""
select id, greatest({S.stand_in_prediction()} - 100, 30.0) as predicted from listings
""")
def p15_price_floor(spark, sf):
    l = listings(spark, sf)
    pred = 40 + 20 * F.col("accommodates") + 25 * F.coalesce("bedrooms", F.lit(1.0)) - 100
    return (l.select("id", SC.price_floor(pred.cast("double")).alias("predicted")))


# ---------------------------------------------------------------------------
# 2.6 scalar functions
# ---------------------------------------------------------------------------

@query("f01_money_parse", f"""
select id, {S.money('price')} as price_clean,
  (price is not null and {S.money('price')} is null) as junk from listings
""")
def f01_money_parse(spark, sf):
    l = listings(spark, sf)
    return (l.select("id", TX.money("price").alias("price_clean"), TX.money_is_junk("price").alias("junk")))


@query("f02_first_number", f"select id, {S.first_number('bathrooms_text')} as bathrooms from listings")
def f02_first_number(spark, sf):
    return (listings(spark, sf).select("id", TX.first_number("bathrooms_text").alias("bathrooms")))


@query("f03_host_experience", """
select id, datediff('day', host_since, date '2025-09-24') as host_experience from listings
""")
def f03_host_experience(spark, sf):
    return listings(spark, sf).select("id", SC.days_since("host_since").alias("host_experience"))


@query("f04_professional_host", """
select id, coalesce(host_total_listings_count > 2, false)::int as is_professional_host,
  coalesce(coalesce(host_total_listings_count, 29.7) > 2, false)::int as is_professional_host_serving
from listings
""")
def f04_professional_host(spark, sf):
    return listings(spark, sf).select(
        "id", SC.threshold_flag("host_total_listings_count").alias("is_professional_host"),
        SC.threshold_flag("host_total_listings_count", fill=29.7).alias("is_professional_host_serving"))


@query("f05_category_slugs", """
select distinct 'district' as kind, neighbourhood_group_cleansed as value,
  'is_' || replace(replace(replace(replace(regexp_replace(lower(neighbourhood_group_cleansed), '[ \\-]', '_', 'g'),
     'ö', 'oe'), 'ä', 'ae'), 'ü', 'ue'), '.', '') as raw_slug
from listings where neighbourhood_group_cleansed is not null
union all
select distinct 'room', room_type,
  'is_' || replace(replace(replace(regexp_replace(lower(room_type), '[ \\-/]', '_', 'g'), 'ö', 'oe'), 'ä', 'ae'), 'ü', 'ue')
from listings where room_type is not null
""")
def f05_category_slugs(spark, sf):
    l = listings(spark, sf)
    d = l.where(F.col("neighbourhood_group_cleansed").isNotNull()).select(
        F.lit("district").alias("kind"), F.col("neighbourhood_group_cleansed").alias("value"),
        F.concat(F.lit("is_"), TX.slug_col("neighbourhood_group_cleansed", "district", collapse=False)).alias("raw_slug"),
    ).distinct()
    r = l.where(F.col("room_type").isNotNull()).select(
        F.lit("room").alias("kind"), F.col("room_type").alias("value"),
        F.concat(F.lit("is_"), TX.slug_col("room_type", "room", collapse=False)).alias("raw_slug"),
    ).distinct()
    return d.unionByName(r)


@query("f06_collapse_underscores", """
select distinct neighbourhood_group_cleansed as value,
  regexp_replace('is_' || replace(replace(replace(replace(regexp_replace(lower(neighbourhood_group_cleansed),
     '[ \\-]', '_', 'g'), 'ö', 'oe'), 'ä', 'ae'), 'ü', 'ue'), '.', ''), '_+', '_', 'g') as column_name
from listings where neighbourhood_group_cleansed is not null
""")
def f06_collapse_underscores(spark, sf):
    l = listings(spark, sf).where(F.col("neighbourhood_group_cleansed").isNotNull())
    return l.select(
        F.col("neighbourhood_group_cleansed").alias("value"),
        F.regexp_replace(F.concat(F.lit("is_"), TX.slug_col("neighbourhood_group_cleansed", "district", collapse=False)),
                         "_+", "_").alias("column_name"),
    ).distinct()


@query("f07_haversine", f"""
select id, {S.r6(S.haversine('latitude', 'longitude', '52.52', '13.405'))} as dist_center from listings
""")
def f07_haversine(spark, sf):
    return rnd(listings(spark, sf).select("id", G.haversine_km("latitude", "longitude", 52.52, 13.405).alias("dist_center")))


@query("f08_one_hot", "select id, " + ", ".join(
    S.one_hot_cols("room_type", ["Entire home/apt", "Private room", "Shared room", "Hotel room"], "is_", "room")
    + S.one_hot_cols("neighbourhood_group_cleansed", [
        "Charlottenburg-Wilm.", "Friedrichshain-Kreuzberg", "Lichtenberg", "Marzahn - Hellersdorf", "Mitte",
        "Neukölln", "Pankow", "Reinickendorf", "Spandau", "Steglitz - Zehlendorf", "Tempelhof - Schöneberg",
        "Treptow - Köpenick"], "is_", "district")) + " from listings")
def f08_one_hot(spark, sf):
    l = listings(spark, sf)
    rooms = A.distinct_values(l, "room_type")
    districts = A.distinct_values(l, "neighbourhood_group_cleansed")
    return l.select("id", *E.one_hot("room_type", rooms, "is_", "room"),
                    *E.one_hot("neighbourhood_group_cleansed", districts, "is_", "district"))


_SPARSE_COLS = ["host_since", "neighbourhood_group_cleansed", "property_type"]


def _sparse_sql() -> str:
    return " union all ".join(f"""
select id, '{c}' as "column", (select count(distinct {c}) from listings)::int as size,
  (dense_rank() over (order by {c}) - 1)::int as slot from listings where {c} is not null""" for c in _SPARSE_COLS)


@query("f08_sparse_one_hot", _sparse_sql())
def f08_sparse_one_hot(spark, sf):
    """F8 as sparse vectors, one slot a value; the start date of a host is the large domain."""
    from .operators.sparse_onehot import SparseOneHot, active_slots
    rows = listings(spark, sf).select("id", *_SPARSE_COLS)
    return active_slots(SparseOneHot.fit(rows, _SPARSE_COLS).transform(rows), "id", _SPARSE_COLS)


@query("f09_property_top15", f"""
with k as (select * from ({S.kept_cte().replace('kept as (', '', 1)[:-1]})),
top as (select property_type v from k where property_type is not null group by property_type
        order by count(*) desc, property_type limit 15)
select k.id, 'property_' || lower(replace(top.v, ' ', '_')) as feature,
  cast(coalesce(k.property_type = top.v, false)::int as double) as value
from k join top on true
union all
select id, 'property_other', cast(case when property_type in (select v from top) then 0 else 1 end as double) from k
""")
def f09_property_top15(spark, sf):
    from .plans.preprocess import clean
    k = clean(listings(spark, sf))
    top = A.top_values(k, "property_type", 15)
    wide = k.select("id", *E.one_hot_top("property_type", top, mode="train"))
    return _long(wide, [c for c in wide.columns if c != "id"], "id")


@query("f10_json_list", f"select id, len({S.json_list('amenities')}) as n_amenities from listings")
def f10_json_list(spark, sf):
    return listings(spark, sf).select("id", F.size(TX.json_list("amenities")).alias("n_amenities"))


@query("f11_amenity_flags", "select id, " + ", ".join(S.amenity_flag_cols(S.json_list("amenities"))) + " from listings")
def f11_amenity_flags(spark, sf):
    l = listings(spark, sf).withColumn("_a", TX.json_list("amenities"))
    return l.select("id", *E.multi_hot("_a"))


@query("f13_per_person", """
select id, round(bedrooms / case when accommodates = 0 then 1 else accommodates end, 6) as bedroom_density,
  round(beds / case when accommodates = 0 then 1 else accommodates end, 6) as beds_per_person,
  round(bedrooms / greatest(accommodates, 1), 6) as bedroom_density_serving
from listings
""")
def f13_per_person(spark, sf):
    return rnd(listings(spark, sf).select(
        "id", SC.per_person("bedrooms").alias("bedroom_density"), SC.per_person("beds").alias("beds_per_person"),
        SC.per_person("bedrooms", mode="serve").alias("bedroom_density_serving")))


@query("f14_total_rooms", f"select id, bedrooms + {S.first_number('bathrooms_text')} as total_rooms from listings")
def f14_total_rooms(spark, sf):
    l = listings(spark, sf)
    return (l.select("id", (F.col("bedrooms") + TX.first_number("bathrooms_text")).alias("total_rooms")))


@query("f15_row_mean", f"select id, {S.r6(S.row_mean(REVIEW_COLUMNS))} as review_mean from listings")
def f15_row_mean(spark, sf):
    return rnd(listings(spark, sf).select("id", RS.row_mean(REVIEW_COLUMNS).alias("review_mean")))


@query("f16_row_min", f"select id, least({', '.join(REVIEW_COLUMNS)}) as review_min from listings")
def f16_row_min(spark, sf):
    return (listings(spark, sf).select("id", RS.row_min(REVIEW_COLUMNS).alias("review_min")))


@query("f17_row_std", f"""
select id, {S.r6(S.row_std(REVIEW_COLUMNS + ['bedrooms'], 1))} as std_sample,
  {S.r6(S.row_std(REVIEW_COLUMNS + ['bedrooms'], 0))} as std_population from listings
""")
def f17_row_std(spark, sf):
    cols = REVIEW_COLUMNS + ["bedrooms"]
    return rnd(listings(spark, sf).select(
        "id", RS.row_std(cols, ddof=1).alias("std_sample"), RS.row_std(cols, ddof=0).alias("std_population")))


@query("f18_row_sum", "select id, " + " + ".join(
    f"coalesce(list_contains({S.json_list('amenities')}, '{a}'), false)::int" for a in
    ["Wifi", "Kitchen", "Washer", "Free washer", "Essentials"]) + " as total_amenities from listings")
def f18_row_sum(spark, sf):
    l = listings(spark, sf).withColumn("_a", TX.json_list("amenities"))
    flags = l.select("id", *E.multi_hot("_a"))
    return flags.select("id", RS.row_sum(E.amenity_names()).alias("total_amenities"))


@query("f20_price_tier", """
with t as (select id, """ + S.money("price") + """ as p from listings where """ + S.money("price") + """ is not null)
select id, case when p <= 100 then 'red' when p <= 160 then 'orange' else 'green' end as tier from t
""")
def f20_price_tier(spark, sf):
    l = listings(spark, sf).select("id", TX.money("price").alias("p")).where(F.col("p").isNotNull())
    return l.select("id", SC.price_tier("p", 100.0, 160.0).alias("tier"))


@query("f21_round_cents", f"""
select id, round_even({S.money('price')} / 3, 2) as third_price from listings where {S.money('price')} is not null
""")
def f21_round_cents(spark, sf):
    l = listings(spark, sf).select("id", TX.money("price").alias("p")).where(F.col("p").isNotNull())
    return l.select("id", SC.round_cents(F.col("p") / 3).alias("third_price"))


@query("f22_log_target", f"""
select id, round(ln(1 + p), 6) as log_price, round(exp(ln(1 + p)) - 1, 6) as back
from (select id, {S.money('price')} as p from listings where {S.money('price')} is not null)
""")
def f22_log_target(spark, sf):
    l = listings(spark, sf).select("id", TX.money("price").alias("p")).where(F.col("p").isNotNull())
    return rnd(l.select("id", SC.log_target("p").alias("log_price"),
                        SC.inverse_log_target(SC.log_target("p")).alias("back")))


@query("f23_display_fields", """
select id, coalesce(cast(cast(trunc(bedrooms) as bigint) as varchar), 'N/A') as bedrooms_text,
  coalesce(cast(cast(number_of_reviews as bigint) as varchar), 'N/A') as num_reviews,
  coalesce(property_type, 'N/A') as property_type, coalesce(bathrooms_text, 'N/A') as bathrooms
from listings
""")
def f23_display_fields(spark, sf):
    l = listings(spark, sf)
    return l.select("id", SC.display_int("bedrooms").alias("bedrooms_text"),
                    SC.display_int("number_of_reviews").alias("num_reviews"),
                    SC.display_text("property_type").alias("property_type"),
                    SC.display_text("bathrooms_text").alias("bathrooms"))


# ---------------------------------------------------------------------------
# 2.7 split and folds; 2.5 ordering and set operations
# ---------------------------------------------------------------------------

@query("t01_split", f"""
select id, case when {SP.split_sql()} then 'test' else 'train' end as "set" from listings
""")
def t01_split(spark, sf):
    return SP.split_table(listings(spark, sf))


@query("t02_folds", f"""
select id, {SP.fold_sql()} as fold from listings where not ({SP.split_sql()})
""")
def t02_folds(spark, sf):
    l = SP.train_part(listings(spark, sf))
    return l.select("id", SP.fold_of("id").alias("fold"))


@query("g14_split_counts", f"""
select case when {SP.split_sql()} then 'test' else 'train' end as "set", count(*) as n from ({S.kept_cte().replace('kept as (', '', 1)[:-1]}) group by 1
""")
def g14_split_counts(spark, sf):
    from .plans.preprocess import clean
    return A.counts_by(SP.with_set(clean(listings(spark, sf))), "set")


@query("o05_union_tag", f"""
select id, 'train' as "set" from listings where not ({SP.split_sql()})
union all select id, 'test' from listings where {SP.split_sql()}
""")
def o05_union_tag(spark, sf):
    l = listings(spark, sf).select("id")
    return SP.train_part(l).withColumn("set", F.lit("train")).unionByName(
        SP.test_part(l).withColumn("set", F.lit("test")))


@query("o06_amenity_membership", f"""
select id, list_contains({S.json_list('amenities')}, 'Washer') as washer,
  list_contains({S.json_list('amenities')}, 'washer') as washer_lower from listings
""")
def o06_amenity_membership(spark, sf):
    a = TX.json_list("amenities")
    return listings(spark, sf).select("id", F.array_contains(a, "Washer").alias("washer"),
                                      F.array_contains(a, "washer").alias("washer_lower"))


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def _long(wide: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Wide feature columns -> (key, feature, value) rows.

    The exploded array holds bare doubles, the name is looked up by position; rounding goes through
    decimals, so whole numbers (flags, counts) skip it.
    """
    v = F.col("v")
    return wide.select(key, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("at", "v")).select(
        key, F.get(F.array(*[F.lit(c) for c in cols]), F.col("at")).alias("feature"),
        F.when(v == F.rint(v), v + F.lit(0.0)).otherwise(F.round(v, 6)).alias("value"))


# ---------------------------------------------------------------------------
# shared derived tables (Spark side)
# ---------------------------------------------------------------------------

def preprocessed(spark, sf):
    """U1 over the listings view: (table, spec)."""
    from .plans.preprocess import preprocess
    return preprocess(listings(spark, sf))


def featured(spark, sf):
    """U1 + U2: (feature table, spec)."""
    from .plans.features import engineer_features
    pre, spec = preprocessed(spark, sf)
    return engineer_features(pre), spec


def _unpivot_sql(src: str, exclude: list[str]) -> str:
    return (f"select id, feature, round(value, 6) as value from (unpivot (select * exclude ({', '.join(exclude)}) "
            f"from {src}) on columns(* exclude (id)) into name feature value value)")


# ---------------------------------------------------------------------------
# 2.9 composed plans: preprocess (U1), features (U2), request features
# ---------------------------------------------------------------------------

@query("u01_preprocess", f"""
with {S.feature_ctes()}
{_unpivot_sql('imp', ['property_type'])}
union all
select id, feature, round(value, 6) from ({S.property_long('imp')})
""")
def u01_preprocess(spark, sf):
    pre, _ = preprocessed(spark, sf)
    return _long(pre, [c for c in pre.columns if c != "id"], "id")


@query("u02_engineer_features", f"""
with {S.feature_ctes()}
select id, feature, round(value, 6) as value from (unpivot (select id, bedroom_density, beds_per_person,
  bathrooms_per_person, total_rooms, avg_dist_to_landmark, review_score_std, min_dist_to_landmark, total_amenities
  from feat) on columns(* exclude (id)) into name feature value value)
""")
def u02_engineer_features(spark, sf):
    from .plans.features import DERIVED
    feat, _ = featured(spark, sf)
    return _long(feat, DERIVED, "id")


@query("g05_medians", f"""
with {S.feature_ctes()}
select feature, round(value, 6) as value from (unpivot med on columns(*) into name feature value value)
""")
def g05_medians(spark, sf):
    _, spec = preprocessed(spark, sf)
    rows = [(k, None if v is None else round(float(v), 6)) for k, v in spec.medians.items()]
    return spark.createDataFrame(rows, "feature string, value double")


@query("f12_median_impute", f"""
with {S.feature_ctes()}
select id, round(bedrooms, 6) as bedrooms, round(bathrooms, 6) as bathrooms,
  round(review_scores_rating, 6) as review_scores_rating, round(host_experience, 6) as host_experience from imp
""")
def f12_median_impute(spark, sf):
    pre, _ = preprocessed(spark, sf)
    return rnd(pre.select("id", F.col("bedrooms").cast("double"), F.col("bathrooms").cast("double"),
                          F.col("review_scores_rating").cast("double"), F.col("host_experience").cast("double")))


@query("g03_distinct_categories", f"""
with {S.kept_cte()}
select distinct 'room_type' as field, room_type as value from kept where room_type is not null
union all select distinct 'neighbourhood', neighbourhood_group_cleansed from kept where neighbourhood_group_cleansed is not null
""")
def g03_distinct_categories(spark, sf):
    from .plans.preprocess import clean
    k = clean(listings(spark, sf))
    fields = {"room_type": "room_type", "neighbourhood": "neighbourhood_group_cleansed"}
    parts = [A.distinct_table(k, c).select(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in fields.items()]
    return parts[0].union(parts[1])


@query("g04_top_property_types", f"""
with {S.kept_cte()}
select property_type, count(*) as n from kept where property_type is not null group by property_type
order by n desc, property_type limit 15
""")
def g04_top_property_types(spark, sf):
    from .plans.preprocess import clean
    return A.value_counts(clean(listings(spark, sf)), "property_type").limit(15).withColumnRenamed("n", "n")


@query("o04_top_k_categories", f"""
select room_type, count(*) as n from listings where room_type is not null group by room_type order by n desc, room_type limit 2
""")
def o04_top_k_categories(spark, sf):
    return A.value_counts(listings(spark, sf), "room_type").limit(2)


@query("g01_safe_means", f"""
with {S.feature_ctes()}
select round(coalesce(avg(host_experience), 365.0), 6) as host_experience_days,
  round((select coalesce(avg(host_total_listings_count), 1.0) from listings), 6) as num_listings,
  {", ".join(f"round(coalesce(avg({c}), 4.7), 6) as {c}" for c in REVIEW_COLUMNS)},
  round(coalesce(avg(number_of_reviews), 50.0), 6) as number_of_reviews,
  round(coalesce(avg(bedrooms), 1.0), 6) as bedrooms, round(coalesce(avg(beds), 1.0), 6) as beds,
  round(coalesce(avg(bathrooms), 1.0), 6) as bathrooms
from feat
""")
def g01_safe_means(spark, sf):
    feat, _ = featured(spark, sf)
    return rnd(A.safe_means(feat, listings(spark, sf)))


@query("g02_host_experience_mean", """
select round(avg(datediff('day', try_cast(cast(host_since as varchar) as date), try_cast(last_scraped as date))), 6)
  as host_experience_days from listings
""")
def g02_host_experience_mean(spark, sf):
    return rnd(A.host_experience_mean(listings(spark, sf)))


@query("g08_column_profile", f"""
with {S.feature_ctes()},
long as (unpivot (select * exclude (property_type) from feat) on columns(* exclude (id)) into name col value v)
select col, round(avg(v), 6) as mean,
  round(case when stddev_samp(v) > 0 then stddev_samp(v) else greatest(abs(avg(v)) * 0.1, 1e-3) end, 6) as std,
  bool_and(v in (0, 1)) as "binary", min(v) >= 0 as non_negative
from long where col not in ('price') group by col
""")
def g08_column_profile(spark, sf):
    from .plans.features import DERIVED
    feat, spec = featured(spark, sf)
    cols = [c for c in feat.columns if c not in ("id", "price") and not c.startswith("property_")]
    return rnd(A.column_profile(feat, cols))


def _pred_rows(spark, sf):
    from .plans.preprocess import clean
    k = clean(listings(spark, sf))
    pred = (40 + 20 * F.col("accommodates") + 25 * F.coalesce("bedrooms", F.lit(1.0))).cast("double")
    return k.select("id", "price", pred.alias("prediction"))


_PRED_SQL = f"select id, price, cast({S.stand_in_prediction()} as double) as prediction from kept"


@query("g06_regression_kpis", f"""
with {S.kept_cte()}, p as ({_PRED_SQL})
select count(*) as n, round(sqrt(avg((prediction - price) * (prediction - price))), 6) as rmse,
  round(avg(abs(prediction - price)), 6) as mae,
  round(1 - sum((prediction - price) * (prediction - price)) / (var_pop(price) * count(price)), 6) as r2,
  round(avg(abs(prediction - price) / greatest(abs(price), 1e-8)) * 100, 6) as mape
from p
""")
def g06_regression_kpis(spark, sf):
    return rnd(A.regression_kpis(_pred_rows(spark, sf)))


@query("m20_train_test_report", f"""
with {S.kept_cte()}, p as ({_PRED_SQL})
select case when {SP.split_sql()} then 'test' else 'train' end as "set", count(*) as n,
  round(sqrt(avg((prediction - price) * (prediction - price))), 6) as rmse,
  round(avg(abs(prediction - price)), 6) as mae,
  round(1 - sum((prediction - price) * (prediction - price)) / (var_pop(price) * count(price)), 6) as r2,
  round(avg(abs(prediction - price) / greatest(abs(price), 1e-8)) * 100, 6) as mape
from p group by 1
""")
def m20_train_test_report(spark, sf):
    return rnd(A.regression_kpis(SP.with_set(_pred_rows(spark, sf)), by=["set"]))


@query("g07_scoring_summary", f"""
with {S.kept_cte()}, p as ({_PRED_SQL} where {SP.split_sql()})
select count(*) as n, round(sqrt(avg((prediction - price) * (prediction - price))), 6) as rmse,
  round(avg(price), 6) as mean_actual, round(avg(prediction), 6) as mean_predicted from p
""")
def g07_scoring_summary(spark, sf):
    return rnd(A.scoring_summary(SP.test_part(_pred_rows(spark, sf))))


@query("g09_error_summary", f"""
with {S.kept_cte()}, p as ({_PRED_SQL}),
e as (select abs(prediction - price) as a, abs(prediction - price) / greatest(price, 1e-6) as r from p)
select count(*) as n, round(avg(a), 6) as abs_err_mean, round(quantile_cont(a, 0.5), 6) as abs_err_median,
  round(quantile_cont(a, 0.9), 6) as abs_err_p90, round(avg(r) * 100, 6) as rel_err_mean_pct,
  round(quantile_cont(r, 0.5) * 100, 6) as rel_err_median_pct from e
""")
def g09_error_summary(spark, sf):
    return rnd(A.error_summary(_pred_rows(spark, sf)))


@query("g10_price_terciles", f"""
select round(quantile_cont(p, 1/3), 6) as low, round(quantile_cont(p, 2/3), 6) as high
from (select {S.money('price')} as p from ({_comps_base_sql()}))
""")
def g10_price_terciles(spark, sf):
    df = C.training_listings(listings(spark, sf)).select(TX.money("price").alias("price_clean"))
    lo, hi = A.terciles(df, "price_clean")
    return rnd(spark.createDataFrame([(lo, hi)], "low double, high double"))


@query("g12_histogram", f"""
with {S.kept_cte()}, p as ({_PRED_SQL}),
b as (select min(prediction) lo, max(prediction) hi from p),
h as (select least(9, cast(floor((prediction - lo) / ((hi - lo) / 10)) as int)) as bin, count(*) as n from p, b group by 1)
select r.bin, round(b.lo + r.bin * ((b.hi - b.lo) / 10), 6) as lo, round(b.lo + (r.bin + 1) * ((b.hi - b.lo) / 10), 6) as hi,
  coalesce(h.n, 0) as n
from (select unnest(range(10))::int as bin) r cross join b left join h on h.bin = r.bin
""")
def g12_histogram(spark, sf):
    return rnd(A.histogram(_pred_rows(spark, sf), "prediction"))


@query("g13_box_summary", f"""
with {S.kept_cte()}, p as ({_PRED_SQL}),
q as (select quantile_cont(prediction, 0.25) q1, quantile_cont(prediction, 0.5) med,
             quantile_cont(prediction, 0.75) q3 from p)
select round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
  round(min(case when prediction >= q1 - 1.5 * (q3 - q1) then prediction end), 6) as whisker_lo,
  round(max(case when prediction <= q3 + 1.5 * (q3 - q1) then prediction end), 6) as whisker_hi
from p, q group by q1, med, q3
""")
def g13_box_summary(spark, sf):
    return rnd(A.box_summary(_pred_rows(spark, sf), "prediction"))


# ---------------------------------------------------------------------------
# model registry over data-derived closed-form predictors
# ---------------------------------------------------------------------------

def baseline_metrics(spark, sf) -> DataFrame:
    """M19 over closed-form predictors: test RMSE of each (model, rmse)."""
    from .plans.evaluate import baseline_predictions
    from .plans.preprocess import clean
    preds = baseline_predictions(clean(listings(spark, sf)).select("id", "price", "accommodates", "bedrooms"))
    e = F.col("prediction") - F.col("price")
    return preds.groupBy("model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


_BASELINE_SQL = f"""
{S.kept_cte()},
tr as (select * from kept where not ({SP.split_sql()})),
te as (select * from kept where {SP.split_sql()}),
gm as (select avg(price) m from tr),
am as (select accommodates, avg(price) m from tr group by accommodates),
preds as (
  select 'mean_price.joblib' as model, te.price, gm.m as prediction from te, gm
  union all select 'stand_in_linear.joblib', te.price, cast(40 + 20 * te.accommodates + 25 * coalesce(te.bedrooms, 1) as double) from te
  union all select 'accommodates_mean.joblib', te.price, coalesce(am.m, gm.m) from te cross join gm left join am on am.accommodates = te.accommodates),
metrics as (select model, sqrt(avg((prediction - price) * (prediction - price))) as rmse from preds group by model)
"""


@query("m19_evaluate_models", f"with {_BASELINE_SQL} select model, round(rmse, 6) as rmse from metrics")
def m19_evaluate_models(spark, sf):
    return rnd(baseline_metrics(spark, sf))


@query("g11_leaderboard", f"""
with {_BASELINE_SQL}
select model, round(rmse, 6) as rmse, replace(model, '.joblib', '') as label,
  round((rmse / (select min(rmse) from metrics) - 1) * 100, 6) as pct_over_best,
  rank() over (order by rmse) as rank
from metrics
""")
def g11_leaderboard(spark, sf):
    return rnd(A.leaderboard(baseline_metrics(spark, sf)).withColumn("rank", F.col("rank").cast("bigint")))


@query("o03_argmin_model", f"with {_BASELINE_SQL} select arg_min(model, rmse) as best_model from metrics")
def o03_argmin_model(spark, sf):
    return baseline_metrics(spark, sf).agg(F.min_by("model", "rmse").alias("best_model"))


@query("s06_choose_model", f"""
with {_BASELINE_SQL},
more as (select * from metrics union all select 'catboost.joblib', 1e9 union all select 'other.joblib', 0.5)
select * from (
  (select 'none preferred' as case_, model, round(rmse, 6) as rmse from metrics order by rmse, model limit 1)
  union all (select 'preferred', model, round(rmse, 6) from more where model = 'catboost.joblib')
  union all (select 'reports', model, round(rmse, 6) from more order by rmse, model limit 1)
  union all select 'no metrics', 'catboost_tuned.joblib', null)
""")
def s06_choose_model(spark, sf):
    from .sources import io
    metrics = baseline_metrics(spark, sf).select("model", "rmse")
    more = metrics.union(spark.createDataFrame([("catboost.joblib", 1e9), ("other.joblib", 0.5)], "model string, rmse double"))
    cases = [("none preferred", io.choose_model(metrics)), ("preferred", io.choose_model(more)),
             ("reports", io.choose_model(more, rule="reports")), ("no metrics", io.choose_model(metrics.limit(0)))]
    out = None
    for name, df in cases:
        df = df.select(F.lit(name).alias("case_"), "model", "rmse")
        out = df if out is None else out.union(df)
    return rnd(out)


# ---------------------------------------------------------------------------
# 2.3 joins: semi-joins, nearest listing, similarity, landmarks, name mapping
# ---------------------------------------------------------------------------

@query("j01_train_semijoin", f"""
with {S.kept_cte()}
select id, price from listings where id in (select id from kept where not ({SP.split_sql()}))
""")
def j01_train_semijoin(spark, sf):
    from .plans.preprocess import clean
    l = listings(spark, sf)
    return C.training_listings(l, features=clean(l)).select("id", "price")


_NEAREST_SQL = f"""
pts as (select distinct latitude as plat, longitude as plon from listings where latitude is not null and longitude is not null),
nd as (select req_id, min({S.haversine('latitude', 'longitude', 'plat', 'plon')}) as d from requests, pts
       where latitude is not null and longitude is not null group by req_id)
"""


@query("j02_nearest_listing", f"with {_NEAREST_SQL} select req_id, round(d, 6) as min_distance_km from nd")
def j02_nearest_listing(spark, sf):
    from .operators.geo_join import nearest_listing_km
    return rnd(nearest_listing_km(requests(spark, sf), listings(spark, sf)))


@query("p13_location_validation", f"""
with {_NEAREST_SQL}
select req_id, round(d, 6) as min_distance_km, d <= 15.0 as ok, 15.0::double as limit_km from nd
""")
def p13_location_validation(spark, sf):
    from .operators.geo_join import validate_location
    return rnd(validate_location(requests(spark, sf), listings(spark, sf)))


_KNN_COLS = KNN_FEATURES


def _knn_sql() -> str:
    b = (f"select id, latitude, longitude, cast(accommodates as double) as accommodates, bedrooms, beds, "
         f"{S.first_number('bathrooms_text')} as bathrooms_numeric, {S.money('price')} as price_clean from listings")
    notnull = " and ".join(f"{c} is not null" for c in _KNN_COLS)
    stats = ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}, "
                      f"median({c}) as md_{c}" for c in _KNN_COLS)
    focus = {"latitude": "latitude", "longitude": "longitude", "accommodates": "cast(accommodates as double)",
             "bedrooms": "bedrooms", "beds": "beds", "bathrooms_numeric": "bathrooms", "price_clean": "null"}
    zf = ", ".join(f"(coalesce({focus[c]}, md_{c}) - m_{c}) / s_{c} as {c}" for c in _KNN_COLS)
    zb = ", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in _KNN_COLS)
    dist = " + ".join(f"pow(zb.{c} - zf.{c}, 2)" for c in _KNN_COLS)
    return f"""with b as (select * from ({b}) where {notnull}),
st as (select {stats} from b),
zb as (select id, {zb} from b, st),
zf as (select req_id, {zf} from requests, st),
d as (select zf.req_id, zb.id, sqrt({dist}) as dist from zf, zb),
r as (select req_id, id, row_number() over (partition by req_id order by dist, id) as rn from d)
select req_id, id from r where rn <= 100"""


@query("j04_similar_ids", _knn_sql())
def j04_similar_ids(spark, sf):
    from .operators.knn import similar_ids
    focus = requests(spark, sf).select(
        "req_id", "latitude", "longitude", "accommodates", "bedrooms", "beds",
        F.col("bathrooms").alias("bathrooms_numeric"))
    return similar_ids(listings(spark, sf), focus, focus_id="req_id").select("req_id", "id")


@query("j05_landmark_distances", "select id, landmark, round(dist, 6) as dist from (unpivot (select id, "
       + ", ".join(S.landmark_distance_cols()) + " from listings) on columns(* exclude (id)) into name landmark value dist)")
def j05_landmark_distances(spark, sf):
    l = listings(spark, sf).select("id", *G.landmark_distances())
    names = G.landmark_names()
    return l.select("id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("landmark"), F.round(F.col(n), 6).alias("dist")) for n in names])).alias("kv")
    ).select("id", "kv.landmark", "kv.dist").where(F.col("dist").isNotNull())


@query("j06_district_mapping", "select req_id, case neighbourhood " + " ".join(
    f"when '{k}' then '{v}'" for k, v in __import__("lodgeprice.constants", fromlist=["x"]).NEIGHBOURHOOD_TO_RAW.items())
    + " else neighbourhood end as raw_district from requests")
def j06_district_mapping(spark, sf):
    return requests(spark, sf).select("req_id", P.raw_district("neighbourhood").alias("raw_district"))


@query("j07_district_resolver", "select id, case " + " ".join(
    f"when contains(coalesce(nullif(neighbourhood_group_cleansed, ''), ''), '{k}') then '{v}'"
    for k, v in __import__("lodgeprice.constants", fromlist=["x"]).SUBURB_TO_NEIGHBOURHOOD)
    + " else '' end as neighbourhood from listings")
def j07_district_resolver(spark, sf):
    from .operators.geo_join import resolve_district
    return listings(spark, sf).select("id", resolve_district("neighbourhood_group_cleansed").alias("neighbourhood"))


# ---------------------------------------------------------------------------
# M1 scaler, U3 request features, U7 marker, U8 batch comps, S3/S5 stats table
# ---------------------------------------------------------------------------

@query("m01_zscore", _knn_sql().split("zf as")[0].rstrip().rstrip(",")
       + "\nselect id, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in KNN_FEATURES) + " from zb")
def m01_zscore(spark, sf):
    from .operators.knn import knn_table, zscore, zscore_stats
    b = knn_table(listings(spark, sf))
    return rnd(zscore(b, zscore_stats(b, KNN_FEATURES), ["id"]))


def _request_feature_sql() -> str:
    from .constants import AMENITIES
    from .functions.text import column_name
    avg = ("select coalesce(avg(host_experience), 365.0) as a_host, "
           "(select coalesce(avg(host_total_listings_count), 1.0) from listings) as a_nl, "
           + ", ".join(f"coalesce(avg({c}), 4.7) as a_{c}" for c in REVIEW_COLUMNS)
           + ", coalesce(avg(number_of_reviews), 50.0) as a_nr, coalesce(avg(bedrooms), 1.0) as a_bed, "
           "coalesce(avg(beds), 1.0) as a_beds, coalesce(avg(bathrooms), 1.0) as a_bath from feat")
    slug = ("replace(replace(replace(replace(regexp_replace(lower(neighbourhood), '[ \\-]', '_', 'g'), 'ö', 'oe'), "
            "'ä', 'ae'), 'ü', 'ue'), '.', '')")
    districts = ", ".join(
        f"cast(coalesce({slug} = '{column_name('is_', d, 'district')[3:]}', false)::int as double) as "
        f"{column_name('is_', d, 'district')}" for d in S.FIXTURE_DISTRICTS)
    rooms = ", ".join(f"cast(coalesce(room_type = '{v}', false)::int as double) as {column_name('is_', v, 'room')}"
                      for v in S.FIXTURE_ROOMS)
    amen = ", ".join(f"cast(list_contains(from_json(amenities_json, '[\"VARCHAR\"]'), '{a}')::int as double) as "
                     f"{column_name('has_', a, 'amenity')}" for a in AMENITIES)
    reviews = ", ".join(f"coalesce({c}, a_{c}) as {c}" for c in REVIEW_COLUMNS)
    dists = ", ".join(S.landmark_distance_cols())
    from .functions.geo import landmark_names
    dn = landmark_names()
    an = [column_name("has_", a, "amenity") for a in AMENITIES]
    return f"""with {S.feature_ctes()},
av as ({avg}),
rq as (select req_id, cast(accommodates as double) as accommodates, coalesce(bedrooms, a_bed) as bedrooms,
  coalesce(beds, a_beds) as beds, coalesce(bathrooms, a_bath) as bathrooms,
  coalesce(number_of_reviews, a_nr) as number_of_reviews, coalesce(host_experience_days, a_host) as host_experience,
  cast(coalesce(coalesce(num_listings, a_nl) > 2, false)::int as double) as is_professional_host,
  {reviews}, {rooms}, {districts}, {dists}, {amen}, property_type from requests, av),
rf as (select *, bedrooms / greatest(accommodates, 1) as bedroom_density, beds / greatest(accommodates, 1) as beds_per_person,
  bathrooms / greatest(accommodates, 1) as bathrooms_per_person, bedrooms + bathrooms as total_rooms,
  ({' + '.join(dn)}) / 6 as avg_dist_to_landmark,
  list_aggregate([{', '.join(REVIEW_COLUMNS)}], 'stddev_pop') as review_score_std,
  least({', '.join(dn)}) as min_dist_to_landmark, {' + '.join(an)} as total_amenities from rq)
select req_id, feature, round(value, 6) as value from (unpivot (select * exclude (property_type) from rf)
  on columns(* exclude (req_id)) into name feature value value)
union all
select s.req_id, 'property_' || lower(replace(top.v, ' ', '_')), cast(coalesce(s.property_type = top.v, false)::int as double)
from rq s join top on true
union all
select req_id, 'property_other', cast(coalesce(property_type = 'Other', false)::int as double) from rq"""


@query("u03_request_features", _request_feature_sql())
def u03_request_features(spark, sf):
    from .plans.features import build_request_features, feature_columns
    feat, spec = featured(spark, sf)
    avg = A.safe_means(feat, listings(spark, sf)).first().asDict()  # one pass; the table is not reused
    rf = build_request_features(fx.requests_with_amenities(spark, sf), spec, avg)
    return _long(rf, feature_columns(spec), "req_id").withColumnRenamed("req_id", "req_id")


@query("u07_focus_marker", """
select req_id, latitude, longitude, cast(null as double) as price_clean, 'blue' as tier,
  case when bedrooms is null or bedrooms = 0 then 'N/A' else cast(bedrooms as varchar) end as bedrooms,
  case when beds is null or beds = 0 then 'N/A' else cast(beds as varchar) end as beds,
  case when bathrooms is null or bathrooms = 0 then 'N/A' else cast(bathrooms as varchar) end as bathrooms,
  case when accommodates is null or accommodates = 0 then 'N/A' else cast(accommodates as varchar) end as accommodates
from requests where latitude is not null and longitude is not null
""")
def u07_focus_marker(spark, sf):
    return C.focus_markers(requests(spark, sf))


def _combination_sql(columns: list[str]) -> str:
    """CTEs: ``base`` listings, ``f`` requests with their filters, ``m`` the general rule per combination."""
    raw = " ".join(f"when '{k}' then '{v}'" for k, v in C.P.NEIGHBOURHOOD_TO_RAW.items())
    source = {"neighbourhood_group_cleansed": f"case when neighbourhood <> '' then case neighbourhood {raw} else neighbourhood end end",
              "bedrooms": "cast(bedrooms as double)"}
    rule = " and ".join(f"(c.f_{x} is null or b.{x} = c.f_{x})" for x in columns)
    return f"""base as (select id, neighbourhood_group_cleansed, bedrooms, latitude, longitude, {S.money('price')} as price_clean
              from ({_comps_base_sql()})),
f as (select req_id, {", ".join(f"{source[x]} as f_{x}" for x in columns)} from requests),
c as (select distinct {", ".join(f"f_{x}" for x in columns)} from f),
m as (select c.*, b.* exclude (neighbourhood_group_cleansed, bedrooms) from c join base b on {rule})"""


@query("u08_comps_batch", f"""
with {_combination_sql(["neighbourhood_group_cleansed", "bedrooms"])},
t as (select *, quantile_cont(price_clean, 1/3) over w as lo, quantile_cont(price_clean, 2/3) over w as hi
      from m window w as (partition by f_neighbourhood_group_cleansed, f_bedrooms))
select f_neighbourhood_group_cleansed, f_bedrooms, id, price_clean,
  case when price_clean <= lo then 'red' when price_clean <= hi then 'orange' else 'green' end as tier
from t where latitude is not null and longitude is not null
""")
def u08_comps_batch(spark, sf):
    filters, active = C.comps_filters(requests(spark, sf), same_district=True, same_bedrooms=True)
    return C.comps_batch(listings(spark, sf), filters, active)


@query("u08_comps_per_request", f"""
with {_combination_sql(["bedrooms"])}
select req_id, f_bedrooms, (select count(*) from m where m.f_bedrooms is not distinct from f.f_bedrooms
  and latitude is not null and longitude is not null) as n_comps
from f
""")
def u08_comps_per_request(spark, sf):
    filters, active = C.comps_filters(requests(spark, sf), same_bedrooms=True)
    return C.comps_per_request(C.comps_batch(listings(spark, sf), filters, active), filters, active)


# stand-in choices of the map's filters: each request turns some on by its number; one in ten is in advanced mode
_ALL_FILTERS = {
    "bedrooms": "case when req_id % 3 = 0 then bedrooms end", "beds": "case when req_id % 5 = 0 then beds end",
    "accommodates": "case when req_id % 4 = 1 then accommodates end",
    "property_type": "case when req_id % 6 = 5 then property_type end", "room_type": "case when req_id % 4 = 3 then room_type end",
    "price_min": "case when req_id % 3 = 1 then cast(20 * (req_id % 7) as double) end",
    "price_max": "case when req_id % 5 = 1 then cast(150 + 20 * (req_id % 7) as double) end",
    "rating_min": "case when req_id % 5 = 2 then 2.5 + (req_id % 3) end",
}


def _all_filters_sql() -> str:
    cols = ", ".join(f"{e} as {c}" for c, e in _ALL_FILTERS.items())
    equal = " and ".join(f"(f.{c} is null or l.{c} = f.{c})" for c in ("bedrooms", "beds", "accommodates", "property_type", "room_type"))
    return f"""
with f as (select req_id, {cols} from requests),
l as (select id, bedrooms, beds, accommodates, property_type, room_type, latitude, longitude,
        coalesce(review_scores_rating, 0) as rating, {S.money('price')} as price
      from listings where {S.money('price')} is not null and {S.money('price')} <= 3000 and not ({SP.split_sql()})),
sim as (select * from ({_knn_sql()}) where req_id % 10 = 9),
m as (
  select f.req_id, l.* from f join l on {equal} and (price_min is null or price >= price_min)
    and (price_max is null or price <= price_max) and (rating_min is null or rating >= rating_min)
  where f.req_id % 10 <> 9 or (f.req_id, l.id) in (select (req_id, id) from sim)),
q as (select req_id, quantile_cont(price, 1/3) as lo, quantile_cont(price, 2/3) as hi from m group by req_id),
t as (select m.req_id, id, case when price <= lo then 'red' when price <= hi then 'orange' else 'green' end as tier
      from m join q using (req_id) where latitude is not null and longitude is not null)
select f.req_id, count(id) as n_comps, coalesce(sum(id), 0)::bigint as id_sum, count(id) filter (tier = 'red') as n_red,
  count(id) filter (tier = 'orange') as n_orange, count(id) filter (tier = 'green') as n_green
from f left join t using (req_id) group by f.req_id"""


@query("u08_comps_all_filters", _all_filters_sql())
def u08_comps_all_filters(spark, sf):
    """U8 with every filter of the map and the advanced mode: per request, its comps by tier."""
    from .operators.knn import similar_ids
    asked = requests(spark, sf)
    filters = asked.select("req_id", *[F.expr(e).alias(c) for c, e in _ALL_FILTERS.items()])
    focus = asked.where("req_id % 10 = 9").select("req_id", "latitude", "longitude", "accommodates", "bedrooms", "beds",
                                                 F.col("bathrooms").alias("bathrooms_numeric"))
    similar = similar_ids(listings(spark, sf), focus, focus_id="req_id").select("req_id", "id")
    combos, found = C.comps_by_filters(listings(spark, sf), filters, similar)
    tiers = found.groupBy("combo").agg(
        F.count("*").alias("n_comps"), F.sum("id").cast("long").alias("id_sum"),
        *[F.count(F.when(F.col("tier") == t, 1)).alias(f"n_{t}") for t in ("red", "orange", "green")])
    return combos.join(tiers, "combo", "left").drop("combo").na.fill(0)


@query("j03_similar_semijoin", f"""
with base as (select id, accommodates, latitude, longitude, {S.money('price')} as price_clean from ({_comps_base_sql()})),
cases as (select 'set' as case_, * from base where id in (select id from listings where accommodates = 4)
          union all select 'empty' as case_, * from base),
t as (select *, quantile_cont(price_clean, 1/3) over w as lo, quantile_cont(price_clean, 2/3) over w as hi
      from cases window w as (partition by case_))
select case_, id, price_clean, case when price_clean <= lo then 'red' when price_clean <= hi then 'orange' else 'green' end as tier
from t where latitude is not null and longitude is not null
""")
def j03_similar_semijoin(spark, sf):
    raw = listings(spark, sf)
    similar = raw.where("accommodates = 4").select("id")
    return C.comps(raw, similar_ids=similar).select(F.lit("set").alias("case_"), "id", "price_clean", "tier").union(
        C.comps(raw, similar_ids=similar.limit(0)).select(F.lit("empty").alias("case_"), "id", "price_clean", "tier"))


_G1_SQL = ORACLE["g01_safe_means"]


@query("s03_json_stats")
def s03_json_stats(spark, sf):
    from .sources import io
    from .session import scratch_path
    feat, _ = featured(spark, sf)
    path = scratch_path(spark, "stats-json")
    io.write_stats(A.safe_means(feat, listings(spark, sf)), path)
    return rnd(io.read_stats(spark, path))


@query("s05_defaults_cascade")
def s05_defaults_cascade(spark, sf):
    from .sources import io
    from .session import scratch_path
    feat, _ = featured(spark, sf)
    raw = listings(spark, sf)
    path, missing = scratch_path(spark, "stats-json"), scratch_path(spark, "no-stats-here")
    io.write_stats(A.safe_means(feat, raw), path)
    levels = {"file": io.load_defaults(spark, path, raw), "raw": io.load_defaults(spark, missing, raw),
              "constants": io.load_defaults(spark, missing)}
    out = None
    for level, table in levels.items():
        table = table.withColumn("level", F.lit(level))
        out = table if out is None else out.unionByName(table)
    return rnd(out)


ORACLE["s03_json_stats"] = _G1_SQL
_RAW_MEANS = {k: f"avg({k})" for k in DEFAULT_AVERAGES} | {
    "num_listings": "avg(host_total_listings_count)",
    "bathrooms": "null",  # raw listings hold bathrooms as text only
    "host_experience_days": "avg(datediff('day', try_cast(cast(host_since as varchar) as date), try_cast(last_scraped as date)))",
}
_RAW_SQL = fx.with_views(f"""
select {", ".join(f"round(coalesce({e}, {DEFAULT_AVERAGES[k]}), 6) as {k}" for k, e in _RAW_MEANS.items())} from listings
""")
ORACLE["s05_defaults_cascade"] = f"""
select 'file' as level, * from ({_G1_SQL})
union all by name select 'raw' as level, * from ({_RAW_SQL})
union all by name select 'constants' as level, {", ".join(f"{v}::double as {k}" for k, v in DEFAULT_AVERAGES.items())}
"""


# ---------------------------------------------------------------------------
# 2.8 learning operators (rows-only checks: model outputs have no SQL oracle)
# ---------------------------------------------------------------------------

def _model_data(spark, sf):
    """Feature table, names, spec; ``benchmark`` keeps both parts of the table itself."""
    from .plans.features import feature_columns
    feat, spec = featured(spark, sf)
    return feat, feature_columns(spec), spec


def _kept_model_data(spark, sf):
    """The same, kept for the fit, scoring and statistics passes."""
    from pyspark import StorageLevel

    feat, cols, spec = _model_data(spark, sf)
    return feat.persist(StorageLevel.MEMORY_AND_DISK), cols, spec


def _bench_one(name: str, search: bool):
    def run(spark, sf):
        from .plans.models import benchmark
        feat, cols, _ = _model_data(spark, sf)
        return rnd(benchmark(feat, cols, [name], search=search).drop("fit_seconds"))
    run.__name__ = f"bench_{name}"
    return run


for _key, _name in [
    ("m02_linear_regression", "linear_regression"),
    ("m06_decision_tree", "decision_tree"),
    ("m07_random_forest", "random_forest"),
    ("m08_gradient_boosting", "sklearn_gbr"),
    ("m09_histogram_boosting", "histgb_tuned"),
    ("m10_xgboost_tuned", "xgboost_tuned"),
    ("m10_xgboost_improved", "xgboost_improved"),
    ("m11_lightgbm_tuned", "lightgbm_tuned"),
    ("m12_catboost_tuned", "catboost_tuned"),
    ("m14_log_target", "xgboost_log_enhanced"),
]:
    QUERIES[_key] = _bench_one(_name, search=_name in ("random_forest", "histgb_tuned"))


def m13_mlp_regressor(spark, sf):
    """The perceptron of the model comparison, fitted on the training part; KPIs on the test part, and those of the constant mean."""
    from .plans import mlp
    feat, cols, _ = _kept_model_data(spark, sf)
    test = SP.is_test("id")
    model = mlp.fit(feat.where(~test), cols)
    scored = model.predict(feat.where(test), ["price"])
    mean = scored.withColumn("prediction", F.lit(float(model.mean[-1])))
    out = A.regression_kpis(scored).withColumn("model", F.lit("mlp")).unionByName(
        A.regression_kpis(mean).withColumn("model", F.lit("mean")))
    return rnd(out.withColumn("steps", F.lit(model.steps)).withColumn("best_step", F.lit(model.best_step)))


QUERIES["m13_mlp_regressor"] = m13_mlp_regressor


_LINE_SQL = f"""
{S.kept_cte()},
tr as (select * from kept where not ({SP.split_sql()})),
te as (select * from kept where {SP.split_sql()}),
line as (select regr_slope(price, accommodates) as a, regr_intercept(price, accommodates) as b,
                regr_slope(price, coalesce(bedrooms, 1)) as a2, regr_intercept(price, coalesce(bedrooms, 1)) as b2 from tr)
"""


def _line_rows(spark, sf):
    """The few columns of the line, written once: the passes of the fits and of the scoring don't repeat the joins."""
    from .plans.preprocess import clean
    from .sources.io import parquet_roundtrip
    rows = clean(listings(spark, sf)).select("id", "price", "accommodates", F.coalesce("bedrooms", F.lit(1.0)).alias("bedrooms"))
    return parquet_roundtrip(spark, rows)


@query("m02_regression_line", f"with {_LINE_SQL} select id, round(a * accommodates + b, 6) as prediction from te, line")
def m02_regression_line(spark, sf):
    """M2 on one feature: predictions of the test part against the closed form."""
    from .plans.models import fit, predict
    rows = _line_rows(spark, sf)
    model = fit("linear_regression", SP.train_part(rows), ["accommodates"])
    return rnd(predict(model, SP.test_part(rows), ["id"]))


@query("m19_saved_models", f"""
with {_LINE_SQL},
p as (select 'by_guests' as model, price, a * accommodates + b as prediction from te, line
      union all select 'by_bedrooms', price, a2 * coalesce(bedrooms, 1) + b2 from te, line)
select model, count(*) as n, round(sqrt(avg((prediction - price) * (prediction - price))), 6) as rmse,
  round(avg(abs(prediction - price)), 6) as mae from p group by model
""")
def m19_saved_models(spark, sf):
    """M19 over models saved by S4; the third folder holds no model and is left out."""
    from .plans.evaluate import evaluate_saved
    from .plans.models import fit
    from .session import scratch_path
    from .sources import io
    rows = _line_rows(spark, sf)
    train = SP.train_part(rows)
    paths = {name: io.save_model(fit("linear_regression", train, [col]), scratch_path(spark, "model"))
             for name, col in [("by_guests", "accommodates"), ("by_bedrooms", "bedrooms")]}
    paths["broken"] = scratch_path(spark, "no-model-here")
    return rnd(evaluate_saved(paths, SP.test_part(rows)).select("model", "n", "rmse", "mae"))


@query("m03_ridge_grid_search")
def m03_ridge_grid_search(spark, sf):
    """M3 + M15: all 5 alphas, 5 stable folds, refit best, test KPIs."""
    from .plans.models import benchmark
    feat, cols, _ = _model_data(spark, sf)
    return rnd(benchmark(feat, cols, ["ridge"], search=True).drop("fit_seconds"))


@query("m04_lasso_grid_search")
def m04_lasso_grid_search(spark, sf):
    from .plans.models import benchmark
    feat, cols, _ = _model_data(spark, sf)
    return rnd(benchmark(feat, cols, ["lasso"], search=True).drop("fit_seconds"))


@query("m16_random_search")
def m16_random_search(spark, sf):
    """12 seeded draws of each grid (20 points of k-NN; all of the smaller ones), 5 folds, refit best, test KPIs.

    The boosters' and the forest's grids are searched in the same way by their own queries and by M18.
    """
    from .operators.knn import KNN_KS, KNN_PS, KNN_WEIGHTS, knn_regress, knn_search
    from .plans.models import SEARCH_ITER, benchmark, grid_points
    feat, cols, _ = _kept_model_data(spark, sf)
    board = benchmark(feat, cols, ["decision_tree", "ridge", "lasso"], search=True)
    train, test = SP.train_part(feat), SP.test_part(feat)
    drawn = grid_points({"k": list(KNN_KS), "weights": list(KNN_WEIGHTS), "p": list(KNN_PS)}, SEARCH_ITER)
    best, _ = knn_search(train, cols, points=[(d["k"], d["weights"], d["p"]) for d in drawn])
    scored = knn_regress(train, test, cols, **best).join(test.select("id", "price"), "id")
    knn = A.regression_kpis(scored).drop("n").withColumns({"model": F.lit("knn"), "params": F.lit(str(best))})
    return rnd(board.drop("fit_seconds").unionByName(knn, allowMissingColumns=True))


def _two_column_ridge_sql() -> str:
    alphas = "[0.01, 0.1, 1.0, 10.0, 100.0]::double[]"
    solve = "((n + alpha) * b1 - n * r * b2) / ((n + alpha) * (n + alpha) - n * r * n * r)"
    other = "((n + alpha) * b2 - n * r * b1) / ((n + alpha) * (n + alpha) - n * r * n * r)"
    stats = """count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2,
    corr(x1, x2) as r, count(*) * covar_pop(x1, y) / stddev_pop(x1) as b1, count(*) * covar_pop(x2, y) / stddev_pop(x2) as b2"""
    return f"""
with {S.kept_cte()},
d as (select id, price as y, accommodates as x1, coalesce(bedrooms, 1) as x2, {SP.split_sql()} as is_test, {SP.fold_sql()} as f
      from kept),
tr as (select * from d where not is_test),
sets as (select unnest([0, 1, 2, 3, 4, 9]) as left_out),
st as (select left_out, {stats} from sets join tr on f <> left_out group by left_out),
w as (select *, {solve} as w1, {other} as w2 from st, (select unnest({alphas}) as alpha)),
e as (select alpha, left_out, sqrt(avg(pow(y - my - w1 * (x1 - m1) / s1 - w2 * (x2 - m2) / s2, 2))) as rmse
      from w join tr on f = left_out group by alpha, left_out),
best as (select alpha from e group by alpha order by avg(rmse), alpha limit 1)
select id, alpha, round(my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2, 6) as prediction
from w join best using (alpha), d where left_out = 9 and is_test"""


def _one_column_lasso_sql() -> str:
    return f"""
with {S.kept_cte()},
d as (select id, price as y, accommodates as x, {SP.split_sql()} as is_test, {SP.fold_sql()} as f from kept),
tr as (select * from d where not is_test),
sets as (select unnest([0, 1, 2, 3, 4, 9]) as left_out),
st as (select left_out, avg(x) as m, avg(y) as my, stddev_pop(x) as s, covar_pop(x, y) / stddev_pop(x) as pull
       from sets join tr on f <> left_out group by left_out),
w as (select *, sign(pull) * greatest(abs(pull) - alpha, 0) as w from st, (select unnest([0.01, 0.1, 1.0, 10.0, 100.0]::double[]) as alpha)),
e as (select alpha, left_out, sqrt(avg(pow(y - my - w * (x - m) / s, 2))) as rmse
      from w join tr on f = left_out group by alpha, left_out),
best as (select alpha from e group by alpha order by avg(rmse), alpha limit 1)
select id, alpha, round(my + w * (x - m) / s, 6) as prediction from w join best using (alpha), d where left_out = 9 and is_test"""


def _few_columns(spark, sf, name: str, cols: list[str]):
    from .plans.models import cv_search, predict
    rows = _line_rows(spark, sf)
    model, params, _ = cv_search(name, SP.train_part(rows), cols, n_iter=None)
    return rnd(predict(model, SP.test_part(rows), ["id"]).withColumn("alpha", F.lit(params["alpha"])))


@query("m03_ridge_two_columns", _two_column_ridge_sql())
def m03_ridge_two_columns(spark, sf):
    """M3 + M15 on two features: alpha by 5 folds, test predictions against the closed form."""
    return _few_columns(spark, sf, "ridge", ["accommodates", "bedrooms"])


@query("m04_lasso_one_column", _one_column_lasso_sql())
def m04_lasso_one_column(spark, sf):
    """M4 + M15 on one feature: alpha by 5 folds, test predictions against soft thresholding."""
    return _few_columns(spark, sf, "lasso", ["accommodates"])


@query("m14_log_line", f"""
with {S.kept_cte()},
line as (select regr_slope(ln(1 + price), accommodates) as a, regr_intercept(ln(1 + price), accommodates) as b
         from kept where not ({SP.split_sql()}))
select id, round(exp(a * accommodates + b) - 1, 6) as prediction from kept, line where {SP.split_sql()}
""")
def m14_log_line(spark, sf):
    """M14 around a line of one feature: fitted on log1p(price), predicted with expm1."""
    from .plans.models import fit, predict
    rows = _line_rows(spark, sf)
    return rnd(predict(fit("linear_regression_log", SP.train_part(rows), ["accommodates"]), SP.test_part(rows), ["id"]))


def _knn_regressor_sql() -> str:
    """The whole grid search in SQL: per fold the deviations of the other folds, the 15 nearest for p = 1 and 2."""
    from .functions.text import column_name as cn
    from .operators.knn import KNN_KS, KNN_WEIGHTS
    from .plans.features import DERIVED

    flags = [cn("is_", v, "room") for v in S.FIXTURE_ROOMS] + [cn("is_", v, "district") for v in S.FIXTURE_DISTRICTS]
    cols = S.IMPUTED + ["is_professional_host"] + flags + S.amenity_names() + DERIVED
    wide = [f"cast({c} as double) as x{i}" for i, c in enumerate(cols)]
    wide += [f"coalesce(property_type = names[{i + 1}], false)::int::double as x{len(cols) + i}" for i in range(15)]
    wide += [f"(not coalesce(list_contains(names, property_type), false))::int::double as x{len(cols) + 15}"]
    xs = [f"x{i}" for i in range(len(wide))]
    devs = ", ".join(f"coalesce(nullif(stddev_pop(t.{x}), 0), 1) as {x}" for x in xs)
    gap = [f"abs(q.{x} - c.{x})" for x in xs]
    scaled = ", ".join(f"t.{x} / s.{x} as {x}" for x in xs) + f", [{', '.join(f't.{x} / s.{x}' for x in xs)}]::double[{len(xs)}] as v"
    dists = f"{' + '.join(gap)} as d1, array_distance(q.v, c.v) as d2"
    picks = ", ".join(f"arg_min({{'dist': d{p}, 'y': y}}, {{'dist': d{p}, 'id': cid}}, 15) as n{p}" for p in (1, 2))
    points = [(k, w, p) for p in (1, 2) for k in KNN_KS for w in KNN_WEIGHTS]

    def guess(k, w, p):
        use = f"n{p}[1:{k}]"
        ys = f"list_avg([n.y for n in {use}])"
        if w == "uniform":
            return ys
        zero = f"[n.y for n in {use} if n.dist = 0]"
        return (f"case when len({zero}) > 0 then list_avg({zero}) else "
                f"list_sum([n.y / n.dist for n in {use}]) / list_sum([1 / n.dist for n in {use}]) end")

    names = [str({"k": k, "weights": w, "p": p}).replace("'", "''") for k, w, p in points]
    grid = " union all ".join(f"select {i} as i, qid, f, qy, {guess(*x)} as g, '{names[i]}' as params from near"
                              for i, x in enumerate(points))
    return f"""
with {S.feature_ctes()},
names as (select list(v) as names from top),
w as materialized (
  select id, price as y, {SP.split_sql()} as is_test, {SP.fold_sql()} as f, {", ".join(wide)} from feat, names),
tr as materialized (select * from w where not is_test),
sets as (select unnest([0, 1, 2, 3, 4, 9]) as f),
s as materialized (select sets.f as sf, {devs} from sets join tr t on t.f <> sets.f group by sets.f),
ask as (select id, y, f, {", ".join(xs)} from tr union all select id, y, 9, {", ".join(xs)} from w where is_test),
qs as materialized (select t.id, t.y, t.f, {scaled} from ask t join s on t.f = s.sf),
cs as materialized (select t.id, t.y, s.sf as f, {scaled} from s join tr t on t.f <> s.sf),
pair as (select q.id as qid, q.f, q.y as qy, c.id as cid, c.y, {dists} from qs q join cs c on q.f = c.f),
near as materialized (select qid, f, any_value(qy) as qy, {picks} from pair group by qid, f),
g as ({grid}),
per_fold as (select i, params, f, sqrt(avg(pow(g - qy, 2))) as rmse from g where f <> 9 group by all),
best as (select i, params from (select i, params, avg(rmse) as r from per_fold group by all) order by r, i limit 1),
t as (select params, qy, g from g join best using (i, params) where f = 9)
select count(*) as n, round(sqrt(avg(pow(g - qy, 2))), 6) as rmse, round(avg(abs(g - qy)), 6) as mae,
  round(1 - sum(pow(g - qy, 2)) / sum(pow(qy - m, 2)), 6) as r2,
  round(avg(abs(g - qy) / greatest(abs(qy), 1e-8)) * 100, 6) as mape, 'knn' as model, any_value(params) as params
from t, (select avg(qy) as m from t)
"""


@query("m05_knn_regressor", _knn_regressor_sql())
def m05_knn_regressor(spark, sf):
    """M5 + M15: z-scored features, k x weights x p grid over 5 stable folds, test KPIs of the best."""
    from .operators.knn import knn_regress, knn_search
    feat, cols, _ = _kept_model_data(spark, sf)
    train, test = SP.train_part(feat), SP.test_part(feat)
    best, _ = knn_search(train, cols)
    pred = knn_regress(train, test, cols, **best)
    scored = pred.join(test.select("id", "price"), "id")
    return rnd(A.regression_kpis(scored).withColumns({"model": F.lit("knn"), "params": F.lit(str(best))}))


@query("m17_stacking")
def m17_stacking(spark, sf):
    """4 re-aimed boosters as bases (out-of-fold, 5 folds), passthrough inputs, ridge meta (alpha by CV)."""
    from .plans.models import stack
    feat, cols, _ = _kept_model_data(spark, sf)
    feat = feat.cache()
    train, test = SP.train_part(feat), SP.test_part(feat)
    score = stack(train, cols, ["xgboost_improved", "catboost_tuned", "lightgbm_tuned", "xgboost_log_enhanced"])
    scored = score(test, ["id", "price"])
    return rnd(A.regression_kpis(scored).withColumns({"model": F.lit("stacking_ensemble"), "n_trees": F.lit(str(score.trees))}))


@query("m18_benchmark_leaderboard")
def m18_benchmark_leaderboard(spark, sf):
    """M18 + O2 + G11: all candidates searched on train, the stack, KPIs on test, sorted, gap to the best."""
    from .plans.models import LEADERBOARD, benchmark
    from .session import scratch_path
    feat, cols, _ = _model_data(spark, sf)
    board = benchmark(feat, cols, LEADERBOARD, search=True, folder=scratch_path(spark, "board"))
    best = board.agg(F.min("rmse")).first()[0]
    return rnd(board.drop("fit_seconds").withColumn("pct_over_best", (F.col("rmse") / F.lit(best) - 1) * 100))


def _served_model(spark, sf):
    from .plans.models import fit
    feat, cols, spec = _kept_model_data(spark, sf)
    model = fit("linear_regression", SP.train_part(feat), cols)
    return model, feat, cols, spec


@query("s04_model_persist")
def s04_model_persist(spark, sf):
    """Save the fitted pipeline, load it back, score the test part."""
    from .plans.models import predict
    from .session import scratch_path
    from .sources import io
    model, feat, cols, _ = _served_model(spark, sf)
    path = io.save_model(model, scratch_path(spark, "model"))
    loaded = io.load_model(path)
    return rnd(A.regression_kpis(predict(loaded, SP.test_part(feat), ["id", "price"])))


@query("u04_score_requests")
def u04_score_requests(spark, sf):
    """U4: location check, limits, request features, model, floor, cents."""
    from .plans.scoring import score
    model, feat, cols, spec = _served_model(spark, sf)
    avg = A.safe_means(feat, listings(spark, sf)).first().asDict()
    return rnd(score(fx.requests_with_amenities(spark, sf), listings(spark, sf), model, spec, avg))


@query("u04_line_scores", f"""
with {_LINE_SQL}, {_NEAREST_SQL},
r as (select q.req_id, q.latitude, q.longitude, nd.d, q.accommodates,
        case when nd.d > 15.0 then printf('Location too far from known listings (nearest is %.1f km; limit is 15.0 km).', nd.d)
             else {P.limit_violation_sql()} end as reject_reason
      from requests q left join nd on q.req_id = nd.req_id)
select req_id, round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(d, 6) as min_distance_km, reject_reason,
  case when reject_reason is null then round(round_even(greatest(a * accommodates + b, 30.0), 2), 6) end as predicted_price
from r, line
""")
def u04_line_scores(spark, sf):
    """U4 in full with the closed-form line (M2 on guests) as its model."""
    from .plans.models import fit
    from .plans.scoring import score
    feat, spec = featured(spark, sf)
    avg = A.safe_means(feat, listings(spark, sf)).first().asDict()
    model = fit("linear_regression", SP.train_part(_line_rows(spark, sf)), ["accommodates"])
    return rnd(score(fx.requests_with_amenities(spark, sf), listings(spark, sf), model, spec, avg))


@query("u05_score_stream")
def u05_score_stream(spark, sf):
    """Request files arrive in a folder; a Structured Streaming query scores them (availableNow).

    The index of the listings is built once, before the stream; every micro-batch searches the written one.
    """
    from .operators.geo_join import ListingIndex
    from .plans.scoring import score
    from .session import scratch_path
    from .streaming.score_stream import score_stream
    model, feat, cols, spec = _served_model(spark, sf)
    avg = A.safe_means(feat, listings(spark, sf)).first().asDict()
    lst = ListingIndex.build(listings(spark, sf))
    reqs = fx.requests_with_amenities(spark, sf)
    in_dir, out_dir, ck = (scratch_path(spark, x) for x in ("req-in", "req-out", "req-ckpt"))
    reqs.repartition(4).write.parquet(in_dir)
    schema = spark.read.parquet(in_dir).schema
    score_stream(spark, in_dir, out_dir, ck, schema, lambda b: score(b, lst, model, spec, avg))
    return rnd(spark.read.parquet(out_dir).drop("batch_id"))


@query("t03_synthetic_rows")
def t03_synthetic_rows(spark, sf):
    """T3 + the original random-prediction test: 1000 rows from the feature profile, scored, floored."""
    from .plans.models import predict
    model, feat, cols, _ = _served_model(spark, sf)
    prof = [r.asDict() for r in A.column_profile(feat, cols).collect()]
    rows = SP.sample_rows(prof, 1000, seed=42, spark=spark)
    scored = predict(model, rows, ["row_id"])
    return rnd(scored.select("row_id", SC.price_floor("prediction").alias("prediction")))


_T3_COLS = ["accommodates", "bedrooms", "price", "is_professional_host"]


def _synthetic_sql() -> str:
    def draw(i, part):
        return f"(('0x' || substring(md5(concat_ws('|', row_id, {i}, 42, {part})), 1, 12))::bigint + 0.5::double) / {16.0 ** 12}"

    cols = []
    for i, c in enumerate(_T3_COLS):
        normal = f"m{i} + s{i} * sqrt(-2 * ln({draw(i, 0)})) * cos(2 * pi() * {draw(i, 1)})"
        cols.append(f"""round(case when b{i} then ({draw(i, 0)} < least(greatest(m{i}, 0), 1))::int::double
          when l{i} >= 0 then greatest({normal}, 0) else {normal} end, 6) as {c}""")
    stats = ", ".join(f"""avg({c}) as m{i}, case when stddev_samp({c}) > 0 then stddev_samp({c})
      else greatest(0.1 * abs(avg({c})), 1e-3) end as s{i}, bool_and({c} in (0, 1)) as b{i}, min({c}) as l{i}"""
                      for i, c in enumerate(_T3_COLS))
    return f"""
with {S.feature_ctes()}, p as (select {stats} from feat), r as (select unnest(range(1000)) as row_id)
select row_id, {", ".join(cols)} from r, p"""


@query("t03_sample_rows", _synthetic_sql())
def t03_sample_rows(spark, sf):
    """T3 alone: 1000 rows drawn by hash from the profile of four feature columns."""
    feat, _ = featured(spark, sf)
    prof = {r["col"]: r.asDict() for r in A.column_profile(feat, _T3_COLS).collect()}
    return rnd(SP.sample_rows([prof[c] for c in _T3_COLS], 1000, seed=42, spark=spark))
