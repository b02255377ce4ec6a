"""SQL text of the column rules, for the DuckDB oracle of each registered query.

Each fragment states the same rule as the Spark column function of the same
name; the oracle runs on the ``listings``/``requests`` CTEs of
``sources.fixtures.with_views``.
"""

from __future__ import annotations

from .constants import AMENITIES, LANDMARKS, REFERENCE_DATE, REVIEW_COLUMNS
from .functions.encode import amenity_names
from .functions.geo import landmark_names
from .functions.text import column_name


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def money(c: str) -> str:
    return f"try_cast(replace(replace({c}, '$', ''), ',', '') as double)"


def first_number(c: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, '[0-9]+\\.?[0-9]*', 0), '') as double)"


def json_list(c: str) -> str:
    return f"coalesce(from_json(case when json_valid({c}) then {c} end, '[\"VARCHAR\"]'), [])"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p1, l1, p2, l2 = (f"radians({x})" for x in (lat1, lon1, lat2, lon2))
    a = f"pow(sin(({p2} - {p1}) / 2), 2) + cos({p1}) * cos({p2}) * pow(sin(({l2} - {l1}) / 2), 2)"
    return f"(12742.0 * asin(sqrt({a})))"


def landmark_distance_cols(lat: str = "latitude", lon: str = "longitude") -> list[str]:
    return [f"{haversine(lat, lon, repr(la), repr(lo))} as {name}"
            for name, (_, la, lo) in zip(landmark_names(), LANDMARKS)]


def amenity_flag_cols(parsed: str) -> list[str]:
    return [f"coalesce(list_contains({parsed}, '{a}'), false)::int as {n}" for a, n in zip(AMENITIES, amenity_names())]


def one_hot_cols(col: str, values: list[str], prefix: str, kind: str) -> list[str]:
    out = []
    for v in values:
        lit = v.replace("'", "''")
        out.append(f"coalesce({col} = '{lit}', false)::int as {column_name(prefix, v, kind)}")
    return out


def kept_cte() -> str:
    """P1, F3, F4, F1, P4, P5 as a CTE named ``kept``."""
    price = money("price")
    return f"""kept as (
  select id,
    datediff('day', try_cast(cast(host_since as varchar) as date), date '{REFERENCE_DATE}') as host_experience,
    coalesce(host_total_listings_count > 2, false)::int as is_professional_host,
    {price} as price,
    accommodates, bedrooms, beds, room_type, neighbourhood_group_cleansed, latitude, longitude, amenities,
    bathrooms_text, property_type, number_of_reviews, {", ".join(REVIEW_COLUMNS)}
  from listings
  where {price} is not null and {price} <= 3000)"""


def row_mean(cols: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(f'cast({c} as double)' for c in cols)}], lambda x: x is not null))"


def row_std(cols: list[str], ddof: int = 1) -> str:
    fn = "stddev_samp" if ddof == 1 else "stddev_pop"
    lst = f"list_filter([{', '.join(f'cast({c} as double)' for c in cols)}], lambda x: x is not null)"
    return f"case when len({lst}) > {ddof} then list_aggregate({lst}, '{fn}') end"


def stand_in_prediction() -> str:
    return "(40 + 20 * accommodates + 25 * coalesce(bedrooms, 1))"


__all__ = [
    "amenity_flag_cols", "first_number", "haversine", "json_list", "kept_cte", "landmark_distance_cols", "money",
    "one_hot_cols", "r6", "row_mean", "row_std", "stand_in_prediction",
]


FIXTURE_ROOMS = ["Entire home/apt", "Hotel room", "Private room", "Shared room"]
FIXTURE_DISTRICTS = [
    "Charlottenburg-Wilm.", "Friedrichshain-Kreuzberg", "Lichtenberg", "Marzahn - Hellersdorf", "Mitte",
    "Neukölln", "Pankow", "Reinickendorf", "Spandau", "Steglitz - Zehlendorf", "Tempelhof - Schöneberg",
    "Treptow - Köpenick",
]

IMPUTED = (["host_experience", "accommodates", "bedrooms", "beds", "number_of_reviews"] + REVIEW_COLUMNS
           + ["bathrooms"] + landmark_names())


def feature_ctes() -> str:
    """CTEs kept -> top (top-15 property types) -> enc -> med -> imp (U1) -> feat (U2 derived)."""
    from .functions.text import column_name as cn

    rooms = one_hot_cols("room_type", FIXTURE_ROOMS, "is_", "room")
    dists = one_hot_cols("neighbourhood_group_cleansed", FIXTURE_DISTRICTS, "is_", "district")
    flag_names = ([cn("is_", v, "room") for v in FIXTURE_ROOMS] + [cn("is_", v, "district") for v in FIXTURE_DISTRICTS]
                  + amenity_names())
    base_double = ["price", "accommodates", "bedrooms", "beds", "number_of_reviews"] + REVIEW_COLUMNS + [
        "host_experience", "is_professional_host"]
    enc_cols = ", ".join([f"cast({c} as double) as {c}" for c in base_double] + rooms + dists
                         + landmark_distance_cols() + amenity_flag_cols(json_list("amenities"))
                         + [f"{first_number('bathrooms_text')} as bathrooms", "property_type"])
    med = ", ".join(f"median({c}) as {c}" for c in IMPUTED)
    imp_cols = ", ".join(
        ["enc.id", "enc.property_type"]
        + [f"coalesce(enc.{c}, med.{c}) as {c}" for c in IMPUTED]
        + [f"enc.{c} as {c}" for c in ["price", "is_professional_host"]]
        + [f"cast(enc.{c} as double) as {c}" for c in flag_names]
    )
    dist = landmark_names()
    den = "case when accommodates = 0 then 1 else accommodates end"
    derived = ", ".join([
        f"bedrooms / {den} as bedroom_density",
        f"beds / {den} as beds_per_person",
        f"bathrooms / {den} as bathrooms_per_person",
        "bedrooms + bathrooms as total_rooms",
        f"{row_mean(dist)} as avg_dist_to_landmark",
        f"{row_std(REVIEW_COLUMNS, 1)} as review_score_std",
        f"least({', '.join(dist)}) as min_dist_to_landmark",
        f"cast({' + '.join(amenity_names())} as double) as total_amenities",
    ])
    return f"""{kept_cte()},
top as (select property_type as v from kept where property_type is not null group by property_type
        order by count(*) desc, property_type limit 15),
enc as (select id, {enc_cols} from kept),
med as (select {med} from enc),
imp as (select {imp_cols} from enc, med),
feat as (select *, {derived} from imp)"""


def property_long(src: str = "imp") -> str:
    """Top-15 property flags plus property_other as (id, feature, value) rows."""
    return f"""select s.id, 'property_' || lower(replace(top.v, ' ', '_')) as feature,
  cast(coalesce(s.property_type = top.v, false)::int as double) as value from {src} s join top on true
union all
select id, 'property_other', cast(case when property_type in (select v from top) then 0 else 1 end as double)
from {src}"""
