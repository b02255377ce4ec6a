"""The ``listings`` and ``requests`` views derived from the test tables.

The raw listing scrape and the request stream do not exist as test tables, so
both are derived from ``orders``/``customer``/``lineitem`` by fixed rules
(FIXTURES.md §2–3). The Spark side builds them as DataFrame plans; the same
rules as SQL text feed the DuckDB oracle.

Plan shape (Spark): lines per order and orders per customer are computed with
``groupBy`` (partial aggregation on the map side, so a hot order or customer
is combined before the shuffle) and joined back by key; AQE's skew-join split
handles a customer holding a large share of all orders. A window
``count(*) over (partition by o_custkey)`` would instead put a hot customer's
rows into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _case_mod(key: Column, modulus: int, values: list[str]) -> Column:
    m = key % modulus
    expr = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(m == i, F.lit(v))
    return expr


def _money_text(cents: Column) -> Column:
    """'$' + dollars with a thousands comma (below $1,000,000) + '.' + two-digit cents."""
    dollars = F.floor(cents / F.lit(1e2)).cast("bigint")
    big = F.concat(
        F.floor(cents / F.lit(1e5)).cast("bigint").cast("string"),
        F.lit(","),
        F.lpad((dollars % 1000).cast("string"), 3, "0"),
    )
    body = F.when(cents >= 100000, big).otherwise(dollars.cast("string"))
    return F.concat(F.lit("$"), body, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw listing per order, with planted nulls, bad JSON, bad dates and outliers."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    lines = (
        read_table(spark, sf_dir, "lineitem", ["l_orderkey"])
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("host_n"))
    cust = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey, "inner").select(
        "c_custkey", "c_nationkey", "host_n"
    )
    b = (
        orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
        # the partitioning of the next join, given here: adaptive execution would end a small table in one task
        .repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
        .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_nationkey", "host_n",
            F.coalesce(F.col("n_lines"), F.lit(0)).alias("n_rev"),
        )
    )
    k = F.col("o_orderkey")
    cents = (
        F.lit(2000) + F.lit(2500) * (1 + k % 16) + F.lit(3000) * ((k * 7) % 6)
        + F.floor(F.col("o_totalprice") / F.lit(2e1))
        + F.when(k % 211 == 0, 300000).when(k % 53 == 0, 90000).otherwise(0)
    ).cast("bigint")
    pt = F.floor(F.sqrt((k * 13) % 400)).cast("int")
    no_rev = F.col("n_rev") == 0

    def score(divisor: int) -> Column:
        return F.when(no_rev, F.lit(None).cast("double")).otherwise(F.lit(3.0) + (k % divisor) / F.lit(1e1))

    amen = F.concat(
        F.lit('["Essentials"'),
        F.when(k % 2 == 0, F.lit(', "Wifi"')).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit(', "Kitchen"')).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit(', "Washer"')).otherwise(F.lit("")),
        F.when(k % 7 == 0, F.lit(', "Free washer"')).otherwise(F.lit("")),
        F.when(k % 9 == 0, F.lit(', "Rooftop"')).otherwise(F.lit("")),
        F.lit("]"),
    )
    null_d = F.lit(None).cast("double")
    return (
        b.withColumn("cents", cents)
        .select(
            k.alias("id"),
            F.when(k % 41 == 0, F.lit(None).cast("date")).otherwise(F.col("o_orderdate").cast("date")).alias("host_since"),
            F.when(k % 101 == 0, F.lit("n/a")).when(k % 2 == 0, F.lit("2025-09-23")).otherwise(F.lit("2025-09-24")).alias("last_scraped"),
            F.when(k % 37 == 0, null_d).otherwise((F.col("host_n") % 6).cast("double")).alias("host_total_listings_count"),
            F.when(k % 29 == 0, F.lit(None).cast("string")).otherwise(_money_text(F.col("cents"))).alias("price"),
            (1 + k % 16).cast("int").alias("accommodates"),
            F.when(k % 11 == 0, null_d).otherwise(((k * 7) % 6).cast("double")).alias("bedrooms"),
            F.when(k % 13 == 0, null_d).otherwise((1 + (k * 5) % 8).cast("double")).alias("beds"),
            _case_mod(F.col("o_custkey"), 4, ["Entire home/apt", "Private room", "Shared room", "Hotel room"]).alias("room_type"),
            _case_mod(F.col("c_nationkey"), 12, [
                "Pankow", "Neukölln", "Mitte", "Friedrichshain-Kreuzberg", "Charlottenburg-Wilm.",
                "Tempelhof - Schöneberg", "Lichtenberg", "Steglitz - Zehlendorf", "Treptow - Köpenick",
                "Reinickendorf", "Marzahn - Hellersdorf", "Spandau",
            ]).alias("neighbourhood_group_cleansed"),
            F.when(k % 499 == 0, null_d).otherwise(F.lit(52.34) + ((k * 7919) % 3300) / F.lit(1e4)).alias("latitude"),
            F.when(k % 499 == 0, null_d).otherwise(F.lit(13.09) + ((k * 104729) % 6600) / F.lit(1e4)).alias("longitude"),
            F.when(k % 89 == 0, F.lit(None).cast("string")).when(k % 97 == 0, F.lit('["Wifi"')).otherwise(amen).alias("amenities"),
            _case_mod(k, 6, ["1 bath", "1.5 baths", "2 shared baths", "Half-bath", None, "1 private bath"]).alias("bathrooms_text"),
            F.when(k % 307 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Type "), pt.cast("string"))).alias("property_type"),
            F.col("n_rev").cast("int").alias("number_of_reviews"),
            score(21).alias("review_scores_rating"),
            score(19).alias("review_scores_accuracy"),
            score(17).alias("review_scores_cleanliness"),
            score(13).alias("review_scores_checkin"),
            score(11).alias("review_scores_communication"),
            score(7).alias("review_scores_location"),
            score(5).alias("review_scores_value"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pricing request per customer; every tenth is far away, some exceed limits."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    k = F.col("c_custkey")
    null_d = F.lit(None).cast("double")

    def score(divisor: int) -> Column:
        return F.when(k % 5 == 0, null_d).otherwise(F.lit(3.0) + (k % divisor) / F.lit(1e1))

    return c.select(
        k.alias("req_id"),
        (F.lit(52.34) + ((k * 6007) % 3300) / F.lit(1e4) + F.when(k % 10 == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("latitude"),
        (F.lit(13.09) + ((k * 3001) % 6600) / F.lit(1e4)).alias("longitude"),
        _case_mod(F.col("c_nationkey"), 4, ["Mitte", "Neukoelln", "Charlottenburg-Wilm.", "Nowhere"]).alias("neighbourhood"),
        _case_mod(k, 5, ["Entire home/apt", "Private room", "Shared room", "Hotel room", "Tent"]).alias("room_type"),
        _case_mod(k, 3, ["Type 19", "Other", "Type 0"]).alias("property_type"),
        (k % 18).cast("int").alias("accommodates"),
        F.when(k % 4 == 0, null_d).otherwise((k % 12).cast("double")).alias("bedrooms"),
        F.when(k % 6 == 0, null_d).otherwise((k % 11).cast("double")).alias("beds"),
        F.when(k % 7 == 0, null_d).otherwise((k % 13) / F.lit(2.0)).alias("bathrooms"),
        _case_mod(k, 3, ['["Wifi","Kitchen"]', "[]", '["Free washer"]']).alias("amenities_json"),
        F.when(k % 8 == 0, null_d).otherwise((k % 4000).cast("double")).alias("host_experience_days"),
        F.when(k % 9 == 0, null_d).otherwise((k % 6).cast("double")).alias("num_listings"),
        score(21).alias("review_scores_rating"),
        null_d.alias("review_scores_accuracy"),
        score(19).alias("review_scores_cleanliness"),
        score(17).alias("review_scores_checkin"),
        score(13).alias("review_scores_communication"),
        score(11).alias("review_scores_location"),
        score(7).alias("review_scores_value"),
        F.when(k % 10 == 1, null_d).otherwise((k % 300).cast("double")).alias("number_of_reviews"),
    )


def requests_with_amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` with the predict-time ``amenities`` array parsed from its JSON text."""
    r = requests(spark, sf_dir)
    return r.withColumn("amenities", F.from_json("amenities_json", "array<string>")).withColumn("use_averages", F.lit(False))


# ---------------------------------------------------------------------------
# SQL text of the same views, for the DuckDB oracle.
# ---------------------------------------------------------------------------

LISTINGS_SQL = """
with li as (select l_orderkey k, count(*) n from lineitem group by l_orderkey),
b as (
  select o.*, c.c_nationkey, coalesce(li.n, 0) n_rev,
    count(*) over (partition by o_custkey) host_n,
    cast(floor(sqrt((o_orderkey * 13) % 400)) as int) pt,
    cast(2000 + 2500 * (1 + o_orderkey % 16) + 3000 * ((o_orderkey * 7) % 6)
      + floor(o_totalprice / 2e1)
      + case when o_orderkey % 211 = 0 then 300000 when o_orderkey % 53 = 0 then 90000 else 0 end as bigint) cents
  from orders o join customer c on o.o_custkey = c.c_custkey
  left join li on li.k = o.o_orderkey)
select o_orderkey id,
  case when o_orderkey % 41 = 0 then null else cast(o_orderdate as date) end host_since,
  case when o_orderkey % 101 = 0 then 'n/a' when o_orderkey % 2 = 0 then '2025-09-23' else '2025-09-24' end last_scraped,
  case when o_orderkey % 37 = 0 then null else cast(host_n % 6 as double) end host_total_listings_count,
  case when o_orderkey % 29 = 0 then null else concat('$',
    case when cents >= 100000
      then concat(cast(cast(floor(cents / 1e5) as bigint) as varchar(20)), ',', lpad(cast(cast(floor(cents / 1e2) as bigint) % 1000 as varchar(20)), 3, '0'))
      else cast(cast(floor(cents / 1e2) as bigint) as varchar(20)) end,
    '.', lpad(cast(cents % 100 as varchar(20)), 2, '0')) end price,
  cast(1 + o_orderkey % 16 as int) accommodates,
  case when o_orderkey % 11 = 0 then null else cast((o_orderkey * 7) % 6 as double) end bedrooms,
  case when o_orderkey % 13 = 0 then null else cast(1 + (o_orderkey * 5) % 8 as double) end beds,
  case o_custkey % 4 when 0 then 'Entire home/apt' when 1 then 'Private room' when 2 then 'Shared room' else 'Hotel room' end room_type,
  case c_nationkey % 12 when 0 then 'Pankow' when 1 then 'Neukölln' when 2 then 'Mitte' when 3 then 'Friedrichshain-Kreuzberg'
    when 4 then 'Charlottenburg-Wilm.' when 5 then 'Tempelhof - Schöneberg' when 6 then 'Lichtenberg' when 7 then 'Steglitz - Zehlendorf'
    when 8 then 'Treptow - Köpenick' when 9 then 'Reinickendorf' when 10 then 'Marzahn - Hellersdorf' else 'Spandau' end neighbourhood_group_cleansed,
  case when o_orderkey % 499 = 0 then null else 52.34e0 + ((o_orderkey * 7919) % 3300) / 1e4 end latitude,
  case when o_orderkey % 499 = 0 then null else 13.09e0 + ((o_orderkey * 104729) % 6600) / 1e4 end longitude,
  case when o_orderkey % 89 = 0 then null when o_orderkey % 97 = 0 then '["Wifi"' else concat('["Essentials"',
    case when o_orderkey % 2 = 0 then ', "Wifi"' else '' end, case when o_orderkey % 3 = 0 then ', "Kitchen"' else '' end,
    case when o_orderkey % 5 = 0 then ', "Washer"' else '' end, case when o_orderkey % 7 = 0 then ', "Free washer"' else '' end,
    case when o_orderkey % 9 = 0 then ', "Rooftop"' else '' end, ']') end amenities,
  case o_orderkey % 6 when 0 then '1 bath' when 1 then '1.5 baths' when 2 then '2 shared baths' when 3 then 'Half-bath' when 4 then null else '1 private bath' end bathrooms_text,
  case when o_orderkey % 307 = 0 then null else concat('Type ', cast(pt as varchar(20))) end property_type,
  cast(n_rev as int) number_of_reviews,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 21) / 1e1 end review_scores_rating,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 19) / 1e1 end review_scores_accuracy,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 17) / 1e1 end review_scores_cleanliness,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 13) / 1e1 end review_scores_checkin,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 11) / 1e1 end review_scores_communication,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 7) / 1e1 end review_scores_location,
  case when n_rev = 0 then null else 3e0 + (o_orderkey % 5) / 1e1 end review_scores_value
from b
"""

REQUESTS_SQL = """
select c_custkey req_id,
  52.34e0 + ((c_custkey * 6007) % 3300) / 1e4 + case when c_custkey % 10 = 0 then 1e0 else 0e0 end latitude,
  13.09e0 + ((c_custkey * 3001) % 6600) / 1e4 longitude,
  case c_nationkey % 4 when 0 then 'Mitte' when 1 then 'Neukoelln' when 2 then 'Charlottenburg-Wilm.' else 'Nowhere' end neighbourhood,
  case c_custkey % 5 when 0 then 'Entire home/apt' when 1 then 'Private room' when 2 then 'Shared room' when 3 then 'Hotel room' else 'Tent' end room_type,
  case c_custkey % 3 when 0 then 'Type 19' when 1 then 'Other' else 'Type 0' end property_type,
  cast(c_custkey % 18 as int) accommodates,
  case when c_custkey % 4 = 0 then null else cast(c_custkey % 12 as double) end bedrooms,
  case when c_custkey % 6 = 0 then null else cast(c_custkey % 11 as double) end beds,
  case when c_custkey % 7 = 0 then null else (c_custkey % 13) / 2e0 end bathrooms,
  case c_custkey % 3 when 0 then '["Wifi","Kitchen"]' when 1 then '[]' else '["Free washer"]' end amenities_json,
  case when c_custkey % 8 = 0 then null else cast(c_custkey % 4000 as double) end host_experience_days,
  case when c_custkey % 9 = 0 then null else cast(c_custkey % 6 as double) end num_listings,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 21) / 1e1 end review_scores_rating,
  cast(null as double) review_scores_accuracy,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 19) / 1e1 end review_scores_cleanliness,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 17) / 1e1 end review_scores_checkin,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 13) / 1e1 end review_scores_communication,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 11) / 1e1 end review_scores_location,
  case when c_custkey % 5 = 0 then null else 3e0 + (c_custkey % 7) / 1e1 end review_scores_value,
  case when c_custkey % 10 = 1 then null else cast(c_custkey % 300 as double) end number_of_reviews
from customer
"""


def with_views(body: str) -> str:
    """Wrap an oracle query so that ``listings`` and ``requests`` exist as CTEs."""
    head = f"with listings as ({LISTINGS_SQL}), requests as ({REQUESTS_SQL})"
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        return f"{head},\n{stripped[5:]}"
    return f"{head}\n{body}"
