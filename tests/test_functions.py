"""Edge cases of the column functions on tiny hand-made frames."""

import math

from pyspark.sql import functions as F

from lodgeprice.functions import encode as E
from lodgeprice.functions import geo as G
from lodgeprice.functions import rowstats as RS
from lodgeprice.functions import scalar as SC
from lodgeprice.functions import text as TX


def test_money_parse(spark):
    df = spark.createDataFrame([("$1,234.50",), ("$80.00",), ("abc",), (None,)], "p string")
    got = [r[0] for r in df.select(TX.money("p")).collect()]
    assert got == [1234.5, 80.0, None, None]
    junk = [r[0] for r in df.select(TX.money_is_junk("p")).collect()]
    assert junk == [False, False, True, False]


def test_first_number(spark):
    df = spark.createDataFrame([("1.5 baths",), ("Half-bath",), ("1. x",), (None,), ("2 shared baths",)], "t string")
    got = [r[0] for r in df.select(TX.first_number("t")).collect()]
    assert got == [1.5, None, 1.0, None, 2.0]


def test_json_list_corner_cases(spark):
    rows = [('["Wifi", "Kitchen"]',), ("[]",), ('["Wifi"',), ('{"Wifi": 1}',), (None,)]
    df = spark.createDataFrame(rows, "a string")
    got = [r[0] for r in df.select(F.size(TX.json_list("a"))).collect()]
    assert got == [2, 0, 0, 0, 0]


def test_slugs():
    assert TX.column_name("is_", "Tempelhof - Schöneberg", "district") == "is_tempelhof_schoeneberg"
    assert TX.column_name("is_", "Charlottenburg-Wilm.", "district") == "is_charlottenburg_wilm"
    assert TX.column_name("is_", "Entire home/apt", "room") == "is_entire_home_apt"
    assert TX.column_name("dist_", "Reichstagsgebäude", "landmark") == "dist_reichstagsgebaeude"
    assert E.amenity_names()[-1] == "has_free_washer"
    assert len(E.amenity_names()) == 20


def test_slug_col_matches_driver_slug(spark):
    names = ["Tempelhof - Schöneberg", "Neukölln", "Charlottenburg-Wilm.", "Mitte"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(TX.slug_col("n", "district")).collect()]
    assert got == [TX.collapse_underscores(TX.slug(n, "district")) for n in names]


def test_haversine_known_distance(spark):
    df = spark.range(1).select(G.haversine_km(F.lit(52.516275), F.lit(13.377704), F.lit(52.521918), F.lit(13.413215)))
    d = df.first()[0]
    assert abs(d - 2.4767) < 0.01


def test_row_std_ddof_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, None, None), (None, None, None)], "a double, b double, c double")
    s1 = [r[0] for r in df.select(RS.row_std(["a", "b", "c"], ddof=1)).collect()]
    s0 = [r[0] for r in df.select(RS.row_std(["a", "b", "c"], ddof=0)).collect()]
    assert abs(s1[0] - 1.0) < 1e-12 and s1[1] is None and s1[2] is None
    assert abs(s0[0] - math.sqrt(2 / 3)) < 1e-12 and s0[1] == 0.0 and s0[2] is None
    m = [r[0] for r in df.select(RS.row_mean(["a", "b", "c"])).collect()]
    assert m == [2.0, 4.0, None]
    mn = [r[0] for r in df.select(RS.row_min(["a", "b", "c"])).collect()]
    assert mn == [1.0, 4.0, None]


def test_per_person_zero_guests(spark):
    df = spark.createDataFrame([(2.0, 0), (3.0, 3)], "b double, acc int")
    train = [r[0] for r in df.select(SC.per_person("b", "acc")).collect()]
    serve = [r[0] for r in df.select(SC.per_person("b", "acc", mode="serve")).collect()]
    assert train == [2.0, 1.0] and serve == [2.0, 1.0]


def test_threshold_flag_train_and_serve(spark):
    df = spark.createDataFrame([(None,), (3.0,), (2.0,)], "n double")
    assert [r[0] for r in df.select(SC.threshold_flag("n")).collect()] == [0, 1, 0]
    assert [r[0] for r in df.select(SC.threshold_flag("n", fill=29.7)).collect()] == [1, 1, 0]


def test_round_cents_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    assert [r[0] for r in df.select(SC.round_cents("x")).collect()] == [0.12, 0.38, 2.5]


def test_property_other_train_vs_serve(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,), ("Other",)], "p string")
    tr = df.select(*E.one_hot_top("p", ["A"], mode="train")).collect()
    sv = df.select(*E.one_hot_top("p", ["A"], mode="serve")).collect()
    assert [r["property_other"] for r in tr] == [0, 1, 1, 1]
    assert [r["property_other"] for r in sv] == [0, 0, 0, 1]


def test_clamp_field(spark):
    df = spark.createDataFrame([("0",), ("abc",), ("20",), ("3",)], "v string")
    got = [r[0] for r in df.select(SC.clamp_field("v", 1, 15, 1, zero_is_missing=True)).collect()]
    assert got == [1.0, 1.0, 15.0, 3.0]
