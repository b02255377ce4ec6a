"""Operators: exact quantiles, split stability, folds, KPIs, nearest distance, k-NN."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgeprice.operators import aggregates as A
from lodgeprice.operators import quantiles as Q
from lodgeprice.operators import split as SP
from lodgeprice.operators.geo_join import nearest_listing_km
from lodgeprice.operators.knn import nearest, similar_ids
from lodgeprice.operators.quantiles import exact_medians, exact_quantiles, kth_smallest


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(2001)] + [5.0] * 300 + [None] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    clean = np.array([v for v in vals if v is not None])
    probs = [0.1, 1 / 3, 0.5, 2 / 3, 0.9]
    got = exact_quantiles(df, "x", probs)
    want = np.quantile(clean, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    med = exact_medians(df, ["x"])["x"]
    assert abs(med - float(np.median(clean))) < 1e-12


def test_exact_quantiles_any_range(spark):
    wide = [10.0 ** -i for i in range(298)]
    columns = {
        "wide": wide,
        "ends": [-1.7e308, 1.7e308, float("inf"), float("-inf"), 0.0, 1.0, 2.0],
        "tiny": [5e-324 * i for i in range(50)],
        "hot": [3.0] * 900 + [1.0, 2.0, 4.0],
        "many": [float((i * 7919) % 30011) for i in range(30011)],
    }
    for vals in columns.values():
        df = spark.createDataFrame([(v,) for v in vals + [float("nan"), None]], "x double").repartition(4)
        n, order = len(vals), sorted(vals)
        ranks = sorted({0, 1, n // 3, n // 2, n - 1})
        assert kth_smallest(df, {"x": ranks + [n]}) == {("x", k): order[k] for k in ranks}


def test_exact_quantiles_narrow_beyond_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(Q, "ACCURACY", 40)
    rnd = random.Random(9)
    vals = [rnd.choice([rnd.gauss(0, 1e6), rnd.random(), 7.0]) for _ in range(5000)]
    df = spark.createDataFrame([(v, -v) for v in vals], "x double, y double").repartition(4)
    order = sorted(vals)
    got = kth_smallest(df, {"x": [0, 1666, 2500, 4999], "y": lambda n: [n // 4]})
    assert got == {("x", k): order[k] for k in (0, 1666, 2500, 4999)} | {("y", 1250): -order[4999 - 1250]}


def test_exact_median_even_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (11.0, None)], "a double, b double")
    m = exact_medians(df, ["a", "b"])
    assert m == {"a": 6.0, "b": None}


def test_split_stable_under_repartition(spark):
    df = spark.range(5000).select(F.col("id"))
    a = {r.id for r in SP.test_part(df).collect()}
    b = {r.id for r in SP.test_part(df.repartition(13, "id")).collect()}
    assert a == b
    assert 0.17 < len(a) / 5000 < 0.23


def test_folds_disjoint_and_cover(spark):
    df = SP.train_part(spark.range(3000)).select("id", SP.fold_of("id").alias("fold"))
    rows = df.collect()
    assert {r.fold for r in rows} == {0, 1, 2, 3, 4}
    assert len({r.id for r in rows}) == len(rows)


def test_kpis_perfect_prediction(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (5.0, 5.0)], "price double, prediction double")
    k = A.regression_kpis(df).first()
    assert k["rmse"] == 0 and k["mae"] == 0 and k["r2"] == 1.0 and k["mape"] == 0


def test_top_values_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "p string")
    assert A.top_values(df, "p", 2) == ["c", "a"]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = {r.bin: r.n for r in A.histogram(df, "x").collect()}
    assert sum(h.values()) == 11 and h[9] == 2


def _brute_min(req, pts):
    from math import asin, cos, radians, sin, sqrt
    out = {}
    for rid, la, lo in req:
        best = None
        for pa, po in pts:
            a = sin((radians(pa) - radians(la)) / 2) ** 2 + cos(radians(la)) * cos(radians(pa)) * sin(
                (radians(po) - radians(lo)) / 2) ** 2
            d = 12742.0 * asin(sqrt(a))
            best = d if best is None or d < best else best
        out[rid] = best
    return out


def test_nearest_listing_exact_against_brute_force(spark):
    rnd = random.Random(7)
    pts = [(52.3 + rnd.random() * 0.4, 13.1 + rnd.random() * 0.6) for _ in range(400)]
    pts += [(52.5, 13.4)] * 50  # a hot spot
    req = [(i, 52.3 + rnd.random() * 0.4, 13.1 + rnd.random() * 0.6) for i in range(60)]
    req += [(100, 60.0, 13.0), (101, -33.9, 151.2), (102, 52.5, 13.4)]
    ldf = spark.createDataFrame(pts, "latitude double, longitude double")
    rdf = spark.createDataFrame(req, "req_id long, latitude double, longitude double")
    got = {r.req_id: r.min_distance_km for r in nearest_listing_km(rdf, ldf).collect()}
    want = _brute_min(req, pts)
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-6 * max(1.0, want[k])


def test_listing_index_is_built_once_and_far_requests_meet_few_cells(spark, tmp_path):
    from lodgeprice.operators.geo_join import LEVELS, ListingIndex, candidate_cells

    rnd = random.Random(11)
    pts = [(52.3 + rnd.random() * 0.4, 13.1 + rnd.random() * 0.6) for _ in range(5000)]
    pts += [(-89.9, 179.9), (-36.8, -179.9), (-36.8, 179.95)]
    listings = spark.createDataFrame(pts + [(None, 1.0)], "latitude double, longitude double")
    ListingIndex.build(listings, str(tmp_path / "index"))
    index = ListingIndex.load(spark, str(tmp_path / "index"))
    req = [(1, 0.0, -60.0), (2, 89.0, 0.0), (3, -37.0, -179.99), (4, 52.5, 13.4), (5, -88.0, 10.0), (6, 10.0, 100.0), (7, None, 3.0)]
    rdf = spark.createDataFrame(req, "req_id long, latitude double, longitude double")
    want = _brute_min([r for r in req if r[1] is not None], pts)
    got = {r.req_id: r.min_distance_km for r in nearest_listing_km(rdf, index).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 * max(1.0, want[k]) for k in want)
    for level in range(LEVELS):
        most = candidate_cells(rdf, index, level).groupBy("rid").count().agg(F.max("count")).first()[0]
        assert most <= 60, (level, most)  # of some 1,800 cells of the lowest level
    plan = nearest_listing_km(rdf, index)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_listing_no_listings_is_zero(spark):
    ldf = spark.createDataFrame([], "latitude double, longitude double")
    rdf = spark.createDataFrame([(1, 52.5, 13.4)], "req_id long, latitude double, longitude double")
    assert [r.min_distance_km for r in nearest_listing_km(rdf, ldf).collect()] == [0.0]


def test_knn_contains_itself_and_k_larger_than_n(spark):
    cand = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 5.0)], "id long, a double, b double")
    q = spark.createDataFrame([(10, 1.0, 0.0)], "qid long, a double, b double")
    got = [(r.id, r.rank) for r in nearest(q, cand, ["a", "b"], k=100).orderBy("rank").collect()]
    assert got[0] == (2, 1) and len(got) == 3


def test_neighbours_by_blocks_equal_brute_force(spark, monkeypatch):
    from lodgeprice.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(0)
    for width, p, apart in ((2, 2, False), (2, 1, True), (9, 2, True)):
        x = rng.integers(0, 9, (400, width)).astype(float)
        x[:130] = x[0]  # a third of the rows are one point
        grp = rng.integers(0, 3, 400)
        scales = {g: (rng.random(width) + 0.5).tolist() for g in range(3)}
        df = spark.createDataFrame([(i, int(grp[i]), x[i].tolist()) for i in range(400)], "id long, grp int, v array<double>")
        got = {r.qid: [(n.dist, n.cid) for n in r.near]
               for r in neighbours.nearest_rows(df, df, width, 7, p, scales, apart).collect()}
        assert len(got) == 400
        for i in range(400):
            gap = np.abs(x - x[i]) / np.array(scales[int(grp[i])])
            d = np.sqrt((gap * gap).sum(1)) if p == 2 else gap.sum(1)
            want = sorted((d[j], j) for j in range(400) if not (apart and grp[j] == grp[i]))[:7]
            assert np.allclose([a for a, _ in want], [a for a, _ in got[i]], atol=1e-12)
            assert len({c for _, c in got[i]}) == 7
    none = spark.createDataFrame([], df.schema)
    assert neighbours.nearest_rows(none, df, 9, 3).collect() == []
    assert all(r.near == [] for r in neighbours.nearest_rows(df, none, 9, 3).collect())


def test_cells_part_columns_of_few_values_and_long_tails():
    """A cell that equal values of one axis keep whole would be compared as a whole; cells next to each other in number are near."""
    from lodgeprice.operators.neighbours import Cells, _order

    rng = np.random.default_rng(6)
    n = 8000
    rows = np.column_stack([np.exp(3 * rng.normal(size=n)), rng.integers(0, 3, n), (rng.random(n) < 0.8) * 2.0, rng.normal(size=n)])
    rows[:500] = rows[0]
    cells = Cells(rows[::2], 64)
    of, (ends, sizes) = cells.of(rows), np.unique(cells.of(rows), return_counts=True)
    assert cells.leaves == len(ends) == 64 and set(ends) == set(range(64)) and sorted(sizes)[-2] < 3 * n / 64 and sizes.max() < 700
    assert len(np.unique(of[:500])) == 1 and (np.diff(of[np.argsort(of, kind="stable")]) >= 0).all()
    by = np.array([2.0, 1.0, 5.0, 0.5])
    assert (Cells(rows[::2], 64).scaled(by).of(rows * by) == of).all()
    assert Cells(np.ones((50, 3)), 8).leaves == 1 and Cells(np.empty((0, 3)), 8).of(np.ones((2, 3))).tolist() == [0, 0]
    odd = rows.copy()
    odd[::7, 3], odd[3, 0] = np.nan, np.inf
    assert Cells(odd, 16).of(odd).max() > 2
    row, dist, cid = rng.integers(0, 300, n), rng.integers(0, 40, n) / 4, rng.permutation(n)
    for d in (dist, rng.random(n), np.where(dist == 3, np.nan, dist)):
        assert (_order(row, d, cid) == np.lexsort((cid, d, row))).all()
    assert (_order(row * 1000, dist, cid) == np.lexsort((cid, dist, row))).all() and len(_order(row[:0], dist[:0], cid[:0])) == 0


def test_neighbours_send_a_query_once_to_a_region(spark, monkeypatch):
    """Of the many blocks a query needs nothing is sent by block; regions are small where most fall away, else as large as a task holds."""
    from lodgeprice.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "REGION", 2)
    monkeypatch.setattr(neighbours, "TILE", 32)
    asked, plain = [], neighbours._answered

    def spy(asks, blocks, per_region, fine, counts, *rest):
        asked.append((per_region, fine, counts))
        return plain(asks, blocks, per_region, fine, counts, *rest)

    monkeypatch.setattr(neighbours, "_answered", spy)
    rng = np.random.default_rng(3)
    for width, p, apart, held in ((2, 2, False, 1 << 20), (9, 1, True, 8 * 9 * 16 * 8)):
        monkeypatch.setattr(neighbours, "HELD", held)
        asked.clear()
        x = rng.integers(0, 30, (700, width)).astype(float)
        grp = rng.integers(0, 3, 700)
        df = spark.createDataFrame([(i, int(grp[i]), x[i].tolist()) for i in range(700)], "id long, grp int, v array<double>")
        scales = {g: [1.0 + g] * width for g in range(3)}
        got = {r.qid: [(n.dist, n.cid) for n in r.near] for r in neighbours.nearest_rows(df, df, width, 9, p, scales, apart).collect()}
        assert len(got) == 700
        for i in range(700):
            gap = np.abs(x - x[i]) / (1.0 + grp[i])
            d = np.sqrt((gap * gap).sum(1)) if p == 2 else gap.sum(1)
            want = sorted((d[j], j) for j in range(700) if not (apart and grp[j] == grp[i]))[:9]
            assert np.allclose([a for a, _ in want], [a for a, _ in got[i]], atol=1e-12)
            assert len({c for _, c in got[i]}) == 9 and all(abs(d[c] - a) < 1e-12 for a, c in got[i])
        (home, _, first), (region, fine, more) = asked
        assert sum(first.values()) == 700 and fine == home
        if width == 2:
            assert region == home and sum(more.values()) < 700 * 5
        else:
            assert region > home and region * 16 * 8 * width <= held * 1.5 and max(more.values()) <= 700


def test_neighbour_search_has_no_nested_loop_and_far_blocks_fall_away(spark):
    from lodgeprice.operators import neighbours

    df = spark.range(6000).select("id", F.lit(0).alias("grp"), F.array((F.col("id") % 77).cast("double"), (F.col("id") / 77)).alias("v"))
    found = neighbours.nearest_rows(df.where("id % 50 = 0"), df, 2, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 120


def test_similar_ids_single_listing(spark):
    raw = spark.createDataFrame(
        [(1, 52.5, 13.4, 2, 1.0, 1.0, "1 bath", "$100.00")],
        "id long, latitude double, longitude double, accommodates int, bedrooms double, beds double, "
        "bathrooms_text string, price string")
    focus = spark.createDataFrame([(7, 52.5, None)], "qid long, latitude double, longitude double")
    got = [r.id for r in similar_ids(raw, focus).collect()]
    assert got == [1]


def test_knn_search_against_brute_force(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lodgeprice.operators.knn import knn_search
    from lodgeprice.operators.split import fold_of

    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.integers(0, 12, 2)), float(rng.integers(50, 90))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, price double")
    fold = {r.id: r.f for r in df.select("id", fold_of("id", 2).alias("f")).collect()}
    scores = {}
    for p in (1, 2):
        for k in (2, 5):
            for w in ("uniform", "distance"):
                per = []
                for f in (0, 1):
                    tr, te = (np.array([r for r in rows if (fold[r[0]] == f) == x]) for x in (False, True))
                    m, s = tr[:, 1:3].mean(0), tr[:, 1:3].std(0)
                    errors = []
                    for t in te:
                        d = (np.abs((tr[:, 1:3] - m) / s - (t[1:3] - m) / s) ** p).sum(1) ** (1 / p)
                        at = np.lexsort((tr[:, 0], d.round(12)))[:k]
                        y, d = tr[at, 3], d[at]
                        if w == "uniform":
                            guess = y.mean()
                        else:
                            guess = y[d == 0].mean() if (d == 0).any() else (y / d).sum() / (1 / d).sum()
                        errors.append((guess - t[3]) ** 2)
                    per.append(np.sqrt(np.mean(errors)))
                scores[k, w, p] = np.mean(per)
    best, rmse = knn_search(df, ["a", "b"], ks=(2, 5), folds=2)
    assert (best["k"], best["weights"], best["p"]) == min(scores, key=scores.get)
    assert abs(rmse - min(scores.values())) < 0.2


def test_few_enclosed_values_need_no_sketch(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(Q, "_round", lambda *a: rounds.append(a))
    df = spark.createDataFrame([(float(i % 7), -float(i)) for i in range(500)], "x double, y double").repartition(3)
    got = kth_smallest(df, {"x": [0, 250, 499], "y": [10]})
    xs = sorted(i % 7 for i in range(500))
    assert got == {("x", 0): xs[0], ("x", 250): xs[250], ("x", 499): xs[499], ("y", 10): -489.0} and not rounds


def test_column_profile_merges_tasks_in_column_order(spark):
    from lodgeprice.operators.aggregates import column_profile

    rows = [(float(i), float(i % 2), None, 1e9 + i, None if i % 3 else 5.0) for i in range(100)]
    df = spark.createDataFrame(rows, "z double, a double, n double, big double, one double").repartition(4)
    got = [tuple(r) for r in column_profile(df, ["z", "a", "n", "big", "one"]).collect()]
    assert [r[0] for r in got] == ["z", "a", "n", "big", "one"]
    sd = np.std(np.arange(100.0), ddof=1)
    assert got[0][1:] == (pytest.approx(49.5), pytest.approx(sd), False, True)
    assert got[1][1:] == (pytest.approx(0.5), pytest.approx(np.std([0, 1] * 50, ddof=1)), True, True)
    assert got[2][1:] == (None, 1e-3, False, None)
    assert got[3][2] == pytest.approx(sd, rel=1e-9)
    assert got[4][1:] == (5.0, 0.5, False, True)
    empty = column_profile(df.limit(0), ["z"]).first()
    assert (empty["mean"], empty["std"], empty["binary"], empty["non_negative"]) == (None, 1e-3, True, None)
    assert "MapInArrow" in column_profile(df, ["z"])._jdf.queryExecution().toString()  # no aggregate of four functions a column
