"""Composed plans on the derived views (small scale) and the driver contract."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lodgeprice.plans import comps as C
from lodgeprice.plans.features import build_request_features, engineer_features, feature_columns
from lodgeprice.plans.preprocess import preprocess
from lodgeprice.sources import fixtures as fx


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert {r.tier for r in rows} <= {"red", "orange", "green"} and sum(r.n for r in rows) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_preprocess_has_no_nulls_and_names(spark):
    pre, spec = preprocess(fx.listings(spark, SF001))
    feat = engineer_features(pre)
    cols = feature_columns(spec)
    assert len(cols) == len(set(cols))
    nulls = feat.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first().asDict()
    assert all(v == 0 for v in nulls.values()), {k: v for k, v in nulls.items() if v}
    assert feat.where(F.col("price") > 3000).count() == 0


def test_small_tables_are_spread_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    raw = fx.listings(spark, SF001)
    assert raw.rdd.getNumPartitions() >= cores
    spread, _ = preprocess(raw)
    dealt, _ = preprocess(raw.coalesce(1))  # one task writes the cleaned rows
    assert len(spread.inputFiles()) >= cores and len(dealt.inputFiles()) >= cores
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, dealt.collect()))


def test_request_features_serving_rules(spark):
    pre, spec = preprocess(fx.listings(spark, SF001))
    req = fx.requests_with_amenities(spark, SF001)
    rf = build_request_features(req, spec, {})
    assert rf.count() == req.count()
    row = rf.where(F.col("req_id") == 3).first()  # property 'Type 19', 3 % 3 == 0
    assert row["property_other"] == 0
    other = rf.where(F.col("req_id") == 1).first()  # 'Other'
    assert other["property_other"] == 1


def test_comps_empty_result(spark):
    out = C.comps(fx.listings(spark, SF001), price_min=1e9)
    assert out.count() == 0


def test_comps_tiers_and_mappable(spark):
    out = C.comps(fx.listings(spark, SF001), room_type="Private room")
    rows = out.collect()
    assert rows and all(r.latitude is not None for r in rows)
    assert {r.tier for r in rows} <= {"red", "orange", "green"}


def test_focus_marker(spark):
    assert C.focus_marker(spark, None, 13.4, 100.0) is None
    m = C.focus_marker(spark, 52.5, 13.4, 99.0, bedrooms=0, beds=2).first()
    assert m.tier == "blue" and m.bedrooms == "N/A" and m.beds == "2"


def test_split_fraction_ends(spark):
    from pyspark.sql import functions as F

    from lodgeprice.operators.split import is_test

    ids = spark.range(300)
    assert ids.where(is_test("id", test_fraction=1.0)).count() == 300
    assert ids.where(is_test("id", test_fraction=0.0)).count() == 0
    assert ids.select(F.count_if(is_test("id"))).first()[0] in range(30, 100)


def test_sample_rows_do_not_depend_on_partitions(spark):
    from lodgeprice.operators.split import sample_rows

    profile = [{"col": "x", "binary": False, "mean": 5.0, "std": 2.0, "non_negative": True},
               {"col": "y", "binary": True, "mean": 0.3, "std": 0.4, "non_negative": True}]
    one = sample_rows(profile, 4000, 7, spark).toPandas()
    two = sample_rows(profile, 4000, 7, spark).repartition(3).toPandas().sort_values("row_id", ignore_index=True)
    assert one.equals(two)
    assert abs(one.x.mean() - 5) < 0.2 and abs(one.x.std() - 2) < 0.2 and abs(one.y.mean() - 0.3) < 0.05


def test_stack_learns_and_keeps_rows(spark):
    from lodgeprice.plans.models import stack

    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("price", 30 + 4 * F.col("a") - 2 * F.col("b"))
    score = stack(df, ["a", "b"], ["linear_regression", "decision_tree"], folds=2, alphas=(0.1, 1.0))
    got = score(df, ["id", "price"])
    assert got.columns == ["id", "price", "prediction"] and got.count() == 400
    assert got.agg(F.max(F.abs(F.col("price") - F.col("prediction")))).first()[0] < 1.0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_defaults_levels(spark, tmp_path):
    import pytest

    from lodgeprice.constants import DEFAULT_AVERAGES
    from lodgeprice.sources import io

    raw = spark.createDataFrame([("2020-01-01", "2020-01-11", 4.0), ("bad", "2020-01-11", None)],
                                "host_since string, last_scraped string, beds double")
    got = io.load_defaults(spark, str(tmp_path / "missing"), raw).first().asDict()
    assert got == DEFAULT_AVERAGES | {"host_experience_days": 10.0, "beds": 4.0}
    assert io.load_defaults(spark, None).first().asDict() == DEFAULT_AVERAGES
    io.write_stats(spark.createDataFrame([(7.0,)], "beds double"), str(tmp_path / "stats"))
    assert io.load_defaults(spark, str(tmp_path / "stats"), raw).first().asDict() == DEFAULT_AVERAGES | {"beds": 7.0}
    with pytest.raises(Exception):
        io.load_defaults(spark, "nosuchscheme://x/y", raw)


def test_evaluate_saved_skips_broken_models(spark, tmp_path):
    from lodgeprice.plans.evaluate import evaluate_saved
    from lodgeprice.plans.models import fit
    from lodgeprice.sources.io import save_model

    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + 1).alias("price"))
    good = save_model(fit("linear_regression", df, ["x"]), str(tmp_path / "good"))
    rows = evaluate_saved({"good": good, "broken": str(tmp_path / "none")}, df).collect()
    assert [r.model for r in rows] == ["good"] and rows[0].rmse < 1e-6 and rows[0].n == 100
    assert evaluate_saved({}, df).count() == 0


def test_distinct_values_bound_is_an_error_and_the_table_has_none(spark):
    import pytest

    from lodgeprice.operators.aggregates import distinct_table, distinct_values

    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "c string")
    assert distinct_values(df, "c") == ["a", "b"]
    assert distinct_table(df, "c").count() == 2
    with pytest.raises(ValueError):
        distinct_values(df, "c", most=1)


def test_patience_counts_rounds_without_a_gain():
    from lodgeprice.plans.models import stop_round

    assert stop_round([5, 4, 3, 2, 1], patience=2) is None
    assert stop_round([5, 4, 4, 4, 1], patience=2) == 4
    assert stop_round([5, 6, 4.9, 5, 5], patience=2) == 5
    assert stop_round([5, 5 - 1e-9, 5], patience=2, gain=1e-7) == 3


def _grid_rows(spark, noise=0.0):
    df = spark.range(400).select("id", (F.col("id") % 31).cast("double").alias("x"), (F.col("id") % 29).cast("double").alias("z"))
    price = 100 + 3 * F.col("x") + 2 * F.col("z") + F.col("x") * F.col("z") / 8
    noisy = (F.xxhash64("id", F.lit(3)) % 1000) * noise
    return df.withColumn("price", price + noisy).cache()


def test_boosting_stops_by_patience_or_runs_all_its_rounds(spark):
    from lodgeprice.plans.models import PATIENCE, fit, held_back, n_trees

    steps = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 10.0).alias("price"))
    assert n_trees(fit("histgb_tuned", steps, ["x"], params={"maxDepth": 2})) == 1 + PATIENCE  # exact after one round
    df = _grid_rows(spark)
    assert n_trees(fit("histgb_tuned", df, ["x", "z"], params={"maxIter": 12, "maxDepth": 3, "stepSize": 0.05})) == 12
    assert n_trees(fit("sklearn_gbr", df, ["x", "z"], params={"maxIter": 7})) == 7
    share = df.where(held_back()).count() / df.count()
    assert 0.04 < share < 0.2


def test_staged_search_equals_separate_fits(spark):
    from lodgeprice.plans import models
    from lodgeprice.operators.split import fold_of

    data = _grid_rows(spark, noise=0.01).withColumn("fold", fold_of("id", 2)).cache()
    points = [{"maxIter": r, "maxDepth": d} for d in (2, 3) for r in (3, 6)]
    c = models.CANDIDATES["catboost_tuned"]
    table, fits = models._search_errors(c, c.name, data, ["x", "z"], "price", points, 2, 4, 64)
    assert fits == 4  # two folds, two depths
    for p, row in zip(points, table):
        for f, e in enumerate(row):
            one = models.fit(c.name, data.where(F.col("fold") != f), ["x", "z"], params=p)
            assert abs(models._rmse(one, data.where(F.col("fold") == f), "price") - e) < 1e-9
    model, params, error = models.cv_search(c.name, data.drop("fold"), ["x", "z"], folds=2, grid={"maxIter": [3, 6], "maxDepth": [2, 3]})
    best = min(range(4), key=lambda i: sum(table[i]))
    assert params == points[best] and abs(error - sum(table[best]) / 2) < 1e-9 and model.n_fits == 4


def test_board_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    import pytest

    from lodgeprice.plans import models

    df = _grid_rows(spark)
    names = ["ridge", "decision_tree", "linear_regression"]
    real, calls = models.fit, []

    def fit(name, *a, **k):
        calls.append(name)
        if name == "decision_tree" and calls.count(name) == 1:
            raise KeyboardInterrupt
        return real(name, *a, **k)

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(KeyboardInterrupt):
        models.benchmark(df, ["x", "z"], names, folder=str(tmp_path))
    rows = models.benchmark(df, ["x", "z"], names, folder=str(tmp_path)).collect()
    assert calls == ["ridge", "decision_tree", "decision_tree", "linear_regression"] and {r.model for r in rows} == set(names)
    assert models.benchmark(df, ["x", "z"], names, folder=str(tmp_path)).collect() == rows and len(calls) == 4
    from lodgeprice.sources.io import load_model
    assert load_model(str(tmp_path / "ridge.model")).transform(df).select("prediction").count() == 400


def test_lines_from_moments(spark):
    import numpy as np

    from lodgeprice.operators import moments

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(1e6, 3, 300), rng.normal(0, 50, 300), np.full(300, 7.0), rng.integers(0, 2, 300)])
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 20 * x[:, 3] + rng.normal(0, 5, 300)
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1.0, 1.0)],
                                 "id long, a double, b double, c double, d double, price double").repartition(5)
    by_fold = moments.fold_moments(rows, list("abcd"), "price", F.col("id") % 3)
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    total = moments.Moments(by_fold[0].shift, sum(m.s for m in by_fold.values()))
    for alpha in (0.5, 40.0):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
        line = moments.ridge(total, alpha)
        assert np.allclose(line.coef * np.where(x.std(0) == 0, 1, x.std(0)), w, atol=1e-6)
        assert abs(line.error(total) - np.sqrt(np.mean((y - y.mean() - z @ w) ** 2))) < 1e-6
        left = moments.lasso(total, alpha / 10)
        v = left.coef * np.where(x.std(0) == 0, 1, x.std(0))
        grad = z.T @ (y - y.mean() - z @ v) / 300  # optimality: within alpha, and at it where a weight is not 0
        assert (np.abs(grad) <= alpha / 10 + 1e-6).all() and np.allclose(grad[v != 0], alpha / 10 * np.sign(v[v != 0]), atol=1e-6)
    keep = np.arange(300) % 3 != 1
    part = total - by_fold[1]
    zk = (x[keep] - x[keep].mean(0)) / np.where(x[keep].std(0) == 0, 1, x[keep].std(0))
    w = np.linalg.solve(zk.T @ zk + np.eye(4), zk.T @ (y[keep] - y[keep].mean()))
    assert np.allclose(moments.ridge(part, 1.0).coef * np.where(x[keep].std(0) == 0, 1, x[keep].std(0)), w, atol=1e-6)
    line, alpha, _ = moments.search("ridge", by_fold, [1e6, 1.0])
    assert alpha == 1.0


def test_forest_and_histogram_boosting_are_searched_over_the_original_grids(spark, monkeypatch):
    from lodgeprice import registry
    from lodgeprice.plans import models

    forest, histgb = (models.CANDIDATES[n].make(1, 1.0) for n in ("random_forest", "histgb_tuned"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), histgb.getMaxDepth(), histgb.getMaxIter()) == (200, 15, 12, 400)
    seen = []

    def searched(feat, cols, names, search=False):
        seen.append((*names, search, len(models.grid_points(models.CANDIDATES[names[0]].grid, models.SEARCH_ITER))))
        raise StopIteration

    monkeypatch.setattr(models, "benchmark", searched)
    monkeypatch.setattr(registry, "_model_data", lambda spark, sf: (None, [], None))
    for key in ("m07_random_forest", "m09_histogram_boosting"):
        try:
            registry.QUERIES[key](None, "")
        except StopIteration:
            pass
    assert seen == [("random_forest", True, 12), ("histgb_tuned", True, 12)]


def test_leaderboard_holds_knn_and_the_stack(spark, monkeypatch):
    from lodgeprice.plans import models

    assert len(models.BENCHMARK) == 14 and set(models.BENCHMARK) - {"knn", "stacking_ensemble"} == set(models.CANDIDATES) - {"ridge_unscaled", "linear_regression_log"}
    for name in models.BENCHMARK:
        if name in models.STACK_BASES:
            points = models.grid_points(models.CANDIDATES[name].grid)
            assert len(points) > models.SEARCH_ITER
            models._estimator(models.CANDIDATES[name], 1, 1.0, points[0])
    monkeypatch.setattr(models, "STACK_BASES", ["decision_tree"])
    monkeypatch.setattr(models, "knn_search", lambda *a, **k: ({"k": 3, "weights": "distance", "p": 2}, 0.0))
    df = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("price", 30 + 4 * F.col("a") - 2 * F.col("b"))
    rows = models.benchmark(df, ["a", "b"], ["knn", "decision_tree", "stacking_ensemble"]).collect()
    assert {r.model for r in rows} == {"knn", "decision_tree", "stacking_ensemble"} and all(r.rmse < 20 for r in rows)


def test_comps_by_all_filters_against_plain_python(spark):
    import random

    import numpy as np

    from lodgeprice.operators.split import train_part
    from lodgeprice.plans.comps import comps_by_filters

    rnd = random.Random(9)
    raw = [(i, rnd.choice(["Mitte", "Pankow", None]), rnd.choice([1.0, 2.0, None]), 1.0, rnd.choice([2, 4]), rnd.choice(["A", "B"]), "R",
            rnd.choice([52.5, None]), 13.4, rnd.choice([None, 3.0, 4.5]), f"${rnd.randint(1, 3200):,}.00") for i in range(300)]
    schema = ("id long, neighbourhood_group_cleansed string, bedrooms double, beds double, accommodates int, property_type string, "
              "room_type string, latitude double, longitude double, review_scores_rating double, price string")
    listings = spark.createDataFrame(raw, schema)
    asks = [(0, None, None, None, None, None), (1, "Mitte", None, None, None, None), (2, "Mitte", 2, None, None, None),
            (3, None, None, 100.0, 900.0, None), (4, None, 4, None, 500.0, 4.0), (5, None, None, None, None, 3.0),
            (6, "Mitte", None, None, None, None), (7, None, None, 800.0, 100.0, None), (8, "Pankow", None, None, None, None),
            (9, None, None, None, None, None), (10, "none", None, None, None, None)]
    filters = spark.createDataFrame(asks, "req_id long, neighbourhood_group_cleansed string, accommodates int, price_min double, "
                                          "price_max double, rating_min double")
    chosen = {8: {i for i in range(0, 300, 3)}, 9: {1, 2, 5, 9999}}
    similar = spark.createDataFrame([(r, i) for r, ids in chosen.items() for i in ids], "req_id long, id long")
    train = {r.id for r in train_part(listings).select("id").collect()}
    combos, found = comps_by_filters(listings, filters, similar)
    combo = {r.req_id: r.combo for r in combos.collect()}
    assert combo[6] == combo[1] == 1 and combo[9] == 9 and len(combo) == len(asks)
    got = {}
    for r in found.collect():
        got.setdefault(r.combo, {})[r.id] = r.tier
    for req, district, guests, low, high, rating in asks:
        rows = []
        for r in raw:
            p = float(r[10].replace("$", "").replace(",", ""))
            if (r[0] in train and p <= 3000 and district in (None, r[1]) and guests in (None, r[4]) and (low is None or p >= low)
                    and (high is None or p <= high) and (rating is None or (r[9] or 0) >= rating)
                    and (req not in chosen or r[0] in chosen[req])):
                rows.append((r[0], p, r[7]))
        want = {}
        if rows:
            a, b = np.quantile([p for _, p, _ in rows], [1 / 3, 2 / 3])
            want = {i: "red" if p <= a + 1e-9 else "orange" if p <= b + 1e-9 else "green" for i, p, lat in rows if lat is not None}
        assert got.get(combo[req], {}) == want, req
    assert comps_by_filters(listings, filters.limit(0))[1].count() == 0
    assert comps_by_filters(listings.limit(0), filters)[1].count() == 0
    assert comps_by_filters(listings, filters.select("req_id"))[0].select("combo").distinct().count() == 1


def test_similar_set_is_computed_once(spark):
    """The requests' combinations read the written similar set, they don't compute it again."""
    from lodgeprice.plans.comps import comps_by_filters
    from lodgeprice.registry import listings, requests
    raw, asked = listings(spark, SF001), requests(spark, SF001)
    filters = asked.select("req_id", "accommodates")
    similar = asked.where("req_id % 10 = 9").select("req_id").crossJoin(
        raw.select("id").where(F.xxhash64("id") % 5 == 0))
    combos, found = comps_by_filters(raw, filters, similar)
    for df in (combos, found):
        assert "xxhash64" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert combos.count() == asked.count()


def test_served_features_come_in_the_served_order(spark):
    from lodgeprice.constants import SERVED_FEATURE_ORDER
    from lodgeprice.plans.features import feature_columns, served_features, serving_spec
    from lodgeprice.sources import fixtures as fx

    assert sorted(feature_columns(serving_spec())) == sorted(SERVED_FEATURE_ORDER) and len(SERVED_FEATURE_ORDER) == 80
    out = served_features(fx.requests_with_amenities(spark, "/root/testdata/sf0.001"))
    assert out.columns == ["req_id", *SERVED_FEATURE_ORDER] and out.first() is not None


def test_mlp_gradient_against_differences():
    import numpy as np
    from lodgeprice.plans import mlp
    rng = np.random.default_rng(2)
    x, y, sizes = rng.normal(size=(20, 4)), rng.normal(size=20), [4, 6, 3, 1]
    for activation in ("relu", "tanh"):
        at = mlp.flat(mlp.init(sizes, 1))
        _, grad = mlp.gradient(x, y, mlp.shaped(at, sizes), activation)
        for k in range(len(at)):
            up, down = at.copy(), at.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            diff = (mlp.gradient(x, y, mlp.shaped(up, sizes), activation)[0]
                    - mlp.gradient(x, y, mlp.shaped(down, sizes), activation)[0]) / 2e-6
            assert abs(diff - grad[k]) < 1e-4 * max(1.0, abs(diff))


def test_mlp_learns_stops_and_leaves_nulls(spark, monkeypatch):
    import numpy as np
    from lodgeprice.plans import mlp
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), 7.0, float(100 + 20 * abs(a) + 10 * a * b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(900, None, 1.0, 7.0, 50.0), (901, 1.0, float("nan"), 7.0, 50.0), (902, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, price double").repartition(3)
    model = mlp.fit(df, ["a", "b", "c"], hidden=(16,), activation="tanh", alpha=0.0, rate=0.05, max_iter=40)
    got = {r["id"]: r["prediction"] for r in model.predict(df, ["id"]).collect()}
    assert len(got) == 603 and got[900] is None and got[901] is None and got[902] is not None
    price = np.array([r[4] for r in rows[:600]])
    error = np.sqrt(np.mean((np.array([got[r[0]] for r in rows[:600]]) - price) ** 2))
    assert error < 0.6 * price.std() and abs(model.mean[-1] - price.mean()) < 1e-9
    monkeypatch.setattr(mlp, "TOL", 10.0)  # nothing counts as a gain after the first step
    short = mlp.fit(df, ["a", "b", "c"], hidden=(4,), max_iter=40, patience=2)
    assert short.steps == 3
    with pytest.raises(ValueError):
        mlp.fit(df.limit(0), ["a", "b"])


def test_mlp_sums_in_two_levels(spark, monkeypatch):
    import numpy as np
    from lodgeprice.plans import mlp
    rng = np.random.default_rng(4)
    values = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(bool(i % 9 == 0), v.tolist()) for i, v in enumerate(values)], "held boolean, v array<double>")
    blocks = mlp._blocks(df.repartition(6))
    weights = mlp.init([2, 5, 1], 1)
    held = np.arange(90) % 9 == 0
    loss, grad = mlp.gradient(values[~held, :2], values[~held, 2], weights, "relu")
    out_loss = mlp.gradient(values[held, :2], values[held, 2], weights, "relu")[0]
    for fan in (100, 2):
        monkeypatch.setattr(mlp, "FAN", fan)
        losses, total = mlp._step(blocks, weights, "relu", 6)
        assert np.allclose(losses, [loss, out_loss]) and np.allclose(total, grad)


def test_mlp_rows_are_written_one_by_one(spark, monkeypatch):
    """Readers, caches and Arrow batches hold a number of rows: a row with thousands of listings would fill a task."""
    import numpy as np
    from lodgeprice.plans import mlp
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(5.0, 3.0, size=(700, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, price double").coalesce(1)
    seen = []
    real = mlp._step
    monkeypatch.setattr(mlp, "_step", lambda blocks, *more: seen.append(blocks) or real(blocks, *more))
    model = mlp.fit(df, ["a", "b"], hidden=(4,), max_iter=2)
    got = seen[0].select("held", F.length(seen[0].columns[-1]).alias("n")).collect()
    assert len(got) == 700 and {r["n"] for r in got} == {8 * 3} and 0 < sum(r["held"] for r in got) < 200
    values = np.array([r[1:] for r in rows])
    assert np.allclose(model.mean, values.mean(axis=0)) and np.allclose(model.std, values.std(axis=0))
    held = {r["id"] for r in df.where(mlp.held_back()).select("id").collect()}
    scaled = (values - model.mean) / model.std
    part = scaled[[i in held for i in range(700)]]
    error = mlp.forward(part[:, :2], mlp.init([2, 4, 1]), "relu")[-1][:, 0] - part[:, 2]
    assert abs(model.held_loss[0] - 0.5 * float((error ** 2).mean())) < 1e-12


def test_leaderboard_searches_the_perceptron(spark, monkeypatch):
    import math

    import numpy as np
    from lodgeprice import registry
    from lodgeprice.plans import mlp, models
    seen = []

    def stand_in(feat, cols, names, **more):
        seen.append((names, more.get("search")))
        return spark.createDataFrame([(1.0, 1.0)], "rmse double, fit_seconds double")

    with monkeypatch.context() as m:
        m.setattr(models, "benchmark", stand_in)
        m.setattr(registry, "_model_data", lambda spark, sf: (None, [], None))
        registry.QUERIES["m18_benchmark_leaderboard"](spark, SF001)
    names, searched = seen[0]
    assert searched and len(names) == 15 and names[-2:] == ["mlp_tuned", "stacking_ensemble"] and set(names) - {"mlp_tuned"} == set(models.BENCHMARK)
    points = models.grid_points(mlp.GRID, models.SEARCH_ITER)
    assert len(points) == 12 and len(models.grid_points(mlp.GRID)) == 90

    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("price", 30 + 4 * F.col("a") - 2 * F.col("b")).coalesce(2).persist()
    monkeypatch.setattr(mlp, "GRID", {"hidden": [(3,)], "activation": ["tanh"], "alpha": [0.0], "rate": [0.0001, 0.1]})
    train = df.where(~models.is_test("id"))
    model, best, error = mlp.search(train, ["a", "b"], folds=2, max_iter=6)
    means = []
    for rate in (0.0001, 0.1):
        errors = []
        for f in range(2):
            fold = models.fold_of("id", 2)
            net = mlp.fit(train.where(fold != f), ["a", "b"], hidden=(3,), activation="tanh", alpha=0.0, rate=rate, max_iter=6)
            got = net.predict(train.where(fold == f), ["price"]).collect()
            errors.append(math.sqrt(np.mean([(r["price"] - r["prediction"]) ** 2 for r in got])))
        means.append(sum(errors) / 2)
    assert best["rate"] == (0.0001, 0.1)[int(np.argmin(means))] and abs(error - min(means)) < 1e-9 and model.n_fits == 4
    real = mlp.search
    monkeypatch.setattr(mlp, "search", lambda *a, **k: real(*a, **k, folds=2, max_iter=3))
    row = models.benchmark(df, ["a", "b"], ["mlp_tuned"], search=True).first()
    assert row["model"] == "mlp_tuned" and row["n_fits"] == 4 and "tanh" in row["params"] and row["rmse"] > 0


def test_csv_splits_without_line_ends_in_quotes(spark, tmp_path):
    from lodgeprice.sources import io
    schema = "id long, text string"
    plain = spark.createDataFrame([(i, f'a, "{i}" b') for i in range(2000)] + [(5000, None)], schema)
    io.write_csv(plain.coalesce(1), f"{tmp_path}/plain")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        whole = io.read_csv(spark, f"{tmp_path}/plain", schema)
        split = io.read_csv(spark, f"{tmp_path}/plain", schema, multi_line=False)
        tasks = split.select(F.spark_partition_id()).distinct().count()
        assert tasks > 1 and whole.select(F.spark_partition_id()).distinct().count() == 1
        assert sorted(split.collect(), key=lambda r: r[0]) == sorted(whole.collect(), key=lambda r: r[0]) == plain.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    io.write_csv(spark.createDataFrame([(1, "two\nlines")], schema), f"{tmp_path}/broken")
    assert [r["text"] for r in io.read_csv(spark, f"{tmp_path}/broken", schema).collect()] == ["two\nlines"]
    with pytest.raises(Exception):
        io.read_csv(spark, f"{tmp_path}/broken", schema, multi_line=False).collect()


def test_csv_with_line_ends_in_quotes_splits_anywhere(spark, tmp_path):
    from lodgeprice.sources import io
    from lodgeprice.sources.csv_split import read_csv_splits
    schema = "id long, text string, more string"
    rows = [(i, ["plain", 'a "quoted", b', "one\ntwo", '\n"\n', "x" * 30 + "\r\ny\n\n", "", None, '"', "ä\n,\nö"][i % 9],
             ["z", "end\n", 'q"q'][i % 3]) for i in range(60)]
    rows.append((60, "long\n" * 300, "over many splits"))
    df = spark.createDataFrame(rows, schema)
    io.write_csv(df.where("id < 20").coalesce(1), f"{tmp_path}/t")
    df.where("id >= 20").coalesce(1).write.mode("append").option("header", True).option("escape", '"').option(
        "nullValue", "").option("ignoreTrailingWhiteSpace", False).csv(f"{tmp_path}/t")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    whole = sorted(io.read_csv(spark, f"{tmp_path}/t", schema).collect())
    assert len(whole) == 61 and whole[2][1:] == ("one\ntwo", 'q"q') and whole[1][2] == "end\n"
    try:
        for size in (83, 409):
            spark.conf.set(key, str(size))
            got = read_csv_splits(spark, f"{tmp_path}/t", schema)
            assert sorted(got.collect()) == whole
        assert spark.read.text(f"{tmp_path}/t").select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.set(key, old)


def test_csv_splits_odd_files(spark, tmp_path):
    from lodgeprice.sources.csv_split import read_csv_splits
    files = {"empty": "", "header": "id,text\n", "open_end": 'id,text\n1,"a\n\nb"', "cr": 'id,text\r\n1,"a\r\nb"\r\n\r\n2,c\r\n',
             "wide_header": '"id","te\nxt"\n3,d\n'}
    want = {"empty": [], "header": [], "open_end": [(1, "a\n\nb")], "cr": [(1, "a\r\nb"), (2, "c")], "wide_header": [(3, "d")]}
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
        got = read_csv_splits(spark, str(tmp_path / f"{name}.csv"), "id long, text string").collect()
        assert sorted(map(tuple, got)) == want[name], name
    (tmp_path / "bad.csv").write_text("id,text\nx,1\n")
    with pytest.raises(Exception):
        read_csv_splits(spark, str(tmp_path / "bad.csv"), "id long, text string").collect()


def test_sparse_one_hot_of_fifty_thousand_values(spark):
    from lodgeprice.operators.sparse_onehot import SparseOneHot, active_slots
    n = 50_000
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("a"),
        F.when(F.col("id") > 1, F.col("id") % 7).alias("b"), F.lit(None).cast("string").alias("c"))
    flags = SparseOneHot.fit(df, ["a", "b", "c"])
    values = sorted({"hot" if i % 3 == 0 else f"v{i}" for i in range(n)})
    assert flags.sizes == [len(values), 7, 0]
    assert {r.value: r.slot for r in flags.slots(spark, "a").collect()} == {v: i for i, v in enumerate(values)}
    got = active_slots(flags.transform(df), "id", ["a", "b", "c"]).collect()
    at = {v: i for i, v in enumerate(values)}
    want = {(i, "a", at["hot" if i % 3 == 0 else f"v{i}"]) for i in range(n)} | {(i, "b", i % 7) for i in range(2, n)}
    assert len(got) == len(want) and {(r.id, r.column, r.slot) for r in got} == want
    assert {(r.column, r.size) for r in got} == {("a", len(values)), ("b", 7)}
    other = spark.createDataFrame([(1, "new", None, "x"), (2, None, 3, None)], "id long, a string, b long, c string")
    assert [(r.id, r.column, r.slot) for r in active_slots(flags.transform(other), "id", ["a", "b", "c"]).collect()] == [(2, "b", 3)]


def test_sparse_preprocessing_matches_the_wide_table(spark):
    from pyspark.ml.functions import vector_to_array
    from lodgeprice.operators.sparse_onehot import SparseOneHot
    from lodgeprice.plans import preprocess as PP
    from lodgeprice.sources import fixtures as fx
    raw = fx.listings(spark, SF001)
    wide, spec = PP.preprocess(raw)
    sparse, flags, medians = PP.preprocess_sparse(raw)
    numbers = [c for c in PP.FeatureSpec([], [], []).base_feature_columns() if c != "property_other"]
    types = [r.value for r in flags.slots(spark, "property_type").orderBy("slot").collect()]
    top = [types.index(t) for t in spec.top_property_types]
    cols = numbers + spec.room_columns() + spec.district_columns() + spec.property_columns()[:-1]
    a = {r.id: [float(r[c]) for c in cols] for r in wide.select("id", *cols).collect()}
    b = {}
    for r in sparse.select("id", vector_to_array("features").alias("v")).collect():
        types_at = len(r.v) - len(types)
        b[r.id] = list(r.v[:types_at]) + [r.v[types_at + i] for i in top]
    assert a == b and len(a) > 100
    again, _, _ = PP.preprocess_sparse(raw, flags=SparseOneHot.load(spark, flags.folder, flags.columns), medians=medians)
    assert again.exceptAll(sparse).count() == 0


def test_cleaned_rows_are_written_once_and_code_stays_compilable(spark):
    import __spark_entry__ as entry

    from lodgeprice.plans.preprocess import preprocess
    from lodgeprice.sources import fixtures

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    entry.queries()["o04_top_k_categories"](spark, SF001)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    table, _ = preprocess(fixtures.listings(spark, SF001))
    files = table.inputFiles()
    assert files and not any("testdata" in f for f in files)


def test_line_rows_are_written_once(spark):
    """The passes over the line's rows read a file; the joins behind the listings are not repeated."""
    from lodgeprice import registry
    from lodgeprice.plans.preprocess import clean

    rows = registry._line_rows(spark, SF001)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = clean(fx.listings(spark, SF001)).select("id", "price", "accommodates", F.coalesce("bedrooms", F.lit(1.0)).alias("bedrooms"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_long_rows_hold_the_rounded_values_without_an_array_of_structs(spark):
    from lodgeprice import registry

    values = [None, 0.0, -0.0, 1.0, -3.0, 0.1234565, 0.1234575, -2.00000049, 1e300, 123456789.1234567, float("inf"), float("nan")]
    wide = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "id long, a double, b int")
    got = registry._long(wide, ["a", "b"], "id")
    assert got.schema.simpleString() == "struct<id:bigint,feature:string,value:double>"
    assert "struct" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = wide.select("id", F.lit("a").alias("feature"), F.round("a", 6).alias("value")).union(
        wide.select("id", F.lit("b"), F.col("b").cast("double")))
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect())


def test_rows_of_a_benchmark_are_kept_once(spark, monkeypatch):
    """``benchmark`` keeps both parts of the table; the table before them is not kept as well."""
    from lodgeprice import registry
    from lodgeprice.plans import models

    seen = []

    def stand_in(feat, cols, names, **more):
        seen.append(feat.storageLevel)
        return spark.createDataFrame([(1.0, 1.0)], "rmse double, fit_seconds double")

    monkeypatch.setattr(models, "benchmark", stand_in)
    for name in ("m02_linear_regression", "m03_ridge_grid_search", "m04_lasso_grid_search", "m18_benchmark_leaderboard"):
        registry.QUERIES[name](spark, SF001)
    assert len(seen) == 4 and not any(level.useMemory or level.useDisk for level in seen)
