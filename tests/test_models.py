from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflux.operators import distribution, forest, groups, regression


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 4))
    y = 1.5 + 2.0 * x[:, 0] - 0.7 * x[:, 1] + 0.4 * x[:, 2] + rng.normal(scale=0.5, size=n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    rows.append((n, None, 0.0, 0.0, 0.0, 1.0))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, noise double, y double"), x, y


def test_multiple_regression_matches_least_squares(planted):
    df, x, y = planted
    names = ("a", "b", "c", "noise")
    model = regression.fit(regression.factor(df, "y", names), names)
    want, rss, *_ = np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)
    assert model.n == len(y)
    assert (model.intercept, *model.slopes) == pytest.approx(tuple(want))
    assert model.rss == pytest.approx(float(rss[0]))
    fitted = regression.with_prediction(df, model, "p", "r").filter("p is not null")
    assert fitted.count() == len(y)
    assert fitted.agg(F.avg("r")).first()[0] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("direction", ["both", "backward"])
def test_stepwise_equals_best_subset_and_drops_noise(planted, direction):
    df, x, y = planted
    names = ("a", "b", "c", "noise")
    m = regression.factor(df, "y", names)
    model, steps = regression.stepwise(m, names, direction=direction)

    def criterion(subset):
        design = np.c_[np.ones(len(y)), x[:, list(subset)]]
        rss = float(np.sum((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2))
        return len(y) * math.log(rss / len(y)) + 2 * (len(subset) + 1)

    best = min((s for k in range(5) for s in itertools.combinations(range(4), k)), key=criterion)
    assert model.predictors == tuple(names[i] for i in best)
    assert model.step_criterion == pytest.approx(criterion(best))
    assert model.aic == pytest.approx(model.step_criterion + len(y) * (math.log(2 * math.pi) + 1) + 2)
    assert steps[0][0] == "<start>"
    forward, _ = regression.stepwise(m, (), direction="forward")
    assert set(forward.predictors) >= {"a", "b", "c"}


def test_inflation_factors(planted):
    df, x, _ = planted
    names = ("a", "b", "c", "noise")
    got = regression.inflation_factors(regression.factor(df, "y", names), names)
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [got[n] for n in names] == pytest.approx(list(want))


def test_factor_equals_a_dense_one_also_when_predictors_are_nearly_collinear(spark):
    """13 predictors, two of them alike to 1e-6; the condition number is beyond what normal equations stand."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 13)) * np.logspace(-3, 3, 13)
    x[:, 12] = x[:, 0] * 1e6 + rng.normal(size=2500) * 1e-6 * np.abs(x[:, 0]).max() * 1e6
    y = x @ np.linspace(1, 2, 13) + rng.normal(size=2500)
    names = tuple(f"p{i}" for i in range(13))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in (*names, "y")))
    m = regression.factor(df.repartition(9), "y", names)
    design = np.c_[np.ones(len(y)), x]
    want = regression.triangle(np.c_[design, y])
    assert m.n == 2500 and np.abs(m.r - want).max() < 1e-8 * np.abs(want).max()
    model = regression.fit(m, names)
    q, r = np.linalg.qr(design)
    dense = np.linalg.solve(r, q.T @ y)
    assert model.predictors == names
    assert np.array([model.intercept, *model.slopes]) == pytest.approx(dense, rel=1e-8, abs=1e-8)
    factors = regression.inflation_factors(m, names)
    assert factors["p0"] > 1e10
    for j in (0, 5, 12):
        others = np.c_[np.ones(len(y)), np.delete(x, j, 1)]
        left = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        assert factors[names[j]] == pytest.approx(np.var(x[:, j]) * len(y) / float(left @ left), rel=1e-4)


def test_one_small_factor_per_task_whatever_the_rows(spark, monkeypatch):
    """Many tasks: their factors are merged in levels, and few reach the driver."""
    monkeypatch.setattr(regression, "MERGED", 4)
    df = spark.range(3000).selectExpr("double(id % 37) AS a", "double(id % 11) AS b", "double(id % 37) * 2 - id % 11 + 3 AS y")
    m = regression.factor(df.repartition(30), "y", ("a", "b"))
    model = regression.fit(m, ("a", "b"))
    assert m.n == 3000 and (model.intercept, *model.slopes) == pytest.approx((3.0, 2.0, -1.0))
    with pytest.raises(ValueError):
        regression.factor(df.limit(0), "y", ("a", "b"))


def test_sweeping_in_and_out_again():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    a = np.corrcoef(x.T)
    once = regression.sweep(regression.sweep(a, 0), 2)
    slopes = np.linalg.solve(a[np.ix_([0, 2], [0, 2])], a[[0, 2], 3])
    assert once[[0, 2], 3] == pytest.approx(slopes)
    assert once[3, 3] == pytest.approx(1 - slopes @ a[[0, 2], 3])
    assert regression.sweep(regression.sweep(once, 2, back=True), 0, back=True) == pytest.approx(a)


def test_split_and_folds_are_balanced_and_repeatable(spark):
    df = spark.range(200_000).withColumn("big", F.col("id") + F.lit(9_000_000_000_000_000))
    for key in ("id", "big"):
        share = df.agg(F.avg(forest.is_training(F.col(key)).cast("int"))).first()[0]
        assert share == pytest.approx(0.75, abs=0.02)
        folds = [r["count"] for r in df.groupBy(forest.fold_of(F.col(key)).alias("f")).count().collect()]
        assert len(folds) == 10 and min(folds) > 15_000


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(11)
    n = 3000
    x = rng.uniform(-3, 3, size=(n, 3))
    y = np.sin(2 * x[:, 0]) * 2 + 0.3 * x[:, 1] ** 2 + rng.normal(scale=0.1, size=n)
    mons = ["Jan", "Feb", "Mar"]
    rows = [(i, mons[i % 3], *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, mon string, main double, side double, noise double, y double")


def test_forest_beats_line_and_ranks_predictors(wavy):
    names = ("main", "side", "noise")
    train = forest.is_training(F.col("id"))
    model = forest.train(wavy.filter(train), "y", names, trees=30, importance=True)
    scored = forest.score(model, wavy.filter(~train), names, ["id", "y"])
    line = regression.fit(regression.factor(wavy.filter(train), "y", names), names)
    r2 = scored.agg(F.regr_r2("y", "prediction")).first()[0]
    linear = regression.with_prediction(wavy.filter(~train), line, "p").agg(F.regr_r2("y", "p")).first()[0]
    assert r2 > 0.8 > linear
    got = {r.pred: r.importance for r in forest.permutation_importance(model).collect()}
    assert got["main"] > got["side"] > got["noise"]


def _walk(tree, row):
    """One row down one written tree, node by node."""
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] + (row[tree.feature[node]] > tree.threshold[node])
    return tree.value[node]


def _sample(df, names, response):
    rows = sorted(tuple(r) for r in df.select(response, *names).collect())
    return np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])


def test_importance_equals_a_plain_loop_over_out_of_bag_rows(wavy):
    names = ("main", "side", "noise")
    small = wavy.filter("id < 120")
    model = forest.train(small, "y", names, trees=12, seed=3, importance=True)
    x, y = _sample(small, names, "y")
    rises = {n: [] for n in names}
    for t in model.trees.collect():
        rng = np.random.default_rng([3, 0, t.tree])
        drawn = rng.integers(0, len(y), len(y))
        # Growing draws from the same stream; replay it, then permute.
        sample = forest.Sample(x, y)
        again = sample.grow(np.bincount(drawn, minlength=len(y)).astype(float), rng, 1, forest.MIN_NODE_ROWS)
        assert again.value.tolist() == t.value
        out = sorted(set(range(len(y))) - set(drawn.tolist()))
        base = np.mean([(y[i] - _walk(t, x[i])) ** 2 for i in out])
        assert t.oob_mse == pytest.approx(base)
        for j, n in enumerate(names):
            mixed = x[out][rng.permutation(len(out)), j]
            moved = []
            for i, v in zip(out, mixed):
                row = x[i].copy()
                row[j] = v
                moved.append((y[i] - _walk(t, row)) ** 2)
            rises[n].append(np.mean(moved) - base)
    got = {r.pred: r.importance for r in forest.permutation_importance(model).collect()}
    assert got == pytest.approx({n: float(np.mean(v)) for n, v in rises.items()})


def test_trees_equal_a_plain_recursion(spark):
    """All predictors tried at every split: values on the drawn rows are those of an exhaustive search."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4))
    x[:, 3] = np.round(x[:, 3])
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=120)
    sample = forest.Sample(x, y)
    weight = sample.bootstrap(rng)
    tree = sample.grow(weight, rng, 4, 5)

    def plain(rows):
        total, mean = weight[rows].sum(), np.average(y[rows], weights=weight[rows])
        best = (total * mean * mean + 1e-9, None, None)
        for f in range(4) if total > 5 else ():
            for cut in np.unique(x[rows, f])[:-1]:
                parts = [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
                gain = sum((weight[p] * y[p]).sum() ** 2 / weight[p].sum() for p in parts)
                if gain > best[0] + 1e-9:
                    best = gain, parts, f
        if best[1] is None:
            return dict.fromkeys(rows.tolist(), mean)
        return plain(best[1][0]) | plain(best[1][1])

    want = plain(np.flatnonzero(weight))
    assert tree.predict(x)[list(want)] == pytest.approx(list(want.values()))


def test_score_is_the_mean_of_all_trees(spark, wavy):
    names = ("main", "side")
    model = forest.train(wavy.filter("id < 300"), "y", names, trees=7)
    trees = model.trees.collect()
    rows = wavy.filter("id between 290 and 340").collect()
    got = {r.id: r.prediction for r in forest.score(model, wavy.filter("id between 290 and 340"), names, ["id"]).collect()}
    assert got == pytest.approx({r.id: float(np.mean([_walk(t, (r.main, r.side)) for t in trees])) for r in rows})
    odd = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0), (4, 0.0, 0.0)], "id long, main double, side double")
    assert [r.id for r in forest.score(model, odd, names, ["id"]).collect()] == [4]
    with pytest.raises(ValueError):
        forest.score(model, odd, ("side", "main"), ["id"])


def test_a_forest_without_rows_predicts_nothing(wavy):
    model = forest.train(wavy.limit(0), "y", ("main", "side"), trees=3)
    got = forest.score(model, wavy.limit(2), ("main", "side"), ["id"]).collect()
    assert [r.prediction for r in got] == [None, None]


def test_cross_validation_scores_every_row_once_by_trees_that_never_saw_it(wavy):
    names = ("main", "side", "noise")
    scored = forest.cross_validate(wavy, "id", "y", names, ["mon"], folds=3, trees=5)
    assert scored.count() == 3000 and scored.select("id").distinct().count() == 3000
    metrics = forest.fold_metrics(scored, "mon", "y")
    assert metrics.count() == 9
    assert forest.fold_summary(metrics, "mon").filter("r2 > 0").count() == 3
    # Fold 1 by hand.
    data = wavy.withColumn("fold", forest.fold_of(F.col("id"), 3))
    model = forest.train(data, "y", names, 5, fold="fold", folds=3)
    x, y = _sample(data.filter("fold <> 1"), names, "y")
    sample = forest.Sample(x, y)
    rng = np.random.default_rng([0, 1, 2])
    tree = sample.grow(sample.bootstrap(rng), rng, 1, forest.MIN_NODE_ROWS)
    assert model.fold(1).trees.filter("tree = 2").first().value == tree.value.tolist()


def test_fold_metrics_equal_sql_on_a_written_prediction_table(spark, wavy, tmp_path):
    import duckdb

    path = str(tmp_path / "predictions")
    scored = forest.cross_validate(wavy, "id", "y", ("main", "side", "noise"), ["mon"], folds=4, trees=5)
    scored.write.parquet(path)
    table = spark.read.parquet(path)
    got = forest.fold_summary(forest.fold_metrics(table, "mon", "y"), "mon").orderBy("mon").collect()
    want = duckdb.sql(f"""
        SELECT mon, avg(r2), avg(mnerr), avg(sderr) FROM (
            SELECT fold, mon, regr_r2(y, prediction) AS r2, avg(prediction - y) AS mnerr, stddev_pop(prediction - y) AS sderr
            FROM '{path}/*.parquet' GROUP BY fold, mon) GROUP BY mon ORDER BY mon""").fetchall()
    assert [r[0] for r in got] == [w[0] for w in want]
    assert [v for r in got for v in r[1:]] == pytest.approx([v for w in want for v in w[1:]])


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", None), ("b", float("inf"))], "g string, x double")
    out = distribution.histogram_by_group(df, ["g"], "x", 10)
    counts = {(r.g, r.bin): r.n for r in out.collect()}
    assert sum(n for (g, _), n in counts.items() if g == "a") == 101
    assert counts[("a", 9)] == 11 and counts[("a", 0)] == 10
    assert counts[("b", 0)] == 1


def test_histograms_of_many_columns_equal_those_of_the_long_table(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), 2.0, None if i % 5 else float("inf")) for i, (a, b) in enumerate(rng.normal(size=(700, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, same double, none double")
    limit = F.col("b") > -0.5
    got = distribution.histogram_columns(df, {"a": None, "b": limit, "same": None, "none": None}, 20)
    long = df.selectExpr("stack(3, 'a', a, 'b', if(b > -0.5, b, null), 'same', same) AS (column, value)")
    want = distribution.histogram_by_group(long, ["column"], "value", 20)
    columns = ["column", "low", "high", "bin", "n"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert {r.column: r.n for r in got.groupBy("column").agg(F.sum("n").alias("n")).collect()}.keys() == {"a", "b", "same"}
    assert distribution.histogram_columns(df, {"none": None}).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") + plan.count("Expand") == 1


def test_last_bit_below_an_edge_does_not_decide_the_bin(spark):
    ends = [0.0, math.log(9.0)]
    near = [math.log(3.0), math.nextafter(math.log(3.0), 0.0)]
    df = spark.createDataFrame([("g", x) for x in ends + near], "g string, x double")
    out = {r.bin: r.n for r in distribution.histogram_by_group(df, ["g"], "x", 50).collect()}
    assert out == {0: 1, 25: 2, 49: 1}


def test_density_histogram_has_unit_area(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(size=500)], "x double")
    out = distribution.histogram_density(df, [], "x", -2.0, 2.0, 30)
    assert out.agg(F.sum("density")).first()[0] * (4.0 / 30) == pytest.approx(1.0)


def test_log_histogram_removes_values_outside_first(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (20000.0,), (20000.1,)], "x double")
    assert distribution.histogram_log(df, [], "x").agg(F.sum("n")).first()[0] == 2


def test_loess_reproduces_a_parabola(spark):
    rows = [("g", m, 2.0 + 0.5 * m - 0.1 * m * m) for m in range(1, 13) for _ in range(m)]
    df = spark.createDataFrame(rows, "g string, month int, v double")
    for r in distribution.seasonal_loess(df, ["g"], "month", "v").collect():
        assert r.smooth == pytest.approx(2.0 + 0.5 * r.month - 0.1 * r.month**2, rel=1e-8)


def test_kernel_density_integrates_to_one(spark):
    data = np.random.default_rng(2).normal(1.0, 0.15, size=4000)
    df = spark.createDataFrame([("g", float(x)) for x in data], "g string, x double")
    rows = distribution.kde_by_group(df, ["g"], "x", points=221).collect()
    assert sum(r.density for r in rows) * 0.01 == pytest.approx(1.0, abs=0.01)
    q1, q3 = np.quantile(data, [0.25, 0.75])
    want = 0.9 * min(data.std(ddof=1), (q3 - q1) / 1.34) * len(data) ** -0.2
    assert rows[0].bw == pytest.approx(want, rel=1e-12)


def test_root_mean_square_counts_all_rows(spark):
    df = spark.createDataFrame([(3.0,), (None,), (4.0,)], "d double")
    assert df.agg(groups.root_mean_square(F.col("d"))).first()[0] == pytest.approx(math.sqrt(25 / 2 / 3))
    assert df.agg(groups.root_mean_square(F.col("d"), 1.0)).first()[0] == pytest.approx(math.sqrt(25 / 3))


def test_aliased_predictors_are_set_aside(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(x), float(z), float(x + 2 * z), 1.0, float(3 * x - z)) for x, z in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, both double, same double, y double")
    names = ("a", "b", "both", "same")
    m = regression.factor(df, "y", names)
    model = regression.fit(m, names)
    assert model.predictors == ("a", "b") and model.slopes == pytest.approx((3.0, -1.0))
    factors = regression.inflation_factors(m, names)
    assert math.isnan(factors["both"]) and math.isnan(factors["same"]) and factors["a"] == pytest.approx(factors["b"], rel=1e-6)


def test_fit_sample_is_bounded_and_repeatable(spark):
    df = spark.range(3000).selectExpr("double(id % 100) AS x", "double(id % 100) * 2 + id / 1e6 AS y")
    one, two = (forest.train(d, "y", ("x",), trees=3, fit_rows=300) for d in (df, df.repartition(7)))
    assert one.rows == two.rows and 200 < one.rows < 400
    assert one.trees.orderBy("tree").drop("oob_mse").collect() == two.trees.orderBy("tree").drop("oob_mse").collect()


def test_kernel_density_keeps_the_group_without_a_key(spark):
    df = spark.createDataFrame([(k, float(i % 7) / 5) for i in range(40) for k in (None, "A")], "g string, x double")
    assert {r.g for r in distribution.kde_by_group(df, ["g"], "x").collect()} == {None, "A"}
