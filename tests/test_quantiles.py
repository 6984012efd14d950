from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segflux.operators import quantiles

PROBS = [0.0, 0.001, 0.05, 0.5, 0.8, 0.995, 1.0]


def check(spark, data, **limits):
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(5)
    got = quantiles.exact_quantiles(df, "x", PROBS, **limits)
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(data, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_values_need_several_rounds(spark, seed):
    data = np.random.default_rng(seed).lognormal(size=5000)
    check(spark, data, accuracy=50, inside_limit=20)


def test_a_third_of_all_rows_share_one_value(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25)])
    check(spark, data, accuracy=30, inside_limit=10)


def test_two_hot_neighbours(spark):
    data = np.array([1.0] * 900 + [2.0] * 900 + [1.5])
    check(spark, data, accuracy=20, inside_limit=5)


def test_single_pass_for_small_columns(spark):
    check(spark, [3.0, 1.0, 2.0, 10.0])


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (3.0,)], "x double")
    assert quantiles.exact_quantiles(df, "x", [0.5]) == {0.5: 2.0}
    assert quantiles.exact_quantiles(df.filter("x is null"), "x", [0.5]) == {0.5: None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_any_list(spark, data):
    check(spark, [float(x) for x in data], accuracy=7, inside_limit=3)


def test_winsorized_values_stay_within_bounds(spark):
    data = [(float(x),) for x in np.random.default_rng(0).normal(size=1000)]
    df = spark.createDataFrame(data, "x double")
    row = quantiles.winsorize(df, "x", 0.01, 0.99).agg(F.min("x"), F.max("x"), F.count("x")).first()
    raw = np.array(data).ravel()
    assert row[0] == pytest.approx(np.quantile(raw, 0.01))
    assert row[1] == pytest.approx(np.quantile(raw, 0.99))
    assert row[2] == 1000


def test_drop_below_quantile_of_one_category(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", -1.0)], "g string, x double")
    out = quantiles.below_quantile_removed(df, "x", 0.1, F.col("g") == "a")
    assert out.filter("g = 'b'").count() == 1
    assert out.filter("g = 'a'").agg(F.min("x")).first()[0] == 10.0


def grouped(df, keys, probs, **limits):
    rows = quantiles.quantile_table(df, keys, probs, **limits).collect()
    return {(*[r[k] for k in keys], r["column"], r["p"]): (r["n"], r["value"]) for r in rows}


@pytest.mark.parametrize("limits", [{}, {"accuracy": 40}, {"accuracy": 40, "inside_limit": 200}])
def test_quantiles_of_many_groups_and_columns(spark, limits):
    """Small, large, constant, hot and empty groups, and one without a key."""
    rng = np.random.default_rng(6)
    data = {
        "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 500, None: rng.normal(size=900).tolist(),
        "hot": rng.normal(size=600).tolist() + [0.1] * 400, "large": rng.lognormal(size=3000).tolist(), "odd": [float("nan"), 3.0, float("inf")],
    }
    rows = [(g, x, None if g == "two" else -x) for g, xs in data.items() for x in xs] + [("odd", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = grouped(df, ["g"], {"x": probs, "y": [0.25]}, **limits)
    for g, xs in data.items():
        xs = [x for x in xs if np.isfinite(x)]
        for p in probs:
            assert got[(g, "x", p)] == (len(xs), pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12))
        if g == "two":
            assert (g, "y", 0.25) not in got
        else:
            assert got[(g, "y", 0.25)] == (len(xs), pytest.approx(np.quantile([-x for x in xs], 0.25), rel=1e-12, abs=1e-12))
    assert grouped(df.limit(0), ["g"], {"x": [0.5]}) == {}


def test_a_bracket_that_misses_its_rank_is_taken_wider(spark, monkeypatch):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(size=4000)], "x double")
    want = np.quantile([r.x for r in df.collect()], [0.25, 0.5])
    monkeypatch.setattr(quantiles, "SLACK", 0.0)
    assert [v for _, v in sorted((k[1], v[1]) for k, v in grouped(df, [], {"x": [0.25, 0.5]}, accuracy=30).items())] == pytest.approx(list(want))
    assert list(quantiles.exact_quantiles(df, "x", [0.25, 0.5], accuracy=30).values()) == pytest.approx(list(want))


def test_all_columns_share_two_jobs(spark, conf):
    conf(spark__sql__adaptive__enabled="false")
    df = spark.range(2000).selectExpr("double(id) AS a", "double(id % 7) AS b", "double(-id) AS c")
    context = spark.sparkContext
    context.setJobGroup("quantiles", "two passes")
    try:
        got = quantiles.exact_quantiles_of(df, {"a": [0.1, 0.9], "b": [0.5], "c": [0.0, 0.25, 1.0]})
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got["a"][0.1] == pytest.approx(199.9) and got["b"][0.5] == 3.0 and got["c"][1.0] == 0.0
    assert len(context.statusTracker().getJobIdsForGroup("quantiles")) == 2


def test_listed_basins(spark, small):
    from segflux.plans import reaches
    from segflux.plans.inputs import NetworkOptions, from_binding
    from segflux.sources.bindings import Binding

    inputs = from_binding(Binding(spark, small))
    placed = reaches.assemble_reaches(inputs, NetworkOptions())
    basins = [r.hybas_id for r in placed.select("hybas_id").distinct().limit(5).collect()]
    means = placed.filter(F.col("hybas_id").isin(basins)).join(inputs.reach_pco2, "comid").groupBy("comid").agg(F.avg("pco2").alias("m")).collect()
    got = reaches.listed_concentration_quantiles(inputs, NetworkOptions(), basins, (0.05, 0.5), placed).collect()
    assert {r.p: r.value for r in got} == pytest.approx({p: float(np.quantile([m.m for m in means], p)) for p in (0.05, 0.5)})
    assert {r.n for r in got} == {len(means)}
    assert reaches.listed_concentration_quantiles(inputs, NetworkOptions(), reaches=placed).count() == 0
