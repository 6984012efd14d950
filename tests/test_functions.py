from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import classify, gas, hydraulics, nulls

EDGE = [None, float("nan"), float("-inf"), -1.0, 0.0, 1e-12, 1.0, float("inf")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, x double")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_log_keeps_zero_as_minus_infinity(edge):
    got = values(edge.filter("x is null or not isnan(x)"), nulls.log_or_inf("x"))
    assert got[0] is None and got[1] is None and got[2] is None
    assert got[3] == float("-inf") and got[4] == pytest.approx(math.log(1e-12)) and got[5] == 0.0


def test_bounds_keep_null(edge):
    assert values(edge, nulls.clamp("x", F.lit(0.0), F.lit(0.5)))[0] is None
    assert values(edge, nulls.at_least("x", F.lit(0.0)))[3] == 0.0
    assert values(edge, nulls.at_most("x", F.lit(0.5)))[6] == 0.5


def test_finite(edge):
    assert values(edge, nulls.is_finite("x")) == [False, False, False, True, True, True, True, False]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, nulls.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, nulls.ratio(F.lit(1.0), F.lit(4.0))) == 0.25


def test_strict_sum_sees_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", None)], "g string, x double")
    got = {r.g: (r.s, r.l, r.m) for r in df.groupBy("g").agg(
        nulls.strict_sum("x").alias("s"), nulls.loose_sum("x").alias("l"), nulls.strict_mean("x").alias("m")).collect()}
    assert got == {"a": (None, 1.0, None), "b": (5.0, 5.0, 2.5), "c": (None, 0.0, None)}


def test_strict_sum_where_ignores_other_rows(spark):
    df = spark.createDataFrame([(1.0, True), (None, False), (4.0, True)], "x double, keep boolean")
    assert df.agg(nulls.strict_sum_where("x", F.col("keep"))).first()[0] == 5.0
    assert df.agg(nulls.strict_sum_where("x", F.lit(False))).first()[0] is None


def test_in_list_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert sorted(r[0] for r in df.select(nulls.in_list("x", ["a"])).collect()) == [False, True]
    assert [r[0] for r in df.select(nulls.in_list("x", [])).collect()] == [False, False]


def test_runoff_classes_at_their_edges(spark):
    df = spark.createDataFrame([(0, None), (1, -5.0), (2, 49.9), (3, 50.0), (4, 200.0), (5, 500.0), (6, 1000.0)], "i int, x double")
    assert values(df, classify.runoff_class(F.col("x"))) == [None, "ARID", "ARID", "MOD1", "MOD2", "WET1", "WET2"]
    assert values(df, classify.wetness_class(F.col("x"))) == [None, "Arid", "Arid", "Mod", "Mod", "Wet", "Wet"]


def test_climate_bands_at_their_edges(spark):
    df = spark.createDataFrame([(0, 56.1), (1, 56.0), (2, 23.5), (3, -23.5), (4, -23.6), (5, None)], "i int, x double")
    assert values(df, classify.climate_band(F.col("x"), dims.BANDS_SHORT)) == [
        "Polar", "N Temperate", "Tropical", "Tropical", "S Temperate", None]


def test_working_basin_shows_missing_parts(spark):
    key = classify.working_basin(F.lit("N"), F.lit(None).cast("string"), F.lit("FR_15"))
    assert one(spark, key) == "NNA15"


def test_velocity_and_exchange(spark):
    v = math.exp(0.12 * math.log(2.0) - 1.06)
    assert one(spark, hydraulics.flow_velocity(F.lit(2.0))) == pytest.approx(v)
    sc = 1742 - 91.24 * 20 + 2.208 * 400 - 0.0219 * 8000
    assert one(spark, gas.schmidt_number(F.lit(20.0))) == pytest.approx(sc)
    gentle = (2841 * 0.005 * v + 2.02) * math.sqrt(600 / sc)
    steep = math.exp(1.18 * math.log(9.81 * 0.05 * v) + 6.43) * math.sqrt(600 / sc)
    slow = (2841 * 0.011 * 0.1 + 2.02) * math.sqrt(600 / sc)
    k = gas.gas_transfer_velocity
    assert one(spark, k(F.lit(0.005), F.lit(v), F.lit(sc))) == pytest.approx(gentle)
    assert one(spark, k(F.lit(0.05), F.lit(v), F.lit(sc))) == pytest.approx(steep)
    assert one(spark, k(F.lit(0.011), F.lit(0.1), F.lit(sc))) == pytest.approx(slow)
    assert one(spark, k(F.lit(None).cast("double"), F.lit(v), F.lit(sc))) is None


def test_water_temperature_never_freezes(spark):
    assert one(spark, gas.water_temperature(F.lit(-30.0))) == 0.0
    assert one(spark, gas.water_temperature(F.lit(10.0))) == pytest.approx(14.15)


def test_dryout(spark):
    assert one(spark, hydraulics.monthly_dryout(F.lit(60.0))) == 0.0
    assert one(spark, hydraulics.dryout_fraction(F.lit(60.0))) > 0.0
    assert one(spark, hydraulics.dryout_fraction(F.lit(1e-9))) == pytest.approx(1.0)


def test_width_exponent_holds_logs_in_range(spark):
    def e(cv, runoff, q):
        return one(spark, hydraulics.width_exponent(F.lit(cv), F.lit(runoff), F.lit(q)))

    assert e(1.0, 1e-3, 1e-6) == pytest.approx(-0.026 * 1.6 + 0.011 * 7 + 0.36)
    assert e(1.0, 1e9, 1e9) == pytest.approx(-0.026 * 8.5 - 0.011 * 10 + 0.36)
    assert e(2.0, 100.0, 3.0) == pytest.approx(
        0.074 * math.log(2) - 0.026 * math.log(100) - 0.011 * math.log(3) + 0.36)


def test_dryout_by_order(spark):
    def d(order, prec, temp):
        return one(spark, hydraulics.dryout_by_order(F.lit(order), F.lit(prec), F.lit(temp)))

    assert d(5, 100.0, 20.0) == 0.0
    assert d(1, 10.0, 10.0) == pytest.approx(0.9 * (-0.019 + 0.17 + 0.026))
    assert d(2, 500.0, 0.0) == 0.0
    assert d(0, 10.0, 10.0) is None


def test_month_lookup(spark):
    assert one(spark, dims.month_number(F.lit("Mar"))) == 3
    assert one(spark, dims.month_number(F.lit("Ann"))) is None
    assert one(spark, dims.month_label(F.lit(12))) == "Dec"
