from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from segflux.operators import network
from segflux.plans import basins, reaches
from segflux.plans.inputs import NetworkOptions

SUMMARY = ("wkbasin string, month int, strm_order int, n long, length_km double, width_m double, area_km2 double, "
           "dry_km2 double, dry_ratio double, dry_alt_km2 double, dry_alt_ratio double, k double, co2 double, pco2 double")


def summary(spark, rows):
    """Rows of (order, length, width, dry ratio, alternative ratio, k)."""
    out = []
    for basin, orders in rows.items():
        for order, length, width, ratio, alt, k in orders:
            area = width * length / 1000
            out.append((basin, 1, order, 1, length, width, area, area * ratio, ratio, area * alt, alt, k, 10.0, 500.0))
    return spark.createDataFrame(out, SUMMARY)


def depth(spark, rows):
    return spark.createDataFrame(list(rows.items()), "wkbasin string, depth int")


@pytest.mark.parametrize("orders, expected", [
    ({1, 2, 3, 4, 5}, 4), ({1, 2, 3, 4}, 3), ({1, 2, 3}, 2), ({1, 2}, 2), ({1, 3}, 2), ({1, 2, 3, 4, 6}, 3)])
def test_fit_depth(spark, orders, expected):
    df = spark.createDataFrame([("w", o) for o in orders], "wkbasin string, strm_order int")
    assert network.fit_depth(df).first()["depth"] == expected


def test_exact_line_constant_and_single_point(spark):
    rows = [("line", x, 2.0 * x + 1) for x in (1.0, 2.0, 3.0, 4.0)]
    rows += [("flat", x, 5.0) for x in (1.0, 2.0, 3.0)] + [("dot", 1.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in df.groupBy("g").agg(*network.ols(F.col("y"), F.col("x"), F.lit(True), "y")).collect()}
    assert got["line"].slope_y == pytest.approx(2) and got["line"].icept_y == pytest.approx(1)
    assert got["line"].r2_y == pytest.approx(1)
    assert got["flat"].slope_y == 0 and got["flat"].r2_y is None
    assert got["dot"].slope_y is None and got["dot"].r2_y is None


@pytest.mark.parametrize("end, expected", [
    (-2.7, [0, -1, -2, -2.7]), (1.4, [0, 1, 2, 1.4]), (0.0, [0, 0]), (-0.4, [0, -0.4]), (None, [None])])
def test_order_sequence(spark, end, expected):
    df = spark.createDataFrame([("w", end)], "wkbasin string, end_order double")
    got = [r["order"] for r in network.extrapolated_orders(df).collect()]
    assert got == expected


@pytest.mark.parametrize("ratios, expected", [
    ((0.5, 0.2, 0.0, 0.0), 2), ((0.0, 0.0, 0.0, 0.0), 0), ((0.5, 0.0, 0.1, 0.0), 3)])
def test_deepest_dry_order(spark, ratios, expected):
    df = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "o int, r double")
    assert df.agg(network.deepest_dry_order(F.col("o"), F.lit(4), F.col("r"))).first()[0] == expected


def test_extrapolation_by_hand(spark):
    # width doubles per order, length halves, k falls by 1 per order, dry ratio falls by 0.1.
    rows = {"w": [(o, 800.0 / 2**o, 2.0**o, 0.5 - 0.1 * o, 0.0, 10.0 - o) for o in (1, 2, 3, 4, 5)]}
    rows["w"][4] = (5, 25.0, 32.0, 0.0, 0.0, 5.0)
    got = network.extrapolate(summary(spark, rows), depth(spark, {"w": 4})).first()
    slope, icept = round(math.log(2), 5), 0.0
    end = (math.log(0.3) - icept) / slope
    assert got.end_order == pytest.approx(end)
    orders = [0, -1, end]
    assert math.ceil(end) == -1
    width = [2.0**o for o in orders]
    length = [800.0 / 2**o for o in orders]
    area = [w * x / 1000 for w, x in zip(width, length)]
    dry = [a * min(0.5 - 0.1 * o, 1.0) for a, o in zip(area, orders)]
    eff = [a - d for a, d in zip(area, dry)]
    k = [10.0 - o for o in orders]
    assert got.length_2 == pytest.approx(sum(length)) and got.area_2 == pytest.approx(sum(area))
    assert got.dry_2 == pytest.approx(sum(dry)) and got.eff_2 == pytest.approx(sum(eff))
    assert got.k_2 == pytest.approx(sum(a * b for a, b in zip(k, eff)) / sum(eff))
    assert got.emission_2 == pytest.approx(sum(10.0 * a * 4.38 * b / 1000 for a, b in zip(k, eff)))
    assert got.dry_alt_2 == 0.0 and got.r2_dry_alt is None
    assert got.co2_2 == 10.0 and got.pco2_2 == 500.0


def test_rising_exchange_uses_the_mean(spark):
    rows = {"w": [(o, 800.0 / 2**o, 2.0**o, 0.0, 0.0, float(o)) for o in (1, 2, 3, 4, 5)]}
    got = network.extrapolate(summary(spark, rows), depth(spark, {"w": 4})).first()
    assert got.k_2 == pytest.approx(3.0) and got.dry_2 == 0.0


def test_one_bad_basin_does_not_stop_the_others(spark):
    good = [(o, 800.0 / 2**o, 2.0**o, 0.1, 0.1, 10.0 - o) for o in (1, 2, 3)]
    df = summary(spark, {"good": good, "bad": good[:1]})
    got = {r.wkbasin: r for r in network.extrapolate(df, depth(spark, {"good": 2, "bad": 2})).collect()}
    assert got["bad"].area_2 is None and got["bad"].end_order is None
    assert got["good"].area_2 > 0


@pytest.mark.parametrize("observed, ratio, annual", [
    ([80.0], 1.0, 100.0), ([90.0], 0.9, 90.0), ([150.0], 1.5, 150.0), ([500.0], 2.0, 500.0), ([95.0, 300.0], 0.95, 95.0)])
def test_width_override(spark, observed, ratio, annual):
    reach = spark.createDataFrame([(1, 100.0)], "comid long, width_year double")
    seen = spark.createDataFrame([(1, w) for w in observed], "comid long, width_mean double")
    row = reaches.override_width(reach, seen, NetworkOptions()).first()
    assert row.width_ratio == pytest.approx(ratio) and row.width_year_obs == annual


@pytest.mark.parametrize("part1, part2, expected", [
    ((0.0, None), (3.0, 5.0), 5.0), ((0.0, None), (0.0, None), 0.0), ((1.0, 2.0), (3.0, 6.0), 5.0), ((1.0, None), (3.0, 6.0), None)])
def test_combining_weighted_means(spark, part1, part2, expected):
    df = spark.createDataFrame([(*part1, *part2)], "eff_1 double, k_1 double, eff_2 double, k_2 double")
    assert df.select(basins.weighted_pair("k")).first()[0] == expected


def test_roll_up_of_cells_equals_direct_sums(spark):
    rows = [("b1" if i % 3 else "b2", "w", i % 2 + 1, i % 4 + 1, 100.0 + i, 0.2 + i * 0.01, 0.1, 2.0, 3.0, 400.0)
            for i in range(200)]
    df = spark.createDataFrame(rows, "hybas_id string, wkbasin string, month int, strm_order int, length_m double, "
                                     "width double, dryout double, k double, co2 double, pco2 double")
    keys = ["wkbasin", "month", "strm_order"]
    direct = network.network_cells(df, keys).orderBy(*keys).collect()
    rolled = network.roll_up(network.network_cells(df), keys, network.MODEL_SUMS).orderBy(*keys).collect()
    for a, b in zip(direct, rolled, strict=True):
        for c in ("n", *network.MODEL_SUMS):
            assert a[c] == pytest.approx(b[c])


def test_undefined_width_makes_the_cell_undefined(spark):
    rows = [("b", "w", 1, 1, 100.0, None, 0.1, 2.0, 3.0, 400.0), ("b", "w", 1, 1, 100.0, 1.0, 0.1, 2.0, 3.0, 400.0)]
    df = spark.createDataFrame(rows, "hybas_id string, wkbasin string, month int, strm_order int, length_m double, "
                                     "width double, dryout double, k double, co2 double, pco2 double")
    row = network.network_cells(df).first()
    assert row.area_km2 is None and row.width_sum is None and row.n == 2
    assert row.k_area == pytest.approx(2.0 * 100 * 1.0 / 1e6 * 0.9)
