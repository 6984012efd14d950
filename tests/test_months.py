"""Tables with a row a month are never sent whole to every task: their size is that of the files they came from, times twelve."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from segflux.catalog import QUERIES
from segflux.catalog.base import OPTIONS
from segflux.plans import basins, reaches, training
from segflux.plans.inputs import KeyDisagreement, from_binding
from segflux.sources.bindings import Binding


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """A folder of a few customers, orders and lines."""
    folder = tmp_path_factory.mktemp("months")
    rows = spark.range(40).selectExpr(
        "id as c_custkey", "concat('c', id) as c_name", "cast(id % 25 as int) as c_nationkey", "id * 90e0 as c_acctbal",
        "'BUILDING' as c_mktsegment",
    )
    rows.write.parquet(f"{folder}/customer.parquet")
    spark.range(600).selectExpr(
        "id as o_orderkey", "id % 40 as o_custkey", "'F' as o_orderstatus", "1e3 + id * 700e0 as o_totalprice",
        "timestamp'1995-01-01 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(900).selectExpr("id % 500 as l_orderkey", "5e4 + id as l_extendedprice").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def broadcast_months(plan: str) -> list[str]:
    """Lines below a broadcast that expand months, unless they are aggregated before it."""
    found, above = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth]
        names = [x for _, x in above]
        if "Generate" in line and "BroadcastExchange" in names:
            last = len(names) - 1 - names[::-1].index("BroadcastExchange")
            if not any("Aggregate" in x for x in names[last:]):
                found.append(line.strip()[:80])
        above.append((depth, re.sub(r"^[\s:+*()\d-]*", "", line).split(" ")[0].split("(")[0]))
    return found


def test_the_reader_of_plans_sees_a_broadcast_table_of_months(spark):
    few = spark.range(5).select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    assert broadcast_months(physical_plan(spark.range(9).join(F.broadcast(few), "id")))


ICE = ["basin_part1", "ice_correction"]


@pytest.mark.parametrize("name", ICE)
def test_ice_is_not_broadcast(spark, own, name):
    plan = physical_plan(QUERIES[name](spark, own))
    assert "Generate" in plan and broadcast_months(plan) == []


def test_mutate_sequential_does_not_broadcast_ice(spark, own):
    assert broadcast_months(physical_plan(QUERIES["mutate_sequential"](spark, own))) == []


CLIMATE = ["dryout_by_order", "grouped_ols", "stream_order_summary", "join_left_wkbasin", "predict_orders", "extrapolate_emission",
           "ephemeral_status", "basin_part2", "basin_emission"]


@pytest.mark.parametrize("name", CLIMATE)
def test_working_basin_climate_does_not_broadcast_months(spark, own, name):
    assert broadcast_months(physical_plan(QUERIES[name](spark, own))) == []


def test_the_wide_emission_table_does_not_broadcast_months(spark, own):
    table = basins.basin_emission_wide(Binding(spark, own), OPTIONS)
    assert broadcast_months(physical_plan(table)) == []


def test_working_basin_climate_is_the_mean_over_basins(spark, own):
    b = Binding(spark, own)
    keys = reaches.basin_classes(b).select("hybas_id", "wkbasin")
    means = b.basin_climate.join(keys, "hybas_id").groupBy("wkbasin", "month").agg(F.avg("tavg").alias("tavg"), F.avg("prec").alias("prec"))
    rows = [[tuple(r[:2]) + tuple(round(x, 9) for x in r[2:]) for r in t.collect()] for t in (means, b.wk_climate)]
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) > 12


def test_features_of_segments_do_not_broadcast_months(spark, own):
    b = Binding(spark, own)
    table = training.reach_features(
        b.reach.join(b.reach_basin, "comid"), b.uparea, b.air_temp, b.basin_climate, b.basin_npp, b.basin_soil_resp, b.basin_static
    )
    plan = physical_plan(table)
    assert "Generate" in plan and broadcast_months(plan) == []
    # The written basin table, too, has a row a month.
    assert plan.count("SortMergeJoin [hybas_id") == 1


@pytest.mark.parametrize("name", ["co2_excess", "conditional_update", "discharge_bind"])
def test_months_of_segments_are_not_broadcast(spark, own, name):
    plan = physical_plan(QUERIES[name](spark, own))
    assert "Generate" in plan and broadcast_months(plan) == []


def test_cells_and_monthly_joins_move_a_row_a_segment(spark, own, conf):
    """No shuffle of cells, and none of months; the monthly tables are arrays before they join."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    b = Binding(spark, own)
    cells = physical_plan(basins.basin_cells(b, OPTIONS, kept=False))
    totals = physical_plan(basins.observed_totals(basins.basin_cells(b, OPTIONS, kept=False)))
    for plan in (cells, totals, physical_plan(QUERIES["reach_assembly"](spark, own))):
        assert "hashpartitioning(comid" in plan and not re.search(r"hashpartitioning\([^)]*month", plan)
        assert not re.search(r"Sort \[[^]]*month", plan)


def test_months_as_arrays_give_the_rows_of_a_join_by_month(spark, own):
    b = Binding(spark, own)
    inputs = from_binding(b)
    inputs.air_temp = b.air_temp.filter("comid % 7 <> 2 or month not in (4, 9)").unionByName(
        spark.createDataFrame([(None, 3, 1.0), (5, None, 2.0), (9, 13, 3.0)], "comid long, month int, ta double")
    )
    inputs.reach_pco2 = b.reach_pco2.filter("comid % 5 <> 1")
    reach = reaches.assemble_reaches(inputs, OPTIONS)
    with pytest.warns(KeyDisagreement):
        packed = reaches.observed_reach_months(inputs, OPTIONS, reach, place="hybas_id")
    plain = reaches.observed_reach_months(inputs, replace(OPTIONS, check_keys=False), reach)
    columns = sorted(plain.columns)
    assert sorted(packed.columns) == columns
    rows = [sorted(map(repr, t.select(*columns).collect())) for t in (packed, plain)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
    assert packed.filter("not keep").count() > 0 and packed.filter("ta is null").count() > 0
