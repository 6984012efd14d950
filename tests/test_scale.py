"""Plan shapes that have to hold at any size, and invariants of the composite plans."""

from __future__ import annotations

import re

import pytest
from conftest import final_plan, physical_plan
from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS
from segflux.operators import groups, network
from segflux.plans import basins, reaches, training
from segflux.catalog.sites import site_inputs
from segflux.plans.inputs import from_binding
from segflux.sources.bindings import Binding


@pytest.fixture(scope="module")
def b(spark, small):
    return Binding(spark, small)


@pytest.fixture(scope="module")
def stored(spark, b, tmp_path_factory):
    """Inputs as separate files, as on a cluster."""
    folder = tmp_path_factory.mktemp("inputs")
    inputs = from_binding(b)
    for name in list(inputs.__dataclass_fields__):
        df = getattr(inputs, name)
        if df is not None:
            df.write.parquet(f"{folder}/{name}")
            setattr(inputs, name, spark.read.parquet(f"{folder}/{name}"))
    return inputs


def hash_keys(plan: str) -> list[str]:
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


def test_segment_months_are_placed_once(spark, stored, conf):
    """Every table is shuffled once on the segment key; the month joins and the window reuse it.

    Segments, air temperature, concentration and observed widths; discharge came with the segments.
    """
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    reach = reaches.assemble_reaches(stored, OPTIONS)
    plan = physical_plan(network.network_cells(reaches.observed_reach_months(stored, OPTIONS, reach)))
    assert hash_keys(plan).count("comid") == 4
    assert sorted(set(hash_keys(plan))) == ["comid", "hybas_id, wkbasin, month, strm_order"]
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_monthly_tables_are_never_broadcast(stored):
    plan = physical_plan(reaches.gas_transfer_by_reach(stored))
    assert "BroadcastHashJoin" not in plan


def test_filters_and_columns_reach_the_scan(stored):
    plan = physical_plan(reaches.gas_transfer_by_reach(stored))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(stat,Qmean\)", plan)
    assert "ReadSchema: struct<region:int,comid:bigint,slope:double>" in plan


def test_no_python_in_any_row_path(b):
    for df in (reaches.gas_transfer_by_reach(b), training.training_table(site_inputs(b))):
        assert "Python" not in physical_plan(df)


def test_a_hot_segment_is_split(spark, conf):
    """A group holding a third of all rows is cut into several tasks on the join back."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__shuffle__partitions="16",
    )
    n = 120_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    df = spark.range(0, n, 1, 8).select(hot.alias("k"), F.rand(1).alias("v"))
    out = groups.normalize_by_group(df, ["k"], "v", "share")
    assert "skew=true" in final_plan(out)
    assert out.count() == n


def test_parts_of_the_area_add_up(stored):
    cells = basins.basin_cells(stored, OPTIONS)
    bad = basins.observed_totals(cells).filter(F.abs(F.col("dry") + F.col("eff") - F.col("area")) > 1e-9)
    assert bad.count() == 0
    part1 = basins.observed_part(cells, stored)
    part2 = basins.extrapolated_part(basins.basin_list(cells), basins.extrapolated(cells, stored), stored)
    whole = basins.combine_parts(part1, part2)
    keys = ["hybas_id", "month"]
    sums = (
        part1.select(*keys, F.col("emission").alias("e1"))
        .join(part2.select(*keys, F.col("emission").alias("e2")), keys)
        .join(whole.select(*keys, "emission"), keys)
        .filter(F.abs(F.col("e1") + F.col("e2") - F.col("emission")) > 1e-9)
    )
    assert sums.count() == 0
    assert whole.groupBy(*keys).count().filter("count > 1").count() == 0


def test_shares_of_every_working_basin_sum_to_one(stored):
    cells = basins.basin_cells(stored, OPTIONS)
    shares = basins.basin_shares(basins.basin_list(cells), stored)
    off = shares.groupBy("wkbasin").agg(F.sum("area_ratio").alias("s")).filter(F.abs(F.col("s") - 1.0) > 1e-9)
    assert off.count() == 0


def test_a_delivered_exchange_table_gives_the_same_result(stored):
    from dataclasses import replace

    k = reaches.gas_transfer_by_reach(stored)
    one = reaches.assemble_reach_months(stored, OPTIONS).select("comid", "month", F.round("k", 9))
    two = reaches.assemble_reach_months(replace(stored, reach_k=k), OPTIONS).select("comid", "month", F.round("k", 9))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_a_slope_floor_is_optional(stored):
    from dataclasses import replace

    options = replace(OPTIONS, min_slope=0.002)
    low = reaches.gas_transfer_by_reach(stored).agg(F.min("k")).first()[0]
    assert reaches.gas_transfer_by_reach(stored, options).agg(F.min("k")).first()[0] >= low


def test_key_checks_pass_on_the_test_data(stored):
    from dataclasses import replace

    assert reaches.assemble_reaches(stored, replace(OPTIONS, check_keys=True)).count() > 0


def test_a_repeated_lookup_key_raises(stored):
    from dataclasses import replace

    twice = stored.reach_basin.unionByName(stored.reach_basin.limit(1))
    with pytest.raises(ValueError, match="repeats"):
        basins.basin_emission(replace(stored, reach_basin=twice), OPTIONS)


def test_segments_without_discharge_stay(stored):
    from dataclasses import replace

    few = stored.discharge.filter("comid % 10 <> 3")
    n = stored.reach.count()
    lost = stored.reach.filter("comid % 10 = 3").count()
    out = reaches.gas_transfer_by_reach(replace(stored, discharge=few))
    assert out.count() == 12 * n and out.filter("k is null").count() >= 12 * lost > 0


def test_measurements_of_unknown_months_stay(b):
    from dataclasses import replace

    inputs = site_inputs(b)
    odd = F.when(F.col("row_id") % 5 == 0, F.lit("January")).when(F.col("row_id") % 5 == 1, F.lit(None)).otherwise(F.col("mon"))
    whole, changed = (training.training_table(replace(inputs, meas=m)) for m in (inputs.meas, inputs.meas.withColumn("mon", odd)))
    assert changed.count() == whole.count()
    unknown = changed.filter("mon is null or mon = 'January'")
    assert unknown.count() > 0 and unknown.filter("tavg_00 is not null or elev is null").count() == 0


def test_only_the_first_part_has_coded_orders(spark):
    parts = [spark.createDataFrame([(2, 0), (4, 255), (6, 3)], "site_no long, so int"), spark.createDataFrame([(1, 0), (3, 2)], "site_no long, so int")]
    assert {r.site_no: r.so for r in training.stream_orders(parts).collect()} == {2: -1, 4: 0, 6: 3, 1: 0, 3: 2}


def test_shuffle_width_follows_the_input():
    from segflux.session import TASK_BYTES, shuffle_partitions_for

    assert shuffle_partitions_for(100 * 10**12) * TASK_BYTES >= 100 * 10**12
    assert shuffle_partitions_for(1) == 8
