from __future__ import annotations

import pytest
from conftest import final_plan, physical_plan
from pyspark.sql import functions as F

from segflux import dims
from segflux.operators import groups, joins, reshape, updates
from segflux.session import shuffle_partitions_for
from segflux.sources import ingest, sink
from segflux.sources.bindings import Binding


@pytest.fixture(scope="module")
def b(spark, small):
    return Binding(spark, small)


def test_typed_scan_rejects_bad_numbers(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("hybas_id,runoff\n0012,3.5\n7,abc\n")
    with pytest.raises(Exception, match="(?i)malformed|runoff|abc"):
        ingest.scan(spark, str(path), "basin_runoff").collect()


def test_typed_scan_keeps_text_keys(spark, tmp_path):
    path = tmp_path / "ok.csv"
    path.write_text("hybas_id,runoff\n0012,3.5\n7,\n")
    rows = {r.hybas_id: r.runoff for r in ingest.scan(spark, str(path), "basin_runoff").collect()}
    assert rows == {"0012": 3.5, "7": None}


def test_region_directories_are_padded_and_pruned(spark, b, tmp_path):
    path = str(tmp_path / "regions")
    sink.write_regions(b.reach, path, b.reach.columns)
    assert (tmp_path / "regions" / "region=01").is_dir()
    part = ingest.scan_regions(spark, path, "reach", regions=[2, 3])
    assert {r.region for r in part.select("region").distinct().collect()} == {2, 3}
    assert "PartitionFilters: [isnotnull(region" in physical_plan(part) or "region#" in physical_plan(part).split("PartitionFilters: [")[1].split("]")[0]
    assert ingest.scan_regions(spark, path, "reach").count() == b.reach.count()


def test_parts_with_other_columns_do_not_append(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    assert ingest.union_parts([a, a.select("v", "k")]).count() == 2
    with pytest.raises(ValueError, match="tables differ"):
        ingest.union_parts([a, a.withColumn("v", F.lit(1.0))])


def test_unknown_statistic(b):
    with pytest.raises(ValueError, match="unknown discharge statistic"):
        ingest.monthly_statistic(b.discharge, "Q99")


def test_materialized_table_lies_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = sink.shared_folder(spark)
    assert folder == (named or folder) and sink.shared_folder(spark) == folder
    df = sink.materialize(spark.range(10), "numbers")
    assert df.count() == 10
    assert all(f"{folder}/segflux/numbers-" in path for path in df.inputFiles())


def test_only_a_local_master_may_lack_the_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        sink.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert sink.shared_folder(Session()) == sink.shared_folder(Session())


def test_bucketed_tables_join_without_shuffle(spark, b, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    for name in ("reach", "uparea"):
        spark.sql(f"DROP TABLE IF EXISTS t_{name}")
        sink.save_bucketed(getattr(b, name), f"t_{name}", 4)
    joined = spark.table("t_reach").join(spark.table("t_uparea"), "comid")
    assert "Exchange" not in final_plan(joined)
    assert joined.count() == b.reach.count()
    for name in ("reach", "uparea"):
        spark.sql(f"DROP TABLE t_{name}")


def test_lookup_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    assert joins.lookup(left, right, "k").count() == 3
    with pytest.raises(ValueError, match="repeats"):
        joins.lookup(left, right, "k", unique=True)


def test_group_statistics_join_either_way(spark, conf):
    key = F.when(F.col("id") % 10 > 0, F.col("id") % 10)
    df = spark.range(100).withColumn("g", key)
    stats = df.groupBy("g").agg(F.max("id").alias("top"))
    few = joins.attach_stats(df, stats, ["g"])
    assert "BroadcastHashJoin" in physical_plan(few)
    rows = sorted(few.select("id", "top").collect())
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    many = joins.attach_stats(df, stats, ["g"])
    assert "SortMergeJoin" in physical_plan(many)
    assert sorted(many.select("id", "top").collect()) == rows
    assert all(top == 90 + i % 10 for i, top in rows)


def test_long_and_wide_are_inverse(b):
    long = reshape.months_to_long(b.reach_pco2_wide, ["comid"], "co2_", "pco2")
    assert long.exceptAll(b.reach_pco2.select("comid", "month", "pco2")).count() == 0
    wide = sink.wide_months(long, ["comid"], ["pco2"])
    names = [f"pco2_{m}" for m in dims.MONTHS]
    assert wide.select("comid", *names).exceptAll(b.reach_pco2_wide.toDF("comid", *names)).count() == 0


def test_own_month_takes_scale_and_annual(spark):
    row = (1, *[float(i) for i in range(1, 13)], 99.0)
    df = spark.createDataFrame([row], "site long, " + ", ".join(f"p_{i:02d} double" for i in range(1, 13)) + ", p_ann double")
    got = reshape.own_month_table(df, ["site"], {"p": ("p", "p_ann")}, {"p": [2.0] * 12})
    assert {r.mon: r.p for r in got.collect()} == {**{m: 2.0 * (i + 1) for i, m in enumerate(dims.MONTHS)}, "Ann": 99.0, reshape.NO_MONTH: None}


def test_prefix_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "area_2_Jan int, area_2_Feb int, other int")
    assert reshape.rename_prefix(df, {"area_2": "rivArea"}).columns == ["rivArea_Jan", "rivArea_Feb", "other"]


def test_recode_does_not_chain(spark):
    df = spark.createDataFrame([(0,), (255,), (3,)], "so int")
    assert [r[0] for r in df.select(updates.recode(F.col("so"), {0: -1, 255: 0})).collect()] == [-1, 0, 3]


def test_limits_drop_only_offenders(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 5.0), (None, 5.0)], "g string, x double")
    assert df.filter(updates.within_limits(F.col("g"), F.col("x"), {"a": (None, 3.0)})).count() == 3


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("w1", 1.0), ("w1", 3.0), ("w2", 5.0)], "w string, a double")
    out = groups.share_of_group(df, ["w"], "a", "share", "total")
    assert {r[0]: r[1] for r in out.groupBy("w").agg(F.sum("share")).collect()} == {"w1": 1.0, "w2": 1.0}


def test_key_mismatch(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    right = spark.createDataFrame([(2,), (3,), (4,)], "k long")
    assert groups.key_mismatch(left, right, ["k"]).first().asDict() == {"left_only": 1, "right_only": 2, "both": 1}
    with pytest.raises(ValueError, match="keys differ"):
        groups.require_same_keys(left, right, ["k"])
    groups.require_same_keys(left, left, ["k"])


def test_shuffle_width_grows_with_the_input():
    assert shuffle_partitions_for(10**6) == 8
    assert 600_000 > shuffle_partitions_for(100 * 10**12) >= 400_000


def test_many_lookup_keys_are_checked_at_once(spark):
    good = spark.createDataFrame([(1, 1), (2, 1), (None, 1)], "k int, v int")
    bad = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "name string, month int")
    joins.require_unique_keys([(good, ["k"])])
    joins.require_unique_keys([])
    with pytest.raises(ValueError, match="month.*a, 1"):
        joins.require_unique_keys([(good, ["k"]), (bad, ["name", "month"])])
