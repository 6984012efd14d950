from __future__ import annotations

import warnings
from dataclasses import replace

import pytest
from conftest import physical_plan
from pyspark.sql import functions as F

from segflux.operators import keycheck
from segflux.plans import inputs as plan_inputs
from segflux.plans import reaches
from segflux.plans.inputs import KeyDisagreement, NetworkOptions, from_binding
from segflux.sources import ingest
from segflux.sources.bindings import Binding


def months(df):
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


@pytest.fixture(scope="module")
def segments(spark):
    return spark.range(5000).withColumnRenamed("id", "comid")


def test_missing_extra_and_repeated_keys_are_counted_exactly(segments):
    good = months(segments)
    table = good.filter("not (comid = 17 and month = 3) and comid <> 99").unionByName(good.filter("comid = 5 and month in (1, 2)"))
    table = table.unionByName(good.limit(3).selectExpr("comid + 100000 AS comid", "month")).unionByName(good.limit(1).selectExpr("cast(null as long) comid", "month"))
    keys = ["comid", "month"]
    found = keycheck.compare([("t", good, table, keys), ("same", good, good.repartition(7), keys), ("ids", segments, segments.limit(0), ["comid"])])
    assert found[0] == keycheck.Agreement("t", 13, 3, 2, found[0].example) and found[0].example in ("5, 1", "5, 2")
    assert found[1] == keycheck.Agreement("same") and found[1].same
    assert found[2].missing == 5000 and found[2].extra == found[2].repeated == 0
    assert keycheck.compare([]) == []


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_two_errors_that_cancel_in_the_count(segments, buckets):
    """One key twice and another one missing: the counts agree, the sums do not."""
    table = segments.filter("comid <> 7").unionByName(segments.filter("comid = 8"))
    (found,) = keycheck.compare([("t", segments, table, ["comid"])], buckets)
    assert (found.missing, found.extra, found.repeated, found.example) == (1, 0, 1, "8")


def test_a_key_three_times_does_not_cancel_in_the_exclusive_or(segments):
    table = segments.unionByName(segments.filter("comid = 8")).unionByName(segments.filter("comid = 8"))
    (found,) = keycheck.compare([("t", segments, table, ["comid"])])
    assert (found.missing, found.extra, found.repeated) == (0, 0, 1)


def test_only_buckets_are_shuffled(segments):
    plan = physical_plan(keycheck.profile(months(segments), ["comid", "month"]))
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(comid" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def network(spark, small):
    return from_binding(Binding(spark, small))


def test_plans_raise_on_repeated_and_warn_on_missing_keys(network):
    twice = network.air_temp.unionByName(network.air_temp.filter("comid = 3 and month = 2"))
    with pytest.raises(ValueError, match="air_temp repeats, e.g. 3, 2"):
        reaches.gas_transfer_by_reach(replace(network, air_temp=twice))
    again = network.discharge.unionByName(network.discharge.filter("comid = 3 and month = 2 and stat = 'Qmean'"))
    with pytest.raises(ValueError, match="discharge repeats, e.g. 3, 2, Qmean"):
        reaches.gas_transfer_by_reach(replace(network, discharge=again))
    with pytest.raises(ValueError, match="repeats"):
        reaches.gas_transfer_by_reach(replace(network, reach=network.reach.unionByName(network.reach.limit(1))))
    fewer = replace(network, discharge=network.discharge.filter("comid <> 3"))
    with pytest.warns(KeyDisagreement, match="discharge: 14 keys missing"):
        table = reaches.gas_transfer_by_reach(fewer)
    assert table.filter("comid = 3 and k is null").count() == 12
    with warnings.catch_warnings():
        warnings.simplefilter("error", KeyDisagreement)
        reaches.gas_transfer_by_reach(fewer, NetworkOptions(check_keys=False))


def test_a_table_is_verified_once_per_set_of_inputs(network, monkeypatch):
    seen = []
    compare = keycheck.compare
    monkeypatch.setattr(plan_inputs.keycheck, "compare", lambda tables, *a: seen.append([t[0] for t in tables]) or compare(tables, *a))
    inputs = replace(network)
    reaches.gas_transfer_by_reach(inputs)
    reaches.gas_transfer_by_reach(inputs)
    assert [s for s in seen if s] == [["discharge", "air_temp"]]
    reaches.gas_transfer_by_reach(replace(inputs, air_temp=inputs.air_temp.filter("month > 0")))
    assert len([s for s in seen if s]) == 2


def test_discharge_by_segment_is_one_scan_and_one_shuffle(spark, network):
    flow = ingest.discharge_by_segment(network.discharge, {"Qmean": "q_year", "Qstd": "q_std"})
    monthly = {(r.comid, r.month): r.q for r in ingest.monthly_statistic(network.discharge).collect()}
    annual = {r.comid: (r.q_year, r.q_std) for r in ingest.annual_statistics(network.discharge, {"Qmean": "q_year", "Qstd": "q_std"}).collect()}
    rows = flow.collect()
    assert {r.comid: (r.q_year, r.q_std) for r in rows} == annual
    assert {(r.comid, m + 1): q for r in rows for m, q in enumerate(r.q_months) if q is not None} == {k: v for k, v in monthly.items() if v is not None}
    with pytest.raises(ValueError):
        ingest.discharge_by_segment(network.discharge, {"Q99": "q"})
