"""Lookups: left, inner, semi, anti; two-part and split tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS, inputs_of, query, rounded, rounded_sql
from segflux.functions import classify, hydraulics, nulls
from segflux.operators import joins, updates
from segflux.plans import reaches
from segflux.sources import ingest


@query(
    "join_left_reach",
    "SELECT r.comid, r.strm_order, q.q_year, o.width_observed FROM reach r LEFT JOIN q_ann q USING (comid) LEFT JOIN obs_min o USING (comid)",
)
def join_left_reach(b):
    """Left lookups on the segment key, one of them with gaps."""
    i = inputs_of(b)
    annual = ingest.annual_statistics(i.discharge, {"Qmean": "q_year"})
    table = joins.lookup(i.reach, annual, "comid")
    table = joins.lookup(table, reaches.smallest_observed_width(i.observed_width, 90.0), "comid")
    return table.select("comid", "strm_order", "q_year", "width_observed")


@query(
    "join_left_basin",
    "SELECT s.comid, s.hybas_id, b.hemis, b.runoff, b.basin_area FROM segment s LEFT JOIN basin b USING (hybas_id)",
)
def join_left_basin(b):
    i = inputs_of(b)
    table = joins.lookup(i.reach_basin, i.basin_hemis, "hybas_id")
    table = joins.lookup(joins.lookup(table, i.basin_runoff, "hybas_id"), i.basin_area, "hybas_id")
    return table.select("comid", "hybas_id", "hemis", "runoff", "basin_area")


@query(
    "join_left_wkbasin",
    rounded_sql("hybas_id wkbasin month", "wk LEFT JOIN wk_climate USING (wkbasin)", tavg=6, prec=6),
)
def join_left_wkbasin(b):
    i = inputs_of(b)
    table = reaches.basin_classes(i).join(i.wk_climate, "wkbasin", "left")
    return rounded(table, "hybas_id wkbasin month", tavg=6, prec=6)


@query(
    "join_left_to_inner",
    "SELECT s.comid, s.hybas_id, w.wkbasin FROM segment s JOIN wk w USING (hybas_id) WHERE w.runoff IS NOT NULL",
)
def join_left_to_inner(b):
    """Left lookup followed by a not-null filter."""
    i = inputs_of(b)
    return joins.keep_matched(i.reach_basin, reaches.basin_classes(i), "hybas_id", "runoff").select(
        "comid", "hybas_id", "wkbasin"
    )


@query("join_semi", "SELECT comid, strm_order FROM reach WHERE comid IN (SELECT comid FROM obs_min)")
def join_semi(b):
    wide = reaches.smallest_observed_width(b.observed_width, 90.0)
    return joins.in_table(b.reach, wide, "comid").select("comid", "strm_order")


@query("join_anti", "SELECT comid, strm_order FROM reach WHERE comid NOT IN (SELECT comid FROM obs_min)")
def join_anti(b):
    wide = reaches.smallest_observed_width(b.observed_width, 90.0)
    return joins.not_in_table(b.reach, wide, "comid").select("comid", "strm_order")


@query(
    "split_union",
    """SELECT comid, 'steep' AS branch, slope FROM reach WHERE slope > 0.01e0
       UNION ALL SELECT comid, 'gentle', slope FROM reach WHERE slope <= 0.01e0""",
)
def split_union(b):
    """Two treatments by slope as one expression instead of a split and a union."""
    slope = F.col("slope")
    return b.reach.select("comid", F.when(slope > 0.01, "steep").otherwise("gentle").alias("branch"), "slope")


@query(
    "keyed_patch",
    "SELECT comid, CASE WHEN comid IN (61, 31) THEN 35e0 ELSE uparea END AS uparea FROM uparea_table",
)
def keyed_patch(b):
    return updates.patch_by_key(b.uparea, "comid", "uparea", OPTIONS.uparea_patches)


@query(
    "classify_latitude",
    """SELECT hybas_id, lat, CASE WHEN lat > 56 THEN 'Polar' WHEN lat > 23.5e0 THEN 'North Temperate'
              WHEN lat >= -23.5e0 THEN 'Tropical' ELSE 'South Temperate' END AS climzone,
              CASE WHEN lat > 56 THEN 1 WHEN lat > 23.5e0 THEN 2 WHEN lat >= -23.5e0 THEN 3 ELSE 4 END AS ord FROM basin""",
)
def classify_latitude(b):
    """Climate band with its rank."""
    from segflux import dims

    table = b.basin_centroid.withColumn("climzone", classify.climate_band(F.col("lat")))
    out = joins.relabel(table, "climzone", dims.level_dim(b.spark, dims.BANDS_LONG), "label", "ord")
    return out.select("hybas_id", "lat", "climzone", "ord")


@query(
    "month_apply",
    rounded_sql(
        "comid month", "reach_temp", {"sc": "1742e0 - 91.24e0 * tw + 2.208e0 * tw * tw - 0.0219e0 * tw * tw * tw"}, tw=6, sc=5
    ),
)
def month_apply(b):
    """One function over all twelve months: a single expression in the long layout."""
    from segflux.functions import gas

    tw = gas.water_temperature(F.col("ta"))
    return rounded(b.air_temp.withColumns({"tw": tw, "sc": gas.schmidt_number(tw)}), "comid month", tw=6, sc=5)


@query(
    "conditional_update",
    """SELECT comid, month, CASE WHEN q >= 60e0 THEN 0e0 ELSE 1e0 END AS may_dry,
              round(CASE WHEN width_ratio > 2e0 THEN 2e0 ELSE width_ratio END, 7) + 0e0 AS width_ratio FROM reach_month""",
)
def conditional_update(b):
    """Masked updates: large rivers never dry, the width ratio is capped."""
    i = inputs_of(b)
    reach = reaches.override_width(reaches.assemble_reaches(i, OPTIONS), i.observed_width, OPTIONS)
    table = reach.join(joins.monthly(ingest.monthly_statistic(i.discharge)), "comid").withColumn("may_dry", F.lit(1.0))
    table = updates.update_where(table, "may_dry", F.col("q") >= hydraulics.PERENNIAL_DISCHARGE, F.lit(0.0))
    table = updates.update_where(table, "width_ratio", F.col("width_ratio") > 2.0, F.lit(2.0))
    return rounded(table, "comid month may_dry", width_ratio=7)


@query("filter_compare", "SELECT comid, slope FROM reach WHERE slope > 0.01e0")
def filter_compare(b):
    return b.reach.filter(F.col("slope") > 0.01).select("comid", "slope")


@query("filter_notnull", "SELECT hybas_id, runoff FROM basin WHERE runoff IS NOT NULL")
def filter_notnull(b):
    return b.basin_runoff.filter(F.col("runoff").isNotNull())


@query(
    "filter_in_list",
    """SELECT hybas_id, wkbasin FROM wk WHERE wkbasin NOT IN ('NARID13', 'SWET211')
       UNION ALL SELECT hybas_id, 'listed' FROM wk WHERE wkbasin IN ('NARID13', 'SWET211')""",
)
def filter_in_list(b):
    """Membership in a list and its complement; NULL is never a member."""
    table = reaches.basin_classes(inputs_of(b)).select("hybas_id", "wkbasin")
    listed = nulls.in_list("wkbasin", ["NARID13", "SWET211"])
    return table.filter(~listed).unionByName(table.filter(listed).withColumn("wkbasin", F.lit("listed")))
