"""Grouped aggregates, shares and tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS, inputs_of, query, rounded, rounded_sql
from segflux.catalog.views import strict
from segflux.operators import groups
from segflux.plans import basins, reaches


@query("count_by_wkbasin", "SELECT wkbasin, count(*) AS n FROM reach_static GROUP BY wkbasin ORDER BY n")
def count_by_wkbasin(b):
    """Segments per working basin, rarest first."""
    return reaches.assemble_reaches(inputs_of(b), OPTIONS).groupBy("wkbasin").agg(F.count("*").alias("n")).orderBy("n")


@query("min_width_by_reach", "SELECT comid, min(width_mean) AS width_mean FROM observed_width GROUP BY comid")
def min_width_by_reach(b):
    return b.observed_width.groupBy("comid").agg(F.min("width_mean").alias("width_mean"))


@query("first_by_key", "SELECT hybas_id, wkbasin FROM basin_list")
def first_by_key(b):
    """Working basin of every basin that has kept segments."""
    return basins.basin_list(_cells(b))


@query(
    "area_by_wkbasin",
    "SELECT wkbasin, sum(basin_area) AS basin_area FROM wk GROUP BY wkbasin",
)
def area_by_wkbasin(b):
    i = inputs_of(b)
    table = reaches.basin_classes(i).join(i.basin_area, "hybas_id", "left")
    return table.groupBy("wkbasin").agg(F.sum("basin_area").alias("basin_area"))


@query("area_ratio", rounded_sql("hybas_id wkbasin", "basin_share", area_ratio=8))
def area_ratio(b):
    """Share of a basin in the area of its working basin."""
    i = inputs_of(b)
    listed = basins.basin_list(_cells(b))
    return rounded(basins.basin_shares(listed, i), "hybas_id wkbasin", area_ratio=8)


def _cells(b):
    return basins.basin_cells(inputs_of(b), OPTIONS, kept=False)


@query("basin_month_area", rounded_sql("hybas_id month", "obs_totals", area=6, dry=7, eff=6))
def basin_month_area(b):
    """Water, dry and wet area per basin and month."""
    return rounded(basins.observed_totals(_cells(b)), "hybas_id month", area=6, dry=7, eff=6)


@query("basin_month_wmean", rounded_sql("hybas_id month", "obs_totals", pco2=3, k=4, flux=2))
def basin_month_wmean(b):
    """Concentration, exchange and flux weighted by wet area."""
    return rounded(basins.observed_totals(_cells(b)), "hybas_id month", pco2=3, k=4, flux=2)


@query("basin_month_emission", rounded_sql("hybas_id month", "obs_totals", emission=4))
def basin_month_emission(b):
    return rounded(basins.observed_totals(_cells(b)), "hybas_id month", emission=4)


@query(
    "coverage_ratio",
    """SELECT p AS n_part, w AS n_whole, round(p * 1e0 / w, 8) + 0e0 AS ratio
       FROM (SELECT count(*) AS p FROM obs_min) AS a, (SELECT count(*) AS w FROM reach_static) AS b""",
)
def coverage_ratio(b):
    """Share of segments with an observed width."""
    i = inputs_of(b)
    table = groups.coverage(
        reaches.smallest_observed_width(i.observed_width, 90.0), reaches.assemble_reaches(i, OPTIONS)
    )
    return rounded(table, "n_part n_whole", ratio=8)


@query("distinct_sorted", "SELECT DISTINCT wkbasin, strm_order FROM reach_static ORDER BY wkbasin, strm_order")
def distinct_sorted(b):
    """Stream orders present in every working basin."""
    reach = reaches.assemble_reaches(inputs_of(b), OPTIONS)
    return reach.select("wkbasin", "strm_order").distinct().orderBy("wkbasin", "strm_order")


@query(
    "strict_sums",
    f"""SELECT wkbasin, {strict('runoff')} AS strict_total, count(runoff) AS n_known, count(*) AS n
        FROM wk GROUP BY wkbasin""".replace("sum(runoff)", "round(sum(runoff), 5)"),
)
def strict_sums(b):
    """A sum is undefined as soon as one value is missing."""
    from segflux.functions import nulls

    table = reaches.basin_classes(inputs_of(b)).groupBy("wkbasin").agg(
        F.round(nulls.strict_sum("runoff"), 5).alias("strict_total"),
        F.count("runoff").alias("n_known"),
        F.count("*").alias("n"),
    )
    return table

