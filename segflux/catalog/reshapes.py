"""Projections, renames, wide and long layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux import dims
from segflux.catalog.base import OPTIONS, inputs_of, query, rounded
from segflux.catalog.basins import summary_of
from segflux.functions import gas
from segflux.operators import joins, network, reshape
from segflux.plans import basins
from segflux.sources import sink

MM = [f"{m:02d}" for m in range(1, 13)]


@query("project_subset", "SELECT comid, strm_order, slope, length_m FROM reach")
def project_subset(b):
    return b.reach.select("comid", "strm_order", "slope", "length_m")


@query(
    "project_drop",
    "SELECT site_no, tavg_ann, prec_ann, " + ", ".join(f"tavg_{m}" for m in MM) + " FROM site_climate",
)
def project_drop(b):
    """Drop a generated set of columns."""
    return reshape.drop_generated(b.site_climate, "prec_", MM)


_WIDE2 = {"area_2": 5, "dry_2": 5, "eff_2": 5, "k_2": 4, "pco2_2": 3, "flux_2": 2, "emission_2": 3}


def _wide_sql(names: dict[str, str]) -> str:
    cols = ", ".join(
        f"round(max(CASE WHEN month = {i + 1} THEN {src} END), {_WIDE2[src]}) + 0e0 AS {out}_{mon}"
        for src, out in names.items() for i, mon in enumerate(dims.MONTHS)
    )
    return f"SELECT wkbasin, {cols} FROM ext_totals GROUP BY wkbasin"


@query("pivot_multi", _wide_sql({c: c for c in _WIDE2}))
def pivot_multi(b):
    """Seven metrics x 12 months, one row per working basin."""
    wide = sink.wide_months(network.extrapolate(*summary_of(b)), ["wkbasin"], list(_WIDE2))
    return rounded(wide, "wkbasin", **{f"{c}_{m}": d for c, d in _WIDE2.items() for m in dims.MONTHS})


_RENAMED = {"area_2": "rivArea", "dry_2": "ephemArea", "eff_2": "effectArea", "k_2": "k", "pco2_2": "pco2", "flux_2": "co2F",
            "emission_2": "co2E"}


@query("rename_prefix", _wide_sql(_RENAMED))
def rename_prefix(b):
    """Rename column families by prefix."""
    wide = sink.wide_months(network.extrapolate(*summary_of(b)), ["wkbasin"], list(_WIDE2))
    renamed = reshape.rename_prefix(wide, _RENAMED)
    return rounded(renamed, "wkbasin", **{f"{_RENAMED[c]}_{m}": d for c, d in _WIDE2.items() for m in dims.MONTHS})


@query(
    "pivot_single",
    """SELECT strm_order, count(*) FILTER (WHERE region = 1) AS "1", count(*) FILTER (WHERE region = 2) AS "2",
              count(*) FILTER (WHERE region = 3) AS "3", count(*) FILTER (WHERE region = 4) AS "4",
              count(*) FILTER (WHERE region = 5) AS "5", count(*) FILTER (WHERE region = 6) AS "6",
              count(*) FILTER (WHERE region = 7) AS "7", count(*) FILTER (WHERE region = 8) AS "8"
       FROM reach GROUP BY strm_order""",
)
def pivot_single(b):
    """One value per key and level to a column per level."""
    counts = b.reach.groupBy("strm_order", "region").agg(F.count("*").alias("n"))
    wide = reshape.to_wide(counts, ["strm_order"], "region", list(range(1, 9)), ["n"])
    return wide.select("strm_order", *[F.coalesce(F.col(str(r)), F.lit(0)).alias(str(r)) for r in range(1, 9)])


@query(
    "mutate_sequential",
    """SELECT hybas_id, month, round(eff * ice, 6) + 0e0 AS ice_area, round(eff - eff * ice, 6) + 0e0 AS open_area
       FROM obs_totals LEFT JOIN basin_ice USING (hybas_id, month)""",
)
def mutate_sequential(b):
    """Later expressions see earlier ones: covered area first, then what is left of the total."""
    i = inputs_of(b)
    cells = basins.basin_cells(i, OPTIONS)
    table = basins.observed_totals(cells).join(joins.monthly(i.basin_ice), ["hybas_id", "month"], "left")
    table = table.withColumn("ice_area", F.col("eff") * F.col("ice")).withColumn(
        "open_area", F.col("eff") - F.col("ice_area")
    )
    return rounded(table, "hybas_id month", ice_area=6, open_area=6)


@query(
    "ice_correction",
    """SELECT hybas_id, month, round(eff * ice, 6) + 0e0 AS ice_area, round(eff * (1e0 - ice), 6) + 0e0 AS eff,
              round(emission * (1e0 - ice), 4) + 0e0 AS emission
       FROM obs_totals LEFT JOIN basin_ice USING (hybas_id, month)""",
)
def ice_correction(b):
    i = inputs_of(b)
    cells = basins.basin_cells(i, OPTIONS)
    return rounded(basins.observed_part(cells, i), "hybas_id month", ice_area=6, eff=6, emission=4)


@query(
    "month_columns_apply",
    "SELECT site_no, "
    + ", ".join(
        f"round(CASE WHEN 0.67e0 * tavg_{m} + 7.45e0 < 0e0 THEN 0e0 ELSE 0.67e0 * tavg_{m} + 7.45e0 END, 6) + 0e0 AS tw_{m}" for m in MM
    )
    + " FROM site_climate",
)
def month_columns_apply(b):
    """The same function over twelve wide columns, for tables that must stay wide."""
    wide = reshape.apply_to_columns(b.site_climate, {f"tavg_{m}": f"tw_{m}" for m in MM}, gas.water_temperature)
    return rounded(wide, "site_no", **{f"tw_{m}": 6 for m in MM})


@query(
    "months_roundtrip",
    "SELECT comid, " + ", ".join(f"max(CASE WHEN month = {i + 1} THEN pco2 END) AS pco2_{m}" for i, m in enumerate(dims.MONTHS))
    + " FROM reach_pco2 GROUP BY comid",
)
def months_roundtrip(b):
    """Wide to long and back."""
    long = reshape.months_to_long(b.reach_pco2_wide, ["comid"], "co2_", "pco2")
    return sink.wide_months(long, ["comid"], ["pco2"])

