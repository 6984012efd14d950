"""Composite plans: exchange, segments, extrapolation, basins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS, inputs_of, query, rounded, rounded_sql
from segflux.dims import MONTHS
from segflux.operators import network
from segflux.plans import basins, reaches
from segflux.sources import sink


@query(
    "gas_transfer_by_basin",
    """SELECT hybas_id, month, count(*) AS n, round(avg(k), 4) + 0e0 AS k
       FROM reach_k JOIN reach_basin USING (comid) GROUP BY hybas_id, month""",
)
def gas_transfer_by_basin(b):
    """Gas transfer velocity of all segments, averaged per basin and month."""
    i = inputs_of(b)
    k = reaches.gas_transfer_by_reach(i).join(i.reach_basin, "comid")
    table = k.groupBy("hybas_id", "month").agg(F.count("*").alias("n"), F.avg("k").alias("k"))
    return rounded(table, "hybas_id month n", k=4)


@query(
    "gas_transfer_wide",
    "SELECT region, comid, "
    + ", ".join(f"round(max(CASE WHEN month = {m + 1} THEN k END), 4) + 0e0 AS k_{mon}" for m, mon in enumerate(MONTHS))
    + " FROM reach_k GROUP BY region, comid",
)
def gas_transfer_wide(b):
    """Output layout of the exchange plan: one row per segment, twelve months."""
    wide = sink.wide_months(reaches.gas_transfer_by_reach(inputs_of(b)), ["region", "comid"], ["k"])
    return rounded(wide, "region comid", **{f"k_{m}": 4 for m in MONTHS})


_REACH = {"q_year": 6, "width_year": 4, "width": 4, "dryout_year": 7, "dryout": 7, "tw": 6, "k": 4, "co2": 5, "pco2": 4}


@query("reach_assembly", rounded_sql("region comid hybas_id wkbasin month strm_order", "reach_month", **_REACH))
def reach_assembly(b):
    """Segment-month table of hydraulics and chemistry."""
    table = reaches.assemble_reach_months(inputs_of(b), OPTIONS)
    return rounded(table, "region comid hybas_id wkbasin month strm_order", **_REACH)


@query(
    "width_override",
    rounded_sql(
        "comid month", "reach_month", {"width": "width * width_ratio"}, width_ratio=7, width_year_obs=5, width=4
    ),
)
def width_override(b):
    """Observed widths replace modelled ones, months scaled by the capped ratio."""
    i = inputs_of(b)
    reach = reaches.override_width(reaches.assemble_reaches(i, OPTIONS), i.observed_width, OPTIONS)
    table = reaches.assemble_reach_months(i, OPTIONS, reach)
    table = table.withColumn("width", F.col("width") * F.col("width_ratio"))
    return rounded(table, "comid month", width_ratio=7, width_year_obs=5, width=4)


_ORDER = {"length_km": 8, "width_m": 5, "area_km2": 6, "dry_km2": 7, "dry_ratio": 7, "dry_alt_km2": 7,
          "dry_alt_ratio": 7, "k": 4, "co2": 4, "pco2": 3}


def cells_of(b, kept=True):
    i = inputs_of(b)
    return i, basins.basin_cells(i, OPTIONS, kept)


def summary_of(b):
    """Stream-order table straight from the segment-month table."""
    i = inputs_of(b)
    keys = ("wkbasin", "month", "strm_order")
    cells = network.network_cells(reaches.assemble_reach_months(i, OPTIONS), keys)
    cells = sink.materialize(cells, "order-cells")
    return network.stream_order_summary(cells, i.wk_climate), network.fit_depth(cells)


@query("stream_order_summary", rounded_sql("wkbasin month strm_order n", "so_summary", **_ORDER))
def stream_order_summary(b):
    return rounded(summary_of(b)[0], "wkbasin month strm_order n", **_ORDER)


@query("fit_depth", "SELECT wkbasin, depth FROM depths")
def fit_depth(b):
    i = inputs_of(b)
    reach = reaches.assemble_reaches(i, OPTIONS)
    return network.fit_depth(reach)


@query("top_n_orders", rounded_sql("wkbasin month strm_order rn depth", "so_ranked WHERE rn <= depth", {"rn": "CAST(rn AS INT)"}, width_m=5, length_km=8))
def top_n_orders(b):
    """The first orders of every group, as many as its fit depth."""
    return rounded(network.first_orders(*summary_of(b)), "wkbasin month strm_order rn depth", width_m=5, length_km=8)


@query("largest_nonzero_order", "SELECT wkbasin, month, CAST(max(dry_depth) AS INT) AS dry_depth FROM so_dry GROUP BY wkbasin, month")
def largest_nonzero_order(b):
    summary, depth = summary_of(b)
    table = summary.join(depth, "wkbasin")
    deepest = network.deepest_dry_order(F.col("strm_order"), F.col("depth"), F.col("dry_ratio"))
    return table.groupBy("wkbasin", "month").agg(deepest.alias("dry_depth"))


_FIT = {f"{p}_{n}": 5 for p in ("slope", "icept", "r2") for n in ("width", "length", "k", "dry", "dry_alt")}


@query("grouped_ols", rounded_sql("wkbasin month depth", "fits", **_FIT))
def grouped_ols(b):
    """Five scaling fits per working basin and month."""
    return rounded(network.fit_orders(*summary_of(b)), "wkbasin month depth", **_FIT)


@query("end_order", rounded_sql("wkbasin month", "ends", end_order=6))
def end_order(b):
    return rounded(network.end_order(network.fit_orders(*summary_of(b))), "wkbasin month", end_order=6)


@query(
    "extrapolated_orders",
    rounded_sql("wkbasin month", "ext_orders", {"order_no": "ord"}, order_no=6),
)
def extrapolated_orders(b):
    fits = network.end_order(network.fit_orders(*summary_of(b)))
    return rounded(network.extrapolated_orders(fits, "order_no"), "wkbasin month", order_no=6)


_PRED = {"width_m": 5, "length_km": 5, "k": 4, "ratio": 6, "ratio_alt": 6, "area_km2": 6, "dry_km2": 6, "eff_km2": 6,
         "flux": 2, "emission": 4}


@query(
    "predict_orders",
    rounded_sql("wkbasin month", "ext_c", {"order_no": "ord"}, order_no=6, **_PRED),
)
def predict_orders(b):
    fits = network.end_order(network.fit_orders(*summary_of(b)))
    rows = network.predict_orders(network.extrapolated_orders(fits, "order_no"), "order_no")
    return rounded(rows, "wkbasin month", order_no=6, **_PRED)


_EXT = {"end_order": 6, "r2_width": 6, "r2_length": 6, "r2_dry": 5, "r2_dry_alt": 5, "r2_k": 5, "dry_1": 6, "dry_alt_1": 6,
        "length_2": 4, "area_2": 5, "dry_2": 5, "dry_alt_2": 5, "eff_2": 5, "k_2": 4, "co2_2": 4, "pco2_2": 3,
        "flux_2": 2, "emission_2": 3}


@query("extrapolate_emission", rounded_sql("wkbasin month", "ext_totals", **_EXT))
def extrapolate_emission(b):
    """Small streams below the mapped network: twenty result columns per working basin and month."""
    return rounded(network.extrapolate(*summary_of(b)), "wkbasin month", **_EXT)


@query(
    "ephemeral_status",
    """SELECT wkbasin, month, CASE WHEN dry_depth < 2 THEN 'too few orders' WHEN max_dry_alt = 0 THEN 'no dry order'
              WHEN r2_dry_alt IS NULL THEN 'undefined' ELSE 'fitted' END AS status FROM fits""",
)
def ephemeral_status(b):
    """Why an alternative dry-out fit has no r-squared, in a column of its own."""
    fits = network.fit_orders(*summary_of(b))
    status = (
        F.when(F.col("dry_depth") < 2, "too few orders")
        .when(F.col("max_dry_alt") == 0, "no dry order")
        .when(F.col("r2_dry_alt").isNull(), "undefined")
        .otherwise("fitted")
    )
    return fits.select("wkbasin", "month", status.alias("status"))


_ATTRIBUTES_SQL = (
    """SELECT s.hybas_id, s.wkbasin, """
    + "CASE WHEN b.lat > 56 THEN 'Polar' WHEN b.lat > 23.5e0 THEN 'North Temperate' WHEN b.lat >= -23.5e0 THEN 'Tropical' ELSE 'South Temperate' END AS climzone, "
    """CASE WHEN b.runoff < 50 THEN 'Arid' WHEN b.runoff < 500 THEN 'Mod' WHEN b.runoff >= 500 THEN 'Wet' END AS wetness,
       s.basin_area, s.wkbasin_area, round(s.area_ratio, 8) + 0e0 AS area_ratio, b.lat,
       round(a.ann_temp, 6) + 0e0 AS ann_temp, round(a.ann_prec, 6) + 0e0 AS ann_prec,
       round(n.gpp, 6) + 0e0 AS gpp, round(n.npp, 6) + 0e0 AS npp, """
    + ", ".join(f"round(p.{v}_{m}, 6) + 0e0 AS {v}_{m}" for v in ("gpp", "npp") for m in MONTHS) + ", "
    + ", ".join(f"round(q.prs_{m}, 6) + 0e0 AS prs_{m}" for m in MONTHS)
    + """ FROM basin_share s LEFT JOIN basin b USING (hybas_id) LEFT JOIN basin_annual a USING (hybas_id)
       LEFT JOIN (SELECT hybas_id, avg(gpp) AS gpp, avg(npp) AS npp FROM basin_npp GROUP BY hybas_id) AS n USING (hybas_id)
       LEFT JOIN (SELECT hybas_id, """
    + ", ".join(f"max(CASE WHEN month = {i + 1} THEN {v} END) AS {v}_{m}" for v in ("gpp", "npp") for i, m in enumerate(MONTHS))
    + """ FROM basin_npp GROUP BY hybas_id) AS p USING (hybas_id)
       LEFT JOIN (SELECT hybas_id, """
    + ", ".join(f"max(CASE WHEN month = {i + 1} THEN prs * 365e0 END) AS prs_{m}" for i, m in enumerate(MONTHS))
    + " FROM basin_soil_resp GROUP BY hybas_id) AS q USING (hybas_id)"
)
_PLACE = "hybas_id wkbasin climzone wetness basin_area wkbasin_area lat"
_ATTRIBUTES = {"area_ratio": 8, "ann_temp": 6, "ann_prec": 6, "gpp": 6, "npp": 6}
_ATTRIBUTES |= {f"{v}_{m}": 6 for v in ("gpp", "npp", "prs") for m in MONTHS}


@query("basin_attributes", _ATTRIBUTES_SQL)
def basin_attributes(b):
    """Location, zone, area and share, climate, annual and monthly productivity, monthly respiration."""
    i, cells = cells_of(b, kept=False)
    return rounded(basins.basin_attributes(cells, i), _PLACE, **_ATTRIBUTES)


_PART = {"area": 6, "dry": 7, "ice_area": 6, "eff": 6, "emission": 4, "pco2": 3, "k": 4, "flux": 2}


@query("basin_part1", rounded_sql("hybas_id month", "part_1", **_PART))
def basin_part1(b):
    """Observed network per basin and month, ice-corrected."""
    i, cells = cells_of(b)
    return rounded(basins.observed_part(cells, i), "hybas_id month", **_PART)


@query("basin_part2", rounded_sql("hybas_id month", "part_2", **_PART))
def basin_part2(b):
    """Extrapolated network handed down to basins, ice-corrected."""
    i, cells = cells_of(b)
    part = basins.extrapolated_part(basins.basin_list(cells), basins.extrapolated(cells, i), i)
    return rounded(part, "hybas_id month", **_PART)


@query("basin_emission", rounded_sql("hybas_id month", "combined", **_PART))
def basin_emission(b):
    """Flagship: monthly area, exchange, flux and emission of every basin."""
    return rounded(basins.basin_emission(inputs_of(b), OPTIONS), "hybas_id month", **_PART)


_WIDE = {f"{m}_{mon}": d for m, d in _PART.items() for mon in MONTHS}


@query(
    "basin_emission_wide",
    f"SELECT a.*, w.* EXCLUDE (hybas_id) FROM ({_ATTRIBUTES_SQL}) AS a LEFT JOIN (SELECT hybas_id, "
    + ", ".join(
        f"round(max(CASE WHEN month = {i + 1} THEN {m} END), {d}) + 0e0 AS {m}_{mon}"
        for m, d in _PART.items() for i, mon in enumerate(MONTHS)
    )
    + " FROM combined GROUP BY hybas_id) AS w USING (hybas_id)",
)
def basin_emission_wide(b):
    """Final output layout: one row per basin, its attributes and 8 metrics x 12 months, written and read back."""
    table = rounded(basins.basin_emission_wide(inputs_of(b), OPTIONS), _PLACE, **_ATTRIBUTES, **_WIDE)
    path = sink.new_path(b.spark, "basin-emission")
    basins.write_emission(table, path)
    return b.spark.read.schema(table.schema).option("header", True).csv(path)
