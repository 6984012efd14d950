"""Per-row formulas of the segment network."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS, inputs_of, query, rounded, rounded_sql
from segflux.catalog.views import DRY_ALT, floor_q, qlevel, schmidt, velocity, excess
from segflux.functions import classify, gas, hydraulics
from segflux.operators import quantiles
from segflux.operators.joins import monthly
from segflux.plans import reaches
from segflux.sources import ingest


@query(
    "discharge_floor",
    rounded_sql("comid month stat value", "discharge", {"value": floor_q("value")}),
)
def discharge_floor(b):
    """No rounding here: the values lie on a decimal grid, where rounding would only break ties."""
    return b.discharge.withColumn("value", hydraulics.discharge_floor(F.col("value")))


@query("water_temperature", rounded_sql("comid month", "reach_temp", tw=6))
def water_temperature(b):
    return rounded(b.air_temp.withColumn("tw", gas.water_temperature(F.col("ta"))), "comid month", tw=6)


@query("flow_velocity", rounded_sql("comid month", "q_month", {"v": velocity("q")}, v=7))
def flow_velocity(b):
    q = ingest.monthly_statistic(b.discharge)
    return rounded(q.withColumn("v", hydraulics.flow_velocity(F.col("q"))), "comid month", v=7)


@query("schmidt_number", rounded_sql("comid month", "reach_temp", {"sc": schmidt("tw")}, sc=5))
def schmidt_number(b):
    tw = gas.water_temperature(F.col("ta"))
    return rounded(b.air_temp.withColumn("sc", gas.schmidt_number(tw)), "comid month", sc=5)


@query(
    "gas_transfer_velocity",
    rounded_sql(
        "comid month",
        "reach_k JOIN (SELECT comid, slope FROM reach) AS r USING (comid)",
        {"dissipation": "9.81e0 * slope * v"},
        v=7, dissipation=7, k=4,
    ),
)
def gas_transfer_velocity(b):
    """Velocity, energy dissipation and exchange of every segment and month."""
    q = ingest.monthly_statistic(b.discharge)
    table = b.reach.join(q.hint("merge"), "comid").join(b.air_temp.hint("merge"), ["comid", "month"], "left")
    table = table.withColumn("v", hydraulics.flow_velocity(F.col("q")))
    table = table.withColumns(
        {
            "dissipation": hydraulics.energy_dissipation(F.col("slope"), F.col("v")),
            "k": gas.gas_transfer_velocity(
                F.col("slope"), F.col("v"), gas.schmidt_number(gas.water_temperature(F.col("ta")))
            ),
        }
    )
    return rounded(table, "comid month", v=7, dissipation=7, k=4)


@query(
    "site_k600",
    rounded_sql(
        "site_no", "site_flow",
        {"v": velocity("ann_q"), "k600": f"2841e0 * slope * {velocity('ann_q')} + 2.02e0"}, v=7, k600=6,
    ),
)
def site_k600(b):
    table = b.site_flow.withColumn("v", hydraulics.flow_velocity(F.col("ann_q")))
    return rounded(table.withColumn("k600", gas.k600_low_energy(F.col("slope"), F.col("v"))), "site_no", v=7, k600=6)


@query("discharge_cv", rounded_sql("comid", "q_ann", {"q_cv": "q_std / q_year"}, q_cv=8))
def discharge_cv(b):
    annual = ingest.annual_statistics(b.discharge, {"Qmean": "q_year", "Qstd": "q_std"})
    cv = hydraulics.coefficient_of_variation(F.col("q_std"), F.col("q_year"))
    return rounded(annual.withColumn("q_cv", cv), "comid", q_cv=8)


@query(
    "co2_excess",
    f"""SELECT p.comid, p.month, round({excess('p.pco2', 't.tw')}, 5) + 0e0 AS co2
        FROM reach_pco2 p LEFT JOIN reach_temp t ON t.comid = p.comid AND t.month = p.month""",
)
def co2_excess(b):
    i = inputs_of(b)
    table = i.reach.select("comid").join(monthly(i.reach_pco2), "comid").join(monthly(i.air_temp), ["comid", "month"], "left")
    excess = gas.excess_co2(F.col("pco2"), gas.water_temperature(F.col("ta")))
    return rounded(table.withColumn("co2", excess), "comid month", co2=5)


@query("annual_width", rounded_sql("comid qlevel", "reach_b", width_year=5))
def annual_width(b):
    i = inputs_of(b)
    annual = ingest.annual_statistics(i.discharge, {"Qmean": "q_year"})
    table = (
        i.reach_basin.filter(F.col("hybas_id") != "0")
        .join(reaches.basin_classes(i), "hybas_id")
        .join(annual, "comid")
        .withColumn("width_year", hydraulics.annual_width(F.col("qlevel"), F.col("q_year")))
    )
    return rounded(table, "comid qlevel", width_year=5)


@query(
    "width_exponent",
    rounded_sql("comid", "reach_static", runoff_reach=3, exponent=7, q_cv=8, coefficient=5),
)
def width_exponent(b):
    """Runoff of the reach, winsorised cv and exponent, and the width coefficient."""
    return rounded(
        reaches.assemble_reaches(inputs_of(b), OPTIONS), "comid", runoff_reach=3, exponent=7, q_cv=8, coefficient=5
    )


@query("monthly_width", rounded_sql("comid month", "reach_month", width=4))
def monthly_width(b):
    return rounded(reaches.assemble_reach_months(inputs_of(b), OPTIONS), "comid month", width=4)


@query(
    "winsorize",
    """SELECT comid, round(CASE WHEN cv < lo THEN lo WHEN cv > hi THEN hi ELSE cv END, 8) + 0e0 AS q_cv
       FROM (SELECT comid, q_std / q_year AS cv FROM q_ann) AS t,
            (SELECT quantile_cont(q_std / q_year, 0.001) AS lo, quantile_cont(q_std / q_year, 0.995) AS hi FROM q_ann) AS w""",
)
def winsorize(b):
    annual = ingest.annual_statistics(b.discharge, {"Qmean": "q_year", "Qstd": "q_std"})
    table = annual.withColumn("q_cv", hydraulics.coefficient_of_variation(F.col("q_std"), F.col("q_year")))
    return rounded(quantiles.winsorize(table, "q_cv", 0.001, 0.995), "comid", q_cv=8)


@query(
    "dryout_fraction",
    """SELECT comid, month, round(CASE WHEN month > 0 AND q >= 60e0 THEN 0e0 ELSE 1e0 / (1e0 + exp(11e0 + 4e0 * ln(q))) END, 7) + 0e0 AS dryout
       FROM (SELECT comid, month, q FROM q_month UNION ALL SELECT comid, 0, q_year FROM q_ann) AS t""",
)
def dryout_fraction(b):
    """Monthly dry share (zero for large rivers) and the annual one (month 0, never zeroed)."""
    monthly = ingest.monthly_statistic(b.discharge).withColumn("dryout", hydraulics.monthly_dryout(F.col("q")))
    annual = ingest.annual_statistics(b.discharge, {"Qmean": "q"}).select(
        "comid", F.lit(0).alias("month"), "q", hydraulics.dryout_fraction(F.col("q")).alias("dryout")
    )
    return rounded(monthly.unionByName(annual), "comid month", dryout=7)


@query(
    "channel_area",
    rounded_sql("comid month", "channel", {"dry": "area * dryout"}, is_channel=0, area=7, dry=7),
)
def channel_area(b):
    table = reaches.assemble_reach_months(inputs_of(b), OPTIONS)
    table = table.withColumns(
        {
            "is_channel": hydraulics.is_channel(F.col("width")),
            "area": hydraulics.surface_area(F.col("length_m"), F.col("width")),
        }
    ).withColumn("dry", F.col("area") * F.col("dryout"))
    return rounded(table, "comid month", is_channel=0, area=7, dry=7)


@query(
    "dryout_by_order",
    f"""SELECT wkbasin, month, strm_order, round({DRY_ALT}, 7) + 0e0 AS dry_alt
        FROM (SELECT DISTINCT wkbasin, month, strm_order FROM reach_month) AS r
        LEFT JOIN wk_climate USING (wkbasin, month)""",
)
def dryout_by_order(b):
    i = inputs_of(b)
    table = reaches.assemble_reach_months(i, OPTIONS).groupBy("wkbasin", "month", "strm_order").agg(F.count("*").alias("n"))
    table = table.join(i.wk_climate, ["wkbasin", "month"], "left").withColumn(
        "dry_alt", hydraulics.dryout_by_order(F.col("strm_order"), F.col("prec"), F.col("tavg"))
    )
    return rounded(table, "wkbasin month strm_order", dry_alt=7)


@query("slope_tangent", rounded_sql("site_no", "site_terrain", {"slope": "tan(slop * pi() / 180e0)"}, slope=7))
def slope_tangent(b):
    return rounded(b.site_terrain.withColumn("slope", hydraulics.slope_from_degrees(F.col("slop"))), "site_no", slope=7)


@query("working_basin_key", f"SELECT hybas_id, {qlevel('runoff')} AS qlevel, wkbasin FROM wk")
def working_basin_key(b):
    return reaches.basin_classes(inputs_of(b)).select("hybas_id", "qlevel", "wkbasin")


@query(
    "classify_runoff",
    f"""SELECT hybas_id, {qlevel('runoff')} AS qlevel,
        CASE WHEN runoff < 50 THEN 'Arid' WHEN runoff < 500 THEN 'Mod' WHEN runoff >= 500 THEN 'Wet' END AS wetness FROM basin""",
)
def classify_runoff(b):
    runoff = F.col("runoff")
    return b.basin_runoff.select(
        "hybas_id", classify.runoff_class(runoff).alias("qlevel"), classify.wetness_class(runoff).alias("wetness")
    )


@query(
    "cast_safe",
    """SELECT site_no, TRY_CAST(comid_txt AS BIGINT) AS comid, CAST(site_no AS VARCHAR) AS site_text,
              CASE WHEN TRY_CAST(comid_txt AS BIGINT) > 100 THEN 1e0 WHEN TRY_CAST(comid_txt AS BIGINT) <= 100 THEN 0e0 END AS is_large
       FROM site_reach""",
)
def cast_safe(b):
    """Text to integer with bad text as NULL, number to text, condition to number."""
    comid = F.col("comid_txt").try_cast("long")
    return b.site_reach.select(
        "site_no",
        comid.alias("comid"),
        F.col("site_no").cast("string").alias("site_text"),
        (comid > 100).cast("double").alias("is_large"),
    )
