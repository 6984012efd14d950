"""Training table of the concentration models, predictor statistics and model rounds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import gas, hydraulics, nulls
from segflux.operators import distribution, quantiles, regression, reshape, updates
from segflux.operators.joins import in_table, lookup, monthly, require_unique_keys
from segflux.sources import sink
from segflux.sources.ingest import union_parts

# --- fixed values -----------------------------------------------------------------------
OPEN_WATER = -1
ORDER_CODES = {0: OPEN_WATER, 255: 0}
SOIL_COLUMNS = (
    "sgravel", "ssand", "ssilt", "sclay", "sdensity", "soc", "sph", "scec", "sbs", "steb",
    "scaco3", "scaso4", "ssodicity", "sconductivity",
)
MONTHLY = {
    "tavg_00": ("tavg", "tavg_ann"),
    "prec_00": ("prec", "prec_ann"),
    "gpp_00": ("gpp", "gpp"),
    "npp_00": ("npp", "npp"),
    "sr_00": ("sr", "sr_ann"),
}
SCALES = {"prec_00": [365.0 / d for d in dims.MONTH_DAYS], "sr_00": [365.0] * 12}
ZERO_DENSITY = -15.0
# ----------------------------------------------------------------------------------------


@dataclass
class SiteInputs:
    """Measurement and covariate tables.  Covariates come in one or more parts."""

    meas: DataFrame
    order: Sequence[DataFrame]
    area: Sequence[DataFrame]
    pop: Sequence[DataFrame]
    climate: Sequence[DataFrame]
    npp: Sequence[DataFrame]
    soil_resp: Sequence[DataFrame]
    wetland: Sequence[DataFrame]
    terrain: Sequence[DataFrame]
    soil: Sequence[DataFrame]
    flow: DataFrame


def stream_orders(parts: Sequence[DataFrame]) -> DataFrame:
    """Stream order of every site.  Only the first part comes with the codes that stand for others."""
    first, *others = parts
    recoded = first.withColumn("so", updates.recode(F.col("so"), ORDER_CODES))
    return union_parts([recoded, *others])


def clean_measurements(meas: DataFrame, order: Sequence[DataFrame]) -> DataFrame:
    """Measurements at sites that are no open water."""
    return in_table(meas, stream_orders(order).filter(F.col("so") != OPEN_WATER), "site_no")


def site_covariates(inputs: SiteInputs, check_keys: bool = True) -> DataFrame:
    """All covariates at site grain.  Eleven lookups meet here, before any measurement row does."""
    order = stream_orders(inputs.order)
    pop = union_parts(inputs.pop).select(
        "site_no", reshape.row_mean(["p1", "p2", "p3", "p4"]).alias("popdens")
    )
    wetland = union_parts(inputs.wetland).withColumn("wetland", F.col("wetland") * 100.0)
    terrain = union_parts(inputs.terrain).withColumn("slop", hydraulics.slope_from_degrees(F.col("slop")))
    soil = updates.zero_to_null(union_parts(inputs.soil), SOIL_COLUMNS)
    velocity = hydraulics.flow_velocity(F.col("ann_q"))
    flow = inputs.flow.select("site_no", gas.k600_low_energy(F.col("slope"), velocity).alias("k"))

    others = (
        union_parts(inputs.area), pop, union_parts(inputs.climate), union_parts(inputs.npp),
        union_parts(inputs.soil_resp), wetland, terrain, soil, flow,
    )
    if check_keys and not inputs.__dict__.get("_verified"):
        require_unique_keys([(t, ["site_no"]) for t in (order, *others)])
        inputs.__dict__["_verified"] = True  # once per set of inputs
    table = order.filter(F.col("so") != OPEN_WATER)
    for other in others:
        table = lookup(table, other, "site_no")
    return table


STATIC = (
    "so", "area", "popdens", "tavg_ann", "prec_ann", "gpp", "npp", "ar_ann", "hr_ann", "wetland", "elev", "slop",
    *SOIL_COLUMNS, "k",
)


def training_table(inputs: SiteInputs, check_keys: bool = True) -> DataFrame:
    """Measurements with the covariates of their site and month; open water is dropped.

    A measurement whose month label is missing or unknown keeps the covariates of its site and has
    no monthly ones.

    One join on (site, month label: twelve months or ``Ann``).  The covariate table is written
    first, so its size decides between broadcast and shuffle; a site with very many measurements
    is spread over its months, and adaptive execution splits what is still large.
    """
    covariates = site_covariates(inputs, check_keys)
    monthly = reshape.own_month_table(covariates, ["site_no", *STATIC], MONTHLY, SCALES)
    monthly = sink.materialize(monthly, "site-months")
    meas = inputs.meas.withColumn("lnco2", nulls.log_or_inf("co2_uatm"))
    known = F.col("mon").isin(*dims.MONTHS, dims.ANNUAL)
    meas = meas.withColumn("__label", F.when(known, F.col("mon")).otherwise(reshape.NO_MONTH))
    return meas.join(monthly.withColumnRenamed("mon", "__label"), ["site_no", "__label"]).drop("__label")


def transformed(table: DataFrame) -> DataFrame:
    """Log-transformed predictors (ln 0 kept as -Infinity)."""
    return updates.log_columns(table, [c for c in dims.LOGGED_COLUMNS if c in table.columns])


def regression_rows(table: DataFrame) -> DataFrame:
    """Transformed table with the population density of empty places set to a finite value."""
    return updates.infinite_to(transformed(table), "popdens", ZERO_DENSITY)


PREDICTORS = tuple(p for p in dims.PREDICTOR_LABELS if p != "lnco2")


def predictor_values(table: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long (predictor, value) table; missing and infinite values and outliers dropped."""
    columns = [c for c in dims.PREDICTOR_LABELS if c not in keep]
    long = reshape.to_long(transformed(table), list(keep), columns, "predictor", "value")
    return long.filter(
        nulls.is_finite("value")
        & updates.within_limits(F.col("predictor"), F.col("value"), dims.OUTLIER_LIMITS)
    )


def histogram_values(table: DataFrame, low_quantile: float = 0.01) -> DataFrame:
    """Long table for histograms: acidity is cut at a quantile instead of a fixed limit."""
    # Read again by the quantile search and by whatever is computed on the result.
    rows = sink.materialize(transformed(table).select(*dims.PREDICTOR_LABELS), "predictors")
    floor = quantiles.exact_quantiles(rows, "sph", [low_quantile])[low_quantile]
    limits = dict(dims.OUTLIER_LIMITS, sph=(floor, None))
    long = reshape.to_long(rows, [], list(dims.PREDICTOR_LABELS), "predictor", "value")
    return long.filter(
        F.col("value").isNotNull() & updates.within_limits(F.col("predictor"), F.col("value"), limits)
    )


def predictor_histograms(table: DataFrame, bins: int = 50, low_quantile: float = 0.01) -> DataFrame:
    """Histogram of every predictor and the response; limits as in ``histogram_values``."""
    rows = sink.materialize(transformed(table).select(*dims.PREDICTOR_LABELS), "predictors")
    floor = quantiles.exact_quantiles(rows, "sph", [low_quantile])[low_quantile]
    limits = dict(dims.OUTLIER_LIMITS, sph=(floor, None))
    wanted = {}
    for c in dims.PREDICTOR_LABELS:
        low, high = limits.get(c, (None, None))
        where = [F.col(c) >= F.lit(low)] * (low is not None) + [F.col(c) <= F.lit(high)] * (high is not None)
        wanted[c] = where[0] if len(where) == 1 else where[0] & where[1] if where else None
    return distribution.histogram_columns(rows, wanted, bins, "predictor")


def predictor_fits(table: DataFrame, max_density: float = 300.0) -> DataFrame:
    """Simple regression of log concentration on every predictor, sparsely populated sites only."""
    sparse = table.filter(F.col("popdens") < max_density)
    long = predictor_values(sparse, keep=["lnco2"])
    fits = regression.simple_fits(long, ["predictor"], "lnco2", "value")
    return fits.withColumn("r2_label", F.round("adj_r2", 2))


def stepwise_rounds(table: DataFrame, rounds: Sequence[Sequence[str]] = dims.STEPWISE_ROUNDS, direction: str = "both"):
    """The four model rounds.  Each round has its own complete rows, hence its own moments."""
    rows = regression_rows(table)
    out = []
    for predictors in rounds:
        m = regression.factor(rows, "lnco2", predictors)
        model, steps = regression.stepwise(m, predictors, direction=direction)
        out.append((model, regression.inflation_factors(m, model.predictors), steps))
    return out


def reach_features(
    reach: DataFrame,
    uparea: DataFrame,
    air_temp: DataFrame,
    climate: DataFrame,
    npp: DataFrame,
    soil_resp: DataFrame,
    static: DataFrame,
) -> DataFrame:
    """The forest's 15 predictors for every segment and month, scaled and logged like the training rows.

    ``reach`` has ``comid``, ``hybas_id`` and ``slope``; ``uparea`` and ``air_temp`` are by segment, the
    other tables by basin.  Basin tables meet at basin grain before they meet the segments.
    """
    days = F.element_at(F.array(*[F.lit(365.0 / d) for d in dims.MONTH_DAYS]), F.col("month"))
    npp = npp.select("hybas_id", "month", F.col("gpp").alias("gpp_00"), F.col("npp").alias("npp_00"))
    soil_resp = soil_resp.select("hybas_id", "month", (F.col("prs") * 365.0).alias("sr_00"))
    basin = climate.select("hybas_id", "month", (F.col("prec") * days).alias("prec_00"))
    for table in (npp, soil_resp):
        basin = lookup(basin, monthly(table), ["hybas_id", "month"])
    basin = sink.materialize(lookup(basin, static, "hybas_id"), "basin-features")
    placed = lookup(reach.select("comid", "hybas_id", F.col("slope").alias("slop")), uparea.withColumnRenamed("uparea", "area"), "comid")
    months = lookup(placed, monthly(air_temp.select("comid", "month", F.col("ta").alias("tavg_00"))), "comid")
    return regression_rows(lookup(months, monthly(basin), ["hybas_id", "month"]))
