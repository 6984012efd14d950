"""Measurement sites: training table, predictors, seasonal cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.catalog.base import query, rounded, rounded_sql
from segflux.catalog.views import LOGGED, LONG_COLUMNS, STATIC, log_inf
from segflux.functions import nulls
from segflux.operators import joins, reshape, updates
from segflux.plans import seasonality as season
from segflux.plans import training
from segflux.sources.bindings import two_parts


def site_inputs(b) -> training.SiteInputs:
    """Site tables of a binding, covariates in the two parts they are delivered in."""
    if "_sites" in b.__dict__:
        return b.__dict__["_sites"]
    names = ("order", "area", "pop", "climate", "npp", "soil_resp", "wetland", "terrain", "soil")
    parts = {name: two_parts(getattr(b, f"site_{name}")) for name in names}
    b.__dict__["_sites"] = training.SiteInputs(meas=b.site_meas, flow=b.site_flow, **parts)
    return b.__dict__["_sites"]


def clean_of(b) -> DataFrame:
    """Measurements off open water."""
    return training.clean_measurements(b.site_meas, two_parts(b.site_order))


def table_of(b):
    return training.training_table(site_inputs(b))


_TRAIN = {"co2_uatm": 4, "lnco2": 7, **{c: 6 for c in STATIC}, "tavg_00": 6, "prec_00": 6, "gpp_00": 6, "npp_00": 6, "sr_00": 6}
_TRAIN["slop"] = 8


@query("training_table", rounded_sql("row_id site_no lat mon so", "train", **_TRAIN))
def training_table(b):
    """Measurements with the covariates of their site and month, open water dropped."""
    return rounded(table_of(b), "row_id site_no lat mon so", **_TRAIN)


@query("month_select", rounded_sql("row_id mon", "train", tavg_00=6, gpp_00=6, npp_00=6))
def month_select(b):
    """Every measurement picks the covariate value of its own month, or the annual one."""
    return rounded(table_of(b), "row_id mon", tavg_00=6, gpp_00=6, npp_00=6)


@query("unit_normalize", rounded_sql("row_id mon", "train", prec_00=6, sr_00=6, wetland=6))
def unit_normalize(b):
    """Monthly amounts per day to yearly rates, fractions to percent."""
    return rounded(table_of(b), "row_id mon", prec_00=6, sr_00=6, wetland=6)


@query(
    "sentinel_recode",
    """SELECT o.site_no, CAST(CASE WHEN o.site_no % 2 <> 0 THEN so WHEN so = 0 THEN -1 WHEN so = 255 THEN 0 ELSE so END AS INT) AS so,
              nullif(i.ssand, 0e0) AS ssand, nullif(i.soc, 0e0) AS soc
       FROM site_order o LEFT JOIN site_soil i ON i.site_no = o.site_no""",
)
def sentinel_recode(b):
    order = training.stream_orders(two_parts(b.site_order))
    soil = updates.zero_to_null(b.site_soil.select("site_no", "ssand", "soc"), ["ssand", "soc"])
    return joins.lookup(order, soil, "site_no").select("site_no", "so", "ssand", "soc")


@query("row_means", rounded_sql("site_no", "site_pop", {"popdens": "(p1 + p2 + p3 + p4) / 4e0"}, popdens=6))
def row_means(b):
    return b.site_pop.select(
        "site_no", (F.round(reshape.row_mean(["p1", "p2", "p3", "p4"]), 6) + F.lit(0.0)).alias("popdens")
    )


@query(
    "log_transform",
    "SELECT row_id, "
    + ", ".join(
        f"round(CASE WHEN {log_inf(c)} = CAST('-inf' AS DOUBLE) THEN -15e0 ELSE {log_inf(c)} END, 7) + 0e0 AS {c}" for c in LOGGED
    )
    + " FROM train",
)
def log_transform(b):
    """Log-transformed predictors with ln(0) shown as -15."""
    table = training.transformed(table_of(b))
    for c in LOGGED:
        table = updates.infinite_to(table, c, training.ZERO_DENSITY)
    return rounded(table, "row_id", **{c: 7 for c in LOGGED})


_LIMITS = (
    "NOT (predictor = 'sph' AND value < 3.7e0) AND NOT (predictor = 'sdensity' AND value < 1e0) "
    "AND NOT (predictor = 'ssodicity' AND value > 5e0) AND NOT (predictor = 'sconductivity' AND value > 0.3e0)"
)


@query(
    "unpivot_predictors",
    f"""SELECT predictor, count(*) AS n, round(min(value), 7) + 0e0 AS low, round(max(value), 7) + 0e0 AS high,
               round(avg(value), 6) + 0e0 AS mean
        FROM (UNPIVOT train_log ON lnco2, {', '.join(LONG_COLUMNS)} INTO NAME predictor VALUE value) AS u
        WHERE isfinite(value) GROUP BY predictor""",
)
def unpivot_predictors(b):
    """27 predictor columns to rows, summarised per predictor."""
    long = reshape.to_long(training.transformed(table_of(b)), [], list(dims.PREDICTOR_LABELS), "predictor", "value")
    table = long.filter(nulls.is_finite("value")).groupBy("predictor").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")
    )
    return rounded(table, "predictor n", low=7, high=7, mean=6)


@query(
    "outlier_rules",
    f"""SELECT predictor, count(*) AS n, round(min(value), 7) + 0e0 AS low, round(max(value), 7) + 0e0 AS high
        FROM train_long WHERE {_LIMITS} GROUP BY predictor""",
)
def outlier_rules(b):
    long = training.predictor_values(table_of(b), keep=["lnco2"])
    table = long.groupBy("predictor").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(table, "predictor n", low=7, high=7)


@query(
    "filter_finite",
    "SELECT predictor, count(*) AS n FROM train_long GROUP BY predictor",
)
def filter_finite(b):
    long = reshape.to_long(training.transformed(table_of(b)), ["lnco2"], list(LONG_COLUMNS), "predictor", "value")
    return long.filter(nulls.is_finite("value")).groupBy("predictor").agg(F.count("*").alias("n"))


def _label_sql() -> str:
    rows = ", ".join(f"('{c}', '{label}', {i + 1})" for i, (c, label) in enumerate(dims.PREDICTOR_LABELS.items()) if c != "sph")
    return f"(VALUES {rows}) AS d(predictor, label, ord)"


@query(
    "factor_relabel",
    f"""SELECT label, ord, count(*) AS n FROM train_long LEFT JOIN {_label_sql()} USING (predictor) GROUP BY label, ord""",
)
def factor_relabel(b):
    """Display label and rank of a category; a code outside the levels becomes NULL."""
    shown = {c: label for c, label in dims.PREDICTOR_LABELS.items() if c != "sph"}
    codes = [c for c in dims.PREDICTOR_LABELS]
    levels = dims.level_dim(b.spark, codes, [dims.PREDICTOR_LABELS[c] for c in codes]).filter(F.col("code").isin(list(shown)))
    long = reshape.to_long(training.transformed(table_of(b)), ["lnco2"], list(LONG_COLUMNS), "predictor", "value")
    table = joins.relabel(long.filter(nulls.is_finite("value")), "predictor", levels, "label", "ord")
    return table.groupBy("label", "ord").agg(F.count("*").alias("n"))


@query(
    "predictor_r2",
    f"""SELECT predictor, n, round(slope, 6) + 0e0 AS slope, round(intercept, 5) + 0e0 AS intercept,
               round(1e0 - (1e0 - r2) * (n - 1) / (n - 2), 6) + 0e0 AS adj_r2
        FROM (SELECT predictor, count(*) AS n, regr_slope(lnco2, value) AS slope, regr_intercept(lnco2, value) AS intercept,
                     regr_r2(lnco2, value) AS r2
              FROM train_long WHERE {_LIMITS} AND popdens_raw < 300e0 GROUP BY predictor) AS s""",
)
def predictor_r2(b):
    """Simple regression of log concentration on each of 26 predictors."""
    table = training.predictor_fits(table_of(b))
    return rounded(table, "predictor n", slope=6, intercept=5, adj_r2=6)


@query("seasonality", rounded_sql("source lat_band month comid row_id", "cycle", co2n=7))
def seasonality(b):
    """Observed and modelled concentration over the segment mean, by climate band and month."""
    table = season.seasonality(clean_of(b), b.site_reach, b.reach_pco2_wide)
    return rounded(table, "source lat_band month comid row_id", co2n=7)


@query("normalize_by_group", rounded_sql("row_id comid month", "cycle_observed", co2n=7))
def normalize_by_group(b):
    """Measurement over its segment mean, which includes annual values."""
    table = season.observed_cycle(season.located_measurements(clean_of(b), b.site_reach))
    return rounded(table, "row_id comid month", co2n=7)


@query("month_calibration", rounded_sql("comid month lat_band", "cycle_modelled", co2n=7))
def month_calibration(b):
    located = season.located_measurements(clean_of(b), b.site_reach)
    return rounded(season.modelled_cycle(located, b.reach_pco2_wide), "comid month lat_band", co2n=7)


@query("mean_lat_by_reach", "SELECT comid, round(avg(lat), 7) + 0e0 AS lat FROM cycle_located WHERE mon <> 'Ann' GROUP BY comid")
def mean_lat_by_reach(b):
    located = season.located_measurements(clean_of(b), b.site_reach).filter(F.col("mon") != dims.ANNUAL)
    return rounded(located.groupBy("comid").agg(F.avg("lat").alias("lat")), "comid", lat=7)


@query("month_recode", "SELECT comid, month, mon, pco2 FROM reach_pco2 JOIN months USING (month)")
def month_recode(b):
    """Month code of a wide column name to number and label."""
    long = reshape.months_to_long(b.reach_pco2_wide, ["comid"], "co2_", "pco2")
    return long.select("comid", "month", dims.month_label(F.col("month")).alias("mon"), "pco2")


@query("unpivot_months", "SELECT comid, month, pco2 FROM reach_pco2")
def unpivot_months(b):
    return reshape.months_to_long(b.reach_pco2_wide, ["comid"], "co2_", "pco2")
