"""Aggregation of the segment network: cells, stream orders, extrapolation below the smallest order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflux.functions import gas, hydraulics, nulls

# --- fixed values -----------------------------------------------------------------------
# Stream orders 1..n all present -> number of orders used in the fits.
FIT_DEPTHS = ((5, 4), (4, 3), (3, 2))
SHALLOW_DEPTH = 2
COEFFICIENT_DIGITS = 5
# ----------------------------------------------------------------------------------------

CELL_KEYS = ("hybas_id", "wkbasin", "month", "strm_order")


def network_cells(reach_month: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Additive sums per group of segments and month.  Every later total is a roll-up of these.

    Needs ``length_m, width, dryout, k, co2, pco2``; when ``width_obs`` and ``keep`` are present
    too, the sums of the observed network (prefix ``obs_``) are built in the same pass.
    """
    # The products are columns of their own, so every aggregate below reads a plain value.
    observed = {"width_obs", "keep"} <= set(reach_month.columns)
    terms = _wet_terms(F.col("width"), "")
    weights = {
        "length_km": F.col("length_m") * F.col("__flag") / 1000.0,
        "width_sum": F.col("width") * F.col("__flag"),
        "area_km2": F.col("__area"),
        "dry_km2": F.col("__dry"),
    }
    wet = {c: F.col(c) * (F.col("__area") - F.col("__dry")) for c in ("k", "co2", "pco2")}
    rows = reach_month.withColumns(terms[0]).withColumns(terms[1])
    aggs = [F.count("*").alias("n")]
    aggs += [nulls.strict_sum(e).alias(c) for c, e in weights.items()]
    aggs += [nulls.loose_sum(e).alias(f"{c}_area") for c, e in wet.items()]
    if observed:
        keep = F.col("keep")
        seen = _wet_terms(F.when(keep, F.col("width_obs")), "obs_")
        rows = rows.withColumns(seen[0]).withColumns(seen[1])
        eff = F.col("__obs_area") - F.col("__obs_dry")
        flux = gas.areal_flux(F.col("co2"), F.col("k"))
        rows = rows.withColumns(
            {
                "obs_area": F.col("__obs_area"),
                "obs_dry": F.col("__obs_dry"),
                "obs_eff": eff,
                "obs_pco2_eff": F.col("pco2") * eff,
                "obs_k_eff": F.col("k") * eff,
                "obs_flux_eff": flux * eff,
            }
        )
        aggs.append(F.count_if(keep).alias("obs_n"))
        aggs += [nulls.strict_sum_where(F.col(c), keep).alias(c) for c in OBSERVED_SUMS]
    return rows.groupBy(*keys).agg(*aggs)


def _wet_terms(width: Column, prefix: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Channel flag, surface and dry area, in two steps because the second uses the first."""
    flag, area, dry = f"__{prefix}flag", f"__{prefix}area", f"__{prefix}dry"
    surface = F.col("length_m") * width * F.col(flag) / hydraulics.M2_PER_KM2
    return (
        {flag: hydraulics.is_channel(width)},
        {area: surface, dry: surface * F.col("dryout")},
    )


OBSERVED_SUMS = ("obs_area", "obs_dry", "obs_eff", "obs_pco2_eff", "obs_k_eff", "obs_flux_eff")
MODEL_SUMS = ("length_km", "width_sum", "area_km2", "dry_km2", "k_area", "co2_area", "pco2_area")


def roll_up(cells: DataFrame, keys: Sequence[str], sums: Sequence[str], counts: Sequence[str] = ("n",)) -> DataFrame:
    """Coarser cells: strict sums of the finer ones."""
    return cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts], *[nulls.strict_sum(c).alias(c) for c in sums]
    )


def stream_order_summary(
    cells: DataFrame, wk_climate: DataFrame, basin: str = "wkbasin", month: str = "month", order: str = "strm_order"
) -> DataFrame:
    """Stream-order table per working basin and month.

    Mean width counts sub-channel segments as zero.  Concentration and exchange are weighted by
    wet area but divided by total area.  The alternative dry ratio depends on order and climate
    only, so it is a factor of the group, not of its segments.
    """
    table = roll_up(cells, [basin, month, order], MODEL_SUMS).join(
        wk_climate.select(basin, month, "tavg", "prec"), [basin, month], "left"
    )
    area = F.col("area_km2")
    alt = hydraulics.dryout_by_order(F.col(order), F.col("prec"), F.col("tavg"))
    return table.select(
        basin,
        month,
        order,
        "n",
        "length_km",
        (F.col("width_sum") / F.col("n")).alias("width_m"),
        "area_km2",
        "dry_km2",
        nulls.ratio("dry_km2", area).alias("dry_ratio"),
        (alt * area).alias("dry_alt_km2"),
        F.when(area != 0, alt).alias("dry_alt_ratio"),
        nulls.ratio("k_area", area).alias("k"),
        nulls.ratio("co2_area", area).alias("co2"),
        nulls.ratio("pco2_area", area).alias("pco2"),
    )


def fit_depth(cells: DataFrame, basin: str = "wkbasin", order: str = "strm_order") -> DataFrame:
    """How many contiguous orders from 1 up a basin offers to the fits."""
    deepest = FIT_DEPTHS[0][0]
    present = cells.groupBy(basin).agg(
        *[F.max(F.when(F.col(order) == i, 1).otherwise(0)).alias(f"o{i}") for i in range(1, deepest + 1)]
    )
    depth = None
    for top, orders in FIT_DEPTHS:
        complete = sum((F.col(f"o{i}") for i in range(2, top + 1)), F.col("o1")) == top
        depth = F.when(complete, orders) if depth is None else depth.when(complete, orders)
    return present.select(basin, depth.otherwise(SHALLOW_DEPTH).cast("int").alias("depth"))


def ranked_orders(summary: DataFrame, depth: DataFrame, keys: Sequence[str] = ("wkbasin", "month"), order: str = "strm_order") -> DataFrame:
    """Number the orders of every group.  A group holds one row per stream order, a dozen at most."""
    window = Window.partitionBy(*keys).orderBy(order)
    return summary.join(depth, keys[0], "left").withColumn("rn", F.row_number().over(window))


def first_orders(summary: DataFrame, depth: DataFrame, keys: Sequence[str] = ("wkbasin", "month"), order: str = "strm_order") -> DataFrame:
    """The first ``depth`` orders of every group."""
    return ranked_orders(summary, depth, keys, order).filter(F.col("rn") <= F.col("depth"))


def deepest_dry_order(order: Column, depth: Column, dry_ratio: Column, window=None) -> Column:
    """Largest order within the depth that dries out at all, 0 when none does.

    An aggregate, or with ``window`` the same value on every row of the group.
    """
    deepest = F.max(F.when((order <= depth) & (dry_ratio != 0), order))
    return F.coalesce(deepest if window is None else deepest.over(window), F.lit(0))


def ols(y: Column, x: Column, keep: Column, name: str) -> list[Column]:
    """Aggregates of a simple regression over the rows in ``keep``.

    A constant response has no r-squared; fewer than two points have no slope.
    """
    masked = F.when(keep, y)
    enough = F.regr_count(masked, x) >= 2
    return [
        F.when(enough, F.regr_slope(masked, x)).alias(f"slope_{name}"),
        F.when(enough, F.regr_intercept(masked, x)).alias(f"icept_{name}"),
        F.when(enough & (F.regr_syy(masked, x) != 0), F.regr_r2(masked, x)).alias(f"r2_{name}"),
    ]


def fit_orders(summary: DataFrame, depth: DataFrame, keys: Sequence[str] = ("wkbasin", "month"), order: str = "strm_order") -> DataFrame:
    """All scaling fits of a group in two small aggregates over the stream-order table."""
    keys = list(keys)
    ranked = ranked_orders(summary, depth, keys, order)
    x = F.col(order).cast("double")
    used = F.col("rn") <= F.col("depth")
    first = F.col(order) == 1
    with_dry = ranked.withColumn(
        "dry_depth",
        deepest_dry_order(F.col(order), F.col("depth"), F.col("dry_ratio"), Window.partitionBy(*keys)),
    )
    dry_used = (F.col("rn") <= F.col("dry_depth")) & (F.col("dry_depth") >= 2)
    alt = F.when(dry_used, F.col("dry_alt_ratio"))
    return with_dry.groupBy(*keys).agg(
        F.max("depth").alias("depth"),
        F.max("dry_depth").alias("dry_depth"),
        *ols(nulls.log_positive("width_m"), x, used, "width"),
        *ols(nulls.log_positive("length_km"), x, used, "length"),
        *ols(F.col("k"), x, used, "k"),
        *ols(F.col("dry_ratio"), x, dry_used, "dry"),
        *ols(F.col("dry_alt_ratio"), x, dry_used, "dry_alt"),
        F.max(F.abs(alt)).alias("max_dry_alt"),
        F.avg("k").alias("mean_k"),
        F.max(F.when(first, F.col("co2"))).alias("co2"),
        F.max(F.when(first, F.col("pco2"))).alias("pco2"),
        nulls.strict_sum("dry_km2").alias("dry_1"),
        nulls.strict_sum("dry_alt_km2").alias("dry_alt_1"),
    )


def end_order(fits: DataFrame) -> DataFrame:
    """Order at which the fitted width reaches the channel limit (coefficients rounded)."""
    slope = F.round("slope_width", COEFFICIENT_DIGITS)
    icept = F.round("icept_width", COEFFICIENT_DIGITS)
    return fits.withColumn("end_order", nulls.ratio(F.log(F.lit(hydraulics.MIN_WIDTH)) - icept, slope))


def extrapolated_orders(fits: DataFrame, output: str = "order") -> DataFrame:
    """One row per order 0, ±1, ... up to the end order, and one for the end order itself.

    Groups without an end order keep a single row with a NULL order.
    """
    last = F.ceil("end_order").cast("int")
    whole = F.transform(F.sequence(F.lit(0), last), lambda i: i.cast("double"))
    orders = F.concat(whole, F.array(F.col("end_order")))
    return fits.withColumn(output, F.explode_outer(orders))


def predict_orders(rows: DataFrame, order: str = "order") -> DataFrame:
    """Width, length, exchange, dry ratios and areas of every extrapolated order."""
    o = F.col(order)

    def line(name: str) -> Column:
        return F.col(f"icept_{name}") + F.col(f"slope_{name}") * o

    fitted = F.col("dry_depth") >= 2
    predicted = rows.withColumns(
        {
            "width_m": F.exp(line("width")),
            "length_km": F.exp(line("length")),
            "k": F.when(F.col("slope_k") > 0, F.col("mean_k")).otherwise(line("k")),
            "ratio": F.when(fitted, line("dry")).otherwise(F.lit(0.0)),
            "ratio_alt": F.when(fitted & (F.col("max_dry_alt") != 0), line("dry_alt")).otherwise(F.lit(0.0)),
        }
    )
    area = F.col("area_km2")
    return (
        predicted.withColumn("area_km2", F.col("width_m") * F.col("length_km") / 1000.0)
        .withColumn("dry_km2", nulls.at_most(area * F.col("ratio"), area))
        .withColumn("dry_alt_km2", nulls.at_most(area * F.col("ratio_alt"), area))
        .withColumn("eff_km2", area - F.col("dry_km2"))
        .withColumn("flux", gas.areal_flux(F.col("co2"), F.col("k")))
        .withColumn("emission", gas.emission(F.col("co2"), F.col("k"), F.col("eff_km2")))
    )


GROUP_COLUMNS = ("end_order", "r2_width", "r2_length", "r2_dry", "r2_dry_alt", "r2_k", "dry_1", "dry_alt_1", "co2", "pco2")


def total_orders(predicted: DataFrame, keys: Sequence[str] = ("wkbasin", "month")) -> DataFrame:
    """Totals of the extrapolated network per group; means are weighted by wet area."""
    eff = F.col("eff_km2")

    def weighted(x: str) -> Column:
        any_wet = F.max(F.when(eff != 0, 1).otherwise(0)) == 1
        mean = nulls.ratio(nulls.strict_sum(F.col(x) * eff), nulls.strict_sum(eff))
        return F.when(any_wet, mean).when(F.count_if(eff.isNull()) == 0, F.lit(0.0))

    return predicted.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in GROUP_COLUMNS],
        nulls.strict_sum("length_km").alias("length_2"),
        nulls.strict_sum("area_km2").alias("area_2"),
        nulls.strict_sum("dry_km2").alias("dry_2"),
        nulls.strict_sum("dry_alt_km2").alias("dry_alt_2"),
        nulls.strict_sum("eff_km2").alias("eff_2"),
        weighted("k").alias("k_2"),
        weighted("flux").alias("flux_2"),
        nulls.strict_sum("emission").alias("emission_2"),
    ).withColumnsRenamed({"co2": "co2_2", "pco2": "pco2_2"})


def extrapolate(summary: DataFrame, depth: DataFrame) -> DataFrame:
    """Small streams below the mapped network, per working basin and month."""
    fits = end_order(fit_orders(summary, depth))
    return total_orders(predict_orders(extrapolated_orders(fits)))
