"""Basin plans: attributes, observed network, extrapolated network, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import classify, nulls
from segflux.operators import groups, network
from segflux.operators.joins import lookup, monthly
from segflux.plans import reaches
from segflux.plans.inputs import NetworkInputs, NetworkOptions, check
from segflux.sources import sink

METRICS = ("area", "dry", "ice_area", "eff", "emission", "pco2", "k", "flux")


def basin_cells(inputs: NetworkInputs, options: NetworkOptions | None = None, kept: bool = True) -> DataFrame:
    """The segment-month table reduced once to basin x month x stream order, and kept.

    Fit depth, stream-order table, basin list and observed totals are all roll-ups of it, so the
    large table is read a single time.  Whoever takes a single roll-up need not have it ``kept``.

    Segments are dealt out by basin before they become twelve rows each, so cells need no shuffle of their own.
    """
    check(inputs, options or NetworkOptions(), "wk_climate", "basin_centroid", "basin_area", "basin_annual", "basin_npp",
          "basin_soil_resp", "basin_ice")
    cells = network.network_cells(reaches.observed_reach_months(inputs, options, place="hybas_id"))
    return sink.materialize(cells, "basin-cells") if kept else cells


def order_table(cells: DataFrame, inputs: NetworkInputs) -> DataFrame:
    return network.stream_order_summary(cells, inputs.wk_climate)


def extrapolated(cells: DataFrame, inputs: NetworkInputs) -> DataFrame:
    return network.extrapolate(order_table(cells, inputs), network.fit_depth(cells))


def basin_list(cells: DataFrame) -> DataFrame:
    """Basins with kept segments and their working basin, written as the shares read it twice."""
    kept = cells.filter(F.col("obs_n") > 0)
    return sink.materialize(kept.groupBy("hybas_id").agg(F.min("wkbasin").alias("wkbasin")), "basin-list")


def basin_shares(basins: DataFrame, inputs: NetworkInputs) -> DataFrame:
    """Basin area and its share of the working basin."""
    with_area = lookup(basins, inputs.basin_area, "hybas_id")
    return groups.share_of_group(with_area, ["wkbasin"], "basin_area", "area_ratio", "wkbasin_area")


def basin_attributes(cells: DataFrame, inputs: NetworkInputs) -> DataFrame:
    """Attribute table: location, zone, area and share, climate, wetness, productivity, respiration.

    Productivity comes as the mean of the year and for all twelve months.
    """
    table = basin_shares(basin_list(cells), inputs)
    table = lookup(table, inputs.basin_centroid, "hybas_id")
    table = table.withColumn("climzone", classify.climate_band(F.col("lat"), dims.BANDS_LONG))
    table = lookup(table, inputs.basin_annual, "hybas_id")
    table = lookup(table, inputs.basin_runoff, "hybas_id")
    table = table.withColumn("wetness", classify.wetness_class(F.col("runoff")))
    npp = inputs.basin_npp.groupBy("hybas_id").agg(F.avg("gpp").alias("gpp"), F.avg("npp").alias("npp"))
    table = lookup(table, npp, "hybas_id")
    table = lookup(table, sink.wide_months(inputs.basin_npp, ["hybas_id"], ["gpp", "npp"]), "hybas_id")
    respiration = sink.wide_months(
        inputs.basin_soil_resp.withColumn("prs", F.col("prs") * 365.0), ["hybas_id"], ["prs"]
    )
    return lookup(table, respiration, "hybas_id")


def with_ice(df: DataFrame, ice: DataFrame) -> DataFrame:
    """Split wet area into ice-covered and open, and reduce the emission by the covered share."""
    cover = F.col("ice")
    joined = df.join(monthly(ice), ["hybas_id", "month"], "left")
    return (
        joined.withColumn("ice_area", F.col("eff") * cover)
        .withColumn("eff", F.col("eff") - F.col("ice_area"))
        .withColumn("emission", F.col("emission") * (1.0 - cover))
        .drop("ice")
    )


def observed_totals(cells: DataFrame) -> DataFrame:
    """Observed network per basin and month before the ice correction, in one aggregate."""
    kept = cells.filter(F.col("obs_n") > 0)
    sums = network.roll_up(kept, ["hybas_id", "month"], network.OBSERVED_SUMS, ["obs_n"])
    eff = F.col("obs_eff")
    return sums.select(
        "hybas_id",
        "month",
        F.col("obs_area").alias("area"),
        F.col("obs_dry").alias("dry"),
        eff.alias("eff"),
        nulls.ratio("obs_pco2_eff", eff).alias("pco2"),
        nulls.ratio("obs_k_eff", eff).alias("k"),
        nulls.ratio("obs_flux_eff", eff).alias("flux"),
        (F.col("obs_flux_eff") / 1000.0).alias("emission"),
    )


def observed_part(cells: DataFrame, inputs: NetworkInputs) -> DataFrame:
    """Observed network with ice: weighted means keep their ice-free weights."""
    return with_ice(observed_totals(cells), inputs.basin_ice)


def extrapolated_part(basins: DataFrame, orders: DataFrame, inputs: NetworkInputs) -> DataFrame:
    """Extrapolated totals handed down to basins by area share; means are handed down unchanged."""
    share = F.col("area_ratio")
    parts = basin_shares(basins, inputs).join(orders, "wkbasin", "left")
    scaled = parts.select(
        "hybas_id",
        "month",
        (share * F.col("area_2")).alias("area"),
        (share * F.col("dry_2")).alias("dry"),
        (share * F.col("eff_2")).alias("eff"),
        F.col("pco2_2").alias("pco2"),
        F.col("k_2").alias("k"),
        F.col("flux_2").alias("flux"),
        (share * F.col("emission_2")).alias("emission"),
    )
    return with_ice(scaled, inputs.basin_ice)


def weighted_pair(value: str, weight: str = "eff") -> Column:
    """Mean of two parts weighted by wet area; a part without weight is absent."""
    total = F.col(f"{weight}_1") + F.col(f"{weight}_2")
    pulled = [
        F.when(F.col(f"{weight}_{i}") == 0, F.lit(0.0)).otherwise(F.col(f"{weight}_{i}") * F.col(f"{value}_{i}"))
        for i in (1, 2)
    ]
    return F.when(total == 0, F.lit(0.0)).otherwise(nulls.ratio(pulled[0] + pulled[1], total))


def combine_parts(part1: DataFrame, part2: DataFrame) -> DataFrame:
    """Observed plus extrapolated: areas and emission add, means are weighted by wet area."""
    keys = ["hybas_id", "month"]
    left = part1.withColumnsRenamed({m: f"{m}_1" for m in METRICS})
    right = part2.withColumnsRenamed({m: f"{m}_2" for m in METRICS})
    both = left.join(right, keys, "left")
    sums = [(F.col(f"{m}_1") + F.col(f"{m}_2")).alias(m) for m in ("area", "dry", "ice_area", "eff", "emission")]
    means = [weighted_pair(m).alias(m) for m in ("pco2", "k", "flux")]
    return both.select(*keys, *sums, *means)


def basin_emission(inputs: NetworkInputs, options: NetworkOptions | None = None) -> DataFrame:
    """Monthly area, exchange, flux and emission of every basin (long layout)."""
    cells = basin_cells(inputs, options)
    part1 = observed_part(cells, inputs)
    part2 = extrapolated_part(basin_list(cells), extrapolated(cells, inputs), inputs)
    return combine_parts(part1, part2)


def basin_emission_wide(inputs: NetworkInputs, options: NetworkOptions | None = None) -> DataFrame:
    """One row per basin: attributes and 8 metrics x 12 months."""
    cells = basin_cells(inputs, options)
    part1 = observed_part(cells, inputs)
    part2 = extrapolated_part(basin_list(cells), extrapolated(cells, inputs), inputs)
    wide = sink.wide_months(combine_parts(part1, part2), ["hybas_id"], METRICS)
    return lookup(basin_attributes(cells, inputs), wide, "hybas_id")


def write_emission(df: DataFrame, path: str, fmt: str = "csv") -> None:
    sink.write_table(df, path, fmt)


