"""Seasonal cycle of concentration: observations against modelled segments, by climate band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import classify
from segflux.operators import groups, reshape, updates
from segflux.operators.joins import in_table, keep_matched
from segflux.sources import sink


def located_measurements(meas: DataFrame, site_reach: DataFrame) -> DataFrame:
    """Measurements at sites with a usable segment key."""
    link = site_reach.select("site_no", F.col("comid_txt").try_cast("long").alias("comid"))
    columns = meas.select("row_id", "site_no", "lat", "mon", F.col("co2_uatm").alias("pco2"))
    return keep_matched(columns, link, "site_no", "comid")


def observed_cycle(located: DataFrame) -> DataFrame:
    """Observations over their segment mean.  Annual values count in the mean, then are dropped."""
    table = located.withColumn("lat_band", classify.climate_band(F.col("lat"), dims.BANDS_SHORT))
    table = groups.normalize_by_group(table, ["comid"], "pco2", "co2n")
    month = dims.month_number(F.col("mon"))
    return table.withColumn("month", month).filter(F.col("month").isNotNull()).select(
        "comid", "month", "lat_band", "co2n", "row_id"
    )


def modelled_cycle(located: DataFrame, modelled_wide: DataFrame) -> DataFrame:
    """Modelled months of the measured segments over their mean, calibrated in the south."""
    months = dims.month_number(F.col("mon")).isNotNull()
    place = located.filter(months).groupBy("comid").agg(F.avg("lat").alias("lat"))
    long = reshape.months_to_long(in_table(modelled_wide, place, "comid"), ["comid"], "co2_", "pco2")
    table = long.join(place, "comid", "left").withColumn(
        "lat_band", classify.climate_band(F.col("lat"), dims.BANDS_SHORT)
    )
    table = groups.normalize_by_group(table, ["comid"], "pco2", "co2n")
    scaled = updates.scale_by_month(
        F.col("co2n"), F.col("lat_band"), F.col("month"), dims.BANDS_SHORT[3], dims.SOUTH_CALIBRATION
    )
    return table.select("comid", "month", "lat_band", scaled.alias("co2n"))


def seasonality(meas: DataFrame, site_reach: DataFrame, modelled_wide: DataFrame) -> DataFrame:
    """Both cycles in one long table with their source."""
    # Read by the observed cycle, its means and the places of the modelled one.
    located = sink.materialize(located_measurements(meas, site_reach), "located")
    observed = observed_cycle(located).withColumn("source", F.lit("observed"))
    modelled = modelled_cycle(located, modelled_wide).withColumns(
        {"source": F.lit("modelled"), "row_id": F.lit(None).cast("long")}
    )
    return observed.unionByName(modelled)


def cycle_summary(cycle: DataFrame) -> DataFrame:
    return cycle.groupBy("source", "lat_band", "month").agg(
        F.count("*").alias("n"), F.avg("co2n").alias("co2n")
    )

