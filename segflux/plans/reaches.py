"""Segment plans: gas transfer velocity, and the full segment-month table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import classify, gas, hydraulics, nulls
from segflux.operators import quantiles, updates
from segflux.operators.joins import lookup, monthly
from segflux.plans.inputs import NetworkInputs, NetworkOptions, check
from segflux.session import MOST_BYTES, estimated_bytes, shuffle_partitions_for
from segflux.sources import ingest, sink

APRIL = 4
PLACED_BYTES = 8 << 20
"""Written segments that a task expands to months when they are dealt out by basin."""


def transfer_velocity(slope: Column, q: Column, air_temperature: Column, min_slope: float | None = None) -> Column:
    """Gas transfer velocity straight from the raw inputs of one segment and month."""
    if min_slope is not None:
        slope = nulls.at_least(slope, F.lit(min_slope))
    water = gas.water_temperature(air_temperature)
    return gas.gas_transfer_velocity(slope, hydraulics.flow_velocity(q), gas.schmidt_number(water))


def gas_transfer_by_reach(inputs: NetworkInputs, options: NetworkOptions | None = None) -> DataFrame:
    """Gas transfer velocity per segment and month (long; pivot with ``sink.wide_months``)."""
    options = options or NetworkOptions()
    check(inputs, options, "discharge", "air_temp")
    flow = ingest.discharge_by_segment(inputs.discharge, {})
    return (
        by_month(inputs.reach.select("region", "comid", "slope").join(monthly(flow), "comid", "left"))
        .join(monthly(inputs.air_temp), ["comid", "month"], "left")
        .select(
            "region",
            "comid",
            "month",
            transfer_velocity(F.col("slope"), F.col("q"), F.col("ta"), options.min_slope).alias("k"),
        )
    )


def by_month(reach: DataFrame, *more: str) -> DataFrame:
    """Every segment in every month, with the month's discharge ``q`` or NULL instead of ``q_months``; ``more`` alike."""
    names = ("q", *more)
    rows = reach.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    rows = rows.withColumns({n: F.element_at(f"{n}_months", F.col("month")) for n in names})
    return rows.drop(*[f"{n}_months" for n in names])


def _packed(inputs: NetworkInputs, options: NetworkOptions) -> bool:
    """Whether the monthly tables can join as one row a segment: no month may repeat, and k must come from them."""
    return options.check_keys and inputs.reach_k is None


def _with_months(reach: DataFrame, inputs: NetworkInputs) -> DataFrame:
    """Add ``ta_months`` and ``pco2_months``: the joins move, sort and spill one row a segment instead of twelve."""
    for table, value in ((inputs.air_temp, "ta"), (inputs.reach_pco2, "pco2")):
        reach = lookup(reach, monthly(ingest.months_by_segment(table, value)), "comid")
    return reach


def basin_classes(inputs: NetworkInputs) -> DataFrame:
    """Runoff class and working basin of every basin that has a flow regime."""
    table = lookup(inputs.basin_regime.filter(F.col("frclass").isNotNull()), inputs.basin_hemis, "hybas_id")
    table = lookup(table, inputs.basin_runoff, "hybas_id")
    q_class = classify.runoff_class(F.col("runoff"))
    return table.select(
        "hybas_id",
        "runoff",
        q_class.alias("qlevel"),
        classify.working_basin(F.col("hemis"), q_class, F.col("frclass")).alias("wkbasin"),
    )


def assemble_reaches(inputs: NetworkInputs, options: NetworkOptions | None = None) -> DataFrame:
    """Static part of the segment table: classes, discharge, annual width, width exponent and coefficient.

    Only segments with a basin and a flow regime stay.  The joined table is written once because
    the exact quantiles scan its columns several times.
    """
    options = options or NetworkOptions()
    check(inputs, options, "discharge", "uparea", "reach_basin", "basin_hemis", "basin_runoff", "basin_regime")
    flow = ingest.discharge_by_segment(inputs.discharge, {"Qmean": "q_year", "Qstd": "q_std"})
    placed = inputs.reach_basin.filter(
        F.col("hybas_id").isNotNull() & ~nulls.in_list("hybas_id", options.no_basin)
    )
    reach = lookup(inputs.reach, monthly(flow), "comid")
    reach = lookup(reach, inputs.uparea, "comid")
    # Written first: a scan on this side is broadcast by its true size, or else lets adaptive
    # execution split a basin that holds a large share of the segments.
    classes = sink.materialize(basin_classes(inputs), "basin-classes")
    reach = reach.join(placed, "comid").join(classes, "hybas_id")
    reach = updates.patch_by_key(reach, "comid", "uparea", options.uparea_patches)
    reach = reach.withColumn("q_cv", hydraulics.coefficient_of_variation(F.col("q_std"), F.col("q_year")))
    reach = sink.materialize(reach, "reach")

    q = F.col("q_year")
    reach = quantiles.winsorize(reach, "q_cv", *options.cv_quantiles)
    reach = reach.withColumns(
        {
            "width_year": hydraulics.annual_width(F.col("qlevel"), q),
            "runoff_reach": hydraulics.reach_runoff(q, F.col("uparea")),
        }
    ).withColumn("exponent", hydraulics.width_exponent(F.col("q_cv"), F.col("runoff_reach"), q))
    reach = quantiles.winsorize(reach, "exponent", lower=options.exponent_quantile)
    reach = reach.withColumns(
        {
            "coefficient": hydraulics.width_coefficient(F.col("width_year"), q, F.col("exponent")),
            "dryout_year": hydraulics.dryout_fraction(q),
        }
    )
    return reach.filter(~nulls.in_list("wkbasin", options.excluded_working_basins))


def listed_concentration_quantiles(
    inputs: NetworkInputs,
    options: NetworkOptions | None = None,
    basins: Sequence[str] = dims.HIGHLAND_BASINS,
    probs: Sequence[float] = (0.05, 0.95),
    reaches: DataFrame | None = None,
) -> DataFrame:
    """(p, n, value): exact quantiles of the yearly mean concentration over the segments of listed basins.

    A segment's mean is over its twelve months and missing as soon as one of them is.
    """
    reach = assemble_reaches(inputs, options) if reaches is None else reaches
    listed = reach.filter(nulls.in_list("hybas_id", basins)).select("comid")
    months = listed.join(monthly(inputs.reach_pco2), "comid").groupBy("comid")
    means = months.agg(F.when(F.count("pco2") == 12, F.avg("pco2")).alias("pco2"))
    return quantiles.quantile_table(means, [], {"pco2": probs}).select("p", "n", "value")


def assemble_reach_months(
    inputs: NetworkInputs, options: NetworkOptions | None = None, reaches: DataFrame | None = None
) -> DataFrame:
    """Segment-month table: width, dry share, gas exchange and concentration.

    All joins are on the segment key (and month), so one hash partitioning serves the chain.
    The twelve discharges of a segment come with ``reaches``, so the months need no join of their own.
    Without a ready-made exchange table, k is computed here from the same discharge and
    temperature rows instead of being joined back.
    """
    options = options or NetworkOptions()
    reach = assemble_reaches(inputs, options) if reaches is None else reaches
    check(inputs, options, "air_temp", "reach_pco2", "reach_k")
    if _packed(inputs, options):
        packed = reach if "ta_months" in reach.columns else _with_months(reach, inputs)
        table = by_month(packed, "ta", "pco2")
    else:
        table = (
            by_month(reach)
            .join(monthly(inputs.air_temp), ["comid", "month"], "left")
            .join(monthly(inputs.reach_pco2), ["comid", "month"], "left")
        )
    if inputs.reach_k is None:
        k = transfer_velocity(F.col("slope"), F.col("q"), F.col("ta"), options.min_slope)
        table = table.withColumn("k", k)
    else:
        table = table.join(monthly(inputs.reach_k.select("comid", "month", "k")), ["comid", "month"], "left")
    q = F.col("q")
    table = table.withColumn("tw", gas.water_temperature(F.col("ta")))
    return table.withColumns(
        {
            "width": hydraulics.width_at(F.col("coefficient"), q, F.col("exponent")),
            "dryout": hydraulics.monthly_dryout(q),
            "co2": gas.excess_co2(F.col("pco2"), F.col("tw")),
        }
    )


REACH_MONTH_COLUMNS = (
    "region", "comid", "hybas_id", "wkbasin", "month", "strm_order", "length_m", "slope", "q", "q_year",
    "width_year", "width", "dryout_year", "dryout", "tw", "k", "co2", "pco2",
)


def smallest_observed_width(observed: DataFrame, minimum: float) -> DataFrame:
    """Smallest observed width per segment, wide rivers only."""
    return (
        observed.groupBy("comid")
        .agg(F.min("width_mean").alias("width_observed"))
        .filter(F.col("width_observed") >= minimum)
    )


def override_width(reach: DataFrame, observed: DataFrame, options: NetworkOptions | None = None) -> DataFrame:
    """Add ``width_ratio``: observed over modelled annual width, capped above, 1 without a match.

    Monthly widths scale with the ratio; the annual width becomes the observed one.
    """
    options = options or NetworkOptions()
    smallest = smallest_observed_width(observed, options.min_observed_width)
    joined = reach.join(smallest, "comid", "left")
    seen = F.col("width_observed")
    factor = nulls.at_most(nulls.ratio(seen, F.col("width_year")), F.lit(options.max_width_ratio))
    return joined.withColumns(
        {
            "width_ratio": F.when(seen.isNull(), F.lit(1.0)).otherwise(factor),
            "width_year_obs": F.coalesce(seen, F.col("width_year")),
        }
    ).drop("width_observed")


def observed_reach_months(
    inputs: NetworkInputs, options: NetworkOptions | None = None, reaches: DataFrame | None = None, place: str | None = None
) -> DataFrame:
    """Segment-month table with modelled and overridden widths and the ``keep`` flag.

    Kept segments lie outside the excluded basins and have an exchange value in April.  The flag
    needs the twelve months of a segment: an array or rows that the joins have already placed together.
    ``place`` names a column by which segments are dealt out before they become twelve rows each.
    """
    options = options or NetworkOptions()
    reach = assemble_reaches(inputs, options) if reaches is None else reaches
    written = estimated_bytes(reach)
    reach = override_width(reach, inputs.observed_width, options)
    if _packed(inputs, options):
        check(inputs, options, "air_temp", "reach_pco2")
        q, ta = (F.element_at(f"{n}_months", APRIL) for n in ("q", "ta"))
        k = transfer_velocity(F.col("slope"), q, ta, options.min_slope)
        reach = _with_months(reach, inputs).withColumn("__april", k.isNotNull())
        if place:
            # A count of its own, as merged tasks would hold too many cells of months and spill them.
            least = int(reach.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            tasks = shuffle_partitions_for(written if written < MOST_BYTES else 0, PLACED_BYTES)
            reach = reach.repartition(max(tasks, least), place)
        table = assemble_reach_months(inputs, options, reach).withColumnRenamed("__april", "keep")
        april = F.col("keep")
    else:
        table = assemble_reach_months(inputs, options, reach)
        months = Window.partitionBy("comid")
        april = F.max(F.when(F.col("month") == APRIL, F.col("k").isNotNull())).over(months)
    return table.withColumns(
        {
            "width_obs": F.col("width") * F.col("width_ratio"),
            "keep": F.coalesce(april, F.lit(False))
            & ~nulls.in_list("hybas_id", options.excluded_basins),
        }
    )
