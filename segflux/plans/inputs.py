"""The tables a plan reads, by role."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.operators import keycheck
from segflux.operators.joins import require_unique_keys
from segflux.session import size_for


@dataclass
class NetworkInputs:
    """Inputs of the segment and basin plans (schemas in ``segflux.sources.schemas``)."""

    reach: DataFrame
    discharge: DataFrame
    air_temp: DataFrame
    uparea: DataFrame
    reach_basin: DataFrame
    reach_pco2: DataFrame
    basin_hemis: DataFrame
    basin_runoff: DataFrame
    basin_regime: DataFrame
    wk_climate: DataFrame
    reach_k: DataFrame | None = None
    observed_width: DataFrame | None = None
    basin_centroid: DataFrame | None = None
    basin_area: DataFrame | None = None
    basin_annual: DataFrame | None = None
    basin_npp: DataFrame | None = None
    basin_soil_resp: DataFrame | None = None
    basin_ice: DataFrame | None = None


@dataclass
class NetworkOptions:
    """Choices of the reach plan, with the published network's values as defaults."""

    uparea_patches: dict = field(default_factory=lambda: dict(dims.UPAREA_PATCHES))
    excluded_working_basins: tuple = dims.EXCLUDED_WORKING_BASINS
    excluded_basins: tuple = dims.EXCLUDED_BASINS
    no_basin: tuple = ("0",)
    min_slope: float | None = None
    cv_quantiles: tuple = (0.001, 0.995)
    exponent_quantile: float = 0.01
    min_observed_width: float = 90.0
    max_width_ratio: float = 2.0
    check_keys: bool = True


BASIN_KEYS = {
    "reach": ("comid",), "basin_hemis": ("hybas_id",), "basin_runoff": ("hybas_id",), "basin_regime": ("hybas_id",),
    "wk_climate": ("wkbasin", "month"), "basin_centroid": ("hybas_id",), "basin_area": ("hybas_id",),
    "basin_annual": ("hybas_id",), "basin_npp": ("hybas_id", "month"), "basin_soil_resp": ("hybas_id", "month"),
    "basin_ice": ("hybas_id", "month"),
}
"""Keys that may not repeat, counted one by one: the segments themselves and the tables at basin grain."""
SEGMENT_KEYS = {
    "discharge": ("comid", "month", "stat"), "air_temp": ("comid", "month"), "reach_pco2": ("comid", "month"),
    "reach_k": ("comid", "month"), "uparea": ("comid",), "reach_basin": ("comid",),
}
"""Keys of the tables at segment grain, held against the segments by checksums."""
DISCHARGE_USED = [(m, "Qmean") for m in range(13)] + [(0, "Qstd")]


class KeyDisagreement(UserWarning):
    """A table lacks keys of the segment table, or has others."""


def expected_keys(reach: DataFrame, name: str) -> DataFrame:
    """The keys the segments ask of a table at segment grain."""
    keys = reach.select("comid")
    if name == "discharge":
        used = ", ".join(f"struct({m} AS month, '{stat}' AS stat)" for m, stat in DISCHARGE_USED)
        return keys.selectExpr("comid", f"inline(array({used}))")
    if SEGMENT_KEYS[name] == ("comid", "month"):
        return keys.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return keys


def _used_rows(table: DataFrame, name: str) -> DataFrame:
    """Rows a plan reads: other statistics and months do not count."""
    if name == "discharge":
        month, stat = F.col("month"), F.col("stat")
        return table.filter(month.between(0, 12) & ((stat == "Qmean") | ((stat == "Qstd") & (month == 0))))
    return table


def key_agreement(inputs, *names: str) -> list[keycheck.Agreement]:
    """How the keys of tables at segment grain agree with the segments; a missing table is left out."""
    tables = [(n, getattr(inputs, n, None)) for n in names]
    return keycheck.compare(
        [(n, expected_keys(inputs.reach, n), _used_rows(t, n), SEGMENT_KEYS[n]) for n, t in tables if t is not None]
    )


def check(inputs, options: NetworkOptions, *names: str) -> None:
    """Size the shuffles for the inputs and, unless told not to, verify the keys of the named tables.

    A repeated key would multiply rows and raises.  Missing and extra keys are reported as a
    ``KeyDisagreement`` warning: the plans keep a segment without a value as NULL.  A table is verified
    once per set of inputs, whatever number of plans read it.
    """
    size_for(inputs.reach, inputs.discharge)
    if not options.check_keys:
        return
    done: dict[str, DataFrame] = inputs.__dict__.setdefault("_verified", {})
    todo = [n for n in ("reach", *names) if getattr(inputs, n, None) is not None and done.get(n) is not getattr(inputs, n)]
    require_unique_keys([(getattr(inputs, n), BASIN_KEYS[n]) for n in todo if n in BASIN_KEYS])
    for found in key_agreement(inputs, *[n for n in todo if n in SEGMENT_KEYS]):
        if found.repeated:
            raise ValueError(f"lookup key {list(SEGMENT_KEYS[found.table])} of {found.table} repeats, e.g. {found.example}")
        if not found.same:
            warnings.warn(f"{found.table}: {found.missing} keys missing, {found.extra} of no segment", KeyDisagreement, stacklevel=3)
    done.update({n: getattr(inputs, n) for n in todo})


def from_binding(binding) -> NetworkInputs:
    """Take every role from an object with one attribute per table."""
    names = [n for n in NetworkInputs.__dataclass_fields__ if n != "reach_k"]
    return NetworkInputs(**{n: getattr(binding, n) for n in names})
