"""Classes of runoff and latitude, and the working-basin key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import nulls


def _steps(x: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """First class whose (exclusive) upper bound exceeds x; NULL stays NULL."""
    expr = None
    for upper, name in steps:
        hit = x.isNotNull() if upper is None else x < upper
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr


def runoff_class(runoff: Column) -> Column:
    return _steps(runoff, [(upper, name) for upper, name, _, _ in dims.RUNOFF_CLASSES])


def wetness_class(runoff: Column) -> Column:
    return _steps(runoff, dims.WETNESS_CLASSES)


def climate_band(lat: Column, labels: Sequence[str] = dims.BANDS_LONG) -> Column:
    """Climate band from latitude; both tropic lines belong to the tropics."""
    polar, north, south = dims.BAND_EDGES
    return (
        F.when(lat > polar, F.lit(labels[0]))
        .when(lat > north, F.lit(labels[1]))
        .when(lat >= south, F.lit(labels[2]))
        .when(lat < south, F.lit(labels[3]))
    )


def working_basin(hemisphere: Column, runoff_class_: Column, regime: Column) -> Column:
    """Hemisphere + runoff class + characters 4 to 6 of the regime code."""
    return F.concat(
        nulls.text_or_na(hemisphere),
        nulls.text_or_na(runoff_class_),
        nulls.text_or_na(F.substring(regime, 4, 3)),
    )
