"""Hydraulic geometry of a reach: discharge, velocity, width, surface area, dry-out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import nulls

# --- fixed values -----------------------------------------------------------------------
MIN_DISCHARGE = 1e-9  # m3/s
MIN_WIDTH = 0.3  # m, narrower segments do not count as channel
PERENNIAL_DISCHARGE = 60.0  # m3/s, never dry from here on
RUNOFF_PER_UPAREA = 3.6 * 24 * 365  # m3/s per km2 to mm/yr
GRAVITY = 9.81
M2_PER_KM2 = 1e6
LOG_RUNOFF_RANGE = (1.6, 8.5)
LOG_DISCHARGE_RANGE = (-7.0, 10.0)
# ----------------------------------------------------------------------------------------


def discharge_floor(q: Column) -> Column:
    return nulls.at_least(q, F.lit(MIN_DISCHARGE))


def flow_velocity(q: Column) -> Column:
    return F.exp(0.12 * nulls.log_positive(q) - 1.06)


def energy_dissipation(slope: Column, velocity: Column) -> Column:
    return GRAVITY * slope * velocity


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    return nulls.ratio(std, mean)


def annual_width(runoff_class: Column, q: Column) -> Column:
    """Width from annual discharge by the power law of the runoff class."""
    log_q = nulls.log_positive(q)
    rating = None
    for _, name, a, b in dims.RUNOFF_CLASSES:
        value = F.exp(a + b * log_q)
        same = runoff_class == name
        rating = F.when(same, value) if rating is None else rating.when(same, value)
    return rating


def reach_runoff(q: Column, uparea: Column) -> Column:
    return nulls.ratio(q, uparea) * 3.6 * 24 * 365


def width_exponent(cv: Column, runoff: Column, q: Column) -> Column:
    """Exponent of the width-discharge relation; both logs are held inside their range."""
    log_runoff = nulls.clamp(nulls.log_positive(runoff), *map(F.lit, LOG_RUNOFF_RANGE))
    log_q = nulls.clamp(nulls.log_positive(q), *map(F.lit, LOG_DISCHARGE_RANGE))
    return 0.074 * nulls.log_positive(cv) - 0.026 * log_runoff - 0.011 * log_q + 0.36


def width_coefficient(width: Column, q: Column, exponent: Column) -> Column:
    return nulls.ratio(width, F.pow(q, exponent))


def width_at(coefficient: Column, q: Column, exponent: Column) -> Column:
    return coefficient * F.pow(q, exponent)


def dryout_fraction(q: Column) -> Column:
    """Share of time a reach is dry."""
    return 1.0 / (1.0 + F.exp(11.0 + 4.0 * nulls.log_positive(q)))


def monthly_dryout(q: Column) -> Column:
    """Dry share in a month; large rivers never dry out."""
    return F.when(q >= PERENNIAL_DISCHARGE, F.lit(0.0)).otherwise(dryout_fraction(q))


def is_channel(width: Column) -> Column:
    return (width >= MIN_WIDTH).cast("double")


def surface_area(length: Column, width: Column) -> Column:
    """Water surface in km2 of the channel part."""
    return length * width * is_channel(width) / M2_PER_KM2


def dryout_by_order(order: Column, prec: Column, temp: Column) -> Column:
    """Dry fraction by stream order: intermittent share times dry share of time."""

    def share(which: int) -> Column:
        expr = F.when(order > 4, F.lit(0.0))
        for so, coefficients in dims.DRYOUT_BY_ORDER.items():
            p, t, c = coefficients[which]
            expr = expr.when(order == so, p * prec + t * temp + c)
        return nulls.clamp(expr, F.lit(0.0), F.lit(0.9))

    return share(0) * share(1)


def slope_from_degrees(degrees: Column) -> Column:
    return F.tan(F.radians(degrees))
