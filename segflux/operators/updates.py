"""Filters by rule and conditional updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.functions import nulls


def update_where(df: DataFrame, column: str, condition: Column, value: Column | float) -> DataFrame:
    """Masked update: rows where the condition holds get the value."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def patch_by_key(df: DataFrame, key: str, column: str, patches: Mapping) -> DataFrame:
    """Overwrite a value for a few listed keys."""
    if not patches:
        return df
    found = F.try_element_at(dims.literal_map(patches), F.col(key))
    return df.withColumn(column, F.coalesce(found, F.col(column)))


def recode(x: Column, mapping: Mapping) -> Column:
    """Replace sentinel codes in one step, so replaced values are not replaced again."""
    expr = None
    for old, new in mapping.items():
        expr = F.when(x == old, F.lit(new)) if expr is None else expr.when(x == old, F.lit(new))
    return expr.otherwise(x)


def zero_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in columns})


def within_limits(category: Column, value: Column, limits: Mapping[str, tuple]) -> Column:
    """True unless the value breaks the limits of its category (no limits: always true).

    The comparison drops nothing for a NULL category.
    """
    bad = F.lit(False)
    for name, (low, high) in limits.items():
        if low is not None:
            bad = bad | ((category == name) & (value < low))
        if high is not None:
            bad = bad | ((category == name) & (value > high))
    return ~F.coalesce(bad, F.lit(False))


def scale_by_month(
    value: Column, band: Column, month: Column, target: str, factors: Sequence[float]
) -> Column:
    """Multiply by a monthly factor inside one band, leave other bands alone."""
    factor = F.try_element_at(
        dims.literal_map({i + 1: f for i, f in enumerate(factors)}), month
    )
    return value * F.when(band == target, F.coalesce(factor, F.lit(1.0))).otherwise(F.lit(1.0))


def log_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Log-transform columns in place, keeping ln(0) as -Infinity."""
    return df.withColumns({c: nulls.log_or_inf(c) for c in columns})


def infinite_to(df: DataFrame, column: str, value: float) -> DataFrame:
    return update_where(df, column, F.abs(F.col(column)) == float("inf"), F.lit(value))
