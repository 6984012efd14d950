"""Missing-value rules: undefined is NULL, and strict sums do not hide it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_sum(x: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    x = _col(x)
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def strict_sum_where(x: Column | str, keep: Column) -> Column:
    """``strict_sum`` over the rows where ``keep`` is true; NULL when there are none."""
    kept = F.when(keep, _col(x))
    return F.when(F.count(kept) == F.count_if(keep), F.sum(kept))


def strict_mean(x: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    x = _col(x)
    return F.when(F.count(x) == F.count("*"), F.avg(x))


def loose_sum(x: Column | str) -> Column:
    """Sum that skips NULL and is 0 when nothing is left."""
    return F.coalesce(F.sum(_col(x)), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that is NULL for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def log_or_inf(x: Column | str) -> Column:
    """Natural log with ln(0) = -Infinity kept; NULL below zero."""
    x = _col(x)
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log(x))


def log_positive(x: Column | str) -> Column:
    """Natural log, NULL for zero and below."""
    x = _col(x)
    return F.when(x > 0, F.log(x))


def at_least(x: Column | str, low: float | Column) -> Column:
    """Lower bound that keeps NULL."""
    x = _col(x)
    return F.when(x < low, low).otherwise(x)


def at_most(x: Column | str, high: float | Column) -> Column:
    """Upper bound that keeps NULL."""
    x = _col(x)
    return F.when(x > high, high).otherwise(x)


def clamp(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """Both bounds, NULL kept."""
    x = _col(x)
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def is_finite(x: Column | str) -> Column:
    """True for ordinary numbers; false for NULL, NaN and infinities."""
    x = _col(x)
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def in_list(x: Column | str, values) -> Column:
    """Membership that is false, not NULL, for a NULL value."""
    values = list(values)
    return F.coalesce(_col(x).isin(values), F.lit(False)) if values else F.lit(False)


def text_or_na(x: Column | str) -> Column:
    """NULL shown as the text ``NA`` inside a concatenated key."""
    return F.coalesce(_col(x), F.lit("NA"))
