"""Wide and long layouts, renames and row-wise statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux import dims


def rename_prefix(df: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Replace leading name parts, e.g. ``{"totArea_2": "rivArea"}``; the first match wins."""
    renames = {}
    for name in df.columns:
        for old, new in prefixes.items():
            if name.startswith(old):
                renames[name] = new + name[len(old):]
                break
    return df.withColumnsRenamed(renames)


def drop_generated(df: DataFrame, prefix: str, codes: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{prefix}{c}" for c in codes])


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(ids), list(columns), key, value)


def months_to_long(df: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """``prefix01..prefix12`` columns to ``(month, value)`` rows."""
    names = [f"{prefix}{i:02d}" for i in range(1, 13)]
    long = df.unpivot(list(ids), names, "code", value)
    return long.select(*ids, F.right("code", F.lit(2)).cast("int").alias("month"), value)


def to_wide(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence, values: Sequence[str]) -> DataFrame:
    """Rows to ``value_level`` columns.  Levels are listed, so one pass finds them all."""
    cells = [
        F.max(F.when(F.col(key) == level, F.col(v))).alias(f"{v}_{level}" if len(values) > 1 else f"{level}")
        for v in values
        for level in levels
    ]
    return df.groupBy(*ids).agg(*cells)


NO_MONTH = ""
"""Label of the row that serves measurements without a known month."""


def own_month_table(
    df: DataFrame,
    ids: Sequence[str],
    covariates: Mapping[str, tuple[str, str]],
    scale: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Wide monthly covariates to one row per id and month label, the annual label included.

    ``covariates`` maps an output name to ``(prefix, annual column)``; the twelve values come
    from ``prefix_01 .. prefix_12``.  ``scale`` multiplies the monthly values (not the annual
    one).  Rows of another table pick the value of their own month with a join on (id, label),
    which spreads a busy site over fourteen keys: the last, ``NO_MONTH``, has no monthly values.
    """
    scale = scale or {}
    parts = []
    for i, mon in enumerate(dims.MONTHS):
        fields = [F.lit(mon).alias("mon")]
        for out, (prefix, _) in covariates.items():
            value = F.col(f"{prefix}_{i + 1:02d}")
            if out in scale:
                value = value * F.lit(float(scale[out][i]))
            fields.append(value.alias(out))
        parts.append(F.struct(*fields))
    annual = [F.lit(dims.ANNUAL).alias("mon")]
    annual += [F.col(name).alias(out) for out, (_, name) in covariates.items()]
    parts.append(F.struct(*annual))
    nothing = [F.lit(None).cast("double").alias(out) for out in covariates]
    parts.append(F.struct(F.lit(NO_MONTH).alias("mon"), *nothing))
    return df.select(*ids, F.inline(F.array(*parts)))


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over columns; NULL when one of them is NULL."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / float(len(columns))


def apply_to_columns(df: DataFrame, columns: Mapping[str, str], fn) -> DataFrame:
    """Apply one column function to many columns, ``{input: output}``."""
    return df.withColumns({out: fn(F.col(c)) for c, out in columns.items()})
