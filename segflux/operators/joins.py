"""Lookups.  All are equality joins; sizes are checked before anything is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux.sources import sink


def lookup(df: DataFrame, table: DataFrame, on: str | Sequence[str], unique: bool = False) -> DataFrame:
    """Left lookup.  ``unique=True`` first verifies that the right side has one row per key.

    The join strategy is left to the optimizer: it broadcasts the right side only when its size
    is below the session threshold, and otherwise sorts and merges, splitting hot keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if unique:
        require_unique(table, keys)
    return df.join(table, keys, "left")


def monthly(table: DataFrame) -> DataFrame:
    """Mark a table with a row a month as a large join side.

    It has twelve rows per segment or basin, so it is never the side to broadcast, whatever a size
    estimate taken before the months were expanded may say.
    """
    return table.hint("merge")


def require_unique(table: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a lookup table repeats a key (a repeated key would multiply rows)."""
    clash = table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if clash:
        raise ValueError(f"lookup key {list(keys)} repeats, e.g. {[tuple(r)[:-1] for r in clash]}")


def require_unique_keys(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> None:
    """The same for many lookup tables: one aggregate per table, all in one job."""
    clashes = []
    for i, (table, keys) in enumerate(tables):
        repeated = table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        clashes.append(repeated.select(F.lit(i).alias("table"), shown.alias("key")).limit(1))
    found = reduce(DataFrame.unionByName, clashes).collect() if clashes else []
    if found:
        texts = [f"{list(tables[r['table']][1])} repeats, e.g. {r['key']}" for r in found]
        raise ValueError(f"lookup key {'; '.join(texts)}")


def attach_stats(df: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """Put per-group statistics back on the rows; a NULL key is a group like any other.

    The grouped table is written first.  Its true size then decides: below the session threshold
    it is broadcast and the rows are not shuffled; above it both sides are plain shuffles, which
    adaptive execution can split at a hot key (it cannot when one side is an aggregate already
    placed by that key).
    """
    small = sink.materialize(stats, "group-stats").withColumnsRenamed({k: f"__key_{k}" for k in on})
    same = [df[k].eqNullSafe(small[f"__key_{k}"]) for k in on]
    return df.join(small, same, "left").drop(*[f"__key_{k}" for k in on])


def keep_matched(df: DataFrame, table: DataFrame, on: str | Sequence[str], required: str) -> DataFrame:
    """Left lookup, then drop rows without a match (the optimizer turns it into an inner join)."""
    return lookup(df, table, on).filter(F.col(required).isNotNull())


def in_table(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(other.select(on), on, "left_semi")


def not_in_table(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return df.join(other.select(on), on, "left_anti")


def relabel(df: DataFrame, column: str, levels: DataFrame, label: str, order: str) -> DataFrame:
    """Attach display label and rank of an ordered category; unknown codes become NULL.

    ``levels`` is a fixed dimension ``(code, label, ord)``.
    """
    dim = levels.select(
        F.col("code").alias(column), F.col("label").alias(label), F.col("ord").alias(order)
    )
    return df.join(dim, column, "left")
