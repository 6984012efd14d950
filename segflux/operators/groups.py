"""Group statistics put back on rows, shares, tallies and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux.functions import nulls
from segflux.operators.joins import attach_stats


def normalize_by_group(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Value over its group mean (NULL as soon as the group has a NULL).

    The mean is aggregated first and joined back, so a group holding a large share of the rows
    is pre-aggregated on every task and split on the join, where a window would gather it.
    """
    means = df.groupBy(*keys).agg(nulls.strict_mean(value).alias("__mean"))
    joined = attach_stats(df, means, keys)
    return joined.withColumn(output, nulls.ratio(value, "__mean")).drop("__mean")


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, output: str, total: str | None = None) -> DataFrame:
    """Value over its (strict) group total; the total stays when ``total`` names it."""
    name = total or "__total"
    totals = df.groupBy(*keys).agg(nulls.strict_sum(value).alias(name))
    joined = attach_stats(df, totals, keys).withColumn(output, nulls.ratio(value, name))
    return joined if total else joined.drop(name)


def null_tally(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and present counts of many columns in one pass, one row per column."""
    row = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"null_{c}").alias("n_null")) for c in columns]
    )
    return row.select("n", F.inline(pairs)).select(
        "column_name", "n_null", (F.col("n") - F.col("n_null")).alias("n_present")
    )


def key_mismatch(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys that occur on one side only, and on both, from a single shuffle."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
    )


def require_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise when two inputs do not cover the same keys."""
    row = key_mismatch(left, right, keys).first()
    if row["left_only"] or row["right_only"]:
        raise ValueError(f"keys differ: {row.asDict()}")


def coverage(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Row counts of two tables and their ratio, one row."""
    counts = part.select(F.lit(1).alias("p"), F.lit(0).alias("w")).unionByName(
        whole.select(F.lit(0).alias("p"), F.lit(1).alias("w"))
    ).agg(F.sum("p").alias("n_part"), F.sum("w").alias("n_whole"))
    return counts.withColumn("ratio", nulls.ratio(F.col("n_part").cast("double"), F.col("n_whole").cast("double")))


def root_mean_square(value: Column, denominator: float = 2.0) -> Column:
    """``sqrt(sum(d^2) / denominator / n)`` where n counts every row and NULLs are skipped."""
    return F.sqrt(nulls.loose_sum(value * value) / denominator / F.count("*"))


def normal_fit(value: Column) -> list[Column]:
    """Maximum-likelihood normal parameters: mean and population standard deviation."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")]
