"""Distribution statistics: histograms, densities, seasonal smooths.

Bins are half-open ``[low, high)``; the last bin of a histogram also takes its upper edge.
A value within 1e-8 bin widths below an edge counts as lying on it, so that the last bit of a
logarithm does not decide the bin.  Values are reduced to bins or to months before anything is put together, so a group of any
size ends up as a few hundred rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflux.functions import nulls
from segflux.operators import quantiles, reshape
from segflux.operators.joins import attach_stats
from segflux.sources import sink

EDGE_FUZZ = 1e-8  # of a bin width


def bin_number(position: Column) -> Column:
    """Bin of a position measured in bin widths."""
    return F.floor(position + EDGE_FUZZ).cast("int")


def histogram_by_group(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over each group's own range; missing and infinite values are dropped."""
    rows = df.select(*keys, value).filter(nulls.is_finite(value))
    ranges = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    x, low, width = F.col(value), F.col("low"), (F.col("high") - F.col("low")) / float(bins)
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(bin_number(nulls.ratio(x - low, width)), F.lit(bins - 1))
    )
    return (
        attach_stats(rows, ranges, keys)
        .groupBy(*keys, "low", "high", slot.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def histogram_columns(
    df: DataFrame, columns: Mapping[str, Column | None], bins: int = 50, name: str = "column"
) -> DataFrame:
    """Equal-width bins over each column's own range, for many columns at once: (name, bin, low, high, n).

    ``columns`` gives the rows a column takes part with (None: all).  All ranges come from one aggregate; with
    them as literals the bins of a row are plain expressions, and the rows are expanded a single time.
    """
    kept = [
        F.when(nulls.is_finite(c) & (F.lit(True) if where is None else where), F.col(c).cast("double")).alias(c)
        for c, where in columns.items()
    ]
    rows = df.select(*kept)
    row = rows.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    ends = [(c, row[f"min_{i}"], row[f"max_{i}"]) for i, c in enumerate(columns) if row[f"min_{i}"] is not None]
    spark = df.sparkSession
    if not ends:
        return spark.createDataFrame([], f"{name} string, low double, high double, bin int, n long")
    # As many rows as columns.
    ranges = F.broadcast(spark.createDataFrame(ends, f"{name} string, low double, high double"))
    long = reshape.to_long(rows, [], [c for c, *_ in ends], name, "value").filter(F.col("value").isNotNull())
    width = (F.col("high") - F.col("low")) / float(bins)
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(bin_number(nulls.ratio(F.col("value") - F.col("low"), width)), F.lit(bins - 1))
    )
    return long.join(ranges, name).groupBy(name, "low", "high", slot.alias("bin")).agg(F.count("*").alias("n"))


def histogram_log(
    df: DataFrame, keys: Sequence[str], value: str, width: float = 0.06, low: float = 30.0, high: float = 20000.0
) -> DataFrame:
    """Counts on a log10 axis; values outside the limits are removed before binning."""
    x = F.col(value)
    rows = df.filter((x >= low) & (x <= high))
    return rows.groupBy(*keys, bin_number(F.log10(x) / width).alias("bin")).agg(F.count("*").alias("n"))


def histogram_density(
    df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int
) -> DataFrame:
    """Histogram over fixed limits scaled to unit area per group (limits applied first)."""
    x, width = F.col(value), (high - low) / bins
    slot = F.least(bin_number((x - low) / width), F.lit(bins - 1))
    counts = (
        df.filter((x >= low) & (x <= high)).groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))
    )
    # One row per bin is left, so the group total is a window over at most ``bins`` rows.
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("density", F.col("n") / (total * width))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = nulls.ratio(x - mean, sd)
    return nulls.ratio(F.exp(-0.5 * z * z), sd * math.sqrt(2.0 * math.pi))


def normal_density_grid(
    fits: DataFrame, keys: Sequence[str], mean: str = "mean", sd: str = "sd",
    low: float = -2.0, high: float = 2.0, points: int = 100,
) -> DataFrame:
    """Fitted normal density on an even grid for every group."""
    step = (high - low) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * step + low))
    rows = fits.select(*keys, mean, sd, grid.alias("x"))
    return rows.select(*keys, "x", normal_density(F.col("x"), F.col(mean), F.col(sd)).alias("density"))


def _same_group(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the statistics of their group; a NULL key is a group like any other."""
    named = stats.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    return df.join(named, same).drop(*[f"__key_{k}" for k in keys])


def kde_by_group(
    df: DataFrame, keys: Sequence[str], value: str,
    low: float = 0.0, high: float = 2.2, points: int = 45, bin_width: float = 0.01,
) -> DataFrame:
    """Gaussian kernel density per group on a fixed grid, from fine bins.

    Bandwidth is ``0.9 min(sd, IQR / 1.34) n^-0.2`` with the exact moments and quartiles of the values.
    Kernels are spread from the bins, not from rows.
    """
    # Bins, moments and both passes of the quartiles read the values.
    rows = sink.materialize(df.select(*keys, value).filter(nulls.is_finite(value)), "kernel-values")
    centre = (F.floor(F.col(value) / bin_width) + 0.5) * bin_width
    binned = rows.groupBy(*keys, centre.alias("__c")).agg(F.count("*").alias("__w"))
    moments = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd"))
    quartiles = quantiles.quantile_table(rows, keys, {value: [0.25, 0.75]})
    iqr = quartiles.groupBy(*keys).agg(
        (F.max(F.when(F.col("p") == 0.75, F.col("value"))) - F.max(F.when(F.col("p") == 0.25, F.col("value")))).alias("iqr")
    )
    spread = _same_group(moments, iqr, keys)
    robust = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    width = spread.select(*keys, "n", (0.9 * robust * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    w, c = F.col("__w"), F.col("__c")

    step = (high - low) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread_out = _same_group(binned, width, keys).select(*keys, "__c", "__w", "n", "bw", grid.alias("point"))
    x = F.col("point") * step + low
    kernel = w * normal_density(x, c, F.col("bw"))
    return (
        spread_out.groupBy(*keys, "point", "n", "bw")
        .agg(F.sum(kernel).alias("mass"))
        .select(*keys, "point", x.alias("x"), "n", "bw", nulls.ratio(F.col("mass"), F.col("n").cast("double")).alias("density"))
    )


def seasonal_loess(
    df: DataFrame, keys: Sequence[str], month: str, value: str, span: float = 0.75
) -> DataFrame:
    """Local quadratic smooth over the months of each group, tricube weights.

    Twelve (count, sum) points per group replace the rows: equal positions share their weight,
    so the weighted normal equations are the same.  Twelve targets per point, no join.
    """
    points = df.filter(F.col(value).isNotNull()).groupBy(*keys, month).agg(
        F.count("*").alias("n"), F.sum(value).alias("s")
    )
    target = F.explode(F.sequence(F.lit(1), F.lit(12)))
    rows = points.select(*keys, F.col(month).alias("m"), "n", "s", target.alias("x"))
    rows = rows.withColumn("d", F.abs(F.col("m") - F.col("x")))
    near = Window.partitionBy(*keys, "x").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.partitionBy(*keys, "x")
    rows = rows.withColumns(
        {"seen": F.sum("n").over(near), "total": F.sum("n").over(everyone)}
    )
    reach = F.min(F.when(F.col("seen") >= F.floor(F.col("total") * span + 1e-5), F.col("d"))).over(everyone)
    rows = rows.withColumn("h", reach.cast("double"))
    ratio = nulls.ratio(F.col("d").cast("double"), F.col("h"))
    cube = 1.0 - ratio * ratio * ratio
    rows = rows.withColumn("w", F.when(F.col("d") < F.col("h"), cube * cube * cube).when(F.col("d") == 0, 1.0).otherwise(0.0))
    u = (F.col("m") - F.col("x")).cast("double")
    wn, ws = F.col("w") * F.col("n"), F.col("w") * F.col("s")
    sums = rows.groupBy(*keys, "x").agg(
        F.sum(wn).alias("s0"), F.sum(wn * u).alias("s1"), F.sum(wn * u * u).alias("s2"),
        F.sum(wn * u * u * u).alias("s3"), F.sum(wn * u * u * u * u).alias("s4"),
        F.sum(ws).alias("t0"), F.sum(ws * u).alias("t1"), F.sum(ws * u * u).alias("t2"),
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det3(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det3(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    intercept = det3(t0, s1, s2, t1, s2, s3, t2, s3, s4)
    return sums.select(*keys, F.col("x").alias(month), nulls.ratio(intercept, whole).alias("smooth"))
