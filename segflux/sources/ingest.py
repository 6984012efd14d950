"""Reading inputs: typed text and Parquet scans, region partitions, discharge statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflux.functions import hydraulics
from segflux.operators.joins import monthly
from segflux.sources.schemas import SCHEMAS

# --- fixed values -----------------------------------------------------------------------
DISCHARGE_STATS = (
    "Q0", "Q10", "Q20", "Q30", "Q40", "Q50", "Q60", "Q70", "Q80", "Q90", "Q100", "Qmean", "Qstd",
)
# ----------------------------------------------------------------------------------------


def scan(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    fmt: str = "csv",
    fail_fast: bool = True,
) -> DataFrame:
    """Scan one input with its declared schema.  ``schema`` is a table name or a DDL string."""
    reader = spark.read.schema(SCHEMAS.get(schema, schema))
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST" if fail_fast else "PERMISSIVE")
    return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def scan_regions(
    spark: SparkSession, path: str, schema: str, fmt: str = "csv", regions: Iterable[int] | None = None
) -> DataFrame:
    """Read a table laid out as ``region=N`` directories; a region list prunes directories."""
    df = scan(spark, path, schema, fmt)
    return df if regions is None else df.filter(F.col("region").isin(list(regions)))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Append tables of one layout by column name; differing columns raise."""
    first = parts[0]
    for other in parts[1:]:
        require_same_columns(first, other)
    return reduce(DataFrame.unionByName, parts)


def require_same_columns(a: DataFrame, b: DataFrame) -> None:
    left, right = dict(a.dtypes), dict(b.dtypes)
    if left != right:
        raise ValueError(f"tables differ: {sorted(set(left.items()) ^ set(right.items()))}")


def monthly_statistic(discharge: DataFrame, stat: str = "Qmean", name: str = "q") -> DataFrame:
    """One monthly discharge statistic per segment, small values floored."""
    return _statistic(discharge, stat).filter(F.col("month").between(1, 12)).select(
        "comid", "month", hydraulics.discharge_floor(F.col("value")).alias(name)
    )


def annual_statistics(discharge: DataFrame, stats: dict[str, str]) -> DataFrame:
    """Annual statistics (month 0) as one row per segment, ``{stat: column}``."""
    value = hydraulics.discharge_floor(F.col("value"))
    for stat in stats:
        _check_stat(stat)
    return (
        discharge.filter((F.col("month") == 0) & F.col("stat").isin(list(stats)))
        .groupBy("comid")
        .agg(*[F.max(F.when(F.col("stat") == s, value)).alias(c) for s, c in stats.items()])
    )


def discharge_by_segment(discharge: DataFrame, annual: dict[str, str], monthly: str = "Qmean") -> DataFrame:
    """All discharge a plan needs, one row per segment: annual columns and ``q_months``, an array of twelve months.

    One scan and one shuffle on the segment key, combined on the map side; months without a value are NULL.
    """
    value, month, stat = hydraulics.discharge_floor(F.col("value")), F.col("month"), F.col("stat")
    for name in (monthly, *annual):
        _check_stat(name)
    used = (stat == monthly) & month.between(1, 12)
    if annual:
        used = used | ((month == 0) & stat.isin(list(annual)))
    return (
        discharge.filter(used)
        .groupBy("comid")
        .agg(
            *[F.max(F.when((month == 0) & (stat == s), value)).alias(c) for s, c in annual.items()],
            F.array(*[F.max(F.when((month == m) & (stat == monthly), value)) for m in range(1, 13)]).alias("q_months"),
        )
    )


def months_by_segment(table: DataFrame, value: str) -> DataFrame:
    """One row per segment with ``{value}_months``, an array of twelve; months without a value are NULL.

    For tables that name a segment and month once.  Combined on the map side, so a segment travels as one row.
    """
    month = F.col("month")
    values = [F.max(F.when(month == m, F.col(value))) for m in range(1, 13)]
    return table.filter(month.between(1, 12)).groupBy("comid").agg(F.array(*values).alias(f"{value}_months"))


def _check_stat(stat: str) -> None:
    if stat not in DISCHARGE_STATS:
        raise ValueError(f"unknown discharge statistic {stat!r}")


def _statistic(discharge: DataFrame, stat: str) -> DataFrame:
    _check_stat(stat)
    return discharge.filter(F.col("stat") == stat)


def bind_discharge(reach: DataFrame, discharge: DataFrame, stat: str = "Qmean") -> DataFrame:
    """Attach a monthly statistic to segments by key (one row per segment and month)."""
    return reach.join(monthly(monthly_statistic(discharge, stat)), "comid", "left")
