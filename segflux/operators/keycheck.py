"""Do the tables of a plan cover the keys they should, once each?

Every table is reduced in one narrow pass to a row per bucket of keys: how many there are, a sum and an
exclusive-or of their hashes.  These commute, so they are combined on the map side and no key travels.
Equal buckets hold equal keys with equal counts; only the keys of buckets that differ are compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


@dataclass(frozen=True)
class Agreement:
    """How a table's keys compare with the expected ones: numbers of distinct keys."""

    table: str
    missing: int = 0
    extra: int = 0
    repeated: int = 0
    example: str | None = None
    """One of the repeated keys."""

    @property
    def same(self) -> bool:
        return not (self.missing or self.extra or self.repeated)


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a table; a key with a missing part matches nothing and is no key."""
    return df.select(*keys).dropna(subset=list(keys))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(buckets)).cast("int")


def profile(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, low, mark): number of keys, sum of half of their hashes, exclusive-or of the whole ones."""
    h = F.xxhash64(F.lit(1), *keys)
    hashed = _known(df, keys).select(_bucket(keys, buckets).alias("bucket"), h.alias("h"))
    return hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.bit_xor("h").alias("mark")
    )


def compare(expected: Sequence[tuple[str, DataFrame, DataFrame, Sequence[str]]], buckets: int = BUCKETS) -> list[Agreement]:
    """Agreement of each (name, expected keys, table, key columns), in two jobs for all of them.

    ``expected`` tables have to name every key once.
    """
    if not expected:
        return []
    profiles = []
    for i, (_, keys_of, table, keys) in enumerate(expected):
        for side, df in enumerate((keys_of, table)):
            profiles.append(profile(df, keys, buckets).select(F.lit(i).alias("table"), F.lit(side).alias("side"), "bucket", F.struct("n", "low", "mark").alias("p")))
    sides = reduce(DataFrame.unionByName, profiles).groupBy("table", "bucket").agg(
        F.max(F.when(F.col("side") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("b")
    )
    # At most BUCKETS rows a table.
    differ: dict[int, list[int]] = {}
    for r in sides.filter(~F.col("a").eqNullSafe(F.col("b"))).select("table", "bucket").collect():
        differ.setdefault(r.table, []).append(r.bucket)
    if not differ:
        return [Agreement(name) for name, *_ in expected]
    exact = []
    for i, wanted in differ.items():
        _, keys_of, table, keys = expected[i]
        here = F.lit(True) if len(wanted) == buckets else _bucket(keys, buckets).isin(wanted)
        both = [
            _known(df, keys).filter(here).select(*keys, F.lit(side).cast("long").alias("side")) for side, df in enumerate((keys_of, table))
        ]
        counts = both[0].unionByName(both[1]).groupBy(*keys).agg(
            F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b")
        )
        shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        exact.append(
            counts.agg(
                F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("missing"),
                F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("extra"),
                F.count_if(F.col("b") > 1).alias("repeated"),
                F.min(F.when(F.col("b") > 1, shown)).alias("example"),
            ).withColumn("table", F.lit(i))
        )
    found = {r.table: r for r in reduce(DataFrame.unionByName, exact).collect()}
    return [
        Agreement(name, found[i].missing, found[i].extra, found[i].repeated, found[i].example) if i in found else Agreement(name)
        for i, (name, *_) in enumerate(expected)
    ]
