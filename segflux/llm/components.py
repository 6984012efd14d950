"""Connected components of a graph given by links, as repeated joins on shared tables.

Alternates the large-star and small-star steps until the links stop changing; then every node is
linked straight to the smallest of its component.  Each step is a group and a join, and its result
is written, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux.sources import sink


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), v < u.  Large: larger neighbours go to the minimum; small: the other ones do."""
    if large:
        pairs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = pairs.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        lows = links.groupBy("u").agg(F.min("v").alias("low"))
        moved = links.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(lows.select("u", "low"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node of its component."""
    current = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, mark = _written(current)
    while mark[0]:
        current, after = _written(_star(_star(current, True), False))
        if after == mark:
            break
        mark = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and a mark that changes when they do: their number and hash sum."""
    table = sink.materialize(links, "links")
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return table, tuple(table.agg(F.count(F.lit(1)), F.sum(h)).first())
