"""Exact quantiles of many columns and groups too large for one task, and winsorising.

Two passes serve all columns, groups and probabilities.  The first sketches every column of every group and
takes a bracket around each wanted rank.  The second counts what lies below a bracket and the distinct
values inside it, combined on the map side; the wanted rank is then found by running counts.  A bracket
that missed its rank is noticed by these counts and taken wider.

A single column whose brackets would still hold more than ``INSIDE_LIMIT`` values is narrowed round by round
instead (``order_statistics``): a sketch, exact counts, and only the few values strictly inside come together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflux.functions import nulls
from segflux.operators.joins import attach_stats
from segflux.sources import sink

SKETCH_ACCURACY = 10_000
INSIDE_LIMIT = 5_000_000
SLACK = 5.0
"""Half the width of a bracket in units of the sketch's error."""
NARROW_LIMIT = 10_000


def _brackets(
    df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, float]], accuracy: int, slack: float | None = None
) -> DataFrame:
    """(keys, __b): per wanted quantile its number of values, its rank ``h`` and a bracket [low, high] around it.

    Small groups have no need of a sketch: their bracket is open.
    """
    columns = list(dict.fromkeys(c for c, _ in specs))
    slack = SLACK / accuracy if slack is None else slack
    cells = []
    for i, c in enumerate(columns):
        x = F.when(nulls.is_finite(c), F.col(c).cast("double"))
        ends = [F.lit(min(max(p + s, 0.0), 1.0)) for d, p in specs if d == c for s in (-slack, slack)]
        cells += [F.count(x).alias(f"n{i}"), F.percentile_approx(x, F.array(*ends), F.lit(accuracy)).alias(f"s{i}")]
    sketched = df.groupBy(*keys).agg(*cells)
    seen: dict[str, int] = {}
    brackets = []
    for c, p in specs:
        i, j = columns.index(c), seen.get(c, 0)
        seen[c] = j + 1
        n = F.col(f"n{i}")
        open_ = (n <= accuracy // 2) | F.lit(slack >= 1.0)
        brackets.append(
            F.struct(
                n.alias("n"),
                ((n - 1).cast("double") * F.lit(p)).alias("h"),
                F.when(open_, F.lit(-math.inf)).otherwise(F.col(f"s{i}")[2 * j]).alias("low"),
                F.when(open_, F.lit(math.inf)).otherwise(F.col(f"s{i}")[2 * j + 1]).alias("high"),
            )
        )
    return sketched.select(*keys, F.array(*brackets).alias("__b"))


def _inside(marked: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, float]]) -> DataFrame:
    """(keys, i, n, h, low, high, missed): the order statistics around rank ``h``, from rows with their brackets.

    The ends of a column's brackets cut the line into pieces.  A row counts once per column: with its value
    inside a bracket, with the number of its piece alone outside.
    """
    columns = list(dict.fromkeys(c for c, _ in specs))
    entries = []
    for j, c in enumerate(columns):
        x = F.col(c).cast("double")
        mine = [F.col("__b")[i] for i, (d, _) in enumerate(specs) if d == c]
        piece = reduce(lambda a, t: a + t, [(x >= b["low"]).cast("int") + (x > b["high"]).cast("int") for b in mine])
        held = reduce(lambda a, t: a | t, [(x >= b["low"]) & (x <= b["high"]) for b in mine])
        entry = F.struct(F.lit(j).alias("j"), mine[0]["n"].alias("n"), piece.alias("piece"), F.when(held, x).alias("v"))
        entries.append(F.when(nulls.is_finite(c), entry))
    if len(columns) == 1:  # nothing to expand
        long = marked.filter(nulls.is_finite(columns[0])).select(*keys, entry.alias("e")).select(*keys, "e.*")
    else:
        long = marked.select(*keys, F.inline(F.array_compact(F.array(*entries))))
    counts = long.groupBy(*keys, "j", "n", "piece", "v").agg(F.count(F.lit(1)).alias("count"))
    upto = Window.partitionBy(*keys, "j").orderBy("piece", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("count").over(upto))

    def at(rank: Column) -> Column:
        """The first value beyond a rank; NULL when it lies outside of all brackets."""
        return F.min(F.when(F.col("upto") > rank, F.struct("upto", "v")))["v"]

    cells = []
    for i, (c, p) in enumerate(specs):
        h = (F.col("n") - 1).cast("double") * F.lit(p)
        cell = F.struct(F.lit(i).alias("i"), h.alias("h"), at(F.floor(h)).alias("low"), at(F.ceil(h)).alias("high"))
        cells.append(F.when(F.col("j") == columns.index(c), cell))
    found = ranked.groupBy(*keys, "j", "n").agg(F.array_compact(F.array(*cells)).alias("cells"))
    found = found.select(*keys, "n", F.inline("cells"))
    return found.withColumn("missed", F.col("low").isNull() | F.col("high").isNull())


def quantile_table(
    df: DataFrame,
    keys: Sequence[str],
    probs: Mapping[str, Sequence[float]],
    accuracy: int = SKETCH_ACCURACY,
    inside_limit: int = INSIDE_LIMIT,
    slack: float | None = None,
) -> DataFrame:
    """(keys, column, p, n, value): exact quantiles of several columns in every group.

    Linear interpolation between order statistics; missing and infinite values are skipped, a column
    without values has no row.  NULL is a group like any other.
    """
    specs = [(c, float(p)) for c, wanted in probs.items() for p in wanted]
    rows = df.select(*keys, *probs)
    while True:
        brackets = sink.materialize(_brackets(rows, keys, specs, accuracy, slack), "brackets")
        most = brackets.agg(F.max(F.array_max(F.transform("__b", lambda b: b["n"])))).first()[0] or 0
        needed = int(2 * SLACK * most / inside_limit)
        if needed <= accuracy or slack is not None:
            break
        accuracy = needed
    if keys:
        found = sink.materialize(_inside(attach_stats(rows, brackets, keys), keys, specs), "quantiles")
    else:
        found = sink.materialize(_inside(rows.withColumn("__b", _literal(brackets.first()["__b"])), keys, specs), "quantiles")
    if not found.filter("missed").isEmpty():
        wider = max(10.0 * (SLACK / accuracy if slack is None else slack), 0.001)
        return quantile_table(df, keys, probs, accuracy, inside_limit, wider)
    names = F.element_at(F.array(*[F.lit(c) for c, _ in specs]), F.col("i") + 1)
    at = F.element_at(F.array(*[F.lit(p) for _, p in specs]), F.col("i") + 1)
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))
    return found.select(*keys, names.alias("column"), at.alias("p"), "n", value.alias("value"))


def _literal(brackets) -> Column:
    return F.array(*[F.struct(*[F.lit(b[f]).alias(f) for f in ("n", "h", "low", "high")]) for b in brackets])


@dataclass
class _Search:
    """State of the search for one order statistic."""

    rank: int  # 0-based rank among the non-missing values
    low: float = -math.inf  # the value lies in [low, high] ...
    high: float = math.inf
    open_low: bool = False  # ... or strictly inside, once the end points are ruled out
    open_high: bool = False
    below: int = 0  # rows before the interval
    inside: int = 0  # rows in the interval
    value: float | None = None

    def member(self, x: Column) -> Column:
        low = x > F.lit(self.low) if self.open_low else x >= F.lit(self.low)
        high = x < F.lit(self.high) if self.open_high else x <= F.lit(self.high)
        return low & high


def order_statistics(
    df: DataFrame,
    column: str,
    ranks: Sequence[int],
    total: int,
    accuracy: int = SKETCH_ACCURACY,
    inside_limit: int = NARROW_LIMIT,
) -> dict[int, float]:
    """Exact values at the given 0-based ranks among ``total`` finite values of ``column``."""
    x = F.col(column)
    values = df.select(x.cast("double").alias(column)).filter(nulls.is_finite(x))
    searches = [_Search(rank=r, inside=total) for r in sorted(set(ranks))]
    while True:
        wide = [s for s in searches if s.value is None and s.inside > inside_limit]
        if not wide:
            break
        _narrow(values, x, wide, accuracy)
    left = [s for s in searches if s.value is None]
    if left:
        # At most ``inside_limit`` values per search: small sorted arrays, one pass.
        row = values.agg(
            *[
                F.element_at(
                    F.sort_array(F.collect_list(F.when(s.member(x), x))), s.rank - s.below + 1
                ).alias(f"v{i}")
                for i, s in enumerate(left)
            ]
        ).first()
        for i, s in enumerate(left):
            s.value = row[f"v{i}"]
    return {s.rank: s.value for s in searches}


def _narrow(values: DataFrame, x: Column, searches: Sequence[_Search], accuracy: int) -> None:
    """One round: sketch the interval of every search, then count around the new end points."""
    # Searches over one interval (all of them in the first round) share one sketch.
    slack = 2.0 / accuracy
    intervals: dict[tuple, list[_Search]] = {}
    for s in searches:
        intervals.setdefault((s.low, s.high, s.open_low, s.open_high), []).append(s)
    sketches = []
    for i, group in enumerate(intervals.values()):
        ends = []
        for s in group:
            p = (s.rank - s.below) / max(s.inside - 1, 1)
            ends += [F.lit(max(p - slack, 0.0)), F.lit(min(p + slack, 1.0))]
        kept = F.when(group[0].member(x), x)
        sketches.append(F.percentile_approx(kept, F.array(*ends), F.lit(accuracy)).alias(f"b{i}"))
    row = values.agg(*sketches).first()
    brackets = {
        s.rank: row[f"b{i}"][2 * j : 2 * j + 2]
        for i, group in enumerate(intervals.values())
        for j, s in enumerate(group)
    }

    counts = []
    for i, s in enumerate(searches):
        low, high = map(F.lit, brackets[s.rank])
        member = s.member(x)
        counts += [
            F.count_if(member & (x < low)).alias(f"under{i}"),
            F.count_if(member & (x == low)).alias(f"low{i}"),
            F.count_if(member & (x > low) & (x < high)).alias(f"mid{i}"),
            F.count_if(member & (x == high)).alias(f"high{i}"),
        ]
    row = values.agg(*counts).first()
    for i, s in enumerate(searches):
        low, high = brackets[s.rank]
        position = s.rank - s.below
        under, at_low, mid = row[f"under{i}"], row[f"low{i}"], row[f"mid{i}"]
        at_high = row[f"high{i}"] if high > low else 0
        if position < under:
            s.high, s.open_high, s.inside = low, True, under
        elif position < under + at_low:
            s.value = low
        elif position < under + at_low + mid:
            s.below += under + at_low
            s.low, s.open_low, s.high, s.open_high, s.inside = low, True, high, True, mid
        elif position < under + at_low + mid + at_high:
            s.value = high
        else:
            s.below += under + at_low + mid + at_high
            s.low, s.open_low = high, True
            s.inside -= under + at_low + mid + at_high


def exact_quantiles_of(
    df: DataFrame, probs: Mapping[str, Sequence[float]], accuracy: int = SKETCH_ACCURACY, inside_limit: int = INSIDE_LIMIT
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of several columns over all rows, in two jobs for all of them."""
    specs = [(c, float(p)) for c, wanted in probs.items() for p in wanted]
    rows = df.select(*probs)
    brackets = _brackets(rows, [], specs, accuracy).first()["__b"]
    out: dict[str, dict[float, float | None]] = {c: {p: None for p in wanted} for c, wanted in probs.items()}
    known = [(s, b) for s, b in zip(specs, brackets) if b["n"]]
    slow = {c: b["n"] for (c, _), b in known if 2 * SLACK * b["n"] / accuracy > inside_limit}
    quick = [(s, b) for s, b in known if s[0] not in slow]
    if quick:
        marked = rows.withColumn("__b", _literal([b for _, b in quick]))
        for r in _inside(marked, [], [s for s, _ in quick]).collect():
            c, p = quick[r["i"]][0]
            if r["missed"]:
                slow[c] = r["n"]
            else:
                out[c][p] = r["low"] + (r["high"] - r["low"]) * (r["h"] - math.floor(r["h"]))
    for c, n in slow.items():
        position = {p: (n - 1) * float(p) for p in probs[c]}
        ranks = sorted({r for h in position.values() for r in (math.floor(h), math.ceil(h))})
        at = order_statistics(df, c, ranks, n, accuracy, min(inside_limit, NARROW_LIMIT))
        for p, h in position.items():
            low, high = at[math.floor(h)], at[math.ceil(h)]
            out[c][p] = low + (high - low) * (h - math.floor(h))
    return out


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], **limits: int
) -> dict[float, float | None]:
    """Quantiles with linear interpolation between order statistics; missing values skipped."""
    return exact_quantiles_of(df, {column: list(probs)}, **limits)[column]


def winsorize(
    df: DataFrame,
    column: str,
    lower: float | None = None,
    upper: float | None = None,
    output: str | None = None,
    **limits: int,
) -> DataFrame:
    """Pull values beyond the lower and upper quantile back to it."""
    probs = [p for p in (lower, upper) if p is not None]
    bounds = exact_quantiles(df, column, probs, **limits)
    x = F.col(column)
    if lower is not None and bounds[lower] is not None:
        x = nulls.at_least(x, F.lit(bounds[lower]))
    if upper is not None and bounds[upper] is not None:
        x = nulls.at_most(x, F.lit(bounds[upper]))
    return df.withColumn(output or column, x)


def below_quantile_removed(df: DataFrame, column: str, prob: float, where: Column | None = None, **limits: int) -> DataFrame:
    """Drop rows whose value is below the quantile; ``where`` limits both to a category."""
    scope = df if where is None else df.filter(where)
    bound = exact_quantiles(scope, column, [prob], **limits)[prob]
    if bound is None:
        return df
    low = F.col(column) < F.lit(bound)
    drop = low if where is None else where & low
    return df.filter(~F.coalesce(drop, F.lit(False)))
