"""Least squares from mergeable QR factors: fits, stepwise selection, inflation factors.

Rows of (1, predictors, response) are factored block by block (tall and skinny); a task keeps one small
triangular factor whatever number of rows it reads, and the factors of tasks are factored again.  Normal
equations would square the condition number of the rows; a factor does not.  The only thing that leaves the
executors is a triangle with one row and column per variable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux.functions import nulls
from segflux.shipping import ship_package
from segflux.sources import sink

ALIASED = 1e-7
"""A predictor is aliased when less than this share of its length is left beside those before it."""
MERGED = 256
"""Factors one merging task takes; fewer than that go to the driver."""


@dataclass
class Factor:
    """Triangular factor of the complete rows of (1, predictors, response)."""

    names: tuple[str, ...]  # predictors, then the response
    n: int
    r: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        """Columns of the factor; column 0 is the constant."""
        return [self.names.index(x) + 1 for x in names]

    def centred(self) -> np.ndarray:
        """Factor of the centred columns."""
        return self.r[1:, 1:]

    def scaled_products(self) -> tuple[np.ndarray, np.ndarray]:
        """Correlations of all variables, and the length of each centred column."""
        centred = self.centred()
        length = np.linalg.norm(centred, axis=0)
        unit = np.divide(centred, length, out=np.zeros_like(centred), where=length > 0)
        return unit.T @ unit, length


@dataclass
class Fit:
    """A fitted linear model and its summary numbers."""

    response: str
    predictors: tuple[str, ...]
    intercept: float
    slopes: tuple[float, ...]
    n: int
    rss: float
    tss: float

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss

    @property
    def adjusted_r2(self) -> float:
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / (self.n - len(self.predictors) - 1)

    @property
    def step_criterion(self) -> float:
        """Criterion compared while searching: n ln(RSS/n) + 2 edf."""
        return self.n * math.log(self.rss / self.n) + 2 * (len(self.predictors) + 1)

    @property
    def aic(self) -> float:
        return self.n * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1) + 2 * (len(self.predictors) + 2)

    def predict(self) -> Column:
        """Fitted value as an expression, NULL when a predictor is missing."""
        terms = [F.lit(b) * F.col(x) for x, b in zip(self.predictors, self.slopes, strict=True)]
        return reduce(lambda a, t: a + t, terms, F.lit(self.intercept))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is an ordinary number."""
    return df.filter(reduce(lambda a, c: a & c, [nulls.is_finite(c) for c in columns]))


def triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular factor, padded to a square, with a diagonal that is not negative."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.concatenate((rows, np.zeros((width - len(rows), width))))
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def factor(df: DataFrame, response: str, predictors: Sequence[str]) -> Factor:
    """Factor of the complete rows: one pass without a shuffle, then the tasks' factors merged."""
    ship_package(df.sparkSession)
    names = (*predictors, response)
    inputs = [f"x{i}" for i in range(len(names))]
    rows = complete_cases(df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(names, inputs)]), inputs)
    width = len(names) + 1

    def batch_rows(batch: pa.RecordBatch) -> np.ndarray:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        return np.stack([np.ones(batch.num_rows), *columns], axis=1)

    def packed(n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "r"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                n, r = n + batch.num_rows, triangle(np.concatenate((r, batch_rows(batch))))
        if n:
            yield packed(n, r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, width))
        for batch in batches:
            for more, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, r = n + more, triangle(np.concatenate((r, np.array(flat).reshape(width, width))))
        if n:
            yield packed(n, r)

    schema = "n long, r array<double>"
    found = sink.materialize(rows.mapInArrow(each, schema), "factors")
    while (tasks := found.count()) > MERGED:
        found = sink.materialize(found.repartition(-(-tasks // MERGED)).mapInArrow(merge, schema), "factors")
    parts = found.collect()
    if not parts:
        raise ValueError("no complete rows")
    stacked = np.concatenate([np.array(p.r).reshape(width, width) for p in parts])
    return Factor(names, sum(p.n for p in parts), triangle(stacked))


def independent(m: Factor, predictors: Sequence[str], tolerance: float = ALIASED) -> list[str]:
    """The predictors that are no linear combination of those before them (and not constant)."""
    kept: list[str] = []
    basis = [m.r[:, 0] / m.r[0, 0]]
    for p in predictors:
        column = m.r[:, m.index([p])[0]]
        left = column.copy()
        for _ in range(2):  # the second pass removes what rounding left
            for q in basis:
                left = left - q * (q @ left)
        size = float(np.linalg.norm(left))
        if size > tolerance * float(np.linalg.norm(column)):
            kept.append(p)
            basis.append(left / size)
    return kept


def fit(m: Factor, predictors: Sequence[str]) -> Fit:
    """Least squares on a subset of the predictors; aliased ones are set aside."""
    predictors = independent(m, predictors)
    y = len(m.names)
    small = triangle(m.r[:, [0, *m.index(predictors), y]])
    coefficients = np.linalg.solve(small[:-1, :-1], small[:-1, -1])
    tss = float(m.centred()[:, -1] @ m.centred()[:, -1])
    rss = min(float(small[-1, -1] ** 2), tss)
    return Fit(m.names[-1], tuple(predictors), float(coefficients[0]), tuple(map(float, coefficients[1:])), m.n, rss, tss)


def sweep(a: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """Sweep operator on pivot k of a symmetric matrix; ``back`` takes a swept pivot out again.

    Sweeping the correlations on some predictors leaves their standardised slopes in the response's column,
    the residual share of the response's variance in its corner and minus the inflation factors on
    the diagonal.
    """
    pivot = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / pivot
    sign = -1.0 if back else 1.0
    out[:, k], out[k, :] = sign * a[:, k] / pivot, sign * a[k, :] / pivot
    out[k, k] = -1.0 / pivot
    return out


def stepwise(
    m: Factor, start: Sequence[str], lower: Sequence[str] = (), direction: str = "both"
) -> tuple[Fit, list[tuple[str, float]]]:
    """Search by the step criterion between ``lower`` and all predictors of the factor.

    Returns the chosen fit and the steps taken.  The search lives on one swept matrix: its pivots tell what
    every single move would cost, so a step is one more sweep and runs no further job.
    """
    if direction not in ("both", "backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    upper = m.names[:-1]
    a, length = m.scaled_products()
    total = float(length[-1] ** 2)
    inside: set[str] = set()

    def criterion(share: float, size: int) -> float:
        rss = max(share, 0.0) * total
        return m.n * math.log(rss / m.n) + 2 * (size + 1) if rss > 0 else -math.inf

    for p in independent(m, [p for p in upper if p in set(start)]):
        a = sweep(a, upper.index(p))
        inside.add(p)
    current = criterion(float(a[-1, -1]), len(inside))
    steps = [("<start>", current)]
    while True:
        moves = []
        for i, p in enumerate(upper):
            if p in inside:
                allowed = direction != "forward" and p not in lower
            else:
                # What is left of the predictor beside those inside; squared, as the matrix holds squares.
                allowed = direction != "backward" and a[i, i] > ALIASED**2
            if allowed:
                share = float(a[-1, -1] - a[i, -1] ** 2 / a[i, i])
                moves.append((criterion(share, len(inside) + (-1 if p in inside else 1)), i, p))
        best = min(moves, default=None)
        if best is None or best[0] >= current - 1e-9:
            return fit(m, [p for p in upper if p in inside]), steps
        current, i, p = best
        a = sweep(a, i, back=p in inside)
        steps.append((f"- {p}" if p in inside else f"+ {p}", current))
        inside ^= {p}


def inflation_factors(m: Factor, predictors: Sequence[str]) -> dict[str, float]:
    """Variance inflation: squared length of a centred predictor over what the others leave of it.

    An aliased predictor is reported as NaN and left out of the others' factors.
    """
    known = independent(m, predictors)
    out = {p: float("nan") for p in predictors}
    for p in known:
        # The last pivot of a factor is what all columns before it leave of the last one.
        at = [0, *m.index([q for q in known if q != p]), *m.index([p])]
        own = m.r[1:, m.index([p])[0]]
        out[p] = float(own @ own) / float(triangle(m.r[:, at])[-1, -1] ** 2)
    return out


def with_prediction(df: DataFrame, model: Fit, prediction: str, residual: str | None = None) -> DataFrame:
    """Add the fitted value, and prediction minus truth when asked."""
    out = df.withColumn(prediction, model.predict())
    return out if residual is None else out.withColumn(residual, F.col(prediction) - F.col(model.response))


def simple_fits(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """One simple regression per group: count, slope, intercept, r-squared and adjusted r-squared."""
    table = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.when(F.regr_count(y, x) >= 2, F.regr_slope(y, x)).alias("slope"),
        F.when(F.regr_count(y, x) >= 2, F.regr_intercept(y, x)).alias("intercept"),
        F.when((F.regr_count(y, x) >= 2) & (F.regr_syy(y, x) != 0), F.regr_r2(y, x)).alias("r2"),
    )
    n = F.col("n")
    return table.withColumn("adj_r2", F.when(n > 2, 1.0 - (1.0 - F.col("r2")) * (n - 1) / (n - 2)))


def prediction_r2(df: DataFrame, keys: Sequence[str], observed: str, predicted: str) -> DataFrame:
    """Goodness of prediction per group, as it is and in back-transformed space."""
    both = F.col(observed).isNotNull() & F.col(predicted).isNotNull()
    log_y, log_p = F.col(observed), F.col(predicted)
    return df.filter(both).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_r2(log_y, log_p).alias("r2"),
        F.regr_r2(F.exp(log_y), F.exp(log_p)).alias("r2_exp"),
    )
