"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflux.catalog.views import VIEWS
from segflux.plans.inputs import NetworkOptions
from segflux.session import configure
from segflux.sources.bindings import Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Keys of the published network do not occur in the test data; these stand in for them.
OPTIONS = NetworkOptions(
    uparea_patches={61: 35.0, 31: 35.0}, excluded_basins=("104", "204", "504")
)


def query(name: str, sql: str | None = None):
    """Register ``fn(binding) -> DataFrame`` and, when SQL can express it, its check."""

    def register(fn: Callable[[Binding], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(binding(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


_BINDINGS: dict[tuple[str, str], Binding] = {}


def binding(spark: SparkSession, sf_dir: str) -> Binding:
    """One binding per session and directory, so its lazy tables are described once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    found = _BINDINGS.get(key)
    if found is None or found.spark is not spark:
        found = _BINDINGS[key] = Binding(spark, sf_dir)
    return found


def inputs_of(b: Binding) -> Binding:
    """A binding offers every role of ``NetworkInputs`` lazily, so it serves as one."""
    return b


def rounded(df: DataFrame, keys: str, **digits: int) -> DataFrame:
    """Final projection: key columns as they are, numbers rounded (and -0 turned into 0)."""
    cols = [F.col(k) for k in keys.split()]
    cols += [(F.round(F.col(c), d) + F.lit(0.0)).alias(c) for c, d in digits.items()]
    return df.select(*cols)


def rounded_sql(keys: str, source: str, exprs: Mapping[str, str] | None = None, **digits: int) -> str:
    """The same projection in SQL; ``exprs`` gives a column's expression when it is not a name."""
    exprs = exprs or {}
    cols = [f"{exprs[k]} AS {k}" if k in exprs else k for k in keys.split()]
    cols += [f"round({exprs.get(c, c)}, {d}) + 0e0 AS {c}" for c, d in digits.items()]
    return f"SELECT {', '.join(cols)} FROM {source}"


def with_views(sql: str) -> str:
    """Prefix the shared views a statement refers to, in definition order."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in VIEWS:
            if name in words and name not in wanted:
                wanted.add(name)
                pending.append(VIEWS[name])
    if not wanted:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in wanted)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views},\n{body[len(start):]}"
    return f"WITH {views}\n{body}"
