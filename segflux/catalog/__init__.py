"""Registered queries: every operator on the test data, with the SQL that checks it."""

from segflux.catalog import (  # noqa: F401
    aggregates,
    basins,
    joins,
    models,
    reshapes,
    scalars,
    scans,
    sites,
    statistics,
    updates,
)
from segflux.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
