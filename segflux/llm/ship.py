"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


@lru_cache(maxsize=1)
def _archive() -> tempfile.TemporaryDirectory:
    """A zip of the package, kept as long as the driver runs."""
    folder = tempfile.TemporaryDirectory(prefix="segflux-code-")
    package = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(f"{folder.name}/segflux.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    return folder


BATCH_ROWS = "2000"
"""Rows of an Arrow batch: whole texts are large, so fewer than Spark's default go to a worker at once."""


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; Spark serves the file itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(f"{_archive().name}/segflux.zip")
        _shipped.add(context.applicationId)
