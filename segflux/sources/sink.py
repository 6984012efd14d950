"""Writing results, and keeping intermediate tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflux import dims

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall back to a
    folder of its own; anywhere else a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set")
        folder = _local_folders.setdefault(context.applicationId, "")
        if not folder:
            folder = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="segflux-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/segflux/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table that several later stages read, and scan it back.

    This cuts the lineage on storage that outlives executors, and lets every reader prune
    columns and push filters, which a checkpointed row set would not.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_regions(
    df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv", region: str = "region"
) -> None:
    """Write chosen columns, one zero-padded ``region=NN`` directory per region.

    Rows are rebalanced by region: a region with a large share of all rows is split over many
    tasks and files, small ones share a task.
    """
    keep = [c for c in columns if c != region]
    padded = df.select(*keep, F.lpad(F.col(region).cast("string"), 2, "0").alias(region))
    writer = padded.hint("rebalance", region).write.mode("errorifexists").partitionBy(region)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "comid", fmt: str = "parquet") -> None:
    """Save as a table bucketed on the segment key.

    Segment tables bucketed alike join on ``comid`` (and on ``comid, month``) without a shuffle.
    """
    (df.write.mode("errorifexists").format(fmt).bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def wide_months(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], month: str = "month"
) -> DataFrame:
    """Long month layout to one row per key with ``metric_Mon`` columns (output edge only)."""
    cells = [
        F.max(F.when(F.col(month) == i + 1, F.col(m))).alias(f"{m}_{mon}")
        for m in metrics
        for i, mon in enumerate(dims.MONTHS)
    ]
    return df.groupBy(*keys).agg(*cells)
