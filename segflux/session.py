"""Session settings the plans rely on.  All are runtime settings except the builder ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Runtime re-planning: small sides become broadcasts once their size is measured,
    # tiny shuffle partitions merge, and a hot key is split over several tasks.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A table hashed on the segment key also serves a join on (segment key, month).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Methods above 8000 bytecodes are never compiled by the JVM; such a stage is better split
    # into operators than run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


MOST_BYTES = 1 << 60
TASK_BYTES = 192 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, task_bytes: int = TASK_BYTES) -> int:
    """Shuffle partitions that keep one task's share of the input near ``task_bytes``.

    Adaptive execution merges what turns out smaller, so the number may err on the high side.
    """
    return max(8, -(-input_bytes // task_bytes))


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Widen the shuffles of a session for its largest input; a width that is set and larger stays."""
    n = max(shuffle_partitions_for(input_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate of a frame's size; scans know the bytes of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_for(*inputs: DataFrame) -> int:
    """Size the shuffles for the largest of some inputs, by the optimizer's own estimate of it.

    An input without an estimate (larger than any table) is left out.
    """
    sizes = [estimated_bytes(df) for df in inputs]
    known = [n for n in sizes if n < MOST_BYTES]
    return size_shuffles(inputs[0].sparkSession, max(known, default=0))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g"
) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segflux")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        # Plans are built from many column expressions; recording a call site for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
