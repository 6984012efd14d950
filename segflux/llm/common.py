"""What the operators of this subpackage share: table reads, batch functions, shared files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 8 * 1024 * 1024
"""Text bytes an operator works on at once inside a task; a longer text is a slice of its own."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names; extra columns stay unread."""
    return df.select(column(df, id_col).alias("doc_id"), column(df, text_col).cast("string").alias("text"))


def map_batches(
    df: DataFrame, schema: T.StructType, start: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]
) -> DataFrame:
    """Arrow batches through a function made once per task by ``start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return map_tasks(df, run, schema)


def map_tasks(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` that gives freed memory back when a task ends; workers live on for other tasks.

    Columns travel under their positions where a name holds a dot or a quote, which ``mapInArrow`` can't resolve.
    """
    names = df.columns
    plain = not any(set(".`") & set(n) for n in (*names, *schema.names))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if plain:
            yield from run(batches)
        else:
            for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
                yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
        release_memory()

    if plain:
        return df.mapInArrow(task, schema)
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(task, numbered).toDF(*schema.names)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``most`` text bytes (or one row)."""
    sizes = lengths(batch.column(name))
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def strings(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, a null as an empty text."""
    import pyarrow.compute as pc

    return pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()


def record_batch(arrays: Sequence, schema: T.StructType) -> pa.RecordBatch:
    """Arrays (numpy, lists or Arrow) as a batch of exactly the given Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    columns = [
        (a.cast(f.type) if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, type=f.type))
        for a, f in zip(arrays, wanted, strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names=wanted.names)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """Fields of a frame by name, all nullable."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def schema_of(*parts: T.StructField | tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([p if isinstance(p, T.StructField) else T.StructField(p[0], p[1], True) for p in parts])


def filesystem(path: str):
    """Arrow file system and inner path of a folder on shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``sink.materialize`` has written and nothing reads any more."""
    files = table.inputFiles()
    if files:
        system, inner = filesystem(files[0].rpartition("/")[0])
        system.delete_dir(inner)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of a text column over all rows: one aggregate, one row to the driver."""
    total = df.agg(F.sum(F.octet_length(column(df, text_col)).cast("long"))).first()[0]
    return int(total or 0)
