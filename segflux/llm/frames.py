"""Documents under 128-bit keys, and their texts as compressed frames for joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common

LEVEL = 3
"""zstandard level of texts on their way."""


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = common.keyed_text(df, id_col, text_col)
    return docs.select(
        F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(400), "text", "doc_id").alias("k2"), "doc_id", "text"
    )


def compressed(docs: DataFrame) -> DataFrame:
    """The documents with their texts as zstandard frames, so that less travels for the joins."""
    schema = common.schema_of(*common.fields(docs, "k1", "k2", "doc_id"), ("frame", T.BinaryType()))

    def start():
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                frames = [compress(t) for t in common.strings(part.column("text"))]
                yield common.record_batch([*(part.column(c) for c in ("k1", "k2", "doc_id")), frames], schema)

        return step

    return common.map_batches(docs.select("k1", "k2", "doc_id", "text"), schema, start)


def texts(frames: pa.Array) -> Iterator[bytes]:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    for frame in frames:
        yield decompress(frame.as_py())


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
