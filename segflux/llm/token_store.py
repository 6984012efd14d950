"""Token-id files with a shared compression dictionary and single-document access.

A store is a folder of data files and a manifest.  A file holds the documents of one range of
ids, in ascending order, each compressed on its own with one zstandard dictionary::

    header   8-byte mark, version u32, id width u32, dictionary hash u64
    frames   one zstandard frame per document (ids as unsigned integers of that width)
    index    per document: frame offset u64, frame bytes u32, number of ids u32
    trailer  index offset u64, documents u64, 8-byte mark

All numbers are little-endian.  The dictionary lies beside the files; its hash in every header
keeps a reader from using another one.

The dictionary is trained on a bounded sample of documents (``SAMPLE_DOCUMENTS``, chosen by the
hash of the id).  It changes sizes only: every document is written whole, whatever the sample.

Files are written under names of their own and count only once the manifest, which Spark commits,
names them; what a lost or repeated task wrote is never read.

Defined results: a null text is an empty document (its end id alone); documents with equal ids
follow each other; null ids come first; an empty table gives a store without files; extra columns
are never read.  A text of any length is one frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common, tokens

MARK, TRAILER_MARK, VERSION = b"TOKSTOR1", b"TOKSTEND", 1
HEADER, ENTRY, TRAILER = struct.Struct("<8sIIQ"), struct.Struct("<QII"), struct.Struct("<QQ8s")
SAMPLE_DOCUMENTS = 1500
BLOCK_DOCUMENTS = 10_000
"""Documents that one row of the manifest lists; a file of more has several rows."""
SAMPLE_BYTES = 16 * 1024
"""Serialized bytes that one sampled document gives to the training."""
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


@dataclass
class TokenStore:
    path: str
    manifest: DataFrame  # per block of documents: file_no, file, position of its first one, documents, n_tokens, doc_ids


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(dictionary)


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; empty when there is too little to learn from."""
    import zstandard

    samples = [a[:SAMPLE_BYTES] for a in arrays if len(a) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()


def sample_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """Train on the documents with the smallest hashes of id and text, at most ``SAMPLE_DOCUMENTS``.

    The hashes alone are ranked first, so no whole text is sorted; tasks encode the documents up to the
    last hash wanted and cut what each gives to the training.  What travels is bounded however long or
    alike the documents are: ``SAMPLE_DOCUMENTS * SAMPLE_BYTES`` from a task.
    """
    h = F.xxhash64("doc_id", "text")
    last = docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    chosen = docs.select("text", h.alias("h")).where(F.col("h") <= last)

    def start():
        encode = tokens.encoder(path).encode

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                ids, at = encode(part.column("text"))
                blobs = [ids[a:b].astype(f"<u{width}").tobytes()[:SAMPLE_BYTES] for a, b in zip(at, at[1:])]
                yield common.record_batch([part.column("h"), blobs], schema)

        return step

    schema = common.schema_of(("h", T.LongType()), ("sample", T.BinaryType()))
    rows = common.map_batches(chosen, schema, start).orderBy("h", "sample").limit(SAMPLE_DOCUMENTS).collect()
    return train_dictionary([bytes(r.sample) for r in rows])


class FileWriter:
    """One data file; ``add`` takes the ids of the next document."""

    def __init__(self, stream, width: int, dictionary: bytes):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        self.stream, self.width, self.entries, self.at = stream, width, [], HEADER.size
        stream.write(HEADER.pack(MARK, VERSION, width, dictionary_hash(dictionary)))

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"an id does not fit {self.width} bytes")
        frame = self.compress(ids.astype(f"<u{self.width}").tobytes())
        self.stream.write(frame)
        self.entries.append(ENTRY.pack(self.at, len(frame), len(ids)))
        self.at += len(frame)

    def close(self) -> None:
        self.stream.write(b"".join(self.entries))
        self.stream.write(TRAILER.pack(self.at, len(self.entries), TRAILER_MARK))
        self.stream.close()


class FileReader:
    """Reads documents of one data file by their position, whole or one at a time."""

    def __init__(self, stream, dictionary: bytes):
        import zstandard

        self.stream = stream
        mark, version, self.width, found = HEADER.unpack(self._bytes(0, HEADER.size))
        if mark != MARK or version != VERSION:
            raise ValueError("not a token store file")
        if found != dictionary_hash(dictionary):
            raise ValueError("the file was written with another dictionary")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        size = stream.size()
        index_at, self.documents, mark = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if mark != TRAILER_MARK:
            raise ValueError("the file is cut short")
        self.index = self._bytes(index_at, self.documents * ENTRY.size)

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def ids(self, position: int) -> np.ndarray:
        at, size, count = ENTRY.unpack_from(self.index, position * ENTRY.size)
        raw = self.decompress(self._bytes(at, size)) if count else b""
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def write_store(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = tokens.END_ID,
    width: int = 2,
    block: int = BLOCK_DOCUMENTS,
) -> TokenStore:
    """Encode whole texts and write them, one file per range of ids, in ascending id order."""
    spark = df.sparkSession
    docs = common.keyed_text(df, id_col, text_col)
    names = vocabulary or tokens.vocabulary_path()
    dictionary = sample_dictionary(docs, names, width)
    system, folder = common.filesystem(path)
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)
    schema = common.schema_of(
        ("file_no", T.LongType()), ("file", T.StringType()), ("position", T.LongType()), ("documents", T.LongType()),
        ("n_tokens", T.LongType()), ("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
    )

    def write_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(names).encode
        number = TaskContext.get().partitionId()
        name, writer, position = "", None, 0
        doc_ids, held, total = [], 0, 0

        def listed() -> pa.RecordBatch:
            flat = pa.concat_arrays(doc_ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return common.record_batch([[number], [name], [position], [held], [total], lists], schema)

        for batch in batches:
            parts = (part.slice(k, block) for part in common.text_slices(batch) for k in range(0, part.num_rows, block))
            for part in parts:
                if writer is None:
                    name = f"ids-{number:06d}-{uuid.uuid4().hex}.bin"
                    system, folder = common.filesystem(path)
                    writer = FileWriter(system.open_output_stream(f"{folder}/{name}"), width, dictionary)
                ids, at = encode(part.column("text"), end_id)
                for a, b in zip(at, at[1:]):
                    writer.add(ids[a:b])
                if held and held + part.num_rows > block:
                    yield listed()
                    position, doc_ids, held, total = position + held, [], 0, 0
                doc_ids.append(part.column("doc_id"))
                held += part.num_rows
                total += len(ids)
        if writer is not None:
            writer.close()
            yield listed()

    # Rows of one id may go to several files: they follow each other by their texts' hashes.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = docs.orderBy(*order)
    common.map_tasks(ordered, write_task, schema).write.parquet(f"{path}/manifest")
    return open_store(spark, path, schema)


def open_store(spark: SparkSession, path: str, schema: T.StructType | None = None) -> TokenStore:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return TokenStore(path, reader.parquet(f"{path}/manifest"))


def read_store(store: TokenStore, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (and ids), from the files.

    ``start`` counts the ids of all documents before.  The running sum sees one short row per block
    of documents, never per document.
    """
    path = store.path
    before = Window.orderBy("file_no", "position").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store.manifest.select("file_no", "position", "n_tokens")
    starts = sizes.select("file_no", "position", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("block_start"))
    blocks = store.manifest.join(starts, ["file_no", "position"])
    count = store.manifest.count()
    if count:
        blocks = blocks.repartitionByRange(count, "file_no", "position")
    long = T.LongType()
    schema = common.schema_of(
        T.StructField("doc_id", store.manifest.schema["doc_ids"].dataType.elementType, True),
        ("start", long), ("n_tokens", long), ("ids_crc32", long), *([("ids", T.BinaryType())] if with_ids else []),
    )

    def start():
        system, folder = common.filesystem(path)
        with system.open_input_stream(f"{folder}/dictionary") as source:
            dictionary = source.read()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                at = batch.column("block_start")[row].as_py()
                name = batch.column("file")[row].as_py()
                with system.open_input_file(f"{folder}/{name}") as source:
                    reader = FileReader(source, dictionary)
                    first = batch.column("position")[row].as_py()
                    for low in range(0, len(doc_ids), 1000):
                        high = min(low + 1000, len(doc_ids))
                        blobs, counts, begins = [], [], []
                        crcs = []
                        for position in range(first + low, first + high):
                            raw = reader.ids(position).tobytes()
                            begins.append(at)
                            counts.append(len(raw) // 4)
                            crcs.append(zlib.crc32(raw))
                            at += len(raw) // 4
                            if with_ids:
                                blobs.append(raw)
                        arrays = [doc_ids.slice(low, high - low), begins, counts, crcs]
                        yield common.record_batch([*arrays, *([blobs] if with_ids else [])], schema)

        return step

    return common.map_batches(blocks.select("file", "position", "block_start", "doc_ids"), schema, start)
