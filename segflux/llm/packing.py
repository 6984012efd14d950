"""Cost-balanced packing of whole documents into token sequences of fixed capacity.

The cost of a piece of ``n`` tokens is estimated as ``linear * n + quadratic * n * n``: attention
stays inside a document, so it is quadratic in the piece, the rest is linear.  Pieces go in
descending order to the lowest-cost sequence that still has room for them; when none has, the
piece is cut at the room of the lowest-cost sequence that is not full.

Every task packs its own part of the documents, a window of sequences at a time, and passes what
does not fill a whole sequence on to its next window.  Only the last tokens of each task (less
than one sequence) leave it; those are packed together by groups of tasks.  So nothing but these
remainders is shuffled, and memory is bounded by one window plus the longest document.

Defined results:

* null text: an empty document, which is its end id alone; null ids pass through;
* a text longer than the capacity: full sequences of its own, then its rest like any document;
* equal rows: packed one by one; ties keep the order of arrival;
* empty table: no rows; extra columns: never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common, tokens
from segflux.sources import sink

CAPACITY = 4096
WINDOW = 512
"""Sequences a task fills at once."""
REST_TASKS = 256
"""Tasks whose remainders are packed together (at most one sequence of tokens each)."""
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
"""Cost per token, and per pair of tokens, of a piece."""
REST_SEQUENCE = 1 << 62


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc", "start", "ids", "doc_tokens")

    def __init__(self, doc, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc, self.start, self.ids, self.doc_tokens = doc, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:at], self.doc_tokens)
        return head, Piece(self.doc, self.start + at, self.ids[at:], self.doc_tokens)


def piece_cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * length + quadratic * length * length


def assign(
    pieces: list[Piece], sequences: int, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> tuple[list[tuple[int, int, Piece]], list[Piece]]:
    """(sequence, offset, piece) for what the sequences hold, and the pieces that are left over."""
    room = np.full(sequences, capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    placed: list[tuple[int, int, Piece]] = []
    rest: list[Piece] = []

    def put(sequence: int, piece: Piece) -> None:
        placed.append((sequence, capacity - int(room[sequence]), piece))
        room[sequence] -= len(piece.ids)
        cost[sequence] += piece_cost(len(piece.ids), linear, quadratic)

    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        while True:
            fits = np.flatnonzero(room >= len(piece.ids))
            if len(fits):
                put(int(fits[np.argmin(cost[fits])]), piece)
                break
            open_ones = np.flatnonzero(room > 0)
            if not len(open_ones):
                rest.append(piece)
                break
            sequence = int(open_ones[np.argmin(cost[open_ones])])
            head, piece = piece.cut(int(room[sequence]))
            put(sequence, head)
    return placed, rest


def _output(df: DataFrame, with_ids: bool, rest: bool) -> T.StructType:
    long = T.LongType()
    parts = [*common.fields(df, "doc_id"), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long)]
    parts += [("sequence_id", long), ("offset", long)]
    parts += [("ids", T.BinaryType())] if with_ids or rest else []
    parts += [("group", long)] if rest else []
    return common.schema_of(*parts)


def _rows(placed, base: int, schema: T.StructType, keys: pa.DataType, with_ids: bool, group: int | None = None) -> pa.RecordBatch:
    """Placed pieces as output rows; with ``group``, remainders that carry their ids."""
    blobs = [p.ids.tobytes() for _, _, p in placed]
    arrays = [
        pa.array([p.doc for _, _, p in placed], keys),
        [p.start for _, _, p in placed],
        [len(p.ids) for _, _, p in placed],
        [zlib.crc32(b) for b in blobs],
        [p.doc_tokens for _, _, p in placed],
        [None if group is not None else base + s for s, _, _ in placed],
        [None if group is not None else o for _, o, _ in placed],
    ]
    if "ids" in schema.names:
        arrays.append(blobs if with_ids or group is not None else [None] * len(blobs))
    if "group" in schema.names:
        arrays.append([group] * len(blobs))
    return common.record_batch(arrays, schema)


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit integers; ``with_ids=False`` leaves the column out.
    """
    docs = common.keyed_text(df, id_col, text_col)
    path = vocabulary or tokens.vocabulary_path()
    first = _output(docs, with_ids, rest=True)

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = tokens.encoder(path).encode
        waiting: list[Piece] = []
        held, used, keys = 0, task << 32, pa.null()

        def fill() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, used
            if held >= capacity:
                placed, waiting = assign(waiting, held // capacity, capacity, linear, quadratic)
                yield _rows(placed, used, first, keys, with_ids)
                used += held // capacity
                held %= capacity

        for batch in batches:
            keys = batch.schema.field("doc_id").type
            for part in common.text_slices(batch):
                ids, offsets = encode(part.column("text"))
                docs_here = part.column("doc_id").to_pylist()
                for doc, a, b in zip(docs_here, offsets[:-1], offsets[1:], strict=True):
                    for at in range(int(a), int(b), capacity):
                        waiting.append(Piece(doc, at - int(a), ids[at : min(at + capacity, b)].astype("<u4"), int(b - a)))
                    held += int(b - a)
                    if held >= WINDOW * capacity:
                        yield from fill()
        yield from fill()
        if waiting:
            yield _rows([(0, 0, p) for p in waiting], 0, first, keys, with_ids, task // REST_TASKS)

    packed = sink.materialize(common.map_tasks(docs, pack_task, first), "packed")
    final = _output(docs, with_ids, rest=False)

    def pack_rest(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        cells = (table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        pieces = [Piece(d, s, np.frombuffer(i, dtype="<u4"), n) for d, s, i, n in zip(*cells, strict=True)]
        sequences = -(-sum(len(p.ids) for p in pieces) // capacity)
        placed, _ = assign(pieces, sequences, capacity, linear, quadratic)
        keys = table.schema.field("doc_id").type
        return pa.Table.from_batches([_rows(placed, REST_SEQUENCE + (group << 32), final, keys, with_ids)])

    whole = packed.where(F.col("sequence_id").isNotNull()).select(*final.names)
    rest = packed.where(F.col("sequence_id").isNull()).groupBy("group").applyInArrow(pack_rest, final)
    return whole.unionByName(rest)
