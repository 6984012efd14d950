"""Removes every byte covered by a long string that also starts anywhere else in the corpus.

Suffixes are sorted in shards (``induced_sort``).  A shard must hold every suffix that could share
``length`` bytes with another of its suffixes, and no more text than a task can sort:

1. *Routing.*  Each window of ``length`` bytes is routed by the smallest hash of its 64-byte
   grams, so equal windows take the same route.  Neighbouring windows mostly share the gram; such a
   run of windows, with the bytes they cover, is a segment.
2. *Collapsing.*  Segments with equal route and equal bytes collapse to one with a weight, by an
   aggregate that combines before it shuffles.  Routes that only one segment in the corpus has are
   done: nothing repeats there.
3. *Sorting.*  The bytes of one segment of each kind are fetched and sorted shard by shard; the
   permuted common prefixes tell which windows share ``length`` bytes with another.
4. Covered spans return to their documents and are merged there.

A route with more than ``ROUTE_SEGMENTS`` kinds of segments is routed anew, by parts of its windows
and a hash of the bytes all windows of a part share; at the finest part these are the whole window.
So no task ever holds more than a shard, whatever passage is frequent, and no window is left out.

Documents are told apart by a 128-bit hash of id and text: rows equal in both have equal results.

Defined results: null and empty texts and texts shorter than ``length`` keep all bytes; equal texts
of at least that length lose all; occurrences inside one text count, overlapping ones too; an empty
table gives no rows; extra columns are never read.  Texts are used whole, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common, frames, passages
from segflux.llm.induced_sort import permuted_prefixes, suffix_array
from segflux.sources import sink

LENGTH = 400
GRAM = 64
SHARD_BYTES = 1024 * 1024
ROUTE_SEGMENTS = 1000
PARTS = (8, 64, None)
"""Parts a full route's windows are split into, step by step; None: one part per window."""
_BLOCK = 1 << 18  # windows routed at once
_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes (a power of two), by doubling."""
    h = _BYTE[raw]
    width = 1
    for level in range(gram.bit_length() - 1):
        h = h[:-width] * _ODD[level] + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    h ^= h >> np.uint64(32)
    return h


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(route, first window, last window, gram position) of a text's runs of windows."""
    windows = len(raw) - length + 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    per = length - gram + 1  # grams in a window
    for low in range(0, max(windows, 0), _BLOCK):
        high = min(low + _BLOCK, windows)
        h = gram_hashes(raw[low : high + length - 1], gram)
        # Low bits hold the position, so that of equal hashes the last one wins.
        keyed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        at = (_LOW - (frames.sliding_min(keyed, per) & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        for o, x in zip(out, (h[at[first]].view(np.int64), first + low, last + low, at[first] + low)):
            o.append(x)
    if not out[0]:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(o) for o in out)


def repeated_windows(
    route: np.ndarray, texts: list[bytes], weight: np.ndarray, windows: np.ndarray, length: int = LENGTH
) -> list[np.ndarray]:
    """For each segment of a shard, which of its windows share ``length`` bytes with another.

    Segments of one route lie in one shard; a weight above one says that equal segments exist.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    s = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    s[:-1] = joined.astype(np.int64) + 2
    s[begins + sizes] = 1
    sa = suffix_array(s)
    common_prefix = permuted_prefixes(s, sa, 2 * int(sizes.max(initial=0)) + 2, begins)
    start = np.zeros(len(s), dtype=np.int64)  # weight at the first byte of each window of its own
    own = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    start[own] = np.repeat(weight, windows)
    kind = np.cumsum(common_prefix[sa] < length)
    total = np.bincount(kind, weights=start[sa])
    repeated = np.zeros(len(s), dtype=bool)
    repeated[sa] = total[kind] > 1
    flags = repeated[own]
    return np.split(flags, np.cumsum(windows)[:-1])


SEGMENT = [("k1", T.LongType()), ("k2", T.LongType()), ("route", T.LongType()), ("digest", T.LongType()),
           ("low", T.IntegerType()), ("windows", T.IntegerType()), ("gram", T.IntegerType())]


def _segments_of(docs: DataFrame, length: int) -> DataFrame:
    schema = common.schema_of(*SEGMENT)

    def start():
        from xxhash import xxh64_intdigest

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                out: list[list[np.ndarray]] = [[] for _ in SEGMENT]
                for i, text in enumerate(common.strings(part.column("text"))):
                    if len(text) < length:
                        continue
                    route, first, last, gram = segments(np.frombuffer(text, dtype=np.uint8), length)
                    digest = [xxh64_intdigest(text[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                    n = len(route)
                    found = (np.full(n, k1[i]), np.full(n, k2[i]), route, np.array(digest, dtype=np.uint64).view(np.int64),
                             first, last - first + 1, gram - first)
                    for o, x in zip(out, found):
                        o.append(x)
                if out[0]:
                    yield common.record_batch([np.concatenate(o) for o in out], schema)

        return step

    return common.map_batches(docs.select("k1", "k2", "text"), schema, start)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


TEXT_SEGMENT = [*SEGMENT, ("weight", T.LongType()), ("bytes", T.BinaryType())]


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments, from the documents they lie in."""
    names = [n for n, _ in TEXT_SEGMENT[2:-1]]
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("segments"))
    once = frames.compressed(docs).select("k1", "k2", "frame").join(lists, ["k1", "k2"])
    schema = common.schema_of(*TEXT_SEGMENT)

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = next(frames.texts(one.column("frame")))
                cells = one.column("segments").flatten()
                columns = {n: cells.field(n) for n in names}
                lows, sizes = columns["low"].to_pylist(), columns["windows"].to_pylist()
                keys = [[one.column(k)[0].as_py()] * len(lows) for k in ("k1", "k2")]
                for at in range(0, len(lows), 2000):
                    part = slice(at, at + 2000)
                    blobs = [text[a : a + w + length - 1] for a, w in zip(lows[part], sizes[part])]
                    yield common.record_batch(
                        [*(k[part] for k in keys), *(columns[n].slice(at, 2000) for n in names), blobs], schema
                    )

        return step

    return common.map_batches(once, schema, start)


def _split_routes(segs: DataFrame, parts: int | None, length: int) -> DataFrame:
    """Segments of full routes by parts of their windows; the new route hashes the shared bytes."""
    schema = common.schema_of(*TEXT_SEGMENT)
    per = length - GRAM + 1
    width = 1 if parts is None else -(-per // parts)

    def start():
        from xxhash import xxh64_intdigest

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, "bytes", 1 << 18):
                rows = []
                for r in part.to_pylist():
                    # Window w of the segment starts (w - gram) bytes from the gram: turn = w - gram + per - 1.
                    turn = per - 1 - r["gram"]
                    for low in range(turn // width * width, turn + r["windows"], width):
                        a, b = max(low - turn, 0), min(low + width - turn, r["windows"])
                        shared = r["bytes"][low + width - 1 - turn : low - turn + length]
                        route = xxh64_intdigest(shared, (r["route"] + low) % (1 << 64))
                        piece = r["bytes"][a : b + length - 1]
                        rows.append((r["k1"], r["k2"], _signed(route), _signed(xxh64_intdigest(piece)), r["low"] + a, b - a,
                                     r["gram"] - a, r["weight"], piece))
                if rows:
                    yield common.record_batch(list(zip(*rows)), schema)

        return step

    return common.map_batches(segs, schema, start)


SPAN = [("k1", T.LongType()), ("k2", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType())]


def _sort_shards(segs: DataFrame, length: int) -> DataFrame:
    """Covered spans (byte positions) of segments, found shard by shard."""
    schema = common.schema_of(*SPAN)
    names = ("k1", "k2", "route", "low", "windows", "weight", "bytes")
    ordered = segs.select(*names).repartition("route").sortWithinPartitions("route")

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, route, low, windows, weight, blobs = zip(*rows)
        flags = repeated_windows(np.array(route), list(blobs), np.array(weight), np.array(windows, dtype=np.int64), length)
        out = []
        for a, b, at, flag in zip(k1, k2, low, flags):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False]))))
            out += [(a, b, at + int(x), at + int(y) - 1 + length) for x, y in zip(edge[::2], edge[1::2])]
        return common.record_batch(list(zip(*out)) if out else [[]] * 4, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # a shard: whole routes
        group: list[tuple] = []  # the route being read
        size = 0

        def close() -> None:
            nonlocal group, size
            if len(group) > 1 or (group and group[0][5] > 1):
                held.extend(group)
                size += sum(len(r[6]) for r in group)
            group = []

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if group and group[0][2] != row[2]:
                    close()
                    if size >= SHARD_BYTES:
                        yield spans(held)
                        held, size = [], 0
                group.append(row)
        close()
        if held:
            yield spans(held)

    return common.map_tasks(ordered, run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, route_segments: int = ROUTE_SEGMENTS) -> DataFrame:
    """(k1, k2, low, high): spans covered by repeated strings; some overlap or touch."""
    found = sink.materialize(_segments_of(docs, length), "segments")
    # Most routes have one segment and end here.  Tables are written before they are joined: with plain
    # scans on both sides adaptive execution can split a frequent route.
    routes = found.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("route")
    found = sink.materialize(found.join(sink.materialize(routes, "routes"), "route", "left_semi"), "met-segments")
    kinds = found.groupBy("route", "digest").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("k1", "k2", "low", "windows", "gram")).alias("one")
    )
    kinds = sink.materialize(kinds, "kinds")
    sizes = sink.materialize(kinds.groupBy("route").agg(F.count(F.lit(1)).alias("kinds")), "route-sizes")
    shared = sink.materialize(kinds.join(sizes, "route").select("route", "digest", "weight", "kinds", "one"), "shared")
    # A segment met more than once is covered whole, wherever it occurs.
    twice = shared.where("weight > 1").select("route", "digest")
    copies = found.join(twice, ["route", "digest"]).select(
        "k1", "k2", "low", (F.col("low") + F.col("windows") + (length - 1)).alias("high")
    )
    wanted = shared.where("kinds > 1").select("one.k1", "one.k2", "route", "digest", "one.low", "one.windows", "one.gram", "weight", "kinds")
    normal = _fetch(docs, wanted.where(F.col("kinds") <= route_segments), length)
    spans = sink.materialize(_sort_shards(normal, length), "spans")
    full = wanted.where(F.col("kinds") > route_segments)
    if not full.isEmpty():
        spans = spans.unionByName(_full_routes(sink.materialize(_fetch(docs, full, length), "full-routes"), length, route_segments))
    return copies.unionByName(spans)


def _full_routes(segs: DataFrame, length: int, route_segments: int) -> DataFrame:
    """Spans of segments on routes that hold too many kinds for a shard."""
    out: DataFrame | None = None
    for parts in PARTS:
        segs = sink.materialize(_split_routes(segs, parts, length), "split-routes")
        if parts is None:  # equal routes are equal windows now
            per = segs.groupBy("route").agg(F.sum("weight").alias("n")).where("n > 1")
            done = segs.join(per, "route").select(
                "k1", "k2", "low", (F.col("low") + F.col("windows") + (length - 1)).cast("int").alias("high")
            )
        else:
            sizes = segs.groupBy("route").agg(F.count(F.lit(1)).alias("kinds"))
            sizes = sink.materialize(sizes.where(F.col("kinds") > route_segments).select("route"), "full")
            done = sink.materialize(_sort_shards(segs.join(sizes, "route", "left_anti"), length), "spans")
            rest = segs.join(sizes, "route", "left_semi")
        out = done if out is None else out.unionByName(done)
        if parts is None or sizes.isEmpty():
            return out
        segs = rest
    return out


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    route_segments: int = ROUTE_SEGMENTS,
    with_kept: bool = True,
    words: int | None = None,
    route_kinds: int = passages.ROUTE_KINDS,
) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept bytes.

    With ``words`` also n_passage_words: the words that lie in a passage of so many words that another row has too
    (``passages``).  That column removes nothing.
    """
    docs = frames.keyed(df, id_col, text_col)
    met = None if words is None else passages.passage_words(docs, words, route_kinds)
    spans = repeated_spans(docs, length, route_segments)
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = frames.compressed(docs).join(lists, ["k1", "k2"], "left")
    counted = []
    if met is not None:
        joined = joined.join(met, ["k1", "k2"], "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0)))
        counted = [("n_passage_words", T.LongType())]
    joined = joined.select("doc_id", "frame", "spans", *(n for n, _ in counted))
    pairs = T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))
    schema = common.schema_of(
        *common.fields(docs, "doc_id"), *((n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
        ("kept_sha256", T.StringType()), *([("spans", pairs), ("kept", T.BinaryType())] if with_kept else []),
        *counted,
    )

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, "frame"):
                rows = []
                for text, found in zip(frames.texts(part.column("frame")), part.column("spans").to_pylist()):
                    merged = merge([(s["low"], s["high"]) for s in found or ()])
                    edges = [0, *itertools.chain(*merged), len(text)]
                    kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                    row = (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, [{"low": a, "high": b} for a, b in merged], kept) if with_kept else row)
                yield common.record_batch([part.column("doc_id"), *map(list, zip(*rows)), *(part.column(n) for n, _ in counted)], schema)

        return step

    return common.map_batches(joined, schema, start)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
