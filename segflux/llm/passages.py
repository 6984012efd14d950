"""Counts the words of each document that lie in a passage of more than 50 words that another document holds too.

Words are what lies between ASCII white space; passages are equal when their words are, in bytes.  Unlike the bytes
that ``suffix_dedup`` removes, a passage must occur in another row, and it may be shorter than 400 bytes.

1. *Routing.*  Each window of ``words`` words is routed by the smallest hash of its 8-word grams, so equal windows take
   the same route.  Neighbouring windows that share the gram are a segment.  Routes of one document end here.
2. *Collapsing.*  Segments with equal words collapse to a kind by an aggregate that combines before it shuffles; a
   kind in several documents is covered whole.
3. *Comparing.*  Windows of one segment of each other kind are hashed anew and compared with those of the same route,
   as arrays inside tasks; routes with more than ``route_kinds`` kinds by an aggregate over single windows.
4. Covered windows return to all documents of their kind and are merged there.

Words, grams and windows are compared by 64-bit hashes, windows within a route, so in effect by 128 bits.  Rows equal
in id and text are different documents: such a text is covered whole if it has ``words`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common, frames
from segflux.sources import sink

WORDS = 51
GRAM = 8
ROUTE_KINDS = 8000
"""Kinds of one route that a task compares: about a megabyte of hashes, 3 at most."""
_SLICE = 1 << 21  # text bytes worked on at once
_CHUNK = 1 << 19  # bytes whose words are hashed at once
_LONG = 1024  # bytes from which a word is hashed on its own
_BLOCK = 1 << 18  # windows routed at once
_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(51)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_LETTER, _WORD = (int(x) * 2 + 1 for x in _rng.integers(0, 1 << 62, 2))
_BACK = pow(_WORD, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LETTERS = _powers(_LETTER, _LONG)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        if ends[j - 1] - starts[i] <= _CHUNK:
            part, begin = raw[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
            place = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
            letters = _BYTE[part] * _LETTERS[np.minimum(place, _LONG - 1)]
            letters[_SPACE[part]] = 0
            out[i:j] = np.add.reduceat(letters, begin)
        i = j
    for k in np.flatnonzero(ends - starts >= _LONG).tolist():
        out[k] = xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return _mixed(out)


class Words:
    """The words of some texts, one after the other, with a hash of any run of them."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[raw])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        """Text of each word."""
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        """First word of each text."""
        hashes = _word_hashes(raw, starts, ends)
        self._sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _powers(_WORD, len(starts)))))
        self._back = _powers(_BACK, len(starts))

    def hashes(self, low: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """Hash of ``count`` words from each word ``low``."""
        return _mixed((self._sums[low + count] - self._sums[low]) * self._back[low])


def segments(w: Words, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, first window, last window) of the texts' runs of windows; no window goes beyond its text."""
    windows, gram = len(w.text) - words + 1, min(GRAM, words)
    out = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low in range(0, max(windows, 0), _BLOCK):
        high = min(low + _BLOCK, windows)
        h = w.hashes(np.arange(low, high + words - gram), gram)
        # Low bits hold the position, so that of equal hashes the last one wins.
        keyed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        at = (_LOW - (frames.sliding_min(keyed, words - gram + 1) & _LOW)).astype(np.int64)
        at[w.text[low:high] != w.text[low + words - 1 : high + words - 1]] = -1
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        inside = at[first] >= 0
        for o, x in zip(out, (h[at[first[inside]]], first[inside] + low, last[inside] + low)):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


SEGMENT = [("k1", T.LongType()), ("k2", T.LongType()), ("route", T.LongType()), ("digest", T.LongType()),
           ("low", T.IntegerType()), ("windows", T.IntegerType())]


def _segments_of(docs: DataFrame, words: int) -> DataFrame:
    schema = common.schema_of(*SEGMENT)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batch, most=_SLICE):
            w = Words(common.strings(part.column("text")))
            route, first, last = segments(w, words)
            text, count = w.text[first], last - first + 1
            digest = w.hashes(first, count + (words - 1))
            keys = [part.column(k).to_numpy()[text] for k in ("k1", "k2")]
            yield common.record_batch([*keys, route.view(np.int64), digest.view(np.int64), first - w.first[text], count], schema)

    return common.map_batches(docs.select("k1", "k2", "text"), schema, lambda: step)


HASHED = [("k1", T.LongType()), ("route", T.LongType()), ("digest", T.LongType()), ("shared", T.BooleanType()),
          ("kinds", T.LongType()), ("hashes", T.BinaryType())]


def _hashed(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The window hashes of wanted segments, from the documents they lie in."""
    names = ("route", "digest", "shared", "kinds", "low", "windows")
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("segments"))
    once = frames.compressed(docs).select("k1", "k2", "frame").join(lists, ["k1", "k2"])
    schema = common.schema_of(*HASHED)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batch, "frame", _SLICE // 4):
            w = Words(list(frames.texts(part.column("frame"))))
            lists, cells = part.column("segments"), part.column("segments").flatten()
            per = lists.value_lengths().to_numpy()
            count = cells.field("windows").to_numpy().astype(np.int64)
            ends = np.cumsum(count)
            first = np.repeat(w.first, per) + cells.field("low").to_numpy()
            hashes = w.hashes(np.repeat(first - ends + count, count) + np.arange(int(count.sum())), words).tobytes()
            blobs = [hashes[8 * (b - n) : 8 * b] for b, n in zip(ends.tolist(), count.tolist())]
            k1 = np.repeat(part.column("k1").to_numpy(), per)
            yield common.record_batch([k1, *(cells.field(n) for n in names[:4]), blobs], schema)

    return common.map_batches(once.select("k1", "frame", "segments"), schema, lambda: step)


COVERED = [("route", T.LongType()), ("digest", T.LongType()), ("first", T.IntegerType()), ("behind", T.IntegerType())]


def met_windows(route: np.ndarray, doc: np.ndarray, shared: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows of some segments another document has on the same route."""
    segment = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, route[segment]))
    r, h, s = route[segment[order]], hashes[order], segment[order]
    edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1]))))
    d = doc[s]
    met = (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)) | np.logical_or.reduceat(shared[s], edge)
    out = np.empty(len(order), dtype=bool)
    out[order] = np.repeat(met, np.diff(np.append(edge, len(order))))
    return out


def _compared(segs: DataFrame) -> DataFrame:
    """Covered windows of kinds that are not shared, found route by route."""
    schema = common.schema_of(*COVERED)
    names = ("route", "k1", "shared", "digest", "hashes")
    ordered = segs.select(*names).repartition("route").sortWithinPartitions("route")

    def found(rows: pa.Table) -> pa.RecordBatch:
        route, k1, shared, digest = (rows.column(n).to_numpy() for n in names[:4])
        blobs = rows.column("hashes").to_pylist()
        count = np.array([len(b) // 8 for b in blobs])
        segment = np.repeat(np.arange(len(count)), count)
        met = met_windows(route, k1, shared, count, np.frombuffer(b"".join(blobs), dtype=np.uint64)) & ~shared[segment]
        begins = np.cumsum(count) - count
        new = np.zeros(len(segment) + 1, dtype=bool)
        new[begins] = new[-1] = True
        first = np.flatnonzero(met & (new[:-1] | ~np.concatenate(([False], met[:-1]))))
        last = np.flatnonzero(met & (new[1:] | ~np.concatenate((met[1:], [False]))))
        s = segment[first]
        return common.record_batch([route[s], digest[s], first - begins[s], last - begins[s] + 1], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows whose last route may go on
        for batch in batches:
            route = batch.column("route").to_numpy()
            change = np.flatnonzero(route[1:] != route[:-1]) + 1
            if held and len(route) and held[-1].column("route")[-1].as_py() != route[0]:
                yield found(pa.Table.from_batches(held))
                held = []
            if len(change):
                yield found(pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))]))
                held, batch = [], batch.slice(int(change[-1]))
            if batch.num_rows:
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    return common.map_tasks(ordered, run, schema)


def _compared_singly(segs: DataFrame) -> DataFrame:
    """The same for routes with too many kinds for a task: a row a window."""
    names = ("route", "digest", "shared", "k1")
    schema = common.schema_of(*((n, dict(HASHED)[n]) for n in names), ("first", T.IntegerType()), ("hash", T.LongType()))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batch, "hashes", 1 << 18):
            blobs = part.column("hashes").to_pylist()
            count = np.array([len(b) // 8 for b in blobs])
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            take = pa.array(np.repeat(np.arange(len(count)), count))
            columns = [part.column(n).take(take) for n in names]
            yield common.record_batch([*columns, within, np.frombuffer(b"".join(blobs), dtype=np.int64)], schema)

    single = sink.materialize(common.map_batches(segs, schema, lambda: step), "single-windows")
    met = single.groupBy("route", "hash").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("shared").alias("shared"))
    met = sink.materialize(met.where("a <> b or shared").select("route", "hash"), "met-windows")
    found = single.where("not shared").join(met, ["route", "hash"], "left_semi")
    return found.select("route", "digest", "first", (F.col("first") + 1).alias("behind"))


def passage_words(docs: DataFrame, words: int = WORDS, route_kinds: int = ROUTE_KINDS) -> DataFrame:
    """(k1, k2, n_passage_words) of the keyed documents with any such word."""
    found = sink.materialize(_segments_of(docs, words), "word-segments")
    # Tables are written before they are joined: with plain scans on both sides adaptive execution can split a frequent route.
    routes = found.groupBy("route").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("route")
    met = sink.materialize(found.join(sink.materialize(routes, "word-routes"), "route", "left_semi"), "met-word-segments")
    # Every text of enough words has one segment from its first word; rows equal in id and text have more.
    high = F.col("low") + F.col("windows") + (words - 1)
    twins = found.groupBy("k1", "k2").agg(F.count(F.when(F.col("low") == 0, 1)).alias("n"), F.max(high).alias("high"))
    twins = sink.materialize(twins.where("n > 1").select("k1", "k2", F.lit(0).alias("low"), "high"), "twins")
    common.discard(found)
    kinds = met.groupBy("route", "digest").agg(
        (F.min("k1") != F.max("k1")).alias("shared"), F.min(F.struct("k1", "k2", "low", "windows")).alias("one")
    )
    kinds = sink.materialize(kinds, "word-kinds")
    sizes = kinds.groupBy("route").agg(F.count(F.lit(1)).alias("kinds"), F.min("shared").alias("done"))
    sizes = sink.materialize(sizes.where("kinds > 1 and not done").select("route", "kinds"), "word-route-sizes")
    wanted = kinds.join(sizes, "route").select("one.*", "route", "digest", "shared", "kinds")
    hashed = sink.materialize(_hashed(docs, wanted, words), "hashed-windows")
    covered = sink.materialize(_compared(hashed.where(F.col("kinds") <= route_kinds)), "covered-windows")
    full = hashed.where(F.col("kinds") > route_kinds)
    if not full.isEmpty():
        covered = covered.unionByName(sink.materialize(_compared_singly(full), "covered-windows"))
    covered = covered.unionByName(
        kinds.where("shared").select("route", "digest", F.lit(0).alias("first"), F.col("one.windows").alias("behind"))
    )
    spans = met.join(covered, ["route", "digest"]).select(
        "k1", "k2", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("behind") + (words - 1)).alias("high")
    )
    lists = spans.unionByName(twins).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(seen, span):
        end = F.greatest(seen["end"], span["high"])
        return F.struct((seen["n"] + end - F.greatest(seen["end"], span["low"])).alias("n"), end.alias("end"))

    return lists.select("k1", "k2", F.aggregate("spans", nothing, add)["n"].alias("n_passage_words"))
