"""Benchmark contamination by Wu-Manber search for word windows.

The patterns are the windows of ``window`` consecutive words of every benchmark item; an item of
fewer words is one pattern of all its words.  A document is read as its sequence of words.  For the
patterns of one length the search looks at blocks of two words: a shift table says how far a
block's last word is from the end of any pattern at least, so impossible positions are skipped
(a block in no pattern moves the search by almost a whole pattern); where the shift is zero, a
table by the hash of the last block selects the patterns to test, and a direct comparison of all
words confirms an occurrence.

The tables of the benchmark go to every task.  They are built from at most ``BENCHMARK_BYTES`` of
benchmark text at a time; a larger benchmark is searched in several parts, whose hits are joined
per document before words are counted.

Defined results: a null text has no words, no hits and is clean; a null or empty item has no
pattern; equal items all count; equal rows each get a row; an empty documents table gives no rows,
an empty benchmark leaves all documents clean; extra columns are never read by ``contamination``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

WINDOW = 13
SHARE = 20
"""A document is contaminated when hit words times this reach its words."""
BENCHMARK_BYTES = 16 * 1024 * 1024

# A-Z to a-z; ASCII other than letters and digits separates words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Matcher:
    """Shift and suffix tables for the windows of benchmark items, by pattern length."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            length = min(window, len(numbers))
            for at in range(len(numbers) - length + 1 if length else 0):
                by_length[length][tuple(numbers[at : at + length])].add(item)
        self.base = len(self.vocabulary) + 1
        self.tables = [self._tables(length, patterns) for length, patterns in sorted(by_length.items())]

    def _tables(self, length: int, patterns: dict[tuple[int, ...], set]):
        """(length, words of a block, shift by block, patterns by their last block)."""
        block = min(2, length)
        shift: dict[int, int] = {}
        buckets: dict[int, list[tuple[tuple[int, ...], set]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                key = self._key(pattern[end - block : end])
                shift[key] = min(shift.get(key, length), length - end)
            buckets[self._key(pattern[length - block :])].append((pattern, items))
        return length, block, shift, dict(buckets)

    def _key(self, block: tuple[int, ...]) -> int:
        return block[0] * self.base + block[1] if len(block) == 2 else block[0]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Occurrences (from, to) in word positions, and the items they belong to."""
        known = self.vocabulary.get
        text = [known(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        found: set = set()
        for length, block, shift, buckets in self.tables:
            far = length - block + 1
            at, n, base = length - 1, len(text), self.base  # the last word of a possible occurrence
            move = shift.get
            while at < n:
                key = text[at - 1] * base + text[at] if block == 2 else text[at]
                step = move(key, far)
                if step:
                    at += step
                    continue
                here = tuple(text[at - length + 1 : at + 1])
                for pattern, items in buckets[key]:
                    if pattern == here:
                        spans.append((at - length + 1, at + 1))
                        found |= items
                at += 1
        return spans, found


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans of the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, most: int = BENCHMARK_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in parts of about half of ``most`` bytes, one after the other on the driver."""
    items = benchmark.select(
        common.column(benchmark, item_col).alias("item"), common.column(benchmark, text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    total = common.input_bytes(items)
    parts = max(1, -(-2 * total // most))
    where = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for p in range(parts):
        rows = (items.where(where == p) if parts > 1 else items).collect()
        yield [(r.item, r.text.encode()) for r in rows]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def is_contaminated(n_hit: int, n_words: int, share: int = SHARE) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    benchmark_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word positions), items (as text, sorted), contaminated."""
    docs = common.keyed_text(df, id_col, text_col)
    parts = item_parts(benchmark, item_col, item_text_col, benchmark_bytes)
    first, second = next(parts), next(parts, None)
    if second is not None:
        return _by_parts(docs, itertools.chain((first, second), parts), window)
    return _search(docs, first, window)


SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def _search(docs: DataFrame, items: list[tuple[object, bytes]], window: int) -> DataFrame:
    carried = [c for c in docs.columns if c != "text"]
    schema = common.schema_of(
        *common.fields(docs, *carried), ("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", SPANS),
        ("items", T.ArrayType(T.StringType())), ("contaminated", T.BooleanType()),
    )

    def start():
        matcher = Matcher(items, window)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                rows = []
                for text in common.strings(part.column("text")):
                    words = words_of(text)
                    spans, found = matcher.search(words)
                    hit = covered(spans)
                    n_hit = sum(b - a for a, b in hit)
                    shown = [{"from": a, "to": b} for a, b in hit]
                    names = sorted(str(i) for i in found if i is not None)
                    rows.append((len(words), n_hit, shown, names, is_contaminated(n_hit, len(words))))
                yield common.record_batch([*(part.column(c) for c in carried), *map(list, zip(*rows))], schema)

        return step

    return common.map_batches(docs, schema, start)


def _by_parts(docs: DataFrame, parts: Iterator[list[tuple[object, bytes]]], window: int) -> DataFrame:
    """Several searches over numbered rows; the words hit by any of them count once."""
    numbered = sink.materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = sink.materialize(_search(numbered, next(parts), window), "hits")
    for items in parts:
        found = found.unionByName(sink.materialize(_search(numbered, items, window).where("n_hit > 0"), "hits"))
    schema = common.schema_of(*common.fields(docs, "doc_id"), *[f for f in found.schema if f.name not in ("doc_id", "row")])
    merged = found.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            hits = [covered([(s["from"], s["to"]) for s in row]) for row in batch.column("spans").to_pylist()]
            n_hit = [sum(b - a for a, b in h) for h in hits]
            n_words = batch.column("n_words").to_pylist()
            shown = [[{"from": a, "to": b} for a, b in h] for h in hits]
            items = [sorted(i) for i in batch.column("items").to_pylist()]
            bad = [is_contaminated(h, n) for h, n in zip(n_hit, n_words, strict=True)]
            yield common.record_batch([batch.column("doc_id"), n_words, n_hit, shown, items, bad], schema)

        return step

    return common.map_batches(merged.select("doc_id", "n_words", "spans", "items"), schema, start)


def keep_clean(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    benchmark_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """Rows of ``df``, unchanged, whose text is not contaminated."""
    parts = item_parts(benchmark, item_col, item_text_col, benchmark_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _filter(df, first, text_col, window)
    numbered = sink.materialize(df.select(F.monotonically_increasing_id().alias("doc_id"), F.struct("*").alias("r")), "numbered")
    texts = numbered.select("doc_id", F.col("r").getField(text_col).alias("text"))
    bad = _by_parts(texts, itertools.chain((first, second), parts), window).where("contaminated").select("doc_id")
    return numbered.join(bad, "doc_id", "left_anti").select("r.*")


def _filter(df: DataFrame, items: list[tuple[object, bytes]], text_col: str, window: int) -> DataFrame:
    def start():
        matcher = Matcher(items, window)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, text_col):
                clean = []
                for text in common.strings(part.column(text_col)):
                    words = words_of(text)
                    n_hit = sum(b - a for a, b in covered(matcher.search(words)[0]))
                    clean.append(not is_contaminated(n_hit, len(words)))
                yield part.filter(pa.array(clean))

        return step

    return common.map_batches(df, df.schema, start)
