"""Ranked lexical search by scanning documents with an automaton of the queries' terms.

There is no document index.  The terms of all items become one Aho-Corasick automaton; every pattern
is guarded by a space on both sides, and a document is read with its separators turned into spaces,
so the automaton finds whole terms only and counts every term's occurrences in one pass over the text.

1. Scan: each document leaves its number of terms and the counts of the items' terms it holds.
2. Statistics over all documents: N, L and the document frequency of each term, by partial aggregates.
3. Scoring: an automaton output maps to the items that hold the term, so a document's counts are
   spread over those items and summed.  A task keeps the best ``k`` documents of every item and nothing
   else; the tasks' lists are merged per item, first inside salted groups, then over them.

Automata are built in the tasks from at most ``TERM_BYTES`` of terms; more distinct terms are scanned for
in several passes.  Items are scored in blocks of at most ``ITEM_POSTINGS`` (item, term) pairs, so neither
the terms nor the postings that go to a task grow with the items.

Scores: w = floor(1000 ln((2N + 2) / (2 df + 1))) in doubles; m = 25 + (75 n N) div L; a term adds
w * ((10^9 tf) div (1000 tf + 8 m)) for each of its occurrences in the item; all integers of 64 bits.

Defined results: null texts have no terms and score nothing; repeated rows are documents of their own
(ranked one after the other), equal items each get their list; ties go to the smaller id, null ids
last; a term in every document has a weight of 0 or so and may add nothing; fewer documents with a
positive score than ``k`` give all; empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

TOP = 10
TERM_BYTES = 4 * 1024 * 1024
"""Bytes of distinct terms (with a fixed share for each) in one automaton."""
TERM_SHARE = 16
ITEM_POSTINGS = 400_000
CELLS = 1 << 21
"""Cells of (document, item) scores, and spread counts, a task holds at once."""
SALTS = 16
NO_ID = np.iinfo(np.int64).max

# A-Z to a-z; ASCII other than letters and digits to the guard.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def automaton(terms: list[tuple[int, bytes]]):
    """Guarded patterns to term numbers.  Bytes are read as Latin-1, one character each."""
    from ahocorasick import Automaton

    machine = Automaton()
    for number, term in terms:
        machine.add_word(f" {term.decode('latin-1')} ", number)
    if terms:
        machine.make_automaton()
    return machine


def count_terms(text: bytes, machine) -> tuple[int, dict[int, int]]:
    """(terms of the text, occurrences by term number)."""
    words = text.translate(_FOLD).split()
    if not words or not len(machine):
        return len(words), {}
    guarded = f" {b' '.join(words).decode('latin-1')} "
    return len(words), Counter(map(itemgetter(1), machine.iter(guarded)))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_row, item_id, term, repeats); terms as bytes."""
    plain = items.select(
        common.column(items, item_col).alias("item_id"), common.column(items, text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    numbered = plain.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "text")
    schema = common.schema_of(
        ("item_row", T.LongType()), *common.fields(numbered, "item_id"), ("term", T.BinaryType()), ("repeats", T.LongType())
    )

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                counts = [Counter(terms_of(t)) for t in common.strings(part.column("text"))]
                at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                yield common.record_batch(
                    [
                        part.column("item_row").take(at),
                        part.column("item_id").take(at),
                        pa.array([t for c in counts for t in c], pa.binary()),
                        np.array([n for c in counts for n in c.values()], dtype=np.int64),
                    ],
                    schema,
                )

        return step

    return common.map_batches(numbered, schema, start)


def scan(docs: DataFrame, terms: list[tuple[int, bytes]]) -> DataFrame:
    """``docs`` with n (terms of the text), and the numbers and counts of the given terms, instead of the text."""
    carried = [c for c in docs.columns if c != "text"]
    schema = common.schema_of(
        *common.fields(docs, *carried), ("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.LongType()))
    )

    def start():
        machine = automaton(terms)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                found = [count_terms(t, machine) for t in common.strings(part.column("text"))]
                ends = np.concatenate(([0], np.cumsum([len(c) for _, c in found]))).astype(np.int32)
                numbers = np.fromiter((t for _, c in found for t in c), np.int32, ends[-1])
                counts = np.fromiter((k for _, c in found for k in c.values()), np.int64, ends[-1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (numbers, counts)]
                yield common.record_batch([*(part.column(c) for c in carried), [n for n, _ in found], *lists], schema)

        return step

    return common.map_batches(docs, schema, start)


class Postings:
    """Items of each term, with what one unit of a document's gain adds to the item's score."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, weights: np.ndarray, n_items: int):
        order = np.argsort(terms, kind="stable")
        self.terms, first = np.unique(terms[order], return_index=True)
        self.starts = np.concatenate((first, [len(terms)]))
        self.items, self.weights, self.n_items = items[order], weights[order], n_items

    def spread(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores (n_docs, n_items) from occurrences (doc, term, gain)."""
        scores = np.zeros(n_docs * self.n_items, dtype=np.int64)
        at = np.searchsorted(self.terms, term)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == term[known]
        doc, gain, at = doc[known], gain[known], at[known]
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        low = 0
        while low < len(sizes):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
            size = sizes[low:high]
            where = np.repeat(self.starts[at[low:high]] - (ends[low:high] - size), size) + np.arange(before, ends[high - 1])
            cell = np.repeat(doc[low:high], size) * self.n_items + self.items[where]
            np.add.at(scores, cell, np.repeat(gain[low:high], size) * self.weights[where])
            low = high
        return scores.reshape(n_docs, self.n_items)


class Best:
    """The best k documents of every item seen so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.ones(n_items, dtype=np.int64)  # scores below are out

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[doc, item[len(self.item) :]]))
        doc = np.concatenate((self.doc, ids[doc]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, item)  # where the item's rows begin
        rank = np.arange(len(item)) - first
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def _best_of_tasks(counts: DataFrame, postings: Postings, stats: tuple[int, int], k: int) -> DataFrame:
    """(item, score, doc_id): the best k of every item in every task."""
    schema = common.schema_of(("item", T.LongType()), ("score", T.LongType()), ("doc_id", T.LongType()))
    n_all, l_all = stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(postings.n_items, k)
        step = max(1, CELLS // max(1, postings.n_items))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                # Whole numbers of Python, so that no product of corpus totals runs over.
                m = np.array([25 + 75 * n * n_all // l_all for n in batch.column("n").to_pylist()], dtype=np.int64)
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                best.add(postings.spread(doc, term, gain, batch.num_rows), ids)
        yield common.record_batch([best.item, best.score, pa.array(best.doc, mask=best.doc == NO_ID)], schema)

    return common.map_tasks(counts, run, schema)


def vocabulary_parts(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(term, number, part) of distinct terms; a part has about half of ``most`` bytes, numbers are gapless."""
    total = terms.agg(F.sum(F.octet_length("term") + TERM_SHARE)).first()[0] or 0
    parts = int(-(-2 * total // most)) if total > most else 1
    dealt = sink.materialize(terms.select("term", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part")), "terms")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    numbered = dealt.withColumn("place", place).join(starts, "part")
    return sink.materialize(numbered.select("term", (F.col("first") + F.col("place")).cast("int").alias("number"), "part"), "vocabulary"), parts


def term_counts(docs: DataFrame, vocabulary: DataFrame, parts: int) -> DataFrame:
    """(doc_id, n, terms, tf) of every document, from one scan per part of the vocabulary."""

    def one(part: int, source: DataFrame) -> DataFrame:
        rows = vocabulary.where(F.col("part") == part).select("number", "term").collect()
        return sink.materialize(scan(source, [(r.number, bytes(r.term)) for r in rows]), "term-counts")

    if parts == 1:
        return one(0, docs)
    docs = sink.materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    every = one(0, docs)
    for part in range(1, parts):
        every = every.unionByName(one(part, docs).where(F.size("terms") > 0))
    merged = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.flatten(F.collect_list(F.arrays_zip("terms", "tf"))).alias("z")
    )
    return sink.materialize(merged.select("doc_id", "n", F.col("z.terms").alias("terms"), F.col("z.tf").alias("tf")), "term-counts")


def search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
    term_bytes: int = TERM_BYTES,
    item_postings: int = ITEM_POSTINGS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item."""
    spark = df.sparkSession
    asked = sink.materialize(item_terms(items, item_col, item_text_col), "item-terms")
    item_field = common.fields(asked, "item_id")
    vocabulary, parts = vocabulary_parts(asked.select("term").distinct(), term_bytes)
    counts = term_counts(common.keyed_text(df, id_col, text_col), vocabulary, parts)
    n_all, l_all = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    df_of = counts.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_all + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = vocabulary.join(df_of, "number").select("term", "number", weight.alias("w"))
    adds = (F.col("w") * F.col("repeats")).alias("adds")
    postings = sink.materialize(asked.join(weights, "term").select("item_row", "item_id", "number", adds), "item-postings")
    total = postings.count()
    blocks = -(-2 * total // item_postings) if total > item_postings else 1
    out = common.schema_of(("item_row", T.LongType()), *item_field, ("score", T.LongType()), ("doc_id", T.LongType()))
    merged = spark.createDataFrame([], out)
    for block in range(blocks if total else 0):
        table = postings.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).toArrow()
        rows, at, item = np.unique(table.column("item_row").to_numpy(), return_index=True, return_inverse=True)
        if not len(rows):
            continue
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("number", "adds")]
        lists = Postings(columns[0], item.astype(np.int64), columns[1], len(rows))
        names = pa.table({"item": pa.array(range(len(rows)), pa.int64()), "item_row": pa.array(rows), "item_id": table.column("item_id").take(pa.array(at))})
        found = _best_of_tasks(counts, lists, (int(n_all), int(l_all)), k)
        # As many names as the block has items.
        merged = merged.unionByName(found.join(F.broadcast(spark.createDataFrame(names)), "item").select(*out.names))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = merged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    local = Window.partitionBy("item_row", "salt").orderBy(*order)
    few = salted.withColumn("r", F.row_number().over(local)).where(F.col("r") <= k)
    final = Window.partitionBy("item_row").orderBy(*order)
    ranked = few.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
