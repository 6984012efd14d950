"""Exact top-k inner products by MaxScore.

A vector's components are its terms.  A shard of candidates keeps one posting column per term.
For a query the contribution of a term is made non-negative by taking off its smallest value in the
shard; its bound is the largest one left.  Terms are split by these bounds and the score to beat:
the non-essential terms are those whose bounds together can't lift a candidate over it.  Only the
essential postings are traversed for all candidates; non-essential ones are probed for the
candidates that are still competitive, which get fewer with every term.  Candidates at the score
to beat stay in, so ties are exact.  The best of every shard are merged per query.

Queries and candidates meet block by block: a task holds at most ``QUERY_ROWS`` queries and one
shard of ``SHARD_ROWS`` candidates.  What leaves it is k rows per query and shard.

Vectors that are null, or hold a null or a component that is not finite, take no part.  Vectors of
different sizes only compete with their own.  Components become ``floor(scale * x)``, x as double.

Defined results: a query never finds its own row, but finds rows with equal vectors and rows with
the same id; ties go to the smaller vec_id; fewer candidates than k give all; rows without an id are
candidates (last in a tie) but no queries; empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

SCALE, TOP = 256, 5
QUERY_ROWS, SHARD_ROWS = 512, 4096
ESSENTIAL_STEP = 8
"""Terms probed between two looks at who is still competitive."""


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) of usable rows, v as integers, and ``row`` to tell equal rows apart."""
    vector = common.column(df, vector_col)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = df.where(vector.isNotNull()).where(usable)
    return rows.select(common.column(df, id_col).cast("long").alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))


class Shard:
    """Candidates of one task, with postings by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # smaller ids first, so ties are in order
        self.ids, self.rows = ids[order], rows[order]
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, query: np.ndarray, own_row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best, best first."""
        worst = np.minimum(query * self.low, query * self.high)
        bound = np.maximum(query * self.low, query * self.high) - worst
        terms = np.argsort(-bound, kind="stable")
        left = np.cumsum(bound[terms][::-1])[::-1]  # what the terms from here on can still add
        others = self.rows != own_row
        # A first score to beat: the full scores of the candidates best in the strongest terms.
        lead = query[terms[:ESSENTIAL_STEP]] @ self.postings[terms[:ESSENTIAL_STEP]]
        lead = np.where(others, lead, np.iinfo(np.int64).min)
        probe = np.argpartition(-lead, min(4 * k, len(lead) - 1))[: 4 * k + 1]
        full = np.sort(query @ self.postings[:, probe[others[probe]]])[::-1]
        beat = full[k - 1] - worst.sum() if len(full) >= k else -1
        # Essential terms: the shortest run whose rest can't reach the score to beat alone.
        essential = max(1, int(np.searchsorted(-left, -beat, side="right"))) if beat > 0 else len(terms)
        alive = np.flatnonzero(others)
        e = terms[:essential]
        score = (query[e] @ self.postings[e])[alive] - worst[e].sum()
        at = essential
        while at < len(terms) and len(alive):
            competitive = score + left[at] >= beat
            alive, score = alive[competitive], score[competitive]
            t = terms[at : at + ESSENTIAL_STEP]
            score = score + query[t] @ self.postings[t][:, alive] - worst[t].sum()
            at += len(t)
            if len(score) > k:
                beat = max(beat, int(np.partition(score, len(score) - k)[len(score) - k]))
        order = np.argsort(-score, kind="stable")[:k]
        return alive[order], score[order] + worst.sum()


def top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = TOP,
    scale: int = SCALE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row where ``is_query`` (over vec_id) holds."""
    vectors = sink.materialize(quantized(df, id_col, vector_col, scale), "vectors")
    queries = vectors.where(F.col("vec_id").isNotNull()).where(is_query)
    n_queries, n_rows = queries.count(), vectors.count()
    blocks, shards = max(1, -(-n_queries // QUERY_ROWS)), max(1, -(-n_rows // SHARD_ROWS))

    def spread(seed: int, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int")

    # Each side is repeated once for every block of the other: rows times blocks, not pairs.
    asked = queries.select("vec_id", "v", "row", spread(1, blocks).alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    given = vectors.select("vec_id", "v", "row", spread(2, shards).alias("shard"))
    given = given.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = common.schema_of(("query_id", T.LongType()), ("query_row", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()))

    def sides(table: pa.Table):
        """(ids, rows, matrix) per vector size."""
        v = table.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        known = table.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        rows = table.column("row").to_numpy()
        values = v.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            yield size, known[some], rows[some], values[(starts[some][:, None] + np.arange(size)).astype(np.int64)]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            by_size = {size: Shard(i, r, m) for size, i, r, m in sides(right)}
            null_rows = set(right.filter(right.column("vec_id").is_null()).column("row").to_pylist())
            for size, ids, rows, matrix in sides(left):
                shard = by_size.get(size)
                if shard is None or not size:
                    continue
                for q, row, vector in zip(ids.tolist(), rows.tolist(), matrix):
                    at, score = shard.top(vector, row, k)
                    found = [None if r in null_rows else i for i, r in zip(shard.ids[at].tolist(), shard.rows[at].tolist())]
                    for o, x in zip(out, ([q] * len(at), [row] * len(at), found, score.tolist())):
                        o += x
        return pa.Table.from_batches([common.record_batch(out, schema)])

    found = asked.groupBy("block", "shard").cogroup(given.groupBy("block", "shard")).applyInArrow(search, schema)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
