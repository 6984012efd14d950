"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and an anchor q
gets 0 there.  Then the squared distance is |q|^2 + M - 2 q.x, so the nearest candidates are those with the
largest inner products, and a ball of candidates around c with radius r bounds the inner product of
every one of them from both sides: distances lie between d(q, c) - r and d(q, c) + r.

Candidates are dealt to shards by the nearest of a bounded set of routing vectors (a part number splits
those that many rows are nearest to), so that a shard is a ball itself.  Each shard gets a cover tree:
a node's children lie within its covering radius, are further apart than the radius of their own level
and the first of them is the node's own centre; every level divides the radius by ``BASE``.  A node keeps
the radius that really covers its rows, and its label when they all have the same.  Nodes of up to
``LEAF_ROWS`` rows, or of equal vectors, are leaves.

An anchor descends best first: nodes by their upper bound, leaves verified by exact integer products, some of
a node's leaves at a time, again in the order of their bounds.

1. Positives: rows of the anchor's label.  The walk ends when no node left can beat the k-th best row.
2. Negatives: every positive opens a window of scores, from 80 to 100 percent of its own.  A node is skipped
   when its bounds lie outside of all windows of the anchor, when it holds only the anchor's label, or
   when every window it reaches has k better rows.  One walk serves all windows of an anchor.

Trees are written once, a row per shard, and both walks read them.  Before anything is shipped an anchor is
held against the root ball of every shard (``ROOTS`` of them at a time): it goes only to those that can
hold a row it asks for.  For the first walk that is decided by the k-th best score in its own shard.  What
is left meets block by block: a task holds at most about ``ANCHOR_ROWS`` anchors and one shard of about
``SHARD_ROWS`` rows, and gives k rows an anchor (and window), which are merged per anchor.  A vector
repeated in a third of all rows is split over shards like any other.

Defined results: rows whose label or vector is null, or whose vector holds a null or a component that
is not finite, take no part; vectors of another length never meet; rows without an id are candidates
(last in a tie) but no anchors; repeated rows are rows of their own; an anchor without positives, and a
window without rows, gives none; empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

SCALE, TOP = 256, 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_ROWS, SHARD_ROWS = 1024, 4096
ROUTES = 1024
"""Routing vectors at most; shards are split further by part numbers."""
ROOTS, OUT_ROWS = 8192, 8192
LEAF_ROWS, BASE = 48, 1.5
VERIFIED = 2048
"""Rows of a node's leaves that are verified between two looks at the bounds (or one leaf)."""
EXACT = float(1 << 52)
NO_ID = np.iinfo(np.int64).max
MIXED = np.iinfo(np.int64).min


def quantized(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, row) of usable rows, v as integers and ``row`` to tell equal rows apart."""
    vector = common.column(df, vector_col)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = df.where(vector.isNotNull()).where(usable)
    out = rows.select(common.column(df, id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"))
    return out.where("label IS NOT NULL").select("*", F.monotonically_increasing_id().alias("row"))


def matrix(v: pa.ListArray, size: int) -> np.ndarray:
    """Lists of one size as rows of doubles where these are exact, else of 64-bit integers."""
    out = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size)
    big = np.abs(out.astype(np.float64)).max(initial=0.0)
    return out if big * big * max(size, 1) >= EXACT else out.astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors (doubles only come from ``matrix``)."""
    if a.dtype == b.dtype == np.float64:
        return (a @ b).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """The vectors with one more component, so that all have the squared norm ``most``."""
    flat = vectors.astype(np.float64)
    lift = np.sqrt(np.maximum(most - (flat * flat).sum(axis=1), 0.0))
    return np.concatenate((flat, lift[:, None]), axis=1)


class CoverTree:
    """Cover tree over lifted points; node i holds the points ``order[begin[i]:end[i]]``."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, most: float):
        self.points, self.own, self.most = points, labels, most
        self.order = np.arange(len(points))
        self.centre, self.radius, self.begin, self.end, self.parent, self.label = [], [], [], [], [], []
        if len(points):
            self._grow()

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        """All points have one norm, so a product gives the distance."""
        return np.sqrt(np.maximum(2.0 * (self.most - self.points[rows] @ self.points[centre]), 0.0))

    def _grow(self) -> None:
        self._node(0, len(self.order), 0, -1)
        stack = [(0, self.radius[0])]
        while stack:
            node, cover = stack.pop()
            b, e = self.begin[node], self.end[node]
            if e - b <= LEAF_ROWS or self.radius[node] <= 2.0 * self._blur():
                continue
            below = min(cover, self.radius[node]) / BASE
            rows = self.order[b:e]
            # Farthest first: a new child is farther than ``below`` from all before it; the end is reached when all are covered.
            x = self.points[rows]
            home = np.zeros(len(rows), dtype=np.int64)
            near = self._distances(rows, self.centre[node])
            heads = [self.centre[node]]
            while True:
                far = int(near.argmax())
                if near[far] <= below:
                    break
                d = np.sqrt(np.maximum(2.0 * (self.most - x @ x[far]), 0.0))
                closer = d < near
                closer[far] = True
                home[closer], near[closer] = len(heads), d[closer]
                near[far] = 0.0
                heads.append(int(rows[far]))
            arranged = np.argsort(home, kind="stable")
            self.order[b:e] = rows[arranged]
            edges = np.searchsorted(home[arranged], np.arange(len(heads) + 1)) + b
            for i, head in enumerate(heads):
                if edges[i + 1] > edges[i]:
                    stack.append((self._node(int(edges[i]), int(edges[i + 1]), head, node), below))

    def _blur(self) -> float:
        """What rounding can hide in a distance."""
        return 1e-6 * np.sqrt(self.most)

    def _node(self, begin: int, end: int, centre: int, parent: int) -> int:
        rows = self.order[begin:end]
        self.centre.append(centre)
        self.radius.append(float(self._distances(rows, centre).max()) + self._blur())
        self.begin.append(begin)
        self.end.append(end)
        self.parent.append(parent)
        own = self.own[rows]
        self.label.append(int(own[0]) if (own == own[0]).all() else MIXED)
        return len(self.centre) - 1


def product_bounds(own: np.ndarray, most: float, dots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product in balls, a little widened for rounding.

    ``own`` is the squared norm of the query, ``dots`` its products with the centres.
    """
    d = np.sqrt(np.maximum(own + most - 2.0 * dots, 0.0))
    slack = 1.0 + 1e-6 * (own + most)
    high = (own + most - np.maximum(d - radius, 0.0) ** 2) / 2.0 + slack
    low = (own + most - (d + radius) ** 2) / 2.0 - slack
    return low, high


class Shard:
    """Rows of one shard, in the order of their tree, and its nodes."""

    def __init__(self, ids, rows, labels, vectors, most: float, centres, radius, begin, end, parent, label):
        self.ids, self.rows, self.labels, self.vectors, self.most = ids, rows, labels, vectors, most
        self.centres, self.radius, self.begin, self.end, self.parent, self.label = centres, radius, begin, end, parent, label
        order = np.argsort(parent, kind="stable")
        edges = np.searchsorted(parent[order], np.arange(len(parent) + 1))
        self.children = [order[a:b] for a, b in zip(edges, edges[1:])]
        self.leaf = edges[1:] == edges[:-1]

    @classmethod
    def build(cls, ids, rows, labels, vectors, most: float) -> Shard:
        t = CoverTree(lifted(vectors, most), labels, most)
        o = t.order
        nodes = [np.array(x) for x in (t.radius, t.begin, t.end, t.parent, t.label)]
        return cls(ids[o], rows[o], labels[o], vectors[o], most, t.points[t.centre], *nodes)

    def bounds(self, query: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return product_bounds(query @ query, self.most, self.centres[nodes, :-1] @ query, self.radius[nodes])

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        """Positions of the rows of some leaves."""
        sizes = self.end[leaves] - self.begin[leaves]
        ends = np.cumsum(sizes)
        return np.repeat(self.begin[leaves] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)

    def _walk(self, query: np.ndarray, wanted, bar, visit) -> None:
        """Best first: nodes by upper bound; a node's leaves wait as one group and are verified bound by bound.

        ``wanted(low, high, label)`` tells which nodes can still hold a row that is asked for, ``bar()`` the
        score below which nothing is, ``visit(positions)`` verifies rows.
        """
        heap: list[tuple] = []

        def offer(nodes: np.ndarray) -> None:
            low, high = self.bounds(query, nodes)
            good = wanted(low, high, self.label[nodes])
            nodes, low, high = nodes[good], low[good], high[good]
            leaf = self.leaf[nodes]
            for node, bound in zip(nodes[~leaf].tolist(), high[~leaf].tolist()):
                heapq.heappush(heap, (-bound, node, None))
            if leaf.any():
                order = np.argsort(-high[leaf], kind="stable")
                group = tuple(x[leaf][order] for x in (nodes, low, high))
                heapq.heappush(heap, (-float(group[2][0]), int(group[0][0]), group))

        if len(self.ids):
            offer(np.zeros(1, dtype=np.int64))
        while heap:
            bound, node, group = heapq.heappop(heap)
            if -bound < bar():
                return
            if group is None:
                offer(self.children[node])
                continue
            nodes, low, high = group
            good = wanted(low, high, self.label[nodes])
            nodes, low, high = nodes[good], low[good], high[good]
            take = max(1, int(np.searchsorted(np.cumsum(self.end[nodes] - self.begin[nodes]), VERIFIED, side="right")))
            if len(nodes):
                visit(self._rows(nodes[:take]))
            if len(nodes) > take:
                rest = nodes[take:], low[take:], high[take:]
                heapq.heappush(heap, (-float(rest[2][0]), int(rest[0][0]), rest))

    def positives(self, vector: np.ndarray, label: int, own_row: int, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """The best k rows of the label: (-score, id, position).  Rows below ``floor`` need not be found."""
        best: list[tuple[int, int, int]] = []
        beat = -np.inf if floor is None else float(floor)

        def wanted(low, high, labels):
            return (high >= beat) & ((labels == MIXED) | (labels == label))

        def visit(at):
            nonlocal best, beat
            at = at[(self.labels[at] == label) & (self.rows[at] != own_row)]
            best = self._merge(best, at, products(self.vectors[at], vector), k)
            if len(best) == k:
                beat = max(beat, -best[-1][0])

        self._walk(vector.astype(np.float64), wanted, lambda: beat, visit)
        return best

    def _merge(self, best: list[tuple[int, int, int]], at: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        if len(best) == k and len(at):
            good = score >= -best[-1][0]
            at, score = at[good], score[good]
        if not len(at):
            return best
        if len(at) > k:
            good = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[good], score[good]
            first = np.lexsort((self.ids[at], -score))[:k]
            at, score = at[first], score[first]
        return sorted(best + list(zip((-score).tolist(), self.ids[at].tolist(), at.tolist())))[:k]

    def windows(
        self, vector: np.ndarray, label: int, low: list[int], high: list[int], k: int
    ) -> list[list[tuple[int, int, int]]]:
        """For each window low..high of scores the best k rows of other labels: (-score, id, position)."""
        best: list[list[tuple[int, int, int]]] = [[] for _ in low]
        highs = np.array(high, dtype=np.int64)
        beat = np.array(low, dtype=np.float64)  # what a row of the window has to reach

        def wanted(low, high, labels):
            meets = ((high[:, None] >= beat) & (low[:, None] <= highs)).any(axis=1)
            return meets & (labels != label)

        def visit(at):
            score = products(self.vectors[at], vector)
            keep = (score >= beat.min()) & (score <= highs.max()) & (self.labels[at] != label)
            at, score = at[keep], score[keep]
            for w in range(len(best) if len(at) else 0):
                inside = (score >= beat[w]) & (score <= highs[w])
                if inside.any():
                    best[w] = self._merge(best[w], at[inside], score[inside], k)
                    if len(best[w]) == k:
                        beat[w] = max(beat[w], -best[w][-1][0])

        self._walk(vector.astype(np.float64), wanted, lambda: beat.min(), visit)
        return best


KEY = ["size", "route", "part"]
_LONGS, _DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
TREES = common.schema_of(
    *[(k, T.LongType()) for k in KEY], ("ids", _LONGS), ("rows", _LONGS), ("labels", _LONGS), ("vectors", _LONGS),
    ("centres", _DOUBLES), ("radius", _DOUBLES), ("begin", _LONGS), ("end", _LONGS), ("parent", _LONGS), ("label", _LONGS),
)


def sharded(vectors: DataFrame, shard_rows: int, routes: int) -> DataFrame:
    """``vectors`` with size, route (nearest routing vector of its size, -1 without one) and part."""
    n = vectors.count()
    wanted = min(routes, -(-n // shard_rows))
    # The bounded sample is cut by a threshold first, so few rows are sorted.
    draw = F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(1 << 40))
    few = vectors.where(draw <= int((1 << 40) * min(1.0, 4.0 * wanted / max(n, 1)))).orderBy(draw, "row").limit(wanted)
    chosen = [np.array(r.v, dtype=np.float64) for r in few.select("v").collect()]
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v) for v in chosen}:
        at = [i for i, v in enumerate(chosen) if len(v) == size]
        by_size[size] = np.array(at, dtype=np.int64), np.array([chosen[i] for i in at]).reshape(len(at), size)
    schema = common.schema_of(*vectors.schema.fields, ("size", T.LongType()), ("route", T.LongType()))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            route = np.full(batch.num_rows, -1, dtype=np.int64)
            for size in np.unique(sizes).tolist():
                if size in by_size:
                    some = np.flatnonzero(sizes == size)
                    x = matrix(v.take(pa.array(some)), size).astype(np.float64)
                    names, points = by_size[size]
                    route[some] = names[((points * points).sum(axis=1) - 2.0 * (x @ points.T)).argmin(axis=1)]
            yield common.record_batch([*batch.columns, sizes, route], schema)

        return step

    routed = sink.materialize(common.map_batches(vectors, schema, start), "routed")
    counts = {r.route: r.n for r in routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as routes
    parts = F.element_at(F.array(*[F.lit(-(-counts.get(i, 1) // shard_rows)) for i in range(-1, len(chosen))]), (F.col("route") + 2).cast("int"))
    return routed.withColumn("part", F.pmod(F.xxhash64(F.lit(13), "row"), parts.cast("long")))


def trees_of(placed: DataFrame, most: float) -> DataFrame:
    """One row per shard: its rows in tree order and the nodes of its tree."""

    def build(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        x = matrix(table.column("v").combine_chunks(), size)
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        s = Shard.build(ids, table.column("row").to_numpy(), table.column("label").to_numpy(), x, most)
        nodes = [s.centres.ravel(), s.radius, s.begin, s.end, s.parent, s.label]
        rows = [s.ids, s.rows, s.labels, s.vectors.astype(np.int64).ravel(), *nodes]
        key = [[table.column(k)[0].as_py()] for k in KEY]
        return pa.Table.from_batches([common.record_batch([*key, *([r.tolist()] for r in rows)], TREES)])

    columns = [*KEY, "vec_id", "label", "v", "row"]
    return sink.materialize(placed.select(*columns).groupBy(*KEY).applyInArrow(build, TREES), "cover-trees")


def shard_of(table: pa.Table, most: float) -> Shard:
    """A shard from its written row."""

    def values(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    size, n, nodes = table.column("size")[0].as_py(), len(values("ids")), len(values("radius"))
    vectors = values("vectors").reshape(n, size)
    big = float(np.abs(vectors.astype(np.float64)).max(initial=0.0))
    if big * big * max(size, 1) < EXACT:
        vectors = vectors.astype(np.float64)
    centres = values("centres").reshape(nodes, size + 1)
    tree = [values(c) for c in ("radius", "begin", "end", "parent", "label")]
    return Shard(values("ids"), values("rows"), values("labels"), vectors, most, centres, *tree)


def _reach(anchors: DataFrame, trees: DataFrame, most: float, lows: str, highs: str | None) -> DataFrame:
    """Anchors once for every shard whose root ball can hold a score in one of their windows.

    ``lows`` and ``highs`` name array columns, a window each; without ``highs`` windows are open above.
    """
    n = trees.count()
    parts = max(1, -(-2 * n // ROOTS)) if n > ROOTS else 1
    schema = common.schema_of(*[f for f in anchors.schema.fields if f.name not in KEY], *[(k, T.LongType()) for k in KEY])
    out = anchors.sparkSession.createDataFrame([], schema)
    for part in range(parts):
        here = trees.where(F.pmod(F.xxhash64(*KEY), F.lit(parts)) == part)
        roots = here.select(*KEY, F.slice("centres", F.lit(1), (F.col("size") + 1).cast("int")).alias("c"), F.col("radius")[0].alias("r")).collect()
        by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {r.size for r in roots}:
            mine = [r for r in roots if r.size == size]
            centres = np.array([r.c for r in mine], dtype=np.float64).reshape(len(mine), size + 1)
            by_size[size] = np.array([[size, r.route, r.part] for r in mine], dtype=np.int64), centres[:, :-1], np.array([r.r for r in mine])

        def start(by_size=by_size):
            def found(batch: pa.RecordBatch, at: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
                key = np.concatenate(keys)
                take = pa.array(np.repeat(at, [len(x) for x in keys]))
                same = [batch.column(f.name).take(take) for f in schema.fields[: -len(KEY)]]
                return common.record_batch([*same, key[:, 0], key[:, 1], key[:, 2]], schema)

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                rows: list[int] = []
                keys: list[np.ndarray] = []
                v = batch.column("v")
                sizes = v.value_lengths().to_numpy(zero_copy_only=False)
                for at, size in enumerate(sizes.tolist()):
                    if size not in by_size:
                        continue
                    names, centres, radius = by_size[size]
                    q = v[at].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    low, high = product_bounds(q @ q, most, centres @ q, radius)
                    near = np.zeros(len(names), dtype=bool)
                    ends = [None] * len(batch.column(lows)[at]) if highs is None else batch.column(highs)[at].as_py()
                    for a, b in zip(batch.column(lows)[at].as_py(), ends):
                        near |= (high >= a) & (True if b is None else low <= b)
                    rows.append(at)
                    keys.append(names[near])
                    if sum(map(len, keys)) >= OUT_ROWS:
                        yield found(batch, rows, keys)
                        rows, keys = [], []
                if rows:
                    yield found(batch, rows, keys)

            return step

        out = out.unionByName(common.map_batches(anchors, schema, start))
    return out


def _meet(asked: DataFrame, trees: DataFrame, blocks: int, most: float, visit, schema: T.StructType) -> DataFrame:
    """Every (anchor, shard) row of ``asked`` with its shard; ``visit(shard, table)`` gives the columns of ``schema``."""
    block = F.pmod(F.xxhash64("anchor_row"), F.lit(blocks)).cast("int").alias("block")
    given = trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = visit(shard_of(right, most), left) if left.num_rows and right.num_rows else [[] for _ in schema]
        return pa.Table.from_batches([common.record_batch(columns, schema)])

    groups = [*KEY, "block"]
    return asked.select("*", block).groupBy(*groups).cogroup(given.groupBy(*groups)).applyInArrow(search, schema)


_FOUND = [("vec_id", T.LongType()), ("score", T.LongType())]


def _positives(asked: DataFrame, trees: DataFrame, blocks: int, most: float, k: int) -> DataFrame:
    """(anchor_row, vec_id, score): the k best of every asked shard."""
    schema = common.schema_of(("anchor_row", T.LongType()), *_FOUND)

    def visit(shard: Shard, left: pa.Table):
        out: list[list] = [[], [], []]
        v = left.column("v").combine_chunks()
        x = matrix(v, len(v[0]))
        for at, (row, label, floor) in enumerate(zip(*(left.column(c).to_pylist() for c in ("anchor_row", "label", "floor")))):
            best = shard.positives(x[at], label, row, k, floor)
            out[0] += [row] * len(best)
            out[1] += [None if i == NO_ID else i for _, i, _ in best]
            out[2] += [-s for s, _, _ in best]
        return out

    return _meet(asked, trees, blocks, most, visit, schema)


def _negatives(asked: DataFrame, trees: DataFrame, blocks: int, most: float, k: int) -> DataFrame:
    """(anchor_row, place, vec_id, score): the k best of every window and asked shard."""
    schema = common.schema_of(("anchor_row", T.LongType()), ("place", T.IntegerType()), *_FOUND)

    def visit(shard: Shard, left: pa.Table):
        out: list[list] = [[], [], [], []]
        v = left.column("v").combine_chunks()
        x = matrix(v, len(v[0]))
        columns = (left.column(c).to_pylist() for c in ("anchor_row", "label", "places", "lows", "highs"))
        for at, (row, label, places, lows, highs) in enumerate(zip(*columns)):
            for place, best in zip(places, shard.windows(x[at], label, lows, highs, k)):
                out[0] += [row] * len(best)
                out[1] += [place] * len(best)
                out[2] += [None if i == NO_ID else i for _, i, _ in best]
                out[3] += [-s for s, _, _ in best]
        return out

    return _meet(asked, trees, blocks, most, visit, schema)


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k best rows per key, ``name`` counting from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn(name, F.row_number().over(order).cast("int")).where(F.col(name) <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = TOP,
    scale: int = SCALE,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    routes: int = ROUTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an expression on the columns of ``df``.
    """
    vectors = sink.materialize(quantized(df, id_col, vector_col, label, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = float(vectors.agg(F.max(norm)).first()[0] or 0.0)
    placed = sink.materialize(sharded(vectors, shard_rows, routes), "placed")
    trees = trees_of(placed, most)
    anchors = placed.where(F.col("vec_id").isNotNull()).where(is_anchor)
    anchors = sink.materialize(
        anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "v", *KEY), "anchors"
    )
    blocks = max(1, -(-anchors.count() // anchor_rows))

    # The k-th best score in the own shard is what others have to reach.
    own = _positives(anchors.withColumn("floor", F.lit(None).cast("long")), trees, 1, most, k)
    floors = own.groupBy("anchor_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    walkers = sink.materialize(anchors.drop(*KEY).join(sink.materialize(floors, "floors"), "anchor_row", "left"), "walkers")
    asked = walkers.withColumn("lows", F.array(F.coalesce("floor", F.lit(-(1 << 62)))))
    near = _positives(_reach(asked, trees, most, "lows", None), trees, blocks, most, k)
    positives = sink.materialize(_first(near, ["anchor_row"], k, "place"), "positives")

    # Windows in whole numbers: low_percent * p <= 100 * n <= high_percent * p.  Empty ones have no rows.
    def whole(x: Column) -> Column:
        return F.call_function("div", x, F.lit(100))

    least, most_of = F.col("score") * low_percent, F.col("score") * high_percent
    window = F.struct(
        F.col("place"),
        whole(least + F.pmod(-least, F.lit(100))).alias("low"),
        whole(most_of - F.pmod(most_of, F.lit(100))).alias("high"),
    ).alias("w")
    listed = positives.select("anchor_row", window).where("w.low <= w.high").groupBy("anchor_row").agg(F.collect_list("w").alias("w"))
    asked = walkers.drop("floor").join(listed, "anchor_row").select(
        "*", F.col("w.place").alias("places"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    ).drop("w")
    asked = sink.materialize(asked, "windows")
    found = _negatives(_reach(asked, trees, most, "lows", "highs"), trees, blocks, most, k)
    ranked = _first(found, ["anchor_row", "place"], k, "rank").select(
        "anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = positives.join(anchors.select("anchor_row", "anchor_id"), "anchor_row").select(
        "anchor_row", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return named.join(ranked, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
