from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflux.llm import cover_tree
from segflux.llm.queries import ORACLES, QUERIES

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, route string"


def order(x):
    return (-x[0], x[1] is None, x[1] or 0)


def brute(rows, k=5, every=100):
    """rows: (vec_id, vector, label), by the definition."""
    usable = []
    for i, v, label in rows:
        if label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, (anchor, q, label) in enumerate(usable):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, l == label) for b, (i, v, l) in enumerate(usable) if b != a and len(v) == len(q)]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:k]:
            fits = sorted((s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:k]
            out += [(anchor, pid, r + 1, n, p, score) for r, (score, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def mine(df, every=100, **limits):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return found(cover_tree.hard_negatives(df, F.col("vec_id") % every == 0, moved, **limits))


def test_query_equals_brute_force_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    wanted = con.execute(ORACLES["op11_cover_tree_negatives"]).fetchall()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op11_cover_tree_negatives"](spark, sf)
    assert df.dtypes == [(c, "int" if c == "rank" else "bigint") for c in COLUMNS]
    assert found(df) == sorted(wanted, key=str) == brute(rows) != []


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 40, "anchor_rows": 7, "routes": 8}])
def test_clusters_ties_and_a_very_common_vector(spark, monkeypatch, limits):
    """A third of the rows hold one vector; the rest lie in clusters with many equal scores."""
    if limits:
        monkeypatch.setattr(cover_tree, "ROOTS", 5)
        monkeypatch.setattr(cover_tree, "LEAF_ROWS", 3)
        monkeypatch.setattr(cover_tree, "VERIFIED", 6)
        monkeypatch.setattr(cover_tree, "OUT_ROWS", 4)
    rng = np.random.default_rng(4)
    common = [0.25] * 8
    heads = rng.normal(0, 0.5, (6, 8))
    rows = [(i, common if i % 3 == 0 else [float(x) for x in np.round(heads[i % 6] + rng.normal(0, 0.05, 8), 2)], i % 5) for i in range(500)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert mine(df, 10, **limits) == brute(rows, every=10) != []


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], 2), (4, [None, 1.0], 2),
        (5, [], 3), (10, [0.5, 0.25], None), (11, [0.1], 2), (20, [0.2], 2), (None, [0.5, 0.25], 2), (30, [0.0, 0.0], 2), (40, [-0.5, 0.25], 2),
        (50, [0.5, 0.2], 2), (60, [0.5, 0.24], 1), (62, [0.5, 0.24], 2), (62, [0.5, 0.24], 2), (80, [-0.5, -0.2], 1), (None, [0.5, 0.25], 1),
        (90, [], 1), (91, [], 1), (92, [], 2),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    assert mine(df, 10) == brute(rows, every=10) != []
    assert mine(df.limit(0), 10) == []
    assert mine(df.where("vec_id = 0"), 10) == []


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_tree_covers_separates_and_bounds(dims):
    rng = np.random.default_rng(dims)
    vectors = np.floor(rng.normal(0, 40, (900, dims)))
    vectors[::4] = vectors[0]
    most = float((vectors**2).sum(axis=1).max())
    labels = rng.integers(0, 3, 900)
    tree = cover_tree.CoverTree(cover_tree.lifted(vectors, most), labels, most)
    shard = cover_tree.Shard.build(np.arange(900), np.arange(900), labels, vectors, most)
    assert sorted(shard.ids.tolist()) == list(range(900))
    nodes = np.arange(len(shard.radius))
    query = np.floor(rng.normal(0, 40, dims))
    low, high = shard.bounds(query, nodes)
    scores = shard.vectors @ query
    for node in nodes.tolist():
        inside = slice(shard.begin[node], shard.end[node])
        assert low[node] <= scores[inside].min() and scores[inside].max() <= high[node]
        kids = shard.children[node]
        if len(kids):
            assert sorted((int(shard.begin[c]), int(shard.end[c])) for c in kids)[0][0] == shard.begin[node]
            assert sum(int(shard.end[c] - shard.begin[c]) for c in kids) == shard.end[node] - shard.begin[node]
            heads = tree.points[[tree.centre[c] for c in kids]]
            gaps = np.linalg.norm(heads[:, None] - heads[None], axis=2)[np.triu_indices(len(kids), 1)]
            assert len(kids) == 1 or gaps.min() > 0.9 * max(shard.radius[c] for c in kids) / 1.1


def test_walks_skip_nodes(monkeypatch):
    """In clustered data most leaves are never verified."""
    rng = np.random.default_rng(2)
    heads = rng.normal(0, 200, (60, 16))
    vectors = np.floor(heads[rng.integers(0, 60, 4000)] + rng.normal(0, 4, (4000, 16)))
    labels = rng.integers(0, 4, 4000)
    most = float((vectors**2).sum(axis=1).max())
    shard = cover_tree.Shard.build(np.arange(4000), np.arange(4000), labels, vectors, most)
    seen = []
    rows = cover_tree.Shard._rows
    monkeypatch.setattr(cover_tree, "VERIFIED", 64)
    monkeypatch.setattr(cover_tree.Shard, "_rows", lambda self, leaves: seen.append(rows(self, leaves)) or seen[-1])
    at = int(np.flatnonzero(shard.rows == 0)[0])
    best = shard.positives(shard.vectors[at], int(shard.labels[at]), 0, 5, None)
    full = shard.vectors @ shard.vectors[at]
    same = [i for i in np.lexsort((shard.ids, -full)) if shard.labels[i] == shard.labels[at] and i != at][:5]
    assert [p for _, _, p in best] == [int(i) for i in same]
    assert sum(map(len, seen)) < 1000
    seen.clear()
    high = int(full[same[0]])
    found, = shard.windows(shard.vectors[at], int(shard.labels[at]), [high * 8 // 10], [high], 5)
    other = [i for i in np.lexsort((shard.ids, -full)) if shard.labels[i] != shard.labels[at] and high * 8 // 10 <= full[i] <= high][:5]
    assert [p for _, _, p in found] == [int(i) for i in other] and sum(map(len, seen)) < 1000
