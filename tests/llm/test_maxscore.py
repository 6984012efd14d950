from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from segflux.llm import maxscore
from segflux.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, chosen, k=5):
    """rows: (vec_id, vector)"""
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (q, qv) in enumerate(usable):
        if q is None or not chosen(q) or not qv:
            continue
        scores = [(-sum(x * y for x, y in zip(qv, v)), i is None, i) for b, (i, v) in enumerate(usable) if b != a and len(v) == len(qv)]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(QUERIES["op3_maxscore_top_k"](spark, sf)) == brute(rows, lambda i: i % 50 == 0)


def test_query_equals_its_sql(spark):
    import duckdb

    from segflux.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    wanted = con.execute(ORACLES["op3_maxscore_top_k"]).fetchall()
    assert found(QUERIES["op3_maxscore_top_k"](spark, "/root/testdata/sf0.01")) == sorted(wanted, key=str)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 10)
    rng = np.random.default_rng(4)
    same = [float(x) for x in rng.normal(0, 0.2, 16)]
    rows = [(i, same if i % 3 == 0 else [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert found(maxscore.top_k(df, F.col("vec_id") % 7 == 0)) == brute(rows, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25]), (0, [0.5, 0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, []),
        (10, [0.5, 0.25]), (11, [0.1]), (20, [0.2]), (None, [0.5, 0.25]), (30, [0.0, 0.0]), (40, [-0.001, 0.001]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert found(maxscore.top_k(df, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)
    assert found(maxscore.top_k(df.limit(0), F.col("vec_id") % 10 == 0)) == []


def test_shard_prunes_but_stays_exact():
    rng = np.random.default_rng(8)
    vectors = np.floor(rng.normal(0, 20, (3000, 64))).astype(np.int64)
    vectors[:, 10:] //= 16  # a few strong terms
    shard = maxscore.Shard(np.arange(3000), np.arange(3000), vectors)
    for q in range(0, 3000, 100):
        at, score = shard.top(vectors[q], q, 5)
        full = vectors @ vectors[q]
        wanted = [i for i in np.lexsort((np.arange(3000), -full)).tolist() if i != q][:5]
        assert at.tolist() == wanted and score.tolist() == full[wanted].tolist()
