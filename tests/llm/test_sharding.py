from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from segflux.llm import sharding
from segflux.llm.queries import QUERIES


def check(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark, small, documents):
    rows = QUERIES["op2_external_shuffle"](spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    check(rows, len(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)


def test_order_is_mixed(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    rows = sharding.with_slots(sharding.write_shards(df, 4, bucket_bytes=20_000)).collect()
    check(rows, 4000)
    assert len({(r.shard, r.bucket) for r in rows}) == 20
    assert max(Counter(r.shard for r in rows).values()) < 1150
    one = [r.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    rises = sum(a < b for a, b in zip(one, one[1:]))
    assert 0.42 < rises / len(one) < 0.58


def test_shard_count_only_moves_into_the_new_shard(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    few = {r.doc_id: r for r in sharding.scatter(df, 5, 1, "doc_id", 1).collect()}
    more = {r.doc_id: r.shard for r in sharding.scatter(df, 6, 1, "doc_id", 1).collect()}
    assert all(more[d] == r.grown_shard and more[d] in (r.shard, 5) for d, r in few.items())
    assert 350 < sum(s == 5 for s in more.values()) < 650


def test_edge_rows_and_clashing_columns(edge, empty):
    rows = sharding.with_slots(sharding.write_shards(edge, 3)).collect()
    check(rows, edge.count())
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(r.doc_id), r.text or "") for r in edge.collect())
    assert all(r.source == "src" and r.score == 1.5 for r in rows)
    assert sharding.with_slots(sharding.write_shards(empty, 3)).collect() == []


def test_many_rows_of_one_id_use_many_buckets(spark):
    df = spark.range(2000).selectExpr("CAST(1 AS bigint) AS doc_id", "repeat('y', 100) AS text")
    rows = sharding.write_shards(df, 2, bucket_bytes=10_000).collect()
    assert len({r.shard for r in rows}) == 1 and max(Counter(r.bucket for r in rows).values()) < 400


def test_null_texts_fill_buckets_too(spark):
    """Buckets are sized by rows as well as by text: none takes a large part of a table without text."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    written = sharding.write_shards(df, 4, bucket_rows=500)
    sizes = [r["count"] for r in written.groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) == 80 and max(sizes) < 1000
