from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from segflux.llm import exact_dedup
from segflux.llm.queries import ORACLES, QUERIES

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(doc_id, keep_id, group_size, sha256) of every row, and the number of rows kept by text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known, default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(df, rows):
    found = df.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("h"), "kept").collect()
    wanted, texts = brute(rows)
    assert sorted((tuple(r[:4]) for r in found), key=str) == wanted
    kept = [r for r in found if r.kept]
    assert len(kept) == texts == len({r.h for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_query(spark, documents):
    found = QUERIES["op13_skew_safe_exact_dedup"](spark, "/root/testdata/sf0.001")
    wanted, texts = brute([(r.doc_id, r.text) for r in documents.collect()])
    rows = found.collect()
    assert found.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == sorted(wanted)
    assert sum(r.kept for r in rows) == texts and all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(ORACLES["op13_skew_safe_exact_dedup"])
    names = [d[0] for d in cur.description]
    found = QUERIES["op13_skew_safe_exact_dedup"](spark, "/root/testdata/sf0.01")
    assert found.columns == names
    assert sorted(map(tuple, found.collect())) == sorted(cur.fetchall())


def test_edge_rows(spark, edge, empty):
    check(exact_dedup.duplicates(edge), [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    assert exact_dedup.duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(edge).count() == brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])[1]


def test_only_ascii_letters_fold(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "K"), (5, "K"), (6, "k"), (7, "İ"), (8, "i"), (9, ""), (10, None)]
    check(exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_hot_text_over_many_partitions(spark):
    rows = [(i, "A hot text" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)] + [(None, "a HOT text"), (2997, "a hot text")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    check(exact_dedup.duplicates(df, least_hot=2, hot_share=50, salts=5), rows)
    check(exact_dedup.duplicates(df), rows)


@pytest.mark.parametrize("least_hot", [1, 10_000])
def test_colliding_digests_never_merge_texts(spark, least_hot):
    """Digests cut to 2 bits: every digest is shared by many texts."""
    rows = [(i, f"Text {i % 40}") for i in range(400)] + [(None, "text 3"), (5, "text 5"), (5, "TEXT 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def weak(text):
        return F.pmod(F.xxhash64(text), F.lit(4)).cast("string").cast("binary")

    found = exact_dedup.duplicates(df, digest=weak, least_hot=least_hot).collect()
    wanted, texts = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == sorted((w[:3] for w in wanted), key=str)
    assert sum(r.kept for r in found) == texts


def test_no_python_in_the_plan(spark, documents):
    plan = exact_dedup.duplicates(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
