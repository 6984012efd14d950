from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from segflux.llm import lexical
from segflux.llm.queries import ORACLES, QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(rows, items, k=10):
    """(item_id, rank, doc_id, score) by the definition."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    full = [c for _, c in counts if c]
    n_all, l_all = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c in counts:
            if not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n_all) // l_all
            score = 0
            for t, repeats in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query(spark, documents):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = QUERIES["op12_aho_corasick_search"](spark, sf)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert found(df) == brute([(r.doc_id, r.text) for r in documents.collect()], items)


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.execute(ORACLES["op12_aho_corasick_search"]).fetchall()
    assert found(QUERIES["op12_aho_corasick_search"](spark, sf)) == sorted(wanted, key=str) != []


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "aba", "The", "the", "x9", "9", "é", "Éa", "日本", "İ", "i̇", "no\x00w", "q\x7fr", "it's", "z" * 300]
    words += [f"w{i}" for i in range(60)]

    def text(size):
        return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", "-", "\t", "_", "@"]) for _ in range(size))

    rows = [(i, text(rng.randrange(0, 30))) for i in range(n)]
    rows += [(7, rows[7][1]), (8, "the the"), (None, "w1 w2 w3"), (None, None), (n, ""), (n + 1, " ,.;"), (n + 2, "w5 " * 20_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)]
    return rows, items + [(3, items[3][1]), (90, None), (91, ""), (92, "..."), (None, "w1 w2"), (93, "never seen"), (94, "w5")]


@pytest.mark.parametrize("limits", [{}, {"term_bytes": 300, "item_postings": 20}])
def test_random_texts(spark, monkeypatch, limits):
    """One part and one block, then many of both; small cells so that sums are cut."""
    if limits:
        monkeypatch.setattr(lexical, "CELLS", 64)
    rows, items = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical.search(df, asked, **limits)) == brute(rows, items)


def test_edge_rows(spark, edge, empty):
    items = [(1, "short no id"), (2, "lorem"), (3, "zero b ñandú")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, term int")
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert found(lexical.search(edge, asked)) == brute(rows, items)
    assert found(lexical.search(empty, asked)) == []
    assert found(lexical.search(edge, asked.limit(0))) == []


def test_named_items(spark, edge):
    asked = spark.createDataFrame([("one", "short")], "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert found(lexical.search(edge, asked)) == brute(rows, [("one", "short")])


def test_guards_keep_terms_whole():
    machine = lexical.automaton([(0, b"a"), (1, b"ab"), (2, b"b"), (3, "é".encode())])
    n, counts = lexical.count_terms("ab a,b abc cab É é a-ab".encode(), machine)
    assert n == 9 and counts == {0: 2, 1: 2, 2: 1, 3: 1}
