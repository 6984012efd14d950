from __future__ import annotations

import hashlib
import re

from segflux.llm import decontam
from segflux.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = patterns.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        names = sorted(str(x) for x in found)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def table(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def summary(found):
    return sorted(
        (str(r.doc_id), r.n_words, r.n_hit, len(r.items), decontam.digest(r.items), r.contaminated) for r in found.collect()
    )


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    items = table(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
    found = QUERIES["op10_wu_manber_decontamination"](spark, sf).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == brute(docs, items)
    assert sum(r[5] for r in got) > 5


def small_case(spark):
    items = [
        (1, "the quick brown fox jumps over the lazy dog and then it sleeps for a while"), (2, "Short item"), (3, "one"),
        (4, None), (5, ""), (6, "Short item"), (None, "never named words"), (7, "aa aa aa aa aa aa aa aa aa aa aa aa aa aa aa"),
    ]
    docs = [
        (1, "x The QUICK brown fox; jumps over the lazy dog and then it sleeps, for a while y"), (2, "a short-item here"),
        (3, None), (4, ""), (5, "one " * 50), (6, "aa " * 40), (7, "über one naïve"), (8, "never named words" + " z" * 80),
        (8, "never named words" + " z" * 80), (None, "short item"),
    ]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS items"),
        spark.createDataFrame(items, "item_id long, text string"),
        docs,
        items,
    )


def test_short_items_overlaps_and_odd_rows(spark):
    docs, items, d, i = small_case(spark)
    wanted = brute(d, i)
    # An item without an id counts its words but has no name.
    got = summary(decontam.contamination(docs, items))
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in wanted]
    assert [g for g in got if g[0] != "8"] == [w for w in wanted if w[0] != "8"]
    assert {g[3] for g in got if g[0] == "8"} == {0}


def test_a_large_benchmark_is_searched_in_parts(spark):
    docs, items, _, _ = small_case(spark)
    whole = summary(decontam.contamination(docs, items))
    assert summary(decontam.contamination(docs, items, benchmark_bytes=64)) == whole
    kept = decontam.keep_clean(docs, items)
    parts = decontam.keep_clean(docs, items, benchmark_bytes=64)
    assert kept.columns == docs.columns == parts.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, parts.collect()))
    assert kept.count() == sum(not r[5] for r in whole)


def test_empty_tables(spark, edge, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination(edge, benchmark).collect())
    assert decontam.contamination(edge, benchmark).count() == edge.count()
    assert decontam.contamination(empty, benchmark).collect() == []


def test_matcher_skips(monkeypatch):
    words_in = [f"w{i}".encode() for i in range(13)]
    matcher = decontam.Matcher([(1, b" ".join(words_in))])
    (_, _, shift, buckets), = matcher.tables
    assert min(shift.values()) == 0 and max(shift.values()) == 11 and len(buckets) == 1
    text = [b"z"] * 1000 + words_in + [b"z"] * 5
    assert matcher.search(text) == ([(1000, 1013)], {1})
