from __future__ import annotations

import hashlib
import random
import sys
from collections import defaultdict

import numpy as np

from segflux.llm import induced_sort, suffix_dedup


def brute(rows, length):
    """Count every string of ``length`` bytes, then mark what repeats."""
    texts = [(t or "").encode() for _, t in rows]
    starts = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            starts[t[i : i + length]] += 1
    out = []
    for (doc, _), t in zip(rows, texts):
        hit = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit)[: len(t)] > 0
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(doc), len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df, **options):
    found = suffix_dedup.remove_repeats(df, **options).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def text_of(rnd, n):
    return "".join(rnd.choice(["on", "er", "the ", "st", "é", "a", ". "]) for _ in range(n))


def planted(seed):
    rnd = random.Random(seed)
    passages = [text_of(rnd, n) for n in (260, 300, 900, 240)]
    rows = []
    for i in range(60):
        parts = [text_of(rnd, rnd.randint(5, 300))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 2)
            parts += [p[cut : cut + rnd.randint(100, 1000)], text_of(rnd, rnd.randint(1, 200))]
        rows.append((i, "".join(parts)))
    near = list(rows[5][1])
    near[len(near) // 2] = "#"
    rows += [(100, rows[3][1]), (101, "".join(near)), (102, "ab" * 500), (103, "z" * 1300), (104, "z" * 401), (105, "q" * 400)]
    return rows


def test_suffix_order_equals_sorting():
    rnd = random.Random(7)
    for _ in range(400):
        letters = rnd.choice([2, 3, 9, 250])
        s = np.array([rnd.randint(1, letters) for _ in range(rnd.randint(0, 80))] + [0])
        sa = induced_sort.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        prefix = induced_sort.permuted_prefixes(s, sa, 1000, np.array([0]))
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert prefix[a] == n


def test_deep_repeats_are_ordered():
    rnd = random.Random(11)
    for _ in range(100):
        part = [rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))]
        s = np.array([2] * rnd.randint(0, 2) + part * rnd.randint(2, 20) + [1] + part * rnd.randint(2, 20) + [0])
        assert induced_sort.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_names_are_not_sorted_one_by_one():
    """Python runs per bucket and round of a shard, not per name."""
    rnd = random.Random(5)
    text = text_of(rnd, 30_000)
    s = np.frombuffer((text[:20_000] + text).encode() + b"\x00", dtype=np.uint8).astype(np.int64)
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != induced_sort.__file__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = induced_sort.suffix_array(s)
    finally:
        sys.settrace(before)
    assert sorted(sa.tolist()) == list(range(len(s)))
    assert lines < len(s) // 10


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = brute(rows, 400)
    assert sum(w[2] for w in wanted) > 10_000
    assert result(documents) == wanted


def test_planted_passages_and_full_routes(spark):
    for seed in (1, 2):
        rows = planted(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        wanted = brute(rows, 400)
        assert result(df) == wanted
        assert result(df, route_segments=2) == wanted


def test_edge_rows(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    long = max((t or "" for _, t in rows), key=len)
    got = result(edge)
    assert [g for g in got if g[0] != "5"] == [w for w in brute([r for r in rows if r[1] != long], 400)]
    # The long text repeats with a short period: all of it goes.
    assert [g[1:4] for g in got if g[0] == "5"] == [(len(long), len(long), 1)]
    assert result(empty) == []
