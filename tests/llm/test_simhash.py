from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash

from segflux.llm import simhash
from segflux.llm.components import components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint) -> component of each row."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(a ^ b).count("1") <= 2:
            parent[find(a)] = find(b)
    low = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            low[r] = min(low.get(r, d), d)
    return [low.get(find(f)) for _, f in rows]


def check(df):
    found = simhash.near_duplicates(df).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    wanted = sorted(((str(d), f, str(c)) for (d, f), c in zip(rows, plain_components(rows))))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found) == wanted


def test_documents(documents):
    check(documents)


def test_edge_rows(edge, empty):
    check(edge)
    assert simhash.near_duplicates(empty).collect() == []


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    out = set(base.tolist())
    for x in base[: n // 2].tolist():
        for _ in range(3):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            out.add(x ^ sum(1 << int(b) for b in bits))
    return sorted(out)


def near_pairs(values, radius=2):
    arr = np.array(values, dtype=np.uint64)
    out = set()
    for i, v in enumerate(values):
        d = np.bitwise_count(arr[i + 1 :] ^ np.uint64(v))
        out |= {(v, values[i + 1 + j]) for j in np.flatnonzero(d <= radius).tolist()}
    return out


def links_of(spark, values, **options):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    rows = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), **options).collect()
    pairs = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in rows]
    assert len(pairs) == len(set(pairs))  # every pair once
    return set(pairs)


def test_links_equal_brute_force(spark):
    values = planted(600, 1)
    wanted = near_pairs(values)
    assert len(wanted) > 300
    assert links_of(spark, values) == wanted


def test_full_buckets_are_filed_anew(spark):
    rng = np.random.default_rng(2)
    # Most fingerprints share their upper half, so one bucket of the first filing holds them.
    values = sorted({(0xABCDEF01 << 32) | int(x) for x in rng.integers(0, 1 << 14, 900)} | set(planted(100, 3)))
    wanted = near_pairs(values)
    assert len(wanted) > 1000
    assert links_of(spark, values, bucket_rows=50) == wanted == links_of(spark, values)


def test_other_radius(spark):
    values = planted(300, 5)
    assert links_of(spark, values, radius=3) == near_pairs(values, 3)


def test_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
