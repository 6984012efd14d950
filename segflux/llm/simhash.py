"""Near duplicates by SimHash, compared bit-sliced.

A fingerprint has bit ``i`` set when more than half of the hashes of a text's word shingles have.
Texts with equal fingerprints collapse first.  Two fingerprints within ``radius`` bits agree in at
least two of ``radius + 2`` blocks of bits, so each is filed under every pair of its blocks; pairs of
blocks that fill up are filed anew by parts of the remaining bits, where again one part must agree.
What meets in a bucket is compared bit-sliced:

* a block of up to 64 fingerprints is stored vertically, one 64-bit word per bit plane;
* a query flips the planes whose bit it has set, and carry-save counters add the planes up for all
  64 lanes at once;
* a query leaves a block as soon as every lane has exceeded the radius.

A bucket of the second filing holds distinct fingerprints that share all but some 22 bits, so its
size is bounded whatever the data.  Every pair is reported by the first bucket that holds it.

Defined results: null and empty texts, and texts of separators, have fingerprint 0 and link like
any other; fewer words than a shingle takes give one shingle of all words; equal rows share a
component; a component of rows without any id has a null id; an empty table gives no rows; extra
columns are never read.  Texts of any length are used whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.llm.components import components
from segflux.sources import sink

SHINGLE, RADIUS, HASH_SEED = 3, 2, 42
BITS = 64
BUCKET_ROWS = 2048
"""Fingerprints a bucket of the first filing may hold before it is filed anew."""
SECOND_PARTS = 3

# Capital letters to small ones; all separators to a space.
_FOLD = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> list[int]:
    """Hashes of all word shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.translate(_FOLD).split()
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    return [
        xxh64_intdigest(joined[a:b], seed) for a, b in zip(itertools.chain((0,), (e + 1 for e in ends)), ends[shingle - 1 :])
    ]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    hashes = shingle_hashes(text, shingle, seed)
    if not hashes:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = HASH_SEED
) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""
    docs = common.keyed_text(df, id_col, text_col)
    schema = common.schema_of(*common.fields(docs, "doc_id"), ("fp", T.LongType()))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                found = [fingerprint(t, shingle, seed) for t in common.strings(part.column("text"))]
                yield common.record_batch([part.column("doc_id"), np.array(found, dtype=np.uint64).view(np.int64)], schema)

        return step

    return common.map_batches(docs, schema, start)


def blocks(count: int, low: int = 0, high: int = BITS) -> list[tuple[int, int]]:
    """``count`` ranges of bits (from, width) that cover low to high."""
    edges = [low + (high - low) * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def masks(radius: int) -> list[int]:
    """One mask per pair of blocks: the bits of a first-filing key."""
    def mask(a, w):
        return ((1 << w) - 1) << a

    return [mask(*x) | mask(*y) for x, y in itertools.combinations(blocks(radius + 2), 2)]


def second_masks(first: int, parts: int) -> list[int]:
    """Splits of the bits outside a first-filing key, one mask per part."""
    free = [b for b in range(BITS) if not first >> b & 1]
    return [sum(1 << b for b in free[a : a + w]) for a, w in blocks(parts, 0, len(free))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints with equal keys (sorted) within the radius.

    Equal fingerprints do not occur inside a bucket.
    """
    same = np.all(key[1:] == key[:-1], axis=1)
    company = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same))) if len(fp) else np.zeros(0, int)
    if len(company) < len(fp):  # buckets of one have nothing to compare
        i, j = bucket_links(key[company], fp[company], radius)
        return company[i], company[j]
    n = len(fp)
    begins = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1)))) if n else np.zeros(0, int)
    sizes = np.diff(np.concatenate((begins, [n])))
    inside = np.arange(n) - np.repeat(begins, sizes)
    # Blocks of up to 64 lanes: the first block of each bucket, and how many it has.
    per_bucket = -(-sizes // 64)
    first_block = np.cumsum(per_bucket) - per_bucket
    block = np.repeat(first_block, sizes) + inside // 64
    lane = (inside % 64).astype(np.uint64)
    total = int(per_bucket.sum())
    edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if n else np.zeros(0, int)
    one = np.uint64(1)
    planes = np.empty((BITS, total), dtype=np.uint64)
    for b in range(BITS):
        planes[b] = np.bitwise_or.reduceat(((fp >> np.uint64(b)) & one) << lane, edge) if n else 0
    filled = np.bitwise_or.reduceat(one << lane, edge) if n else np.zeros(0, np.uint64)
    last_block = np.repeat(first_block + per_bucket, sizes)
    low, high = [], []
    # Every fingerprint asks its own block (lanes after its own) and the later ones of its bucket.
    asking, asked = np.arange(n), block.copy()
    step = 0
    while len(asking):
        for at in range(0, len(asking), 1 << 15):
            q, blk = asking[at : at + (1 << 15)], asked[at : at + (1 << 15)]
            lanes = filled[blk]
            if step == 0:
                lanes = lanes & ~((one << lane[q]) | ((one << lane[q]) - one))
            i, lanes_left, blk_left = _sliced(fp, q, planes, blk, lanes, radius)
            while len(i):
                bit = lanes_left & (~lanes_left + one)
                at_lane = np.round(np.log2(bit.astype(np.float64))).astype(np.int64)
                low.append(i)
                high.append(edge[blk_left] + at_lane)
                lanes_left = lanes_left ^ bit
                more = lanes_left != 0
                i, lanes_left, blk_left = i[more], lanes_left[more], blk_left[more]
        step += 1
        more = asked + 1 < last_block[asking]
        asking, asked = asking[more], asked[more] + 1
    if not low:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(low), np.concatenate(high)


def _sliced(fp, q, planes, blk, lanes, radius: int):
    """Carry-save count of differing bits of each query against its block; the lanes within radius."""
    width = int(radius + 1).bit_length()
    counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(width)]
    alive = lanes.copy()
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    value = fp[q]
    for b in range(BITS):
        if b % 8 == 0:
            keep = alive != 0  # blocks whose lanes have all exceeded the radius are abandoned
            if not keep.all():
                q, blk, alive, value = q[keep], blk[keep], alive[keep], value[keep]
                counters = [c[keep] for c in counters]
            if not len(q):
                break
        carry = planes[b][blk] ^ (((value >> np.uint64(b)) & one) * full)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        alive &= ~_exceeds(counters, radius)
    keep = alive != 0
    return q[keep], alive[keep], blk[keep]


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter equals radius + 1 (they are dropped at once, so it gets no higher)."""
    out = np.full_like(counters[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for k, c in enumerate(counters):
        out &= c if (radius + 1) >> k & 1 else ~c
    return out


def _compare(filed: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of rows (level, k1, k2, fp): (a, b) as signed fingerprints, a < b.

    Rows come sorted by bucket; a task holds one bucket (and one batch) at a time.
    """
    schema = common.schema_of(("a", T.LongType()), ("b", T.LongType()))
    first = masks(radius)
    seconds = [second_masks(m, radius + 1) for m in first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(c).to_numpy() for c in ("tag", "k1", "k2")]
                key, fp = np.stack(cols, axis=1), batch.column("fp").to_numpy().view(np.uint64)
                if held is not None:
                    key, fp = np.concatenate((held[0], key)), np.concatenate((held[1], fp))
                new = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1))
                cut = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on
                held = (key[cut:], fp[cut:])
                key, fp = key[:cut], fp[:cut]
            elif held is not None:
                key, fp = held
            else:
                return
            i, j = bucket_links(key, fp, radius)
            if not len(i):
                continue
            x, tag = fp[i] ^ fp[j], key[i, 0]
            # The first filing that holds the pair reports it.
            earlier = np.zeros(len(i), dtype=bool)
            for f, m in enumerate(first):
                agree = (x & np.uint64(m)) == 0
                earlier |= agree & (tag // 16 > f)
                for p, second in enumerate(seconds[f]):
                    earlier |= ((x & np.uint64(second)) == 0) & (tag // 16 == f) & (tag % 16 - 1 > p)
            low, high = fp[i].view(np.int64)[~earlier], fp[j].view(np.int64)[~earlier]
            yield common.record_batch([np.minimum(low, high), np.maximum(low, high)], schema)

    return common.map_tasks(filed, run, schema)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``) that differ in at most radius bits."""
    if not 1 <= radius <= 6:
        raise ValueError("radius must be between 1 and 6")
    first = masks(radius)

    def part(mask: int) -> Column:
        return F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))

    keys = [F.struct(F.lit(f * 16).cast("long").alias("tag"), part(m).alias("k1")) for f, m in enumerate(first)]
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.tag", "k.k1")
    sizes = filed.groupBy("tag", "k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = sink.materialize(sizes.where(F.col("n") > bucket_rows).select("tag", "k1"), "full-buckets")
    nothing = F.lit(0).cast("long").alias("k2")
    if full.isEmpty():
        buckets = filed.select("tag", "k1", nothing, "fp")
    else:
        again = F.array(*[
            F.array(*[
                F.struct(F.lit(f * 16 + 1 + p).cast("long").alias("tag"), part(s).alias("k2"))
                for p, s in enumerate(second_masks(m, radius + 1))
            ])
            for f, m in enumerate(first)
        ])
        choice = F.element_at(again, (F.col("tag") / 16 + 1).cast("int"))
        split = filed.join(full, ["tag", "k1"], "left_semi").select("fp", "k1", F.explode(choice).alias("s"))
        kept = filed.join(full, ["tag", "k1"], "left_anti").select("tag", "k1", nothing, "fp")
        buckets = kept.union(split.select("s.tag", "k1", "s.k2", "fp"))
    ordered = buckets.repartition("tag", "k1", "k2").sortWithinPartitions("tag", "k1", "k2", "fp")
    return _compare(ordered, radius)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    seed: int = HASH_SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, fp, component_id (the smallest doc_id reachable)."""
    rows = sink.materialize(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    distinct = sink.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    links = sink.materialize(fingerprint_links(distinct.select("fp"), radius, bucket_rows), "fingerprint-links")
    nodes = components(links)
    linked = distinct.join(nodes, distinct.fp == nodes.node).select("fp", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "root").select("fp", "component_id")
    by_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    # Written, so that both sides below are plain scans and a frequent fingerprint can be split.
    by_fp = sink.materialize(by_fp, "fingerprint-components")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")
