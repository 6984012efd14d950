"""Random order for a whole corpus: a two-pass external shuffle into shards.

First pass: every record is scattered by seeded hashes, its id deciding the shard and a hash of
the whole record the bucket inside the shard.  Buckets are sized so that one fits in a task's
memory many times over.  Second pass: each bucket is shuffled on its own by Spark's seeded
Fisher-Yates and written; a shard is its buckets one after the other.  A repeated task may draw
another order, but its output replaces the earlier one whole, and what is written stays.

The shard of a record is the one with the highest hash of (seed, id, shard).  Id and shard count
alone decide, and one shard more takes records only into itself.

Only built-in functions run.  Records travel once, for the scatter; slots need one short row per
bucket besides.

Defined results: a null text has 0 bytes and a null checksum input (treated as empty); null ids
are one id like any other; equal records keep separate slots; an empty table gives no rows.  Extra
columns are carried along (an input column named like an output column is replaced).  Records with
one id share a shard by definition, but spread over its buckets unless they are equal in full and
come from one input partition position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflux.llm import common
from segflux.sources import sink

BUCKET_BYTES = 8 * 1024 * 1024
"""Text bytes a bucket should hold."""
BUCKET_ROWS = 65_536
"""Rows a bucket should hold at most, as empty and null texts have no bytes."""
SEED = 20
OUTPUT = ("shard", "grown_shard", "bucket", "place")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard with the highest hash for this key."""
    scores = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("score"), F.lit(s).alias("shard")) for s in range(shards)
    ]
    return F.array_max(F.array(*scores))["shard"]


def scatter(df: DataFrame, shards: int, buckets: int, id_col: str, seed: int) -> DataFrame:
    """First pass: shard, shard with one more, and bucket of every record."""
    plain = df.select([c for c in df.columns if c not in OUTPUT])
    key = common.column(plain, id_col)
    spread = F.xxhash64(F.lit(seed), F.lit("bucket"), key, F.monotonically_increasing_id())
    return plain.select(
        "*",
        shard_of(key, shards, seed).alias("shard"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
        F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket"),
    )


def write_shards(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Shuffle and write all records; the written table, with shard, grown_shard, bucket, place.

    ``place`` is the position inside the bucket.  ``with_slots`` turns it into the position inside
    the shard.
    """
    if not 1 <= shards <= 4096:
        raise ValueError("shards must be between 1 and 4096")
    octets = F.octet_length(common.column(df, text_col)).cast("long")
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(octets), F.lit(0))).first()
    buckets = max(1, -(-total // (bucket_bytes * shards)), -(-rows // (bucket_rows * shards)))
    scattered = scatter(df, shards, buckets, id_col, seed)
    carried = [c for c in scattered.columns if c not in ("shard", "bucket")]
    record = F.struct([common.column(scattered, c).alias(f"c{i}") for i, c in enumerate(carried)])
    gathered = scattered.groupBy("shard", "bucket").agg(F.collect_list(record).alias("records"))
    shuffled = gathered.select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "r"))
    out = shuffled.select(
        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(carried)],
        "shard", "bucket", F.col("place").cast("long").alias("place"),
    )
    return sink.materialize(out, "shards")


def with_slots(written: DataFrame) -> DataFrame:
    """Adds ``slot``, the gapless position in the shard, from one row per bucket."""
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    joined = written.drop("slot").join(starts, ["shard", "bucket"])
    return joined.withColumn("slot", F.col("first") + F.col("place")).drop("first")
