"""Exact duplicates by skew-safe combining, with built-in functions only.

Texts are equal when they are identical after A-Z became a-z.  A first narrow pass writes one short
row per document (id, digest) and counts digests.  A digest is hot when it has more than
1 / ``HOT_SHARE`` of all rows, so there are fewer than ``HOT_SHARE`` of them, whatever the input: that
proven bound is what lets them be broadcast.

Texts then are combined in three stages, every one grouping by the digest *and the full text*:

1. locally: the map side of the group leaves one row per text and input partition;
2. by salted digest: a hot digest is spread over ``SALTS`` groups by input partition, others have one;
3. globally: the salt winners of hot digests, at most ``SALTS`` rows a text.  Other digests are done.

So each text is shuffled at most once, except the few salt winners.  The result goes back to the
documents by digest: hot ones by broadcast, the rest by a join in which no key has more than
1 / ``HOT_SHARE`` of the rows.  Two texts that share a digest are found by the full comparison; their
documents are joined by digest and text instead, so a collision costs time but never merges texts.

Defined results: a null text is an empty one; of equal texts the row with the largest id stays, and
of repeated rows with that id exactly one; rows without an id stay only when no row of their group
has one (``keep_id`` is then null); an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflux.llm import common
from segflux.sources import sink

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_SHARE = 4096
LEAST_HOT = 256
"""A digest with fewer rows than this is never hot."""
SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def winners(texts: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, keep_id, group_size), one row per different text of ``texts`` (doc_id, digest, text).

    ``hot`` holds the digests to salt, fewer than ``HOT_SHARE`` rows.
    """
    marked = texts.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    salt = F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(-1))
    # Stages 1 and 2: one group, combined on the map side and then by (digest, salt, text).
    salted = marked.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Only hot digests need their text again.
    kept = F.when(F.col("salt") >= 0, F.col("text")).alias("text")
    salted = sink.materialize(salted.select("digest", "salt", kept, "keep_id", "group_size"), "salt-winners")
    # Stage 3.
    merged = salted.where("salt >= 0").groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return salted.where("salt < 0").select("digest", "keep_id", "group_size").union(
        merged.select("digest", "keep_id", "group_size")
    )


def duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    least_hot: int = LEAST_HOT,
    hot_share: int = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row of ``df``."""
    docs = common.keyed_text(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    keys = docs.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"))
    keys = sink.materialize(keys, "digests")
    counts = keys.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("top")
    )
    counts = sink.materialize(counts.select("digest", "n", F.col("top.row").alias("top_row")), "digest-counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    hot = sink.materialize(counts.where(F.col("n") > max(least_hot, -(-rows // hot_share))).select("digest"), "hot-digests")

    groups = sink.materialize(winners(docs, hot, salts), "text-groups")
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    shared = sink.materialize(shared, "shared-digests")
    collided = not shared.isEmpty()
    if collided:
        groups = groups.join(shared, "digest", "left_anti")
        keys = keys.join(shared, "digest", "left_anti")
    # Written, so that its size is known to the joins below.
    groups = sink.materialize(groups.join(counts.select("digest", "top_row"), "digest"), "group-results")
    is_hot = hot.select("digest")
    few = F.broadcast(groups.join(F.broadcast(is_hot), "digest", "left_semi"))
    cold = keys.join(F.broadcast(is_hot), "digest", "left_anti").join(
        groups.join(F.broadcast(is_hot), "digest", "left_anti"), "digest"
    )
    found = keys.join(few, "digest").unionByName(cold)
    if collided:
        found = found.unionByName(_by_text(docs, shared))
    kept = (F.col("row") == F.col("top_row")).alias("kept")
    return found.select("doc_id", "digest", "keep_id", "group_size", kept)


def _by_text(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The documents of digests that several texts share, grouped and joined by the text itself."""
    rows = docs.join(shared, "digest", "left_semi").select("*", F.monotonically_increasing_id().alias("row"))
    rows = sink.materialize(rows, "shared-rows")
    groups = rows.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")
    )
    groups = groups.select("digest", "text", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("top_row"))
    groups = sink.materialize(groups, "shared-groups")
    return rows.join(groups, ["digest", "text"]).select("digest", "doc_id", "row", "keep_id", "group_size", "top_row")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the rows that stay, one per different text."""
    return duplicates(df, id_col, text_col).where("kept").select("doc_id")
