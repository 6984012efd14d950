"""Corpus pipeline: documents in, packed token sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

1. ``language_id`` learns from the labelled rows and drops texts without a language.
2. ``near_duplicates`` keeps the row with the smallest id of every SimHash component; shingle length and
   bit distance are those of the operator's own query.
3. ``decontamination`` drops texts that hold benchmark passages.
4. ``personal_data`` replaces personal data by its kind; ``n_chars`` follows the text.
5. ``packing`` cuts and packs the token ids into sequences.

Of rows that are equal in full one stays; a row without an id stays only when no row of its component
has one.  Extra columns go along as they are, whatever their names.  Empty tables pass through as empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflux.llm import common, decontam, language, packing, pii, simhash
from segflux.llm.ship import ship
from segflux.sources import sink


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    names, prototypes = language.train(docs)
    return language.keep_identified(docs, names, prototypes)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # An id every row has, smallest ids first; only rows equal in full share one.  The row itself travels
    # in a struct of its own, so no column of it can clash.
    every = [common.column(docs, c) for c in docs.columns]
    content = F.struct(F.xxhash64(*every), F.hash(*every))
    doc_id = F.col("doc_id").cast("long")
    key = F.struct(doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.lit(0)).alias("id"), content.alias("content"))
    keyed = docs.select(key.alias("doc_id"), F.col("text"), F.struct(*every).alias("row"))
    found = simhash.near_duplicates(keyed)
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    kept = sink.materialize(kept, "kept-documents")
    rows = keyed.join(kept, "doc_id")
    once = rows.where("copies = 1").select("row.*")
    if kept.where("copies > 1").isEmpty():
        return once
    return once.unionByName(rows.where("copies > 1").dropDuplicates(["doc_id"]).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.mask_texts(docs, pii.train(docs), size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Fingerprints, trained models and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = sink.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
