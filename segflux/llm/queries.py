"""Registered queries: each operator on its whole table, with the columns its contract names."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflux.llm import common, cover_tree, decontam, exact_dedup, language, lexical, lm_scoring, maxscore, packing, passages, pii, sharding, simhash, suffix_dedup, token_store
from segflux.llm.ship import ship
from segflux.sources import sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return lm_scoring.score(documents, *lm_scoring.train(documents))


@query
def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards in random order; law ``key``."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    written = sharding.write_shards(documents, 24)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Digests first: the texts themselves need not travel for the slots.
    digests = written.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
        "bucket",
        "place",
    )
    placed = sharding.with_slots(digests)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op3_maxscore_top_k"] = """
WITH usable AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a store and read back."""
    path = sink.new_path(spark, "token-store")
    store = token_store.write_store(common.table(spark, sf_dir, "documents"), path)
    return token_store.read_store(store, with_ids=False)


@query
def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash are of the patterns' spans; ``spans`` holds those the random field adds too."""
    documents = common.table(spark, sf_dir, "documents")
    found = pii.find_spans(documents, pii.train(documents))

    def count(kind: str, spans: str):
        return F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(f"{kind}:"))).cast("long")

    return found.select(
        "doc_id",
        *[count(kind, "base").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


@query
def op6_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kept_text`` is what is left; bytes of a character that was cut through show as replacements.

    ``n_passage_words``: words in passages of over 50 words that another document has too, however few bytes these have.
    """
    found = suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"), words=passages.WORDS)
    kept = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept, "n_passage_words")


@query
def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), with_ids=False)


@query
def op8_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, predicts all."""
    documents = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.remainder(F.col("doc_id")) == 2, F.lit(False))
    names, prototypes = language.train(documents.where(~held_out))
    found = language.identify(documents, names, prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


ORACLES["op11_cover_tree_negatives"] = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, c.vec_id AS vec_id, c.label = a.label AS same,
           CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable a JOIN usable c ON c.r <> a.r AND len(c.v) = len(a.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
     AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op12_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


# Separators are the ASCII characters other than letters and digits; only A-Z fold.
_TERM_LIST = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
ORACLES["op12_aho_corasick_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERM_LIST} AS words FROM documents),
words AS (SELECT d, unnest(words) AS term FROM docs),
counts AS (SELECT d, term, count(*) AS tf FROM words GROUP BY d, term),
totals AS (SELECT count(*) AS n_all, CAST(sum(len(words)) AS HUGEINT) AS l_all FROM docs WHERE len(words) > 0),
weights AS (
    SELECT term, CAST(floor(1000e0 * ln((2e0 * any_value(n_all) + 2e0) / (2e0 * count(*) + 1e0))) AS BIGINT) AS w
    FROM counts, totals GROUP BY term
),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERM_LIST} AS words FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(words) AS term FROM items) GROUP BY ALL),
sizes AS (SELECT d, doc_id, CAST(25 + (75 * CAST(len(words) AS HUGEINT) * n_all) // l_all AS BIGINT) AS m FROM docs, totals),
scored AS (
    SELECT i, item_id, d, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (d) GROUP BY i, item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


@query
def op13_skew_safe_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op13_skew_safe_exact_dedup"] = f"""
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS x FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""
