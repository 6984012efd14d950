from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from segflux.llm import language
from segflux.llm.queries import QUERIES


def plain_vector(text):
    """The definition, letter by letter."""
    v = language.letter_vectors(language.DIMENSIONS, language.SEED).astype(int)
    code = language.letter_codes()
    out = np.zeros(language.DIMENSIONS, dtype=int)
    for word in (text or "").lower().split():
        padded = [0, *(int(code[ord(c)]) for c in word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b:
                out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_bundles_equal_the_definition():
    texts = ["Hello, World again", None, "", "... 42", "Ünïcödé ñandú 字한", "a", "x1y2 z", "word " * 5000]
    vectors, lettered = language.text_vectors(pa.array(texts))
    assert lettered.tolist() == [True, False, False, False, True, True, True, True]
    for row, text in zip(vectors, texts):
        assert (row == plain_vector(text)).all(), text


def test_held_out_accuracy(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op9_hyperdimensional_language"](spark, "/root/testdata/sf0.01").collect()}
    known = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert rows.keys() == known.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [d for d, r in rows.items() if r.held_out and r.lang_pred != "und"]
    assert np.mean([rows[d].lang_pred == known[d] for d in held]) > 0.95


def test_nothing_but_the_text_decides(spark, documents):
    names, prototypes = language.train(documents)
    changed = documents.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents, names, prototypes).collect()}
    two = {r.doc_id - 1000000: (r.lang_pred, r.score) for r in language.identify(changed, names, prototypes).collect()}
    assert one == two


def test_sample_is_bounded(spark, documents):
    names, _ = language.train(documents, train_rows=40)
    assert names and set(names) <= {"de", "en", "es", "fr"}


def test_edge_rows(edge, empty):
    names, prototypes = language.train(edge)
    assert names == []
    assert {(r.lang_pred, r.score) for r in language.identify(edge, names, prototypes).collect()} == {("und", 0.0)}
    fitted = ["aa", "bb"], np.ones((2, language.DIMENSIONS))
    found = language.identify(edge, *fitted).collect()
    assert len(found) == edge.count()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 6)} == {"und"}
    assert language.identify(empty, *fitted).collect() == []
    kept = language.keep_identified(edge, *fitted)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3


def test_a_rare_language_is_learned_from_all_its_rows(spark):
    """One row in 3,000 here; a uniform sample of 300 would miss most of them."""
    rows = [(i, "the house and the tree stand here", "en") for i in range(6000)]
    rows += [(10_000 + i, "qalqiz vyxow zuqam xyq", "qq") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = language.train(df, train_rows=300)
    assert names == ["en", "qq"]
    found = language.identify(spark.createDataFrame([(1, "vyxow qalqiz"), (2, "the tree")], "doc_id long, text string"), names, prototypes)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "qq", 2: "en"}
    assert language._fair_share([2, 10, 1000], 300) == 288 and language._fair_share([1, 2], 300) == 2
