"""Every stage against brute force on its own input, and the whole run."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from segflux.llm import decontam, pii

from .test_decontam import brute as contaminated
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_one_after_the_other(spark, pipeline, documents):
    stage = dict(pipeline.STAGES)
    named = stage["language_id"](spark, documents, SF)
    assert named.columns == documents.columns
    assert rows_of(named) == rows_of(documents.where("text rlike '[A-Za-zÀ-ÿ]'"))

    once = stage["near_duplicates"](spark, documents, SF)
    every = [(r.doc_id, r.text) for r in documents.collect()]
    component = plain_components([(d, plain_fingerprint(t)) for d, t in every])
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(component))
    assert once.columns == documents.columns and len(set(component)) < len(every)
    assert rows_of(once.join(documents, documents.columns, "left_anti")) == []

    clean = stage["decontamination"](spark, documents, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r[0] for r in contaminated(every, items) if not r[5]}
    assert {str(r.doc_id) for r in clean.collect()} == good and clean.columns == documents.columns

    masked = stage["personal_data"](spark, documents, SF)
    assert masked.columns == documents.columns and masked.count() == documents.count()
    old = {r.doc_id: r for r in documents.collect()}
    changed = 0
    for r in masked.collect():
        assert not pii.base_spans(r.text)
        if r.text != old[r.doc_id].text:
            changed += 1
            assert r.n_chars == len(r.text)
        else:
            assert r == old[r.doc_id]
    assert changed > 0


def test_run(spark, pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    found = pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 0 and found.agg({"length": "max"}).first()[0] <= 4096


def test_edge_rows(spark, pipeline, edge, empty):
    edge = edge.withColumn("n_chars", edge.shard.cast("long"))
    empty = empty.withColumn("n_chars", empty.shard.cast("long"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, edge, SF)
        assert out.columns == edge.columns and out.count() <= edge.count()
        assert stage(spark, empty, SF).count() == 0
    kept = dict(pipeline.STAGES)["near_duplicates"](spark, edge, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 3, 5, 7, 8, 9, 10, None]))
    assert pipeline.pack(spark, edge, SF).count() >= edge.count()
    assert pipeline.pack(spark, empty, SF).count() == 0


def test_clashing_columns(spark, pipeline):
    extra = ["_key", "_rows", "n.x", "row", "copies", "fp", "component_id", "content", "shard", "score", "lang_pred"]
    rows = [(1, "the same text in two rows", "en", "s", 1), (2, "the same text in two rows", "en", "s", 2), (3, "another text altogether", "en", "s", 3)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = plain.select("*", *[F.concat(F.lit(name), F.col("doc_id")).alias(name) for name in extra])
    wanted = {"language_id": [1, 2, 3], "near_duplicates": [1, 3], "decontamination": [1, 2, 3], "personal_data": [1, 2, 3]}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        found = {r[0]: tuple(r)[5:] for r in out.collect()}
        assert found == {i: tuple(f"{c}{i}" for c in extra) for i in wanted[name]}
    assert pipeline.pack(spark, df, SF).count() == 3


def test_rows_without_ids_are_deduplicated(spark, pipeline):
    rows = [(None, "same words here now"), (None, "same words here now"), (None, "other words there then"), (5, "other words there then")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(pipeline.STAGES)["near_duplicates"](spark, df, SF).collect()
    assert sorted(map(str, out)) == sorted(map(str, [type(out[0])(doc_id=5, text=rows[3][1]), type(out[0])(doc_id=None, text=rows[0][1])]))


def test_contract_share():
    assert decontam.is_contaminated(1, 20) and not decontam.is_contaminated(1, 21) and not decontam.is_contaminated(0, 0)
