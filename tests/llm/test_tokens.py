"""Encoder, token store and packing against the tokenizer itself."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from segflux.llm import common, packing, token_store, tokens
from segflux.sources import sink


def exact(text):
    found = tokens.encoder(tokens.vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False)
    return [*found.ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_tokenizer_on_random_text():
    letters = [chr(c) for c in range(1, 0x250)] + list("̀́̇ıΣσςÅ 　字한😀​")
    letters += [" "] * 60 + list("'stredlvm") * 8
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "x<|endoftext|>y", "don't 'S it'll"]
    ids, at = tokens.encoder(tokens.vocabulary_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == exact(text), text


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    fresh = tokens.WordEncoder(tokens.vocabulary_path())
    for text in ("one two three four", "five six", "one five seven"):
        ids, _ = fresh.encode(pa.array([text]))
        assert ids.tolist() == exact(text)


def check_store(df, rows, spark, **options):
    path = sink.new_path(spark, "store-test")
    store = token_store.write_store(df, path, **options)
    found = token_store.read_store(store).collect()
    assert len(found) == len(rows)
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in sorted(found, key=lambda r: r.start):
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == crc(ids)
        text = next(t for t in by_id[r.doc_id] if exact(t) == ids)
        by_id[r.doc_id].remove(text)
        at += len(ids)
    return store.manifest


def test_store_round_trip(spark, documents):
    check_store(documents, [(r.doc_id, r.text) for r in documents.collect()], spark)


def test_store_edge_rows(spark, edge, empty):
    check_store(edge, [(r.doc_id, r.text) for r in edge.collect()], spark)
    check_store(empty, [], spark)


def test_single_document_access_and_dictionary_hash(spark, documents):
    path = sink.new_path(spark, "store-test")
    store = token_store.write_store(documents, path)
    system, folder = common.filesystem(path)
    dictionary = system.open_input_stream(f"{folder}/dictionary").read()
    assert dictionary
    row = store.manifest.first()
    with system.open_input_file(f"{folder}/{row.file}") as source:
        reader = token_store.FileReader(source, dictionary)
        k = reader.documents // 2
        text = documents.where(f"doc_id = {row.doc_ids[k]}").first().text
        assert reader.ids(k).tolist() == exact(text)
    with system.open_input_file(f"{folder}/{row.file}") as source, pytest.raises(ValueError):
        token_store.FileReader(source, dictionary + b"x")


def test_a_file_with_several_blocks(spark, documents):
    few = documents.limit(60).coalesce(1)
    hot = spark.createDataFrame([(5, f"copy {i % 3}") for i in range(40)], "doc_id long, text string")
    both = few.select("doc_id", "text").unionByName(hot)
    manifest = check_store(both, [(r.doc_id, r.text) for r in both.collect()], spark, block=7)
    assert manifest.count() > manifest.select("file").distinct().count()


def test_sample_of_equal_rows_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SAMPLE_DOCUMENTS", 50)
    seen = []
    monkeypatch.setattr(token_store, "train_dictionary", lambda arrays, size=0: seen.append(len(arrays)) or b"")
    rows = spark.range(3000).selectExpr("cast(1 as bigint) as doc_id", "'the same text every time' as text")
    token_store.sample_dictionary(rows, token_store.tokens.vocabulary_path(), 2)
    token_store.sample_dictionary(rows.limit(0), token_store.tokens.vocabulary_path(), 2)
    assert seen == [50]


def check_packing(df, rows):
    found = packing.pack_documents(df).collect()
    for r in found:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert r.ids_crc32 == crc(ids) and r.length == len(ids) > 0
    wanted = defaultdict(int)
    for i, t in rows:
        wanted[(i, tuple(exact(t)))] += 1
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    for (doc, ids), copies in wanted.items():
        got = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
        covered = np.zeros(len(ids), dtype=int)
        for r in got:
            part = np.frombuffer(bytes(r.ids), dtype="<u4")
            assert tuple(part) == ids[r.start : r.start + r.length] or copies < sum(k[0] == doc for k in wanted)
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(len(ids) * n for (_, ids), n in wanted.items())
    assert len(sequences) == -(-total // packing.CAPACITY) or len(sequences) <= total // packing.CAPACITY + 2


def test_packing_round_trip(documents):
    check_packing(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_packing_edge_rows(edge, empty):
    check_packing(edge, [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.pack_documents(empty).collect() == []


def test_assignment_goes_to_the_cheapest_sequence_with_room():
    def piece(n):
        return packing.Piece(n, 0, np.zeros(n, dtype="<u4"), n)

    placed, rest = packing.assign([piece(n) for n in (6, 5, 4, 3, 2)], 2, capacity=10)
    assert not rest
    assert [(s, len(p.ids)) for s, _, p in placed] == [(0, 6), (1, 5), (1, 4), (0, 3), (1, 1), (0, 1)]
    costs = [sum(packing.piece_cost(len(p.ids)) for s, _, p in placed if s == k) for k in (0, 1)]
    assert max(costs) / min(costs) < 1.1
