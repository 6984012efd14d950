from __future__ import annotations

import dataclasses
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segflux.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def trained(spark):
    return lm.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def plain_words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


@pytest.fixture(scope="module")
def counted(spark):
    counts = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        counts.update(plain_words(r.text))
    return counts


def plain_id(words, classes, word):
    marks, raw = lm.marks_for(classes), word.encode()
    if word in words:
        return 1 + 16 * marks + words.index(word)
    return 1 + (min(len(raw), 16) - 1) * marks + raw[-1] % marks


def plain_score(lexicon, net, counted, text):
    """Token by token, from the definition."""
    words, classes = lexicon.words, lexicon.classes
    letters = Counter(p for w in counted for p in zip((" " + w + " ").encode(), (" " + w + " ").encode()[1:]))
    after = Counter()
    for (x, _), n in letters.items():
        after[x] += n
    among = Counter()
    for w, n in counted.items():
        if w not in own(lexicon):
            among[plain_id([], classes, w)] += n
    tokens = plain_words(text)
    at = [0, 0, *(plain_id(words, classes, t) for t in tokens), 0, 0]
    total = 0.0
    for i in range(2, len(at) - 2):
        h = np.tanh(sum(net.embed[p][at[i + d]].astype(float) for p, d in enumerate((-2, -1, 1, 2))))
        h = np.append(h, 1.0)
        c, w = divmod(at[i], classes)
        for weights, k in ((net.to_class, c), (net.to_word[c], w)):
            x = weights.astype(float) @ h
            total += x[k] - np.log(np.exp(x).sum())
        word = tokens[i - 2]
        if word not in own(lexicon):
            raw = (" " + word + " ").encode()
            spelling = sum(np.log((letters[p] + 1) / (after[p[0]] + 256)) for p in zip(raw, raw[1:]))
            total += np.log(counted[word] + np.exp(spelling)) if counted[word] else spelling
            total -= np.log(among[at[i]] + 1)
    return len(tokens), total


def own(lexicon):
    return set(lexicon.words)


def test_words_are_counted_over_all_documents(documents):
    counts = Counter()
    for r in documents.collect():
        counts.update(plain_words(r.text))
    lexicon = lm.lexicon_of(documents.select("text"))
    assert {r.word: r.n for r in lexicon.counts.collect()} == counts
    assert lexicon.words == sorted(counts, key=lambda w: (-counts[w], w.encode()))[: lm.own_words(lexicon.classes)]
    shared = sum(n for w, n in counts.items() if w not in own(lexicon))
    assert lexicon.shared.sum() == shared and np.allclose(np.exp(lexicon.spelling).sum(axis=1), 1)


def test_ids_grow_with_the_distinct_words():
    sizes = [lm.classes_for(10**k) for k in range(12)]
    assert sizes == sorted(sizes) and sizes[0] == 32 and sizes[9] == 76 and sizes[11] == 191
    for classes in sizes:
        assert lm.own_words(classes) > 0.87 * classes * classes - 1
    flat, wide = pa.array(["a", "abc", "x" * 40], pa.large_string()), lm.classes_for(10**9)
    words = pa.array(["abc"], pa.large_string())
    assert lm.token_ids(flat, words, wide).tolist() == [plain_id(["abc"], wide, w) for w in flat.to_pylist()]
    net = lm.Network.fresh(classes=wide)
    assert lm.Network.of(net.flat(), wide).to_word.shape == (wide, wide, lm.DIMENSIONS + 1)


def test_every_word_has_a_probability_of_its_own(spark, trained, counted):
    lexicon, net = trained
    rare = sorted(w for w, n in counted.items() if n == 1 and len(w.encode()) == 6 and w not in own(lexicon))
    often = [w for w, n in counted.items() if n >= 4 and w not in own(lexicon) and len(w.encode()) == 6]
    same = next((a, b) for a in rare for b in often if plain_id([], lexicon.classes, a) == plain_id([], lexicon.classes, b))
    assert not {"qzwxvk", "bbbbbk", "blackk"} & set(counted)
    texts = [f"the {w} of" for w in ("qzwxvk", "bbbbbk", "blackk", *same)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.log_likelihood for r in lm.score(frame, lexicon, net).orderBy("doc_id").collect()]
    assert len(set(found)) == 5 and found[2] > found[0] and found[4] > found[3] > max(found[:3])


def test_scores_do_not_depend_on_which_counts_travel(spark, trained, counted):
    lexicon, net = trained
    assert lexicon.frequent and all(counted[w] == n and w not in own(lexicon) for w, n in lexicon.frequent.items())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    none = dataclasses.replace(lexicon, frequent={})
    here = {r.doc_id: r.log_likelihood for r in lm.score(docs, lexicon, net).collect()}
    there = {r.doc_id: r.log_likelihood for r in lm.score(docs, none, net).collect()}
    assert here.keys() == there.keys() and all(np.isclose(here[i], there[i], rtol=1e-9, atol=1e-6) for i in here)


def test_words_of_a_shared_id_have_at_most_probability_one(spark, trained):
    lexicon, net = trained
    rows = [r for r in lexicon.counts.collect() if r.word not in own(lexicon)]
    flat = pa.array([r.word for r in rows], pa.large_string())
    ids = lm.token_ids(flat, pa.array(lexicon.words, pa.large_string()), lexicon.classes)
    mass = np.bincount(ids, np.array([r.n for r in rows]) + np.exp(lm.spelled(flat, lexicon.spelling)))
    assert (mass <= lexicon.shared[: len(mass)] + 1).all()


def test_scores_equal_the_definition(spark, trained, counted, edge):
    words, net = trained
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 900").limit(12)
    for r in lm.score(docs, words, net).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, total = plain_score(words, net, counted, r.text)
        assert r.n_tokens == n and np.isclose(r.log_likelihood, total, rtol=1e-3, atol=1e-2)
    rows = lm.score(edge, words, net).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id in (1, 2, 6):
            assert (r.n_tokens, r.log_likelihood, r.score) == (0, 0.0, None)
        if r.doc_id == 3:
            assert np.isclose(r.log_likelihood, plain_score(words, net, counted, "Short.")[1], rtol=1e-3)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    net = lm.Network.fresh()
    for p in net.parts():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    row, place = lm.padded(rng.integers(1, 1024, 60), np.array([0, 25, 60]))
    slopes, total = lm.gradient(net, row, place)
    assert np.isclose(total, lm.log_probabilities(net, row, place).sum(), rtol=1e-5)
    for part, slope in zip(net.parts(), slopes):
        for cell in np.argsort(-np.abs(slope).ravel())[:5]:
            spot = np.unravel_index(cell, part.shape)
            old = part[spot]
            part[spot] = old + 0.01
            up = lm.log_probabilities(net, row, place).sum()
            part[spot] = old - 0.01
            down = lm.log_probabilities(net, row, place).sum()
            part[spot] = old
            assert np.isclose((up - down) / 0.02, slope[spot], rtol=0.05, atol=0.02)


def test_training_tells_order_from_disorder(spark, trained):
    words, net = trained
    fresh = lm.Network.fresh()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").limit(150).collect()]
    texts = [t for t in texts if len(t.split()) > 100]
    rnd = random.Random(0)
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    other = spark.createDataFrame([(i, t) for i, t in enumerate(mixed)], "doc_id long, text string")
    good = {r.doc_id: r.score for r in lm.score(frame, words, net).collect()}
    untrained = {r.doc_id: r.score for r in lm.score(frame, words, fresh).collect()}
    shuffled = {r.doc_id: r.score for r in lm.score(other, words, net).collect()}
    assert np.mean(list(good.values())) > np.mean(list(untrained.values())) + 1
    assert np.mean([good[i] > untrained[i] for i in good]) > 0.95
    assert np.mean(list(good.values())) >= np.mean(list(shuffled.values()))


def test_empty_table(empty):
    words, net = lm.train(empty)
    assert words.words == [] and words.counts.count() == 0 and lm.score(empty, words, net).collect() == []


def test_shared_ids_of_a_sliced_array():
    flat, offsets = lm.words_of(pa.array(["x", " ab  cd ", None, "efg"]).slice(1))
    assert flat.to_pylist() == ["ab", "cd", "efg"] and offsets.tolist() == [0, 2, 2, 3]
    ids = lm.token_ids(flat.slice(1), pa.array(["cd"], pa.large_string()))
    assert ids.tolist() == [1 + 128, 1 + 16 + ord("g") % 8]
