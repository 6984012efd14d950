from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from segflux.llm import passages, suffix_dedup
from segflux.llm.queries import QUERIES


def brute(rows, words=51):
    """Words inside any run of ``words`` words that another row has too."""
    texts = [[x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if x] for _, t in rows]
    rows_of = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t) - words + 1):
            rows_of[tuple(t[a : a + words])].add(i)
    out = []
    for (doc, _), t in zip(rows, texts):
        hit = set()
        for a in range(len(t) - words + 1):
            if len(rows_of[tuple(t[a : a + words])]) > 1:
                hit.update(range(a, a + words))
        out.append((str(doc), len(hit)))
    return sorted(out)


def result(df, **options):
    return sorted((str(r.doc_id), r.n_passage_words) for r in suffix_dedup.remove_repeats(df, words=51, **options).collect())


def prose(rnd, n):
    return " ".join("".join(rnd.choices("aeinrst", k=rnd.randint(1, 7))) for _ in range(n))


def planted(seed):
    """Texts of their own and passages of 51 to 70 short words, under 400 bytes, each put into some of them."""
    rnd = random.Random(seed)
    held = [prose(rnd, n) for n in (51, 55, 60, 70)]
    assert all(len(p) < 400 for p in held)
    rows, with_passage = [], set()
    for i in range(80):
        parts = [prose(rnd, rnd.randint(0, 120))]
        if i % 2:
            parts += [held[i // 2 % 4], prose(rnd, rnd.randint(0, 120))]
            with_passage.add(i)
        rows.append((i, " ".join(parts)))
    return rows, with_passage


def test_passages_under_400_bytes_are_counted(spark):
    """The contract's removal leaves them, as it must; the count tells documents with a passage from others."""
    rows, with_passage = planted(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(df, words=51).collect()
    assert {r.doc_id for r in found if r.n_passage_words > 0} == with_passage
    assert not any(r.n_removed for r in found)
    assert sorted((str(r.doc_id), r.n_passage_words) for r in found) == brute(rows)


def test_odd_texts_and_full_routes(spark):
    rnd = random.Random(2)
    rows, _ = planted(3)
    held = prose(rnd, 90)
    words = held.split(" ")
    rows += [
        (100, held + "\n" + held),  # twice, but in no other row than the next ones
        (101, " ".join(words[:50])),  # one word short
        (102, "\t" + "\r\n".join(words[10:61]) + "\x0b"),  # other white space
        (103, " ".join(words[:30] + ["x"] + words[30:])),
        (104, "the " * 400), (105, "de " * 60), (106, "de " * 80), (107, " ".join(words)),
        (108, "é\x00 " * 60 + "w" * 5000 + " " + prose(rnd, 20)), (109, "y " + "é\x00 " * 40 + "w" * 5000 + " " + " ".join(words[:51])),
        (110, None), (111, ""), (112, " \n"), (113, prose(rnd, 60)), (114, prose(rnd, 40)),
        (115, "own " * 20 + prose(rnd, 300)),
    ]
    rows += [rows[-1], rows[-3], rows[-2]]  # equal in id and text
    long = " ".join(["z" * 2000] * 30 + [prose(rnd, 40)])
    rows += [(120, "a " + long), (121, "b " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = brute(rows)
    assert dict(wanted)["104"] == 0 and dict(wanted)["105"] == 60 and dict(wanted)["101"] == 0 and dict(wanted)["121"] == 70
    assert result(df) == wanted
    assert result(df, route_kinds=1) == wanted


def test_documents_and_query(spark, documents, small):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = brute(rows)
    assert sum(n > 0 for _, n in wanted) > 10
    found = QUERIES["op6_induced_suffix_dedup"](spark, small)
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((str(r.doc_id), r.n_passage_words) for r in found.collect()) == wanted


def test_no_rows(empty):
    assert result(empty) == []


def test_windows_stay_inside_their_text():
    rnd = random.Random(4)
    texts = [prose(rnd, n).encode() for n in (0, 51, 50, 200, 1, 52)] + [b"", b" a "]
    w = passages.Words(texts)
    assert np.bincount(w.text, minlength=8).tolist() == [len(t.split()) for t in texts]
    _, first, last = passages.segments(w)
    windows = [i for a, b in zip(first.tolist(), last.tolist()) for i in range(a, b + 1)]
    assert windows == [i for i in range(len(w.text) - 50) if w.text[i] == w.text[i + 50]]
    low = np.array([0, 3, 20])
    assert w.hashes(low, 5).tolist() == passages.Words([b"\t".join(b" ".join(texts).split()[:30])]).hashes(low, 5).tolist()
