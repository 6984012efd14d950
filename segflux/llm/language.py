"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A letter trigram is bound from its three
letter vectors, the first permuted twice and the second once (element-wise product); a text bundles
(adds) the vectors of the trigrams of its words, a word starting and ending with the vector of
"no letter".  A language's prototype bundles the texts labelled with it.  A text gets the language
whose prototype has the highest cosine with it, which is also its score.

Prototypes come from labelled rows only, at most about ``TRAIN_ROWS`` of them, chosen by a hash of
the id; the prediction sees nothing but the text.  Sums are of integers, so order does not matter.
Texts are used whole.

Defined results: a null text, and one without letters, is ``und`` with score 0, as is every text
when no row is labelled; a cosine below 0 counts as 0; equal cosines go to the first language in
alphabetical order; a row without an id is neither learned from nor held out; an empty table gives
no rows; extra columns are never read by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common

DIMENSIONS = 512
SEED = 9
TRAIN_ROWS = 20_000
UNKNOWN = "und"
_DIRECT = 0x250  # letters below have a vector each; others share _SHARED ones
_SHARED = 1024
_SLICE = 1 << 20  # text bytes whose distinct trigrams are bound at once (or one text)
_CELLS = 1 << 22  # trigram counts held at once


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point the row of its letter vector; 0 for what is no letter."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    points = np.arange(0x110000)
    return np.where(alpha, np.where(points < _DIRECT, points, _DIRECT + points % _SHARED), 0).astype(np.int32)


@lru_cache(maxsize=2)
def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, (_DIRECT + _SHARED, dimensions), dtype=np.int8)
    return signs * 2 - 1


def trigram_vectors(trigrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of rows (first, second, third letter code)."""
    v = letter_vectors(dimensions, seed)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return first[trigrams[:, 0]] * second[trigrams[:, 1]] * v[trigrams[:, 2]]


def text_vectors(texts: pa.Array, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of all texts, and which texts have letters.

    The distinct trigrams of the texts are bound once; their counts in each text weigh them in a
    matrix product, some texts at a time.
    """
    lower = [t.lower() for t in pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()]
    points = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "replace"), dtype="<u4")
    code = letter_codes()[points]
    middle = np.flatnonzero(code[1:-1]) + 1
    # Letters that occur get small numbers, so a table tells which trigrams occur.
    seen = np.flatnonzero(np.bincount(code, minlength=_DIRECT + _SHARED))
    small = np.zeros(_DIRECT + _SHARED, dtype=np.int64)
    small[seen] = np.arange(len(seen))
    s, n = small[code], len(seen)
    packed = (s[middle - 1] * n + s[middle]) * n + s[middle + 1]
    if n**3 <= 1 << 24:
        present = np.zeros(n**3, dtype=bool)
        present[packed] = True
        unique = np.flatnonzero(present)
        number = np.zeros(n**3, dtype=np.int32)
        number[unique] = np.arange(len(unique))
        place = number[packed].astype(np.int64)
    else:
        unique, place = np.unique(packed, return_inverse=True)
    letters = seen[np.stack((unique // (n * n), unique // n % n, unique % n), axis=1)]
    ends = np.cumsum([len(t) + 1 for t in lower])
    bounds = np.searchsorted(middle, np.concatenate(([0], ends)), side="right")
    exact = np.float32 if len(middle) < 1 << 24 else np.float64  # whole numbers stay whole
    bound = trigram_vectors(letters, dimensions, seed).astype(exact)
    out = np.zeros((len(lower), dimensions), dtype=np.int64)
    step = max(1, _CELLS // max(1, len(unique)))
    for low in range(0, len(lower) if len(unique) else 0, step):
        high = min(low + step, len(lower))
        row = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
        cells = np.bincount(row * len(unique) + place[bounds[low] : bounds[high]], minlength=(high - low) * len(unique))
        out[low:high] = np.rint(cells.reshape(high - low, len(unique)).astype(exact) @ bound)
    return out, np.diff(bounds) > 0


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _fair_share(counts: list[int], total: int) -> float:
    """Rows each language may take so that all take ``total``; counts come in ascending order."""
    left = float(total)
    for i, n in enumerate(counts):
        share = left / (len(counts) - i)
        if n > share:
            return share
        left -= n
    return float(counts[-1])


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from labelled rows.

    At most about ``train_rows`` of them, an equal share for every language: a rare one is learned from all
    its rows however large the table is.
    """
    rows = df.select(
        common.column(df, text_col).cast("string").alias("text"),
        common.column(df, label_col).cast("string").alias("label"),
        common.column(df, id_col).alias("doc_id"),
    ).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (F.col("label") != UNKNOWN))
    # As many counts as languages, which the prototypes are too.
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) > train_rows:
        draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000_007))
        share = _fair_share(sorted(counts.values()), train_rows)
        often = {label: int(1_000_000_007 * share / n) for label, n in counts.items() if n > share}
        limits = F.create_map(*[F.lit(x) for pair in often.items() for x in pair])
        limit = F.coalesce(F.try_element_at(limits, F.col("label")), F.lit(1_000_000_007))
        rows = rows.where(draw < limit)
    schema = common.schema_of(("label", T.StringType()), ("bundle", T.ArrayType(T.LongType())))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for part in common.text_slices(batch, most=_SLICE):
                vectors, _ = text_vectors(part.column("text"), dimensions, seed)
                labels = np.array(part.column("label").to_pylist(), dtype=object)
                for label in set(labels.tolist()):
                    sums[label] = sums.get(label, 0) + vectors[labels == label].sum(axis=0)
            yield common.record_batch([list(sums), [v.tolist() for v in sums.values()]], schema)

        return step

    parts = common.map_batches(rows.select("text", "label"), schema, start)
    cells = parts.select("label", F.posexplode("bundle").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("x"))
    totals = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("label").collect()
    names = [r.label for r in totals]
    return names, np.array([[c.x for c in r.v] for r in totals], dtype=np.float64).reshape(len(names), dimensions)


def predict(texts: pa.Array, names: list[str], prototypes: np.ndarray, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    vectors, lettered = text_vectors(texts, prototypes.shape[1], seed)
    vectors = vectors.astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True) * np.linalg.norm(prototypes, axis=1)
    cosine = np.divide(vectors @ prototypes.T, norms, out=np.zeros((len(vectors), len(names))), where=norms > 0)
    best = cosine.argmax(axis=1)
    score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0), 0.0)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def identify(
    df: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    docs = common.keyed_text(df, id_col, text_col)
    schema = common.schema_of(*common.fields(docs, "doc_id"), ("lang_pred", T.StringType()), ("score", T.DoubleType()))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, most=_SLICE):
                found, score = predict(part.column("text"), names, prototypes)
                yield common.record_batch([part.column("doc_id"), found, score], schema)

        return step

    return common.map_batches(docs, schema, start)


def keep_identified(
    df: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text", least: float = 0.0
) -> DataFrame:
    """Rows of ``df``, unchanged, whose text has a language with a score of ``least`` or more."""

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, text_col, _SLICE):
                found, score = predict(part.column(text_col).cast(pa.string()), names, prototypes)
                good = np.array([f != UNKNOWN for f in found]) & (score >= least)
                yield part.filter(pa.array(good))

        return step

    return common.map_batches(df, df.schema, start)
