"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens before and after it: the hidden vector is the tanh
of the sum of position-specific embeddings, the output a softmax in three steps: class of the token's
id, id in its class, word among the words of that id.  A document's score is the sum of the
log-probabilities of its tokens, each given both sides.

All words of the corpus are counted exactly, into a table that grows with it.  The most frequent have
an id of their own, the others share ids by length and last byte; the number of ids grows with the
number of distinct words (``classes_for``).  Among the ``N`` occurrences of a shared id a word counted
``n`` times has probability ``(n + q) / (N + 1)``, where ``q`` is the probability of its spelling, letter
by letter, learned from all distinct words: the words of the corpus are told apart by their counts,
others by their spelling, and all words together have at most probability 1.  The counts of the next
frequent words (``FREQUENT``, of at most ``LONGEST`` bytes) go to every task; all others reach the
documents by a join on the word, in which no word is frequent.

The network is trained in numpy over all documents: in each round
every task starts from the same weights, walks over its documents of that round, and hands in its
weights; their average, weighted by tokens, starts the next round.  Rounds take disjoint parts of the
documents, together each document once.

Defined results: a null text, or one of white space, has no tokens, log-likelihood 0 and no mean
score; equal rows score alike; an empty table gives no rows; extra columns are never read.  Texts
are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

SIDE = 2
CLASSES = 32
"""Classes of ids, and ids in a class, of the smallest network."""
LENGTHS = 16
"""Lengths told apart among the words that share ids."""
DIMENSIONS = 16
ROUNDS = 2
BATCH = 16_384
RATE = 0.3
SEED = 1
COUNTED = 400_000
"""Distinct words a task counts before it hands them on."""
FREQUENT = 65_536
LONGEST = 64
"""Shared-id words whose counts go to every task, at most FREQUENT of LONGEST bytes; the others are joined."""
UNIT = 1e9
"""Log-probabilities are added up as whole multiples of 1 / UNIT, so their order does not matter."""
OUT_ROWS = 200_000
SPACE = 32


def classes_for(distinct: int) -> int:
    """Classes, and ids in a class: with the fifth root of the distinct words, so ids grow with its square."""
    return max(CLASSES, math.ceil(1.2 * distinct**0.2))


def marks_for(classes: int) -> int:
    """Last bytes told apart: an eighth of the ids are shared."""
    return classes * classes // (8 * LENGTHS)


def own_words(classes: int) -> int:
    """Words with an id of their own; id 0 is the boundary."""
    return classes * classes - LENGTHS * marks_for(classes) - 1


@dataclass
class Lexicon:
    classes: int
    words: list[str]  # with an id of their own, by frequency
    counts: DataFrame  # word, n: all words of the corpus
    frequent: dict[str, int]  # counts of the most frequent words that share ids
    shared: np.ndarray  # occurrences of each id, 0 for ids of one word
    spelling: np.ndarray  # log-probability of a byte after a byte; words begin and end with a space


@dataclass
class Network:
    embed: np.ndarray  # position, token, dimension
    to_class: np.ndarray  # class, dimension + bias
    to_word: np.ndarray  # class, word in class, dimension + bias

    @staticmethod
    def fresh(seed: int = SEED, classes: int = CLASSES) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.1, (2 * SIDE, classes * classes, DIMENSIONS)).astype(np.float32),
            np.zeros((classes, DIMENSIONS + 1), dtype=np.float32),
            np.zeros((classes, classes, DIMENSIONS + 1), dtype=np.float32),
        )

    @property
    def classes(self) -> int:
        return len(self.to_class)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.to_class, self.to_word]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray, classes: int = CLASSES) -> Network:
        shapes = [p.shape for p in Network.fresh(classes=classes).parts()]
        sizes = [int(np.prod(s)) for s in shapes]
        return Network(*(x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words of all texts, ASCII letters in lower case, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # the split leaves an empty word at the ends of a text
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    offsets = lists.offsets.to_numpy()
    return flat.filter(full), before[offsets - offsets[0]]


def _bytes_of(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, and the places where words end, from the start of the first word."""
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], dtype=np.uint8), ends


def token_ids(flat: pa.Array, vocabulary: pa.Array, classes: int = CLASSES) -> np.ndarray:
    """0 is the boundary, then the shared ids, then the vocabulary by frequency."""
    found = pc.index_in(flat, value_set=vocabulary)
    known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, ends = _bytes_of(flat)
    marks = marks_for(classes)
    last = raw[ends[1:] - 1].astype(np.int64)
    shared = np.minimum(np.diff(ends), LENGTHS) - 1
    return np.where(known >= 0, known + 1 + LENGTHS * marks, 1 + shared * marks + last % marks)


def is_shared(ids: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    return ids <= LENGTHS * marks_for(classes)


def _letters(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of the words with the byte before it, where words start, and the words' last bytes."""
    raw, ends = _bytes_of(flat)
    raw, starts = raw[ends[0] : ends[-1]], ends[:-1] - ends[0]
    before = np.concatenate((raw[:0] if not len(raw) else [SPACE], raw[:-1])).astype(np.int64)
    before[starts] = SPACE
    return before, raw.astype(np.int64), starts, raw[ends[1:] - ends[0] - 1].astype(np.int64)


def spelled(flat: pa.Array, spelling: np.ndarray) -> np.ndarray:
    """Log-probability of each word's spelling."""
    before, after, starts, last = _letters(flat)
    if not len(flat):
        return np.zeros(0)
    return np.add.reduceat(spelling[before, after], starts) + spelling[last, SPACE]


def padded(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one row with ``SIDE`` boundaries around each; places of the tokens."""
    n = np.diff(offsets)
    place = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(n)), n))
    row = np.zeros(len(ids) + SIDE * (len(n) + 1), dtype=np.int64)
    row[place] = ids
    return row, place


def hidden(net: Network, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hidden vectors from both sides, with a last column of ones for the bias."""
    total = np.zeros((len(place), DIMENSIONS), dtype=np.float32)
    for p, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        total += net.embed[p][row[place + step]]
    return np.concatenate((np.tanh(total), np.ones((len(place), 1), dtype=np.float32)), axis=1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _by_class(target: np.ndarray, classes: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort((target // classes).astype(np.uint16), kind="stable")
    cuts = np.searchsorted(target[order] // classes, np.arange(classes + 1))
    for c in range(classes):
        if cuts[c] < cuts[c + 1]:
            yield c, order[cuts[c] : cuts[c + 1]]


def log_probabilities(net: Network, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log-probability of each token's id given the tokens on both sides."""
    out = np.empty(len(place), dtype=np.float64)
    for at in range(0, len(place), BATCH):
        part = place[at : at + BATCH]
        target, h = row[part], hidden(net, row, part)
        logp = _log_softmax(h @ net.to_class.T)[np.arange(len(part)), target // net.classes].astype(np.float64)
        for c, some in _by_class(target, net.classes):
            logp[some] += _log_softmax(h[some] @ net.to_word[c].T)[np.arange(len(some)), target[some] % net.classes]
        out[at : at + BATCH] = logp
    return out


def gradient(net: Network, row: np.ndarray, part: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Slope of the summed log-probability of some places in every weight, and the sum itself."""
    target, h = row[part], hidden(net, row, part)
    rows = np.arange(len(part))
    logp = _log_softmax(h @ net.to_class.T)
    total = float(logp[rows, target // net.classes].sum())
    miss = -np.exp(logp)
    miss[rows, target // net.classes] += 1
    d_class = miss.T @ h
    d_h = miss @ net.to_class
    d_word = np.zeros_like(net.to_word)
    for c, some in _by_class(target, net.classes):
        hs = h[some]
        logp = _log_softmax(hs @ net.to_word[c].T)
        inside = np.arange(len(some)), target[some] % net.classes
        total += float(logp[inside].sum())
        miss = -np.exp(logp)
        miss[inside] += 1
        d_word[c] = miss.T @ hs
        d_h[some] += miss @ net.to_word[c]
    d_sum = (d_h * (1 - h * h))[:, :DIMENSIONS]
    d_embed = np.empty_like(net.embed)
    for p, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        cells = row[part + step][:, None] * DIMENSIONS + np.arange(DIMENSIONS)
        d_embed[p] = np.bincount(cells.ravel(), d_sum.ravel(), d_embed[p].size).reshape(d_embed[p].shape)
    return [d_embed, d_class, d_word], total


def learn(net: Network, squares: list[np.ndarray], row: np.ndarray, place: np.ndarray, rate: float = RATE) -> None:
    """One walk over the tokens with adaptive steps."""
    for at in range(0, len(place), BATCH):
        part = place[at : at + BATCH]
        slopes, _ = gradient(net, row, part)
        for weights, square, slope in zip(net.parts(), squares, slopes):
            slope /= len(part)
            square += slope * slope
            weights += rate * slope / np.sqrt(square)


def word_counts(docs: DataFrame) -> DataFrame:
    """Every word of all documents and how often it occurs."""
    schema = common.schema_of(("word", T.StringType()), ("n", T.LongType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for part in common.text_slices(batch):
                pairs = pc.value_counts(words_of(part.column("text"))[0])
                found = pa.table({"word": pairs.field("values"), "n": pairs.field("counts")})
                held = found if held is None else pa.concat_tables([held, found])
                if held.num_rows > COUNTED:
                    held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > COUNTED:
                    for b in held.to_batches(max_chunksize=50_000):
                        yield common.record_batch([b.column(0), b.column(1)], schema)
                    held = None
        if held is not None:
            held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            for b in held.to_batches(max_chunksize=50_000):
                yield common.record_batch([b.column(0), b.column(1)], schema)

    return common.map_tasks(docs.select("text"), count, schema).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(docs: DataFrame) -> Lexicon:
    """Words counted over all documents; ids by frequency, ties in alphabetical order."""
    counts = sink.materialize(word_counts(docs), "words")
    classes = classes_for(counts.count())
    words = [r.word for r in counts.orderBy(F.col("n").desc(), "word").limit(own_words(classes)).collect()]
    # A quarter of a power of two is the step in which the least count is found: no ranking of all words.
    step = F.floor(F.log2("n") * 4)
    least, within = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        within += r["count"]
        if within > FREQUENT:
            least = r.step + 1
            break
    short = counts.where((step >= least) & (F.octet_length("word") <= LONGEST)).collect()
    own = set(words)
    frequent = {r.word: r.n for r in short if r.word not in own}
    schema = common.schema_of(("cell", T.IntegerType()), ("n", T.LongType()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bytes after bytes over distinct words, then occurrences of the shared ids.
        vocabulary = pa.array(words, pa.large_string())
        pairs, shared = np.zeros(1 << 16, dtype=np.int64), np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("word").cast(pa.large_string())
            before, after, _, last = _letters(flat)
            pairs += np.bincount(before << 8 | after, minlength=1 << 16) + np.bincount(last << 8 | SPACE, minlength=1 << 16)
            ids = token_ids(flat, vocabulary, classes)
            some = is_shared(ids, classes)
            np.add.at(shared, ids[some], batch.column("n").to_numpy(zero_copy_only=False)[some])
        every = np.concatenate((pairs, shared))
        cells = np.flatnonzero(every)
        if len(cells):
            yield common.record_batch([cells.astype(np.int32), every[cells]], schema)

    every = np.zeros((1 << 16) + classes * classes, dtype=np.int64)
    for r in common.map_tasks(counts, gather, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        every[r.cell] = r.n
    pairs = every[: 1 << 16].reshape(256, 256) + 1.0
    return Lexicon(classes, words, counts, frequent, every[1 << 16 :], np.log(pairs / pairs.sum(axis=1, keepdims=True)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Lexicon, Network]:
    docs = common.keyed_text(df, id_col, text_col)
    lexicon = lexicon_of(docs)
    words, classes = lexicon.words, lexicon.classes
    net = Network.fresh(classes=classes)
    schema = common.schema_of(("i", T.IntegerType()), ("tokens", T.LongType()), ("w", T.DoubleType()))

    def walk(start: Network):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = pa.array(words, pa.large_string())
            own = Network.of(start.flat(), classes)
            squares = [np.full_like(p, 1e-6) for p in own.parts()]
            tokens = 0
            for batch in batches:
                for part in common.text_slices(batch):
                    flat, offsets = words_of(part.column("text"))
                    row, place = padded(token_ids(flat, vocabulary, classes), offsets)
                    learn(own, squares, row, place)
                    tokens += len(place)
            if tokens:
                flat = own.flat().astype(np.float64)
                for at in range(0, len(flat), 10_000):
                    w = flat[at : at + 10_000]
                    index = np.arange(at, at + len(w), dtype=np.int32)
                    yield common.record_batch([index, np.full(len(w), tokens), w], schema)

        return run

    for r in range(rounds):
        turn = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(rounds)) == r
        gathered = common.map_tasks(docs.where(turn).select("text"), walk(net), schema)
        means = gathered.groupBy("i").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w"))
        found = sink.materialize(means, "network").toPandas()
        if len(found):
            flat = np.zeros(len(net.flat()))
            flat[found["i"].to_numpy()] = found["w"].to_numpy()
            net = Network.of(flat, classes)
    return lexicon, net


def _parts(docs: DataFrame, lexicon: Lexicon, net: Network) -> DataFrame:
    """Per row one part under a key that is no word, and one part for each word whose count is still to come."""
    schema = common.schema_of(
        ("row", T.LongType()), ("word", T.StringType()), ("value", T.DoubleType()),
        ("n_tokens", T.LongType()), *common.fields(docs, "doc_id"),
    )
    words, classes, spelling = lexicon.words, lexicon.classes, lexicon.spelling
    among = np.log(lexicon.shared + 1.0)
    names, counted = list(lexicon.frequent), np.array(list(lexicon.frequent.values()), dtype=np.float64)

    def start():
        vocabulary, frequent = pa.array(words, pa.large_string()), pa.array(names, pa.large_string())
        among_words = np.log(counted + np.exp(spelled(frequent, spelling)))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                flat, offsets = words_of(part.column("text"))
                ids = token_ids(flat, vocabulary, classes)
                row, place = padded(ids, offsets)
                logp = log_probabilities(net, row, place)
                some = np.flatnonzero(is_shared(ids, classes))
                logp[some] -= among[ids[some]]
                found = pc.index_in(flat.take(pa.array(some)), value_set=frequent)
                known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
                logp[some[known >= 0]] += among_words[known[known >= 0]]
                some = some[known < 0]
                sums = np.concatenate(([0.0], np.cumsum(logp)))
                keys = part.column("row").to_numpy()
                yield common.record_batch(
                    [keys, [f" {k}" for k in keys.tolist()], sums[offsets[1:]] - sums[offsets[:-1]], np.diff(offsets), part.column("doc_id")],
                    schema,
                )
                rare, owner = flat.take(pa.array(some)), np.repeat(keys, np.diff(offsets))[some]
                for at in range(0, len(rare), OUT_ROWS):
                    few = rare.slice(at, OUT_ROWS)
                    none = pa.nulls(len(few))
                    yield common.record_batch([owner[at : at + OUT_ROWS], few, spelled(few, spelling), none, none], schema)

        return step

    return common.map_batches(docs.withColumn("row", F.monotonically_increasing_id()), schema, start)


def score(df: DataFrame, lexicon: Lexicon, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed) and score (its mean per token) of every row."""
    parts = _parts(common.keyed_text(df, id_col, text_col), lexicon, net)
    joined = parts.join(lexicon.counts, "word", "left")
    # Only words of the corpus have a count; what a row's own part holds and a spelling are logarithms already.
    value = F.when(F.col("n").isNull(), F.col("value")).otherwise(F.log(F.col("n") + F.exp("value")))
    rows = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.round(value * UNIT).cast("long")) / UNIT).alias("log_likelihood"),
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.select("doc_id", "n_tokens", "log_likelihood", mean.alias("score"))
