"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  The random field works
on atoms (runs of letters, runs of digits, single other characters) and scores whole candidate
spans: how many digits and groups they have, the check digit, the range of the groups, brackets, the
neighbouring atoms.  A dynamic program over segments of bounded length chooses boundaries and kinds
together; a chosen span is added when its probability reaches ``LEAST`` and it overlaps no span of
the patterns.  Those always stay.

Every entity holds a digit or an at sign, so only regions around these are decoded, joined wherever an
entity can reach from one into the next; between regions nothing can be an entity, which makes this
equal to decoding the whole text (tested).  Texts are used whole.

The field is trained here, on at most ``TRAIN_ROWS`` distinct texts with such characters, chosen by a
hash of the text: an equal share for each kind from the texts in which the patterns find it, the rest
from texts without any; ``TRAIN_REGIONS`` regions of each.  So every kind that occurs has examples,
however rare it is; a warning names one that is found in no region short enough to learn from.  The
patterns' spans are the labels; to learn more than the patterns, each labelled span is also shown rewritten (no country code, other
separators, a spelled at sign), and the digits of phone numbers also as a date, which is no entity.

Defined results: a null or empty text has no spans; equal rows each get a row; an empty table gives
no rows and, as does one without labels, no added spans; extra columns are never read.
"""

from __future__ import annotations

import functools
import operator
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segflux.llm import common
from segflux.sources import sink

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, TRAIN_REGIONS = 800, 8
MOST_ATOMS = 24
"""Atoms of an entity at most."""
LEAST = 0.9
Span = tuple[int, int, str]

# The patterns.  Lookarounds only keep the search linear; they change no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """For each at sign, the longest local part before it that follows the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns (code points, end exclusive), by start, then kind as listed."""
    spans: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 20) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# Regions: atoms around a digit or an at sign, joined over the marks an entity may hold.
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\[at\]|\(at\)|.", re.DOTALL)
_AHEAD = re.compile(rf"(?:[A-Za-z]++|[0-9]++|\[at\]|\(at\)|\S){{0,{MOST_ATOMS + 1}}}+")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARKS = frozenset("+ ().-")
"""Marks of card and phone numbers; other kinds hold no white space."""


def _atom_before(text: str, a: int, floor: int) -> int:
    """Start of the atom that ends at ``a``; there are no digits and at signs to meet."""
    if text[a - 1] not in _LETTERS:
        return a - 1
    while a > floor and text[a - 1] in _LETTERS:
        a -= 1
    return a


def regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text where entities can be, with an atom of context."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        a = m.start()
        floor = out[-1][1] if out else 0
        for _ in range(MOST_ATOMS + 1):
            if a == floor or text[a - 1].isspace() and text[a - 1] not in _MARKS:
                break
            if text[a - 1] == " " and any(c not in _MARKS for c in text[a : m.start()]):
                break  # beyond the space only marks can belong to an entity, and none holds what is here
            a = _atom_before(text, a, floor)
        b = _AHEAD.match(text, m.end()).end()
        if out and 0 <= a - out[-1][1] <= 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@dataclass
class Lattice:
    """Atoms of a region and its candidate segments with their features."""

    bounds: list[int]  # atom i covers bounds[i] to bounds[i + 1]
    segments: list[tuple[int, int, int]]  # first atom, atom after the last, kind
    features: np.ndarray  # one row per segment


N_FEATURES = 22


def _features(text: str, atoms: list[str], i: int, j: int, kind: int) -> list[float] | None:
    """Features of atoms i to j as one entity; None when it can't be one of this kind."""
    span = atoms[i:j]
    whole = "".join(span)
    digits = "".join(a for a in span if a[0].isascii() and a[0].isdigit())
    groups = [a for a in span if a[0].isascii() and a[0].isdigit()]
    ats = [a for a in span if a in ("@", "[at]", "(at)")]
    n = len(digits)
    marks = set(a for a in span if not a[0].isalnum()) - set(ats)
    if kind == 0:
        if len(ats) != 1 or not _LOCAL.match(whole.split(ats[0])[0]) or not _DOMAIN.fullmatch(whole.split(ats[0])[1]):
            return None
    elif kind == 1:
        if len(groups) != 4 or ats or any(a.isalpha() for a in span) or not marks <= {".", "[", "]"}:
            return None
    elif ats or any(a.isalpha() for a in span) or not marks <= set("+ ().-"):
        return None
    elif kind == 2 and (not 14 <= n <= 19 or "+" in span or not luhn(digits)):
        return None
    elif kind == 3 and not 10 <= n <= 15:
        return None
    sizes = [len(g) for g in groups]
    before = atoms[i - 1] if i else " "
    after = atoms[j] if j < len(atoms) else " "
    host = whole.split(ats[0])[1] if ats else ""
    return [
        1.0,
        float(luhn(digits)) if n else 0.0,
        float(bool(n) and not luhn(digits)),
        float(all(int(g) <= 255 for g in groups if len(g) < 5) and all(s < 4 for s in sizes)),
        float(any(s > 3 for s in sizes) or any(int(g) > 255 for g in groups if len(g) < 5)),
        float(whole.startswith("+")),
        float("(" in marks and whole.count("(") == whole.count(")")),
        float(whole.count("(") != whole.count(")")),
        float(sizes[-3:] == [3, 3, 4]),
        float(len(groups) == 1),
        float(bool(sizes) and set(sizes) == {4}),
        float(n in (10, 11)),
        float(n == 16),
        float(n in (13, 14, 15, 17, 18, 19)),
        float(len(marks - {"+", "(", ")", "[", "]", " "}) > 1),
        float(before[-1:].isalnum() or before in "+@.-_%/="),
        float(after[:1].isalnum() or after in "@-_%/="),
        float(before.isspace() or before in ",;:(\"'"),
        float(after.isspace() or after in ",.;:)\"'!?"),
        float(len(host.split(".")[-1]) >= 2 and host.split(".")[-1].isalpha()),
        float(len(ats) == 1 and ats[0] == "@"),
        min(len(span), MOST_ATOMS) / MOST_ATOMS,
    ]


def lattice(text: str, start: int, end: int) -> Lattice:
    """Candidate segments of one region; one character of context on both sides counts as atoms."""
    atoms, bounds = [], []
    for m in _ATOM.finditer(text, start, end):
        atoms.append(m[0])
        bounds.append(m.start())
    bounds.append(end)
    n = len(atoms)
    digits = np.concatenate(([0], np.cumsum([len(a) if a[0] in "0123456789" else 0 for a in atoms]))).tolist()
    groups = np.concatenate(([0], np.cumsum([a[0] in "0123456789" for a in atoms]))).tolist()
    ats = np.concatenate(([0], np.cumsum([a in ("@", "[at]", "(at)") for a in atoms]))).tolist()
    segments, rows = [], []
    for i in range(n):
        if not (atoms[i][0].isalnum() or atoms[i] in "+(._%-"):
            continue
        for j in range(i + 1, min(n, i + MOST_ATOMS) + 1):
            if not atoms[j - 1][0].isalnum():
                continue
            kinds = []
            d = digits[j] - digits[i]
            if ats[j] - ats[i] == 1:
                kinds.append(0)
            if groups[j] - groups[i] == 4 and d <= 12:
                kinds.append(1)
            if 10 <= d <= 19:
                kinds += [2] * (d >= 14) + [3] * (d <= 15)
            for k in kinds:
                row = _features(text, atoms, i, j, k)
                if row is not None:
                    segments.append((i, j, k))
                    rows.append(row)
    return Lattice(bounds, segments, np.array(rows).reshape(-1, N_FEATURES))


def chart(lat: Lattice, weights: np.ndarray, most: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of segments; forward and backward sums (or maxima) over segmentations.

    An atom outside entities scores 0.
    """
    n = len(lat.bounds) - 1
    score = (lat.features * weights[[k for _, _, k in lat.segments]]).sum(axis=1) if lat.segments else np.zeros(0)
    add = max if most else np.logaddexp
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(lat.segments):
        ending[j].append(s)
        starting[i].append(s)
    for j in range(1, n + 1):
        best = ahead[j - 1]
        for s in ending[j]:
            best = add(best, ahead[lat.segments[s][0]] + score[s])
        ahead[j] = best
    for i in range(n - 1, -1, -1):
        best = back[i + 1]
        for s in starting[i]:
            best = add(best, back[lat.segments[s][1]] + score[s])
        back[i] = best
    return score, ahead, back


def decode(lat: Lattice, weights: np.ndarray) -> list[tuple[int, float]]:
    """The best segmentation's segments, each with its probability."""
    if not lat.segments:
        return []
    score, ahead, back = chart(lat, weights, most=True)
    ending: list[list[int]] = [[] for _ in lat.bounds]
    for s, (_, j, _) in enumerate(lat.segments):
        ending[j].append(s)
    chosen, at = [], len(lat.bounds) - 1
    while at:
        for s in ending[at]:
            if ahead[lat.segments[s][0]] + score[s] == ahead[at] and ahead[at] > ahead[at - 1]:
                chosen.append(s)
                at = lat.segments[s][0]
                break
        else:
            at -= 1
    score, ahead, back = chart(lat, weights, most=False)
    total = ahead[-1]
    return [(s, float(np.exp(ahead[lat.segments[s][0]] + score[s] + back[lat.segments[s][1]] - total))) for s in chosen]


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (kind, feature) that raise the conditional likelihood of the labelled segments."""
    seen = []
    for text, spans in examples:
        lat = lattice(text, 0, len(text))
        gold = {(a, b, KINDS.index(k)) for a, b, k in spans}
        marks = np.array([(lat.bounds[i], lat.bounds[j], k) in gold for i, j, k in lat.segments], dtype=float)
        if lat.segments:
            seen.append((lat, marks))
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    squares = np.full_like(weights, 1e-6)
    for _ in range(rounds if seen else 0):
        slope = -decay * len(seen) * weights
        for lat, marks in seen:
            score, ahead, back = chart(lat, weights, most=False)
            ends = np.array(lat.segments)
            chance = np.exp(ahead[ends[:, 0]] + score + back[ends[:, 1]] - ahead[-1])
            np.add.at(slope, ends[:, 2], (marks - chance)[:, None] * lat.features)
        slope /= len(seen)
        squares += slope * slope
        weights += rate * slope / np.sqrt(squares)
    return weights


def rewritten(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The same region with its only labelled span written in other ways."""
    if len(spans) != 1:
        return []
    a, b, kind = spans[0]
    found = text[a:b]
    forms = []
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "phone" and len(digits) in (10, 11):
        d = digits[-10:]
        forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]
    elif kind == "card" and len(digits) == 16:
        forms = [mark.join(digits[i : i + 4] for i in range(0, 16, 4)) for mark in (" ", "-", ".")]
    elif kind == "email":
        forms = [found.replace("@", at) for at in ("[at]", "(at)")]
    elif kind == "ip":
        forms = [found.replace(".", "[.]")]
    out = [(text[:a] + f + text[b:], [(a, a + len(f), kind)]) for f in forms]
    if kind == "phone" and len(digits) >= 10:
        d = digits[-10:]
        out += [(text[:a] + f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:]}:{d[:2]}" + text[b:], []), (text[:a] + d + text[b:], [])]
    return out


def _examples(text: str) -> tuple[set[str], dict[str, list[tuple[str, list[Span]]]]]:
    """Kinds the patterns find in a text; for each kind to learn ("" without any) the labelled regions."""
    spans = base_spans(text)
    parts = [(a, b) for a, b in regions(text) if b - a <= 400]
    inside = {p: [(x - p[0], y - p[0], k) for x, y, k in spans if p[0] <= x and y <= p[1]] for p in parts}
    kinds = {k for _, _, k in spans}
    out = {}
    for kind in kinds or {""}:
        # Regions with the kind first, then those with others.
        order = sorted(parts, key=lambda p: (-any(k == kind for _, _, k in inside[p]), not inside[p]))[:TRAIN_REGIONS]
        if order and (not kind or any(k == kind for _, _, k in inside[order[0]])):
            out[kind] = [(text[a:b], inside[a, b]) for a, b in order]
    return kinds, out


def train(df: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Weights from a bounded sample of documents; None when there is nothing to learn."""
    texts = df.select(common.column(df, text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.select("text", F.xxhash64(F.lit(5), "text").alias("h"))
    pair = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = common.schema_of(("wanted", T.StringType()), ("h", T.LongType()), ("region", T.StringType()), ("spans", T.ArrayType(pair)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each kind the texts of the smallest hashes; a row without a hash names a kind that occurs.
        held: dict[str, dict[int, list]] = {k: {} for k in ("", *KINDS)}
        bound = dict.fromkeys(held, 1 << 63)
        occur: set[str] = set()

        def shrink(kind: str) -> None:
            low = sorted(held[kind])[:train_rows]
            held[kind] = {h: held[kind][h] for h in low}
            if len(low) == train_rows:
                bound[kind] = low[-1]

        for batch in batches:
            for part in common.text_slices(batch):
                for text, h in zip(part.column("text").to_pylist(), part.column("h").to_pylist()):
                    found = {k for _, _, k in base_spans(text)}
                    occur |= found
                    if all(h >= bound[k] or h in held[k] for k in found or {""}):
                        continue
                    for kind, regions_of in _examples(text)[1].items():
                        if h < bound[kind]:
                            held[kind][h] = regions_of
                            if len(held[kind]) >= 2 * train_rows:
                                shrink(kind)
        out = [(kind, None, None, None) for kind in sorted(occur)]
        for kind in held:
            shrink(kind)
            for h, kept in held[kind].items():
                out += [(kind, h, region, [dict(zip("ab", s), kind=s[2]) for s in spans]) for region, spans in kept]
        if out:
            yield common.record_batch(list(zip(*out)), schema)

    drawn = sink.materialize(common.map_tasks(texts, run, schema), "labelled-regions")
    seen = drawn.select("wanted", "h").distinct().toPandas()
    hashes = {k: np.sort(seen.loc[seen["wanted"].eq(k) & seen["h"].notna(), "h"].astype("int64").to_numpy()) for k in ("", *KINDS)}
    for kind in KINDS:
        if seen["wanted"].eq(kind).any() and not len(hashes[kind]):
            warnings.warn(f"the patterns find {kind}, but in no region to learn from", stacklevel=2)
    share = train_rows // (len(KINDS) + 1)
    few = {k: hashes[k][:share] for k in KINDS}
    few[""] = hashes[""][: train_rows - sum(map(len, few.values()))]
    if not any(len(few[k]) for k in KINDS):
        return None
    chosen = [(F.col("wanted") == k) & (F.col("h") <= int(v[-1])) for k, v in few.items() if len(v)]
    rows = drawn.where(functools.reduce(operator.or_, chosen)).select("region", "spans").collect()
    found = sorted({(r.region, tuple((s.a, s.b, s.kind) for s in r.spans)) for r in rows})
    examples = [(region, _disjoint(list(spans))) for region, spans in found]
    return fit(examples + [e for x in examples for e in rewritten(*x)])


def _disjoint(spans: list[Span]) -> list[Span]:
    """Of overlapping labels the longer one: a segmentation has one label for an atom."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in out):
            out.append(s)
    return in_order(out)


def added_spans(text: str, base: list[Span], weights: np.ndarray | None, least: float = LEAST) -> list[Span]:
    """Entities of the random field that overlap no pattern's span."""
    if weights is None:
        return []
    out = []
    for a, b in regions(text):
        lat = lattice(text, a, b)
        for s, chance in decode(lat, weights):
            i, j, k = lat.segments[s]
            low, high = lat.bounds[i], lat.bounds[j]
            if chance >= least and all(high <= x or y <= low for x, y, _ in base):
                out.append((low, high, KINDS[k]))
    return out


def find_spans(df: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (all), each as kind:start:end, comma-joined."""
    docs = common.keyed_text(df, id_col, text_col)
    schema = common.schema_of(*common.fields(docs, "doc_id"), ("base", T.StringType()), ("spans", T.StringType()))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch):
                base, spans = [], []
                for text in part.column("text").to_pylist():
                    found = base_spans(text) if text else []
                    more = added_spans(text, found, weights) if text else []
                    base.append(written(found))
                    spans.append(written(in_order(found + more)))
                yield common.record_batch([part.column("doc_id"), base, spans], schema)

        return step

    return common.map_batches(docs, schema, start)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    k = 0
    spans = in_order(spans)
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def mask_texts(df: DataFrame, weights: np.ndarray | None, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``df`` with personal data in its texts replaced; ``size_col`` then gets the new length."""

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in common.text_slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                new = []
                for text in texts:
                    base = base_spans(text) if text else []
                    new.append(masked(text, base + added_spans(text, base, weights)) if text else text)
                columns = {n: part.column(n) for n in part.schema.names}
                columns[text_col] = pa.array(new, part.schema.field(text_col).type)
                if size_col in columns:
                    sizes = [old if a == b else len(b) for old, a, b in zip(columns[size_col].to_pylist(), texts, new)]
                    columns[size_col] = pa.array(sizes, part.schema.field(size_col).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return step

    return common.map_batches(df, df.schema, start)
