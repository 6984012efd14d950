"""Token ids of whole texts with a public tokenizer, each distinct word encoded once.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
white-space-separated chunks in order.  A chunk of plain Latin letters, digits and punctuation is
first cut by the pre-tokenizer's own rule, so ``word``, ``Word`` and ``word,`` share one call.  Any
other chunk goes to the tokenizer as it is.  The result equals
``Tokenizer.encode(text, add_special_tokens=False)``; tests compare the two.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CACHE_WORDS = 600_000
"""Distinct words an encoder remembers; beyond that it starts afresh (results do not change)."""

LINE_WORDS = 1024
"""Words given to the tokenizer in one line."""

# Chunks of these characters: letters below U+0250 are stable under composition and lower
# case alone, save U+0130; the controls U+0080 to U+00A0 hold white space of other kinds.
_PLAIN = r"^[\t\n\r\x20-\x7E\x{A1}-\x{12F}\x{131}-\x{24F}]*$"
# Fixed value: the pre-tokenizer's own pieces other than runs of letters.
_PIECES = r"('(?:s|t|re|ve|m|ll|d)|\pN|[^\s\pL\pN]+)"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Words met so far and their ids, kept as Arrow arrays (some 40 bytes a word)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))

    def _encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of words in one list, and the number of each word's ids."""
        ids: list[int] = []
        counts: list[int] = []
        for at in range(0, len(words), LINE_WORDS):
            for encoded in self.tokenizer.encode_batch_fast(words[at : at + LINE_WORDS], add_special_tokens=False):
                got = encoded.ids
                ids += got
                counts.append(len(got))
        return ids, counts

    def _encode_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for single pieces, many to a call: the last id of a piece is a word end."""
        ids, counts = [], []
        for at in range(0, len(words), LINE_WORDS):
            line = words[at : at + LINE_WORDS]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[got])
            if len(ends) == len(line) and ends[-1] == len(got) - 1:
                sizes = np.diff(ends, prepend=-1)
            else:
                alone, sizes = self._encode_words(line)
                got = np.array(alone, dtype=np.uint32)
            ids.append(got)
            counts.append(sizes)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, words: pa.Array, single: bool) -> None:
        """Encode words met for the first time and append them to the known ones."""
        texts = words.to_pylist()
        ids, counts = self._encode_lines(texts) if single else self._encode_words(texts)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.uint32()))
        self.words = pa.concat_arrays([self.words, words])
        self.ids = pa.concat_arrays([self.ids, lists])

    def _lists(self, pieces: pa.Array, single: bool) -> pa.Array:
        """The id list of each piece."""
        found = pc.index_in(pieces, value_set=self.words)
        if found.null_count:
            unknown = pc.is_null(found)
            fresh = pieces.filter(unknown)
            new, known = fresh.unique(), len(self.words)
            self._learn(new, single)
            late = pc.add(pc.index_in(fresh, value_set=new), pa.scalar(known, pa.int32()))
            found = pc.replace_with_mask(found, unknown, late)
        return self.ids.take(found)

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts (one entry more than texts).

        A null text counts as empty.  ``end_id`` is put after every text when given.
        """
        if len(self.words) > CACHE_WORDS:
            self._forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        split = pc.replace_substring_regex(pc.ascii_lower(chunks.filter(plain)), _PIECES, r" \1 ")
        pieces = pc.ascii_split_whitespace(split)
        small = self._lists(pieces.flatten(), True)
        whole = self._lists(chunks.filter(pc.invert(plain)), False)
        # Ids of plain chunks first, then those of the others; ``row`` finds a chunk's list again.
        ends = small.offsets.to_numpy()[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        ends, more = ends - ends[0], whole.offsets.to_numpy()
        bounds = np.concatenate((ends, ends[-1] + more[1:] - more[0]))
        pool = pa.concat_arrays([small.flatten(), whole.flatten()])
        by_chunk = pa.LargeListArray.from_arrays(pa.array(bounds), pool)
        mask = plain.to_numpy(zero_copy_only=False)
        row = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
        lists = by_chunk.take(pa.array(row[coded.indices.to_numpy(zero_copy_only=False)], pa.int64()))
        ids = lists.flatten().to_numpy()
        at = words.offsets.to_numpy()
        starts = lists.offsets.to_numpy()
        offsets = starts[at - at[0]] - starts[0]
        return (ids, offsets) if end_id is None else with_ends(ids, offsets, end_id)


def with_ends(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, dtype="<u4")
    marks = offsets[1:] + np.arange(n)
    keep = np.ones(len(out), dtype=bool)
    keep[marks] = False
    out[keep] = ids
    out[marks] = end_id
    return out, offsets + np.arange(n + 1)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; later tasks on it find its words known."""
    return WordEncoder(path)
