"""Splitting texts at spaces where byte-level BPE can never merge across, with memoised pieces.

The byte-level pre-tokenizer attaches one space to the word that follows it.  A space that has
a non-space character on either side therefore always starts a new pre-token, and the tokens of
a text are the tokens of its pieces.  Natural text repeats its pieces, so each worker encodes a
piece once and then gathers ids from one flat table.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import regex

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the byte-level pre-tokenizer's pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
CHUNK_CHARS = 1_000_000


def _odd(text: str) -> bool:
    """Whether a space may stand beside other white space or at an end; True is always safe."""
    if text.isascii() and not any(c in text for c in _ASCII_SPACE):
        return text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text
    # as many words as single spaces and line feeds allow: no runs, no other white space
    return len(text.split()) != text.count(" ") + text.count("\n") + 1


def pieces_of(text: str) -> list[str]:
    """Pieces in order; every piece but the first is preceded by one (dropped) space."""
    return (_SAFE_SPACE.split(text) if _odd(text) else text.split(" ")) if text else []


def ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit; a larger text is a range of its own."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start <= i:
        yield start, i + 1


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters."""
    return ranges(map(len, texts), limit)


def flatten(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class FlatTable:
    """Growing list of integer lists in one array."""

    def __init__(self, dtype=np.int32):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.lengths, self.rows = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> int:
        """Append len(lengths) lists; returns the row of the first."""
        first, n, m = self.rows, len(lengths), len(values)
        while self.used + m > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.values[self.used : self.used + m] = values
        ends = np.cumsum(lengths)
        self.starts[first : first + n] = self.used + ends - lengths
        self.lengths[first : first + n] = lengths
        self.used, self.rows = self.used + m, first + n
        return first

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        return flatten(self.values, self.starts[rows], lengths), lengths


class _Rows(dict):
    def __missing__(self, key):
        return -1


class Memo:
    """Rows of a flat table by key; forget() empties it once it holds more than limit characters."""

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode_new, self.limit = encode_new, limit
        self.rows, self.table, self.chars = _Rows(), FlatTable(), 0

    def forget(self) -> None:
        if self.chars > self.limit:
            self.rows, self.table, self.chars = _Rows(), FlatTable(), 0

    def encode(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all keys, and how many each has."""
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            first = self.table.extend(*self.encode_new(new))
            self.rows.update(zip(new, range(first, first + len(new))))
            self.chars += sum([len(k) for k in new if type(k) is str])
            rows[missing] = [self.rows[keys[i]] for i in missing]
        return self.table.gather(rows)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return ends[bounds[1:]] - ends[bounds[:-1]]


class TextEncoder:
    """Ids of whole texts from a function that encodes distinct pre-tokens.

    encode_words gets pre-tokens and returns (flat ids, ids per pre-token); added maps strings
    that are tokens of their own, wherever they stand, to their ids.  Both memos are bounded.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], piece_chars: int = 5_000_000, word_chars: int = 2_000_000):
        self.words = Memo(self._new_words, word_chars)
        self.pieces = Memo(self._new_pieces, piece_chars)
        self.encode_words, self.added = encode_words, added
        self.pretokens = regex.compile(PRETOKEN)
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists are made, none in cycles
        try:
            self.words.forget()
            self.pieces.forget()
            split = [pieces_of(t) for t in texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            for p in split:  # the first piece has no space before it: another key than the same word later on
                if p:
                    p[0] = (p[0],)
            ids, lengths = self.pieces.encode(list(chain.from_iterable(split)))
            return ids, sums(lengths, counts)
        finally:
            if collecting:
                gc.enable()

    def _new_pieces(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        special = self.specials is not None and self.specials.search("\n".join([k if type(k) is str else k[0] for k in keys]))
        cut = self._with_added if special else self.pretokens.findall
        whole, parts, single = [], [], np.zeros(len(keys), bool)
        for i, k in enumerate(keys):
            if type(k) is not str:
                parts.append(cut(k[0]))
            elif k.isalpha():  # letters only: one pre-token with its space, remembered as a piece already
                single[i] = True
                whole.append(" " + k)
            elif k[-1:] in (".", ",") and k[:-1].isalpha():
                parts.append((" " + k[:-1], k[-1]))
            else:
                parts.append(cut(" " + k))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, lengths = self.words.encode(list(chain.from_iterable(parts)))
        if not whole:
            return ids, sums(lengths, counts)
        more, sizes = self.encode_words(whole)
        out = np.empty(len(keys), np.int64)
        out[~single], out[single] = sums(lengths, counts), sizes
        starts = np.empty(len(keys), np.int64)
        starts[~single] = np.cumsum(out[~single]) - out[~single]
        starts[single] = len(ids) + np.cumsum(sizes) - sizes
        return flatten(np.concatenate([ids, more]), starts, out), out

    def _with_added(self, text: str) -> list:
        """Pre-tokens; an added token is its id."""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.pretokens.findall(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return out + self.pretokens.findall(text[at:])

    def _new_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w in words if type(w) is str]
        ids, lengths = self.encode_words(plain) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(plain) == len(words):
            return ids, lengths
        is_id = np.array([type(w) is not str for w in words])
        all_lengths = np.ones(len(words), np.int64)
        all_lengths[~is_id] = lengths
        values = np.zeros(int(all_lengths.sum()), np.int64)
        where = np.repeat(is_id, all_lengths)
        values[where] = [w for w in words if type(w) is not str]
        values[~where] = ids
        return values, all_lengths
