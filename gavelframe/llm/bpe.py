"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

``BytePairCodec`` reads a public vocabulary file (vocabulary, merges, added tokens).  Encoding
cuts texts into pre-tokens, puts the symbols of many new words into one flat array and runs
merge rounds over all of them at once: in a round every unfinished word merges all occurrences
of its lowest-rank adjacent pair, found by binary search over the sorted pair keys.  Decoding
gathers token bytes from one flat table.  The memos of a worker are bounded in characters, so that
two workers fit beside a full executor heap; smaller ones cost time, never results.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ''.
Repeated rows give equal results.  Texts of any length are encoded whole; strings of added
tokens inside a text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelframe.llm.segments import TextEncoder, chunks, flatten

_NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    def __init__(self, path: str, piece_chars: int = 2_000_000, word_chars: int = 500_000):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        data = [b""] * size
        for token, i in vocab.items():
            data[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            data[i] = token.encode()
        self.size = size
        self.token_lengths = np.fromiter(map(len, data), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.fromiter((vocab[a] * size + vocab[b] for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int32)
        self.pair_results = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))  # by rank
        self.texts = TextEncoder(lambda words: self.encode_words([w.encode() for w in words]), self.added, piece_chars, word_chars)

    # -- encoding ---------------------------------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; _NONE if it does not merge."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE).astype(np.int32)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words in one flat array, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        done_words, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            finished = best == _NONE
            if finished.any():
                done_words.append(word[finished])
                done_symbols.append(symbols[finished])
                going = ~finished
                symbols, word, ranks, best = symbols[going], word[going], ranks[going], best[going]
                if not len(symbols):
                    break
            hit = ranks == best
            at = np.flatnonzero(hit)
            # in a run of overlapping hits (a a a) the leftmost wins, then every second one
            run_first = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - np.repeat(at[run_first], np.diff(np.append(np.flatnonzero(run_first), len(at))))) % 2 == 0]
            symbols[at] = self.pair_results[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, word, ranks, changed = symbols[keep], word[keep], ranks[keep], changed[keep]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            ranks[again] = _NONE
            again = again[again + 1 < len(word)]
            again = again[word[again] == word[again + 1]]
            ranks[again] = self._ranks(symbols[again], symbols[again + 1])
        if not done_words:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        return self.texts.encode(texts)

    # -- decoding ---------------------------------------------------------------------------
    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary adds nothing."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.size)
        safe = np.where(known, ids, 0)
        sizes = np.where(known, self.token_lengths[safe], 0)
        data = flatten(self.token_bytes, self.token_starts[safe], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec a worker process."""
    return BytePairCodec(path)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids array<int>, decoded string) of every row: ids of the whole text, and their decoding.

    One pass over the rows without a shuffle; memory is bounded by a chunk of texts.  Evaluate it
    under ``storage.bounded_batches`` (``Scratch.save_bounded``) where texts are long.
    """
    source = docs.select(F.col(key), F.col(text).alias("text_in"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, lengths = tool.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                token_ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), token_ids, pa.array(tool.decode(ids, lengths), pa.string())], names=[key, "token_ids", "decoded"])

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids) of every row."""
    source = docs.select(F.col(key), F.col(text).alias("text_in"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, lengths = tool.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=[key, "token_ids"])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, decoded) of every row; a null list counts as empty."""
    source = rows.select(F.col(key), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids_in"))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tool.decode(lists.flatten().to_numpy(), lengths), pa.string())], names=[key, "decoded"])

    return source.mapInArrow(run, schema)
