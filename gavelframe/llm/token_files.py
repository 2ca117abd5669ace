"""Flat token files: unsigned integer ids, 64-bit document offsets, memory-mapped reading.

A run is a folder of shards in ascending key order.  Shard k is two files:

* ``shard-k.bin``: the ids of its documents, one after another, as little-endian unsigned
  integers of 2 bytes (vocabularies up to 65,536) or 4;
* ``shard-k.idx``: int64 values: number of documents n, n keys, n flags (1: the key is null),
  n + 1 offsets into the .bin file, counted in ids.

Documents are range-partitioned by key, every task writes its shard through a temporary name,
and a shard's base (ids of all shards before it) is a prefix sum over one row a shard.

Defined results: a null text counts as empty and still gets its end id; rows with a null key
come first; repeated keys are all kept, in the order of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelframe.llm.segments import FlatTable, flatten, ranges, sums
from gavelframe.llm.storage import Scratch, atomic_output, file_system, new_path, trim_memory

_JOINED = 40
_BATCH_BYTES = 12_000_000
MANIFEST = "shard int, bin string, idx string, n_docs long, n_tokens long"
# White space of any of Python, Arrow and the library, as UTF-8 in one number; ASCII signs without the apostrophe.
_SPACES = np.array([*range(9, 14), *range(28, 33)])
_WIDE_SPACES = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SIGN = r"!-&(-/:-@\[-`{-~"
_LETTERS = r"^ ?\p{L}+$"
#: Letters, ASCII digits and signs, with single line feeds between them: pre-tokens are runs of one kind.
_PLAIN = rf"^ ?[\p{{L}}0-9{_SIGN}]+(?:\n[\p{{L}}0-9{_SIGN}]+)*$"
_KINDS = np.array([0 if b == 32 else 1 if b == 10 else 2 if 48 <= b < 58 else 3 if b > 127 or chr(b).isalpha() else 4 for b in range(256)], np.int8)


def matches(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


def raw(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, int64 offsets into them)."""
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The strings between the starts; the last one ends with the data."""
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def safe_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of spaces with a character other than white space on either side, in the same text."""
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    edge[offsets[1:] - (offsets[1:] > offsets[:-1])] = True
    at = np.flatnonzero(data == 32)
    at = at[~edge[at]]
    at = at[~np.isin(padded[at + 2], _SPACES) & ~np.isin(padded[at + 4], _SPACES)]
    wide = np.flatnonzero((padded[at + 2] > 127) | (padded[at + 4] > 127))
    byte = lambda k: padded[at[wide] + 3 + k].astype(np.int32)
    two, three = lambda k: byte(k) << 8 | byte(k + 1), lambda k: byte(k) << 16 | byte(k + 1) << 8 | byte(k + 2)
    spaced = np.isin(np.stack([two(-2), three(-3), two(1), three(1)]), _WIDE_SPACES).any(axis=0)
    return np.delete(at, wide[spaced])


class WordMemo:
    """Ids by string, looked up a column at a time; forget() empties it once its strings hold more than limit bytes."""

    def __init__(self, encode_new: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode_new, self.limit = encode_new, limit
        self.clear()

    def clear(self) -> None:
        self.words, self.table = pa.array([], pa.string()), FlatTable()

    def forget(self) -> None:
        if self.words.nbytes > self.limit:
            self.clear()

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        found = words.dictionary_encode()
        rows = pc.index_in(found.dictionary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = found.dictionary.take(pa.array(missing))
            first = self.table.extend(*self.encode_new(new))
            self.words = pa.concat_arrays([self.words, new])
            rows[missing] = np.arange(first, first + len(new))
        return self.table.gather(rows[found.indices.to_numpy()])


class LibraryEncoder:
    """Ids by the tokenizers library, a column of texts at a time.

    Texts are cut into pieces at safe spaces.  Each new pre-token of a plain piece, and each new piece of
    another kind, goes through the library once, many of them as one string, and is memoised afterwards.
    """

    def __init__(self, path: str, word_bytes: int = 16_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_lengths = np.zeros(1 + max(vocab.values()), np.int64)
        for token, i in vocab.items():  # a byte-level token has one letter a byte
            self.token_lengths[i] = len(added[i].encode()) if i in added else len(token)
        self.added = list(added.values())
        self.words = WordMemo(self._encode_words, word_bytes)

    def __call__(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        self.words.forget()
        data, offsets = raw(texts)
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        starts[safe_spaces(data, offsets)] = True  # a piece keeps the space before it
        starts = np.flatnonzero(starts[:-1])
        pieces = slices(data, starts).dictionary_encode()
        rows = pieces.indices.to_numpy()
        ids, lengths = self._encode_pieces(pieces.dictionary)
        counts = np.diff(np.searchsorted(starts, offsets))
        sizes = lengths[rows]
        return flatten(ids, (np.cumsum(lengths) - lengths)[rows], sizes), sums(sizes, counts)

    def _contains_added(self, strings: pa.Array) -> np.ndarray:
        out = np.zeros(len(strings), bool)
        for token in self.added:
            out |= pc.match_substring(strings, token).to_numpy(zero_copy_only=False)
        return out

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces are cut into pre-tokens; other pieces are left to the library whole."""
        plain = ~matches(pieces, _LETTERS) & matches(pieces, _PLAIN) & ~self._contains_added(pieces)
        data, offsets = raw(pieces.filter(pa.array(plain)))
        kinds = _KINDS[data]
        starts = np.ones(len(data), bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != 0)
        starts[offsets[:-1]] = True
        starts = np.flatnonzero(starts)
        ids, lengths = self.words.encode(pa.concat_arrays([pieces.filter(pa.array(~plain)), slices(data, starts)]))
        n = len(pieces) - len(offsets) + 1
        out, places = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        out[~plain], out[plain] = lengths[:n], sums(lengths[n:], np.diff(np.searchsorted(starts, offsets)))
        order = np.concatenate([np.flatnonzero(~plain), np.flatnonzero(plain)])
        places[order] = np.cumsum(out[order]) - out[order]
        return flatten(ids, places, out), out

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A string with its space, or after a line feed whose id is then taken off, stands in a longer one; those with other white space at an end or an added token stand alone."""
        spaced = matches(words, f"^ [^{_SPACE}]")
        alone = ~spaced & matches(words, f"^[{_SPACE}]") | matches(words, f"[{_SPACE}]$") | self._contains_added(words)
        flat, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        together = np.flatnonzero(~alone)
        if len(together):
            extra = ~spaced[together]
            units = pc.binary_join_element_wise(pa.array(["", "\n"]).take(pa.array(extra.astype(np.int8))), words.take(pa.array(together)), "")
            data, offsets = raw(units)
            strings = slices(data, offsets[:-1:_JOINED]).to_pylist()
            ids = np.fromiter(chain.from_iterable([e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]), np.int64)
            ends = np.cumsum(self.token_lengths[ids])
            cut = np.searchsorted(ends, offsets[1:]) + 1
            if cut[-1] != len(ids) or (ends[cut - 1] != offsets[1:]).any():  # never for a byte-level vocabulary
                raise ValueError("a token crosses a pre-token boundary")
            n = np.diff(cut, prepend=0)
            flat.append(np.delete(ids, (cut - n)[extra]))
            lengths.append(n - extra)
        rest = words.filter(pa.array(alone)).to_pylist()
        if rest:
            encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            flat += [np.array(e.ids, np.int64) for e in encoded]
            lengths.append(np.fromiter((len(e) for e in encoded), np.int64, len(rest)))
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        back = np.empty(len(words), np.int64)
        back[np.concatenate([together, np.flatnonzero(alone)])] = np.arange(len(words))
        return flatten(flat, (np.cumsum(lengths) - lengths)[back], lengths[back]), lengths[back]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each run."""
    ends = np.cumsum(lengths)
    return np.insert(ids, ends, end_id), lengths + 1


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to _BATCH_BYTES or a little more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, make_encoder: Callable[[], Callable], path: str, end_id: int = 0, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one shard a range of keys; returns the manifest, one row a shard (to be saved before use: reading it writes).

    make_encoder makes a function that takes a column of texts (a pyarrow array) to flat ids and their number a text.
    """
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = make_encoder()
        base = f"{path}/shard-{shard:07d}"
        keys, nulls, lengths = [], [], []
        with atomic_output(f"{base}.bin") as sink:
            for batch in gathered(batches):
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("<i8"))
                texts = batch.column(1)
                for a, b in ranges(pc.binary_length(texts).to_pylist(), _BATCH_BYTES):
                    ids, n = with_end(*encoder(texts.slice(a, b - a)), end_id)
                    if len(ids) and ids.max() >= 1 << (8 * width):
                        raise ValueError(f"an id needs more than {width} bytes")
                    sink.write(ids.astype(f"<u{width}").tobytes())
                    lengths.append(n)
        keys, nulls, lengths = (np.concatenate(x) if x else np.empty(0, "<i8") for x in (keys, nulls, lengths))
        trim_memory()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with atomic_output(f"{base}.idx") as sink:
            sink.write(np.concatenate([[len(keys)], keys, nulls, offsets]).astype("<i8").tobytes())
        if len(keys):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "bin": f"{base}.bin", "idx": f"{base}.idx", "n_docs": len(keys), "n_tokens": int(offsets[-1])}], schema=pa.schema([("shard", pa.int32()), ("bin", pa.string()), ("idx", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(run, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """base: ids in all shards before; one row a shard, so the window is small."""
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def open_array(path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the file system is local, else read."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.size == 0:
        return np.empty(0, dtype)
    if fs.type_name == "local":
        return np.memmap(at, dtype, "r")
    with fs.open_input_file(at) as source:
        return np.frombuffer(source.read(), dtype)


def read_shard(bin_path: str, idx_path: str, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, null flags, offsets, ids) of one shard, all mapped."""
    index = open_array(idx_path, "<i8")
    n = int(index[0])
    return index[1 : n + 1], index[n + 1 : 2 * n + 1], index[2 * n + 1 :], open_array(bin_path, f"<u{width}")


def read_token_files(manifest: DataFrame, width: int = 2, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, read from the files."""
    shards = with_bases(manifest).select("bin", "idx", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls, offsets, ids = read_shard(row["bin"], row["idx"], width)
                step = max(1, int(4_000_000 * len(keys) / max(1, int(offsets[-1]))))
                for a in range(0, len(keys), step):
                    b = min(len(keys), a + step)
                    part = np.asarray(ids[offsets[a] : offsets[b]]).astype("<u4")
                    cut = (offsets[a : b + 1] - offsets[a]).tolist()
                    crc = [zlib.crc32(part[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                    columns = [pa.array(np.asarray(keys[a:b]), pa.int64(), mask=np.asarray(nulls[a:b]) != 0), pa.array(row["base"] + np.asarray(offsets[a:b])), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())]
                    names = [key, "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.array(cut, np.int32)), pa.array(part.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = shards.repartition(max(1, manifest.count()))  # one shard a task
    return spread.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0, width: int = 2, path: str | None = None) -> DataFrame:
    """Write documents as token files below path (the shared folder by default) and read them back."""
    path = path or new_path(spark, "token-files")
    manifest = Scratch(spark).save_bounded(write_token_files(docs, lambda: library_encoder(vocabulary), path, end_id, width), "token-manifest", 2000)
    return read_token_files(manifest, width)
