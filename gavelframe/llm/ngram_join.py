"""Jaccard self-join of documents on word n-grams: prefix filtering, rarest n-grams first.

A document's set is its distinct n-grams of lower-cased words (64-bit hashes); documents with
equal sets form one class and act as one record.  With t the similarity, a record with m
n-grams can only reach t with a record that shares one of its first m - ceil(t*m) + 1 n-grams,
in any fixed order of all n-grams.  The order used is rare first:

1. every n-gram of every document is counted (counts of fingerprints, packed by hash range, are
   shuffled; nothing is sampled); the most frequent, at most TABLE of them, form a broadcast
   table of fixed size.  N-grams outside it come first, by hash, then those in it, rarest first;
2. the prefix of every record is posted by hash range, and lists of one record are dropped; the
   sets of the records left are written once, each with the number of its n-grams in RANGES hash
   ranges;
3. in rounds, every posting list proposes its members to one leader of the list (another leader
   each round); proposals pass the length and the positional filter, are made distinct, pass the
   suffix filter (the two records' counts by hash range bound what they can share) and are
   verified once on the whole sets.  Records that are connected already are not proposed again,
   nor pairs that were rejected, and lists whose members are all connected go;
4. once a round of leaders connects little, a last round proposes all remaining pairs of a list
   that are in different components, so no link between different components is missed.

Classes are told apart by one 64-bit hash and checked by a second: if two different sets ever
shared the first, the whole join starts again with other hashes.

Defined results: null and empty texts, and texts of white space only, have an empty set and
link with nothing (their component is their own id).  Repeated rows are each returned.  Rows
with a null key are returned and take part, but a component is named after its smallest
non-null key.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.components import components
from gavelframe.llm.storage import Scratch, bounded_batches, fresh, trim_memory

TABLE = 1 << 20  # most frequent n-grams that are broadcast (12 bytes each)
MIN_COUNT = 8  # rarer n-grams never enter the table
ROUNDS = 5  # leader rounds before the exhaustive one, at most
YIELD = 0.005  # links a proposal of a leader round that make another one worth while
BROADCAST_ROWS = 1_000_000  # rows of one or two 64-bit numbers
RANGES = 256
BATCH_ROWS = 64  # a pair of long texts carries two sets of several hundred KB
FLUSH = 400_000
CHUNK_BYTES = 200_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on wrapping unsigned integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(size, _BASE, _U), np.full(size, inverse, _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the number of words of each text.

    data: UTF-8 bytes of all texts; offsets: where each begins, and the end.
    """
    n_texts = len(offsets) - 1
    if len(data) == 0:
        return np.empty(0, _U), np.zeros(n_texts, np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE_VALUES[data] * up[: len(data)])])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, one after another, and the size of each set."""
    words, counts = word_hashes(data, offsets)
    first = np.cumsum(counts) - counts
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    width = np.repeat(np.minimum(counts, n), per)
    out = width.astype(_U) * _U(0xA0761D6478BD642F)
    padded = np.concatenate([words, np.zeros(n, _U)])
    for j in range(n):
        factor = mix(np.array([j + 101], _U))[0] | _U(1)
        out = out + np.where(width > j, padded[at + j] * factor, _U(0))
    out = mix(out)
    bounds = np.concatenate([[0], np.cumsum(per)]).tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[np.array(bounds[:-1], np.int64)[per > 0]] = True
    sizes = np.add.reduceat(keep, np.array(bounds[:-1], np.int64)[per > 0]) if len(out) else np.empty(0, np.int64)
    full = np.zeros(len(per), np.int64)
    full[per > 0] = sizes
    return out[keep], full


def class_keys(sets: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each set, from a sum over its members; sets must not be empty."""
    starts = np.cumsum(sizes) - sizes
    salt = mix(np.array([seed], _U))[0] ^ _U(0x5851F42D4C957F2D)
    return mix(np.add.reduceat(mix(sets ^ salt), starts) + sizes.astype(_U)).view(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a string column of about CHUNK_BYTES."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that small values leave runs of zeros."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(data: memoryview, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).reshape(-1).view(dtype)


def _delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _buckets(spark: SparkSession) -> int:
    """Log2 of the number of hash ranges: they follow the session's number of shuffle partitions."""
    return int(8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()


BLOBS = "bucket int, blob binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _blob_batches(buckets: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(buckets), 2_000):
        yield pa.RecordBatch.from_arrays([pa.array(buckets[i : i + 2_000], pa.int32()), pa.array(blobs[i : i + 2_000], pa.binary())], schema=_BLOB_SCHEMA)


def _count_pass(n: int, bits: int, seed: int):
    """Packed counts of fingerprints by hash range, and packed (key, known, size, class, check) of documents."""

    def flush(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        fingerprints, counts = np.unique(np.concatenate(sets) >> _U(32 - bits), return_counts=True)
        low = (fingerprints & _U(0xFFFFFFFF)).astype(np.uint32)
        cut = np.searchsorted(fingerprints >> _U(32), np.arange((1 << bits) + 1, dtype=_U)).tolist()
        buckets, blobs = [], []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a < b:
                more = np.flatnonzero(counts[a:b] > 1)
                blobs.append(np.array([b - a, len(more)], np.uint32).tobytes() + _planes(_delta(low[a:b])) + _planes(_delta(more.astype(np.uint32))) + _planes(counts[a:b][more].astype(np.uint32)))
                buckets.append(k)
        yield from _blob_batches(buckets, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, members, turn = [], 0, [], None
        for batch in batches:
            ids = batch.column(0)
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in _texts(batch.column(1)):
                found, sizes = shingle_sets(data, offsets, n)
                classes, checks = np.zeros((2, len(sizes)), np.int64)
                if len(found):
                    classes[sizes > 0] = class_keys(found, sizes[sizes > 0], seed)
                    checks[sizes > 0] = class_keys(found, sizes[sizes > 0], seed + 1)
                members.append(np.stack([ids[a:b], known[a:b].astype(np.int64), sizes, classes, checks]).T)
                sets.append(found)
                held += len(found)
                if held > FLUSH:
                    yield from flush(sets)
                    sets, held = [], 0
                if sum(map(len, members)) > 4_000:
                    block = np.concatenate(members)
                    turn = (int(block[0, 3]) if turn is None else turn + 1) % (1 << bits)
                    yield from _blob_batches([(1 << bits) + turn], [block.tobytes()])
                    members = []
        yield from flush(sets)
        if members:
            block = np.concatenate(members)
            yield from _blob_batches([(1 << bits) + (int(block[0, 3]) if turn is None else turn + 1) % (1 << bits)], [block.tobytes()])
        trim_memory()

    return run


FACTS = "kind int, a long, b long, c long, d long"


def _merge_counts(bits: int):
    """Facts of one hash range: kind 0 (fingerprint, count) of the frequent, kind 1 (key, size, class, check)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blobs = [memoryview(b.as_buffer()) for chunk in table.column("blob").chunks for b in chunk]
        if bucket >= 1 << bits:
            rows = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 5) for b in blobs])
            empty = rows[:, 2] == 0
            return pa.table({"kind": np.ones(len(rows), np.int32), "a": pa.array(rows[:, 0], mask=rows[:, 1] == 0), "b": rows[:, 2], "c": pa.array(rows[:, 3], mask=empty), "d": pa.array(rows[:, 4], mask=empty)})
        low, counts = [], []
        for blob in blobs:
            size, more = np.frombuffer(blob, np.uint32, 2).tolist()
            low.append(np.cumsum(_unplanes(blob[8:], size, np.uint32), dtype=np.uint32))
            count = np.ones(size, np.int64)
            at = np.cumsum(_unplanes(blob[8 + 4 * size :], more, np.uint32), dtype=np.uint32)
            count[at] = _unplanes(blob[8 + 4 * size + 4 * more :], more, np.uint32)
            counts.append(count)
        low, counts = np.concatenate(low), np.concatenate(counts)
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        total, low = np.add.reduceat(counts, starts), low[starts]
        keep = total >= MIN_COUNT
        fingerprints = low[keep].astype(np.int64) + (bucket << 32)
        return pa.table({"kind": np.zeros(len(fingerprints), np.int32), "a": fingerprints, "b": total[keep], "c": pa.nulls(len(fingerprints), pa.int64()), "d": pa.nulls(len(fingerprints), pa.int64())})

    return run


def prefix_length(size: int | np.ndarray, percent: int):
    """m - ceil(percent * m / 100) + 1"""
    return size - (percent * size + 99) // 100 + 1


def _posting_pass(n: int, bits: int, percent: int, seed: int, frequent):
    """Packed postings (n-gram, class, size, position) of every record's prefix, by hash range."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        hashes, classes, sizes, places = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(hashes, kind="stable")
        hashes, classes, sizes, places = hashes[order], classes[order], sizes[order], places[order]
        cut = np.searchsorted(hashes >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U)).tolist()
        buckets, blobs = [], []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a < b:
                blobs.append(np.array([b - a], np.int64).tobytes() + _planes(_delta(hashes[a:b])) + _planes(classes[a:b]) + _planes(sizes[a:b]) + _planes(places[a:b]))
                buckets.append(k)
        yield from _blob_batches(buckets, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprints, counts = frequent.value
        seen: set[int] = set()  # classes of this partition
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                found, sizes = shingle_sets(data, offsets, n)
                if not len(found):
                    continue
                sizes = sizes[sizes > 0]
                classes = class_keys(found, sizes, seed)
                key = (found >> _U(32 - bits)).astype(np.int64)
                at = np.searchsorted(fingerprints, key)
                at[at == len(fingerprints)] = 0
                count = np.where(fingerprints[at] == key, counts[at], 0) if len(fingerprints) else np.zeros(len(key), np.int64)
                ends = np.cumsum(sizes).tolist()
                for a, b, c in zip([0, *ends[:-1]], ends, classes.tolist()):
                    if c in seen:
                        continue
                    seen.add(c)
                    m = b - a
                    p = prefix_length(m, percent)
                    x, weight = found[a:b], count[a:b]
                    rare = x[weight == 0]
                    if len(rare) < p:
                        common = np.flatnonzero(weight)
                        rare = np.concatenate([rare, x[common[np.lexsort((x[common], weight[common]))]]])
                    parts.append((rare[:p], np.full(p, c), np.full(p, m, np.uint32), np.arange(p, dtype=np.uint32)))
                    held += p
                if held > FLUSH // 2:
                    yield from flush(parts)
                    parts, held = [], 0
        yield from flush(parts)
        trim_memory()

    return run


POSTINGS = "h long, c long, m int, p int"


def _merge_postings(table: pa.Table) -> pa.Table:
    """Postings of one hash range whose list has two classes at least; a class is listed once."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for chunk in table.column("blob").chunks:
        for value in chunk:
            blob = memoryview(value.as_buffer())
            size = int(np.frombuffer(blob, np.int64, 1)[0])
            at = 8
            for i, kind in enumerate((_U, np.int64, np.uint32, np.uint32)):
                part = _unplanes(blob[at:], size, kind)
                columns[i].append(np.cumsum(part, dtype=_U) if i == 0 else part)
                at += size * np.dtype(kind).itemsize
    h, c, m, p = (np.concatenate(x) for x in columns)
    order = np.lexsort((c, h))
    h, c, m, p = h[order], c[order], m[order], p[order]
    same = h[1:] == h[:-1]
    keep = np.concatenate([[True], ~(same & (c[1:] == c[:-1]))])
    h, c, m, p = h[keep], c[keep], m[keep], p[keep]
    same = h[1:] == h[:-1]
    listed = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.table({"h": h[listed].view(np.int64), "c": c[listed], "m": m[listed].astype(np.int32), "p": p[listed].astype(np.int32)})


def _set_pass(n: int, seed: int):
    """(class, sketch, set): sets are sorted little-endian 64-bit hashes, sketches their 16-bit counts by hash range; a class once a partition."""
    bounds = (np.arange(1, RANGES, dtype=_U) << _U(64 - RANGES.bit_length() + 1)).astype(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                found, sizes = shingle_sets(data, offsets, n)
                sizes = sizes[sizes > 0]
                if not len(sizes):
                    continue
                ends = np.cumsum(sizes).tolist()
                rows = [(c, found[a:b]) for c, a, b in zip(class_keys(found, sizes, seed).tolist(), [0, *ends[:-1]], ends) if not (c in seen or seen.add(c))]
                sketches = [np.minimum(np.diff(np.searchsorted(x, bounds), prepend=0, append=len(x)), 65535).astype("<u2").tobytes() for _, x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array(sketches, pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["c", "k", "s"])
        trim_memory()

    return run


def needed(x: int | np.ndarray, y: int | np.ndarray, percent: int):
    """The least intersection of sets of x and y elements with 100 * intersection >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def may_reach(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter on rows of sketches: what two sets share is at most the sum of the smaller counts. Counts at their limit bound nothing."""
    full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
    return full | (np.minimum(x, y).sum(axis=1) >= needed(x.sum(axis=1), y.sum(axis=1), percent))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    need = needed(len(x), len(y), percent)
    if min(len(x), len(y)) < need:
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def _kept(batch: pa.RecordBatch, ok: np.ndarray) -> pa.RecordBatch:
    mask = pa.array(ok, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _suffix_pass(percent: int):
    """(a, b) of the pairs (a, b, sketch of a, sketch of b) that the suffix filter leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, RANGES).astype(np.int64) for i in (2, 3))
            yield _kept(batch, may_reach(x, y, percent))

    return run


def _verify_pass(percent: int):
    """(a, b) of the pairs (a, b, set of a, set of b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept(batch, np.array([similar(np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U), percent) for a, b in zip(batch.column(2), batch.column(3))], bool))
        trim_memory()

    return run


def _frequent(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most TABLE of the most frequent fingerprints, sorted, with their counts.

    Counts are binned by sixteenths of a power of two; of the first bin that does not fit whole, a
    share by hash enters, so the table is never empty for being too full.
    """
    level = F.floor(16 * F.log2(F.col("b").cast("double")))
    counted = facts.where("kind = 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows
    total, whole, split, share = 0, [], -1, 0
    for row in counted:
        if total + row["count"] > TABLE:
            split, share = row["level"], int((TABLE - total) / row["count"] * 0.95 * (1 << 20))
            break
        total += row["count"]
        whole.append(row["level"])
    if not counted:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    part = (level == split) & (F.pmod(F.xxhash64("a"), F.lit(1 << 20)) < share)
    rows = facts.where((F.col("kind") == 0) & (part if not whole else (level >= min(whole)) | part)).select("a", "b").toArrow()
    a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
    order = np.argsort(a)
    return a[order], np.minimum(b[order], np.iinfo(np.int32).max).astype(np.int32)


def _small(rows: DataFrame) -> DataFrame:
    """A saved table of one or two numbers a row, marked for broadcast up to BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, class_id, component_id) of every row; percent is 100 times the similarity."""
    with bounded_batches(docs.sparkSession, BATCH_ROWS):  # all work in Python is done inside
        for seed in range(0, 8, 2):
            out = _joined(docs, key, text, n, percent, seed)
            if out is not None:
                return out
    raise RuntimeError("different sets had equal hashes four times over")


def _joined(docs: DataFrame, key: str, text: str, n: int, percent: int, seed: int) -> DataFrame | None:
    """The join; None if two different sets share a class."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bits = _buckets(spark)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    counted = texts.mapInArrow(_count_pass(n, bits, seed), BLOBS).groupBy("bucket").applyInArrow(_merge_counts(bits), FACTS)
    facts = scratch.save(counted, "ngram-facts", compact=True)
    members = facts.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("m"), "c", "d")
    owners = scratch.save(members.where("c is not null").groupBy("c").agg(F.min("k").alias("k"), F.min("d").alias("d"), F.max("d").alias("e")), "ngram-owners", compact=True)
    if not owners.where("d <> e").isEmpty():
        scratch.drop(*list(scratch.paths))
        return None
    frequent = spark.sparkContext.broadcast(_frequent(facts))

    packed = texts.select("t").mapInArrow(_posting_pass(n, bits, percent, seed, frequent), BLOBS)
    postings = scratch.save(packed.groupBy("bucket").applyInArrow(_merge_postings, POSTINGS), "ngram-postings", compact=True)
    frequent.destroy()

    listed = scratch.save(postings.select("c").distinct(), "ngram-listed", compact=True)
    chosen = scratch.save(owners.join(listed, "c", "left_semi").select("k").distinct(), "ngram-chosen", compact=True)
    wanted = texts.join(_small(chosen.where("k is not null")), "k", "left_semi").select("t")
    if not chosen.where("k is null").isEmpty():
        wanted = wanted.unionByName(texts.where("k is null").select("t"))
    made = wanted.mapInArrow(_set_pass(n, seed), "c long, k binary, s binary").join(_small(listed), "c", "left_semi")
    sets = scratch.save(made, "ngram-sets")
    if sets.count() != listed.count():  # rows that share a key, in several partitions
        sets = scratch.save(sets.dropDuplicates(["c"]), "ngram-sets-once")
        scratch.drop("ngram-sets")

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        """pairs (a, b) with a column of sets for a and for b, of which only the rows in pairs are moved."""
        ends = [pairs.select(F.col(e).alias("c")).distinct() for e in "ab"]
        left, right = (sets.select("c", column).join(_small(e), "c", "left_semi").select(F.col("c").alias(name), F.col(column).alias(value)) for e, name, value in zip(ends, "ab", "xy"))
        return _small(pairs).join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def verified(pairs: DataFrame, step: int) -> DataFrame:
        hopeful = scratch.save(beside(pairs, "k").mapInArrow(_suffix_pass(percent), "a long, b long"), f"ngram-hopeful-{step}", compact=True)
        return scratch.save(beside(hopeful, "s").mapInArrow(_verify_pass(percent), "a long, b long"), f"ngram-links-{step}", compact=True)

    def passing(a: str, b: str) -> F.Column:
        """Length and positional filter of the postings a and b of one list."""
        need = F.ceil(F.expr(f"{percent} * ({a}.m + {b}.m) / {100 + percent}D"))
        rest = F.least(F.expr(f"{a}.m - {a}.p"), F.expr(f"{b}.m - {b}.p"))
        return (F.least(f"{a}.m", f"{b}.m") >= need) & (rest >= need) & (F.col(f"{a}.g") != F.col(f"{b}.g"))

    now, links, tried, step, last = postings.withColumn("g", F.col("c")), None, None, 0, False
    while True:
        record = F.struct("c", "m", "p", "g")
        if last:  # a list's members outside its largest component against all
            sizes = now.groupBy("h", "g").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("g", F.struct("n", "g")).alias("most"))
            other = now.join(sizes, "h").where("g <> most").select("h", record.alias("y"))
        else:  # a list's members against one leader
            other = now.groupBy("h").agg(F.min_by(record, F.xxhash64("c", F.lit(step)) if step == 0 else F.xxhash64("c", "h", F.lit(step))).alias("y"))
        proposed = now.select("h", record.alias("x")).join(other, "h").where(passing("x", "y"))
        pairs = proposed.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"ngram-pairs-{step}", compact=True)
        found = verified(pairs, step)
        links = found if links is None else links.unionByName(found)
        graph = components(scratch, links, f"ngram-graph-{step}")
        if last:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        last = step + 1 >= ROUNDS or found.count() < YIELD * pairs.count()
        # lists whose members are still apart
        labelled = now.drop("g").join(graph, F.col("c") == F.col("u"), "left").select("h", "c", "m", "p", F.coalesce("v", "c").alias("g"))
        labelled = scratch.save(labelled, f"ngram-labelled-{step}")
        apart = labelled.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("h")
        now = scratch.save(labelled.join(apart, "h", "left_semi"), f"ngram-now-{step}")
        scratch.drop("ngram-postings", f"ngram-labelled-{step}", f"ngram-graph-{step}-components", f"ngram-now-{step - 1}")
        step += 1

    # decided by class, so that what is joined to the rows is one line a class
    classes = owners.join(graph, F.col("c") == F.col("u"), "left").select("c", F.col("k").alias("class_id"), F.coalesce("v", "c").alias("g"))
    names = scratch.save(classes.groupBy("g").agg(F.min("class_id").alias("component_id")), "ngram-names")
    classes = scratch.save(classes.join(names, "g").select("c", "class_id", "component_id"), "ngram-classes")
    placed = members.join(classes, "c", "left").select(F.col("k").alias(key), F.col("m").alias("n_shingles"), F.coalesce("class_id", "k").alias("class_id"), F.coalesce("component_id", "k").alias("component_id"))
    return scratch.result(placed, "ngram-joined")


def row_hash(docs: DataFrame) -> F.Column:
    """A 64-bit hash of a whole row, nulls apart from values; maps are hashed as their sorted entries."""
    value = lambda f: F.to_json(F.struct(F.array_sort(F.map_entries(f"`{f.name}`")))) if "map<" in f.dataType.simpleString() and f.dataType.typeName() == "map" else F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*(value(f) for f in docs.schema.fields), *(F.col(f"`{f.name}`").isNull() for f in docs.schema.fields))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component: the one with the smallest key, then text hash; of rows repeated as a whole one stays.

    Decided by row, so rows that share a key but no words do not touch each other.  Rows with a null
    key are compared with each other only: one of each component stays beside the row with a key.
    Texts without n-grams all stay.
    """
    row = fresh(docs.columns, "_row")
    rows = docs.withColumn(row, row_hash(docs))
    scratch = Scratch(docs.sparkSession)
    joined = ngram_join(rows.select(row, text), row, text, n, percent).where("n_shingles > 0").select(F.col(row).alias("r"), F.col("component_id").alias("component")).distinct()
    order = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(row).alias("row"))
    ordered = rows.select(F.col(row).alias("r"), F.col(key).isNull().alias("unknown"), order.alias("order")).distinct()
    placed = scratch.save(joined.join(ordered, "r"), "ngram-rows")
    first = placed.groupBy("component", "unknown").agg(F.min("order").alias("first")).select(F.col("first.row").alias("r"))
    gone = scratch.save(placed.select(F.col("r").alias(row)).join(first.withColumnRenamed("r", row), row, "left_anti"), "ngram-gone", compact=True)
    scratch.drop("ngram-rows")
    return rows.join(_small(gone), row, "left_anti").dropDuplicates([row]).drop(row)
