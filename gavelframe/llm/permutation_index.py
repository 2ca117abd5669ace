"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots of its own length: the
``posted`` nearest pivots, nearest first.  Rows are dealt into shards of bounded size; a shard
posts its vectors, with the pivot's rank, to one inverted file a pivot.  A query reads the files
of its own nearest pivots and accumulates the footrule distance between the two orders (a pivot
missing from an order has rank ``posted``).  The ``examined`` share of a shard
(``LEAST_EXAMINED`` rows at least) with the smallest distance is compared by exact cosine, in
double precision, and the best of all shards are the answer.

Every row with a usable vector is indexed; the pivots are a sample of at most ``pivots`` rows of
each length, for the ``LENGTHS`` most frequent lengths with over LEAST_EXAMINED rows; rows of any
other length have no order and are compared whole.  Every row is moved once, to its shard; the
queries are written once and streamed past every shard in blocks, so neither side is ever held
whole in one task and neither is copied for the other.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows with a null key; vectors are only compared with others of equal length; ties
in the score go to the smaller key; repeated rows are neighbours of each other unless they have
the same key.  An empty table has no answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch, file_system
from gavelframe.llm.vectors import matrix, sample_by_length, unit, usable

PIVOTS = 256
POSTED = 64
EXAMINED = 0.12
LEAST_EXAMINED = 256
LENGTHS = 16
SHARD_BYTES = 4 << 20  # of vectors: 8,192 rows of 64 components
QUERY_ROWS = 1024


def index(rows: DataFrame, key: str, vector: str, pivots: dict[int, np.ndarray], posted: int = POSTED) -> DataFrame:
    """(id, dim, v, perm): perm holds the numbers of the nearest pivots, 2 bytes each; empty for lengths without pivots."""
    good = rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            perms: list[bytes] = [b""] * batch.num_rows
            dims = batch.column(1).to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(pivots):
                same = np.flatnonzero(dims == dim)
                seen = unit(matrix(batch.column(2).take(pa.array(same)), dim)) @ pivots[dim].T
                order = np.argsort(-seen, axis=1, kind="stable")[:, :posted].astype("<u2")
                for i, p in zip(same.tolist(), order):
                    perms[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(perms, pa.binary())], names=["id", "dim", "v", "perm"])

    return good.mapInArrow(run, "id long, dim int, v array<double>, perm binary")


def closeness(query: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, posted: int) -> np.ndarray:
    """sum over shared pivots of posted - max(rank, rank'): the footrule distance is posted * (posted + 1) - 2 * closeness."""
    starts, members, ranks = files
    spans = [slice(starts[p], starts[p + 1]) for p in query]
    who = np.concatenate([members[s] for s in spans])
    own = np.repeat(np.arange(len(query)), [s.stop - s.start for s in spans])
    gain = posted - np.maximum(own, np.concatenate([ranks[s] for s in spans]))
    return np.bincount(who, gain, minlength=rows)


class Shard:
    """The rows of one shard with their inverted files."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, perms: np.ndarray, pivots: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.units, perms = ids[order], unit(vectors[order]), perms[order]
        self.posted = perms.shape[1]
        flat = perms.reshape(-1).astype(np.int64)
        by_pivot = np.argsort(flat, kind="stable")
        self.files = np.searchsorted(flat[by_pivot], np.arange(pivots + 1)).tolist(), by_pivot // max(1, self.posted), by_pivot % max(1, self.posted)

    def search(self, query_ids: np.ndarray, query_vectors: np.ndarray, query_perms: np.ndarray, k: int, examined: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the best k of the shard for every query."""
        n = len(self.ids)
        quota = min(n, max(4 * k, LEAST_EXAMINED, int(np.ceil(examined * n)))) if self.posted else n
        for q, v, p in zip(query_ids.tolist(), unit(query_vectors), query_perms.astype(np.int64).tolist()):
            score = closeness(p, self.files, n, self.posted) if self.posted else np.zeros(n)
            least = np.partition(score, n - quota)[n - quota]
            above = np.flatnonzero(score > least)
            chosen = np.concatenate([above, np.flatnonzero(score == least)[: quota - len(above)]])  # ids ascend: ties go to the smaller
            chosen = chosen[self.ids[chosen] != q]
            cosine = (self.units[chosen] * v).sum(axis=1)
            best = np.lexsort((self.ids[chosen], -cosine))[:k]
            yield q, self.ids[chosen][best], cosine[best]


def _perms(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1) if rows and rows[0] else np.empty((len(rows), 0), "<u2")


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query=None, k: int = 5, pivots: int = PIVOTS, posted: int = POSTED, examined: float = EXAMINED) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest rows found for every row that is_query (a condition on the key) takes."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    keyed = rows.where(F.col(key).isNotNull())
    lengths = scratch.save(keyed.where(usable(vector)).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")), "permutation-lengths", compact=True)
    usual = [r["dim"] for r in lengths.where(F.col("n") > LEAST_EXAMINED).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()]
    chosen = sample_by_length(keyed, key, vector, pivots, usual)
    indexed = scratch.save(index(rows, key, vector, chosen, posted), "permutation-index")
    asked = scratch.save(indexed.where(is_query(F.col("id"))) if is_query is not None else indexed, "permutation-queries", compact=True)
    files = sorted(asked.inputFiles())

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        shard = Shard(table.column("id").to_numpy(), matrix(table.column("v"), dim), _perms(table.column("perm")), len(chosen.get(dim, ())))
        out: list = []
        for file in files:
            fs, at = file_system(file)
            with fs.open_input_file(at) as source:
                for block in pq.ParquetFile(source).iter_batches(QUERY_ROWS, columns=["id", "dim", "v", "perm"]):
                    block = block.filter(pa.array(block.column("dim").to_numpy() == dim))
                    if block.num_rows:
                        out += shard.search(block.column("id").to_numpy(), matrix(block.column("v"), dim), _perms(block.column("perm")), k, examined)
        sizes = [len(i) for _, i, _ in out]
        empty = np.empty(0, np.int64)
        return pa.table({"query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), sizes), "id": np.concatenate([i for _, i, _ in out]) if out else empty, "score": np.concatenate([s for _, _, s in out]) if out else empty.astype(float)})

    shards = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES))
    dealt = indexed.join(F.broadcast(lengths), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), shards))  # one row a length
    found = dealt.select("dim", "shard", "id", "v", "perm").groupBy("dim", "shard").applyInArrow(run, "query_id long, id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
    return scratch.result(best, "permutation-found")
