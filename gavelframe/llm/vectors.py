"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: str) -> F.Column:
    """Whether a vector is not null, has only finite components, and is not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def sample_vectors(rows: DataFrame, key: str, vector: str, count: int) -> np.ndarray:
    """At most count different unit vectors, of the dimension of the first, among the 4 * count rows with the smallest hashes of their keys."""
    taken = rows.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h", "v").limit(4 * count).collect()
    if not taken:
        return np.zeros((0, 0))
    dim = len(taken[0]["v"])
    unique = list(dict.fromkeys(tuple(r["v"]) for r in taken if len(r["v"]) == dim))[:count]
    return unit(np.array(unique, float))


def sample_by_length(rows: DataFrame, key: str, vector: str, count: int, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each of the lengths, at most count different unit vectors among the 4 * count rows of that length with the smallest hashes of their keys."""
    if not lengths:
        return {}
    good = rows.where(usable(vector)).select(F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).where(F.col("dim").isin(lengths))
    first = good.withColumn("rn", F.row_number().over(Window.partitionBy("dim").orderBy("h", "v"))).where(F.col("rn") <= 4 * count)
    found: dict[int, dict] = {}
    for r in first.orderBy("dim", "rn").select("dim", "v").collect():
        found.setdefault(r["dim"], {})[tuple(r["v"])] = None
    return {dim: unit(np.array(list(x)[:count], float)) for dim, x in found.items()}


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list or binary column whose rows all have dim components, as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
