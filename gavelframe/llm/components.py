"""Connected components of an edge table, labelled with the smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch

#: Edges that one task may hold; above it the distributed algorithm runs.
ONE_TASK_EDGES = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a[i], b[i]) and the smallest node each can reach."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges with the components of the edges seen; a part is contracted whenever it grows."""
    a, b, bound = np.empty(0, np.int64), np.empty(0, np.int64), 1_000_000
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > bound:
            a, b = roots(a, b)
            a, b = a[a != b], b[a != b]
            bound = max(bound, 2 * len(a))
    if len(a):
        a, b = roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["u", "v"])


def components(scratch: Scratch, edges: DataFrame, name: str, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(u, v) for every node u that reaches a smaller node; v is the smallest.

    edges: two long columns, in either direction; nulls and loops are ignored.  Every partition
    first contracts its own edges to a spanning forest.  If what is left is at most one_task
    edges, one task finishes; beyond that, large-star and small-star rounds run until nothing changes.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = scratch.save(clean.mapInArrow(_forest, "u long, v long"), f"{name}-0", compact=True)
    if e.count() <= one_task:
        out = scratch.save(e.coalesce(1).mapInArrow(_forest, "u long, v long"), f"{name}-components")
        scratch.drop(f"{name}-0")
        return out
    seen, step = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        step += 1
        e = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e
        seen = now
