"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated by a random orthogonal matrix and coded by the signs, one bit a
component; beside the code stands its correction factor, the inner product of the vector with its
own code.  For another vector y, (code . rotated y) / factor is an unbiased estimate of the
cosine, in single precision, and the factor gives a confidence bound on its error.  Pairs whose
upper bound is below the threshold are settled; all others are computed exactly, in double
precision.

The bound is ``confidence`` standard errors.  At the usual 4.5 a pair that links is lost with a
chance of at most 3.4 in a million, and only if its cosine is hardly above the threshold; with
``confidence=math.inf`` every pair is computed exactly and none can be lost.

Only vectors of one label (and one length) are compared.  Equal vectors are first made one
record with a multiplicity.  Records are dealt to cells by their nearest pivot, and cells to
blocks of bounded size; a label has one cell for every BLOCK_ROWS rows, up to CELLS.  A pair of
cells whose pivots are too far apart for any link, by the triangle inequality on angles, is
skipped.  Clustered vectors therefore cost little more than their own blocks, but vectors spread
evenly over a space of many dimensions cost the square of their label, as nothing can be skipped.
A pair of blocks returns one number of links a record and a spanning forest of its links, so
nothing that is moved grows with the square of a group.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows with
a null label and rows with a null key link with nothing; repeated rows link with each other;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.components import components, roots
from gavelframe.llm.storage import Scratch
from gavelframe.llm.vectors import matrix, sample_vectors, unit, usable

#: Standard errors of the estimate within which a pair is recomputed.
CONFIDENCE = 4.5
CELLS = 1024
BLOCK_ROWS = 2048
SEED = 20240521


def rotation(dim: int) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of dim columns, rounded up to whole bytes."""
    width = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors."""
    y = x @ turn
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded rows (first axis) with rotated rows, and the standard error of each coded row."""
    width = turned.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(width))
    return (signs @ turned.T.astype(np.float32)) / factors[:, None], np.sqrt((1 - np.minimum(factors, 1) ** 2) / (factors**2 * max(1, width - 1)))


def linked_exactly(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors with a cosine of at least threshold, all of them computed."""
    step = max(1, (1 << 22) // max(1, y.size))
    parts = [np.nonzero((x[i : i + step, None, :] * y[None, :, :]).sum(axis=2) >= threshold) for i in range(0, len(x), step)]
    return np.concatenate([a + i * step for i, (a, _) in enumerate(parts)]), np.concatenate([b for _, b in parts])


def linked(x: np.ndarray, y: np.ndarray, codes: np.ndarray, factors: np.ndarray, turn: np.ndarray, threshold: float, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) of unit vectors with a cosine of at least threshold; codes and factors are x's."""
    if np.isinf(confidence):
        return linked_exactly(x, y, threshold)
    guess, error = estimate(codes, factors, y @ turn)
    a, b = np.nonzero(guess + confidence * error[:, None] >= threshold)
    keep = np.concatenate([(x[a[i : i + 100_000]] * y[b[i : i + 100_000]]).sum(axis=1) >= threshold for i in range(0, len(a), 100_000)] or [np.empty(0, bool)])
    return a[keep], b[keep]


def _code_pass(pivots: np.ndarray):
    """(id, label, dim, digest, v, code, factor, cell) of usable rows; v is the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cells").to_numpy()
            for dim in np.unique(dims).tolist():
                turn = turns.setdefault(dim, rotation(dim))
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                raw = matrix(rows.column("v"), dim) + 0.0  # -0.0 is 0.0
                x = unit(raw)
                codes, factors = encode(x, turn)
                cell = np.zeros(len(x), np.int32)
                if dim == pivots.shape[1] and len(pivots):
                    near = x @ pivots.T
                    near[np.arange(len(pivots))[None, :] >= cells[dims == dim][:, None]] = -2
                    cell = near.argmax(axis=1).astype(np.int32)
                digests = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), rows.column("dim"), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors), pa.array(cell)], names=["id", "label", "dim", "digest", "v", "code", "factor", "cell"])

    return run


def _compare(threshold: float, confidence: float):
    """Link counts (a, null, n) and forest edges (a, b, null) of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        first, second = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        turn = rotation(dim)
        block = table.column("block").to_numpy()
        ids, weight = table.column("c").to_numpy(), table.column("n").to_numpy()
        x = matrix(table.column("v"), dim)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        factors = table.column("factor").to_numpy()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        count = np.zeros(len(ids), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(left), 512):
            at = left[i : i + 512]
            a, b = linked(x[at], x[right], codes[at], factors[at], turn, threshold, confidence)
            a, b = at[a], right[b]
            if first == second:
                a, b = a[a < b], b[a < b]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            edges.append((ids[a], ids[b]))
            if sum(len(e[0]) for e in edges) > 200_000:
                edges = [roots(*(np.concatenate(e) for e in zip(*edges)))]
        u, v = roots(*(np.concatenate(e) for e in zip(*edges))) if edges else (np.empty(0, np.int64),) * 2
        u, v = u[u != v], v[u != v]
        some = np.flatnonzero(count)
        return pa.table({"a": np.concatenate([ids[some], u]).astype(np.int64), "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), v]), mask=np.arange(len(some) + len(u)) < len(some)), "n": np.concatenate([count[some], np.zeros(len(u), np.int64)])})

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    good = rows.where(usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull())
    source = good.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v"))
    sizes = scratch.save(source.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("wanted")), "code-sizes", compact=True)
    most = min(CELLS, sizes.agg(F.max("wanted")).first()[0] or 1)
    pivots = sample_vectors(rows.where(F.col(key).isNotNull()), key, vector, most)
    sizes = sizes.select("label", "dim", F.least(F.lit(max(1, len(pivots))), F.col("wanted")).alias("cells"))
    coded = scratch.save(source.join(sizes, ["label", "dim"]).mapInArrow(_code_pass(pivots), "id long, label string, dim int, digest binary, v binary, code binary, factor double, cell int"), "codes")

    group = ["label", "dim"]
    classes = coded.groupBy(*group, "digest").agg(F.min("id").alias("c"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("code").alias("code"), F.first("factor").alias("factor"), F.first("cell").alias("cell"))
    classes = scratch.save(classes, "code-classes")
    # the angle of a cell: the farthest of its records from its pivot
    if len(pivots):

        def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, dims = batch.column(2).to_numpy(), batch.column(1).to_numpy()
                angle = np.full(len(cell), np.pi)
                same = np.flatnonzero(dims == pivots.shape[1])
                if len(same):
                    angle[same] = np.arccos(np.clip((matrix(batch.column(3).take(pa.array(same)), pivots.shape[1]) * pivots[cell[same]]).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(angle)], names=["label", "dim", "cell", "angle"])

        radii = classes.select(*group, "cell", "v").mapInArrow(angles, "label string, dim int, cell int, angle double")
    else:
        radii = classes.select(*group, "cell", F.lit(float(np.pi)).alias("angle"))
    cells = radii.groupBy(*group, "cell").agg(F.max("angle").alias("angle"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    cells = scratch.save(cells, "code-cells")  # at most CELLS rows a label and length

    reach = float(np.arccos(threshold)) + 1e-9
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((1, 1))
    i, j = np.triu_indices(len(apart))
    between = spark.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "far": apart[i, j]}))  # at most CELLS * (CELLS + 1) / 2 rows
    pairs = cells.alias("x").join(cells.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.cell") <= F.col("y.cell")))
    pairs = pairs.join(between, (F.col("x.cell") == F.col("i")) & (F.col("y.cell") == F.col("j"))).where(F.col("x.angle") + F.col("y.angle") + reach >= F.col("far"))
    both = pairs.select("x.label", "x.dim", F.explode(F.array(F.struct(F.col("x.cell").alias("cell"), F.col("y.cell").alias("other"), F.col("y.parts").alias("other_parts")), F.struct(F.col("y.cell").alias("cell"), F.col("x.cell").alias("other"), F.col("x.parts").alias("other_parts")))).alias("p")).select("label", "dim", "p.*").distinct()
    placed = classes.join(cells.select(*group, "cell", "parts"), [*group, "cell"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    name = lambda cell, part: F.col(cell).cast("long") * (1 << 32) + F.col(part)
    dealt = placed.join(both, [*group, "cell"]).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    dealt = dealt.select(*group, "c", "n", "v", "code", "factor", name("cell", "part").alias("block"), F.least(name("cell", "part"), name("other", "other_part")).alias("one"), F.greatest(name("cell", "part"), name("other", "other_part")).alias("two"))
    found = scratch.save(dealt.groupBy(*group, "one", "two").applyInArrow(_compare(threshold, confidence), "a long, b long, n long"), "code-links")

    graph = components(scratch, found.where("b is not null").select("a", "b"), "code-graph")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    done = classes.select(*group, "digest", "c", "n").join(counts, F.col("c") == F.col("a"), "left").join(graph, F.col("c") == F.col("u"), "left").select(*group, "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("v", "c").alias("component_id"))
    linked_rows = coded.select("id", *group, "digest").join(done, [*group, "digest"]).select(F.col("id").alias(key), "n_links", "component_id")
    alone = rows.where(~usable(vector) | F.col(label).isNull() | F.col(key).isNull()).select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    return scratch.result(linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))), "code-rows")
