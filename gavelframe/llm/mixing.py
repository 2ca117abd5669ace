"""Mixing sources to target weights with a low-discrepancy schedule.

Sources get weights in the order of their names, and targets that share the words of the whole
corpus by weight, capped at a multiple of what the source holds (the excess goes to the others
by weight).  The mix is a sequence of slots of BLOCK words.  Slot i belongs to the source in
whose stretch of the cumulative targets the golden-ratio point frac(i * phi) falls, so every
stretch of the mix is close to the targets.  The slots of a source are ranked; its documents,
shuffled by a hash of their keys, are cut into blocks of BLOCK words; rank r takes block r modulo
the number of blocks.  A document's share is the sum over its blocks of the words it has there,
times how often the block is taken; no block is taken more than the cap.

Prefix sums over a source go through hash buckets and rank prefix sums through slot ranges, so
no source, however large, is ordered in one task.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a
source of its own, last in the order; repeated rows are each kept; with no words at all every
target is 0.  The same rows give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch

BLOCK = 64
WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 1024  # at least; more where a bucket of all rows would hold over BUCKET_ROWS
BUCKET_ROWS = 100_000
RANGE = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
#: floor(2^32 / golden ratio), odd: i * PHI mod 2^32 are the golden-ratio points in 32-bit fixed point.
PHI = 2654435769


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source, so the windows are small."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(cap * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levelled = weighed.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the first source whose cap the common level does not reach fixes the level of it and all after it
    open_level = F.min(F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.struct(cap * F.col("source_size") / F.col("w"), "level"))).over(everything).getField("level")
    return levelled.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.coalesce(open_level, F.lit(0.0)) * F.col("w")).alias("target"))


def stretches(targets: DataFrame) -> DataFrame:
    """targets with lo and hi, the source's stretch of [0, 2^32)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    upper = F.floor(F.least(F.sum("target").over(by_name) / F.greatest(total, F.lit(1e-300)), F.lit(1.0)) * float(1 << 32))
    cut = targets.withColumn("hi", upper)
    return cut.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))


def schedule(targets: DataFrame, total: int, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """(slot, source, rank, block, epoch) of the whole mix, in any order."""
    spark = targets.sparkSession
    cut = stretches(targets).withColumn("blocks", F.ceil(F.col("source_size") / block))
    slots = spark.range(total // block).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 32)) * PHI % (1 << 32)).alias("point"))
    owners = cut.where("hi > lo").select("lo", "hi", "source", "blocks")
    # sources cut [0, 2^32) into cells of 2^20: an equi-join on the cell, then the bounds
    cells = owners.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 20), F.shiftright(F.col("hi") - 1, 20))))
    placed = slots.withColumn("cell", F.shiftright("point", 20)).join(cells, "cell").where("point >= lo and point < hi")
    placed = placed.select("slot", "source", "blocks", F.floor(F.col("slot") / RANGE).alias("part"))
    counts = placed.groupBy("source", "part").count()
    bases = counts.select("source", "part", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = placed.withColumn("rn", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1)
    ranked = local.alias("l").join(bases.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.part") == F.col("b.part"))).select("slot", "l.source", "blocks", (F.col("base") + F.col("rn")).alias("rank"))
    return ranked.where(F.col("rank") < cap * F.col("blocks")).select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def shuffled(sized: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """sized with start: words of the source before the document, in the order of the hashes of keys."""
    hashed = sized.withColumn("h", F.md5(F.concat_ws("|", F.coalesce(F.col("source"), F.lit("")), F.col(key).cast("string"))))
    # a bucket is a range of hashes, so that the order does not depend on their number
    hashed = hashed.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    bases = sums.select("source", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumn("upto", F.sum("size").over(inside))
    return local.alias("l").join(bases.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.bucket") == F.col("b.bucket"))).select(f"l.{key}", "l.source", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row."""
    scratch = Scratch(docs.sparkSession)
    counted = docs.select(F.col(key), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    sized = scratch.save(counted, "mix-sizes")
    targets = scratch.save(source_targets(sized, weights, cap), "mix-targets")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    takes = schedule(targets, total, block, cap).groupBy("source", "block").agg(F.count("*").alias("times"))
    placed = scratch.save(shuffled(sized, key, max(BUCKETS, -(-rows // BUCKET_ROWS))), "mix-placed")
    # a document with words starts where no other one does: (source, start) tells it
    parts = placed.where("size > 0").select("source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("p.block") + 1) * block) - F.greatest(F.col("start"), F.col("p.block") * block)
    taken = parts.alias("p").join(takes.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))).select("p.source", "start", (words * F.col("times")).alias("n")).groupBy("source", "start").agg(F.sum("n").alias("taken"))
    joined = placed.alias("d").join(taken.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.start") == F.col("k.start")) & (F.col("size") > 0), "left")
    joined = joined.select(f"d.{key}", F.col("d.source").alias("source"), "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    out = joined.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(key, "d.source", "size", "source_size", "target", "taken")
    return scratch.result(out, "mix-taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM s1 WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT coalesce((SELECT level FROM s2 WHERE level * w <= 3 * source_size ORDER BY 3 * source_size / w::DOUBLE, level LIMIT 1), 0) AS open_level
), tg AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, open_level * w) AS target FROM s2, lv
), st AS (
  SELECT *, floor(least(sum(target) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(sum(target) OVER (), 1e-300), 1.0) * 4294967296.0)::BIGINT AS hi,
    ceil(source_size / 64.0)::BIGINT AS blocks FROM tg
), cut AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY encode(source) NULLS LAST), 0) AS lo FROM st
), slots AS (
  SELECT i AS slot, (i % 4294967296) * 2654435769 % 4294967296 AS point FROM range((SELECT (sum(size) // 64)::BIGINT FROM sized)) r(i)
), ranked AS (
  SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN cut ON point >= lo AND point < hi
), takes AS (
  SELECT source, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 3 * blocks GROUP BY ALL
), hashed AS (
  SELECT *, md5(concat_ws('|', coalesce(source, ''), doc_id::VARCHAR)) AS h FROM sized
), placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM hashed
), parts AS (
  SELECT doc_id, source, start, size, unnest(range((start // 64)::BIGINT, ((start + size - 1) // 64 + 1)::BIGINT)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT doc_id, p.source, sum((least(start + size, (p.block + 1) * 64) - greatest(start, p.block * 64)) * times)::BIGINT AS taken
  FROM parts p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block GROUP BY ALL
)
SELECT d.doc_id, d.source, d.size, g.source_size, g.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized d JOIN tg g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN taken k ON k.doc_id = d.doc_id AND k.source IS NOT DISTINCT FROM d.source
"""
