"""Certificates on disk: checks and verdicts as Parquet, one folder a judge, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.operators.certify import verdicts

VERSION = 1


def certificates(checks: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """One row a judge: verdict, counts, and its checks as an array; identity adds a config column by judge_id."""
    listed = checks.groupBy("judge_id").agg(F.sort_array(F.collect_list(F.struct("name", "status", "successes", "trials", "errors", "low", "high", "threshold"))).alias("checks"))
    out = verdicts(checks).join(listed, "judge_id").withColumn("version", F.lit(VERSION))
    return out if identity is None else out.join(identity, "judge_id", "left")


def fingerprint(config: str) -> F.Column:
    """16 hex digits of a judge's configuration (a map column), in the order of its keys."""
    entries = F.array_sort(F.map_entries(config))
    return F.substring(F.sha2(F.to_json(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))), 256), 1, 16)


def save(rows: DataFrame, path: str) -> None:
    """Write beside path, then swap by two renames: readers see the old folder, the new one or, between the renames, none, and never a part of one."""
    spark = rows.sparkSession
    staged, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.partitionBy("judge_id").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(staged), hadoop(path))
    fs.delete(hadoop(old), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Saved certificates of the current version only; others count as missing."""
    return spark.read.parquet(path).where(F.col("version") == VERSION)


def as_json(rows: DataFrame) -> DataFrame:
    """(judge_id, json) of certificates."""
    return rows.select("judge_id", F.to_json(F.struct(*rows.columns)).alias("json"))
