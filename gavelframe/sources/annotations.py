"""Annotation exports: JSON lines, CSV or rows, with candidate names for every field."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names under which exports carry each field, and the verdicts they use.
FIELDS = {
    "trace_id": ("trace_id", "traceId"),
    "span_id": ("span_id", "spanId"),
    "verdict": ("verdict",),
    "category": ("category",),
    "expected_output": ("expected_output", "expectedOutput"),
    "comment": ("comment",),
    "tags": ("tags",),
    "reviewer": ("reviewer_email", "reviewerEmail", "reviewer", "email"),
    "agent": ("agent_name", "agentName", "agent"),
    "updated_at": ("updated_at", "updatedAt", "created_at", "createdAt"),
}
VERDICTS = {"pass": "pass", "neutral": "neutral", "fail": "fail"}


def read_export(spark: SparkSession, source: str | Sequence[dict], kind: str | None = None) -> DataFrame:
    """All columns as texts, and row_no from 1: JSON lines or CSV by the suffix (or kind: jsonl, csv), or rows.

    Exports are what people wrote by hand, so one ordered pass numbers their rows.
    """
    if not isinstance(source, str):
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        names = list(dict.fromkeys(k for row in source for k in row))
        schema = ", ".join(["row_no long", *(f"`{n}` string" for n in names)])
        return spark.createDataFrame([(i, *(text(row.get(n)) for n in names)) for i, row in enumerate(source, 1)], schema)
    suffix = kind or {"jsonl": "jsonl", "ndjson": "jsonl", "json": "jsonl", "csv": "csv"}.get(source.rsplit(".", 1)[-1].lower())
    if suffix == "jsonl":
        lines = spark.read.text(source).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
        lines = lines.withColumn("row_no", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))
        read = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
        checked = F.when(F.startswith(F.trim("value"), F.lit("{")), read).otherwise(F.raise_error(F.concat(F.lit("not an object: row "), F.col("row_no").cast("string"))).cast("map<string,string>"))
        rows = lines.select("row_no", checked.alias("m"))
        names = [r[0] for r in rows.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").collect()]  # field names
        return rows.select("row_no", *(F.element_at("m", F.lit(n)).alias(n) for n in names))
    if suffix == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(source)
        return rows.withColumn("row_no", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))
    raise ValueError(f"unknown annotation format: {source}; pass kind='jsonl' or 'csv'")


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first column of names that exists and is neither null nor empty."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalise_tags(tags: Column) -> Column:
    """An array from a JSON list or comma-separated text."""
    listed = F.when(F.startswith(F.trim(tags), F.lit("[")), F.coalesce(F.from_json(tags, "array<string>"), F.split(tags, ","))).otherwise(F.split(tags, ","))
    return F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != "")


def read_annotations(spark: SparkSession, source: str | Sequence[dict], fields: dict[str, Sequence[str]] | None = None, kind: str | None = None, verdicts: dict[str, str] | None = None, run_id: str | Column = "span") -> DataFrame:
    """Typed annotations, one a row of the export; a missing verdict, or one outside the known words, raises.

    run_id says what names a run: span, trace, or a Column of the export.  Rows without one stay,
    with a null run_id, so that they can be counted.
    """
    raw = read_export(spark, source, kind)
    columns = {f: first_of(raw, n) for f, n in (FIELDS | (fields or {})).items()}
    word = F.lower(F.trim(columns["verdict"]))
    known = F.create_map(*(F.lit(x) for pair in (verdicts or VERDICTS).items() for x in pair))
    wrong = F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce(word, F.lit("none")), F.lit(" in row "), F.col("row_no").cast("string"))).cast("string")
    verdict = F.coalesce(F.element_at(known, word), wrong)
    run = {"span": columns["span_id"], "trace": columns["trace_id"]}[run_id] if isinstance(run_id, str) else run_id.cast("string")
    zoned = columns["updated_at"].rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$")  # times with and without a zone do not compare
    when = F.when(zoned, F.try_to_timestamp(columns["updated_at"]))
    plain = [columns[c].alias(c) for c in ("trace_id", "span_id", "reviewer", "agent", "category", "expected_output", "comment")]
    return raw.select("row_no", run.alias("run_id"), verdict.alias("verdict"), *plain, normalise_tags(columns["tags"]).alias("tags"), when.alias("updated_at"))
