"""Span documents in four shapes to one span table.

Shapes: OTLP/JSON documents (resourceSpans, with scopeSpans or the older instrumentationLibrarySpans),
OTLP spans on their own (traceId), rows of a span query (span_name), and exported spans (context).
They may be mixed, one JSON value a line or a file, or lists of them.  Spans that fit no shape are
left out.

The span table: seq, trace_id, span_id, parent_id, name, attributes (map of texts, other values as
JSON), error (null: none), start, pending.  Of a key given twice the last value counts.  OTLP lists and
key-value lists become JSON to a depth of two; what lies deeper keeps OTLP's own form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPANS = "array<struct<spans:array<string>>>"
DOCUMENT = f"resourceSpans array<struct<scopeSpans:{_SPANS},instrumentationLibrarySpans:{_SPANS}>>"
RECORD = (
    "span_name string, trace_id string, span_id string, parent_span_id string, start_timestamp string, otel_status_code string, otel_status_message string, is_exception boolean, exception_type string, exception_message string, "
    "traceId string, spanId string, parentSpanId string, startTimeUnixNano string, name string, attributes string, events string, status string, context struct<trace_id:string,span_id:string>, parent string, parent_id string, start_time string"
)
COLUMNS = ("seq", "trace_id", "span_id", "parent_id", "name", "attributes", "error", "start", "pending")
#: Severity numbers from which a record is an error.
ERROR_LEVEL = 17


def span_time(value: Column) -> Column:
    """A timestamp from ISO text (naive is UTC) or nanoseconds since the epoch."""
    digits = value.rlike("^[0-9]+$")
    return F.when(digits, F.timestamp_micros(F.floor(F.when(digits, value).cast("decimal(38,0)") / 1000).cast("long"))).otherwise(F.try_to_timestamp(value))


def hex_id(value: Column, width: int) -> Column:
    """Lower-case hex of a fixed width from hex text with or without 0x; null for none."""
    text = F.regexp_replace(F.lower(value), "^0x", "")
    return F.when(text != "", F.lpad(text, width, "0"))


@F.udf(StringType())
def _hex_of_integer(value):
    return format(int(value), "x") if value and value.isdigit() else None


def last_of_each(entries: Column) -> Column:
    """A map from array<struct<key, value>> in which of equal keys the last counts."""
    later = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.filter(later, lambda e: e["key"].isNotNull()))


def otlp_value(value: Column, depth: int = 2) -> Column:
    """The text of an OTLP value given as JSON; lists and key-value lists as JSON, to a depth beyond which they stay as they are."""
    v = F.from_json(value, "stringValue string, boolValue string, doubleValue string, intValue string, arrayValue struct<values:array<string>>, kvlistValue struct<values:array<struct<key:string,value:string>>>")
    plain = F.coalesce(v["stringValue"], v["boolValue"], v["doubleValue"], v["intValue"])
    if depth == 0:
        return F.coalesce(plain, value)

    def inner(x: Column) -> Column:
        """As JSON inside another value: texts are quoted, numbers, booleans, lists and maps are not."""
        return F.when(F.get_json_object(x, "$.stringValue").isNotNull(), F.regexp_replace(F.to_json(F.array(otlp_value(x, 0))), r"^\[|\]$", "")).otherwise(otlp_value(x, depth - 1))

    items = F.concat(F.lit("["), F.array_join(F.transform(v["arrayValue"]["values"], inner), ","), F.lit("]"))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    pairs = F.concat(F.lit("{"), F.array_join(F.transform(v["kvlistValue"]["values"], lambda e: F.concat(quoted(e["key"]), F.lit(":"), inner(e["value"]))), ","), F.lit("}"))
    return F.coalesce(plain, items, pairs)


def otlp_attributes(attributes: Column) -> Column:
    """A map from OTLP's list of keys and values, as JSON."""
    entries = F.from_json(attributes, "array<struct<key:string,value:string>>")
    return last_of_each(F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("key"), otlp_value(e["value"]).alias("value"))))


def json_attributes(attributes: Column) -> Column:
    """A map from an object, or from a text that holds one, as JSON."""
    text = F.when(F.startswith(F.trim(attributes), F.lit('"')), F.get_json_object(F.concat(F.lit('{"t":'), attributes, F.lit("}")), "$.t")).otherwise(attributes)
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _exception(events: Column, otlp: bool) -> Column:
    """kind: message of the first exception event; null without one."""
    rows = F.filter(F.from_json(events, "array<struct<name:string,attributes:string>>"), lambda e: e["name"] == "exception")
    first = F.get(rows, F.lit(0))
    attributes = otlp_attributes(first["attributes"]) if otlp else json_attributes(first["attributes"])
    kind, message = F.coalesce(F.element_at(attributes, F.lit("exception.type")), F.lit("exception")), F.element_at(attributes, F.lit("exception.message"))
    return F.when(first.isNotNull(), F.when(F.coalesce(message, F.lit("")) != "", F.concat(kind, F.lit(": "), message)).otherwise(kind))


def _ending(attributes: Column, name: str) -> Column:
    """The value of the attribute whose name ends so, whatever stands before the dot."""
    return F.get(F.map_values(F.map_filter(attributes, lambda k, _: k.endswith(name))), F.lit(0))


def flatten(documents: DataFrame, column: str = "value") -> DataFrame:
    """(seq, span): the JSON of every span in JSON texts of any shape, in their order."""
    text = F.trim(F.regexp_replace(F.col(column), "^﻿", ""))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    items = documents.where(F.col(column).isNotNull() & (F.trim(column) != "")).select(F.monotonically_increasing_id().alias("doc"), F.posexplode(listed).alias("i", "item"))
    parsed = F.from_json("item", DOCUMENT)["resourceSpans"]
    inside = F.flatten(F.flatten(F.transform(parsed, lambda r: F.transform(F.coalesce(r["scopeSpans"], r["instrumentationLibrarySpans"], F.array().cast(_SPANS)), lambda s: F.coalesce(s["spans"], F.array().cast("array<string>"))))))
    rows = items.select("doc", "i", F.posexplode(F.when(parsed.isNotNull(), inside).otherwise(F.array("item"))).alias("j", "span"))
    return rows.select(F.struct("doc", "i", "j").alias("seq"), "span")


def normalise(rows: DataFrame) -> DataFrame:
    """The span table of flatten() rows."""
    read = rows.select("seq", "span", F.from_json("span", RECORD).alias("r")).select("seq", "span", "r.*")
    status = F.from_json("status", "code string, message string, status_code string, description string")
    nothing = F.lit(None).cast("string")

    query = read.where("span_name is not null")
    failed = (F.col("otel_status_code") == "ERROR") | F.coalesce(F.col("is_exception"), F.lit(False))
    message = F.coalesce("exception_message", "otel_status_message")
    told = F.when(F.col("exception_type").isNotNull() & message.isNotNull(), F.concat("exception_type", F.lit(": "), message)).otherwise(F.coalesce("exception_type", message, F.lit("ERROR")))
    a = query.select("seq", hex_id(F.col("trace_id"), 32).alias("trace_id"), hex_id(F.col("span_id"), 16).alias("span_id"), hex_id(F.col("parent_span_id"), 16).alias("parent_id"), F.col("span_name").alias("name"), json_attributes(F.col("attributes")).alias("attributes"), F.when(failed, told).alias("error"), span_time(F.col("start_timestamp")).alias("start"))

    otlp = read.where("span_name is null and traceId is not null")
    wrong = F.coalesce(status["code"].isin("2", "STATUS_CODE_ERROR"), F.lit(False))
    error = F.coalesce(_exception(F.col("events"), True), F.when(wrong, F.coalesce(status["message"], F.lit("ERROR"))))
    b = otlp.select("seq", hex_id(F.col("traceId"), 32).alias("trace_id"), hex_id(F.col("spanId"), 16).alias("span_id"), hex_id(F.col("parentSpanId"), 16).alias("parent_id"), F.coalesce("name", F.lit("")).alias("name"), otlp_attributes(F.col("attributes")).alias("attributes"), error.alias("error"), span_time(F.col("startTimeUnixNano")).alias("start"))

    exported = read.where("span_name is null and traceId is null and context is not null")
    parent = F.coalesce(F.get_json_object("parent", "$.span_id"), F.col("parent_id"))
    is_number = lambda field: F.col("span").rlike(rf'"{field}"\s*:\s*[0-9]')
    known = lambda value, field, width: hex_id(F.when(is_number(field) & ~value.startswith("0x"), _hex_of_integer(value)).otherwise(value), width)
    attributes = json_attributes(F.col("attributes"))
    level = _ending(attributes, ".level_num").try_cast("int")
    error = F.coalesce(_exception(F.col("events"), False), F.when(status["status_code"] == "ERROR", F.coalesce(status["description"], F.lit("ERROR"))), F.when(level >= ERROR_LEVEL, "ERROR"))
    c = exported.select("seq", known(F.col("context.trace_id"), "trace_id", 32).alias("trace_id"), known(F.col("context.span_id"), "span_id", 16).alias("span_id"), hex_id(F.when(is_number("parent_id"), _hex_of_integer(parent)).otherwise(parent), 16).alias("parent_id"), F.coalesce("name", F.lit("")).alias("name"), attributes.alias("attributes"), error.alias("error"), span_time(F.col("start_time")).alias("start"))

    every = a.unionByName(b).unionByName(c)
    pending = F.coalesce(_ending(F.col("attributes"), ".span_type") == "pending_span", F.lit(False))
    return every.select(*(F.coalesce(x, F.lit("")).alias(x) if x in ("trace_id", "span_id") else F.coalesce("error", nothing).alias("error") if x == "error" else F.col(x) for x in COLUMNS[:-1]), pending.alias("pending"))


def read_spans(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """The span table of JSON lines (or of files that hold one JSON value each)."""
    return normalise(flatten(spark.read.text(path, wholetext=whole_files)))


def from_rows(spark: SparkSession, spans: list[dict]) -> DataFrame:
    """The span table of Python dictionaries of any shape."""
    import json

    return normalise(flatten(spark.createDataFrame([(json.dumps(s),) for s in spans], "value string")))


def tree(checks: DataFrame, judgments: DataFrame, max_examples: int = 5) -> DataFrame:
    """Certificates as spans: one row a judge, check and failing example, with parent ids, attributes and the number left out.

    checks: certify.checks(); judgments: with kind, family and passed.
    """
    from pyspark.sql import Window

    from gavelframe.operators.certify import truth_of, verdicts

    name = lambda *parts: F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    text = lambda **columns: F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))))
    root = verdicts(checks).select("judge_id", name("judge_id").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("certificate").alias("name"), text(verdict=F.col("verdict"), failed=F.col("failed"), open=F.col("open")).alias("attributes"))
    each = checks.select("judge_id", name("judge_id", "name").alias("span_id"), name("judge_id").alias("parent_id"), F.concat(F.lit("check "), "name").alias("name"), text(status=F.col("status"), successes=F.col("successes"), trials=F.col("trials"), low=F.col("low"), high=F.col("high")).alias("attributes"))
    wrong = judgments.withColumn("truth", truth_of(F.col("kind"), F.col("family"), F.col("repeat"))).where("passed <> truth")
    check = F.when(F.col("kind") == "reference", "acceptance").when(F.col("kind") == "must_fail", "rejection").when(F.col("kind") == "must_hold", "invariance").otherwise("human_agreement")
    rows = wrong.withColumn("check", check)
    # counted apart, so that a task keeps its first rows only and no window holds all of a check
    first = F.row_number().over(Window.partitionBy("judge_id", "check").orderBy("family", "case_id", "repeat"))
    shown = rows.withColumn("_rn", first).where(F.col("_rn") <= max_examples).join(rows.groupBy("judge_id", "check").agg(F.count("*").alias("_n")), ["judge_id", "check"])
    example = shown.select("judge_id", name("judge_id", "check", F.col("_rn").cast("string")).alias("span_id"), name("judge_id", "check").alias("parent_id"), F.lit("example").alias("name"), text(case=F.col("case_id"), family=F.col("family"), passed=F.col("passed"), omitted=F.greatest(F.lit(0), F.col("_n") - max_examples)).alias("attributes"))
    return root.unionByName(each).unionByName(example)


