"""Spans of every shape to runs and cases; annotation exports."""

import json

import pytest
from pyspark.sql import functions as F

from gavelframe.operators import controls, labels, traces
from gavelframe.sources import annotations, spans

MESSAGES = [
    {"role": "user", "parts": [{"type": "text", "content": "old"}]},
    {"role": "assistant", "parts": [{"type": "text", "content": "older answer"}]},
    {"role": "user", "parts": [{"type": "text", "content": "What is"}, {"type": "text", "content": "2+2?"}]},
    {"role": "assistant", "parts": [{"type": "tool_call", "id": "c1", "name": "add", "arguments": {"a": 2}}, {"type": "tool_call", "id": "c2", "name": "log", "arguments": "{}"}]},
    {"role": "user", "parts": [{"type": "tool_call_response", "id": "c1", "name": "add", "result": 4}]},
    {"role": "assistant", "parts": [{"type": "text", "content": "4"}]},
]
ATTRIBUTES = {"gen_ai.operation.name": "invoke_agent", "gen_ai.agent.name": "calc", "x.all_messages": json.dumps(MESSAGES), "x.new_message_index": 2, "final_result": "4"}


def otlp(value):
    kind = {str: "stringValue", bool: "boolValue", int: "intValue"}.get(type(value))
    if kind:
        return {kind: str(value) if kind == "intValue" else value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [otlp(v) for v in value]}}
    return {"kvlistValue": {"values": [{"key": k, "value": otlp(v)} for k, v in value.items()]}}


def pairs(attributes):
    return [{"key": k, "value": otlp(v)} for k, v in attributes.items()]


TOOL = {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.call.id": "c2"}
SHAPES = {
    "query": [
        {"span_name": "invoke_agent calc", "trace_id": "0xABC", "span_id": "1", "parent_span_id": None, "start_timestamp": "2024-01-01T00:00:00Z", "attributes": ATTRIBUTES},
        {"span_name": "execute_tool log", "trace_id": "abc", "span_id": "2", "parent_span_id": "1", "start_timestamp": "2024-01-01T00:00:01Z", "attributes": json.dumps(TOOL), "is_exception": True, "exception_type": "E", "exception_message": "bad"},
    ],
    "otlp": [{"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "ABC", "spanId": "1", "name": "invoke_agent calc", "startTimeUnixNano": "1704067200000000000", "attributes": pairs(ATTRIBUTES) + pairs({"final_result": "4"})}]}]}, {"instrumentationLibrarySpans": [{"spans": [{"traceId": "abc", "spanId": "2", "parentSpanId": "1", "name": "execute_tool log", "attributes": pairs(TOOL), "events": [{"name": "exception", "attributes": pairs({"exception.type": "E", "exception.message": "bad"})}], "status": {"code": 2}}]}]}]}],
    "exported": [
        {"name": "invoke_agent calc", "context": {"trace_id": 0xABC, "span_id": 1}, "parent": None, "attributes": ATTRIBUTES, "start_time": 1704067200000000000},
        {"name": "execute_tool log", "context": {"trace_id": "0xabc", "span_id": "0x2"}, "parent": {"span_id": "0x1"}, "attributes": TOOL, "events": [{"name": "exception", "attributes": {"exception.type": "E", "exception.message": "bad"}}], "start_time": "2024-01-01T00:00:01+00:00"},
    ],
}


def test_all_shapes_give_the_same_run(spark):
    for shape, rows in SHAPES.items():
        noise = [{"unlike": "a span"}, {"name": "pending", "context": {"trace_id": "9", "span_id": "9"}, "attributes": {"x.span_type": "pending_span"}}]
        [run] = traces.agent_runs(spark, spans.from_rows(spark, rows + rows + noise)).collect()
        assert (run.trace_id, run.span_id, run.name) == ("abc".zfill(32), "1".zfill(16), "calc-00000000-00000000"), shape
        assert run.prompt == "What is\n2+2?" and [m.role for m in run.history] == ["user", "assistant"]
        assert [(c.id, c.name, c.result, c.error) for c in run.tool_calls] == [("c1", "add", "4", None), ("c2", "log", None, "E: bad")]
        assert run.output == "4" and run.output_is_text and not run.nested and run.version == 3 and run.problems == []
        assert run.start.year in (2023, 2024)


def test_nested_values_and_repeated_keys(spark):
    value = {"a": [1, "x\"y", True], "b": 2}
    span = {"traceId": "1", "spanId": "1", "name": "n", "attributes": pairs({"v": value}) + pairs({"k": "first"}) + pairs({"k": "last"})}
    row = spans.from_rows(spark, [span]).first()
    assert json.loads(row.attributes["v"]) == value and row.attributes["k"] == "last"


def test_files_of_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(SHAPES["otlp"], indent=1))
    assert spans.read_spans(spark, str(tmp_path / "d.json"), whole_files=True).count() == 2
    (tmp_path / "l.jsonl").write_text("﻿" + "\n\n".join(json.dumps(s) for s in SHAPES["query"]))
    assert spans.read_spans(spark, str(tmp_path / "l.jsonl")).count() == 2


def run_span(span_id, parent=None, prompt="p", start=0, trace="1", **more):
    messages = [{"role": "user", "parts": [{"type": "text", "content": prompt}]}] if prompt else []
    return {"span_name": "agent run", "trace_id": trace, "span_id": span_id * 16, "parent_span_id": parent and parent * 16, "start_timestamp": f"2024-01-01T00:00:{start:02d}Z", "attributes": {"agent_name": "a", "x.all_messages": json.dumps(messages), "final_result": "r"}, **more}


def test_nested_runs_filters_and_duplicates(spark):
    middle = {"span_name": "step", "trace_id": "1", "span_id": "b" * 16, "parent_span_id": "a" * 16, "start_timestamp": "2024-01-01T00:00:00Z", "attributes": {}}
    rows = [run_span("a", "c", start=5), middle, run_span("c", "a", "inner", trace="2"), run_span("d", "b", "inner"), run_span("e", None, "p", 9, "3"), run_span("f", None, "p", 1, "4", is_exception=True, exception_type="E"), run_span("9", None, None, trace="5")]
    runs = traces.agent_runs(spark, spans.from_rows(spark, rows)).cache()
    assert {r.span_id[-1]: r.nested for r in runs.collect()} == {"a": False, "c": False, "d": True, "e": False, "f": False, "9": False}
    pick = lambda **k: [(r.span_id[-1], [x[-1] for x in r.later]) for r in traces.select_runs(runs, **k).collect()]
    assert pick() == [("c", []), ("f", ["a", "e"])]
    assert pick(errors="exclude") == [("c", []), ("a", ["e"])] and pick(errors="only") == [("f", [])]
    assert pick(nested=True, where=F.col("prompt") == "inner") == [("c", ["d"])]
    assert len(pick(deduplicate=False)) == 4 and len(pick(deduplicate=False, sample=2)) == 2
    cases = {r.case_id[-1]: r for r in traces.cases_of(traces.select_runs(runs, deduplicate=False), F.col("trace_id").endswith("3"), True).collect()}
    assert cases["e"].output == cases["e"].expected_output == "r" and cases["a"].output is None and cases["a"].metadata["recorded_output"] == "r"


def test_older_event_lists(spark):
    events = [{"role": "user", "content": "first"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "t", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "id": "t", "content": "ok"}]
    rows = [{"span_name": "agent run", "trace_id": "1", "span_id": "1", "attributes": {"agent_name": "a", "all_messages_events": json.dumps(events)}}]
    run = traces.agent_runs(spark, spans.from_rows(spark, rows)).first()
    assert run.prompt == "hi" and run.version == 1 and [(c.name, c.result) for c in run.tool_calls] == [("f", "ok")] and run.problems == ["no final result recorded"]


def test_the_last_call_of_an_id_owns_the_response(spark):
    rows = spark.createDataFrame([("r", 1, "tool_call", "x"), ("r", 2, "tool_call", "x"), ("r", 3, "tool_call_response", "x"), ("r", 4, "tool_call_response", "x"), ("r", 0, "tool_call_response", "x")], "run_id string, no int, kind string, call_id string")
    assert {(r.call_no, r.response_no) for r in traces.pair_tools(rows).collect()} == {(1, None), (2, 4)}


EXPORT = [
    {"traceId": "t1", "spanId": "s1", "verdict": "pass", "reviewerEmail": "a@x", "updatedAt": "2024-01-02T00:00:00Z", "tags": ["x", "y"], "category": "ok"},
    {"traceId": "t1", "spanId": "s1", "verdict": "Fail ", "reviewerEmail": "a@x", "updatedAt": "2024-01-01T00:00:00Z", "tags": '["z"]'},
    {"traceId": "t2", "spanId": "s2", "verdict": "pass", "reviewer": "a"},
    {"traceId": "t2", "spanId": "s2", "verdict": "fail", "reviewer": "b"},
    {"traceId": "t2", "spanId": "s2", "verdict": "fail", "tags": "p, q"},
    {"traceId": "t2", "spanId": "s2", "verdict": "fail"},
    {"traceId": "t3", "spanId": "s3", "verdict": "neutral", "email": "c"},
    {"traceId": "t4", "verdict": "pass"},
]


@pytest.mark.parametrize("kind", ["rows", "jsonl", "json", "csv"])
def test_exports_are_accounted_for(spark, tmp_path, kind):
    source = EXPORT
    if kind != "rows":
        source = str(tmp_path / f"export.{kind}")
        names = list(dict.fromkeys(k for r in EXPORT for k in r))
        cell = lambda v: "" if v is None else '"' + (v if isinstance(v, str) else json.dumps(v)).replace('"', '""') + '"'
        text = "\n".join([",".join(names), *(",".join(cell(r.get(n)) for n in names) for r in EXPORT)]) if kind == "csv" else "﻿" + "\n\n".join(map(json.dumps, EXPORT))
        (tmp_path / f"export.{kind}").write_text(text)
    rows = annotations.read_annotations(spark, source).cache()
    assert [(r.row_no, r.run_id, r.verdict) for r in rows.orderBy("row_no").collect()][:2] == [(1, "s1", "pass"), (2, "s1", "fail")]
    got = labels.read_summary(rows).first().asDict()
    assert got == {"rows": 8, "missing_id": 1, "runs": 3, "labelled": 1, "pass": 1, "fail": 0, "neutral_annotations": 1, "neutral_runs": 1, "conflicts": 1, "superseded": 1}
    assert labels.read_summary(rows, "majority").first().fail == 1
    runs = spark.createDataFrame([("s1", "case 1", "out")], "run_id string, case_id string, output string")
    [label] = labels.human_labels(rows, runs).collect()
    assert (label.case_id, label.label, label.category, label.tags) == ("case 1", 1, "ok", ["x", "y"])
    with pytest.raises(KeyError):
        labels.human_labels(rows, runs, "majority")


def test_exports_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(Exception, match="unknown verdict: true in row 1"):
        annotations.read_annotations(spark, [{"span_id": "a", "verdict": "true"}]).collect()
    assert annotations.read_annotations(spark, [{"span_id": "a", "verdict": "true"}], verdicts={"true": "pass"}).first().verdict == "pass"
    with pytest.raises(ValueError, match="unknown annotation format"):
        annotations.read_annotations(spark, "x.xlsx")
    assert annotations.read_annotations(spark, []).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"verdict": "pass"}\n[1]\n')
    with pytest.raises(Exception, match="not an object"):
        annotations.read_annotations(spark, str(tmp_path / "bad.jsonl")).collect()


def test_timelines_conversations_and_calls(spark):
    df = spark.sql("""SELECT array(named_struct('time', '2024-01-01T10:00', 'content', 'a'), named_struct('time', '2024-01-01T12:00', 'content', 'b')) AS events, '2024-01-01T11:00' AS at,
        array('t1', 't2', 'last') AS talk, array('new') AS turns,
        array(named_struct('tool', 'look', 'span_id', 's0', 'arguments', 'x', 'result', 'r'), named_struct('tool', 'pay', 'span_id', 's1', 'arguments', 'x', 'result', 'done')) AS calls""")
    fact = F.struct(F.lit("").alias("time"), F.lit("new").alias("content"))
    got = df.select(
        controls.add_event(F.col("events"), fact, F.col("at"), 2880).alias("later"), controls.add_event(F.col("events"), fact, F.col("at"), -1).alias("before"),
        controls.insert_turns(F.col("talk"), F.col("turns")).alias("talk"), controls.insert_turns(F.col("talk"), F.array().cast("array<string>")).alias("same"),
        controls.insert_call(F.col("calls"), ["pay"], lambda c: F.lit("again"), True, "d").alias("twice"), controls.insert_call(F.col("calls"), ["pay"], lambda c: F.lit("timeout"), False, "r").alias("retry"),
        controls.insert_call(F.col("calls"), ["none"], lambda c: F.lit("x"), True, "d").alias("none"), controls.retry_changed(F.col("calls"), ["pay"], F.lit("failed"), lambda c: c.withField("arguments", F.lit("y"))).alias("changed"),
        controls.retry_changed(F.col("calls"), ["pay"], F.lit("failed"), lambda c: c).alias("unchanged"),
    ).first()
    assert [(e.time, e.content) for e in got.later] == [("2024-01-01T10:00", "a"), ("2024-01-01T12:00", "b"), ("2024-01-03T11:00", "new")]
    assert [e.content for e in got.before] == ["a", "new", "b"] and got.before[1].time == "2024-01-01T10:59"
    assert got.talk == ["t1", "t2", "new", "last"] and got.same is None and got.none is None and got.unchanged is None
    assert [c.result for c in got.twice] == ["r", "done", "again"] and got.twice[2].span_id != "s1" and [c.result for c in got.retry] == ["r", "timeout", "done"]
    assert [(c.arguments, c.result) for c in got.changed] == [("x", "r"), ("x", "failed"), ("y", "done")]
