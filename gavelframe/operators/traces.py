"""Spans to runs to cases, retried calls, and content-addressed reuse of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalise_spans(spans: DataFrame) -> DataFrame:
    """Fixed-width lower-case ids, pending spans dropped, the first of repeated (trace, span) pairs kept; spans without an id are all kept.

    spans: seq, trace_id, span_id, parent_id, name, pending, start.
    """
    hexed = lambda c, n: F.lpad(F.lower(F.regexp_replace(c, "^0x", "")), n, "0")
    rows = spans.where(~F.coalesce("pending", F.lit(False))).withColumns({"trace_id": hexed(F.col("trace_id"), 32), "span_id": F.when(F.col("span_id") != "", hexed(F.col("span_id"), 16)).otherwise("")})
    first = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy("seq"))
    return rows.withColumn("_rn", first).where("_rn = 1 or span_id = ''").drop("_rn")


# Names of run and tool spans, and of the attributes that carry an operation.
RUN_NAMES, TOOL_NAMES = ("agent run", "invoke_agent"), ("running tool", "execute_tool")
OPERATION, CALL_ID = "gen_ai.operation.name", "gen_ai.tool.call.id"
_PART = "struct<type:string,content:string,id:string,name:string,arguments:string,result:string,uri:string>"
MESSAGES = f"array<struct<role:string,parts:array<{_PART}>>>"
_EVENTS = "array<struct<role:string,content:string,id:string,name:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"


def _attribute(name: str) -> Column:
    return F.element_at("attributes", F.lit(name))


def _ending(name: str) -> Column:
    """The attribute whose name ends so, whatever stands before the dot."""
    return F.get(F.map_values(F.map_filter("attributes", lambda k, _: k.endswith(name))), F.lit(0))


def is_run() -> Column:
    return F.coalesce(_attribute(OPERATION) == "invoke_agent", F.lit(False)) | F.col("name").isin(*RUN_NAMES) | F.col("name").startswith("invoke_agent ")


def is_tool() -> Column:
    return F.coalesce(_attribute(OPERATION) == "execute_tool", F.lit(False)) | F.col("name").isin(*TOOL_NAMES) | F.col("name").startswith("execute_tool ")


def nested_runs(spark: SparkSession, spans: DataFrame, view: str = "_run_spans") -> DataFrame:
    """(trace_id, span_id) of the runs that stand, at any depth, under another run; parents are followed up to the first run, cycles are cut."""
    spans.select("trace_id", "span_id", "parent_id", is_run().alias("run")).createOrReplaceTempView(view)
    return spark.sql(f"""WITH RECURSIVE up(trace_id, span_id, at, found, seen) MAX RECURSION LEVEL 1000000000 AS (
        SELECT trace_id, span_id, parent_id, false, array(span_id) FROM {view} WHERE run
        UNION ALL SELECT u.trace_id, u.span_id, p.parent_id, p.run, array_append(u.seen, p.span_id) FROM up u JOIN {view} p ON u.trace_id = p.trace_id AND u.at = p.span_id WHERE NOT u.found AND NOT array_contains(u.seen, p.span_id))
        SELECT DISTINCT trace_id, span_id FROM up WHERE found""")


def _older_messages(events: Column) -> Column:
    """Messages of the older event list: a tool's answer, or a text and the calls beside it."""
    none = F.lit(None).cast("string")

    def part(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), *(values.get(n, none).cast("string").alias(n) for n in ("content", "id", "name", "arguments", "result", "uri")))

    def message(e: Column) -> Column:
        answer = F.array(part("tool_call_response", id=e["id"], name=e["name"], result=e["content"]))
        said = F.when(e["content"].isNotNull(), F.array(part("text", content=e["content"]))).otherwise(F.array().cast(f"array<{_PART}>"))
        calls = F.transform(F.coalesce(e["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")), lambda c: part("tool_call", id=c["id"], name=c["function"]["name"], arguments=c["function"]["arguments"]))
        return F.struct(e["role"].alias("role"), F.when(e["role"] == "tool", answer).otherwise(F.concat(said, calls)).alias("parts"))

    return F.transform(F.from_json(events, _EVENTS), message)


def _has_prompt(m: Column) -> Column:
    own = F.exists(m["parts"], lambda p: (p["type"] != "tool_call_response") & (p["content"].isNotNull() | p["uri"].isNotNull()))
    return F.coalesce((m["role"] == "user") & own, F.lit(False))


def _paired_calls(messages: Column) -> Column:
    """array<struct<id, name, arguments, result>> of the calls in messages, in order; of several calls of one id the last before a response owns it."""
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["parts"], F.array().cast(f"array<{_PART}>"))))
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    calls = F.filter(placed, lambda x: x["p"]["type"] == "tool_call")
    answers = F.filter(placed, lambda x: x["p"]["type"] == "tool_call_response")

    def row(c: Column) -> Column:
        again = F.array_min(F.transform(F.filter(calls, lambda d: (d["i"] > c["i"]) & (d["p"]["id"] == c["p"]["id"])), lambda d: d["i"]))
        mine = F.filter(answers, lambda a: (a["p"]["id"] == c["p"]["id"]) & (a["i"] > c["i"]) & (a["i"] < F.coalesce(again, F.lit(2147483647))))
        return F.struct(c["p"]["id"].alias("id"), c["p"]["name"].alias("name"), c["p"]["arguments"].alias("arguments"), F.try_element_at(mine, F.lit(-1))["p"]["result"].alias("result"))

    return F.transform(calls, row)


def agent_runs(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """Every agent run of a span table, with its prompt, history, tool calls and output.

    Columns: trace_id, span_id, name, agent_name, run_id, conversation_id, model, start, prompt (a
    text, or its parts as JSON), history and own messages, instructions, tool_calls (with error,
    where the call's tool span failed), output, output_is_text (the run's last words, so never read
    as JSON), error, nested, version (1: event list, 2 and 3: messages), problems.
    """
    good = normalise_spans(spans)
    failed = good.where(is_tool() & F.col("error").isNotNull() & _attribute(CALL_ID).isNotNull()).groupBy("trace_id", _attribute(CALL_ID).alias("id")).agg(F.max_by("error", "seq").alias("error"))
    failed = failed.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "error"))).alias("failed"))
    nested = nested_runs(spark, good).withColumn("nested", F.lit(True))
    runs = good.where(is_run()).join(failed, "trace_id", "left").join(nested, ["trace_id", "span_id"], "left")

    raw, older = _ending(".all_messages"), _attribute("all_messages_events")
    version = F.when(raw.isNotNull(), F.when(F.col("name").isin(*RUN_NAMES[:1]), 2).otherwise(3)).when(older.isNotNull(), 1)
    runs = runs.withColumn("version", version).withColumn("messages", F.when(raw.isNotNull(), F.from_json(raw, MESSAGES)).otherwise(_older_messages(older)))
    places = F.filter(F.sequence(F.lit(0), F.size("messages") - 1), lambda i: _has_prompt(F.get("messages", i)))
    index = F.coalesce(_ending(".new_message_index").try_cast("int"), F.lit(0))
    index = F.when(index.between(0, F.size("messages")), index).otherwise(0)
    start = F.when(F.col("version") == 1, F.array_max(places)).otherwise(F.array_min(F.filter(places, lambda i: i >= index)))
    runs = runs.withColumn("at", F.when(F.size("messages") > 0, start))
    runs = runs.withColumns({"history": F.when(F.col("at").isNotNull(), F.slice("messages", 1, F.col("at"))).otherwise(F.array().cast(MESSAGES)), "own": F.when(F.col("at").isNotNull(), F.slice("messages", F.col("at") + 1, F.size("messages"))).otherwise(F.col("messages"))})

    asked = F.filter(F.get("messages", F.col("at"))["parts"], lambda p: p["type"] != "tool_call_response")
    plain = F.forall(asked, lambda p: (p["type"] == "text") & p["content"].isNotNull())
    prompt = F.when(plain, F.array_join(F.transform(asked, lambda p: p["content"]), "\n")).otherwise(F.to_json(asked))
    spoken = F.filter("own", lambda m: m["role"] == "assistant")
    last = F.array_join(F.transform(F.filter(F.try_element_at(spoken, F.lit(-1))["parts"], lambda p: p["type"] == "text"), lambda p: p["content"]), "")
    output, system = _attribute("final_result"), F.from_json(_attribute("gen_ai.system_instructions"), "array<struct<content:string>>")
    calls = F.transform(_paired_calls(F.col("own")), lambda c: c.withField("error", F.element_at("failed", c["id"])))
    problems = F.array_compact(F.array(F.when(F.col("version").isNull(), "no messages recorded"), F.when(F.col("version").isNotNull() & F.col("messages").isNull(), "messages unreadable"), F.when((F.size("messages") > 0) & F.col("at").isNull(), "no user prompt in the messages"), F.when(output.isNull() & F.col("error").isNull(), "no final result recorded")))
    agent = F.coalesce(_attribute("gen_ai.agent.name"), _attribute("agent_name"))
    return runs.select(
        "seq", "trace_id", "span_id", F.concat_ws("-", F.coalesce(agent, F.lit("agent")), F.substring("trace_id", 1, 8), F.substring("span_id", 1, 8)).alias("name"), agent.alias("agent_name"),
        _attribute("gen_ai.agent.call.id").alias("run_id"), _attribute("gen_ai.conversation.id").alias("conversation_id"), _attribute("model_name").alias("model"), "start",
        F.when(F.col("at").isNotNull(), prompt).alias("prompt"), "history", "own", F.nullif(F.array_join(F.transform(system, lambda p: p["content"]), "\n"), F.lit("")).alias("instructions"),
        F.coalesce(calls, F.array().cast("array<struct<id:string,name:string,arguments:string,result:string,error:string>>")).alias("tool_calls"), output.alias("output"), F.coalesce(last == output, F.lit(False)).alias("output_is_text"),
        "error", F.coalesce("nested", F.lit(False)).alias("nested"), "version", problems.alias("problems"),
    )


def select_runs(runs: DataFrame, agents: list[str] | None = None, errors: str = "include", nested: bool = False, where: Column | None = None, deduplicate: bool = True, sample: int | None = None, seed: str = "runs") -> DataFrame:
    """The runs to make cases of: every filter first, then the earliest of each (prompt, history), then a sample.

    Adds duplicates (later runs with the same inputs) and later (their names).  A sampled table keeps
    the order of start.
    """
    if errors not in ("include", "exclude", "only"):
        raise ValueError("errors must be include, exclude or only")
    kept = runs.where(F.col("prompt").isNotNull())
    if agents is not None:
        kept = kept.where(F.col("agent_name").isin(*agents))
    if errors != "include":
        kept = kept.where(F.col("error").isNotNull() if errors == "only" else F.col("error").isNull())
    if not nested:
        kept = kept.where(~F.col("nested"))
    if where is not None:
        kept = kept.where(where)
    if deduplicate:
        key = F.sha2(F.to_json(F.struct("prompt", "history")), 256)
        w = Window.partitionBy("_key").orderBy(F.col("start").asc_nulls_first(), "seq")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = kept.withColumn("_key", key).withColumns({"_rn": F.row_number().over(w), "later": F.slice(F.collect_list("name").over(whole), F.lit(2), F.lit(2147483647))})
        kept = ranked.where("_rn = 1").drop("_rn", "_key").withColumn("duplicates", F.size("later"))
    else:
        kept = kept.withColumns({"later": F.array().cast("array<string>"), "duplicates": F.lit(0)})
    if sample is not None:
        kept = kept.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "trace_id", "span_id"), 256)).limit(sample)
    return kept.orderBy(F.col("start").asc_nulls_first(), "seq")


def cases_of(runs: DataFrame, accepted: Column, as_expected: bool = False) -> DataFrame:
    """Cases (case_id, inputs, output, expected_output, metadata) of selected runs; output is a known-good answer only where accepted."""
    good = F.coalesce(accepted, F.lit(False)) & F.col("output").isNotNull() & F.col("error").isNull()
    metadata = F.create_map(F.lit("trace_id"), F.col("trace_id"), F.lit("span_id"), F.col("span_id"), F.lit("recorded_output"), F.col("output"))
    return runs.select(F.col("name").alias("case_id"), F.col("prompt").alias("inputs"), F.when(good, F.col("output")).alias("output"), (F.when(good, F.col("output")) if as_expected else F.lit(None).cast("string")).alias("expected_output"), metadata.alias("metadata"))


def ancestors(spark: SparkSession, spans: DataFrame, view: str = "_span_parents") -> DataFrame:
    """(trace_id, span_id, depth, root): the chain of parents of every span, cycles cut."""
    spans.select("trace_id", "span_id", "parent_id").createOrReplaceTempView(view)
    return spark.sql(f"""WITH RECURSIVE up(trace_id, span_id, at, depth, seen) MAX RECURSION LEVEL 1000000000 AS (
        SELECT trace_id, span_id, parent_id, 0, array(span_id) FROM {view}
        UNION ALL SELECT u.trace_id, u.span_id, p.parent_id, u.depth + 1, array_append(u.seen, p.span_id) FROM up u JOIN {view} p ON u.trace_id = p.trace_id AND u.at = p.span_id WHERE NOT array_contains(u.seen, p.span_id))
        SELECT trace_id, span_id, max(depth) AS depth, max_by(seen[size(seen) - 1], depth) AS root FROM up GROUP BY trace_id, span_id""")


def dedupe_runs(runs: DataFrame, accepted: Column, prompt: str = "prompt", start: str = "start") -> DataFrame:
    """Accepted runs only, then the earliest of each prompt (a missing time first, then arrival), with the number of later repeats."""
    w = Window.partitionBy(prompt)
    order = w.orderBy(F.col(start).asc_nulls_first(), "seq")
    kept = runs.where(accepted).withColumns({"_rn": F.row_number().over(order), "duplicates": F.count("*").over(w) - 1})
    return kept.where("_rn = 1").drop("_rn")


def pair_tools(messages: DataFrame) -> DataFrame:
    """Tool calls with the last response of their id before the next call of it: run_id, call_id, call_no, response_no (null: unanswered).

    messages: run_id, no, kind (tool_call or tool_call_response), call_id.  One window over the
    messages of an id; calls and responses are never multiplied.
    """
    w = Window.partitionBy("run_id", "call_id").orderBy("no")
    call = F.col("kind") == "tool_call"
    rows = messages.where(F.col("kind").isin("tool_call", "tool_call_response")).withColumn("call_no", F.max(F.when(call, F.col("no"))).over(w))
    return rows.where("call_no is not null").groupBy("run_id", "call_id", "call_no").agg(F.max(F.when(~call, F.col("no"))).alias("response_no"))


def occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The how-manieth identical row this is, from 0."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def cache_misses(plan: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Planned judgments that no stored verdict answers."""
    return plan.join(cache.select(*keys).distinct(), keys, "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of every key of both tables."""
    both = cache.unionByName(fresh)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).where("_rn = 1").drop("_rn")


def reuse(cases: DataFrame, cache: DataFrame, keys: list[str], version: str, task) -> tuple[DataFrame, DataFrame]:
    """(cases with output and hit, cache with what was made): outputs stored under the same keys and version are reused, only the others are made.

    cache: keys, version, output.  task(rows) adds output to rows; a changed version misses
    everything, and the newest output of a key stays.
    """
    known = cache.where(F.col("version") == version).select(*keys, F.col("output"))
    hits = cases.join(known, keys).withColumn("hit", F.lit(True))
    made = task(cases.join(known.select(*keys), keys, "left_anti")).withColumn("hit", F.lit(False))
    fresh = made.select(*keys, F.lit(version).alias("version"), "output").dropDuplicates(keys)
    kept = cache.join(fresh.select(*keys, "version"), [*keys, "version"], "left_anti")
    return hits.unionByName(made), kept.select(*keys, "version", "output").unionByName(fresh)
