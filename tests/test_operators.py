"""Sources, text functions, panels, traces, iterative tools and the canary."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gavelframe.functions import text as T
from gavelframe.operators import panel, traces
from gavelframe.streaming import canary

def test_repeated_and_pending_spans_drop(spark):
    rows = spark.createDataFrame([(0, "0xAB", "1", None, "x", False, 1), (1, "ab", "1", None, "later", False, 1), (2, "ab", "2", None, "p", True, 1), (3, "ab", "", None, "n", False, 1), (4, "ab", "", None, "n", False, 1)], "seq long, trace_id string, span_id string, parent_id string, name string, pending boolean, start int")
    assert sorted(r.name for r in traces.normalise_spans(rows).collect()) == ["n", "n", "x"]


def test_ancestors_cut_cycles(spark):
    rows = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "a")], "trace_id string, span_id string, parent_id string")
    assert {r.span_id: r.depth for r in traces.ancestors(spark, rows).collect()} == {"a": 1, "b": 1, "c": 2}


def test_ancestors_of_a_long_chain(spark):
    rows = spark.createDataFrame([("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(105)], "trace_id string, span_id string, parent_id string")
    got = {r.span_id: (r.depth, r.root) for r in traces.ancestors(spark, rows.coalesce(1)).collect()}
    assert got == {f"s{i}": (i, "s0") for i in range(105)}


def test_cache_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, out string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, v int, out string")
    assert {r.k: r.out for r in traces.upsert(old, new, ["k"], "v").collect()} == {"a": "z", "b": "y"}


@pytest.mark.parametrize("a, b, edits", [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("A  b", "a b", 0), ("", "", 0)])
def test_similarity(spark, a, b, edits):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.similarity(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(1 - edits / max(1, len(a), len(b)) if edits else 1.0)


def test_mutants(spark):
    df = spark.createDataFrame([("It costs $42.50, or 7 a day. Yes, sure! No more",)], "t string")
    t = F.col("t")
    got = df.select(T.bumped_number(t).alias("n"), T.flipped_yes_no(t).alias("y"), T.dropped_last_sentence(t).alias("s")).first()
    assert got.n == "It costs $42.50, or 8 a day. Yes, sure! No more"
    assert got.y == "It costs $42.50, or 7 a day. Yes, sure! Yes more"
    assert got.s == "It costs $42.50, or 7 a day. Yes, sure!"
    none = spark.createDataFrame([("plain",)], "t string").select(T.bumped_number(t), T.flipped_yes_no(t), T.dropped_last_sentence(t)).first()
    assert list(none) == [None, None, None]


def test_yes_and_no_beside_other_letters_are_words_as_in_sql(spark):
    texts = ["no\u00f1co", "x \u00e9no", "No\u0301", "\u0660no", "a_no", "1yes", "Yes\u200d", "no \u00f1 yes", "NO\n"]
    sql = r"SELECT regexp_extract(t, '(?is)^(.*)\b(yes|no)\b(.*)$', 1) AS head, regexp_extract(t, '(?is)^(.*)\b(yes|no)\b(.*)$', 2) AS word, regexp_extract(t, '(?is)^(.*)\b(yes|no)\b(.*)$', 3) AS tail FROM (SELECT unnest(?) AS t)"
    other = {"yes": "no", "Yes": "No", "no": "yes", "No": "Yes", "NO": "YES"}
    want = [head + other[word] + tail if word else None for head, word, tail in duckdb.execute(sql, [texts]).fetchall()]
    got = [T.flipped_yes_no(F.lit(t)) for t in texts]
    assert list(spark.range(1).select(*got).first()) == want
    assert want[0] == "yes\u00f1co" and want[4] is None


def test_long_s_counts_as_s_as_in_sql(spark):
    texts = ["ye\u017fx", "YE\u017f1.", "no ye\u017f", "a ye\u017f_", "aye\u017fb", "ye\u017f no"]
    assert list(spark.range(1).select(*[T.flipped_yes_no(F.lit(t)) for t in texts]).first()) == ["yesx", "yes1.", "yes ye\u017f", "a yes_", None, "ye\u017f yes"]


def test_iban_and_luhn(spark):
    df = spark.createDataFrame([("DE89370400440532013000", "4539578763621486"), ("DE88370400440532013000", "4539578763621487")], "i string, c string")
    assert [tuple(r) for r in df.select(T.iban_valid(F.col("i")), T.luhn(F.col("c"))).collect()] == [(True, True), (False, False)]


@pytest.mark.parametrize("votes, rule, tie, want", [([True, False], "majority", "fail", False), ([True, False], "majority", "abstain", None), ([True, None, True], "unanimous_pass", "fail", None), ([None, None, False], "any_fail", "fail", False), ([None, None, True], "any_fail", "fail", None), ([True, True, False], "majority", "fail", True)])
def test_jury_rules(spark, votes, rule, tie, want):
    df = spark.createDataFrame([(votes,)], "v array<boolean>")
    assert df.select(panel.jury_verdict(F.col("v"), rule, 2, tie)).first()[0] is want


def test_contested_item_counts_raters_not_verdicts(spark):
    rows = spark.createDataFrame([("i", "a", True)] * 4 + [("i", "b", False), ("i", "c", False), ("i", "d", None)], "item string, rater string, passed boolean")
    got = panel.contested(rows).first()
    assert got.split == pytest.approx(2 / 3) and got.minority == ["a"] and got.between and not got.within


def test_canary_stream_keeps_the_last_hundred(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("j", i, i >= 30) for i in range(150)] + [("j", 200, None)]
    spark.createDataFrame(rows, "judge_id string, seq long, rejected boolean").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("judge_id string, seq long, rejected boolean").parquet(str(source))
    query = canary.canary_stream(stream).writeStream.format("memory").queryName("canary_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("canary_out").collect()[-1]
    assert (got.checks, got.rejected, got.errors) == (100, 100, 1)
    twin = canary.canary_window(spark.read.parquet(str(source))).orderBy(F.desc("seq")).first()
    assert (twin.checks, twin.rejected) == (got.checks, got.rejected)


def test_windowed_stream(spark, tmp_path):
    source = tmp_path / "ev"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(source))
    query = canary.windowed_outcomes(stream).writeStream.format("memory").queryName("windows_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows_out").agg(F.sum("n")).first()[0] == spark.read.parquet(str(source)).count()
