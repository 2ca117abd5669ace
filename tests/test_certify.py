"""Scripted judges must get the verdict they deserve."""

import pytest
from pyspark.sql import functions as F

from gavelframe.__main__ import main
from gavelframe.operators import certify, controls, judges, report
from gavelframe.sources import certificates

ANSWERS = [f"City {chr(65 + i % 26)}{i}" for i in range(40)]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"q{i}", f"Capital {i}?", f"It is  {a}.", a, "en" if i % 2 else "de") for i, a in enumerate(ANSWERS)]
    return spark.createDataFrame(rows, "case_id string, inputs string, output string, expected_output string, slice string")


@pytest.fixture(scope="module")
def planned(cases):
    wrong = cases.withColumns({"output": F.concat(F.lit("not "), F.reverse("expected_output")), "label": F.lit(0)})
    return certify.plan(cases, cases.withColumn("label", F.lit(1)).unionByName(wrong), 2).cache()


@pytest.fixture(scope="module")
def judged(planned):
    output, expected = F.col("output"), F.col("expected_output")
    parts = [judges.by_column(planned, n, judges.scripted(n, output, expected)) for n in ("oracle", "yes_man", "no_man", "exact", "lenient_on_empty")]
    parts.append(judges.by_column(planned, "broken", F.lit(None).cast("boolean")))
    parts.append(judges.by_column(planned, "flaky", judges.scripted("oracle", output, expected) & (F.col("repeat") == 0)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.cache()


@pytest.fixture(scope="module")
def decided(judged):
    return certify.checks(judged, draws=300).cache()


def test_scripted_judges(decided):
    got = {r.judge_id: r.verdict for r in certify.verdicts(decided).collect()}
    assert got == {"oracle": "ADMISSIBLE", "yes_man": "INADMISSIBLE", "no_man": "INADMISSIBLE", "exact": "INADMISSIBLE", "lenient_on_empty": "INADMISSIBLE", "broken": "UNVALIDATED", "flaky": "INADMISSIBLE"}
    status = {(r.judge_id, r.name): r.status for r in decided.collect()}
    assert status["yes_man", "rejection"] == "FAIL" and status["no_man", "acceptance"] == "FAIL" and status["flaky", "stability"] == "FAIL"
    assert status["lenient_on_empty", "rejection"] == "FAIL"
    assert {status["broken", n] for n in ("acceptance", "rejection", "stability", "human_agreement")} == {"UNVALIDATED"}
    people = {r.judge_id: r for r in decided.where("name = 'human_agreement'").collect()}
    assert people["oracle"].estimate == 1 and people["oracle"].status == "PASS" and 0.7 < people["oracle"].low < 0.95  # the exact floor, not the point 1
    assert people["yes_man"].status == "FAIL" and people["yes_man"].estimate == 0


def test_plan_reads_each_table_once(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(20)], "case_id long, output string, label int").write.parquet(str(tmp_path / "t"))
    people = spark.read.parquet(str(tmp_path / "t")).withColumn("good", F.col("label") == 1)
    rows = judges.by_column(certify.plan_people(people, 2), "j", F.length("output") > 3)
    plan = certify.checks(rows, draws=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2


def test_donors_differ_in_output_and_expectation(spark):
    rows = [(i, "yes" if i < 5 else "no", "yes" if i < 5 else "no") for i in range(8)] + [(20, "no", None)]
    cases = spark.createDataFrame(rows, "case_id long, output string, expected_output string")
    got = {r.case_id: r.output for r in certify.plan_control(cases, controls.mismatched()).collect()}
    assert got == {i: "no" if o == "yes" else "yes" for i, o, _ in rows}
    same = cases.withColumn("output", F.lit("yes"))
    assert certify.plan_control(same, controls.mismatched()).count() == 0


def test_controls_that_do_not_apply_are_left_out(spark):
    cases = spark.createDataFrame([(1, "a \t b\nc ", "in"), (2, "  ", "in"), (3, "", None)], "case_id long, output string, inputs string")
    run = lambda c: {(r.case_id, r.output, r.inputs) for r in certify.plan_control(cases, c).collect()}
    assert run(controls.EMPTY) == {(1, "", "in")}
    assert {r[1] for r in run(controls.REFORMAT)} == {"a b\n\nc\n", "\n"}
    assert run(controls.evidence_rewrite("x", lambda i: F.lit("out"))) == {(1, "a \t b\nc ", "out"), (2, "  ", "out"), (3, "", "out")}
    assert run(controls.rewrite("x", lambda o: F.when(F.length(o) > 3, F.upper(o)))) == {(1, "A \t B\nC ", "in")}


def test_python_judges_give_reasons_and_errors(spark, planned):
    def judge(inputs, output, expected):
        if output == "":
            raise RuntimeError("x" * 500)
        return {"right": (expected in output, "looked"), "score": 3, "other": True}

    rows = judges.by_function(planned, "f", judge, assertion="right").cache()
    empty = rows.where("family = 'empty_output'").first()
    assert empty.passed is None and empty.error.startswith("RuntimeError: xxx") and len(empty.error) == 300
    assert rows.where("kind = 'reference' and passed and reason = 'looked'").count() == 80
    unclear = judges.by_function(planned.limit(1), "f", judge).first()
    assert unclear.passed is None and "2 verdicts" in unclear.error
    with pytest.raises(ValueError):
        judges.verdict_of("yes")


def test_unknown_and_repeated_cases_raise(spark, cases):
    with pytest.raises(ValueError, match="unknown cases"):
        certify.require_cases(cases.withColumn("case_id", F.lit("else")), cases)
    with pytest.raises(ValueError, match="unique"):
        certify.require_cases(cases, cases.unionByName(cases))


def test_a_judge_without_controls_is_unvalidated(spark, cases):
    rows = judges.by_column(certify.plan(cases, None, 1, ()), "j", F.lit(True))
    got = {r.name: r.status for r in certify.checks(rows).collect()}
    assert got["rejection"] == got["invariance"] == "UNVALIDATED" and got["acceptance"] == "PASS" and "stability" not in got


def test_looks_stop_at_the_first_failure(spark, judged):
    rows = certify.sequential(judged.where("judge_id in ('oracle', 'no_man')"), F.substring("case_id", 2, 2).cast("int") % 2, 2, draws=100).collect()
    got = {(r.judge_id, r.look): (r.verdict, r.stopped) for r in rows}
    assert got["no_man", 0] == ("INADMISSIBLE", False) and got["no_man", 1] == ("INADMISSIBLE", True)
    assert got["oracle", 1] == ("ADMISSIBLE", False)


def test_recovery_profiles(spark):
    rows = []
    for judge, forgives, catches in (("good", True, True), ("hard", False, True), ("blind", True, False), ("odd", False, False)):
        for i in range(30):
            rows += [(judge, i, "reference", "", 0, True), (judge, i, "must_hold", "error_then_repaired", 0, forgives), (judge, i, "must_fail", "error_unrepaired", 0, not catches)]
    df = spark.createDataFrame(rows, "judge_id string, case_id long, kind string, family string, repeat int, passed boolean")
    got = {r.judge_id: r.profile for r in certify.recovery_profile(df).collect()}
    assert got == {"good": "recovery-aware", "hard": "unforgiving", "blind": "blind to unrepaired errors", "odd": "backwards"}


def test_qualification_by_decision(spark, judged, decided):
    rows = judged.where("judge_id in ('oracle', 'yes_man')")
    config = F.create_map(F.lit("model"), F.lit("m1"))
    identities = spark.createDataFrame([("oracle",), ("yes_man",)], "judge_id string").select("judge_id", config.alias("certified"), config.alias("running"), F.lit(True).alias("reliable"), F.lit(40.0).alias("age_days"))
    run = lambda d, **k: {(r.judge_id, r.rule): r.outcome for r in report.qualify(decided, certify.families(rows), identities, d, **k).collect()}
    gate = run("gate", max_age_days=30)
    assert gate["oracle", "verdict"] == gate["oracle", "checks"] == gate["oracle", "coverage"] == "ok" and gate["oracle", "freshness"] == "fail"
    assert gate["yes_man", "verdict"] == gate["yes_man", "checks"] == "fail"
    steer = run("steer", slice_name="en", sees_traces=True, evidence=("empty_output",))
    assert steer["oracle", "evidence"] == "ok" and steer["oracle", "context_slice"] == "ok" and steer["yes_man", "evidence"] == "fail"
    with pytest.raises(ValueError):
        run("ship")


def test_report_tables(spark, judged, decided):
    assert report.certificate_table(decided).where("judge_id = 'oracle' and check = 'acceptance' and rate = 1 and verdict = 'ADMISSIBLE'").count() == 1
    a = spark.createDataFrame([("j", {"model": "m", "bar": "1", "old": "x"})], "judge_id string, config map<string,string>")
    b = spark.createDataFrame([("j", {"model": "m", "bar": "2"})], "judge_id string, config map<string,string>")
    assert {(r.setting, r.same) for r in report.coverage_table(a, b).collect()} == {("model", True), ("bar", False), ("old", False)}
    assert report.consistent_rejections(judged).where("judge_id = 'no_man'").count() == 40


def test_saved_certificates_are_replaced(spark, decided, tmp_path):
    path = str(tmp_path / "certificates")
    rows = certificates.certificates(decided)
    certificates.save(rows, path)
    certificates.save(rows.where("judge_id = 'oracle'"), path)
    got = certificates.load(spark, path).collect()
    assert [(r.judge_id, r.verdict) for r in got] == [("oracle", "ADMISSIBLE")]
    assert '"ADMISSIBLE"' in certificates.as_json(certificates.load(spark, path)).first()["json"]


def test_advice_and_cases_needed(spark, decided):
    lines = {(r.judge_id, r.name): r.advice for r in report.diagnose(decided).collect()}
    assert ("oracle", "acceptance") not in lines and "must fail" in lines["yes_man", "rejection"]
    rates = spark.createDataFrame([(1.0, 0.7), (0.6, 0.7), (0.9, 0.8), (0.81, 0.8)], "rate double, bar double")
    got = {(r.rate, r.bar): r.cases_needed for r in report.cases_needed(rates).collect()}
    assert got[1.0, 0.7] == 11 and got[0.6, 0.7] is None and got[0.9, 0.8] == 62 and got[0.81, 0.8] > 5000


def test_usage(capsys):
    assert main([]) == 2


def test_reports_read_the_judgments_once(spark):
    rows = [("j", c, kind, family, repeat, "a", (c + repeat) % 5 > 0) for c in range(40) for kind, family, repeat in (("reference", "", 0), ("reference", "", 1), ("must_fail", "x", 0), ("must_hold", "y", 0), ("human", "1", 0))]
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    judgments = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "judge_id string, case_id long, kind string, family string, repeat int, slice string, passed boolean")
    reports = {
        "checks": lambda: certify.checks(judgments, draws=20),
        "dataset": lambda: certify.dataset_report(judgments, draws=20),
        "sequential": lambda: certify.sequential(judgments, F.col("case_id") % 2, 2, draws=20),
    }
    for name, report in reports.items():
        before = read.value
        found = report().collect()
        assert read.value - before == len(rows), name
    assert sorted((r.look, r.judgments) for r in found) == [(0, 100), (1, 200)]
    [row] = certify.dataset_report(judgments, draws=20).collect()
    assert row.cases == 40
