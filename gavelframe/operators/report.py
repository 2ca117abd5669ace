"""What a certificate says: advice by check, cases a rate would need, report tables, fitness for a use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions.stats import binomial_cdf
from gavelframe.operators.certify import truth_of, verdicts

# Advice by check and status.
ADVICE = {
    ("acceptance", "FAIL"): "the judge rejects known-good answers: loosen the rubric or fix the answers",
    ("rejection", "FAIL"): "the judge passes answers that must fail: tighten the rubric",
    ("invariance", "FAIL"): "the verdict moves with formatting: judge the content only",
    ("stability", "FAIL"): "the same answer gets different verdicts: lower the temperature or vote",
    ("slices", "FAIL"): "one kind of case is below the bar: look at its cases",
    ("human_agreement", "FAIL"): "people disagree with the judge: review the disputed labels",
}
DECISIONS = ("report", "gate", "promote", "steer")


def cases_needed(rates: DataFrame, rate: str = "rate", bar: str = "bar", most: int = 100_000) -> DataFrame:
    """rates with cases_needed: the least number of cases whose exact lower bound reaches the bar at that rate; null if none up to most does.

    The bound reaches the bar where as many successes, or more, would be rarer than 2.5 % at the bar:
    one binomial tail a size.  Every size to 1,000 is tried, and larger ones in steps of a hundredth.
    """
    sizes = [1000]
    while sizes[-1] < most:
        sizes.append(min(most, sizes[-1] + sizes[-1] // 100))
    pairs = rates.select(F.col(rate).alias("r"), F.col(bar).alias("b")).where("r > b").distinct()
    every = F.concat(F.sequence(F.lit(1), F.lit(999)), F.array(*map(F.lit, sizes)))
    tried = pairs.withColumn("n", F.explode(every.cast("array<long>"))).withColumn("k", F.floor(F.col("r") * F.col("n") + 1e-9).cast("long"))
    reached = tried.where((F.col("k") > 0) & (binomial_cdf("(k - 1)", "n", "b") >= 0.975))
    least = reached.groupBy("r", "b").agg(F.min("n").alias("cases_needed"))
    joined = rates.join(least, (F.col(rate) == F.col("r")) & (F.col(bar) == F.col("b")), "left")
    return joined.drop("r", "b")


def diagnose(checks: DataFrame) -> DataFrame:
    """One line of advice for every check that does not pass."""
    advice = F.create_map(*(F.lit(x) for (name, status), text in ADVICE.items() for x in (f"{name}:{status}", text)))
    more = F.when(F.col("errors") > 0.1 * (F.col("trials") + F.col("errors")), "too many judgments errored").when(F.col("trials") < 10, "fewer than 10 judgments").otherwise("the interval straddles the bar: add cases")
    return checks.where("status <> 'PASS'").select("judge_id", "name", "status", F.coalesce(F.element_at(advice, F.concat_ws(":", "name", "status")), more).alias("advice"))


def consistent_rejections(judgments: DataFrame) -> DataFrame:
    """(judge_id, case_id, repeats): known-good answers that a judge rejects on every repeat, two at least: look at the answers first."""
    refs = judgments.where("kind = 'reference'").groupBy("judge_id", "case_id").agg(F.count("*").alias("repeats"), F.count_if(~F.col("passed")).alias("rejected"))
    return refs.where("repeats >= 2 and rejected = repeats").select("judge_id", "case_id", "repeats")


# -- report tables --------------------------------------------------------------------------
def certificate_table(checks: DataFrame) -> DataFrame:
    """(judge_id, verdict, check, status, rate, low, high, threshold): one row a check."""
    rate = F.col("successes") / F.nullif(F.col("trials"), F.lit(0))
    return checks.join(verdicts(checks).select("judge_id", "verdict"), "judge_id").select("judge_id", "verdict", F.col("name").alias("check"), "status", rate.alias("rate"), "low", "high", "threshold")


def coverage_table(certified: DataFrame, running: DataFrame) -> DataFrame:
    """(judge_id, setting, certified, running, same) of two tables of configurations (judge_id, config map): every setting of either, compared as text, null apart from missing."""
    entries = lambda df, name: df.select("judge_id", F.explode("config").alias("setting", name), F.lit(True).alias(f"has_{name}"))
    both = entries(certified, "certified").join(entries(running, "running"), ["judge_id", "setting"], "full_outer")
    same = F.col("certified").eqNullSafe(F.col("running")) & F.col("has_certified").eqNullSafe(F.col("has_running"))
    return both.select("judge_id", "setting", "certified", "running", same.alias("same"))


def evidence_table(judgments: DataFrame) -> DataFrame:
    """(judge_id, kind, family, right, wrong, unknown, errors): what the certificate rests on."""
    truth = truth_of(F.col("kind"), F.col("family"), F.col("repeat"))
    right = F.col("passed") == truth
    return judgments.groupBy("judge_id", "kind", "family").agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"), F.count_if(F.col("passed").isNotNull() & truth.isNull()).alias("unknown"), F.count_if(F.col("passed").isNull()).alias("errors"))


# -- fitness for a use ----------------------------------------------------------------------
def qualify(checks: DataFrame, families: DataFrame, identities: DataFrame, decision: str, slice_name: str | None = None, sees_traces: bool = False, evidence: Sequence[str] = (), max_age_days: float | None = None, other: Mapping[str, str] | None = None) -> DataFrame:
    """(judge_id, rule, outcome) of every rule that the decision calls for: ok, warn or fail; a judge without a fail is qualified.

    checks, families: as certify gives them.  identities: judge_id, certified and running (maps of
    settings, null: not recorded), reliable, age_days.  decision: report, gate, promote or steer.
    """
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {DECISIONS}")
    soft = F.lit("warn" if decision == "report" else "fail")
    status = lambda name: F.max(F.when(F.col("name") == name, F.col("status"))).alias(name)
    per = checks.groupBy("judge_id").agg(*(status(n) for n in ("acceptance", "rejection", "slices", "accuracy", "order_consistency")))
    per = per.join(verdicts(checks).select("judge_id", "verdict"), "judge_id").join(identities, "judge_id", "left")
    shown = families.where("name = 'rejection'").where(F.col("family").isin(*evidence)) if evidence else families.limit(0)
    proofs = shown.groupBy("judge_id").agg(F.count("*").alias("proofs"), F.count_if(F.col("status") != "PASS").alias("unproven"))
    kind = families.where((F.col("name") == "slices") & (F.col("family") == slice_name)) if slice_name else families.limit(0)
    kind = kind.select("judge_id", F.col("successes").alias("slice_k"), F.col("trials").alias("slice_n"), F.col("threshold").alias("slice_bar"))
    per = per.join(proofs, "judge_id", "left").join(kind, "judge_id", "left")

    def ok(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), "ok").otherwise("fail")

    certified = F.col("certified")
    reliable = F.coalesce("reliable", F.lit(False))
    same = F.to_json(F.array_sort(F.map_entries("certified"))).eqNullSafe(F.to_json(F.array_sort(F.map_entries("running"))))
    pairwise = F.col("accuracy").isNotNull()
    both = F.when(pairwise, (F.col("accuracy") == "PASS") & (F.col("order_consistency") == "PASS")).otherwise((F.col("acceptance") == "PASS") & (F.col("rejection") == "PASS"))
    rules = {
        "coverage": F.when(certified.isNull(), soft).when(~same, "fail").when(~reliable, "warn").otherwise("ok"),
        "verdict": F.when(F.col("verdict") == "ADMISSIBLE", "ok").when((F.lit(decision) == "report") & (F.col("verdict") == "UNVALIDATED"), "warn").otherwise("fail"),
    }
    if decision != "report":
        rules["checks"] = ok(both)
    if decision == "promote":
        rules["slices"] = F.when(F.col("slices").isNull(), "warn").when(F.col("slices") == "FAIL", "fail").otherwise("ok")
    if slice_name:
        rules["context_slice"] = F.when(F.coalesce(F.col("slice_n") > 0, F.lit(False)) & (F.col("slice_k") > F.col("slice_bar") * F.col("slice_n")), "ok").otherwise(soft)
    if decision == "steer":
        if sees_traces:
            blind = F.element_at(certified, F.lit("include_input")) == "false"
            rules["evidence"] = F.when(F.coalesce(blind, F.lit(False)), "fail").otherwise(ok((F.col("proofs") > 0) & (F.col("unproven") == 0)))
        rules["reasons"] = F.when(F.element_at(certified, F.lit("include_reason")) == "false", "warn").otherwise("ok")
    if max_age_days is not None:
        rules["freshness"] = ok(F.col("age_days") <= max_age_days)
    if other:
        rules["context"] = F.lit("warn")
    return per.select("judge_id", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), r.alias("outcome")) for n, r in rules.items()))).alias("r")).select("judge_id", "r.*")
