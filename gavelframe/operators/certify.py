"""Planning known-answer judgments and deciding certificates from verdicts.

``judgments`` have one row a verdict: judge_id, case_id, kind (reference, must_fail, must_hold,
human), family, repeat, slice and passed; a null verdict is an error, never a fail.

Judgments are brought together once, by judge and case; what every check needs is then a few
counts a judge and family (``tally``), and all decisions are made on that small table.  The case is
the unit of evidence: acceptance and slices use its first judgment, repeats serve stability only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.stats import check_status, clopper_pearson, kappa
from gavelframe.operators import controls
from gavelframe.operators.controls import Control

BARS = {"acceptance": 0.7, "rejection": 0.8, "invariance": 0.8, "slices": 0.7, "stability": 0.8, "human_agreement": 0.4}
MIN_TRIALS = 10
DRAWS = 2000
PLAN = ("case_id", "slice", "kind", "family", "repeat", "inputs", "output", "expected_output")
CHECK = ("name", "status", "successes", "trials", "errors", "low", "high", "threshold", "estimate")


# -- planning -------------------------------------------------------------------------------
def with_defaults(cases: DataFrame) -> DataFrame:
    """cases with inputs, expected_output and slice, null where they have none."""
    missing = [c for c in ("inputs", "expected_output", "slice") if c not in cases.columns]
    return cases.select("*", *(F.lit(None).cast("string").alias(c) for c in missing))


def plan_people(people: DataFrame, repeats: int = 1, chosen: Sequence[Control] = controls.DEFAULT, buckets: int = 1) -> DataFrame:
    """The plan in one pass over people: case_id, output, good (a known-good answer) and label (0, 1 or null).

    A known-good answer is judged repeats times and under every control; a labelled output once more.
    """
    rows = with_defaults(people)
    if any(c.donor for c in chosen):
        rows = controls.with_donors(rows, ["good"], buckets)
    else:
        rows = rows.withColumn("donor", F.lit(None).cast("string"))
    inputs, output, donor = F.col("inputs"), F.col("output"), F.col("donor")
    repeated = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda i: controls.plan_row("reference", "", i, inputs, output))
    good = F.concat(repeated, F.array(*(c.row(inputs, output, donor) for c in chosen))) if chosen else repeated
    human = F.array(controls.plan_row("human", F.col("label").cast("int").cast("string"), F.lit(0), inputs, output))
    rows = rows.select("case_id", "slice", "expected_output", F.explode(F.concat(F.when(F.col("good"), good).otherwise(F.slice(human, 1, 0)), F.when(F.col("label").isNotNull(), human).otherwise(F.slice(human, 1, 0)))).alias("p"))
    return rows.select("case_id", "slice", "p.*", "expected_output").where("output is not null").select(*PLAN)


def plan(cases: DataFrame, labelled: DataFrame | None = None, repeats: int = 1, chosen: Sequence[Control] = controls.DEFAULT, buckets: int = 1) -> DataFrame:
    """The plan of known-good cases and, in a table of their own, labelled outputs (with label 0 or 1)."""
    people = with_defaults(cases).withColumn("good", F.lit(True)).withColumn("label", F.lit(None).cast("int"))
    if labelled is not None:
        people = people.unionByName(with_defaults(labelled).withColumn("good", F.lit(False)).withColumn("label", F.col("label").cast("int")), allowMissingColumns=True)
    return plan_people(people, repeats, chosen, buckets)


def plan_repeats(cases: DataFrame, repeats: int) -> DataFrame:
    """Every known-good answer, repeats times."""
    return plan(cases, None, repeats, ())


def plan_control(cases: DataFrame, control: Control, buckets: int = 1) -> DataFrame:
    """Every case under one control, where it applies."""
    return plan(cases, None, 1, (control,), buckets).where(F.col("kind") != "reference")


def require_cases(labelled: DataFrame, cases: DataFrame) -> None:
    """Raise if an output is labelled for a case that is not there, or a case is there twice."""
    unknown = labelled.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"labels for unknown cases: {[r[0] for r in unknown]}")
    twice = cases.groupBy("case_id").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"case ids must be unique: {[r[0] for r in twice]}")


def truth_of(kind: Column, family: Column, repeat: Column) -> Column:
    """The right verdict of a planned judgment, where it is known."""
    return F.when((kind == "reference") & (repeat == 0), True).when(kind == "must_hold", True).when(kind == "must_fail", False).when(kind == "human", family == "1")


# -- evidence -------------------------------------------------------------------------------
def evidence(judgments: DataFrame, keys: Sequence[str] = ("judge_id",)) -> DataFrame:
    """One row a judge and case: counts of its reference verdicts, its control verdicts and its labelled ones."""
    kind, passed = F.col("kind"), F.col("passed")
    ref, first = kind == "reference", (kind == "reference") & (F.col("repeat") == 0)
    return judgments.groupBy(*keys, "case_id").agg(
        F.min(F.when(ref, F.col("slice"))).alias("slice"),
        F.count_if(ref).alias("n"),
        F.count(F.when(ref, passed)).alias("v"),
        F.count_if(ref & passed).alias("p"),
        F.count_if(first).alias("firsts"),
        F.count(F.when(first, passed)).alias("first_v"),
        F.count_if(first & passed).alias("first_p"),
        F.max(F.when(ref, F.col("repeat"))).alias("last"),
        F.collect_list(F.when(kind.isin("must_fail", "must_hold"), F.struct("kind", "family", "passed"))).alias("controls"),
        F.count_if((kind == "human") & passed.isNull()).alias("human_errors"),
        *(F.count_if((kind == "human") & (F.col("family") == h) & (passed if v else ~passed)).alias(c) for h, v, c in (("1", True, "both_pass"), ("1", False, "human_only"), ("0", True, "judge_only"), ("0", False, "both_fail"))),
        F.count_if(kind == "human").alias("humans"),
        F.count("*").alias("rows"),
    )


def majority() -> Column:
    """Of an evidence row: more than half of a case's repeats pass; a tie fails, no verdict is null."""
    return F.when(F.col("v") > 0, 2 * F.col("p") > F.col("v"))


def majorities(judgments: DataFrame) -> DataFrame:
    """(judge_id, case_id, majority) of every case that has reference judgments."""
    return evidence(judgments).where("n > 0").select("judge_id", "case_id", majority().alias("majority"))


def _count(name: str, family: Column, successes: Column, trials: Column, errors: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), family.alias("family"), successes.cast("long").alias("successes"), trials.cast("long").alias("trials"), errors.cast("long").alias("errors"))


def tally(judgments: DataFrame, keys: Sequence[str] = ("judge_id",), sizes: bool = False) -> DataFrame:
    """(keys, name, family, successes, trials, errors) of every check, family and slice.

    The rows named human hold the labelled outputs: family is a case's counts of both pass, human
    only, judge only and both fail, trials the cases with these counts.  With sizes, a row named size
    has as successes the verdicts, as trials the cases with reference judgments, as errors all judgments.
    """
    per = evidence(judgments, keys).withColumn("majority", majority())
    whole = F.col("v") == F.col("n")
    nothing, one, verdict = F.lit(""), F.lit(1), lambda c: c["passed"].isNotNull().cast("int")
    first = (F.col("first_p"), F.col("first_v"), F.col("firsts") - F.col("first_v"))
    cells = [F.col(c) for c in ("both_pass", "human_only", "judge_only", "both_fail")]
    judged = cells[0] + cells[1] + cells[2] + cells[3]

    def family(c: Column) -> Column:
        held = c["kind"] == "must_hold"
        right = F.when(held, c["passed"] == F.col("majority")).otherwise(~c["passed"])
        kept = _count("rejection", c["family"], F.coalesce(right, F.lit(False)).cast("int"), verdict(c), 1 - verdict(c))
        return F.when(held, kept.withField("name", F.lit("invariance"))).otherwise(kept)

    usable = F.filter("controls", lambda c: (c["kind"] == "must_fail") | F.col("majority").isNotNull())
    rows = F.concat(
        F.when(F.col("firsts") > 0, F.array(_count("acceptance", nothing, *first), _count("slices", F.col("slice"), *first))).otherwise(F.array().cast(COUNTS)),
        F.when(F.col("last") > 0, F.array(_count("stability", nothing, (whole & ((F.col("p") == 0) | (F.col("p") == F.col("n")))).cast("int"), whole.cast("int"), 1 - whole.cast("int")))).otherwise(F.array().cast(COUNTS)),
        F.when(F.col("humans") > 0, F.array(_count("human", F.concat_ws(",", *cells), cells[0] + cells[3], F.when(judged > 0, one).otherwise(0), F.col("human_errors")))).otherwise(F.array().cast(COUNTS)),
        F.transform(usable, family),
    )
    if sizes:
        size = _count("size", nothing, F.col("v") + F.aggregate("controls", F.lit(0).cast("long"), lambda a, c: a + verdict(c)) + F.col("humans") - F.col("human_errors"), (F.col("n") > 0).cast("int"), F.col("rows"))
        rows = F.concat(rows, F.array(size))
    rows = per.select(*keys, F.explode(rows).alias("t")).select(*keys, "t.*").where("name <> 'slices' or family is not null")
    return rows.groupBy(*keys, "name", "family").agg(*(F.sum(c).alias(c) for c in ("successes", "trials", "errors")))


TALLY = ("name", "family", "successes", "trials", "errors")
COUNTS = "array<struct<name string, family string, successes bigint, trials bigint, errors bigint>>"


def counts_of(judgments: DataFrame, name: str) -> DataFrame:
    """(judge_id, family, successes, trials, errors) of one check."""
    return tally(judgments).where(F.col("name") == name).drop("name")


def confusion(judgments: DataFrame) -> DataFrame:
    """Labels against verdicts: both_pass, human_only, judge_only, both_fail, errors, kappa."""
    cells = [F.sum(c).alias(c) for c in ("both_pass", "human_only", "judge_only", "both_fail")]
    per = evidence(judgments).where("humans > 0").groupBy("judge_id").agg(*cells, F.sum("human_errors").alias("errors"))
    return per.withColumn("kappa", kappa("both_pass", "human_only", "judge_only", "both_fail"))


# -- decisions ------------------------------------------------------------------------------
def with_budget(tallies: DataFrame, keys: Sequence[str], looks: int) -> DataFrame:
    """tallies with alpha_fail: every check, family and slice that can fail, at every look, shares one error budget."""
    # all counts of a judge in one array: whatever is asked of them later has the same plan below, which runs once
    listed = tallies.groupBy(*keys).agg(F.collect_list(F.struct(*TALLY)).alias("t"))
    count = lambda *names: F.size(F.filter("t", lambda x: x["name"].isin(*names)))
    n = 1 + count("rejection", "invariance", "slices") + count("stability") + F.least(F.lit(1), count("human"))
    return listed.select(*keys, (0.05 / (n * looks)).alias("alpha_fail"), F.explode("t").alias("t")).select(*keys, "t.*", "alpha_fail")


def agreement(kinds: DataFrame, keys: Sequence[str], bar: float, min_trials: int, draws: int) -> DataFrame:
    """human_agreement of the rows named human: kappa on an interval that resamples cases.

    PASS needs the lower of two bounds: the bootstrap's, and an exact bound on agreement by case
    carried to kappa with chance agreement held fixed, since a resample of cases that all agree is
    a point.  FAIL is decided on the bootstrap at the error budget.
    """
    names = ("both_pass", "human_only", "judge_only", "both_fail")
    cut = F.split("family", ",")
    typed = kinds.select(*keys, "family", "trials", "errors", "alpha_fail", *(F.get(cut, F.lit(i)).cast("long").alias(c) for i, c in enumerate(names)))
    typed = typed.withColumn("pairs", F.expr("+".join(names)))
    # one pass: the cases as they are (draw -1) and the resamples
    drawn = resample.weights(typed, "family", "trials", draws, "kappa", observed=True)
    share = F.when(F.col("pairs") > 0, (F.col("both_pass") + F.col("both_fail")) / F.col("pairs") * F.col("w"))
    each = drawn.groupBy(*keys, "draw").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in names), F.first("alpha_fail").alias("alpha_fail"), F.sum("errors").alias("errors"), F.sum("w").alias("cases"), F.sum(share).alias("shares"))
    each = each.withColumn("kappa", kappa(*names))
    seen = lambda c: F.max(F.when(F.col("draw") < 0, F.col(c))).alias(c)
    c = each.groupBy(*keys).agg(*map(seen, (*names, "alpha_fail", "errors", "cases", "shares", "kappa")), F.sort_array(F.collect_list(F.when(F.col("draw") >= 0, F.col("kappa")))).alias("values"))
    c = c.withColumns({"trials": F.expr("+".join(names)), "successes": F.expr("both_pass + both_fail"), "agreeing": F.floor(F.coalesce("shares", F.lit(0.0)) + 1e-9)})
    a, b = F.expr("(both_pass + human_only) / nullif(trials, 0)"), F.expr("(both_pass + judge_only) / nullif(trials, 0)")
    expected = a * b + (1 - a) * (1 - b)
    exact = F.when(expected < 1, F.greatest(F.lit(-1.0), (clopper_pearson("agreeing", "cases")[0] - expected) / (1 - expected))).otherwise(0.0)
    (boot_low, boot_high), fail_high = resample.percentile("values", 0.05), resample.percentile("values", F.col("alpha_fail"))[1]
    c = c.withColumns({"k_low": F.least(boot_low, exact), "k_high": boot_high, "k_fail": fail_high})
    unsure = F.expr(f"errors > 0.1D * (trials + errors) or both_pass + human_only = 0 or judge_only + both_fail = 0 or kappa is null or trials < {min_trials} or cases < {min_trials}")
    status = F.when(unsure, "UNVALIDATED").when(F.col("k_low") >= bar, "PASS").when(F.col("k_fail") < bar, "FAIL").otherwise("UNVALIDATED")
    low, high = F.when(unsure, 0.0).otherwise(F.col("k_low")), F.when(unsure, 1.0).otherwise(F.col("k_high"))
    return c.select(*keys, F.lit("human_agreement").alias("name"), status.alias("status"), "successes", "trials", "errors", low.alias("low"), high.alias("high"), F.lit(bar).alias("threshold"), F.col("kappa").alias("estimate"))


def families(judgments: DataFrame, looks: int = 1, bars: Mapping[str, float] = BARS, min_trials: int = MIN_TRIALS, keys: Sequence[str] = ("judge_id",)) -> DataFrame:
    """Every family, slice and single check decided on its own: status, low, high, and fail_high at the error budget."""
    return _decided(with_budget(tally(judgments, keys, sizes=True), keys, looks), bars, min_trials)


def _decided(budgeted: DataFrame, bars: Mapping[str, float], min_trials: int) -> DataFrame:
    low, high = clopper_pearson("successes", "trials")
    bar = F.element_at(F.create_map(*(F.lit(x) for pair in bars.items() for x in pair)), F.col("name"))
    rows = budgeted.where("name not in ('human', 'size')").withColumn("threshold", bar)
    rows = rows.withColumns({"low": low, "high": high, "fail_high": clopper_pearson("successes", "trials", "alpha_fail")[1]})
    return rows.withColumn("status", check_status(F.col("low"), F.col("fail_high"), F.col("trials"), F.col("errors"), F.col("threshold"), min_trials))


def _rolled(rows: DataFrame, keys: Sequence[str], bars: Mapping[str, float]) -> DataFrame:
    """One row a check. Families must all pass; slices report the deciding one; checks without a family are UNVALIDATED."""
    item = F.struct("fail_high", "family", "successes", "trials")
    gap = F.col("errors") > 0.1 * (F.col("trials") + F.col("errors"))
    weak = (F.col("trials") == 0) | (F.col("successes") <= F.col("threshold") * F.col("trials"))
    sums = [F.sum(c).alias(c) for c in ("successes", "trials", "errors")]
    per = rows.groupBy(*keys, "name").agg(*sums, F.max("threshold").alias("threshold"), F.count_if(F.col("status") == "FAIL").alias("f"), F.count_if(F.col("status") != "PASS").alias("u"), F.min(item).alias("worst"), F.min(F.when(gap, item)).alias("gap"), F.min(F.when(weak, item)).alias("weak"))
    shown_low = (F.col("worst.trials") > 0) & (F.col("worst.fail_high") < F.col("threshold"))
    slices = F.when(shown_low, "FAIL").when(F.col("gap").isNotNull() | F.col("weak").isNotNull(), "UNVALIDATED").otherwise("PASS")
    shown = F.when(shown_low, F.col("worst")).otherwise(F.coalesce("gap", "weak", "worst"))
    is_slices = F.col("name") == "slices"
    status = F.when(is_slices, slices).when(F.col("f") > 0, "FAIL").when(F.col("u") == 0, "PASS").otherwise("UNVALIDATED")
    per = per.select(*keys, "name", status.alias("status"), *(F.when(is_slices, shown[c]).otherwise(F.col(c)).alias(c) for c in ("successes", "trials")), "errors", "threshold")
    # a judge without controls of a kind has the check all the same
    listed = per.groupBy(*keys).agg(F.collect_list(F.struct("name", "status", "successes", "trials", "errors", "threshold")).alias("found"))
    zero = F.lit(0).cast("long")
    absent = lambda n: F.struct(F.lit(n).alias("name"), F.lit("UNVALIDATED").alias("status"), zero.alias("successes"), zero.alias("trials"), zero.alias("errors"), F.lit(bars[n]).alias("threshold"))
    every = F.array(*map(absent, ("acceptance", "rejection", "invariance")))
    added = F.filter(every, lambda x: ~F.exists("found", lambda y: y["name"] == x["name"]))
    rows = listed.select(*keys, F.explode(F.concat("found", added)).alias("c")).select(*keys, "c.*")
    low, high = clopper_pearson("successes", "trials")
    return rows.withColumns({"low": low, "high": high, "estimate": F.lit(None).cast("double")}).select(*keys, *CHECK)


def checks(judgments: DataFrame, looks: int = 1, bars: Mapping[str, float] = BARS, min_trials: int = MIN_TRIALS, keys: Sequence[str] = ("judge_id",), draws: int = DRAWS) -> DataFrame:
    """All checks of every judge (of every value of keys), one row each; saved judgments are decided again the same way."""
    return _checks(with_budget(tally(judgments, keys, sizes=True), keys, looks), bars, min_trials, keys, draws)


def _checks(budgeted: DataFrame, bars: Mapping[str, float] = BARS, min_trials: int = MIN_TRIALS, keys: Sequence[str] = ("judge_id",), draws: int = DRAWS) -> DataFrame:
    rolled = _rolled(_decided(budgeted, bars, min_trials), keys, bars)
    people = agreement(budgeted.where("name = 'human'"), keys, bars["human_agreement"], min_trials, draws)
    return rolled.unionByName(people)


def verdicts(decided: DataFrame, keys: Sequence[str] = ("judge_id",)) -> DataFrame:
    """(keys, verdict, failed, open) from checks."""
    per = decided.groupBy(*keys).agg(F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "UNVALIDATED").alias("open"))
    return per.withColumn("verdict", F.when(F.col("failed") > 0, "INADMISSIBLE").when(F.col("open") > 0, "UNVALIDATED").otherwise("ADMISSIBLE"))


def sequential(judgments: DataFrame, batch: Column, looks: int, **options) -> DataFrame:
    """Verdicts after every look: (judge_id, look, verdict, failed, open, judgments, stopped).

    batch: the look (from 0) at which a judgment's case is first seen, the same for all of its
    judgments.  A look holds all earlier ones, the error budget is split over the looks, and the
    first look that fails stops the judge; later ones are marked as such and would not be run.
    """
    keys = ("judge_id", "look")
    # a case belongs to one batch, so the counts of a look are the sums of its batches' counts
    batches = tally(judgments.withColumn("batch", batch.cast("int")), ("judge_id", "batch"), sizes=True)
    seen = batches.withColumn("look", F.explode(F.sequence("batch", F.lit(looks - 1))))
    counts = seen.groupBy(*keys, "name", "family").agg(*(F.sum(c).alias(c) for c in TALLY[2:]))
    budgeted = with_budget(counts, keys, looks)
    sizes = budgeted.where("name = 'size'").select(*keys, F.col("errors").alias("judgments"))
    rows = verdicts(_checks(budgeted, keys=keys, **options), keys).join(sizes, list(keys))
    before = Window.partitionBy("judge_id").orderBy("look").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("verdict") == "INADMISSIBLE").cast("int")).over(before)
    return rows.withColumn("stopped", F.coalesce(failed, F.lit(0)) == 1)


def dataset_report(judgments: DataFrame, min_cases: int = MIN_TRIALS, **options) -> DataFrame:
    """(judge_id, verdict, failed, open, cases) of all judges; one with fewer cases than min_cases, or that gave scores and no verdict at all, is SKIPPED."""
    looks = options.pop("looks", 1)
    keys = options.get("keys", ("judge_id",))
    budgeted = with_budget(tally(judgments, keys, sizes=True), keys, looks)
    sizes = budgeted.where("name = 'size'").select("judge_id", F.col("trials").alias("cases"), F.col("successes").alias("judged"))
    rows = verdicts(_checks(budgeted, **options)).join(sizes, "judge_id")
    skipped = (F.col("cases") < min_cases) | (F.col("judged") == 0)
    return rows.select("judge_id", F.when(skipped, "SKIPPED").otherwise(F.col("verdict")).alias("verdict"), "failed", "open", "cases")


def recovery_profile(judgments: DataFrame, repaired: str = "error_then_repaired", unrepaired: str = "error_unrepaired", bars: Mapping[str, float] = BARS, min_trials: int = MIN_TRIALS) -> DataFrame:
    """How a judge treats mistakes: forgives the repaired ones (where it passed the original), catches the others.

    (judge_id, profile, and status, successes, trials, low, high of each); both at the plain 95 % level.
    """
    kind, passed = F.col("kind"), F.col("passed")
    per = judgments.groupBy("judge_id", "case_id").agg(
        F.max(F.when((kind == "reference") & (F.col("repeat") == 0), passed)).alias("first"),
        *(F.count_if((kind == k) & (F.col("family") == f) & test).alias(c) for k, f, c, test in (("must_hold", repaired, "fixed_ok", passed), ("must_hold", repaired, "fixed_bad", ~passed), ("must_hold", repaired, "fixed_errors", passed.isNull()), ("must_fail", unrepaired, "caught", ~passed), ("must_fail", unrepaired, "let_pass", passed), ("must_fail", unrepaired, "caught_errors", passed.isNull()))),
    )
    good = F.coalesce("first", F.lit(False)).cast("int")
    rows = per.groupBy("judge_id").agg(F.sum(F.col("fixed_ok") * good).alias("fk"), F.sum((F.col("fixed_ok") + F.col("fixed_bad")) * good).alias("fn"), F.sum("fixed_errors").alias("fe"), F.sum("caught").alias("ck"), F.sum(F.col("caught") + F.col("let_pass")).alias("cn"), F.sum("caught_errors").alias("ce"))
    made = {}
    for c, bar in (("f", bars["invariance"]), ("c", bars["rejection"])):
        low, high = clopper_pearson(f"{c}k", f"{c}n")
        made |= {f"{c}_low": low, f"{c}_high": high, f"{c}_status": check_status(low, high, F.col(f"{c}n"), F.col(f"{c}e"), F.lit(bar), min_trials)}
    rows = rows.withColumns(made)
    f, c = F.col("f_status"), F.col("c_status")
    profile = F.when((f == "PASS") & (c == "PASS"), "recovery-aware").when((f == "FAIL") & (c == "FAIL"), "backwards").when(f == "FAIL", "unforgiving").when(c == "FAIL", "blind to unrepaired errors").otherwise("inconclusive")
    shown = lambda x, name: (F.col(f"{x}_status").alias(f"{name}_status"), F.col(f"{x}k").alias(f"{name}_successes"), F.col(f"{x}n").alias(f"{name}_trials"), F.col(f"{x}_low").alias(f"{name}_low"), F.col(f"{x}_high").alias(f"{name}_high"))
    return rows.select("judge_id", profile.alias("profile"), *shown("f", "forgives"), *shown("c", "catches"))
