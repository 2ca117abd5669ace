"""Judges of other shapes: comparisons, cited verdicts, abstaining judges and confidence gates, decided.

Each function brings judgments down to one row a check (name, successes, trials, errors, threshold,
alpha_fail) and decides it as certificates are: PASS on the exact 95 % lower bound, FAIL on an exact
upper bound whose error budget all checks that can fail share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.rng import u01
from gavelframe.functions.stats import check_status, clopper_pearson

MIN_TRIALS = 10
PAIR_BARS = {"accuracy": 0.8, "order_consistency": 0.9}
CITATION_BARS = {"acceptance": 0.7, "rejection": 0.8, "citation_validity": 0.9, "citation_support": 0.8}
ABSTAIN_BARS = {"coverage": 0.8, "decided_accuracy": 0.8, "abstention_recall": 0.8, "abstention_precision": 0.8}


def check(name: str, successes: Column, trials: Column, errors: Column, threshold: float, alpha_fail: Column | float) -> Column:
    """struct of a check's counts, for decide()."""
    alpha = alpha_fail if isinstance(alpha_fail, Column) else F.lit(alpha_fail)
    whole = {"successes": successes, "trials": trials, "errors": errors}
    return F.struct(F.lit(name).alias("name"), *(c.cast("long").alias(n) for n, c in whole.items()), F.lit(threshold).alias("threshold"), alpha.cast("double").alias("alpha_fail"))


def decide(per: DataFrame, checks: Sequence[Column], keys: Sequence[str] = (), min_trials: int = MIN_TRIALS) -> DataFrame:
    """One row a check of every row of per: (keys, name, status, successes, trials, errors, low, high, threshold). Null checks are left out."""
    rows = per.select(*keys, F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select(*keys, "c.*")
    low, high = clopper_pearson("successes", "trials")
    rows = rows.withColumns({"low": low, "high": high, "fail_high": clopper_pearson("successes", "trials", "alpha_fail")[1]})
    status = check_status(F.col("low"), F.col("fail_high"), F.col("trials"), F.col("errors"), F.col("threshold"), min_trials)
    return rows.select(*keys, "name", status.alias("status"), "successes", "trials", "errors", "low", "high", "threshold")


# -- comparisons ----------------------------------------------------------------------------
def presentations(pairs: DataFrame, repeats: int = 1) -> DataFrame:
    """Every pair both ways round: pairs with better_first, repeat, first and second answer."""
    rows = pairs.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("better_first"), F.lit(0).alias("_z"))
    rows = rows.select("*", F.explode(F.sequence(F.col("_z"), F.lit(repeats - 1))).alias("repeat")).drop("_z")
    first = F.when(F.col("better_first"), F.col("better")).otherwise(F.col("worse"))
    second = F.when(F.col("better_first"), F.col("worse")).otherwise(F.col("better"))
    return rows.select("*", first.alias("first"), second.alias("second"))


def certify_pairs(presented: DataFrame, keys: Sequence[str] = (), bars: Mapping[str, float] = PAIR_BARS, min_trials: int = MIN_TRIALS) -> DataFrame:
    """accuracy (one presentation a pair, better first in every second pair) and order_consistency.

    presented: keys, pair_no, case_id, better_first, repeat, passed (picked the better; null: error).
    """
    first = presented.where("repeat = 0")
    counted = F.col("better_first") == (F.col("pair_no") % 2 == 0)
    side = lambda test, name: F.max(F.when(test, F.col("passed"))).alias(name)
    per = first.groupBy(*keys, "case_id").agg(side(counted, "one"), side(F.col("better_first"), "a"), side(~F.col("better_first"), "b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    sums = per.groupBy(*keys).agg(
        F.count_if("one").alias("right"), F.count("one").alias("judged"), F.count("*").alias("pairs"),
        F.count_if(both & (F.col("a") == F.col("b"))).alias("same"), F.count_if(both).alias("complete"),
    )
    alpha = 0.05 / 2
    made = [
        check("accuracy", F.col("right"), F.col("judged"), F.col("pairs") - F.col("judged"), bars["accuracy"], alpha),
        check("order_consistency", F.col("same"), F.col("complete"), F.col("pairs") - F.col("complete"), bars["order_consistency"], alpha),
    ]
    return decide(sums, made, keys, min_trials)


def flips(presented: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, flipped, flipped_to_first): pairs whose pick changed with the order, and those that went with the answer shown first."""
    side = lambda test, name: F.max(F.when(test, F.col("passed"))).alias(name)
    per = presented.where("repeat = 0").groupBy(*keys, "case_id").agg(side(F.col("better_first"), "a"), side(~F.col("better_first"), "b"))
    return per.groupBy(*keys).agg(F.count_if(F.col("a") != F.col("b")).alias("flipped"), F.count_if(F.col("a") & ~F.col("b")).alias("flipped_to_first"))


def first_position(presented: DataFrame, keys: Sequence[str] = (), draws: int = 2000) -> DataFrame:
    """(keys, rate, low, high, presentations): how often the first answer was picked; the interval resamples pairs."""
    took = (F.col("better_first") == F.col("passed")).cast("int")
    per = presented.where("passed is not null").groupBy(*keys, "case_id").agg(F.sum(took).alias("k"), F.count("*").alias("m"))
    kinds = per.groupBy(*keys, "k", "m").agg(F.count("*").alias("n")).withColumn("kind", F.concat_ws("/", "k", "m"))
    drawn = resample.weights(kinds, "kind", "n", draws, "first")
    rate = lambda w: F.sum(F.col("k") * w) / F.nullif(F.sum(F.col("m") * w), F.lit(0))
    values = resample.sorted_values(drawn.groupBy(*keys, "draw").agg(rate(F.col("w")).alias("r")), keys, F.col("r"))
    total = kinds.groupBy(*keys).agg(rate(F.col("n")).alias("rate"), F.sum(F.col("m") * F.col("n")).alias("presentations"))
    low, high = resample.percentile("values", 0.05)
    joined = total.join(values, list(keys)) if keys else total.crossJoin(values)  # one row each
    return joined.select(*keys, "rate", low.alias("low"), high.alias("high"), "presentations")


# -- cited verdicts -------------------------------------------------------------------------
def citation_facts(rows: DataFrame, facts: Column | None = None) -> DataFrame:
    """rows with unknown, valid and supported, from cited (array of ids) and items (map of id to the item's text).

    valid: something is cited and all of it is there.  supported: every one of the facts (an array)
    stands in a cited item that is there; null without facts to look for.
    """
    real = F.array_distinct(F.array_intersect("cited", F.map_keys("items")))
    text = F.transform(real, lambda i: F.element_at("items", i))
    unknown = F.array_distinct(F.array_except("cited", F.map_keys("items")))
    out = rows.withColumn("unknown", unknown).withColumn("valid", (F.size("cited") > 0) & (F.size("unknown") == 0))
    if facts is None:
        return out.withColumn("supported", F.lit(None).cast("boolean"))
    held = F.forall(facts, lambda f: F.exists(text, lambda t: t.contains(f)))
    return out.withColumn("supported", (F.size(facts) > 0) & held)


def certify_citations(checked: DataFrame, keys: Sequence[str] = (), bars: Mapping[str, float] = CITATION_BARS, min_trials: int = MIN_TRIALS) -> DataFrame:
    """acceptance, rejection (if there are must_fail rows), citation_validity and citation_support.

    checked: keys, role (good or must_fail), passed (null: error), valid, supported.
    """
    good, bad, done = F.col("role") == "good", F.col("role") == "must_fail", F.col("passed").isNotNull()
    sums = checked.groupBy(*keys).agg(
        F.count_if(good & F.col("passed")).alias("accepted"), F.count_if(good & done).alias("good"), F.count_if(good & ~done).alias("good_errors"),
        F.count_if(bad & ~F.col("passed")).alias("rejected"), F.count_if(bad & done).alias("bad"), F.count_if(bad & ~done).alias("bad_errors"),
        F.count_if(done & F.col("valid")).alias("valid"), F.count_if(done & F.col("supported")).alias("supported"),
        F.count_if(done).alias("done"), F.count_if(~done).alias("errors"),
    )
    some_bad = F.col("bad") + F.col("bad_errors") > 0
    alpha = 0.05 / (3 + some_bad.cast("int"))
    c = F.col
    made = [
        check("acceptance", c("accepted"), c("good"), c("good_errors"), bars["acceptance"], alpha),
        F.when(some_bad, check("rejection", c("rejected"), c("bad"), c("bad_errors"), bars["rejection"], alpha)),
        check("citation_validity", c("valid"), c("done"), c("errors"), bars["citation_validity"], alpha),
        check("citation_support", c("supported"), c("done"), c("errors"), bars["citation_support"], alpha),
    ]
    return decide(sums, made, keys, min_trials)


# -- judges that may abstain ----------------------------------------------------------------
def certify_abstention(rows: DataFrame, keys: Sequence[str] = (), expected_reason: str | None = None, bars: Mapping[str, float] = ABSTAIN_BARS, min_trials: int = MIN_TRIALS) -> DataFrame:
    """coverage and decided_accuracy on answerable rows; recall and precision of abstaining where there are rows that call for it.

    rows: keys, role (good, must_fail, must_abstain), decision (pass, fail, abstain; null: error), reason.
    """
    role, d = F.col("role"), F.col("decision")
    must, out, done = role == "must_abstain", d == "abstain", d.isNotNull()
    right = ((role == "good") & (d == "pass")) | ((role == "must_fail") & (d == "fail"))
    meant = out if expected_reason is None else out & (F.col("reason") == expected_reason)
    sums = rows.groupBy(*keys).agg(
        F.count_if(~must & done & ~out).alias("decided"), F.count_if(~must & done).alias("answerable"), F.count_if(~must & ~done).alias("errors"), F.count_if(right).alias("right"),
        F.count_if(must & meant).alias("hit"), F.count_if(must & done).alias("missing"), F.count_if(must & ~done).alias("missing_errors"),
        F.count_if(must & out).alias("well_abstained"), F.count_if(out).alias("abstained"),
    )
    some = F.col("missing") + F.col("missing_errors") > 0
    alpha = 0.05 / F.when(some, 4).otherwise(2)
    c, none = F.col, F.lit(0)
    made = [
        check("coverage", c("decided"), c("answerable"), c("errors"), bars["coverage"], alpha),
        check("decided_accuracy", c("right"), c("decided"), c("errors"), bars["decided_accuracy"], alpha),
        F.when(some, check("abstention_recall", c("hit"), c("missing"), c("missing_errors"), bars["abstention_recall"], alpha)),
        F.when(some, check("abstention_precision", c("well_abstained"), c("abstained"), none, bars["abstention_precision"], alpha)),
    ]
    return decide(sums, made, keys, min_trials)


# -- confidence gates -----------------------------------------------------------------------
def from_confidence(threshold: float, cutoff: float = 0.5) -> tuple[float, float]:
    """(low, high) of the gate that decides where the distance from the cutoff, scaled to 1 on either side, reaches a threshold."""
    if not 0 <= threshold <= 1 or not 0 < cutoff < 1:
        raise ValueError("threshold must be in [0, 1] and cutoff in (0, 1)")
    return round(cutoff - threshold * cutoff, 12), round(cutoff + threshold * (1 - cutoff), 12)


def grid(step: float = 0.05, top: float = 0.95, cutoff: float = 0.5) -> list[tuple[float, float]]:
    """The gates of confidence 0, step, ... up to top."""
    return [from_confidence(round(i * step, 10), cutoff) for i in range(round(top / step) + 1)]


def first_records(cases: DataFrame) -> DataFrame:
    """The first record of every case (by record_no); contradictory labels or groups of a case raise.

    cases: case_id, record_no, probability, label, fallback (may be null), group_id (null: the case itself).
    """
    first = F.min_by(F.struct("probability", "label", "fallback", "group_id"), "record_no")
    per = cases.groupBy("case_id").agg(first.alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_distinct(F.coalesce(F.col("group_id").cast("string"), F.lit(""))).alias("groups"))
    bad = (F.col("lo") != F.col("hi")) | (F.col("groups") > 1) | F.isnan("r.probability") | (F.abs("r.probability") == float("inf"))
    message = F.concat(F.lit("contradictory records of case "), F.col("case_id").cast("string"))
    checked = F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("r.probability"))
    return per.select("case_id", checked.alias("probability"), "r.label", "r.fallback", F.coalesce(F.col("r.group_id").cast("string"), F.concat(F.lit("case "), F.col("case_id").cast("string"))).alias("unit"))


def gate_units(first: DataFrame, gates: Sequence[tuple[float, float]], by_case: bool = False) -> DataFrame:
    """(low, high) and, over units (groups, or cases): units, decided, correct, full, end_correct, and over outputs: outputs, made, false_passes, false_fails, no_fallback, passes, fails.

    A unit is correct if all its decided outputs are right, full if none is deferred; end_correct
    counts units that are right once deferred outputs take their fallback.
    """
    each = F.explode(F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in gates)))
    rows = first.withColumn("g", each).select("*", "g.low", "g.high").drop("g")
    if by_case:
        rows = rows.withColumn("unit", F.concat(F.lit("case "), F.col("case_id").cast("string")))
    p, label = F.col("probability"), F.col("label")
    d = F.when(p >= F.col("high"), True).when(p <= F.col("low"), False)
    final = F.coalesce(d, F.col("fallback"))
    per = rows.groupBy("low", "high", "unit").agg(
        F.count(d).alias("made"), F.count("*").alias("n"), F.count_if(d == label).alias("right"), F.count_if(d & ~label).alias("fp"), F.count_if(~d & label).alias("ff"),
        F.count_if(d.isNull() & F.col("fallback").isNull()).alias("gap"), F.count_if(final == label).alias("end"), F.count_if(label).alias("pos"),
    )
    return per.groupBy("low", "high").agg(
        F.count("*").alias("units"), F.count_if(F.col("made") > 0).alias("decided"),
        F.count_if((F.col("made") > 0) & (F.col("made") == F.col("right"))).alias("correct"), F.count_if(F.col("made") == F.col("n")).alias("full"),
        F.count_if(F.col("end") == F.col("n")).alias("end_correct"), F.sum("n").alias("outputs"), F.sum("made").alias("made"), F.sum("fp").alias("false_passes"), F.sum("ff").alias("false_fails"),
        F.sum("gap").alias("no_fallback"), F.sum("pos").alias("passes"), F.sum(F.col("n") - F.col("pos")).alias("fails"),
    )


def certify_gates(first: DataFrame, gates: Sequence[tuple[float, float]], min_accuracy: float = 0.9, min_coverage: float = 0.0, min_end_to_end: float | None = None, min_trials: int = MIN_TRIALS, by_case: bool = False) -> DataFrame:
    """Every gate's checks: (low, high, name, status, successes, trials, ...) of auto_accuracy, coverage and, if asked for, end_to_end."""
    per = gate_units(first, gates, by_case).withColumnsRenamed({"low": "gate_low", "high": "gate_high"})
    alpha = 0.05 / (1 + (min_coverage > 0) + (min_end_to_end is not None))
    none = F.lit(0)
    made = [
        check("auto_accuracy", F.col("correct"), F.col("decided"), none, min_accuracy, alpha),
        check("coverage", F.col("full"), F.col("units"), none, min_coverage, alpha),
    ]
    if min_end_to_end is not None:
        known = F.col("no_fallback") == 0
        made.append(check("end_to_end", F.when(known, F.col("end_correct")).otherwise(0), F.when(known, F.col("units")).otherwise(0), none, min_end_to_end, alpha))
    return decide(per, made, ("gate_low", "gate_high"), min_trials)


def gate_status(first: DataFrame, gates: Sequence[tuple[float, float]], min_coverage: float = 0.0, chosen_on: DataFrame | None = None, **options) -> DataFrame:
    """(gate_low, gate_high, status, reason): FAIL if a deciding check fails; PASS if all pass, on cases the gate was not chosen on and with labels of both kinds."""
    checks = certify_gates(first, gates, min_coverage=min_coverage, **options)
    deciding = checks.where("name <> 'coverage'") if not min_coverage else checks
    per = deciding.groupBy("gate_low", "gate_high").agg(F.count_if(F.col("status") == "FAIL").alias("f"), F.count_if(F.col("status") != "PASS").alias("u"))
    one = first.agg((F.count_distinct("label") < 2).alias("one_class"))
    per = per.crossJoin(one)  # one row
    if chosen_on is None:
        per = per.withColumn("overlap", F.lit(0).cast("long"))
    else:
        units = first.join(chosen_on.select("case_id"), "case_id", "left_semi").select("unit").distinct()
        per = per.crossJoin(first.join(units, "unit", "left_semi").agg(F.count("*").alias("overlap")))
    status = F.when(F.col("f") > 0, "FAIL").when(F.col("u") > 0, "UNVALIDATED").when((F.col("overlap") > 0) | F.col("one_class"), "UNVALIDATED").otherwise("PASS")
    reason = F.when(F.col("f") > 0, "shown below the bar").when(F.col("u") > 0, "not enough evidence").when(F.col("overlap") > 0, "chosen on the same cases").when(F.col("one_class"), "every label is the same").otherwise("every check clears its bar")
    return per.select("gate_low", "gate_high", status.alias("status"), reason.alias("reason"))


def choose_gate(first: DataFrame, gates: Sequence[tuple[float, float]], min_accuracy: float = 0.9, min_trials: int = MIN_TRIALS, estimate: bool = False, by_case: bool = False) -> DataFrame:
    """At most one row: the gate that decides the most units while its accuracy meets the bar by its exact lower bound (or, with estimate, by itself).

    Ties go to the higher accuracy, then the narrower band.
    """
    per = gate_units(first, gates, by_case)
    per = per.withColumn("bound", F.col("correct") / F.col("decided") if estimate else clopper_pearson("correct", "decided")[0])
    ok = per.where((F.col("decided") >= min_trials) & (F.col("bound") >= min_accuracy))
    return ok.orderBy(F.desc("decided"), F.desc(F.col("correct") / F.col("decided")), F.col("high") - F.col("low")).limit(1).select("low", "high", "decided", "correct", "bound")


def split_cases(first: DataFrame, share: float = 0.5, seed: str = "split") -> DataFrame:
    """first with selected: a share of the units, drawn within units of the same kinds of labels, so both halves see both classes."""
    units = first.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_set(F.col("label").cast("string"))), ",").alias("kind"))
    w = Window.partitionBy("kind")
    ranked = units.withColumn("_rn", F.row_number().over(w.orderBy(u01(seed, F.col("unit")), "unit"))).withColumn("_n", F.count("*").over(w))
    return first.join(ranked.select("unit", (F.col("_rn") <= F.bround(F.col("_n") * share)).alias("selected")), "unit")


def calibrate_by_split(first: DataFrame, gates: Sequence[tuple[float, float]], min_accuracy: float = 0.9, share: float = 0.5, seed: str = "split", **options) -> DataFrame:
    """The gate chosen on one half of the units and its status on the other: (gate_low, gate_high, status, reason), no row if none qualifies."""
    both = split_cases(first, share, seed)
    chosen = choose_gate(both.where("selected").drop("selected"), gates, min_accuracy)
    picked = chosen.first()
    if picked is None:
        return gate_status(first, gates[:1]).limit(0)
    return gate_status(both.where("not selected").drop("selected"), [(picked["low"], picked["high"])], min_accuracy=min_accuracy, **options)


def fixed_sequence(first: DataFrame, gates: Sequence[tuple[float, float]], min_accuracy: float = 0.9, min_trials: int = MIN_TRIALS, by_case: bool = False) -> DataFrame:
    """Gates in the order of what they decide, each tested until one fails: (low, high, decided, correct, bound, accepted).

    Gates that decide too few to pass even if all were right are skipped: that depends on the
    probabilities only.  The last accepted row is the choice.
    """
    per = gate_units(first, gates, by_case)
    per = per.withColumn("bound", clopper_pearson("correct", "decided")[0]).withColumn("best", clopper_pearson("decided", "decided")[0])
    tested = per.where((F.col("decided") >= min_trials) & (F.col("best") >= min_accuracy))
    order = Window.orderBy("made", F.desc(F.col("high") - F.col("low"))).rowsBetween(Window.unboundedPreceding, 0)  # one row a gate
    return tested.select("low", "high", "decided", "correct", "bound", (F.min((F.col("bound") >= min_accuracy).cast("int")).over(order) == 1).alias("accepted"))


def record_stability(cases: DataFrame, low: float, high: float) -> DataFrame:
    """(repeated, stable): cases with several records, and those whose records all get one decision."""
    p = F.col("probability")
    d = F.when(p >= high, "pass").when(p <= low, "fail").otherwise("defer")
    per = cases.groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct(d).alias("kinds")).where("n > 1")
    return per.agg(F.count("*").alias("repeated"), F.count_if(F.col("kinds") == 1).alias("stable"))
