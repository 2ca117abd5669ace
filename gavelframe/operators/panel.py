"""Several judges: juries, routing, confidence gates, pairwise order checks and disagreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.stats import clopper_pearson, kappa, wilson
from gavelframe.operators import gate
from gavelframe.operators.certify import truth_of

SLOT = ["case_id", "kind", "family", "repeat", "occurrence"]


def _count(votes: Column, value: bool) -> Column:
    return F.size(F.filter(votes, lambda v: v if value else ~v))


def jury_verdict(votes: Column, rule: str, quorum: int, tie: str = "fail") -> Column:
    """The verdict of an array of votes (null: no verdict). Any fail first, then the quorum, then the rule, then the tie."""
    passes, fails = _count(votes, True), _count(votes, False)
    cast = passes + fails
    tied = {"fail": F.lit(False), "pass": F.lit(True), "abstain": F.lit(None).cast("boolean")}[tie]
    out = F.when(F.lit(rule in ("any_fail", "unanimous_pass")) & (fails > 0), False).when(cast < quorum, F.lit(None).cast("boolean"))
    if rule == "any_fail":
        return out.otherwise(True)
    if rule == "unanimous_pass":
        return out.when(cast == F.size(votes), True)
    return out.when(passes != fails, passes > fails).otherwise(tied)


def vote_code(votes: Column) -> Column:
    """P, F or ? a member."""
    return F.array_join(F.transform(votes, lambda v: F.when(v.isNull(), "?").when(v, "P").otherwise("F")), "")


def unanimous(votes: Column) -> Column:
    """The common vote of an array without nulls; null if the members differ or one has none."""
    first = F.get(votes, F.lit(0))
    return F.when(F.forall(votes, lambda v: F.coalesce(v == first, F.lit(False))), first)


# -- juries over judged plans ---------------------------------------------------------------
def with_occurrence(judgments: DataFrame) -> DataFrame:
    """judgments with occurrence: the how-manieth identical (case, role, output) of its judge, from 0, in the order of plan_no (or of the rows' own keys)."""
    keys = [c for c in ("judge_id", "case_id", "kind", "family", "repeat", "output") if c in judgments.columns]
    order = F.col("plan_no") if "plan_no" in judgments.columns else F.lit(0)
    return judgments.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def ballots(judgments: DataFrame, members: Sequence[str], strict: bool = True) -> DataFrame:
    """One row a slot of the plan (case, kind, family, repeat, occurrence): slice, truth and votes in the order of members.

    Members must have judged the same plan: a slot that one of them lacks, or has twice, raises
    unless strict is off, which leaves such slots out.
    """
    rows = judgments.where(F.col("judge_id").isin(*members))
    if "occurrence" not in rows.columns:
        rows = with_occurrence(rows)
    n = len(members)
    per = rows.groupBy(*SLOT).agg(F.min("slice").alias("slice"), F.map_from_entries(F.collect_list(F.struct("judge_id", "passed"))).alias("by"), F.count("*").alias("n"))
    whole = (F.col("n") == n) & (F.size("by") == n)
    if strict:
        message = F.concat(F.lit("members judged different plans: case "), F.col("case_id").cast("string"), F.lit(" "), F.col("kind"), F.lit(" "), F.col("family"))
        per = per.withColumn("by", F.when(whole, F.col("by")).otherwise(F.raise_error(message).cast("map<string,boolean>")))
    else:
        per = per.where(whole)
    votes = F.array(*(F.element_at("by", F.lit(m)) for m in members))
    return per.select(*SLOT, "slice", truth_of(F.col("kind"), F.col("family"), F.col("repeat")).alias("truth"), votes.alias("votes"))


def jury_judgments(slots: DataFrame, judge_id: str, rule: str, quorum: int, tie: str = "fail") -> DataFrame:
    """The jury's judgments on the plan its members judged, for certify.checks(): no judge is called again."""
    verdict = jury_verdict(F.col("votes"), rule, quorum, tie)
    return slots.select(F.lit(judge_id).alias("judge_id"), "case_id", "slice", "kind", "family", "repeat", verdict.alias("passed"), F.concat(F.lit(f"{rule}: "), vote_code(F.col("votes"))).alias("reason"))


def _long(slots: DataFrame, members: Sequence[str], jury: Column | None = None) -> DataFrame:
    """(case_id, truth, member, passed) of slots whose truth is known, the jury as a member of its own."""
    votes = [F.struct(F.lit(m).alias("member"), F.get("votes", F.lit(i)).alias("passed")) for i, m in enumerate(members)]
    if jury is not None:
        votes.append(F.struct(F.lit("jury").alias("member"), jury.alias("passed")))
    return slots.where("truth is not null").select("case_id", "truth", F.explode(F.array(*votes)).alias("v")).select("case_id", "truth", "v.*")


def accuracy(verdicts: DataFrame, keys: Sequence[str] = ("member",), draws: int = 2000, min_cases: int = 10) -> DataFrame:
    """Right of judged by case: (keys, correct, judged, rate, low, high, method, cases, cases_all_right, cases_low, cases_high).

    verdicts: keys, case_id, truth, passed.  The interval resamples cases; with fewer than min_cases
    of them, or one rate for all, it is exact with the case as the trial, rounded outward.
    """
    per = verdicts.where("passed is not null").groupBy(*keys, "case_id").agg(F.count_if(F.col("passed") == F.col("truth")).alias("r"), F.count("*").alias("k"))
    kinds = per.groupBy(*keys, "r", "k").agg(F.count("*").alias("n")).withColumn("kind", F.concat_ws("/", "r", "k"))
    total = kinds.groupBy(*keys).agg(
        F.sum(F.col("r") * F.col("n")).alias("correct"), F.sum(F.col("k") * F.col("n")).alias("judged"), F.sum("n").alias("cases"),
        F.sum(F.when(F.col("r") == F.col("k"), F.col("n")).otherwise(0)).alias("cases_all_right"), F.count_distinct(F.round(F.col("r") / F.col("k"), 12)).alias("rates"),
    )
    drawn = resample.weights(kinds, "kind", "n", draws, "accuracy").groupBy(*keys, "draw").agg((F.sum(F.col("r") * F.col("w")) / F.nullif(F.sum(F.col("k") * F.col("w")), F.lit(0))).alias("rate"))
    rows = total.join(resample.sorted_values(drawn, keys, F.col("rate")), list(keys)).withColumn("rate", F.col("correct") / F.col("judged"))
    rows = rows.withColumns({"down": F.floor(F.col("rate") * F.col("cases") + 1e-9), "up": F.ceil(F.col("rate") * F.col("cases") - 1e-9)})
    low, high = resample.percentile("values", 0.05)
    exact = (F.col("cases") < min_cases) | (F.col("rates") <= 1) | (low == high)
    exact_low, exact_high = clopper_pearson("down", "cases")[0], clopper_pearson("up", "cases")[1]
    cases_low, cases_high = wilson("cases_all_right", "cases")
    return rows.select(*keys, "correct", "judged", "rate", F.when(exact, exact_low).otherwise(low).alias("low"), F.when(exact, exact_high).otherwise(high).alias("high"), F.when(exact, "exact").otherwise("bootstrap").alias("method"), "cases", "cases_all_right", cases_low.alias("cases_low"), cases_high.alias("cases_high"))


def member_effects(slots: DataFrame, members: Sequence[str], jury: Column) -> DataFrame:
    """(member, fixed, inherited, introduced): what the vote did to each member's verdicts, where both have one."""
    verdict = slots.where("truth is not null").withColumn("_jury", jury)
    votes = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.get("votes", F.lit(i)).alias("mine")) for i, m in enumerate(members))))
    rows = verdict.select("truth", "_jury", votes.alias("v")).where("v.mine is not null and _jury is not null").select("truth", "_jury", "v.*")
    wrong, jury_wrong = F.col("mine") != F.col("truth"), F.col("_jury") != F.col("truth")
    return rows.groupBy("member").agg(F.count_if(wrong & ~jury_wrong).alias("fixed"), F.count_if(wrong & jury_wrong).alias("inherited"), F.count_if(~wrong & jury_wrong).alias("introduced"))


def member_pairs(slots: DataFrame, members: Sequence[str]) -> DataFrame:
    """(first, second, n, agree, kappa) of every pair of members, on the slots both decided."""
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.get("votes", F.lit(i)).alias("x"), F.get("votes", F.lit(j)).alias("y")) for i, a in enumerate(members) for j, b in enumerate(members) if i < j]
    rows = slots.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null")
    cells = rows.groupBy("first", "second").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agree"), *(F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(c) for x, y, c in ((True, True, "tt"), (True, False, "tf"), (False, True, "ft"), (False, False, "ff"))))
    return cells.select("first", "second", "n", "agree", kappa("tt", "tf", "ft", "ff").alias("kappa"))


def shared_errors(slots: DataFrame, jury: Column) -> DataFrame:
    """The slots on which more than one member is wrong, with the votes as a code."""
    wrong = F.size(F.filter("votes", lambda v: F.coalesce(v != F.col("truth"), F.lit(False))))
    rows = slots.where("truth is not null").withColumns({"wrong": wrong, "jury": jury, "code": vote_code(F.col("votes"))})
    return rows.where("wrong > 1").select(*SLOT, "truth", "code", "wrong", "jury")


def jury_against(slots: DataFrame, members: Sequence[str], jury: Column, level: float = gate.LEVEL, draws: int = gate.DRAWS) -> DataFrame:
    """The jury against each member, paired by case on the slots both decided: a gate at the level split over the members."""
    verdict = slots.where("truth is not null").withColumn("_jury", jury)
    votes = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.get("votes", F.lit(i)).alias("mine")) for i, m in enumerate(members))))
    rows = verdict.select("case_id", "truth", "_jury", votes.alias("v")).where("v.mine is not null and _jury is not null")
    right = lambda c: (F.col(c) == F.col("truth")).cast("int")
    per = rows.groupBy("v.member", "case_id").agg((F.avg(right("_jury")) - F.avg(right("v.mine"))).alias("gain"))
    return gate.decide_repeated(per, ["member"], level, candidates=len(members), draws=draws)


# -- routing --------------------------------------------------------------------------------
def routed(cheap: DataFrame, expensive: DataFrame, truth: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """One row a judgment with known truth and cheap samples: samples (the first k), expensive verdict, truth, agreed.

    cheap: keys, sample_no, passed; expensive: keys, passed; truth: keys, truth.  A judgment with
    fewer than k samples raises.
    """
    samples = cheap.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_no", "passed"))), lambda s: s["passed"]).alias("samples"))
    rows = samples.join(truth.select(*keys, "truth").where("truth is not null"), list(keys)).join(expensive.select(*keys, F.col("passed").alias("expensive"), F.lit(True).alias("asked")), list(keys), "left")
    short = F.raise_error(F.lit(f"every judgment needs at least {k} cheap samples")).cast("array<boolean>")
    first = F.when(F.size("samples") >= k, F.slice("samples", 1, k)).otherwise(short)
    return rows.withColumn("samples", first).withColumn("agreed", unanimous(F.col("samples")))


def routing_summary(rows: DataFrame, keys: Sequence[str] = (), cheap_cost: float = 1.0, expensive_cost: float = 1.0) -> DataFrame:
    """Counts of what routing did to routed() rows, Wilson intervals of its accuracy, and its cost against the expensive judge alone."""
    up, t, one = F.col("agreed").isNull(), F.col("truth"), F.get("samples", F.lit(0))
    final = F.coalesce("agreed", "expensive")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(up).alias("escalated"), F.count_if(final == t).alias("routed_right"), F.count_if(one == t).alias("alone_right"),
        F.count_if(F.col("expensive") == t).alias("expensive_right"), F.count("asked").alias("expensive_trials"),
        F.count_if(F.forall("samples", lambda s: F.coalesce(s != t, F.lit(False)))).alias("confident_wrong"),
        F.count_if(up & ~one.eqNullSafe(t)).alias("caught"), F.count_if(up & F.col("expensive").isNull()).alias("unresolved"), F.max(F.size("samples")).alias("k"),
    )
    low, high = wilson("routed_right", "total")
    cost = (F.col("total") * F.col("k") * cheap_cost + F.col("escalated") * expensive_cost) / (F.col("total") * expensive_cost)
    return counts.withColumns({"low": low, "high": high, "relative_cost": cost})


def routed_judgments(slots: DataFrame, expensive: str, members: Sequence[str], judge_id: str = "routed") -> DataFrame:
    """Judgments of the policy as deployed, for certify.checks(): the common verdict of the cheap members, else the expensive one's.

    slots: ballots() over members and the expensive judge, which stands last.
    """
    cheap, last = F.slice("votes", 1, len(members)), F.element_at("votes", -1)
    agreed = unanimous(cheap)
    how = F.concat(F.when(agreed.isNull(), "escalated ").otherwise("agreed "), vote_code(cheap))
    return slots.select(F.lit(judge_id).alias("judge_id"), "case_id", "slice", "kind", "family", "repeat", F.coalesce(agreed, last).alias("passed"), how.alias("reason"))


def hybrid_pairs(code: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n, agree, low, high, disagree) of two judges' verdicts on the same judgments; errors are left out, of repeated ones the last counts.

    code, model: keys, plan_no, passed.
    """
    last = lambda df: df.where("passed is not null").groupBy(*keys).agg(F.max_by("passed", "plan_no").alias("passed"))
    both = last(code).withColumnRenamed("passed", "a").join(last(model).withColumnRenamed("passed", "b"), list(keys))
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"))
    low, high = wilson("agree", "n")
    return counts.withColumns({"low": low, "high": high, "disagree": F.col("n") - F.col("agree")})


def hybrid_verdict(clauses: Column, model: Column) -> Column:
    """A verdict from code clauses (array of booleans, null: not decidable by code) and a model asked only where code does not fail.

    Any failed clause fails; with all of them decided and passed, or none left for the model, code decides.
    """
    failed = F.exists(clauses, lambda c: F.coalesce(~c, F.lit(False)))
    unsure = F.exists(clauses, lambda c: c.isNull())
    return F.when(failed, False).when(~unsure, True).otherwise(model)


def gate_decide(p: Column, low: Column, high: Column) -> Column:
    """pass at high or above (tested first), fail at low or below, else defer."""
    return F.when(p >= high, "pass").when(p <= low, "fail").otherwise("defer")


def gate_tally(cases: DataFrame, keys: list[str], decision: Column, label: Column) -> DataFrame:
    """decided, deferred, correct, false passes and false fails by keys."""
    d = cases.withColumn("_d", decision).withColumn("_l", label)
    made = F.col("_d") != "defer"
    right = (F.col("_d") == "pass") == F.col("_l")
    return d.groupBy(*keys).agg(F.count_if(made).alias("decided"), F.count_if(~made).alias("deferred"), F.count_if(made & right).alias("correct"), F.count_if((F.col("_d") == "pass") & ~F.col("_l")).alias("false_passes"), F.count_if((F.col("_d") == "fail") & F.col("_l")).alias("false_fails"))


def unit_tally(cases: DataFrame, keys: list[str], unit: str, decision: Column, label: Column) -> DataFrame:
    """Units with a decided output, with all decided outputs right, and decided entirely."""
    d = cases.withColumn("_d", decision).withColumn("_l", label)
    made = F.col("_d") != "defer"
    right = (F.col("_d") == "pass") == F.col("_l")
    per = d.groupBy(*keys, unit).agg(F.count_if(made).alias("made"), F.count_if(made & right).alias("right"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.count_if(F.col("made") > 0).alias("units_decided"), F.count_if((F.col("made") > 0) & (F.col("made") == F.col("right"))).alias("units_correct"), F.count_if(F.col("made") == F.col("n")).alias("units_full"))


def contested(ratings: DataFrame) -> DataFrame:
    """Per item: votes, passes, split (each rater one vote, a tie half), instability, between, within, and the minority raters.

    ratings: item, rater, passed (null: errored).
    """
    per = ratings.where("passed is not null").groupBy("item", "rater").agg(F.count_if("passed").alias("p"), F.count("*").alias("n"))
    vote = F.when(2 * F.col("p") > F.col("n"), 1.0).when(2 * F.col("p") == F.col("n"), 0.5).otherwise(0.0)
    mixed = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    rows = per.withColumn("vote", vote).withColumn("mixed", mixed)
    out = rows.groupBy("item").agg(F.sum("n").alias("votes"), F.sum("p").alias("passes"), F.avg("vote").alias("share"), F.avg(F.col("mixed").cast("int")).alias("instability"), F.count_if(F.col("vote") == 1.0).alias("yes"), F.count_if(F.col("vote") == 0.0).alias("no"), F.sort_array(F.collect_list(F.struct("rater", "vote"))).alias("by_rater"))
    odd = F.when(F.col("yes") < F.col("no"), 1.0).when(F.col("no") < F.col("yes"), 0.0)
    out = out.withColumn("minority", F.transform(F.filter("by_rater", lambda r: r["vote"] == odd), lambda r: r["rater"]))
    return out.select("item", "votes", "passes", (2 * F.least(F.col("share"), 1 - F.col("share"))).alias("split"), "instability", ((F.col("yes") > 0) & (F.col("no") > 0)).alias("between"), (F.col("instability") > 0).alias("within"), F.when((F.col("yes") != F.col("no")), F.col("minority")).otherwise(F.array().cast("array<string>")).alias("minority"))


def ranked_contested(items: DataFrame) -> DataFrame:
    """contested() rows with rank: split, then instability, then votes, largest first, then item. The rank orders items by sampled ranges, not in one task."""
    return items.where((F.col("split") > 0) | (F.col("instability") > 0)).orderBy(F.desc("split"), F.desc("instability"), F.desc("votes"), "item")


def outliers(ratings: DataFrame) -> DataFrame:
    """(rater, minority, rated): how often a rater stood against the others."""
    odd = contested(ratings).select(F.explode("minority").alias("rater")).groupBy("rater").agg(F.count("*").alias("minority"))
    rated = ratings.where("passed is not null").groupBy("rater").agg(F.count_distinct("item").alias("rated"))
    return rated.join(odd, "rater", "left").select("rater", F.coalesce("minority", F.lit(0)).alias("minority"), "rated")


def apprentice_pairs(expert: DataFrame, apprentice: DataFrame) -> DataFrame:
    """(n, agree, both_pass, expert_only, apprentice_only, both_fail, kappa, low, high) of verdicts on the same (case_id, position); a missing one drops the pair."""
    rows = expert.select("case_id", "position", F.col("passed").alias("e")).join(apprentice.select("case_id", "position", F.col("passed").alias("a")), ["case_id", "position"]).where("e is not null and a is not null")
    e, a = F.col("e"), F.col("a")
    cells = rows.agg(F.count("*").alias("n"), F.count_if(e == a).alias("agree"), F.count_if(e & a).alias("both_pass"), F.count_if(e & ~a).alias("expert_only"), F.count_if(~e & a).alias("apprentice_only"), F.count_if(~e & ~a).alias("both_fail"))
    low, high = wilson("agree", "n")
    return cells.withColumns({"kappa": kappa("both_pass", "expert_only", "apprentice_only", "both_fail"), "low": low, "high": high})


def order_consistency(presented: DataFrame) -> DataFrame:
    """accuracy on one presentation a pair (alternating by pair number), consistency between orders, and flips to the first answer.

    presented: pair_no, case_id, better_first, passed.
    """
    counted = F.col("better_first") == (F.col("pair_no") % 2 == 0)
    per = presented.groupBy("case_id").agg(F.max(F.when(counted, F.col("passed"))).alias("counted"), F.max(F.when(F.col("better_first"), F.col("passed"))).alias("a"), F.max(F.when(~F.col("better_first"), F.col("passed"))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return per.agg(F.count_if("counted").alias("right"), F.count("counted").alias("trials"), F.count_if(both & (F.col("a") == F.col("b"))).alias("consistent"), F.count_if(both & (F.col("a") != F.col("b"))).alias("flipped"), F.count_if(both & F.col("a") & ~F.col("b")).alias("flipped_to_first"))
