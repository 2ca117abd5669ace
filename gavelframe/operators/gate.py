"""Release gates on paired and unpaired outcomes, judge bridges, reviews and exposure ledgers.

``outcomes`` are long: case_id, version (baseline or candidate), repeat, passed.  Tests are exact:
with one outcome a side, gains are -1, 0 or 1 and the sign-flip test is a binomial tail on the
discordant cases; with repeats, the distribution of the sum is computed from the number of cases of
every size of gain; label permutation of binary outcomes is a hypergeometric tail.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.stats import _lgamma, incomplete_beta

LEVEL = 0.05
DRAWS = 2000
#: Steps of the distribution of a sum of gains beyond which its normal form is used.
EXACT_STEPS = 2_000_000


# -- tails ----------------------------------------------------------------------------------
def _log_choose(n: str, k: str) -> str:
    one = lambda x: _lgamma(f"cast({x} + 1 as double)")
    return f"({one(n)} - {one(k)} - {one(f'({n} - {k})')})"


def binomial_tail(up: str, down: str) -> tuple[Column, Column]:
    """(p_better, p_worse) of the sign-flip test on up and down cases: P(X >= up) and P(X <= up), X ~ Binomial(up + down, 1/2)."""
    n = f"({up} + {down})"
    at_least = lambda k, rest: F.expr(f"if({k} = 0, 1D, {incomplete_beta('0.5D', f'cast({k} as double)', f'cast({rest} + 1 as double)', n)})")
    return at_least(up, down), at_least(down, up)


def hypergeometric_tail(k1: str, n1: str, k2: str, n2: str) -> tuple[Column, Column]:
    """(p_better, p_worse) of arm 2 against arm 1 under random relabelling: tails of arm 2's passes given all passes.

    Terms are summed within 40 standard deviations of the mean or of arm 2's count, so their number
    grows with the square root of the data; what lies beyond is below 1e-300.
    """
    k, n = f"({k1} + {k2})", f"({n1} + {n2})"
    lowest, highest = f"greatest(0L, {k} - {n1})", f"least({k}, {n2})"
    term = f"exp({_log_choose(k, 'hg_i')} + {_log_choose(f'({n} - {k})', f'({n2} - hg_i)')} - {_log_choose(n, n2)})"
    mean = f"cast({k} * cast({n2} as double) / {n} as long)"
    reach = f"cast(50 + 40 * sqrt(cast({n2} as double) * {k} / {n}) as long)"
    total = lambda lo, hi: F.expr(f"least(1D, aggregate(transform(sequence({lo}, {hi}), hg_i -> {term}), 0D, (hg_a, hg_x) -> hg_a + hg_x))")
    above = total(f"greatest({k2}, least({highest}, {mean} - {reach}))", f"least({highest}, greatest({k2}, {mean}) + {reach})")
    below = total(f"greatest({lowest}, least({k2}, {mean}) - {reach})", f"least({k2}, greatest({lowest}, {mean} + {reach}))")
    return above, below


def sum_tails(sizes: Sequence[float], counts: Sequence[int], observed: float) -> tuple[float, float]:
    """P(S >= observed) and P(S <= observed) of S, the sum of counts[i] gains of sizes[i], each with a random sign.

    Sizes are multiples of a common step, so S is one of a convolution of binomials.  Beyond
    EXACT_STEPS steps its normal form with continuity correction is used, and without a common step
    (unequal repeats) the normal form alone.
    """
    kept = [(s, c) for s, c in zip(sizes, counts) if s > 1e-12 and c]
    if not kept:
        return 1.0, 1.0
    sizes, counts = zip(*kept)
    unit = next((d for d in range(1, 1000) if all(abs(s * d - round(s * d)) < 1e-6 for s in sizes)), None)
    steps = [round(s * unit) if unit else s for s in sizes]
    target = round(observed * unit) if unit else observed
    span = sum(s * c for s, c in zip(steps, counts))
    if unit is None or span > EXACT_STEPS:
        sd, gap = math.sqrt(sum(s * s * c for s, c in zip(steps, counts))), math.gcd(*(2 * s for s in steps)) / 2 if unit else 0
        upper = lambda x: 0.5 * math.erfc(x / sd / math.sqrt(2))
        return upper(target - gap), upper(-target - gap)
    # distribution of the number of positive signs, weighted: S = 2 * T - span
    spread = np.ones(1)
    for s, c in zip(steps, counts):
        i = np.arange(c + 1)
        logs = np.array([math.lgamma(c + 1) - math.lgamma(j + 1) - math.lgamma(c - j + 1) for j in i]) - c * math.log(2)
        part = np.zeros(s * c + 1)
        part[i * s] = np.exp(logs)
        size = len(spread) + len(part) - 1
        if len(spread) * len(part) < 1 << 22:
            spread = np.convolve(spread, part)
        else:
            n = 1 << (size - 1).bit_length()
            spread = np.clip(np.fft.irfft(np.fft.rfft(spread, n) * np.fft.rfft(part, n), n)[:size], 0, None)
    at = (target + span) // 2
    return min(1.0, float(spread[at:].sum())), min(1.0, float(spread[: at + 1].sum()))


def _tails(sizes: str, counts: str, observed: str) -> Column:
    """sum_tails() of array columns."""

    @F.pandas_udf("p_better double, p_worse double")
    def tails(s: pd.Series, c: pd.Series, o: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sum_tails(*row) for row in zip(s, c, o)], columns=["p_better", "p_worse"])

    return tails(sizes, counts, observed)


# -- paired outcomes ------------------------------------------------------------------------
def gains(outcomes: DataFrame) -> DataFrame:
    """(case_id, baseline, candidate, gain, uneven): both sides must have the case; uneven repeat counts are flagged."""
    side = lambda v: F.avg(F.when(F.col("version") == v, F.col("passed").cast("int")))
    n = lambda v: F.count_if(F.col("version") == v)
    per = outcomes.groupBy("case_id").agg(side("baseline").alias("baseline"), side("candidate").alias("candidate"), (n("baseline") != n("candidate")).alias("uneven"))
    return per.withColumn("gain", F.col("candidate") - F.col("baseline"))


def guard(paired: DataFrame) -> DataFrame:
    """Raise unless every case has outcomes on both sides, as many on each."""
    bad = F.col("gain").isNull() | F.col("uneven")
    message = F.concat(F.lit("baseline and candidate must be scored on the same cases, equally often: "), F.col("case_id").cast("string"))
    return paired.withColumn("gain", F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("gain")))


def report_outcomes(assertions: DataFrame, name: str) -> DataFrame:
    """Outcomes (case_id, version, repeat, passed) of one assertion of report rows (case_id, version, repeat, assertions map): a missing one, or a failed run, did not pass."""
    return assertions.select("case_id", "version", "repeat", F.coalesce(F.element_at("assertions", F.lit(name)), F.lit(False)).alias("passed"))


def for_candidates(level: float, k: int) -> float:
    """The level of each of k comparisons of which any may be acted on."""
    return level / k


def _decision(level: float, min_gain: float, max_regressions: float | None) -> Column:
    many = F.lit(False) if max_regressions is None else F.col("regressed") > max_regressions * F.col("cases")
    better = (F.col("p_better") < level / 2) & (F.col("mean_gain") > min_gain)
    return F.when((F.col("p_worse") < level / 2) | (better & many), "REJECT").when(better, "PROMOTE").otherwise("INCONCLUSIVE")


def decide(paired: DataFrame, keys: list[str], level: float = LEVEL, min_gain: float = 0.0, max_regressions: float | None = None, candidates: int = 1) -> DataFrame:
    """One decision a group of keys from gains of -1, 0 or 1 (one outcome a side); other gains raise. REJECT is tested first."""
    whole = F.col("gain").isin(-1, 0, 1) | F.col("gain").isNull()
    gain = F.when(whole, F.col("gain")).otherwise(F.raise_error(F.lit("gains of repeated outcomes need decide_repeated()")).cast("double"))
    per = paired.withColumn("gain", gain).groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("gain").alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") < 0).alias("regressed"))
    better, worse = binomial_tail("improved", "regressed")
    per = per.withColumns({"p_better": better, "p_worse": worse})
    return per.withColumn("decision", _decision(for_candidates(level, candidates), min_gain, max_regressions))


def decide_repeated(paired: DataFrame, keys: list[str], level: float = LEVEL, min_gain: float = 0.0, max_regressions: float | None = None, candidates: int = 1, draws: int = DRAWS) -> DataFrame:
    """decide() for gains of any size, with low and high, the bootstrap interval of the mean gain by case.

    Cases with equal gains are counted once, so one row a size of gain reaches the test.
    """
    kinds = paired.groupBy(*keys, F.round("gain", 9).alias("gain")).agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("kind", F.format_string("%.9f", "gain"))
    sizes = kinds.groupBy(*keys, F.abs("gain").alias("size")).agg(F.sum("n").alias("n"))
    listed = sizes.groupBy(*keys).agg(F.collect_list("size").alias("sizes"), F.collect_list("n").alias("counts"))
    total = kinds.groupBy(*keys).agg(F.sum("n").alias("cases"), F.sum(F.col("gain") * F.col("n")).alias("total"), F.sum(F.when(F.col("gain") > 0, F.col("n")).otherwise(0)).alias("improved"), F.sum(F.when(F.col("gain") < 0, F.col("n")).otherwise(0)).alias("regressed"))
    low, high = resample.percentile("values", 0.05)
    rows = total.join(listed, keys).join(gain_draws(kinds, keys, draws), keys)
    rows = rows.select(*keys, "cases", (F.col("total") / F.col("cases")).alias("mean_gain"), "improved", "regressed", low.alias("low"), high.alias("high"), _tails("sizes", "counts", "total").alias("p")).select("*", "p.*").drop("p")
    return rows.withColumn("decision", _decision(for_candidates(level, candidates), min_gain, max_regressions))


def gain_draws(kinds: DataFrame, keys: list[str], draws: int = DRAWS) -> DataFrame:
    """(keys, values): mean gains of bootstrap resamples of the cases behind kinds (keys, kind, gain, n)."""
    drawn = resample.weights(kinds, "kind", "n", draws, "gain")
    means = drawn.groupBy(*keys, "draw").agg((F.sum(F.col("gain") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    return resample.sorted_values(means, keys, F.col("mean"))


def refused(decided: DataFrame, certificates: DataFrame, key: str = "judge_id") -> DataFrame:
    """Decisions, REFUSED where the judge's certificate is missing or not ADMISSIBLE, or was issued for another configuration.

    certificates: key, verdict and, to be compared with decided's own, fingerprint.
    """
    same = F.lit(True) if "fingerprint" not in decided.columns else F.col("c.fingerprint").eqNullSafe(F.col("d.fingerprint"))
    columns = [F.col(f"d.{c}") for c in decided.columns if c != "decision"]
    reason = F.when(F.col("c.verdict").isNull(), "no certificate").when(F.col("c.verdict") != "ADMISSIBLE", F.concat(F.lit("the judge is "), F.col("c.verdict"))).when(~same, "the certificate is for another configuration")
    joined = decided.alias("d").join(certificates.alias("c"), F.col(f"d.{key}") == F.col(f"c.{key}"), "left")
    return joined.select(*columns, F.when(reason.isNotNull(), "REFUSED").otherwise(F.col("d.decision")).alias("decision"), reason.alias("refusal"))


def detectable_gain(paired: DataFrame, repeats: int, power: float = 0.8, level: float = LEVEL, trials: int = 100, shifts: Sequence[float] = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5), seed: int = 0) -> float | None:
    """The smallest shift of the cases' pass rates that would be promoted with at least that power; None if none would.

    The cases enter as counts by baseline rate.  A trial draws both versions anew, the candidate's
    rates shifted and cut at 1.
    """
    kinds = paired.groupBy(F.round("baseline", 9).alias("rate")).count().orderBy("rate").collect()  # one row a rate
    rng = np.random.default_rng(seed)
    for shift in sorted(shifts):
        promoted = 0
        for _ in range(trials):
            got: dict[int, int] = {}
            for r in kinds:
                a, b = rng.binomial(repeats, r["rate"], r["count"]), rng.binomial(repeats, min(1.0, r["rate"] + shift), r["count"])
                for value, n in zip(*np.unique(b - a, return_counts=True)):
                    got[int(value)] = got.get(int(value), 0) + int(n)
            total = sum(v * n for v, n in got.items())
            sizes = sorted({abs(v) for v in got} - {0})
            better, _ = sum_tails(sizes, [got.get(s, 0) + got.get(-s, 0) for s in sizes], total)
            promoted += better < level / 2 and total > 0
        if promoted >= power * trials:
            return shift
    return None


def decide_unpaired(arms: DataFrame, level: float = LEVEL) -> DataFrame:
    """Decisions from passes and outcomes of two arms (k1, n1 baseline; k2, n2 candidate) by random relabelling."""
    better, worse = hypergeometric_tail("k1", "n1", "k2", "n2")
    rows = arms.withColumns({"mean_gain": F.col("k2") / F.col("n2") - F.col("k1") / F.col("n1"), "p_better": better, "p_worse": worse})
    return rows.withColumn("decision", F.when(F.col("p_worse") < level / 2, "REJECT").when((F.col("p_better") < level / 2) & (F.col("mean_gain") > 0), "PROMOTE").otherwise("INCONCLUSIVE"))


# -- two judges on two versions -------------------------------------------------------------
def four_rates(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a case: pass rates of judges old and new on both versions (old_baseline, ...), and uneven where a cell lacks outcomes."""
    cell = lambda j, v: (F.col("judge_id") == j) & (F.col("version") == v)
    names = [(j, v) for j in ("old", "new") for v in ("baseline", "candidate")]
    rates = [F.avg(F.when(cell(j, v), F.col("passed").cast("int"))).alias(f"{j}_{v}") for j, v in names]
    counts = F.array(*(F.count_if(cell(j, v)) for j, v in names))
    per = outcomes.groupBy(*keys, "case_id").agg(*rates, counts.alias("_n"))
    return per.withColumn("uneven", (F.array_min("_n") == 0) | (F.array_min("_n") != F.array_max("_n"))).drop("_n")


def subset_interval(kinds: DataFrame, keys: list[str], bound: float, level: float = LEVEL, draws: int = DRAWS) -> DataFrame:
    """(keys, estimate, low, high) of a mean over cases by the means of random subsets, from (keys, value, n).

    One pseudo-case at each extreme keeps a few cases that agree from proving anything.  The +1 of
    the observed labelling and subsets without a case are counted as in a sign-flip test.
    """
    ends = kinds.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(bound), F.lit(-bound))).alias("value"), F.lit(1).cast("long").alias("n"))
    every = kinds.select(*keys, F.round("value", 9).alias("value"), "n").unionByName(ends).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    every = every.withColumn("value", F.col("value") + 0.0).withColumn("kind", F.format_string("%.9f", "value"))
    drawn = resample.subsets(every, "kind", "n", draws, "subset").groupBy(*keys, "draw").agg((F.sum(F.col("value") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    means = resample.sorted_values(drawn, keys, F.col("mean"))
    estimate = kinds.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("estimate"), F.sum("n").alias("cases"))
    m = F.size("values")
    need = F.lit(math.ceil(level / 2 * (draws + 1))) - 1 - (draws - m)
    open_end = (need <= 0) | (need > m)
    low = F.when(open_end, -bound).otherwise(F.greatest(F.lit(-bound), F.get("values", need - 1)))
    high = F.when(open_end, bound).otherwise(F.least(F.lit(bound), F.get("values", m - need)))
    return estimate.join(means, keys).select(*keys, "cases", "estimate", low.alias("low"), high.alias("high"))


def bridge(rates: DataFrame, margin: float = 0.05, level: float = LEVEL, draws: int = DRAWS) -> DataFrame:
    """Three effects of a new judge over four_rates() rows: interaction (new gain - old gain), and its shift on either version.

    (effect, cases, estimate, low, high, comparable): comparable is PASS if the interaction's interval
    lies within the margin, FAIL if it lies beyond on one side, else UNVALIDATED; null for the shifts.
    """
    new, old = F.col("new_candidate") - F.col("new_baseline"), F.col("old_candidate") - F.col("old_baseline")
    values = {"interaction": new - old, "shift_baseline": F.col("new_baseline") - F.col("old_baseline"), "shift_candidate": F.col("new_candidate") - F.col("old_candidate")}
    message = F.concat(F.lit("every cell needs the same number of outcomes, at least one: case "), F.col("case_id").cast("string"))
    checked = lambda v: F.when(F.col("uneven"), F.raise_error(message).cast("double")).otherwise(F.round(v, 9))
    long = rates.select(F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), checked(v).alias("value")) for k, v in values.items()))).alias("e")).select("e.*")
    kinds = long.groupBy("effect", "value").agg(F.count("*").alias("n"))
    parts = [subset_interval(kinds.where(test), ["effect"], bound, level, draws) for test, bound in (("effect = 'interaction'", 2.0), ("effect <> 'interaction'", 1.0))]
    rows = parts[0].unionByName(parts[1])
    within = (F.col("low") >= -margin) & (F.col("high") <= margin)
    beyond = (F.col("low") > margin) | (F.col("high") < -margin)
    return rows.withColumn("comparable", F.when(F.col("effect") == "interaction", F.when(within, "PASS").when(beyond, "FAIL").otherwise("UNVALIDATED")))


def impact(rates: DataFrame, keys: Sequence[str], level: float = LEVEL) -> DataFrame:
    """Per record: the decision of either judge and what the change means for one that was acted on. rates: four_rates() with one outcome a cell."""
    side = lambda j: decide(rates.select(*keys, (F.col(f"{j}_candidate") - F.col(f"{j}_baseline")).alias("gain")), list(keys), level).select(*keys, "decision")
    joined = side("old").withColumnRenamed("decision", "acted_on").join(side("new").withColumnRenamed("decision", "now"), list(keys))
    return joined.withColumn("concern", concern(F.col("acted_on"), F.col("now")))


def concern(acted: Column, now: Column) -> Column:
    """What a changed judge means for a decision that was acted on."""
    return F.when((acted == "PROMOTE") & (now == "REJECT"), "dangerous").when((acted == "PROMOTE") & (now != "PROMOTE"), "unsupported").when((acted != "PROMOTE") & (now == "PROMOTE"), "missed").otherwise("none")


# -- reviews by people ----------------------------------------------------------------------
def quotas(strata: DataFrame, total: int, density: str | None = None) -> DataFrame:
    """strata (stratum, size) with quota: two labels each at least, the rest by size (times density), none above its size.

    Labels go one by one to the stratum furthest below its share, which is a common level: a
    stratum of weight w gets its i-th label (from 0) at level i / w, so the labels taken are the
    total lowest of all levels, ties by name.
    """
    weight = F.col("size") * (F.col(density) if density else F.lit(1.0))
    base = strata.withColumn("_w", weight).withColumn("_least", F.least(F.lit(2), F.col("size")))
    given = base.agg(F.sum("_least")).first()[0] or 0
    slots = base.where("size > _least").select("stratum", F.explode(F.sequence(F.col("_least"), F.least(F.col("size") - 1, F.lit(total)))).alias("i"), "_w")
    taken = slots.orderBy(F.col("i") / F.col("_w"), "stratum").limit(max(0, total - given)).groupBy("stratum").count()
    return base.join(taken, "stratum", "left").withColumn("quota", F.col("_least") + F.coalesce("count", F.lit(0))).drop("_w", "_least", "count")


def review_batch(cases: DataFrame, quota: DataFrame, seed: str = "review") -> DataFrame:
    """The cases (stratum, case_id) to label for these quotas, in a fixed random order of each stratum."""
    from pyspark.sql import Window

    from gavelframe.functions.rng import digest

    order = Window.partitionBy("stratum").orderBy(digest(seed, F.col("case_id")), "case_id")
    rows = cases.withColumn("_rn", F.row_number().over(order)).join(quota.select("stratum", "quota"), "stratum")
    return rows.where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def review_estimate(strata: DataFrame) -> DataFrame:
    """(estimate, variance) of the stratified mean from (size, labelled, mean, sum_squares): a pseudo-label at +1 and -1 keeps few labels from certainty."""
    m = F.col("labelled") + 2
    total = F.col("labelled") * F.col("mean")
    variance = (F.col("sum_squares") + 2 - total * total / m) / (m - 1)
    everything = strata.agg(F.sum("size").alias("all"))
    weight = F.col("size") / F.col("all")
    return strata.crossJoin(everything).agg(F.sum(weight * F.col("mean")).alias("estimate"), F.sum(weight * weight * (1 - F.col("labelled") / F.col("size")) * variance / F.col("labelled")).alias("variance"))


def review_decision(strata: DataFrame, looks: Sequence[int], alpha: float = 0.05) -> DataFrame:
    """(estimate, low, high, look, labels, decision) of a review at the latest of its fixed looks; INCONCLUSIVE until every stratum has two labels."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / (2 * len(looks)))
    labels = strata.agg(F.sum("labelled").alias("labels"), F.min("labelled").alias("least"))
    rows = review_estimate(strata.where("labelled > 0")).crossJoin(labels)  # one row each
    half = z * F.sqrt("variance")
    rows = rows.withColumns({"low": F.greatest(F.lit(-1.0), F.col("estimate") - half), "high": F.least(F.lit(1.0), F.col("estimate") + half), "look": sum((F.col("labels") >= n).cast("int") for n in looks)})
    ready = (F.col("least") >= 2) & (F.col("look") > 0)
    decision = F.when(ready & (F.col("low") > 0), "PROMOTE").when(ready & (F.col("high") < 0), "REJECT").otherwise("INCONCLUSIVE")
    hide = lambda c: F.when(ready, F.col(c)).alias(c)
    return rows.select(hide("estimate"), hide("low"), hide("high"), "look", "labels", decision.alias("decision"))


# -- cases an optimizer has seen ------------------------------------------------------------
def exposures(events: DataFrame) -> DataFrame:
    """(case_id, exposures, exposed_by) from events (event_no, by, case_id): a case counts once an event."""
    once = events.select("event_no", "by", "case_id").distinct()
    return once.groupBy("case_id").agg(F.count_distinct("event_no").alias("exposures"), F.sort_array(F.collect_set("by")).alias("exposed_by"))


def fresh(cases: DataFrame, events: DataFrame, max_exposures: int = 0) -> DataFrame:
    """cases with exposures and fresh: exposed at most max_exposures times."""
    n = F.coalesce("exposures", F.lit(0))
    return cases.join(exposures(events), "case_id", "left").select(*cases.columns, n.alias("exposures"), (n <= max_exposures).alias("fresh"))


def confirm(paired: DataFrame, keys: list[str], events: DataFrame, max_exposures: int = 0, **rules) -> DataFrame:
    """decide(), REFUSED for a group in which any case was exposed more often; exposed is the number of such cases."""
    spent = fresh(paired, events, max_exposures).groupBy(*keys).agg(F.count_if(~F.col("fresh")).alias("exposed"))
    rows = decide(paired, keys, **rules).join(spent, keys)
    return rows.withColumn("decision", F.when(F.col("exposed") > 0, "REFUSED").otherwise(F.col("decision")))


# -- advice at saved states -----------------------------------------------------------------
def assess_steering(runs: DataFrame, good_path_rate: float = 0.8, **rules) -> DataFrame:
    """Whether advice helps, from runs (state, arm in silent, steer, neutral, repeat, completed, steps).

    One row: completion and mean steps of the arms, verdict against the control arm (neutral if
    there is one, else silent), and harm: the decision on states that silent runs complete at
    least at good_path_rate, against the neutral arm only.
    """
    arms = {r[0] for r in runs.select("arm").distinct().collect()}  # three at most
    if "steer" not in arms or len(arms) < 2:
        raise ValueError("runs need the arm steer and at least one of silent and neutral")
    control = "neutral" if "neutral" in arms else "silent"
    per = runs.groupBy("state").pivot("arm", ["silent", "steer", "neutral"]).agg(F.avg(F.col("completed").cast("int")).alias("rate"), F.avg("steps").alias("steps"))
    means = per.agg(*(F.avg(f"{a}_{c}").alias(f"{a}_{c}") for a in ("silent", "steer", "neutral") for c in ("rate", "steps")), F.count("*").alias("states"))

    def versus(rows: DataFrame, name: str) -> DataFrame:
        pairs = rows.select(F.lit(1).alias("g"), F.col("state").alias("case_id"), (F.col("steer_rate") - F.col(f"{control}_rate")).alias("gain"))
        return decide_repeated(pairs, ["g"], **rules).select(F.col("decision").alias(name), F.col("mean_gain").alias(f"{name}_gain"), F.col("cases").alias(f"{name}_states"))

    out = means.crossJoin(versus(per, "steer"))  # one row each
    if {"silent", "neutral"} <= arms:
        harm = versus(per.where(F.col("silent_rate") >= good_path_rate), "harm")
        out = out.join(harm, F.lit(True), "left")
    verdict = F.when(F.col("steer") == "PROMOTE", "HELPS").when(F.col("steer") == "REJECT", "HURTS").otherwise("INCONCLUSIVE")
    return out.withColumn("verdict", verdict).withColumn("control", F.lit(control))
