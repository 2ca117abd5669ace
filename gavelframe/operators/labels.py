"""Labels that arrive from people or later events: annotations, delayed outcomes, audited pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions.rng import digest, u01
from gavelframe.functions.stats import begg_greenes, clopper_pearson, kappa, newcombe


def latest_annotations(rows: DataFrame) -> DataFrame:
    """The last annotation of every (run, reviewer): by time if all of the group's times are readable, else by row. A row without a reviewer is a reviewer of its own.

    rows: run_id, reviewer, verdict, updated_at, row_no; rows without a run are left out.
    """
    nobody = F.when(F.col("reviewer").isNull(), F.col("row_no"))
    rows = rows.where("run_id is not null").withColumn("_own", nobody)
    w = Window.partitionBy("run_id", "reviewer", "_own")
    timed = F.count_if(F.col("updated_at").isNull()).over(w) == 0
    by = w.orderBy(F.when(F.col("_timed"), F.col("updated_at")).desc_nulls_last(), F.desc("row_no"))
    return rows.withColumn("_timed", timed).withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn", "_timed", "_own")


def annotation_votes(latest: DataFrame, conflicts: str = "exclude") -> DataFrame:
    """One label a run: neutral votes do not count, one class of votes is the label, both are a conflict.

    conflicts: exclude leaves a conflict one; majority takes a strict majority of pass and fail.
    """
    if conflicts not in ("exclude", "majority"):
        raise ValueError("conflicts must be exclude or majority")
    per = latest.groupBy("run_id").agg(F.count_if(F.col("verdict") == "pass").alias("passes"), F.count_if(F.col("verdict") == "fail").alias("fails"), F.count_if(F.col("verdict") == "neutral").alias("neutral"))
    p, f = F.col("passes"), F.col("fails")
    both = F.lit("conflict") if conflicts == "exclude" else F.when(p > f, "pass").when(f > p, "fail").otherwise("conflict")
    return per.withColumn("label", F.when((p > 0) & (f > 0), both).when(p > 0, "pass").when(f > 0, "fail").otherwise("neutral"))


def read_summary(rows: DataFrame, conflicts: str = "exclude") -> DataFrame:
    """One row that accounts for every row of an export: rows, runs, labelled, pass, fail, neutral_annotations, neutral_runs, conflicts, superseded, missing_id."""
    latest = latest_annotations(rows)
    votes = annotation_votes(latest, conflicts)
    all_rows = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("run_id").isNull()).alias("missing_id"))
    count = lambda *kinds: F.count_if(F.col("label").isin(*kinds))
    decided = votes.agg(F.count("*").alias("runs"), count("pass", "fail").alias("labelled"), count("pass").alias("pass"), count("fail").alias("fail"), F.coalesce(F.sum("neutral"), F.lit(0)).alias("neutral_annotations"), count("neutral").alias("neutral_runs"), count("conflict").alias("conflicts"))
    kept = latest.agg(F.count("*").alias("kept"))
    return all_rows.crossJoin(decided).crossJoin(kept).withColumn("superseded", F.col("rows") - F.col("missing_id") - F.col("kept")).drop("kept")  # one row each


def human_labels(rows: DataFrame, runs: DataFrame, conflicts: str = "exclude", skip_missing: bool = False) -> DataFrame:
    """Labelled outputs for certify.plan(): case_id, output, label, and what reviewers wrote.

    runs: run_id, case_id, output.  A labelled run that is not there raises, unless skip_missing.
    """
    latest = latest_annotations(rows)
    votes = annotation_votes(latest, conflicts).where("label in ('pass', 'fail')")
    missing = votes.join(runs, "run_id", "left_anti")
    if not skip_missing:
        first = [r[0] for r in missing.select("run_id").orderBy("run_id").limit(3).collect()]
        if first:
            raise KeyError(f"labelled runs without a case and output: {first}; pass them, or skip_missing=True")
    notes = latest.groupBy("run_id").agg(F.sort_array(F.collect_set("reviewer")).alias("reviewers"), F.min_by("category", F.when(F.col("category").isNotNull(), F.col("row_no"))).alias("category"), F.collect_list("comment").alias("comments"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return votes.join(runs, "run_id").join(notes, "run_id").select("case_id", "output", (F.col("label") == "pass").cast("int").alias("label"), "run_id", "reviewers", "category", "comments", "tags")


def agreement(human: DataFrame, judge: DataFrame, key: str) -> DataFrame:
    """Labels (key, label: pass or fail) against verdicts (key, passed): both_pass, human_only_pass, judge_only_pass, both_fail, errors, human_only, judge_only, agreement with its exact interval, kappa."""
    h, j = human.select(key, (F.col("label") == "pass").alias("h")), judge.select(key, F.col("passed").alias("p"), F.lit(True).alias("seen"))
    both = h.join(j, key, "full_outer")
    matched = F.col("h").isNotNull() & F.col("p").isNotNull()
    cells = both.agg(
        *(F.count_if(matched & (F.col("h") == a) & (F.col("p") == b)).alias(n) for a, b, n in ((True, True, "both_pass"), (True, False, "human_only_pass"), (False, True, "judge_only_pass"), (False, False, "both_fail"))),
        F.count_if(F.col("h").isNotNull() & F.col("seen") & F.col("p").isNull()).alias("errors"), F.count_if(F.col("h").isNotNull() & F.col("seen").isNull()).alias("human_only"), F.count_if(F.col("h").isNull()).alias("judge_only"),
    )
    cells = cells.withColumns({"n": F.expr("both_pass + human_only_pass + judge_only_pass + both_fail"), "agree": F.expr("both_pass + both_fail")})
    low, high = clopper_pearson("agree", "n")
    return cells.withColumns({"agreement": F.col("agree") / F.nullif(F.col("n"), F.lit(0)), "low": low, "high": high, "kappa": kappa("both_pass", "human_only_pass", "judge_only_pass", "both_fail")})


def match_outcomes(verdicts: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """verdicts with outcome (null: pending). An outcome without a verdict raises."""
    first = [r[0] for r in outcomes.join(verdicts, key, "left_anti").select(key).limit(3).collect()]
    if first:
        raise KeyError(f"outcomes without a verdict: {first}")
    return verdicts.join(outcomes.select(key, "outcome"), key, "left")


def audit(population: DataFrame, labels: DataFrame, key: str, n: int, seed: str = "audit") -> DataFrame:
    """The population (key, passed) with human for the drawn sample. Labels must cover exactly the n rows that the hash draws."""
    drawn = population.select(key).orderBy(u01(seed, F.col(key)), key).limit(n)
    extra = [r[0] for r in labels.select(key).join(drawn, key, "left_anti").limit(3).collect()]
    lacking = [r[0] for r in drawn.join(labels, key, "left_anti").limit(3).collect()]
    if extra or lacking:
        raise ValueError(f"the audit must label the drawn rows and no others; not drawn: {extra}, not labelled: {lacking}")
    return population.join(labels.select(key, "human"), key, "left")


def left_out(human: DataFrame, judge: DataFrame, key: str) -> DataFrame:
    """Runs by side: matched, human_only, judge_only. human: key, label; judge: key, passed."""
    both = human.select(key, F.lit(True).alias("h")).join(judge.select(key, F.lit(True).alias("j")), key, "full_outer")
    side = F.when(F.col("h") & F.col("j"), "matched").when(F.col("h"), "human_only").otherwise("judge_only")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("runs"))


def outcome_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """Six counts of verdict (passed) by outcome (true, false, null: pending)."""
    p, o = F.col("passed"), F.col("outcome")
    return rows.groupBy(*keys).agg(F.count_if(p & o).alias("ps"), F.count_if(p & ~o).alias("pf"), F.count_if(p & o.isNull()).alias("pm"), F.count_if(~p & o).alias("fs"), F.count_if(~p & ~o).alias("ff"), F.count_if(~p & o.isNull()).alias("fm"))


def outcome_report(cells: DataFrame) -> DataFrame:
    """Rates, observation gap with Newcombe's interval, bias flag and Begg-Greenes adjusted rates of outcome cells."""
    n = cells.withColumns({"op": F.expr("ps + pf"), "np": F.expr("ps + pf + pm"), "of": F.expr("fs + ff"), "nf": F.expr("fs + ff + fm")})
    ratio = lambda a, b: F.when(F.expr(b) > 0, F.expr(a) / F.expr(b))
    gap, low, high = newcombe("op", "np", "of", "nf")
    sens, spec = begg_greenes(ratio("np", "np + nf"), ratio("ps", "ps + pf"), ratio("fs", "fs + ff"))
    blind = ((F.col("np") > 0) & (F.col("op") == 0)) | ((F.col("nf") > 0) & (F.col("of") == 0))
    n = n.withColumns({"gap": gap, "gap_low": low, "gap_high": high, "sensitivity": ratio("ps", "ps + fs"), "specificity": ratio("ff", "pf + ff"), "ppv": ratio("ps", "ps + pf"), "npv": ratio("ff", "fs + ff"), "agreement": ratio("ps + ff", "ps + pf + fs + ff"), "adjusted_sensitivity": sens, "adjusted_specificity": spec})
    return n.withColumn("biased", (F.col("np") > 0) & (F.col("nf") > 0) & (blind | F.coalesce((F.col("gap_low") > 0) | (F.col("gap_high") < 0), F.lit(False)))).drop("op", "np", "of", "nf")


def ppi(rows: DataFrame, tuned: bool, z: float = 1.959963984540054) -> DataFrame:
    """Prediction-powered pass rate from (passed, human): human is null outside the audit. One row: estimate, interval, what people alone say."""
    h, j = F.col("human").cast("double"), F.when(F.col("human").isNotNull(), F.col("passed").cast("double"))
    base = rows.agg(F.count("*").alias("total"), F.avg(F.col("passed").cast("double")).alias("q"), F.count("human").alias("n"), F.avg(h).alias("mh"), F.avg(j).alias("mj"), F.var_samp(h).alias("vh"), F.var_samp(j).alias("vj"), F.covar_samp(h, j).alias("c"), F.count_if(F.col("human") & ~F.col("passed")).alias("false_fails"), F.count_if(~F.col("human") & F.col("passed")).alias("false_passes"))
    lam = F.when(F.col("vj") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") / F.col("vj")))).otherwise(1.0) if tuned else F.lit(1.0)
    base = base.withColumn("lam", lam).withColumn("raw", F.expr("mh + lam * (q - mj)"))
    base = base.withColumn("se", F.expr("sqrt(greatest(0D, 1 - n / total) * (vh - 2 * lam * c + lam * lam * vj) / n)")).withColumn("estimate", F.expr("least(1D, greatest(0D, raw))"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return base.withColumns({"low": F.least("estimate", clip(F.col("raw") - z * F.col("se"))), "high": F.greatest("estimate", clip(F.col("raw") + z * F.col("se")))})


def ppi_exact(base: DataFrame) -> DataFrame:
    """Adds the finite-sample interval of ppi()'s row."""
    ff, fp = clopper_pearson("false_fails", "n", "0.025D"), clopper_pearson("false_passes", "n", "0.025D")
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return base.withColumns({"exact_low": F.least("estimate", clip(F.col("q") + ff[0] - fp[1])), "exact_high": F.greatest("estimate", clip(F.col("q") + ff[1] - fp[0]))})


def fingerprint(names: Column) -> Column:
    """16 hex digits of the sorted names: a digest of a population or sample small enough for one row; population_digest() has no bound."""
    return F.substring(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(names))), 256), 1, 16)


def population_digest(rows: DataFrame, key: str, keys: list[str], buckets: int = 4096) -> DataFrame:
    """(keys, digest) of a population of any size: digests of the sorted names by hash bucket, then of those."""
    h = digest(F.col(key))
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)
    per = rows.groupBy(*keys, F.floor(bucket).alias("bucket")).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(h))), 256).alias("d"))
    listed = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "d"))).alias("all"))
    return listed.select(*keys, F.substring(F.sha2(F.array_join(F.transform("all", lambda x: x["d"]), "\n"), 256), 1, 16).alias("digest"))


def beta_interval(cells: DataFrame, keys: list[str], statistic, alpha: float = 0.05, draws: int = 4000, seed: int = 0) -> DataFrame:
    """(keys, low, high) of a statistic of binomial rates, by draws from their Jeffreys posteriors.

    cells: keys and counts k_1, n_1, k_2, n_2, ...; statistic(rates) gets one array of draws a rate
    and returns an array.  The draws are fixed by seed and the keys.
    """
    import zlib

    import numpy as np
    import pandas as pd

    pairs = sorted(int(c[2:]) for c in cells.columns if c.startswith("k_"))

    def interval(rows):
        for part in rows:
            out = part[keys].copy()
            bounds = []
            for row in part.to_dict("records"):
                rng = np.random.default_rng([seed, zlib.crc32(repr([row[k] for k in keys]).encode())])
                rates = [rng.beta(row[f"k_{i}"] + 0.5, row[f"n_{i}"] - row[f"k_{i}"] + 0.5, draws) for i in pairs]
                bounds.append(np.quantile(statistic(rates), [alpha / 2, 1 - alpha / 2], method="inverted_cdf"))
            out["low"], out["high"] = np.array(bounds).T if bounds else (pd.Series(dtype=float),) * 2
            yield out

    fields = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in keys)
    return cells.mapInPandas(interval, f"{fields}, low double, high double")


def adjusted_intervals(cells: DataFrame, keys: list[str], **options) -> DataFrame:
    """Intervals of the Begg-Greenes sensitivity of outcome_cells() rows."""
    rates = cells.select(*keys, F.expr("ps + pf + pm").alias("k_1"), F.expr("ps + pf + pm + fs + ff + fm").alias("n_1"), F.col("ps").alias("k_2"), F.expr("ps + pf").alias("n_2"), F.col("fs").alias("k_3"), F.expr("fs + ff").alias("n_3"))
    return beta_interval(rates, keys, lambda r: r[0] * r[1] / (r[0] * r[1] + (1 - r[0]) * r[2]), **options)
