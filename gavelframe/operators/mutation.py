"""Mutation reports: known defects planted in known-good outputs, and who catches them.

A mutant rewrites the output, which every evaluator sees, or the evidence (the inputs), which one
that reads only the output never sees.  An evaluator is asked about a mutant of a case only where
it passed the original; what it cannot see counts as judged and not caught.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import text as T
from gavelframe.functions.stats import wilson

#: Mutants of texts: what each does to an output; null where it does not apply.
DEFAULT: Mapping[str, Callable[[Column], Column]] = {
    "truncated": T.truncated,
    "last_sentence_dropped": T.dropped_last_sentence,
    "number_changed": T.bumped_number,
    "yes_no_flipped": T.flipped_yes_no,
    "emptied": lambda t: F.when(t != "", F.lit("")),
}


def mutants(cases: DataFrame, of_output: Mapping[str, Callable[[Column], Column]] = DEFAULT, of_evidence: Mapping[str, Callable[[Column], Column]] | None = None, oracle: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(case_id, mutant, changes, state, inputs, output) of every case and mutant.

    cases: case_id, output and, if there are any, inputs and expected_output.  state is
    not_applicable (the mutant leaves the case as it is), not_defect (the oracle of inputs and output
    still accepts it, or it equals the expected output) or defect.  Cases whose own output the oracle
    rejects are left out.
    """
    rows = cases
    for c in ("inputs", "expected_output"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if oracle is not None:
        rows = rows.where(oracle(F.col("inputs"), F.col("output")))
    inputs, output = F.col("inputs"), F.col("output")

    def made(name: str, changes: str, new_inputs: Column, new_output: Column) -> Column:
        return F.struct(F.lit(name).alias("mutant"), F.lit(changes).alias("changes"), new_inputs.alias("new_inputs"), new_output.alias("new_output"))

    each = [made(n, "output", inputs, f(output)) for n, f in of_output.items()]
    each += [made(n, "evidence", f(inputs), output) for n, f in (of_evidence or {}).items()]
    rows = rows.select("case_id", "inputs", "output", "expected_output", F.explode(F.array(*each)).alias("m")).select("*", "m.*").drop("m")
    gone = F.when(F.col("changes") == "output", F.col("new_output").isNull()).otherwise(F.col("new_inputs").isNull())
    same = F.col("new_output").eqNullSafe(output) & F.col("new_inputs").eqNullSafe(inputs)
    right = oracle(F.col("new_inputs"), F.col("new_output")) if oracle is not None else F.coalesce(F.col("new_output") == F.col("expected_output"), F.lit(False))
    state = F.when(gone | same, "not_applicable").when(right, "not_defect").otherwise("defect")
    return rows.select("case_id", "mutant", "changes", state.alias("state"), F.col("new_inputs").alias("inputs"), F.col("new_output").alias("output"))


def summary(made: DataFrame) -> DataFrame:
    """(mutant, changes, defects, not_defect, not_applicable)."""
    count = lambda s, n: F.count_if(F.col("state") == s).alias(n)
    return made.groupBy("mutant", "changes").agg(count("defect", "defects"), count("not_defect", "not_defect"), count("not_applicable", "not_applicable"))


def outcomes(made: DataFrame, originals: DataFrame, verdicts: DataFrame, observes: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(evaluator, mutant, case_id, status) of every evaluator and defect.

    originals: evaluator, case_id, passed; verdicts: evaluator, mutant, case_id, passed.  observes
    names what an evaluator is shown (output, evidence); others see both.
    """
    seen = F.lit(True)
    for evaluator, shown in (observes or {}).items():
        seen = seen & ((F.col("evaluator") != evaluator) | F.col("changes").isin(*shown))
    rows = made.where("state = 'defect'").select("case_id", "mutant", "changes").join(originals.select("evaluator", "case_id", F.col("passed").alias("first")), "case_id")
    rows = rows.join(verdicts.select("evaluator", "mutant", "case_id", "passed"), ["evaluator", "mutant", "case_id"], "left")
    status = F.when(F.col("first").isNull(), "error").when(~F.col("first"), "original_failed").when(~seen, "unobservable").when(F.col("passed").isNull(), "error").when(F.col("passed"), "missed").otherwise("caught")
    return rows.select("evaluator", "mutant", "case_id", status.alias("status"))


def kill_rates(found: DataFrame, min_rate: float = 0.8) -> DataFrame:
    """(evaluator, mutant, caught, missed, unobservable, errors, original_failed, judged, rate, low, high, clears).

    clears: some defect was judged, no more than a tenth of the verdicts errored, and the lower
    bound of the rate reaches min_rate.
    """
    count = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    rows = found.groupBy("evaluator", "mutant").agg(count("caught", "caught"), count("missed", "missed"), count("unobservable", "unobservable"), count("error", "errors"), count("original_failed", "original_failed"))
    rows = rows.withColumn("judged", F.col("caught") + F.col("missed") + F.col("unobservable"))
    low, high = wilson("caught", "judged")
    rows = rows.withColumns({"rate": F.col("caught") / F.nullif(F.col("judged"), F.lit(0)), "low": low, "high": high})
    clears = (F.col("judged") > 0) & (F.col("errors") <= 0.1 * (F.col("judged") + F.col("errors"))) & (F.col("low") >= min_rate)
    return rows.withColumn("clears", clears)
