"""Plugging a judge into a plan: a Column, a Python function, or a table of verdicts.

Whatever the judge is, its judgments are the plan with judge_id, passed, reason and error.  A null
verdict is an error and never a fail.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR_LENGTH = 300


def by_column(planned: DataFrame, judge_id: str, passed: Column, reason: Column | None = None) -> DataFrame:
    """Judgments of a judge that is a condition on the plan's columns."""
    nothing = F.lit(None).cast("string")
    error = F.when(passed.isNull(), "no verdict")
    return planned.select(F.lit(judge_id).alias("judge_id"), "*", passed.alias("passed"), (nothing if reason is None else reason.cast("string")).alias("reason"), error.alias("error"))


def verdict_of(result: Any, assertion: str | None = None) -> tuple[bool, str | None]:
    """(passed, reason) of what a judge returned: a bool, a (bool, reason) pair, or a mapping of names to either.

    Of a mapping, the assertion named counts, or the only one that is a verdict; anything else raises.
    """
    if isinstance(result, Mapping):
        found = {k: v for k, v in result.items() if isinstance(v[0] if isinstance(v, tuple) else v, bool)}
        if assertion is not None:
            if assertion not in found:
                raise ValueError(f"no verdict named {assertion!r}; the judge returned {sorted(map(str, result))}")
            result = found[assertion]
        elif len(found) == 1:
            result = next(iter(found.values()))
        else:
            raise ValueError(f"{len(found)} verdicts and no assertion= to say which")
    passed, reason = result if isinstance(result, tuple) else (result, None)
    if not isinstance(passed, bool):
        raise ValueError(f"a verdict must be true or false, not {type(passed).__name__}")
    return passed, reason


def by_function(planned: DataFrame, judge_id: str, judge: Callable[[Any, str, Any], Any], assertion: str | None = None) -> DataFrame:
    """Judgments of a Python function of (inputs, output, expected_output), called in Arrow batches; an exception is an error of that judgment."""

    def call(inputs: Any, output: Any, expected: Any) -> tuple[bool | None, str | None, str | None]:
        try:
            passed, reason = verdict_of(judge(inputs, output, expected), assertion)
            return passed, None if reason is None else str(reason), None
        except Exception as e:  # whatever a judge raises is data here
            return None, None, f"{type(e).__name__}: {e}"[:ERROR_LENGTH]

    @F.pandas_udf("passed boolean, reason string, error string")
    def judged(inputs: pd.Series, output: pd.Series, expected: pd.Series) -> pd.DataFrame:
        clean = (None if x is None or x is pd.NA else x for x in expected)
        return pd.DataFrame([call(*row) for row in zip(inputs, output, clean)], columns=["passed", "reason", "error"]).astype({"passed": "boolean"})

    columns = [F.col(c) if c in planned.columns else F.lit(None).cast("string") for c in ("inputs", "output", "expected_output")]
    return planned.select(F.lit(judge_id).alias("judge_id"), "*", judged(*columns).alias("_v")).select("judge_id", *planned.columns, "_v.*")


def by_table(planned: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Judgments from stored verdicts (judge_id, keys, passed, reason), one row a judge; a planned judgment without one is an error.

    The k-th of several identical planned judgments takes the k-th stored one, if verdicts have an occurrence.
    """
    judges = verdicts.select("judge_id").distinct()
    if "occurrence" in verdicts.columns:
        order = Window.partitionBy(*keys).orderBy(*[c for c in ("plan_no", "repeat") if c in planned.columns] or keys)
        planned, keys = planned.withColumn("occurrence", F.row_number().over(order) - 1), [*keys, "occurrence"]
    rows = planned.crossJoin(F.broadcast(judges)).join(verdicts, ["judge_id", *keys], "left")  # one row a judge
    return rows.withColumn("error", F.when(F.col("passed").isNull(), "no verdict"))


# What a scripted judge says of an answer, for tests of the whole chain.
def scripted(name: str, output: Column, expected: Column) -> Column:
    """oracle, yes_man, no_man, exact or lenient_on_empty."""
    folded = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    oracle = (F.trim(output) != "") & folded(output).contains(folded(expected))
    return {
        "oracle": oracle,
        "yes_man": F.lit(True),
        "no_man": F.lit(False),
        "exact": F.coalesce(output == expected, F.lit(False)),
        "lenient_on_empty": oracle | (F.trim(output) == ""),
    }[name]
