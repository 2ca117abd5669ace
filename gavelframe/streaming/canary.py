"""A canary over a stream of known-answer checks: health of the last checks of every judge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelframe.functions.stats import wilson

KEEP = 100
OUTPUT = "judge_id string, checks long, rejected long, errors long"


def health(checks: str, rejected: str, min_checks: int = 20, min_rejection: float = 0.8):
    """HEALTHY, DRIFTING or UNKNOWN from the Wilson interval of the rejection rate."""
    low, high = wilson(rejected, checks)
    enough = F.col(checks) >= min_checks
    return F.when(enough & (low >= min_rejection), "HEALTHY").when(enough & (high < min_rejection), "DRIFTING").otherwise("UNKNOWN")


class LastChecks(StatefulProcessor):
    """Keeps the last KEEP verdicts of a judge in a list state; errors are counted apart and are no checks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "rejected boolean")
        self.errors = handle.getValueState("errors", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        errors = self.errors.get()[0] if self.errors.exists() else 0
        for part in rows:
            part = part.sort_values("seq")
            errors += int(part["rejected"].isna().sum())
            last += [bool(x) for x in part["rejected"].dropna()]
        last = last[-KEEP:]
        self.last.put([(x,) for x in last])
        self.errors.update((errors,))
        yield pd.DataFrame({"judge_id": [key[0]], "checks": [len(last)], "rejected": [sum(last)], "errors": [errors]})

    def close(self) -> None:
        pass


def canary_stream(checks: DataFrame) -> DataFrame:
    """One row a judge and batch; checks is a stream of judge_id, seq, rejected. Needs the RocksDB state store."""
    return checks.groupBy("judge_id").transformWithStateInPandas(LastChecks(), OUTPUT, outputMode="Update", timeMode="None")


def canary_window(checks: DataFrame, keep: int = KEEP) -> DataFrame:
    """The batch twin: for every check, the rejected among the last keep."""
    w = Window.partitionBy("judge_id").orderBy("seq").rowsBetween(1 - keep, 0)
    return checks.where("rejected is not null").select("judge_id", "seq", F.count("*").over(w).alias("checks"), F.count_if("rejected").over(w).alias("rejected"))


def windowed_outcomes(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling windows of a stream, late events dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def systematic(calls: DataFrame, every: int) -> DataFrame:
    """Every n-th call of a judge (judge_id, seq), counted from the first."""
    order = Window.partitionBy("judge_id").orderBy("seq")
    return calls.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") % every == 0).drop("_rn")


def with_borrowed(calls: DataFrame, keep: int = 50) -> DataFrame:
    """calls (judge_id, seq, output) with borrowed: the latest of the last keep outputs that differs from a call's own; null without one."""
    before = Window.partitionBy("judge_id").orderBy("seq").rowsBetween(-keep, -1)
    other = F.filter(F.collect_list("output").over(before), lambda o: o != F.col("output"))
    return calls.withColumn("borrowed", F.try_element_at(other, F.lit(-1)))
