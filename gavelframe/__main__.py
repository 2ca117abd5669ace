"""python -m gavelframe SF_DIR [OUT]: certify the style judges over documents and labels.

Exit code 0: every judge is admissible; 1: one is not, or is unvalidated; 2: bad usage.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from gavelframe.operators import certify, report
from gavelframe.plans.certification import judgments
from gavelframe.sources import certificates


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("gavelframe").getOrCreate()
    decided = certify.checks(judgments(spark, args[0])).persist()
    rows = certificates.certificates(decided)
    if len(args) == 2:
        certificates.save(rows, args[1])
    rows.select("judge_id", "verdict", "failed", "open").orderBy("judge_id").show(truncate=False)
    report.diagnose(decided).orderBy("judge_id", "name").show(100, truncate=False)
    bad = rows.where("verdict <> 'ADMISSIBLE'").count()
    decided.unpersist()
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
