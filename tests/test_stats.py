"""Known answers of the statistics kernel."""

import math

import pytest
from pyspark.sql import functions as F

from gavelframe.functions import stats
from gavelframe.operators import gate, labels


def row(spark, columns, *values):
    return spark.createDataFrame([values], columns)


@pytest.mark.parametrize("k, n, low, high", [(0, 10, 0.0, 0.3085), (5, 10, 0.1871, 0.8129), (19, 20, 0.7513, None), (1000, 2000, 0.4779, 0.5221), (10, 10, 0.6915, 1.0), (37, 40, 0.7961, None), (0, 0, 0.0, 1.0)])
def test_clopper_pearson_known_values(spark, k, n, low, high):
    got = row(spark, "k long, n long", k, n).select(*(c.alias(a) for c, a in zip(stats.clopper_pearson("k", "n"), ("low", "high")))).first()
    assert got.low == pytest.approx(low, abs=1e-4)
    if high is not None:
        assert got.high == pytest.approx(high, abs=1e-4)


def test_clopper_pearson_at_large_counts_is_near_wilson(spark):
    df = row(spark, "k long, n long", 700_000, 1_000_000)
    exact = df.select(*stats.clopper_pearson("k", "n")).first()
    score = df.select(*stats.wilson("k", "n", 1.959964)).first()
    assert exact[0] == pytest.approx(score[0], abs=1e-6) and exact[1] == pytest.approx(score[1], abs=1e-6)


def test_wilson(spark):
    assert tuple(row(spark, "k long, n long", 0, 0).select(*stats.wilson("k", "n")).first()) == (0.0, 1.0)
    low, high = row(spark, "k long, n long", 67, 80).select(*stats.wilson("k", "n")).first()
    assert (round(low, 5), round(high, 5)) == (0.74157, 0.90250)


def test_kappa(spark):
    df = spark.createDataFrame([(35, 7, 6, 32), (10, 0, 0, 0), (0, 0, 0, 0)], "a long, b long, c long, d long")
    got = [r[0] for r in df.select(stats.kappa("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(0.675, abs=5e-3) and got[1:] == [None, None]


def test_sign_flip_is_the_binomial_tail(spark):
    better, worse = row(spark, "u long, d long", 8, 4).select(*gate.binomial_tail("u", "d")).first()
    assert better == pytest.approx(sum(math.comb(12, i) for i in range(8, 13)) / 2**12)
    assert worse == pytest.approx(sum(math.comb(12, i) for i in range(0, 9)) / 2**12)
    assert tuple(row(spark, "u long, d long", 0, 0).select(*gate.binomial_tail("u", "d")).first()) == (1.0, 1.0)


def test_label_permutation_is_the_hypergeometric_tail(spark):
    better, _ = row(spark, "k1 long, n1 long, k2 long, n2 long", 3, 8, 5, 7).select(*gate.hypergeometric_tail("k1", "n1", "k2", "n2")).first()
    assert better == pytest.approx(sum(math.comb(8, i) * math.comb(7, 7 - i) for i in range(5, 8)) / math.comb(15, 7))


@pytest.mark.parametrize("k, n, errors, status", [(40, 40, 0, "PASS"), (9, 9, 0, "UNVALIDATED"), (40, 40, 5, "UNVALIDATED"), (5, 40, 0, "FAIL"), (30, 40, 0, "UNVALIDATED")])
def test_decision_rule(spark, k, n, errors, status):
    got = row(spark, "s long, t long, e long, a double", k, n, errors, 0.01).select(stats.decide_check("s", "t", "e", "0.7D", "a")[0]).first()
    assert got[0] == status


def test_gate_guard_refuses_uneven_cases(spark):
    uneven = spark.createDataFrame([(1, "baseline", True), (1, "candidate", True), (1, "candidate", False)], "case_id long, version string, passed boolean")
    missing = spark.createDataFrame([(1, "baseline", True)], "case_id long, version string, passed boolean")
    for rows in (uneven, missing):
        with pytest.raises(Exception, match="same cases"):
            gate.guard(gate.gains(rows)).collect()


def test_gate_rejects_before_it_promotes(spark):
    rows = spark.createDataFrame([("better", 1)] * 9 + [("worse", -1)] * 9 + [("even", g) for g in (1, -1, 0)], "r string, gain int")
    got = {x.r: x.decision for x in gate.decide(rows, ["r"]).collect()}
    assert got == {"better": "PROMOTE", "worse": "REJECT", "even": "INCONCLUSIVE"}


def test_ppi_of_a_census_is_the_human_rate(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "passed boolean, human boolean")
    got = labels.ppi(rows, False).first()
    assert got.estimate == pytest.approx(0.5) and got.se == 0


def test_outcome_report_flags_one_blind_side(spark):
    cells = spark.createDataFrame([(0, 0, 9, 1, 5, 0)], "ps long, pf long, pm long, fs long, ff long, fm long")
    assert labels.outcome_report(cells).first().biased is True


def test_rogan_gladen_without_information(spark):
    assert row(spark, "x double", 0.5).select(stats.rogan_gladen(F.col("x"), F.lit(0.5), F.lit(0.5))).first()[0] is None
