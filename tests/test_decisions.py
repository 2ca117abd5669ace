"""Gates with repeats, bridges, confidence gates, juries, mutation reports and searches against brute force."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.rng import digest
from gavelframe.operators import decisions, gate, labels, mutation, panel, search
from gavelframe.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("gains", [[0.5, 0.5, -0.5, 1, 0], [1, 1, 1, -1], [1 / 3, -2 / 3, 1, 1 / 3], [], [0, 0]])
def test_sum_tails_equal_enumeration(gains):
    sizes = sorted({abs(g) for g in gains})
    counts = [sum(abs(g) == s for g in gains) for s in sizes]
    sums = [sum(s * abs(g) for s, g in zip(signs, gains)) for signs in itertools.product((1, -1), repeat=len(gains))]
    better = sum(x >= sum(gains) - 1e-9 for x in sums) / len(sums)
    worse = sum(x <= sum(gains) + 1e-9 for x in sums) / len(sums)
    assert gate.sum_tails(sizes, counts, sum(gains)) == pytest.approx((better, worse))


def test_sum_tails_of_many_cases_are_near_normal():
    exact = gate.sum_tails([0.5, 1.0], [3000, 2000], 90.0)
    rough = gate.sum_tails([0.5, 1.0, 1 / 3 + 1e-4], [3000, 2000, 1], 90.0)
    assert exact[0] == pytest.approx(rough[0], rel=0.05) and exact[0] < 0.05 < exact[1]


def test_hypergeometric_tail_of_large_arms(spark):
    row = spark.createDataFrame([(500_000, 1_000_000, 501_500, 1_000_000)], "k1 long, n1 long, k2 long, n2 long").select(*gate.hypergeometric_tail("k1", "n1", "k2", "n2")).first()
    z = 1500 / math.sqrt(2_000_000 / 4)
    assert row[0] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=0.02) and row[0] + row[1] == pytest.approx(1, abs=1e-3)


def test_poisson_weights_have_the_right_moments(spark):
    kinds = spark.createDataFrame([("a", 3), ("b", 60), ("c", 5000)], "kind string, n long")
    got = resample.weights(kinds, "kind", "n", 2000, "t").groupBy("kind", "n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    for r in got:
        assert r.m == pytest.approx(r.n, rel=0.06) and r.v == pytest.approx(r.n, rel=0.15)
    half = resample.subsets(kinds, "kind", "n", 1000, "t").groupBy("kind", "n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    for r in half:
        assert r.m == pytest.approx(r.n / 2, rel=0.06) and r.v == pytest.approx(r.n / 4, rel=0.2)


def test_repeated_gate_and_identical_versions(spark):
    rng = random.Random(4)
    rows = [("same", i, 0.0, rng.choice([-0.5, 0.0, 0.0, 0.5])) for i in range(40)] + [("better", i, 0.0, rng.choice([0.0, 0.5, 1.0])) for i in range(40)]
    got = {r.g: r for r in gate.decide_repeated(spark.createDataFrame(rows, "g string, case_id long, baseline double, gain double"), ["g"], draws=300).collect()}
    assert got["better"].decision == "PROMOTE" and got["better"].low > 0 and got["same"].decision == "INCONCLUSIVE"
    limited = gate.decide_repeated(spark.createDataFrame([(1, i, 1.0 if i % 4 else -0.5) for i in range(40)], "g int, case_id long, gain double"), ["g"], max_regressions=0.1, draws=50).first()
    assert limited.decision == "REJECT" and limited.regressed == 10
    with pytest.raises(Exception, match="repeated"):
        gate.decide(spark.createDataFrame([(1, 0.5)], "g int, gain double"), ["g"]).collect()


def test_detectable_gain_of_forty_questions(spark):
    paired = spark.createDataFrame([(i, 0.5) for i in range(40)], "case_id long, baseline double")
    assert gate.for_candidates(0.05, 5) == pytest.approx(0.01)
    found = gate.detectable_gain(paired, 2, trials=60)
    assert found in (0.2, 0.25, 0.3) and gate.detectable_gain(paired, 2, trials=60, level=0.01) >= found
    assert gate.detectable_gain(paired, 1, trials=20, shifts=(0.01,)) is None


def test_refusals_and_exposure(spark):
    decided = spark.createDataFrame([("a", "PROMOTE", "f1"), ("b", "PROMOTE", "f1"), ("c", "PROMOTE", "f1"), ("d", "REJECT", "f1")], "judge_id string, decision string, fingerprint string")
    certificates = spark.createDataFrame([("a", "ADMISSIBLE", "f1"), ("b", "UNVALIDATED", "f1"), ("d", "ADMISSIBLE", "f2")], "judge_id string, verdict string, fingerprint string")
    assert {r.judge_id: r.decision for r in gate.refused(decided, certificates).collect()} == {"a": "PROMOTE", "b": "REFUSED", "c": "REFUSED", "d": "REFUSED"}


def bridge_of(spark, interactions):
    rows = [(i, j, v, 0, p) for i, x in enumerate(interactions) for j, v, p in (("old", "baseline", False), ("old", "candidate", x < 0), ("new", "baseline", False), ("new", "candidate", x > 0))]
    outcomes = spark.createDataFrame(rows, "case_id long, judge_id string, version string, repeat int, passed boolean")
    return {r.effect: r for r in gate.bridge(gate.four_rates(outcomes), margin=0.05, draws=300).collect()}


def test_bridges(spark):
    alike = bridge_of(spark, [0] * 400)["interaction"]
    assert alike.comparable == "PASS" and alike.estimate == 0
    assert bridge_of(spark, [0] * 8)["interaction"].comparable == "UNVALIDATED"  # pseudo-cases: a few that agree prove nothing
    apart = bridge_of(spark, [1] * 60 + [0] * 40)
    assert apart["interaction"].comparable == "FAIL" and apart["shift_baseline"].estimate == 0 and apart["interaction"].low > 0.3
    broken = spark.createDataFrame([(1, "old", "baseline", 0, True)], "case_id long, judge_id string, version string, repeat int, passed boolean")
    with pytest.raises(Exception, match="same number"):
        gate.bridge(gate.four_rates(broken), draws=10).collect()


def test_quotas_go_to_the_furthest_below(spark):
    sizes = {"a": 50, "b": 10, "c": 3, "d": 1}
    for total in (10, 25, 64, 100):
        quota = {s: min(2, n) for s, n in sizes.items()}
        while sum(quota.values()) < min(total, sum(sizes.values())):
            quota[min((s for s in sizes if quota[s] < sizes[s]), key=lambda s: (quota[s] / sizes[s], s))] += 1
        got = gate.quotas(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), total).collect()
        assert {r.stratum: r.quota for r in got} == quota


GATE_CASES = [("a", 0.95, True, None), ("b", 0.9, True, None), ("c", 0.85, False, None), ("d", 0.05, False, None), ("e", 0.1, True, None), ("f", 0.5, True, None), ("g", 0.6, False, None), ("h", 0.4, False, None)]


def test_confidence_gate_counts(spark):
    rows = spark.createDataFrame([(n, 0, p, y, None, g) for n, p, y, g in GATE_CASES], "case_id string, record_no int, probability double, label boolean, fallback boolean, group_id string")
    r = decisions.gate_units(decisions.first_records(rows), [(0.2, 0.8)]).first()
    assert (r.decided, r.units, r.correct, r.false_passes, r.false_fails, r.no_fallback) == (5, 8, 3, 1, 1, 3)
    assert decisions.from_confidence(0.6) == (0.2, 0.8) and len(decisions.grid()) == 20
    twice = rows.unionByName(rows.limit(1).withColumns({"label": F.lit(False), "record_no": F.lit(1)}))
    with pytest.raises(Exception, match="contradictory"):
        decisions.first_records(twice).collect()


def test_gate_status_needs_fresh_cases(spark):
    rows = spark.createDataFrame([(i, 0, 0.99 if i % 2 else 0.01, bool(i % 2), None, f"g{i // 2}") for i in range(200)], "case_id long, record_no int, probability double, label boolean, fallback boolean, group_id string")
    first = decisions.first_records(rows)
    assert decisions.gate_status(first, [(0.2, 0.8)]).first().status == "PASS"
    assert decisions.gate_status(first, [(0.2, 0.8)], chosen_on=first.limit(1)).first().status == "UNVALIDATED"
    halves = decisions.split_cases(first)
    assert halves.groupBy("unit").agg(F.count_distinct("selected").alias("n")).where("n > 1").count() == 0
    assert 95 <= halves.where("selected").count() <= 105


def test_jury_members_must_share_a_plan(spark):
    rows = [(j, c, "en", "reference", "", 0, 0, p) for j, c, p in (("a", 1, True), ("b", 1, False), ("a", 2, True))]
    df = spark.createDataFrame(rows, "judge_id string, case_id long, slice string, kind string, family string, repeat int, occurrence int, passed boolean")
    with pytest.raises(Exception, match="different plans"):
        panel.ballots(df, ["a", "b"]).collect()
    kept = panel.ballots(df, ["a", "b"], strict=False).collect()
    assert [(r.case_id, r.votes, r.truth) for r in kept] == [(1, [True, False], True)]


def test_accuracy_of_few_cases_is_exact(spark):
    rows = spark.createDataFrame([("m", c, True, True) for c in range(3)], "member string, case_id long, truth boolean, passed boolean")
    r = panel.accuracy(rows, draws=50).first()
    assert r.method == "exact" and r.low == pytest.approx(0.2924, abs=1e-3) and r.high == 1


def test_mutants_are_judged_only_where_they_can_be(spark):
    cases = spark.createDataFrame([(1, "in", "It costs 5. Yes."), (2, "in", "plain words here")], "case_id long, inputs string, output string")
    made = mutation.mutants(cases, mutation.DEFAULT, {"evidence": lambda i: F.lit("out")}, lambda i, o: ~o.contains("6"))
    states = {(r.case_id, r.mutant): r.state for r in made.collect()}
    assert states[1, "number_changed"] == "defect" and states[2, "number_changed"] == "not_applicable" and states[1, "emptied"] == "not_defect"
    originals = spark.createDataFrame([("e", 1, True), ("blind", 1, True), ("down", 1, False), ("err", 1, None)], "evaluator string, case_id long, passed boolean")
    verdicts = spark.createDataFrame([(e, m, 1, p) for e in ("e", "blind") for m, p in (("number_changed", False), ("evidence", True))], "evaluator string, mutant string, case_id long, passed boolean")
    wrong = mutation.mutants(cases, {"number_changed": mutation.DEFAULT["number_changed"]}, {"evidence": lambda i: F.lit("out")})
    got = {(r.evaluator, r.mutant, r.case_id): r.status for r in mutation.outcomes(wrong, originals, verdicts, {"blind": ("output",)}).collect()}
    assert got["e", "number_changed", 1] == "caught" and got["e", "evidence", 1] == "missed" and got["blind", "evidence", 1] == "unobservable"
    assert got["down", "evidence", 1] == "original_failed" and got["err", "number_changed", 1] == "error"


def test_ddmin_is_one_minimal_and_keeps_its_budget():
    rng = random.Random(1)
    for _ in range(60):
        parts = list(range(rng.randrange(1, 14)))
        need = [set(rng.sample(parts, rng.randrange(1, min(4, len(parts)) + 1))) for _ in range(2)]
        fools = lambda p, need=need: any(n <= set(p) for n in need)
        found = search.ddmin(parts, fools)
        assert fools(found) and all(not fools([x for x in found if x != y]) for y in found)
    calls = []
    search.ddmin(list(range(40)), lambda p: calls.append(1) or {0, 39} <= set(p), calls=10)
    assert len(calls) <= 10
    with pytest.raises(ValueError):
        search.ddmin([1, 2], lambda p: False)


def test_summary_counts_a_no_beside_a_letter_outside_ascii(spark):
    cases = spark.createDataFrame([(1, "no\u00f1co"), (2, "\u00e9no"), (3, "a_no"), (4, "Yes.")], "case_id long, output string")
    made = mutation.mutants(cases, {"yes_no_flipped": mutation.DEFAULT["yes_no_flipped"]})
    [row] = mutation.summary(made).collect()
    assert (row.defects, row.not_applicable) == (3, 1)


def test_mutant_summary_of_odd_texts_equals_its_sql(spark, tmp_path):
    texts = ["ye\u017fx", "a ye\u017f ", "YE\u017f_", "no\n", "n\u00f3 12", "\U0001f600 7.5\r\n", "9" * 38, "", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("mutant_summary", "kill_rate"):
        assert_same(spark, con, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def naive_clusters(similar, threshold):
    groups = [[i] for i in range(len(similar))]
    while len(groups) > 1:
        mean = lambda g, h: sum(similar[i][j] for i in g for j in h) / (len(g) * len(h))
        value, g, h = max((mean(g, h), g, h) for g, h in itertools.combinations(groups, 2))
        if value < threshold:
            break
        groups = [x for x in groups if x not in (g, h)] + [g + h]
    return sorted(sorted(g) for g in groups)


def test_clusters_equal_naive_average_link():
    rng = random.Random(6)
    for n in (1, 2, 6, 14):
        m = [[0.0] * n for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            m[i][j] = m[j][i] = rng.random() ** 2
        assert search.clusters(m, 0.2) == naive_clusters(m, 0.2)


def test_items_cluster_by_their_words(spark):
    rows = [(1, "refund policy denied"), (2, "refund policy wrong denied"), (3, "shipping date late"), (4, "shipping late date again"), (5, "")]
    got = {r.k: r.cluster for r in search.cluster_items(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got[5] == 5 and got[1] in (1,) and len({got[1], got[3]}) == 2


def test_attack_search_replays_the_bounds(spark):
    rows = [("j", a, i, a == "b" and i % 3 == 0) for a in "abc" for i in range(30)]
    got = {r.attack: (r.tried, r.fooled) for r in search.stress(spark.createDataFrame(rows, "judge_id string, attack string, case_id long, fooled boolean"), 30, ["judge_id"]).collect()}
    assert sum(t for t, _ in got.values()) == 30 and got["b"][0] > got["a"][0] and got["a"][1] == 0


def test_evidence_that_matters_stays(spark):
    cases = spark.createDataFrame([("x" * 50, "key", "zz")] * 5, "big string, small string, tiny string")
    trials = search.evidence_budget(cases, ["big", "small", "tiny"], lambda left: F.concat_ws(" ", *left.values()).contains("key"))
    assert [(t["component"], t["dropped"]) for t in trials] == [("big", True), ("small", False), ("tiny", True)]


def test_audits_outcomes_and_beta_intervals(spark):
    population = spark.createDataFrame([(i, i % 3 > 0) for i in range(50)], "k long, passed boolean")
    drawn = [r.k for r in labels.audit(population, population.withColumn("human", F.lit(True)), "k", 50).orderBy("k").collect()]
    assert drawn == list(range(50))
    with pytest.raises(ValueError, match="drawn rows"):
        labels.audit(population, population.limit(5).withColumn("human", F.lit(True)), "k", 4)
    with pytest.raises(KeyError):
        labels.match_outcomes(population, spark.createDataFrame([(99, True)], "k long, outcome boolean"), "k")
    cells = spark.createDataFrame([("a", 60, 20, 20, 10, 30, 10)], "g string, ps long, pf long, pm long, fs long, ff long, fm long")
    r = labels.adjusted_intervals(cells, ["g"]).first()
    point = 2 / 3 * 0.75 / (2 / 3 * 0.75 + 1 / 3 * 0.25)
    assert r.low < point < r.high and r.high - r.low < 0.3


def test_only_the_first_cases_in_hash_order_are_sorted(spark):
    """Groups larger and smaller than the budget, a missing key and a case that comes twice."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "j").alias("judge_id"), F.when(F.col("id") % 1000 == 7, "rare").otherwise("common").alias("attack"), (F.col("id") - F.col("id") % 3).alias("case_id"))
    hashed = digest("stress", F.col("case_id"))
    kept = search.first_by_hash(rows, ["judge_id", "attack"], hashed, 50)
    near = [(r.judge_id, r.attack, r.case_id) for r in kept.select("judge_id", "attack", "case_id", hashed.alias("h")).orderBy("judge_id", "attack", "h", "case_id").collect()]
    every = [(r.judge_id, r.attack, r.case_id) for r in rows.select("judge_id", "attack", "case_id", hashed.alias("h")).orderBy("judge_id", "attack", "h", "case_id").collect()]
    for group in {r[:2] for r in every}:
        a, b = [r for r in near if r[:2] == group], [r for r in every if r[:2] == group]
        assert a == b[: len(a)] and min(50, len(b)) <= len(a) < 300, group
    plan = search.stress(rows.withColumn("fooled", F.lit(True)), 50, ["judge_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_similarities_equal_cosines_pair_by_pair():
    vectors = [{f"t{(i * k) % 37}": 1 / (1 + k) for k in range(1 + i % 9)} for i in range(40)] + [{}]
    want = [[search.cosine_of(a, b) if i != j else 0.0 for j, b in enumerate(vectors)] for i, a in enumerate(vectors)]
    got = search.similarities(vectors)
    assert [[got[i][j] if i != j else 0.0 for j in range(41)] for i in range(41)] == want
    assert search.clusters(got, 0.2) == naive_clusters(got.tolist(), 0.2)
