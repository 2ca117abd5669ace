"""Queries that end in decisions: comparisons, cited and abstaining judges, gates, juries and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.rng import u01
from gavelframe.operators import certify, decisions, panel
from gavelframe.plans.certification import FAMILIES, JUDGES, U01, cp_sql, judgments, load
from gavelframe.plans.panels import ABSTAIN, GATE, PAIRS, WH, WL, presented

Q = {}
S = {}


def query(sql):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


def R(c):
    return F.round(c, 9)


def rounded(rows, *columns):
    return rows.withColumns({c: R(F.col(c)) for c in columns})


def decided_sql(ctes: str, rows: str, keys: str = "", least: int = 10) -> str:
    """SQL twin of decisions.decide(): rows has keys, name, successes, trials, errors, threshold, alpha_fail."""
    wanted = "SELECT successes AS k, trials AS n, 0.05 AS alpha FROM chk UNION ALL SELECT successes, trials, alpha_fail FROM chk"
    status = f"CASE WHEN errors > 0.1 * (trials + errors) OR trials < {least} THEN 'UNVALIDATED' WHEN a.low >= threshold THEN 'PASS' WHEN f.high < threshold THEN 'FAIL' ELSE 'UNVALIDATED' END"
    return f"WITH RECURSIVE {ctes}, chk AS (SELECT * FROM ({rows})), {cp_sql(wanted)}, done AS (SELECT {keys} name, {status} AS status, successes::BIGINT AS successes, trials::BIGINT AS trials, errors::BIGINT AS errors, round(a.low, 9) AS low, round(a.high, 9) AS high, threshold::DOUBLE AS threshold FROM chk JOIN cp a ON a.k = successes AND a.n = trials AND a.alpha = 0.05 JOIN cp f ON f.k = successes AND f.n = trials AND f.alpha = chk.alpha_fail)"


# -- comparisons ----------------------------------------------------------------------------
PER_PAIR = PAIRS + ", per AS (SELECT case_id, bool_or(passed) FILTER (better_first = (pair_no % 2 = 0)) AS one, bool_or(passed) FILTER (better_first) AS a, bool_or(passed) FILTER (NOT better_first) AS b FROM pres GROUP BY case_id), s AS (SELECT count(*) FILTER (one) AS r, count(one) AS j, count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS c FROM per)"


@query(decided_sql(PER_PAIR, "SELECT 'accuracy' AS name, r AS successes, j AS trials, n - j AS errors, 0.8 AS threshold, 0.025::DOUBLE AS alpha_fail FROM s UNION ALL SELECT 'order_consistency', same, c, n - c, 0.9, 0.025 FROM s") + " SELECT * FROM done")
def pairwise_checks(spark, sf_dir):
    return rounded(decisions.certify_pairs(presented(spark, sf_dir).withColumn("repeat", F.lit(0))), "low", "high")


FIRST = PAIRS + f", per AS (SELECT case_id, count(*) FILTER (better_first = passed) AS k, count(passed) AS m FROM pres WHERE passed IS NOT NULL GROUP BY case_id), kinds AS (SELECT k, m, concat_ws('/', k, m) AS kind, count(*) AS n FROM per GROUP BY ALL), drawn AS ({resample.weights_sql('kinds', 'kind', 'n', 500, 'first')}), rates AS (SELECT draw, sum(k * w) / nullif(sum(m * w), 0)::DOUBLE AS r FROM drawn GROUP BY draw), v AS (SELECT list_sort(list(r)) AS v FROM rates)"


@query(f"WITH {FIRST} SELECT round((SELECT sum(k * n) / sum(m * n)::DOUBLE FROM kinds), 9) AS rate, round(v[1 + floor(0.025 * 500)::BIGINT], 9) AS low, round(v[1 + least(499, floor(0.975 * 500)::BIGINT)], 9) AS high, (SELECT sum(m * n)::BIGINT FROM kinds) AS presentations FROM v")
def first_position_interval(spark, sf_dir):
    return rounded(decisions.first_position(presented(spark, sf_dir), draws=500), "rate", "low", "high")


# -- cited verdicts: a line item cites suppliers, the items at hand are keyed by number ------
CITED = """rows AS (SELECT l_linestatus AS judge_id, CASE WHEN l_returnflag = 'N' THEN 'must_fail' ELSE 'good' END AS role, CASE WHEN l_orderkey % 40 <> 3 THEN (l_returnflag <> 'N') = (l_quantity < 48) END AS passed,
  [('s' || l_linenumber), 's' || (l_suppkey % 7)] AS cited, ['s1', 's2', 's3', 's4', 's5', 's6', 's7'] AS ids, l_partkey % 9 AS fact FROM lineitem),
checked AS (SELECT judge_id, role, passed, len(list_filter(cited, lambda c: NOT list_contains(ids, c))) = 0 AS valid, len(list_filter(cited, lambda c: list_contains(ids, c) AND contains('item ' || c || ' holds fact ' || (c[2:]::INTEGER % 9), 'fact ' || fact))) > 0 AS supported FROM rows),
s AS (SELECT judge_id, count(*) FILTER (role = 'good' AND passed) AS ak, count(*) FILTER (role = 'good' AND passed IS NOT NULL) AS an, count(*) FILTER (role = 'good' AND passed IS NULL) AS ae, count(*) FILTER (role = 'must_fail' AND NOT passed) AS rk, count(*) FILTER (role = 'must_fail' AND passed IS NOT NULL) AS rn, count(*) FILTER (role = 'must_fail' AND passed IS NULL) AS re,
  count(*) FILTER (passed IS NOT NULL AND valid) AS vk, count(*) FILTER (passed IS NOT NULL AND supported) AS sk, count(*) FILTER (passed IS NOT NULL) AS n, count(*) FILTER (passed IS NULL) AS e FROM checked GROUP BY judge_id)"""
CITED_CHECKS = "SELECT judge_id, 'acceptance' AS name, ak AS successes, an AS trials, ae AS errors, 0.7 AS threshold, 0.05 / 4::DOUBLE AS alpha_fail FROM s UNION ALL SELECT judge_id, 'rejection', rk, rn, re, 0.8, 0.05 / 4::DOUBLE FROM s UNION ALL SELECT judge_id, 'citation_validity', vk, n, e, 0.9, 0.05 / 4::DOUBLE FROM s UNION ALL SELECT judge_id, 'citation_support', sk, n, e, 0.8, 0.05 / 4::DOUBLE FROM s"


@query(decided_sql(CITED, CITED_CHECKS, "judge_id,") + " SELECT * FROM done")
def citation_checks(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    good = F.col("l_returnflag") != "N"
    passed = F.when(F.col("l_orderkey") % 40 != 3, good == (F.col("l_quantity") < 48))
    ids = [f"s{i}" for i in range(1, 8)]
    items = F.create_map(*(F.lit(x) for i in ids for x in (i, f"item {i} holds fact {int(i[1:]) % 9}")))
    rows = li.select(F.col("l_linestatus").alias("judge_id"), F.when(good, "good").otherwise("must_fail").alias("role"), passed.alias("passed"), F.array(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string"))).alias("cited"), items.alias("items"), F.array(F.concat(F.lit("fact "), (F.col("l_partkey") % 9).cast("string"))).alias("facts"))
    checked = decisions.citation_facts(rows, F.col("facts"))
    return rounded(decisions.certify_citations(checked, ("judge_id",)), "low", "high")


ABSTAINED = f"rows AS ({ABSTAIN}), s AS (SELECT count(*) FILTER (role <> 'must_abstain' AND decision <> 'abstain') AS d, count(*) FILTER (role <> 'must_abstain') AS n, count(*) FILTER (role = 'good' AND decision = 'pass' OR role = 'must_fail' AND decision = 'fail') AS r, count(*) FILTER (role = 'must_abstain' AND decision = 'abstain') AS h, count(*) FILTER (role = 'must_abstain') AS m, count(*) FILTER (decision = 'abstain') AS a FROM rows)"


@query(decided_sql(ABSTAINED, "SELECT 'coverage' AS name, d AS successes, n AS trials, 0 AS errors, 0.8 AS threshold, 0.05 / 4::DOUBLE AS alpha_fail FROM s UNION ALL SELECT 'decided_accuracy', r, d, 0, 0.8, 0.05 / 4::DOUBLE FROM s UNION ALL SELECT 'abstention_recall', h, m, 0, 0.8, 0.05 / 4::DOUBLE FROM s UNION ALL SELECT 'abstention_precision', h, a, 0, 0.8, 0.05 / 4::DOUBLE FROM s") + " SELECT * FROM done")
def abstention_checks(spark, sf_dir):
    role = F.when(F.col("o_orderstatus") == "F", "good").when(F.col("o_orderstatus") == "O", "must_fail").otherwise("must_abstain")
    decision = F.when(F.col("o_orderpriority") == "3-MEDIUM", "abstain").when(F.col("o_totalprice") > 150000, "pass").otherwise("fail")
    rows = load(spark, sf_dir, "orders").select(role.alias("role"), decision.alias("decision"), F.lit(None).cast("string").alias("reason"))
    return rounded(decisions.certify_abstention(rows), "low", "high")


# -- confidence gates: a source of documents is a group -------------------------------------
UNITS = GATE.split(", grid AS")[0] + """, grid AS (SELECT round(0.5 - 0.5 * c, 12)::DOUBLE AS low, round(0.5 + c * 0.5, 12)::DOUBLE AS high FROM (SELECT i * 0.05 AS c FROM range(20) t(i))),
fb AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NOT label ELSE label END AS fallback, 'case ' || doc_id AS unit FROM gate),
made AS (SELECT low, high, unit, label, fallback, CASE WHEN p >= high THEN true WHEN p <= low THEN false END AS d FROM fb, grid),
per AS (SELECT low, high, unit, count(d) AS made, count(*) AS n, count(*) FILTER (d = label) AS r, count(*) FILTER (coalesce(d, fallback) = label) AS e FROM made GROUP BY ALL),
g AS (SELECT low, high, count(*) AS units, count(*) FILTER (made > 0) AS decided, count(*) FILTER (made > 0 AND made = r) AS correct, count(*) FILTER (made = n) AS full_units, count(*) FILTER (e = n) AS end_correct, sum(made)::BIGINT AS outputs FROM per GROUP BY ALL)"""


def gate_records(spark, sf_dir):
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n_chars") / 2000.0 + 0.3 * (u01("p", F.col("doc_id")) - 0.5)))
    label = F.col("n_chars") >= 1000
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("case_id"), F.lit(0).alias("record_no"), p.alias("probability"), label.alias("label"), F.when(F.col("doc_id") % 5 == 0, ~label).otherwise(label).alias("fallback"), F.lit(None).cast("string").alias("group_id"))


@query(decided_sql(UNITS, "SELECT low AS gate_low, high AS gate_high, 'auto_accuracy' AS name, correct AS successes, decided AS trials, 0 AS errors, 0.9 AS threshold, 0.05 / 3::DOUBLE AS alpha_fail FROM g UNION ALL SELECT low, high, 'coverage', full_units, units, 0, 0.5, 0.05 / 3::DOUBLE FROM g UNION ALL SELECT low, high, 'end_to_end', end_correct, units, 0, 0.85, 0.05 / 3::DOUBLE FROM g", "gate_low, gate_high,") + " SELECT * FROM done")
def gate_checks(spark, sf_dir):
    first = decisions.first_records(gate_records(spark, sf_dir))
    return rounded(decisions.certify_gates(first, decisions.grid(), 0.9, 0.5, 0.85), "low", "high")


def gate_calibrated(spark, sf_dir):
    """A gate chosen on half of the documents, and what the other half says of it."""
    return decisions.calibrate_by_split(decisions.first_records(gate_records(spark, sf_dir)), decisions.grid(0.1))


Q["gate_calibrated"] = gate_calibrated


@query("WITH RECURSIVE " + UNITS + ", " + cp_sql("SELECT correct AS k, decided AS n, 0.05 AS alpha FROM g UNION ALL SELECT decided, decided, 0.05 FROM g") + ", t AS (SELECT g.low, g.high, decided, correct, outputs, c.low AS bound FROM g JOIN cp c ON c.k = correct AND c.n = decided JOIN cp b ON b.k = decided AND b.n = decided WHERE decided >= 10 AND b.low >= 0.9) SELECT low, high, decided, correct, round(bound, 9) AS bound, min((bound >= 0.9)::INTEGER) OVER (ORDER BY outputs, high - low DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS accepted FROM t")
def gate_sequence(spark, sf_dir):
    return rounded(decisions.fixed_sequence(decisions.first_records(gate_records(spark, sf_dir)), decisions.grid()), "bound")


# -- a jury of the style judges, on their own certification plan ----------------------------
NAMES = [n for n, _ in JUDGES]
SLOTS = FAMILIES + ", slots AS (SELECT case_id, slice, kind, family, repeat, [max(passed) FILTER (judge_id = 'lenient'), max(passed) FILTER (judge_id = 'strict'), max(passed) FILTER (judge_id = 'style')] AS votes, CASE WHEN kind = 'reference' AND repeat = 0 OR kind = 'must_hold' THEN true WHEN kind = 'must_fail' THEN false WHEN kind = 'human' THEN family = '1' END AS truth FROM judgments GROUP BY ALL), counted AS (SELECT *, len(list_filter(votes, lambda v: v)) AS p, len(list_filter(votes, lambda v: NOT v)) AS f FROM slots), voted AS (SELECT *, CASE WHEN p + f < 2 THEN NULL WHEN p <> f THEN p > f ELSE false END AS jury FROM counted)"


def slots(spark, sf_dir):
    return panel.ballots(judgments(spark, sf_dir).withColumn("occurrence", F.lit(0)), NAMES)


def majority_of():
    return panel.jury_verdict(F.col("votes"), "majority", 2)


@query(f"WITH {SLOTS} SELECT kind, family, count(*) FILTER (jury) AS passes, count(jury) AS trials, count(*) FILTER (jury IS NULL) AS undecided FROM voted GROUP BY ALL")
def jury_slots(spark, sf_dir):
    rows = panel.jury_judgments(slots(spark, sf_dir), "jury", "majority", 2)
    return rows.groupBy("kind", "family").agg(F.count_if("passed").alias("passes"), F.count("passed").alias("trials"), F.count_if(F.col("passed").isNull()).alias("undecided"))


def jury_certificate(spark, sf_dir):
    """The jury's certificate from its members' judgments."""
    return rounded(certify.checks(panel.jury_judgments(slots(spark, sf_dir), "jury", "majority", 2), draws=200), "low", "high", "estimate")


Q["jury_certificate"] = jury_certificate
MEMBERS = SLOTS + ", m AS (SELECT case_id, truth, jury, unnest(['lenient', 'strict', 'style']) AS member, unnest(votes) AS mine FROM voted WHERE truth IS NOT NULL)"
ACCURACY = MEMBERS + f", every AS (SELECT member, case_id, truth, mine AS v FROM m UNION ALL SELECT 'jury', case_id, truth, jury FROM voted WHERE truth IS NOT NULL), per AS (SELECT member, case_id, count(*) FILTER (v = truth) AS r, count(*) AS k FROM every WHERE v IS NOT NULL GROUP BY ALL), kinds AS (SELECT member, r, k, concat_ws('/', r, k) AS kind, count(*) AS n FROM per GROUP BY ALL), drawn AS ({resample.weights_sql('kinds', 'kind', 'n', 300, 'accuracy')}), rates AS (SELECT member, draw, sum(r * w) / nullif(sum(k * w), 0)::DOUBLE AS rate FROM drawn GROUP BY ALL), boot AS (SELECT member, list_sort(list(rate)) AS v FROM rates GROUP BY member), total AS (SELECT member, sum(r * n)::BIGINT AS correct, sum(k * n)::BIGINT AS judged, sum(n)::BIGINT AS cases, coalesce(sum(n) FILTER (r = k), 0)::BIGINT AS cases_all_right FROM kinds GROUP BY member)"


@query(f"WITH {ACCURACY} SELECT member, correct, judged, round(correct / judged::DOUBLE, 9) AS rate, round(v[1 + floor(0.025 * 300)::BIGINT], 9) AS low, round(v[1 + least(299, floor(0.975 * 300)::BIGINT)], 9) AS high, cases, cases_all_right, round({WL.format(k='cases_all_right', n='cases')}, 9) AS cases_low, round({WH.format(k='cases_all_right', n='cases')}, 9) AS cases_high FROM total JOIN boot USING (member)")
def jury_accuracy(spark, sf_dir):
    rows = panel.accuracy(panel._long(slots(spark, sf_dir), NAMES, majority_of()), draws=300)
    return rounded(rows, "rate", "low", "high", "cases_low", "cases_high").drop("method")


@query(f"WITH {MEMBERS} SELECT member, count(*) FILTER (mine <> truth AND jury = truth) AS fixed, count(*) FILTER (mine <> truth AND jury <> truth) AS inherited, count(*) FILTER (mine = truth AND jury <> truth) AS introduced FROM m WHERE mine IS NOT NULL AND jury IS NOT NULL GROUP BY member")
def jury_effects(spark, sf_dir):
    return panel.member_effects(slots(spark, sf_dir), NAMES, majority_of())


@query(f"WITH {SLOTS}, x AS (SELECT unnest([('lenient', 'strict', votes[1], votes[2]), ('lenient', 'style', votes[1], votes[3]), ('strict', 'style', votes[2], votes[3])]) AS t FROM slots), c AS (SELECT t[1] AS first, t[2] AS second, t[3] AS a, t[4] AS b FROM x WHERE t[3] IS NOT NULL AND t[4] IS NOT NULL), s AS (SELECT first, second, count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a) / count(*)::DOUBLE AS pa, count(*) FILTER (b) / count(*)::DOUBLE AS pb FROM c GROUP BY ALL) SELECT first, second, n, agree, round((agree / n::DOUBLE - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM s")
def jury_agreement(spark, sf_dir):
    return rounded(panel.member_pairs(slots(spark, sf_dir), NAMES), "kappa")


@query(f"WITH {SLOTS} SELECT case_id, kind, family, repeat, truth, array_to_string(list_transform(votes, lambda v: CASE WHEN v IS NULL THEN '?' WHEN v THEN 'P' ELSE 'F' END), '') AS code, jury::VARCHAR AS jury FROM voted WHERE truth IS NOT NULL AND len(list_filter(votes, lambda v: v <> truth)) > 1")
def jury_blind_spots(spark, sf_dir):
    rows = panel.shared_errors(slots(spark, sf_dir), majority_of())
    return rows.select("case_id", "kind", "family", "repeat", "truth", "code", F.col("jury").cast("string").alias("jury"))


@query(f"WITH {MEMBERS}, p AS (SELECT member, case_id, avg((jury = truth)::INTEGER) - avg((mine = truth)::INTEGER) AS gain FROM m WHERE mine IS NOT NULL AND jury IS NOT NULL GROUP BY ALL) SELECT member, count(*) AS cases, round(avg(gain), 9) AS mean_gain, count(*) FILTER (gain > 1e-9) AS improved, count(*) FILTER (gain < -1e-9) AS regressed FROM p GROUP BY member")
def jury_gains(spark, sf_dir):
    rows = panel.jury_against(slots(spark, sf_dir), NAMES, majority_of(), draws=100)
    return rounded(rows, "mean_gain").select("member", "cases", "mean_gain", "improved", "regressed")


# -- routing between two cheap samples and a strong judge -----------------------------------
ROUTED = "j AS (SELECT doc_id, source, [n_chars >= 800, CASE WHEN doc_id % 17 <> 0 THEN n_chars >= 1200 END] AS samples, CASE WHEN doc_id % 31 <> 0 THEN n_chars >= 1000 + doc_id % 60 END AS expensive, n_chars >= 1000 AS truth FROM documents), r AS (SELECT *, CASE WHEN samples[1] = samples[2] THEN samples[1] END AS agreed FROM j)"


@query(f"WITH {ROUTED}, c AS (SELECT source, count(*) AS total, count(*) FILTER (agreed IS NULL) AS escalated, count(*) FILTER (coalesce(agreed, expensive) = truth) AS routed_right, count(*) FILTER (samples[1] = truth) AS alone_right, count(*) FILTER (expensive = truth) AS expensive_right, count(*) AS expensive_trials, count(*) FILTER (samples[1] <> truth AND samples[2] <> truth) AS confident_wrong, count(*) FILTER (agreed IS NULL AND samples[1] IS DISTINCT FROM truth) AS caught, count(*) FILTER (agreed IS NULL AND expensive IS NULL) AS unresolved, 2 AS k FROM r GROUP BY source) SELECT *, round({WL.format(k='routed_right', n='total')}, 9) AS low, round({WH.format(k='routed_right', n='total')}, 9) AS high, round((total * 2 + escalated * 10.0) / (total * 10.0), 9) AS relative_cost FROM c")
def routing_summary(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    samples = docs.select("doc_id", "source", F.posexplode(F.array(n >= 800, F.when(i % 17 != 0, n >= 1200))).alias("sample_no", "passed"))
    expensive = docs.select("doc_id", "source", F.when(i % 31 != 0, n >= 1000 + i % 60).alias("passed"))
    rows = panel.routed(samples, expensive, docs.select("doc_id", "source", (n >= 1000).alias("truth")), ("doc_id", "source"), 2)
    return rounded(panel.routing_summary(rows, ("source",), 1.0, 10.0), "low", "high", "relative_cost")


def routing_certificate(spark, sf_dir):
    """The certificate of asking two style judges and, where they differ, the third."""
    rows = panel.routed_judgments(slots(spark, sf_dir), "style", NAMES[:2])
    return rounded(certify.checks(rows, draws=200), "low", "high", "estimate")


Q["routing_certificate"] = routing_certificate


@query(f"WITH {ROUTED}, c AS (SELECT count(*) AS n, count(*) FILTER (samples[1] = expensive) AS agree FROM j WHERE samples[1] IS NOT NULL AND expensive IS NOT NULL) SELECT n, agree, round({WL.format(k='agree', n='n')}, 9) AS low, round({WH.format(k='agree', n='n')}, 9) AS high, n - agree AS disagree FROM c")
def hybrid_agreement(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    code = docs.select("doc_id", F.lit(0).alias("plan_no"), (n >= 800).alias("passed"))
    model = docs.select("doc_id", F.lit(0).alias("plan_no"), F.when(i % 31 != 0, n >= 1000 + i % 60).alias("passed"))
    return rounded(panel.hybrid_pairs(code, model, ("doc_id",)), "low", "high")


@query(f"WITH {ROUTED}, c AS (SELECT count(*) AS n, count(*) FILTER (e = a) AS agree, count(*) FILTER (e AND a) AS both_pass, count(*) FILTER (e AND NOT a) AS expert_only, count(*) FILTER (NOT e AND a) AS apprentice_only, count(*) FILTER (NOT e AND NOT a) AS both_fail FROM (SELECT truth AS e, samples[2] AS a FROM j) WHERE a IS NOT NULL) SELECT *, round((agree / n::DOUBLE - ((both_pass + expert_only) / n::DOUBLE * ((both_pass + apprentice_only) / n::DOUBLE) + (1 - (both_pass + expert_only) / n::DOUBLE) * (1 - (both_pass + apprentice_only) / n::DOUBLE))) / (1 - ((both_pass + expert_only) / n::DOUBLE * ((both_pass + apprentice_only) / n::DOUBLE) + (1 - (both_pass + expert_only) / n::DOUBLE) * (1 - (both_pass + apprentice_only) / n::DOUBLE))), 9) AS kappa, round({WL.format(k='agree', n='n')}, 9) AS low, round({WH.format(k='agree', n='n')}, 9) AS high FROM c")
def apprentice_agreement(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("position"), "n_chars")
    apprentice = docs.select("case_id", "position", F.when(F.col("case_id") % 17 != 0, F.col("n_chars") >= 1200).alias("passed"))
    return rounded(panel.apprentice_pairs(docs.select("case_id", "position", (F.col("n_chars") >= 1000).alias("passed")), apprentice), "kappa", "low", "high")
