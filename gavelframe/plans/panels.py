"""Queries over labels, juries, routing, gates and disagreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelframe.functions.rng import u01
from gavelframe.functions.stats import clopper_pearson, newcombe, rogan_gladen, wilson
from gavelframe.operators import labels, panel
from gavelframe.plans.certification import CASES, U01, cp_sql, labelled, load, symbol_share

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


# -- annotations: events as an export; a user annotates a run, sometimes again --------------
ANNOTATIONS = """ann AS (SELECT (event_id % 2000)::BIGINT AS run_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS reviewer, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'pass' WHEN 'error' THEN 'fail' ELSE 'neutral' END AS verdict, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS updated_at, event_id AS row_no FROM events),
own AS (SELECT *, CASE WHEN reviewer IS NULL THEN row_no END AS self FROM ann),
timed AS (SELECT *, count(*) FILTER (updated_at IS NULL) OVER (PARTITION BY run_id, reviewer, self) = 0 AS t FROM own),
latest AS (SELECT run_id, reviewer, verdict, row_no FROM timed QUALIFY row_number() OVER (PARTITION BY run_id, reviewer, self ORDER BY CASE WHEN t THEN updated_at END DESC NULLS LAST, row_no DESC) = 1),
votes AS (SELECT run_id, count(*) FILTER (verdict = 'pass') AS passes, count(*) FILTER (verdict = 'fail') AS fails, count(*) FILTER (verdict = 'neutral') AS neutral FROM latest GROUP BY run_id),
labels_of AS (SELECT *, CASE WHEN passes > 0 AND fails > 0 THEN 'conflict' WHEN passes > 0 THEN 'pass' WHEN fails > 0 THEN 'fail' ELSE 'neutral' END AS label FROM votes)"""


def annotations(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "pass").when(F.col("event_type") == "error", "fail").otherwise("neutral")
    return e.select((F.col("event_id") % 2000).alias("run_id"), F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 3).alias("reviewer"), verdict.alias("verdict"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("updated_at"), F.col("event_id").alias("row_no"))


@query(f"WITH {ANNOTATIONS} SELECT run_id, coalesce(reviewer::VARCHAR, 'none') AS reviewer, verdict, row_no FROM latest")
def annotation_latest(spark, sf_dir):
    return labels.latest_annotations(annotations(spark, sf_dir)).select("run_id", F.coalesce(F.col("reviewer").cast("string"), F.lit("none")).alias("reviewer"), "verdict", "row_no")


@query(f"WITH {ANNOTATIONS} SELECT * FROM labels_of")
def annotation_votes(spark, sf_dir):
    return labels.annotation_votes(labels.latest_annotations(annotations(spark, sf_dir)))


@query(f"WITH {ANNOTATIONS} SELECT CASE WHEN l.run_id IS NULL THEN 'judge_only' WHEN d.doc_id IS NULL THEN 'human_only' ELSE 'matched' END AS side, count(*) AS runs FROM (SELECT * FROM labels_of WHERE label IN ('pass', 'fail')) l FULL JOIN (SELECT doc_id FROM documents) d ON d.doc_id = l.run_id GROUP BY ALL")
def agreement_left_out(spark, sf_dir):
    human = labels.annotation_votes(labels.latest_annotations(annotations(spark, sf_dir))).where("label in ('pass', 'fail')").select("run_id", "label")
    return labels.left_out(human, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.lit(True).alias("passed")), "run_id")


@query("SELECT round(sum(abs(n)), 0)::BIGINT AS rows, count(DISTINCT run_id) AS runs, count(*) FILTER (verdict = 'neutral') AS neutral FROM (SELECT 1 AS n, event_id % 2000 AS run_id, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'pass' WHEN 'error' THEN 'fail' ELSE 'neutral' END AS verdict FROM events)")
def annotation_summary(spark, sf_dir):
    return annotations(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_distinct("run_id").alias("runs"), F.count_if(F.col("verdict") == "neutral").alias("neutral"))


# -- delayed outcomes: an order passes by price; its outcome is its status, open ones are pending
OUTCOME_ROWS = "SELECT o_orderpriority AS judge_id, o_totalprice > 150000 AS passed, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 9 = 0 AND o_totalprice > 150000 THEN NULL ELSE o_orderstatus = 'F' END AS outcome FROM orders"
CELLS = f"cells AS (SELECT judge_id, count(*) FILTER (passed AND outcome) AS ps, count(*) FILTER (passed AND NOT outcome) AS pf, count(*) FILTER (passed AND outcome IS NULL) AS pm, count(*) FILTER (NOT passed AND outcome) AS fs, count(*) FILTER (NOT passed AND NOT outcome) AS ff, count(*) FILTER (NOT passed AND outcome IS NULL) AS fm FROM ({OUTCOME_ROWS}) GROUP BY judge_id)"


def outcome_rows(spark, sf_dir):
    passed = F.col("o_totalprice") > 150000
    pending = (F.col("o_orderstatus") == "P") | ((F.col("o_orderkey") % 9 == 0) & passed)
    return load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("judge_id"), passed.alias("passed"), F.when(~pending, F.col("o_orderstatus") == "F").alias("outcome"))


def cells(spark, sf_dir):
    return labels.outcome_cells(outcome_rows(spark, sf_dir), "judge_id")


@query(f"WITH {CELLS} SELECT * FROM cells")
def outcome_cells(spark, sf_dir):
    return cells(spark, sf_dir)


WL = "greatest(0, (({k}) / ({n})::DOUBLE + 1.9208 / ({n}) - 1.96 * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE) / ({n}) + 0.9604 / (({n})::DOUBLE * ({n})))) / (1 + 3.8416 / ({n})))"
WH = "least(1, (({k}) / ({n})::DOUBLE + 1.9208 / ({n}) + 1.96 * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE) / ({n}) + 0.9604 / (({n})::DOUBLE * ({n})))) / (1 + 3.8416 / ({n})))"
GAP = CELLS + f", gap AS (SELECT *, p1 - p2 AS d, p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2) AS low, p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2) AS high FROM (SELECT *, (ps + pf) / (ps + pf + pm)::DOUBLE AS p1, (fs + ff) / (fs + ff + fm)::DOUBLE AS p2, {WL.format(k='ps + pf', n='ps + pf + pm')} AS l1, {WH.format(k='ps + pf', n='ps + pf + pm')} AS u1, {WL.format(k='fs + ff', n='fs + ff + fm')} AS l2, {WH.format(k='fs + ff', n='fs + ff + fm')} AS u2 FROM cells))"


@query(f"WITH {GAP} SELECT judge_id, round(d, 9) AS gap, round(low, 9) AS low, round(high, 9) AS high FROM gap")
def newcombe_gap(spark, sf_dir):
    n = cells(spark, sf_dir).withColumns({"op": F.expr("ps + pf"), "np": F.expr("ps + pf + pm"), "of": F.expr("fs + ff"), "nf": F.expr("fs + ff + fm")})
    d, low, high = newcombe("op", "np", "of", "nf")
    return n.select("judge_id", R(d).alias("gap"), R(low).alias("low"), R(high).alias("high"))


@query(f"""WITH {GAP}, b AS (SELECT *, (ps + pf + pm) / (ps + pf + pm + fs + ff + fm)::DOUBLE AS q, ps / (ps + pf)::DOUBLE AS a, fs / (fs + ff)::DOUBLE AS c FROM gap)
SELECT judge_id, round(ps / (ps + fs)::DOUBLE, 9) AS sensitivity, round(ff / (pf + ff)::DOUBLE, 9) AS specificity, round(q * a / (q * a + (1 - q) * c), 9) AS adjusted_sensitivity, round((1 - q) * (1 - c) / (q * (1 - a) + (1 - q) * (1 - c)), 9) AS adjusted_specificity, low > 0 OR high < 0 AS biased FROM b""")
def begg_greenes(spark, sf_dir):
    report = labels.outcome_report(cells(spark, sf_dir))
    return report.select("judge_id", *(R(F.col(c)).alias(c) for c in ("sensitivity", "specificity", "adjusted_sensitivity", "adjusted_specificity")), "biased")


@query(f"WITH {CELLS} SELECT judge_id, round(CASE WHEN ps / (ps + fs)::DOUBLE + ff / (pf + ff)::DOUBLE - 1 > 0 THEN greatest(0, least(1, ((ps + pf + pm) / (ps + pf + pm + fs + ff + fm)::DOUBLE + ff / (pf + ff)::DOUBLE - 1) / (ps / (ps + fs)::DOUBLE + ff / (pf + ff)::DOUBLE - 1))) END, 9) AS rate FROM cells")
def rogan_gladen_rate(spark, sf_dir):
    return cells(spark, sf_dir).select("judge_id", R(rogan_gladen(F.expr("(ps + pf + pm) / (ps + pf + pm + fs + ff + fm)"), F.expr("ps / (ps + fs)"), F.expr("ff / (pf + ff)"))).alias("rate"))


# -- audited pass rates ---------------------------------------------------------------------
PPI = f"WITH RECURSIVE rows AS (SELECT o_totalprice > 150000 AS passed, CASE WHEN {U01.format(chr(39) + 'audit' + chr(39) + ', o_orderkey')} < 0.05 THEN o_totalprice > 140000 + 20000 * (o_orderkey % 2) END AS human FROM orders), " + """base AS (SELECT count(*) AS total, avg(passed::INTEGER) AS q, count(human) AS n, avg(human::INTEGER) AS mh, avg(passed::INTEGER) FILTER (human IS NOT NULL) AS mj, var_samp(human::INTEGER) AS vh, var_samp(CASE WHEN human IS NOT NULL THEN passed::INTEGER END) AS vj, covar_samp(human::INTEGER, passed::INTEGER) AS c, count(*) FILTER (human AND NOT passed) AS ff, count(*) FILTER (NOT human AND passed) AS fp FROM rows),
tuned AS (SELECT *, CASE WHEN {tuned} AND vj > 0 THEN least(1, greatest(0, c / vj)) ELSE 1 END::DOUBLE AS lam FROM base),
est AS (SELECT *, mh + lam * (q - mj) AS raw, sqrt(greatest(0, 1 - n / total::DOUBLE) * (vh - 2 * lam * c + lam * lam * vj) / n) AS se FROM tuned)"""
PPI_OUT = " SELECT total, n, round(q, 9) AS judge_only, round(mh, 9) AS human_only, round(lam, 9) AS lam, round(least(1, greatest(0, raw)), 9) AS estimate, round(greatest(0, raw - 1.959963984540054 * se), 9) AS low, round(least(1, raw + 1.959963984540054 * se), 9) AS high FROM est"


def audited(spark, sf_dir):
    human = F.col("o_totalprice") > 140000 + 20000 * (F.col("o_orderkey") % 2)
    return load(spark, sf_dir, "orders").select((F.col("o_totalprice") > 150000).alias("passed"), F.when(u01("audit", F.col("o_orderkey")) < 0.05, human).alias("human"))


def _ppi(spark, sf_dir, tuned):
    return labels.ppi(audited(spark, sf_dir), tuned).select("total", "n", R(F.col("q")).alias("judge_only"), R(F.col("mh")).alias("human_only"), R(F.col("lam")).alias("lam"), R(F.col("estimate")).alias("estimate"), R(F.col("low")).alias("low"), R(F.col("high")).alias("high"))


@query(PPI.replace("{tuned}", "false") + PPI_OUT)
def ppi(spark, sf_dir):
    return _ppi(spark, sf_dir, False)


@query(PPI.replace("{tuned}", "true") + PPI_OUT)
def ppi_plus_plus(spark, sf_dir):
    return _ppi(spark, sf_dir, True)


@query(PPI.replace("{tuned}", "true") + ", " + cp_sql("SELECT ff AS k, n, 0.025 AS alpha FROM est UNION ALL SELECT fp, n, 0.025 FROM est") + " SELECT e.ff AS false_fails, e.fp AS false_passes, round(least(raw, greatest(0, q + f.low - p.high)), 9) AS exact_low, round(greatest(raw, least(1, q + f.high - p.low)), 9) AS exact_high FROM est e JOIN cp f ON f.k = e.ff JOIN cp p ON p.k = e.fp")
def ppi_exact_interval(spark, sf_dir):
    return labels.ppi_exact(labels.ppi(audited(spark, sf_dir), True)).select("false_fails", "false_passes", R(F.col("exact_low")).alias("exact_low"), R(F.col("exact_high")).alias("exact_high"))


@query(f"SELECT lang, count(*) AS drawn, substr(sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 16) AS sample_digest FROM documents WHERE {U01.format(chr(39) + 'sample' + chr(39) + ', doc_id')} < 0.1 GROUP BY lang")
def audit_sample(spark, sf_dir):
    drawn = load(spark, sf_dir, "documents").where(u01("sample", F.col("doc_id")) < 0.1)
    return drawn.groupBy("lang").agg(F.count("*").alias("drawn"), labels.fingerprint(F.col("doc_id").cast("string")).alias("sample_digest"))


# -- juries: three deterministic raters over documents --------------------------------------
VOTES = "jury AS (SELECT doc_id AS case_id, source, [CASE WHEN doc_id % 17 <> 0 THEN n_chars >= 800 END, n_chars >= 1200, CASE WHEN doc_id % 23 <> 0 THEN doc_id % 3 <> 0 END] AS votes, n_chars >= 1000 AS truth FROM documents), counted AS (SELECT *, len(list_filter(votes, lambda v: v)) AS p, len(list_filter(votes, lambda v: NOT v)) AS f FROM jury)"


def votes(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id")
    return load(spark, sf_dir, "documents").select(i.alias("case_id"), "source", F.array(F.when(i % 17 != 0, n >= 800), n >= 1200, F.when(i % 23 != 0, i % 3 != 0)).alias("votes"), (n >= 1000).alias("truth"))


@query(f"WITH {VOTES} SELECT case_id, array_to_string(list_transform(votes, lambda v: CASE WHEN v IS NULL THEN '?' WHEN v THEN 'P' ELSE 'F' END), '') AS code, coalesce((CASE WHEN p + f < 2 THEN NULL WHEN p <> f THEN p > f ELSE false END)::VARCHAR, 'none') AS majority, coalesce((CASE WHEN f > 0 THEN false WHEN p + f < 2 THEN NULL ELSE true END)::VARCHAR, 'none') AS any_fail, coalesce((CASE WHEN f > 0 THEN false WHEN p + f < 2 THEN NULL WHEN p + f = 3 THEN true END)::VARCHAR, 'none') AS unanimous_pass FROM counted")
def jury_vote(spark, sf_dir):
    v = F.col("votes")
    return votes(spark, sf_dir).select("case_id", panel.vote_code(v).alias("code"), *(F.coalesce(panel.jury_verdict(v, rule, 2).cast("string"), F.lit("none")).alias(rule) for rule in ("majority", "any_fail", "unanimous_pass")))


@query(f"WITH {VOTES}, v AS (SELECT *, CASE WHEN p + f < 2 THEN NULL WHEN p <> f THEN p > f ELSE false END AS jury FROM counted) SELECT source, count(*) FILTER (votes[1] <> truth AND jury = truth) AS fixed, count(*) FILTER (votes[1] <> truth AND jury <> truth) AS inherited, count(*) FILTER (votes[1] = truth AND jury <> truth) AS introduced FROM v GROUP BY source")
def jury_effect(spark, sf_dir):
    rows = votes(spark, sf_dir).withColumn("jury", panel.jury_verdict(F.col("votes"), "majority", 2)).withColumn("one", F.get("votes", F.lit(0)))
    wrong, jury_wrong = F.col("one") != F.col("truth"), F.col("jury") != F.col("truth")
    return rows.groupBy("source").agg(F.count_if(wrong & ~jury_wrong).alias("fixed"), F.count_if(wrong & jury_wrong).alias("inherited"), F.count_if(~wrong & jury_wrong).alias("introduced"))


@query(f"WITH {VOTES} SELECT len(list_filter(votes, lambda v: v <> truth))::INTEGER AS wrong, count(*) AS cases FROM jury GROUP BY ALL")
def jury_shared_errors(spark, sf_dir):
    wrong = F.size(F.filter("votes", lambda v: F.coalesce(v != F.col("truth"), F.lit(False))))
    return votes(spark, sf_dir).groupBy(wrong.alias("wrong")).agg(F.count("*").alias("cases"))


@query(f"WITH {VOTES}, m AS (SELECT case_id, truth, unnest(votes) AS vote, unnest([0, 1, 2]) AS member FROM jury) SELECT a.member::INTEGER AS first, b.member::INTEGER AS second, count(*) FILTER (a.vote = b.vote) AS agree, count(*) FILTER (a.vote IS NOT NULL AND b.vote IS NOT NULL) AS judged FROM m a JOIN m b ON a.case_id = b.case_id AND a.member < b.member GROUP BY ALL")
def jury_pairs(spark, sf_dir):
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("first"), F.lit(j).alias("second"), F.get("votes", F.lit(i)).alias("x"), F.get("votes", F.lit(j)).alias("y")) for i in range(3) for j in range(i + 1, 3))))
    return votes(spark, sf_dir).select(pairs.alias("p")).select("p.*").groupBy("first", "second").agg(F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("judged"))


@query(f"WITH {VOTES}, r AS (SELECT *, CASE WHEN f = 0 AND p = 3 THEN true WHEN p = 0 AND f = 3 THEN false END AS agreed, CASE WHEN case_id % 31 <> 0 THEN truth END AS expensive FROM counted) SELECT source, count(*) AS total, count(*) FILTER (agreed IS NULL) AS escalated, count(*) FILTER (coalesce(agreed, expensive) = truth) AS routed_right, count(*) FILTER (votes[1] = truth) AS alone_right, count(*) FILTER (agreed <> truth) AS confident_wrong, count(*) FILTER (agreed IS NULL AND votes[1] IS DISTINCT FROM truth) AS caught, count(*) FILTER (agreed IS NULL AND expensive IS NULL) AS unresolved FROM r GROUP BY source")
def routing_replay(spark, sf_dir):
    rows = votes(spark, sf_dir).withColumn("agreed", panel.unanimous(F.col("votes"))).withColumn("expensive", F.when(F.col("case_id") % 31 != 0, F.col("truth"))).withColumn("one", F.get("votes", F.lit(0)))
    up, t = F.col("agreed").isNull(), F.col("truth")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(up).alias("escalated"), F.count_if(F.coalesce("agreed", "expensive") == t).alias("routed_right"), F.count_if(F.col("one") == t).alias("alone_right"), F.count_if(F.col("agreed") != t).alias("confident_wrong"), F.count_if(up & ~F.col("one").eqNullSafe(t)).alias("caught"), F.count_if(up & F.col("expensive").isNull()).alias("unresolved"))


# -- confidence gates -----------------------------------------------------------------------
GATE = f"gate AS (SELECT doc_id, source, least(1, greatest(0, n_chars / 2000.0 + 0.3 * ({U01.format(chr(39) + 'p' + chr(39) + ', doc_id')} - 0.5)))::DOUBLE AS p, n_chars >= 1000 AS label FROM documents), grid AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS high, round(0.5 - 0.05 * i, 2)::DOUBLE AS low FROM range(10) t(i)), made AS (SELECT high, low, source, label, CASE WHEN p >= high THEN 'pass' WHEN p <= low THEN 'fail' ELSE 'defer' END AS d FROM gate, grid)"


def gate_cases(spark, sf_dir):
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n_chars") / 2000.0 + 0.3 * (u01("p", F.col("doc_id")) - 0.5)))
    grid = F.explode(F.array(*(F.struct(F.lit(round(0.5 + 0.05 * i, 2)).alias("high"), F.lit(round(0.5 - 0.05 * i, 2)).alias("low")) for i in range(10))))
    return load(spark, sf_dir, "documents").select("doc_id", "source", p.alias("p"), (F.col("n_chars") >= 1000).alias("label")).withColumn("g", grid).select("*", "g.high", "g.low")


DECISION = ("p", "low", "high")
TALLY = GATE + ", tally AS (SELECT high, low, count(*) FILTER (d <> 'defer') AS decided, count(*) FILTER (d = 'defer') AS deferred, count(*) FILTER (d <> 'defer' AND (d = 'pass') = label) AS correct, count(*) FILTER (d = 'pass' AND NOT label) AS false_passes, count(*) FILTER (d = 'fail' AND label) AS false_fails FROM made GROUP BY ALL)"


def tally(spark, sf_dir):
    return panel.gate_tally(gate_cases(spark, sf_dir), ["high", "low"], panel.gate_decide(*map(F.col, DECISION)), F.col("label"))


@query(f"WITH {TALLY} SELECT * FROM tally")
def conf_gate_report(spark, sf_dir):
    return tally(spark, sf_dir)


@query(f"WITH {GATE}, per AS (SELECT high, low, source, count(*) FILTER (d <> 'defer') AS made, count(*) FILTER (d <> 'defer' AND (d = 'pass') = label) AS right_ones, count(*) AS n FROM made GROUP BY ALL) SELECT high, low, count(*) FILTER (made > 0) AS units_decided, count(*) FILTER (made > 0 AND made = right_ones) AS units_correct, count(*) FILTER (made = n) AS units_full FROM per GROUP BY ALL")
def conf_gate_units(spark, sf_dir):
    return panel.unit_tally(gate_cases(spark, sf_dir), ["high", "low"], "source", panel.gate_decide(*map(F.col, DECISION)), F.col("label"))


CHOICE = "WITH RECURSIVE " + TALLY.replace("gate AS", "gate AS", 1) + ", " + cp_sql("SELECT correct AS k, decided AS n, 0.05 AS alpha FROM tally") + ", bounded AS (SELECT t.*, c.low AS bound FROM tally t JOIN cp c ON c.k = correct AND c.n = decided)"


def bounded(spark, sf_dir):
    rows = tally(spark, sf_dir)
    return rows.withColumn("bound", clopper_pearson("correct", "decided")[0])


@query(CHOICE + " SELECT high, low, decided, correct, round(bound, 9) AS bound FROM bounded WHERE bound >= 0.9 ORDER BY decided DESC, correct / decided DESC, high LIMIT 1")
def conf_gate_choose(spark, sf_dir):
    ok = bounded(spark, sf_dir).where("bound >= 0.9")
    return ok.orderBy(F.desc("decided"), F.desc(F.col("correct") / F.col("decided")), "high").limit(1).select("high", "low", "decided", "correct", R(F.col("bound")).alias("bound"))


@query(CHOICE + ", seq AS (SELECT *, min(CASE WHEN bound >= 0.9 THEN 1 ELSE 0 END) OVER (ORDER BY high DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM bounded) SELECT high, low, decided, round(bound, 9) AS bound, alive = 1 AS accepted FROM seq")
def conf_gate_fixed_sequence(spark, sf_dir):
    w = Window.orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, 0)  # one row a gate
    return bounded(spark, sf_dir).select("high", "low", "decided", R(F.col("bound")).alias("bound"), (F.min((F.col("bound") >= 0.9).cast("int")).over(w) == 1).alias("accepted"))


# -- pairs in both orders -------------------------------------------------------------------
PAIRS = f"pres AS (SELECT p_partkey AS pair_no, p_partkey AS case_id, b AS better_first, CASE WHEN p_partkey % 29 = 0 AND b THEN NULL ELSE {U01.format(chr(39) + 'pair' + chr(39) + ', p_partkey')} < 0.7 OR (b AND {U01.format(chr(39) + 'pos' + chr(39) + ', p_partkey')} < 0.3) END AS passed FROM part, (VALUES (true), (false)) t(b))"


def presented(spark, sf_dir):
    k, b = F.col("p_partkey"), F.col("better_first")
    rows = load(spark, sf_dir, "part").select(k, F.explode(F.array(F.lit(True), F.lit(False))).alias("better_first"))
    passed = F.when(~((k % 29 == 0) & b), (u01("pair", k) < 0.7) | (b & (u01("pos", k) < 0.3)))
    return rows.select(k.alias("pair_no"), k.alias("case_id"), "better_first", passed.alias("passed"))


@query(f"WITH {PAIRS}, per AS (SELECT case_id, bool_or(passed) FILTER (better_first = (pair_no % 2 = 0)) AS counted, bool_or(passed) FILTER (better_first) AS a, bool_or(passed) FILTER (NOT better_first) AS b FROM pres GROUP BY case_id) SELECT count(*) FILTER (counted) AS right, count(counted) AS trials, count(*) FILTER (a = b) AS consistent, count(*) FILTER (a <> b) AS flipped, count(*) FILTER (a AND NOT b) AS flipped_to_first FROM per")
def pairwise_consistency(spark, sf_dir):
    return panel.order_consistency(presented(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT round(avg((better_first = passed)::INTEGER), 9) AS first_position, count(passed) AS presentations FROM pres")
def first_position(spark, sf_dir):
    return presented(spark, sf_dir).agg(R(F.avg((F.col("better_first") == F.col("passed")).cast("int"))).alias("first_position"), F.count("passed").alias("presentations"))


# -- disagreement: four raters, two of them twice -------------------------------------------
RATINGS = "ratings AS (SELECT doc_id AS item, r AS rater, CASE r WHEN 'short' THEN n_chars < 3000 WHEN 'long' THEN n_chars > 700 WHEN 'even' THEN (doc_id + k) % 4 < 2 ELSE CASE WHEN doc_id % 13 <> 0 THEN n_chars > 1000 END END AS passed FROM documents, (VALUES ('short', 0), ('long', 0), ('even', 0), ('even', 1), ('none', 0)) t(r, k)), per AS (SELECT item, rater, count(*) FILTER (passed) AS p, count(*) AS n FROM ratings WHERE passed IS NOT NULL GROUP BY ALL), v AS (SELECT *, CASE WHEN 2 * p > n THEN 1.0 WHEN 2 * p = n THEN 0.5 ELSE 0.0 END::DOUBLE AS vote FROM per), items AS (SELECT item, sum(n)::BIGINT AS votes, sum(p)::BIGINT AS passes, avg(vote) AS share, avg((p > 0 AND p < n)::INTEGER) AS instability, count(*) FILTER (vote = 1) AS yes, count(*) FILTER (vote = 0) AS no FROM v GROUP BY item)"


def ratings(spark, sf_dir):
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.lit(k).alias("k")) for r, k in (("short", 0), ("long", 0), ("even", 0), ("even", 1), ("none", 0)))))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "n_chars", kinds.alias("x")).select("*", "x.rater", "x.k")
    n, i, r = F.col("n_chars"), F.col("item"), F.col("rater")
    return rows.select("item", "rater", F.when(r == "short", n < 3000).when(r == "long", n > 700).when(r == "even", (i + F.col("k")) % 4 < 2).when(i % 13 != 0, n > 1000).alias("passed"))


@query(f"WITH {RATINGS} SELECT item, votes, passes, 2 * least(share, 1 - share) AS split, instability, yes > 0 AND no > 0 AS between, instability > 0 AS within, coalesce((SELECT count(*) FROM v WHERE v.item = items.item AND yes <> no AND vote = CASE WHEN yes < no THEN 1 ELSE 0 END), 0) AS minority FROM items")
def contested_items(spark, sf_dir):
    return panel.contested(ratings(spark, sf_dir)).withColumn("minority", F.size("minority").cast("long"))


@query(f"WITH {RATINGS} SELECT rater, count(*) FILTER (yes <> no AND vote = CASE WHEN yes < no THEN 1 ELSE 0 END) AS minority, count(*) AS rated FROM v JOIN items USING (item) GROUP BY rater")
def rater_outliers(spark, sf_dir):
    return panel.outliers(ratings(spark, sf_dir))


# -- richer verdicts ------------------------------------------------------------------------
@query("SELECT l_returnflag AS role, count(*) AS judgments, count(*) FILTER (len(list_filter(cited, lambda c: NOT list_contains(known, c))) = 0) AS valid, count(*) FILTER (len(list_filter(cited, lambda c: list_contains(known, c))) > 0) AS supported FROM (SELECT l_returnflag, [l_linenumber, l_suppkey % 7] AS cited, range(1, 5) AS known FROM lineitem) GROUP BY ALL")
def citations(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), F.array(F.col("l_linenumber").cast("long"), (F.col("l_suppkey") % 7).cast("long")).alias("cited"), F.array(*(F.lit(i).cast("long") for i in range(1, 5))).alias("known"))
    return rows.groupBy("role").agg(F.count("*").alias("judgments"), F.count_if(F.size(F.array_except("cited", "known")) == 0).alias("valid"), F.count_if(F.size(F.array_intersect("cited", "known")) > 0).alias("supported"))


ABSTAIN = "SELECT CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'must_fail' ELSE 'must_abstain' END AS role, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'abstain' WHEN o_totalprice > 150000 THEN 'pass' ELSE 'fail' END AS decision FROM orders"


@query(f"SELECT count(*) FILTER (role <> 'must_abstain' AND decision <> 'abstain') AS decided, count(*) FILTER (role <> 'must_abstain') AS decidable, count(*) FILTER (role = 'good' AND decision = 'pass' OR role = 'must_fail' AND decision = 'fail') AS right, count(*) FILTER (role = 'must_abstain' AND decision = 'abstain') AS abstained, count(*) FILTER (role = 'must_abstain') AS must_abstain, count(*) FILTER (decision = 'abstain') AS all_abstained FROM ({ABSTAIN})")
def abstention(spark, sf_dir):
    role = F.when(F.col("o_orderstatus") == "F", "good").when(F.col("o_orderstatus") == "O", "must_fail").otherwise("must_abstain")
    decision = F.when(F.col("o_orderpriority") == "3-MEDIUM", "abstain").when(F.col("o_totalprice") > 150000, "pass").otherwise("fail")
    rows = load(spark, sf_dir, "orders").select(role.alias("role"), decision.alias("decision"))
    must = F.col("role") == "must_abstain"
    out = F.col("decision") == "abstain"
    right = ((F.col("role") == "good") & (F.col("decision") == "pass")) | ((F.col("role") == "must_fail") & (F.col("decision") == "fail"))
    return rows.agg(F.count_if(~must & ~out).alias("decided"), F.count_if(~must).alias("decidable"), F.count_if(right).alias("right"), F.count_if(must & out).alias("abstained"), F.count_if(must).alias("must_abstain"), F.count_if(out).alias("all_abstained"))


@query(f"WITH {CASES} SELECT slice AS turn_kind, count(*) FILTER (length(output) >= 600) AS k, count(*) AS n, round({WL.format(k='count(*) FILTER (length(output) >= 600)', n='count(*)')}, 9) AS low FROM people GROUP BY slice")
def recovery_profile(spark, sf_dir):
    rows = labelled(spark, sf_dir).groupBy(F.col("slice").alias("turn_kind")).agg(F.count_if(F.length("output") >= 600).alias("k"), F.count("*").alias("n"))
    return rows.withColumn("low", R(wilson("k", "n")[0]))


@query("""WITH c AS (SELECT source AS judge_id, count(*) AS cases, count(DISTINCT lang) AS slices, avg(n_chars) AS mean FROM documents GROUP BY source)
SELECT judge_id, r AS rule, CASE r WHEN 'cases' THEN CASE WHEN cases >= 50 THEN 'ok' WHEN cases >= 20 THEN 'warn' ELSE 'fail' END WHEN 'slices' THEN CASE WHEN slices >= 4 THEN 'ok' ELSE 'warn' END ELSE CASE WHEN mean <= 5000 THEN 'ok' ELSE 'fail' END END AS outcome FROM c, (VALUES ('cases'), ('slices'), ('length')) t(r)""")
def qualify_rules(spark, sf_dir):
    c = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("judge_id")).agg(F.count("*").alias("cases"), F.count_distinct("lang").alias("slices"), F.avg("n_chars").alias("mean"))
    rules = F.explode(F.array(F.struct(F.lit("cases").alias("rule"), F.when(F.col("cases") >= 50, "ok").when(F.col("cases") >= 20, "warn").otherwise("fail").alias("outcome")), F.struct(F.lit("slices").alias("rule"), F.when(F.col("slices") >= 4, "ok").otherwise("warn").alias("outcome")), F.struct(F.lit("length").alias("rule"), F.when(F.col("mean") <= 5000, "ok").otherwise("fail").alias("outcome"))))
    return c.select("judge_id", rules.alias("r")).select("judge_id", "r.rule", "r.outcome")


@query(f"WITH {CASES} SELECT slice, round(avg(length(regexp_replace(output, '[\\p{{L}}\\s]', '', 'g')) / length(output)) FILTER (length(output) > 0), 9) AS symbols FROM people GROUP BY slice")
def symbol_share_by_slice(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("slice").agg(R(F.avg(symbol_share(F.col("output")))).alias("symbols"))
