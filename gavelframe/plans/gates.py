"""Gate, bridge, review and ledger queries over orders: a case is a customer, its outcomes are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.rng import u01
from gavelframe.operators import gate
from gavelframe.plans.certification import U01, load

Q = {}
S = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


def R(c):
    return F.round(c, 9)


#: Orders of a customer: the first one is the baseline, the second the candidate; it passes if its price is over 150,000, strictly or leniently by judge.
OUTCOMES = """ranked AS (SELECT o_custkey AS case_id, o_totalprice AS price, o_orderpriority AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
pairs AS (SELECT case_id, max(price) FILTER (rn = 1) AS b, max(price) FILTER (rn = 2) AS c, max(record_id) FILTER (rn = 1) AS record_id FROM ranked WHERE rn <= 2 GROUP BY case_id HAVING count(*) = 2),
judged AS (SELECT judge_id, case_id, record_id, (b > bar)::INTEGER AS baseline, (c > bar)::INTEGER AS candidate, (c > bar)::INTEGER - (b > bar)::INTEGER AS gain FROM pairs, (VALUES ('new', 180000.0::DOUBLE), ('old', 150000.0::DOUBLE)) j(judge_id, bar))"""


def outcomes(spark, sf_dir):
    """Long outcomes of both judges: judge_id, record_id, case_id, version, repeat, passed."""
    from pyspark.sql import Window

    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("record_id"), "o_orderkey")
    ranked = orders.withColumn("rn", F.row_number().over(Window.partitionBy("case_id").orderBy("o_orderkey"))).where("rn <= 2")
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy("case_id"))).where("n = 2")
    ranked = ranked.withColumn("record_id", F.max(F.when(F.col("rn") == 1, F.col("record_id"))).over(Window.partitionBy("case_id")))
    bars = F.explode(F.array(F.struct(F.lit("new").alias("judge_id"), F.lit(180000.0).alias("bar")), F.struct(F.lit("old").alias("judge_id"), F.lit(150000.0).alias("bar"))))
    return ranked.withColumn("j", bars).select("j.judge_id", "record_id", "case_id", F.when(F.col("rn") == 1, "baseline").otherwise("candidate").alias("version"), F.lit(0).alias("repeat"), (F.col("price") > F.col("j.bar")).alias("passed"))


def paired(spark, sf_dir, judge="old"):
    return gate.gains(outcomes(spark, sf_dir).where(F.col("judge_id") == judge))


def four_rates(spark, sf_dir):
    return gate.four_rates(outcomes(spark, sf_dir), ["record_id"])


def both(spark, sf_dir):
    """One row a case with the rates of both judges on both versions."""
    rate = lambda j, v: F.avg(F.when((F.col("judge_id") == j) & (F.col("version") == v), F.col("passed").cast("int"))).alias(f"{j}_{v}")
    return outcomes(spark, sf_dir).groupBy("case_id").agg(F.max("record_id").alias("record_id"), *(rate(j, v) for j in ("old", "new") for v in ("baseline", "candidate")))


@query(f"WITH {OUTCOMES} SELECT case_id, baseline::DOUBLE AS baseline, candidate::DOUBLE AS candidate, gain::DOUBLE AS gain FROM judged WHERE judge_id = 'old'")
def gate_gains(spark, sf_dir):
    return gate.guard(paired(spark, sf_dir)).select("case_id", "baseline", "candidate", "gain")


TAILS = """least(1, list_sum(list_transform(range({lo}, {hi} + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))))"""
DECIDED = """SELECT {keys} cases, mean_gain, up AS improved, down AS regressed, round(pb, 9) AS p_better, round(pw, 9) AS p_worse, CASE WHEN pw < 0.025 THEN 'REJECT' WHEN pb < 0.025 AND mean_gain > 0 THEN 'PROMOTE' ELSE 'INCONCLUSIVE' END AS decision
FROM (SELECT *, CASE WHEN up + down = 0 THEN 1 ELSE {b} END AS pb, CASE WHEN up + down = 0 THEN 1 ELSE {w} END AS pw FROM (SELECT {keys} count(*) AS cases, avg(gain) AS mean_gain, count(*) FILTER (gain > 0) AS up, count(*) FILTER (gain < 0) AS down FROM judged {where} GROUP BY ALL))"""
TB, TW = TAILS.format(lo="up", hi="up + down"), TAILS.format(lo="0", hi="up")


@query(f"WITH {OUTCOMES} " + DECIDED.format(keys="judge_id,", b=TB, w=TW, where=""))
def gate_signflip_exact(spark, sf_dir):
    rows = paired(spark, sf_dir, "old").withColumn("judge_id", F.lit("old")).unionByName(paired(spark, sf_dir, "new").withColumn("judge_id", F.lit("new")))
    return gate.decide(rows, ["judge_id"]).withColumns({"p_better": R(F.col("p_better")), "p_worse": R(F.col("p_worse"))})


@query(f"""WITH arms AS (SELECT count(*) FILTER (NOT c AND p) AS k1, count(*) FILTER (NOT c) AS n1, count(*) FILTER (c AND p) AS k2, count(*) FILTER (c) AS n2 FROM (SELECT {U01.format("'arm', o_orderkey")} < 0.5 AS c, o_totalprice > 150000 AS p FROM orders)),
t AS (SELECT *, list_transform(range(greatest(0, k1 + k2 - n1), least(k1 + k2, n2) + 1), lambda i: struct_pack(i := i, p := exp(lgamma(k1 + k2 + 1) - lgamma(i + 1) - lgamma(k1 + k2 - i + 1) + lgamma(n1 + n2 - k1 - k2 + 1) - lgamma(n2 - i + 1) - lgamma(n1 - k1 - k2 + i + 1) - lgamma(n1 + n2 + 1) + lgamma(n2 + 1) + lgamma(n1 + 1)))) AS ps FROM arms)
SELECT k1, n1, k2, n2, round(least(1, list_sum(list_transform(list_filter(ps, lambda x: x.i >= k2), lambda x: x.p))), 9) AS p_better, round(least(1, list_sum(list_transform(list_filter(ps, lambda x: x.i <= k2), lambda x: x.p))), 9) AS p_worse FROM t""")
def gate_unpaired(spark, sf_dir):
    c, p = u01("arm", F.col("o_orderkey")) < 0.5, F.col("o_totalprice") > 150000
    arms = load(spark, sf_dir, "orders").agg(F.count_if(~c & p).alias("k1"), F.count_if(~c).alias("n1"), F.count_if(c & p).alias("k2"), F.count_if(c).alias("n2"))
    better, worse = gate.hypergeometric_tail("k1", "n1", "k2", "n2")
    return arms.withColumns({"p_better": R(better), "p_worse": R(worse)})


@query(f"WITH {OUTCOMES} SELECT judge_id, avg(baseline) AS baseline, avg(candidate) AS candidate, count(*) AS cases FROM judged GROUP BY judge_id")
def bridge_rates(spark, sf_dir):
    side = lambda v: F.avg(F.when(F.col("version") == v, F.col("passed").cast("int"))).alias(v)
    return outcomes(spark, sf_dir).groupBy("judge_id").agg(side("baseline"), side("candidate"), F.count_distinct("case_id").alias("cases"))


@query(f"WITH {OUTCOMES}, x AS (SELECT o.case_id, n.gain - o.gain AS i, n.baseline - o.baseline AS sb, n.candidate - o.candidate AS sc FROM judged o JOIN judged n ON o.case_id = n.case_id WHERE o.judge_id = 'old' AND n.judge_id = 'new') SELECT i::DOUBLE AS interaction, count(*) AS cases, sum(sb)::DOUBLE AS shift_baseline, sum(sc)::DOUBLE AS shift_candidate FROM x GROUP BY i")
def bridge_interaction(spark, sf_dir):
    rows = both(spark, sf_dir).select(((F.col("new_candidate") - F.col("new_baseline")) - (F.col("old_candidate") - F.col("old_baseline"))).alias("interaction"), (F.col("new_baseline") - F.col("old_baseline")).alias("b"), (F.col("new_candidate") - F.col("old_candidate")).alias("c"))
    return rows.groupBy("interaction").agg(F.count("*").alias("cases"), F.sum("b").alias("shift_baseline"), F.sum("c").alias("shift_candidate"))


@query(f"WITH {OUTCOMES}, d AS (" + DECIDED.format(keys="record_id, judge_id,", b=TB, w=TW, where="") + ") SELECT o.record_id, o.decision AS acted_on, n.decision AS now, CASE WHEN o.decision = 'PROMOTE' AND n.decision = 'REJECT' THEN 'dangerous' WHEN o.decision = 'PROMOTE' AND n.decision <> 'PROMOTE' THEN 'unsupported' WHEN o.decision <> 'PROMOTE' AND n.decision = 'PROMOTE' THEN 'missed' ELSE 'none' END AS concern FROM d o JOIN d n ON o.record_id = n.record_id WHERE o.judge_id = 'old' AND n.judge_id = 'new'")
def impact_flips(spark, sf_dir):
    return gate.impact(four_rates(spark, sf_dir), ["record_id"])


STRATA = OUTCOMES + f""", l AS (SELECT o.case_id, o.gain AS stratum, n.gain AS truth, {U01.format("'review', o.case_id")} AS u FROM judged o JOIN judged n ON o.case_id = n.case_id WHERE o.judge_id = 'old' AND n.judge_id = 'new'),
strata AS (SELECT stratum, count(*) AS size, count(*) FILTER (u < 0.3) AS labelled, avg(truth) FILTER (u < 0.3) AS mean, sum(truth * truth) FILTER (u < 0.3) AS sum_squares FROM l GROUP BY stratum)"""


def strata(spark, sf_dir):
    rows = both(spark, sf_dir).select(F.col("case_id"), (F.col("old_candidate") - F.col("old_baseline")).alias("stratum"), (F.col("new_candidate") - F.col("new_baseline")).alias("truth"))
    seen = F.when(u01("review", F.col("case_id")) < 0.3, F.col("truth"))
    return rows.groupBy("stratum").agg(F.count("*").alias("size"), F.count(seen).alias("labelled"), F.avg(seen).alias("mean"), F.sum(seen * seen).alias("sum_squares"))


@query(f"WITH {STRATA} SELECT stratum::DOUBLE AS stratum, size, labelled, mean, sum_squares::DOUBLE AS sum_squares FROM strata")
def review_strata(spark, sf_dir):
    return strata(spark, sf_dir)


@query(f"WITH {STRATA}, w AS (SELECT *, size / (sum(size) OVER ())::DOUBLE AS weight, (sum_squares + 2 - (labelled * mean) * (labelled * mean) / (labelled + 2)) / (labelled + 1) AS v FROM strata) SELECT round(sum(weight * mean), 9) AS estimate, round(sum(weight * weight * (1 - labelled / size::DOUBLE) * v / labelled), 9) AS variance FROM w")
def review_estimate(spark, sf_dir):
    return gate.review_estimate(strata(spark, sf_dir)).select(R(F.col("estimate")).alias("estimate"), R(F.col("variance")).alias("variance"))


@query("WITH exposed AS (SELECT l_suppkey AS case_id, count(DISTINCT l_orderkey) AS events FROM lineitem WHERE l_quantity >= 45 GROUP BY l_suppkey) SELECT s_suppkey AS case_id, coalesce(events, 0) AS exposures, coalesce(events, 0) < 60 AS fresh FROM supplier LEFT JOIN exposed ON s_suppkey = case_id")
def ledger_fresh(spark, sf_dir):
    seen = load(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("event_no"), F.lit("optimizer").alias("by"), F.col("l_suppkey").alias("case_id"))
    return gate.fresh(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id")), seen, 59)


CONFIRM = OUTCOMES + ", exposed AS (SELECT c_custkey AS case_id FROM customer WHERE c_custkey % 50 = 7 AND c_mktsegment = 'BUILDING'), grouped AS (SELECT c_mktsegment AS segment, j.* FROM judged j JOIN customer ON c_custkey = case_id WHERE judge_id = 'old')"


@query(f"WITH {CONFIRM}, d AS (" + DECIDED.format(keys="segment,", b=TB, w=TW, where="").replace("FROM judged", "FROM grouped") + ") SELECT d.segment, d.cases, round(d.mean_gain, 9) AS mean_gain, coalesce(x.n, 0) AS exposed, CASE WHEN coalesce(x.n, 0) > 0 THEN 'REFUSED' ELSE d.decision END AS decision FROM d LEFT JOIN (SELECT segment, count(*) AS n FROM grouped WHERE case_id IN (SELECT case_id FROM exposed) GROUP BY segment) x ON x.segment = d.segment")
def ledger_confirm(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"))
    seen = customers.where("case_id % 50 = 7 and segment = 'BUILDING'").select(F.lit(1).alias("event_no"), F.lit("round 1").alias("by"), "case_id")
    rows = gate.confirm(paired(spark, sf_dir).join(customers, "case_id"), ["segment"], seen)
    return rows.select("segment", "cases", R(F.col("mean_gain")).alias("mean_gain"), "exposed", "decision")


#: Four orders a customer: two repeats a version, so gains are halves.
REPEATED = """four AS (SELECT o_custkey AS case_id, o_totalprice > 150000 AS passed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
halves AS (SELECT case_id, avg(passed::INTEGER) FILTER (rn <= 2) AS b, avg(passed::INTEGER) FILTER (rn > 2) AS c FROM four WHERE rn <= 4 GROUP BY case_id HAVING count(*) = 4),
segments AS (SELECT c_mktsegment AS segment, c - b AS gain FROM halves JOIN customer ON c_custkey = case_id),
kinds AS (SELECT segment, round(gain, 9)::DOUBLE AS gain, printf('%.9f', gain) AS kind, count(*) AS n FROM segments GROUP BY ALL)"""
#: The sign-flip distribution step by step: each case adds or takes away its gain in halves.
SIGN_SUM = """sizes AS (SELECT segment, count(*) FILTER (abs(gain) = 0.5) AS h, count(*) FILTER (abs(gain) = 1) AS o, round(2 * sum(gain))::BIGINT AS s FROM segments GROUP BY segment),
tails AS (SELECT segment, list_sum(list_transform(range(0, h + 1), lambda i: list_sum(list_transform(range(0, o + 1), lambda j: CASE WHEN (2 * i - h) + 2 * (2 * j - o) >= s THEN exp(lgamma(h + 1) - lgamma(i + 1) - lgamma(h - i + 1) + lgamma(o + 1) - lgamma(j + 1) - lgamma(o - j + 1) - (h + o) * ln(2)) ELSE 0 END)))) AS pb,
  list_sum(list_transform(range(0, h + 1), lambda i: list_sum(list_transform(range(0, o + 1), lambda j: CASE WHEN (2 * i - h) + 2 * (2 * j - o) <= s THEN exp(lgamma(h + 1) - lgamma(i + 1) - lgamma(h - i + 1) + lgamma(o + 1) - lgamma(j + 1) - lgamma(o - j + 1) - (h + o) * ln(2)) ELSE 0 END)))) AS pw FROM sizes)"""
GAIN_DRAWS = f"""drawn AS ({resample.weights_sql("kinds", "kind", "n", 500, "gain")}), means AS (SELECT segment, draw, sum(gain * w) / sum(w)::DOUBLE AS m FROM drawn GROUP BY ALL), boot AS (SELECT segment, list_sort(list(m)) AS v FROM means GROUP BY segment)"""


def repeated(spark, sf_dir):
    from pyspark.sql import Window

    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_totalprice") > 150000).alias("passed"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn"))
    four = orders.where("rn <= 4").withColumn("n", F.count("*").over(Window.partitionBy("case_id"))).where("n = 4")
    long = four.select("case_id", F.when(F.col("rn") <= 2, "baseline").otherwise("candidate").alias("version"), (F.col("rn") % 2).alias("repeat"), "passed")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"))
    return gate.guard(gate.gains(long)).join(customers, "case_id")


@query(f"WITH {REPEATED}, {SIGN_SUM}, {GAIN_DRAWS}, t AS (SELECT segment, count(*) AS cases, avg(gain) AS mean_gain, count(*) FILTER (gain > 0) AS improved, count(*) FILTER (gain < 0) AS regressed FROM segments GROUP BY segment) SELECT t.segment, cases, round(mean_gain, 9) AS mean_gain, improved, regressed, round(v[1 + floor(0.025 * 500)::BIGINT], 9) AS low, round(v[1 + least(499, floor(0.975 * 500)::BIGINT)], 9) AS high, round(least(1, pb), 9) AS p_better, round(least(1, pw), 9) AS p_worse, CASE WHEN pw < 0.025 THEN 'REJECT' WHEN pb < 0.025 AND mean_gain > 0 THEN 'PROMOTE' ELSE 'INCONCLUSIVE' END AS decision FROM t JOIN tails USING (segment) JOIN boot USING (segment)")
def gate_repeated(spark, sf_dir):
    rows = gate.decide_repeated(repeated(spark, sf_dir), ["segment"], draws=500)
    return rows.withColumns({c: R(F.col(c)) for c in ("mean_gain", "low", "high", "p_better", "p_worse")})


BRIDGE = OUTCOMES + """, x AS (SELECT n.gain - o.gain AS i, n.baseline - o.baseline AS sb, n.candidate - o.candidate AS sc FROM judged o JOIN judged n ON o.case_id = n.case_id WHERE o.judge_id = 'old' AND n.judge_id = 'new'),
long AS (SELECT 'interaction' AS effect, i::DOUBLE AS value, 2.0::DOUBLE AS bound FROM x UNION ALL SELECT 'shift_baseline', sb, 1 FROM x UNION ALL SELECT 'shift_candidate', sc, 1 FROM x),
seen AS (SELECT effect, bound, value, count(*) AS n FROM long GROUP BY ALL),
every AS (SELECT effect, bound, value, printf('%.9f', value) AS kind, sum(n)::BIGINT AS n FROM (SELECT * FROM seen UNION ALL SELECT DISTINCT effect, bound, bound, 1 FROM seen UNION ALL SELECT DISTINCT effect, bound, -bound, 1 FROM seen) GROUP BY ALL),
drawn AS (""" + resample.subsets_sql("every", "kind", "n", 400, "subset") + """),
means AS (SELECT effect, bound, draw, sum(value * w) / nullif(sum(w), 0)::DOUBLE AS m FROM drawn GROUP BY ALL),
sorted AS (SELECT effect, bound, list_sort(list(m) FILTER (m IS NOT NULL)) AS v FROM means GROUP BY ALL),
cut AS (SELECT effect, bound, v, ceil(0.025 * 401)::BIGINT - 1 - (400 - len(v)) AS need FROM sorted),
est AS (SELECT effect, count(*) AS cases, avg(value) AS estimate FROM long GROUP BY effect),
b AS (SELECT effect, cases, estimate, CASE WHEN need <= 0 OR need > len(v) THEN -bound ELSE greatest(-bound, v[need]) END AS low, CASE WHEN need <= 0 OR need > len(v) THEN bound ELSE least(bound, v[len(v) - need + 1]) END AS high FROM cut JOIN est USING (effect))"""


@query(f"WITH {BRIDGE} SELECT effect, cases, round(estimate, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN effect <> 'interaction' THEN 'none' WHEN low >= -0.05 AND high <= 0.05 THEN 'PASS' WHEN low > 0.05 OR high < -0.05 THEN 'FAIL' ELSE 'UNVALIDATED' END AS comparable FROM b")
def bridge_effects(spark, sf_dir):
    rows = gate.bridge(four_rates(spark, sf_dir), draws=400)
    return rows.withColumns({c: R(F.col(c)) for c in ("estimate", "low", "high")}).withColumn("comparable", F.coalesce("comparable", F.lit("none")))


@query(f"WITH {STRATA}, w AS (SELECT *, size / (sum(size) OVER ())::DOUBLE AS weight, (sum_squares + 2 - (labelled * mean) * (labelled * mean) / (labelled + 2)) / (labelled + 1) AS v FROM strata), e AS (SELECT sum(weight * mean) AS estimate, sqrt(sum(weight * weight * (1 - labelled / size::DOUBLE) * v / labelled)) * 2.3939797998185104 AS half, sum(labelled)::BIGINT AS labels, min(labelled) AS least FROM w) SELECT round(estimate, 9) AS estimate, round(greatest(-1, estimate - half), 9) AS low, round(least(1, estimate + half), 9) AS high, ((labels >= 10)::INTEGER + (labels >= 20)::INTEGER + (labels >= 40)::INTEGER) AS look, labels, CASE WHEN least >= 2 AND labels >= 10 AND estimate - half > 0 THEN 'PROMOTE' WHEN least >= 2 AND labels >= 10 AND estimate + half < 0 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS decision FROM e")
def review_decision(spark, sf_dir):
    rows = gate.review_decision(strata(spark, sf_dir), (10, 20, 40))
    return rows.withColumns({c: R(F.col(c)) for c in ("estimate", "low", "high")})


@query("WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), base AS (SELECT *, least(2, size) AS least FROM s), slots AS (SELECT stratum, i, i / size::DOUBLE AS level FROM base, range(0, 100) t(i) WHERE i >= least AND i < size), ranked AS (SELECT *, row_number() OVER (ORDER BY level, stratum) AS rn FROM slots) SELECT b.stratum, b.size, least + count(r.stratum) AS quota FROM base b LEFT JOIN ranked r ON r.stratum = b.stratum AND r.rn <= 40 - (SELECT sum(least) FROM base) GROUP BY b.stratum, b.size, least")
def review_quotas(spark, sf_dir):
    return gate.quotas(load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("size")), 40)


#: A customer is a state, its orders are runs, their priorities the arms.
def steering(spark, sf_dir):
    """Advice on saved states: completion of three arms, verdict against the neutral one, harm on good paths."""
    arm = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "steer").when(F.col("o_orderpriority") == "3-MEDIUM", "neutral").otherwise("silent")
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("state"), arm.alias("arm"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("completed"))
    runs = orders.groupBy("state", "arm").agg(F.min_by("completed", "o_orderkey").alias("completed"), F.count("*").alias("steps"))
    whole = runs.groupBy("state").agg(F.count_distinct("arm").alias("arms")).where("arms = 3").select("state")
    return gate.assess_steering(runs.join(whole, "state"), draws=200)


Q["steering"] = steering
