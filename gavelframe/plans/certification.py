"""Certification queries over documents and labels, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.functions import resample
from gavelframe.functions.rng import u01
from gavelframe.functions.stats import clopper_pearson, wilson
from gavelframe.operators import certify, controls

#: Style judges: the largest share of symbols they let pass.
JUDGES = (("lenient", 0.2), ("strict", 0.05), ("style", 0.08))
REPEATS = 3


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("output"), F.col("lang").alias("slice"))
    return docs.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("label")), "case_id")


def known_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("label = 1").drop("label")


def symbol_share(output) -> F.Column:
    """Share of characters that are neither letters nor white space; null for an empty text."""
    return F.when(F.length(output) > 0, F.length(F.regexp_replace(output, r"[\p{L}\s]+", "")) / F.length(output))


def judge(planned: DataFrame) -> DataFrame:
    """Verdicts of all JUDGES: a text passes below the bar, with a little noise by repeat; 3 % of calls have no verdict."""
    shares = planned.withColumn("share", symbol_share(F.col("output"))).drop("output")
    bars = F.explode(F.array(*(F.struct(F.lit(n).alias("judge_id"), F.lit(b).alias("bar")) for n, b in JUDGES)))
    rows = shares.withColumn("j", bars).select("*", "j.judge_id", "j.bar")
    keys = [F.col(c) for c in ("judge_id", "case_id", "kind", "family", "repeat")]
    passed = F.coalesce(F.col("share") < F.col("bar") + 0.02 * (u01("noise", *keys) - 0.5), F.lit(False))
    return rows.select("judge_id", "case_id", "slice", "kind", "family", "repeat", F.when(u01("error", *keys) >= 0.03, passed).alias("passed"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the ones people call good are the known-good answers."""
    return labelled(spark, sf_dir).withColumn("good", F.col("label") == 1)


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return max(1, load(spark, sf_dir, "labels").where("quality = 1").count() // controls.BUCKET_ROWS)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(certify.plan_people(people(spark, sf_dir), REPEATS, controls.STYLE, buckets(spark, sf_dir)))


# -- SQL twins ------------------------------------------------------------------------------
U01 = "(('0x' || substr(sha256(concat_ws('|', {0})), 1, 13))::BIGINT / 4503599627370496.0)"
CASES = "people AS (SELECT d.doc_id AS case_id, d.text AS output, d.lang AS slice, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id), cases AS (SELECT case_id, output, slice FROM people WHERE label = 1)"
SPACES = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIPPED = f"regexp_replace(output, '^{SPACES}+|{SPACES}+$', '', 'g')"
PLAN = CASES + f""", ring AS (SELECT *, sha256('donor|' || case_id) AS h FROM cases),
dealt AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT * (SELECT greatest(1, count(*) // 4096) FROM labels WHERE quality = 1)) >> 32 AS bucket FROM ring),
candidates AS (SELECT case_id, slice, output, [lead(output, 1) OVER w, lead(output, 2) OVER w, lead(output, 3) OVER w, nth_value(output, 1) OVER a, nth_value(output, 2) OVER a, nth_value(output, 3) OVER a] AS others FROM dealt
  WINDOW w AS (PARTITION BY bucket ORDER BY h, case_id), a AS (PARTITION BY bucket ORDER BY h, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
donors AS (SELECT case_id, slice, list_filter(others, lambda o: o IS NOT NULL AND o <> output)[1] AS donor FROM candidates),
plan AS (
  SELECT case_id, slice, 'reference' AS kind, '' AS family, r::INTEGER AS repeat, output FROM cases, range(3) t(r)
  UNION ALL SELECT case_id, slice, 'must_fail', 'empty_prose', 0, '' FROM cases WHERE {STRIPPED} <> ''
  UNION ALL SELECT case_id, slice, 'must_hold', 'mismatched_output', 0, donor FROM donors WHERE donor IS NOT NULL
  UNION ALL SELECT case_id, slice, 'must_hold', 'prose_whitespace', 0, replace(output, ' ', '  ') || chr(10) FROM cases
  UNION ALL SELECT case_id, slice, 'human', label::VARCHAR, 0, output FROM people)"""
JUDGMENTS = PLAN + """, shares AS (SELECT * EXCLUDE (output), CASE WHEN length(output) > 0 THEN length(regexp_replace(output, '[\\p{L}\\s]', '', 'g')) / length(output) END AS share FROM plan),
judgments AS (SELECT judge_id, case_id, slice, kind, family, repeat, CASE WHEN %s >= 0.03 THEN coalesce(share < bar + 0.02 * (%s - 0.5), false) END AS passed
  FROM shares, (VALUES ('lenient', 0.2::DOUBLE), ('strict', 0.05::DOUBLE), ('style', 0.08::DOUBLE)) j(judge_id, bar))""" % (U01.format("'error', judge_id, case_id, kind, family, repeat"), U01.format("'noise', judge_id, case_id, kind, family, repeat"))
FAMILIES = JUDGMENTS + """, majority AS (SELECT judge_id, case_id, CASE WHEN count(passed) > 0 THEN 2 * count(*) FILTER (passed) > count(passed) END AS majority FROM judgments WHERE kind = 'reference' GROUP BY ALL),
acceptance AS (SELECT judge_id, count(*) FILTER (passed) AS successes, count(passed) AS trials, count(*) FILTER (passed IS NULL) AS errors FROM judgments WHERE kind = 'reference' AND repeat = 0 GROUP BY ALL),
rejection AS (SELECT judge_id, family, count(*) FILTER (NOT passed) AS successes, count(passed) AS trials, count(*) FILTER (passed IS NULL) AS errors FROM judgments WHERE kind = 'must_fail' GROUP BY ALL),
invariance AS (SELECT judge_id, family, count(*) FILTER (passed = majority) AS successes, count(passed) AS trials, count(*) FILTER (passed IS NULL) AS errors FROM judgments JOIN majority USING (judge_id, case_id) WHERE kind = 'must_hold' AND majority IS NOT NULL GROUP BY ALL),
stable AS (SELECT judge_id, case_id, count(*) AS n, count(passed) AS v, min(passed::INTEGER) AS lo, max(passed::INTEGER) AS hi FROM judgments WHERE kind = 'reference' GROUP BY ALL),
stability AS (SELECT judge_id, count(*) FILTER (v = n AND lo = hi) AS successes, count(*) FILTER (v = n) AS trials, count(*) FILTER (v < n) AS errors FROM stable GROUP BY ALL),
slices AS (SELECT judge_id, slice, count(*) FILTER (passed) AS successes, count(passed) AS trials, count(*) FILTER (passed IS NULL) AS errors FROM judgments WHERE kind = 'reference' AND repeat = 0 AND slice IS NOT NULL GROUP BY ALL),
confusion AS (SELECT judge_id, count(*) FILTER (family = '1' AND passed) AS both_pass, count(*) FILTER (family = '1' AND NOT passed) AS human_only, count(*) FILTER (family = '0' AND passed) AS judge_only, count(*) FILTER (family = '0' AND NOT passed) AS both_fail, count(*) FILTER (passed IS NULL) AS errors FROM judgments WHERE kind = 'human' GROUP BY ALL),
agreed AS (SELECT *, both_pass + both_fail AS successes, both_pass + human_only + judge_only + both_fail AS trials, (both_pass + human_only) / n * ((both_pass + judge_only) / n) + (1 - (both_pass + human_only) / n) * (1 - (both_pass + judge_only) / n) AS expected FROM (SELECT *, (both_pass + human_only + judge_only + both_fail)::DOUBLE AS n FROM confusion)),
budget AS (SELECT judge_id, 0.05 / (1 + count(DISTINCT CASE WHEN kind IN ('must_fail', 'must_hold') THEN kind || family END) + count(DISTINCT CASE WHEN kind = 'reference' THEN slice END) + max((kind = 'reference' AND repeat > 0)::INTEGER) + max((kind = 'human')::INTEGER))::DOUBLE AS alpha_fail FROM judgments GROUP BY judge_id)"""
KAPPA_DRAWS = f"""human_cases AS (SELECT judge_id, case_id, count(*) FILTER (family = '1' AND passed) AS a, count(*) FILTER (family = '1' AND NOT passed) AS b, count(*) FILTER (family = '0' AND passed) AS c, count(*) FILTER (family = '0' AND NOT passed) AS d FROM judgments WHERE kind = 'human' GROUP BY ALL),
kinds AS (SELECT judge_id, concat_ws(',', a, b, c, d) AS kind, a, b, c, d, count(*) AS n FROM human_cases WHERE a + b + c + d > 0 GROUP BY ALL),
shares AS (SELECT judge_id, sum(n)::BIGINT AS cases, floor(sum((a + d) / (a + b + c + d)::DOUBLE * n) + 1e-9)::BIGINT AS agreeing FROM kinds GROUP BY judge_id),
drawn AS ({resample.weights_sql("kinds", "kind", "n", certify.DRAWS, "kappa")}),
sums AS (SELECT judge_id, draw, sum(a * w)::DOUBLE AS a, sum(b * w)::DOUBLE AS b, sum(c * w)::DOUBLE AS c, sum(d * w)::DOUBLE AS d, sum((a + b + c + d) * w)::DOUBLE AS n FROM drawn GROUP BY ALL),
chance AS (SELECT *, (a + b) / n * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS expected FROM sums WHERE n > 0),
boot AS (SELECT judge_id, list_sort(list(((a + d) / n - expected) / (1 - expected))) AS vals FROM chance WHERE expected <> 1 GROUP BY judge_id)"""


def cp_sql(wanted: str) -> str:
    """CTEs that end in cp(k, n, alpha, low, high) for the distinct rows (k, n, alpha) of wanted: 60 bisections on summed binomial terms."""
    cdf = "list_sum(list_transform(range(0, kk + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))))"
    return f"""asked AS (SELECT DISTINCT k::BIGINT AS k, n::BIGINT AS n, alpha::DOUBLE AS alpha FROM ({wanted})),
bisect AS (
  SELECT k, n, alpha, side, kk, kk / n::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM (SELECT *, 1 AS side, k AS kk FROM asked UNION ALL SELECT *, 0, n - k FROM asked) WHERE n > 0
  UNION ALL SELECT k, n, alpha, side, kk, CASE WHEN kk < n AND c > alpha / 2 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN kk < n AND c > alpha / 2 THEN hi WHEN kk < n THEN (lo + hi) / 2 ELSE hi END, step + 1
  FROM (SELECT *, CASE WHEN kk < n THEN {cdf} ELSE 1 END AS c FROM bisect WHERE step < 60)
), cp AS (SELECT a.k, a.n, a.alpha, coalesce(1 - max(hi) FILTER (side = 0), 0) AS low, coalesce(max(hi) FILTER (side = 1), 1) AS high FROM asked a LEFT JOIN bisect b ON a.k = b.k AND a.n = b.n AND a.alpha = b.alpha AND b.step = 60 GROUP BY ALL)"""


R = lambda c: F.round(c, 9)
CP = FAMILIES.replace("people AS", "RECURSIVE people AS", 1)

CHECKS = "WITH " + CP + ", " + KAPPA_DRAWS.replace("shares", "agree_shares") + """, parts AS (
  SELECT judge_id, 'acceptance' AS name, '' AS family, successes, trials, errors, 0.7 AS bar FROM acceptance
  UNION ALL SELECT judge_id, 'rejection', family, successes, trials, errors, 0.8 FROM rejection
  UNION ALL SELECT judge_id, 'invariance', family, successes, trials, errors, 0.8 FROM invariance
  UNION ALL SELECT judge_id, 'stability', '', successes, trials, errors, 0.8 FROM stability),
""" + cp_sql("SELECT successes AS k, trials AS n, 0.05 AS alpha FROM parts UNION ALL SELECT successes, trials, alpha_fail FROM parts JOIN budget USING (judge_id) UNION ALL SELECT sum(successes), sum(trials), 0.05 FROM parts GROUP BY judge_id, name UNION ALL SELECT successes, trials, 0.05 FROM slices UNION ALL SELECT successes, trials, alpha_fail FROM slices JOIN budget USING (judge_id) UNION ALL SELECT agreeing, cases, 0.05 FROM agree_shares") + """,
decided AS (SELECT p.*, CASE WHEN p.errors > 0.1 * (p.trials + p.errors) OR p.trials < 10 THEN 'UNVALIDATED' WHEN a.low >= bar THEN 'PASS' WHEN f.high < bar THEN 'FAIL' ELSE 'UNVALIDATED' END AS status
  FROM parts p JOIN budget b USING (judge_id) JOIN cp a ON a.k = p.successes AND a.n = p.trials AND a.alpha = 0.05 JOIN cp f ON f.k = p.successes AND f.n = p.trials AND f.alpha = b.alpha_fail),
rolled AS (SELECT judge_id, name, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'UNVALIDATED' END AS status, sum(successes)::BIGINT AS successes, sum(trials)::BIGINT AS trials, sum(errors)::BIGINT AS errors, max(bar)::DOUBLE AS threshold FROM decided GROUP BY ALL),
sl AS (SELECT s.*, f.high AS bound, s.errors > 0.1 * (s.trials + s.errors) AS gap, s.trials = 0 OR s.successes <= 0.7 * s.trials AS low_rate FROM slices s JOIN budget b USING (judge_id) JOIN cp f ON f.k = s.successes AND f.n = s.trials AND f.alpha = b.alpha_fail),
sw AS (SELECT judge_id, sum(errors)::BIGINT AS errors, arg_min(struct_pack(b := bound, k := successes, n := trials), (bound, slice)) AS worst, arg_min(struct_pack(b := bound, k := successes, n := trials), (bound, slice)) FILTER (gap) AS gap, arg_min(struct_pack(b := bound, k := successes, n := trials), (bound, slice)) FILTER (low_rate) AS low FROM sl GROUP BY judge_id),
sd AS (SELECT judge_id, 'slices' AS name, CASE WHEN worst.n > 0 AND worst.b < 0.7 THEN 'FAIL' WHEN gap IS NOT NULL OR low IS NOT NULL THEN 'UNVALIDATED' ELSE 'PASS' END AS status, CASE WHEN worst.n > 0 AND worst.b < 0.7 THEN worst ELSE coalesce(gap, low, worst) END AS s, errors FROM sw),
ag AS (SELECT g.judge_id, 'human_agreement' AS name, g.errors > 0.1 * (trials + g.errors) OR both_pass + human_only = 0 OR judge_only + both_fail = 0 OR expected >= 1 OR trials < 10 OR cases < 10 AS unsure, successes, trials, g.errors, (successes / g.n - expected) / (1 - expected) AS kappa,
  least(vals[1 + greatest(0, floor(0.05 / 2 * len(vals))::BIGINT)], greatest(-1, (a.low - expected) / (1 - expected))) AS kl, vals[1 + least(len(vals) - 1, floor((1 - 0.05 / 2) * len(vals))::BIGINT)] AS kh, vals[1 + least(len(vals) - 1, floor((1 - alpha_fail / 2) * len(vals))::BIGINT)] AS kf
  FROM agreed g JOIN budget b USING (judge_id) JOIN agree_shares s USING (judge_id) JOIN boot o USING (judge_id) JOIN cp a ON a.k = s.agreeing AND a.n = s.cases AND a.alpha = 0.05),
every AS (
  SELECT judge_id, name, status, successes, trials, errors, low, high, threshold, NULL::DOUBLE AS estimate FROM rolled JOIN cp ON k = successes AND n = trials AND alpha = 0.05
  UNION ALL SELECT judge_id, name, status, s.k, s.n, errors, low, high, 0.7, NULL FROM sd JOIN cp ON cp.k = s.k AND cp.n = s.n AND alpha = 0.05
  UNION ALL SELECT judge_id, name, CASE WHEN unsure THEN 'UNVALIDATED' WHEN kl >= 0.4 THEN 'PASS' WHEN kf < 0.4 THEN 'FAIL' ELSE 'UNVALIDATED' END, successes, trials, errors, CASE WHEN unsure THEN 0 ELSE kl END, CASE WHEN unsure THEN 1 ELSE kh END, 0.4, kappa FROM ag)"""

Q = {}
S = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


@query(f"WITH {PLAN} SELECT case_id, repeat, sha256(output) AS output_sha256 FROM plan WHERE kind = 'reference'")
def plan_repeats(spark, sf_dir):
    return certify.plan_repeats(known_good(spark, sf_dir), REPEATS).select("case_id", "repeat", F.sha2("output", 256).alias("output_sha256"))


@query(f"WITH {PLAN} SELECT case_id, output FROM plan WHERE family = 'empty_prose'")
def control_empty(spark, sf_dir):
    return certify.plan_control(known_good(spark, sf_dir), controls.STYLE[0]).select("case_id", "output")


@query(f"WITH {PLAN} SELECT case_id, sha256(output) AS output_sha256 FROM plan WHERE family = 'prose_whitespace'")
def control_whitespace(spark, sf_dir):
    return certify.plan_control(known_good(spark, sf_dir), controls.STYLE[2]).select("case_id", F.sha2("output", 256).alias("output_sha256"))


@query(f"WITH {PLAN} SELECT case_id, sha256(output) AS output_sha256 FROM plan WHERE family = 'mismatched_output'")
def control_mismatched(spark, sf_dir):
    return certify.plan_control(known_good(spark, sf_dir), controls.STYLE[1], buckets(spark, sf_dir)).select("case_id", F.sha2("output", 256).alias("output_sha256"))


@query(f"WITH {PLAN} SELECT kind, family, count(*) AS n, count(*) FILTER (CASE WHEN kind = 'reference' AND repeat = 0 OR kind = 'must_hold' THEN true WHEN kind = 'human' THEN family = '1' ELSE false END) AS known_true, count(*) FILTER (kind = 'reference' AND repeat > 0) AS unknown FROM plan GROUP BY ALL")
def truth_of_role(spark, sf_dir):
    planned = certify.plan_people(people(spark, sf_dir), REPEATS, controls.STYLE, buckets(spark, sf_dir))
    truth = certify.truth_of(F.col("kind"), F.col("family"), F.col("repeat"))
    return planned.groupBy("kind", "family").agg(F.count("*").alias("n"), F.count_if(truth).alias("known_true"), F.count_if(truth.isNull()).alias("unknown"))


@query(f"WITH {JUDGMENTS} SELECT judge_id, kind, family, count(*) FILTER (passed) AS passes, count(passed) AS trials, count(*) FILTER (passed IS NULL) AS errors FROM judgments GROUP BY ALL")
def judge_rates(spark, sf_dir):
    return judgments(spark, sf_dir).groupBy("judge_id", "kind", "family").agg(F.count_if("passed").alias("passes"), F.count("passed").alias("trials"), F.count_if(F.col("passed").isNull()).alias("errors"))


@query(f"WITH {FAMILIES} SELECT * FROM majority")
def case_majority(spark, sf_dir):
    return certify.majorities(judgments(spark, sf_dir))


@query(f"WITH {FAMILIES} SELECT * FROM stability")
def stability(spark, sf_dir):
    return certify.counts_of(judgments(spark, sf_dir), "stability").drop("family")


@query(f"WITH {FAMILIES} SELECT * FROM invariance")
def invariance_family(spark, sf_dir):
    return certify.counts_of(judgments(spark, sf_dir), "invariance")


@query(f"WITH {FAMILIES} SELECT * FROM rejection")
def rejection_family(spark, sf_dir):
    return certify.counts_of(judgments(spark, sf_dir), "rejection")


@query(f"WITH {FAMILIES} SELECT * FROM slices")
def slices(spark, sf_dir):
    return certify.counts_of(judgments(spark, sf_dir), "slices").withColumnRenamed("family", "slice")


@query(f"WITH {FAMILIES} SELECT judge_id, both_pass, human_only, judge_only, both_fail, errors, round(CASE WHEN expected <> 1 THEN (successes / n - expected) / (1 - expected) END, 9) AS kappa FROM agreed")
def confusion(spark, sf_dir):
    return certify.confusion(judgments(spark, sf_dir)).withColumn("kappa", R(F.col("kappa")))


@query(CHECKS + " SELECT judge_id, name, status, successes, trials, errors, round(low, 9) AS low, round(high, 9) AS high, threshold::DOUBLE AS threshold, round(estimate, 9) AS estimate FROM every")
def certificate_checks(spark, sf_dir):
    return certify.checks(judgments(spark, sf_dir)).withColumns({c: R(F.col(c)) for c in ("low", "high", "estimate")})


@query(CHECKS + " SELECT judge_id, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'INADMISSIBLE' WHEN count(*) FILTER (status = 'UNVALIDATED') > 0 THEN 'UNVALIDATED' ELSE 'ADMISSIBLE' END AS verdict, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNVALIDATED') AS open FROM every GROUP BY judge_id")
def certificate_verdict(spark, sf_dir):
    return certify.verdicts(certify.checks(judgments(spark, sf_dir)))


@query(f"""WITH {JUDGMENTS}, looked AS (SELECT *, floor({U01.format("'look', case_id")} * 4)::INTEGER AS batch FROM judgments WHERE kind = 'reference' AND repeat = 0)
SELECT judge_id, b::INTEGER AS look, count(*) FILTER (passed) AS successes, count(passed) AS trials FROM looked JOIN range(4) t(b) ON batch <= b GROUP BY ALL""")
def sequential_looks(spark, sf_dir):
    seen = judgments(spark, sf_dir).withColumn("look", F.explode(F.sequence(F.floor(u01("look", F.col("case_id")) * 4).cast("int"), F.lit(3))))
    return certify.tally(seen, ("judge_id", "look")).where("name = 'acceptance'").select("judge_id", "look", "successes", "trials")


def sequential_verdicts(spark, sf_dir):
    """Verdict after each of four looks, and whether an earlier one had stopped the judge."""
    return certify.sequential(judgments(spark, sf_dir), F.floor(u01("look", F.col("case_id")) * 4), 4, draws=200)


Q["sequential_verdicts"] = sequential_verdicts


REFORMAT = f"regexp_replace({STRIPPED}, '[ \\t]+', ' ', 'g')"


@query(f"WITH {CASES}, r AS (SELECT case_id, output, replace({REFORMAT}, chr(10), chr(10) || chr(10)) || chr(10) AS changed FROM cases) SELECT case_id, sha256(CASE WHEN changed <> output THEN changed ELSE '  ' || output || chr(10) END) AS output_sha256 FROM r")
def control_reformat(spark, sf_dir):
    return certify.plan_control(known_good(spark, sf_dir), controls.REFORMAT).select("case_id", F.sha2("output", 256).alias("output_sha256"))


@query(f"WITH {CASES} SELECT case_id, family, sha256(output) AS output_sha256 FROM (SELECT case_id, 'prefixed' AS family, 'Re: ' || output AS output, output AS was FROM cases UNION ALL SELECT case_id, 'other_language', output, NULL FROM cases WHERE slice <> 'en') WHERE was IS NULL OR was <> output")
def control_rewrites(spark, sf_dir):
    """A change of the output, and one of the inputs (the language) under the same output."""
    cases = known_good(spark, sf_dir).withColumn("inputs", F.col("slice"))
    chosen = (controls.rewrite("prefixed", lambda o: F.concat(F.lit("Re: "), o)), controls.evidence_rewrite("other_language", lambda i: F.lit("en")))
    rows = certify.plan(cases, None, 1, chosen).where("kind <> 'reference'")
    return rows.select("case_id", "family", F.sha2("output", 256).alias("output_sha256"))


@query("WITH " + FAMILIES + ", c AS (SELECT judge_id, count(*) AS cases FROM majority GROUP BY judge_id) SELECT judge_id, cases, cases < 10 AS skipped FROM c")
def dataset_report(spark, sf_dir):
    rows = certify.dataset_report(judgments(spark, sf_dir), draws=200)
    return rows.select("judge_id", "cases", (F.col("verdict") == "SKIPPED").alias("skipped"))


WILSON = "CASE WHEN n = 0 THEN {0} ELSE {1}({0}, (k / n::DOUBLE + 1.9208 / n {2} 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n)) END"
SOURCES = "SELECT source, count(*) FILTER (n_chars >= 1000) AS k, count(*) AS n FROM documents GROUP BY source"


def long_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 1000).alias("k"), F.count("*").alias("n"))


@query(f"SELECT source, k, n, round({WILSON.format('0.0', 'greatest', '-')}, 9) AS low, round({WILSON.format('1.0', 'least', '+')}, 9) AS high FROM ({SOURCES})")
def wilson_interval(spark, sf_dir):
    low, high = wilson("k", "n")
    return long_documents(spark, sf_dir).select("source", "k", "n", R(low).alias("low"), R(high).alias("high"))


@query("WITH RECURSIVE s AS (" + SOURCES + "), " + cp_sql("SELECT k, n, 0.05 AS alpha FROM s") + " SELECT source, s.k, s.n, round(low, 9) AS low, round(high, 9) AS high FROM s JOIN cp ON s.k = cp.k AND s.n = cp.n")
def clopper_pearson_interval(spark, sf_dir):
    rows = long_documents(spark, sf_dir)
    low, high = clopper_pearson("k", "n")
    distinct = rows.select("k", "n").distinct().withColumns({"low": R(low), "high": R(high)})
    return rows.join(distinct, ["k", "n"]).select("source", "k", "n", "low", "high")
