"""Queries over texts, traces, caches and the canary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelframe.functions import pii
from gavelframe.functions import text as T
from gavelframe.functions.rng import u01
from gavelframe.operators import certify, controls, labels, mutation, panel, report, search, traces
from gavelframe.plans.certification import CASES, FAMILIES, JUDGES, JUDGMENTS, U01, judgments, known_good, load, symbol_share
from gavelframe.plans.panels import WH, WL, annotations, ratings
from gavelframe.sources import spans as span_source
from gavelframe.streaming import canary

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


def turns(spark, sf_dir):
    return load(spark, sf_dir, "conversations")


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS) + "]"
TOKENS = f"toks AS (SELECT conv_id, turn, role, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z''\\-]*[a-z]'), lambda w: trim(w, '''')), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)) AS ws FROM conversations), terms AS (SELECT conv_id, turn, role, unnest(ws) AS term FROM toks)"


@query(f"WITH {TOKENS}, tf AS (SELECT conv_id, term, count(*) AS tf FROM terms GROUP BY ALL), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, df.df, round(ln((1 + n) / (1 + df)::DOUBLE) + 1, 9) AS idf FROM df, n")
def tfidf_terms(spark, sf_dir):
    rows = turns(spark, sf_dir)
    terms = rows.select("conv_id", F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    n = rows.agg(F.count_distinct("conv_id").alias("n"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", R(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


@query(f"WITH {TOKENS}, c AS (SELECT term, count(DISTINCT (conv_id, turn)) FILTER (role = 'user') AS a, count(DISTINCT (conv_id, turn)) FILTER (role <> 'user') AS b FROM terms GROUP BY term), n AS (SELECT count(*) FILTER (role = 'user') AS na, count(*) FILTER (role <> 'user') AS nb FROM conversations) SELECT term, a, b, round(ln((a + 0.5) / (na + 1)) - ln((b + 0.5) / (nb + 1)), 9) AS ratio FROM c, n WHERE a >= 2 AND ln((a + 0.5) / (na + 1)) - ln((b + 0.5) / (nb + 1)) > 0")
def distinctive_terms(spark, sf_dir):
    rows = turns(spark, sf_dir)
    user = F.col("role") == "user"
    terms = rows.select("conv_id", "turn", "role", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(user).alias("a"), F.count_if(~user).alias("b"))
    n = rows.agg(F.count_if(user).alias("na"), F.count_if(~user).alias("nb"))
    ratio = F.expr("ln((a + 0.5D) / (na + 1)) - ln((b + 0.5D) / (nb + 1))")
    return counts.crossJoin(F.broadcast(n)).where((F.col("a") >= 2) & (ratio > 0)).select("term", "a", "b", R(ratio).alias("ratio"))


ASCII = "regexp_full_match(p_name, '[ -~]*')"


@query("SELECT p_partkey, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE END, 9) AS similarity FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS y FROM part)")
def similarity_ascii(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", R(T.similarity(F.col("p_name"), F.col("p_type"))).alias("similarity"))


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v::DOUBLE)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("o"))
    return e.join(other, "vec_id").select("vec_id", "other_id", F.round(T.cosine(F.col("embedding"), F.col("o")), 6).alias("cosine"))


BUMP = "CASE WHEN regexp_matches({0}, '[0-9]') THEN regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 1) || CASE WHEN regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 2) LIKE '%.%' THEN (split_part(regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 2), '.', 1)::BIGINT + 1)::VARCHAR || '.' || split_part(regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 2), '.', 2) ELSE (regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 2)::BIGINT + 1)::VARCHAR END || regexp_extract({0}, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)([^0-9]*)$', 3) END"


@query(f"SELECT c_custkey, {BUMP.format('c_name')} AS mutant FROM customer")
def mutant_number(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", T.bumped_number(F.col("c_name")).alias("mutant"))


YN = "'Is it ' || o_orderpriority || '? ' || CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' ELSE 'NO' END || ', as asked.'"
FLIP = "regexp_extract(t, '(?is)^(.*)\\b(yes|no)\\b(.*)$', 1) || CASE regexp_extract(t, '(?is)^(.*)\\b(yes|no)\\b(.*)$', 2) WHEN 'Yes' THEN 'No' WHEN 'no' THEN 'yes' ELSE 'YES' END || regexp_extract(t, '(?is)^(.*)\\b(yes|no)\\b(.*)$', 3)"


@query(f"SELECT o_orderkey, {FLIP} AS mutant FROM (SELECT o_orderkey, {YN} AS t FROM orders)")
def mutant_yes_no(spark, sf_dir):
    answer = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "no").otherwise("NO")
    return load(spark, sf_dir, "orders").select("o_orderkey", T.flipped_yes_no(F.concat(F.lit("Is it "), "o_orderpriority", F.lit("? "), answer, F.lit(", as asked."))).alias("mutant"))


@query("SELECT doc_id, sha256(CASE WHEN contains(h, ' ') THEN regexp_replace(h, '(?s) [^ ]*$', '') ELSE h END) AS mutant_sha256 FROM (SELECT doc_id, substr(text, 1, (length(text) // 2)::BIGINT) AS h FROM documents)")
def mutant_truncated(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.truncated(F.col("text")), 256).alias("mutant_sha256"))


MUTANTS = CASES + r""", split AS (SELECT case_id, output, regexp_extract(output, '(?s)^(.*?)([0-9]+(?:\.[0-9]+)?)([^0-9]*)$', 1) AS head, regexp_extract(output, '(?s)^(.*?)([0-9]+(?:\.[0-9]+)?)([^0-9]*)$', 2) AS number, regexp_extract(output, '(?s)^(.*?)([0-9]+(?:\.[0-9]+)?)([^0-9]*)$', 3) AS tail, substr(output, 1, (length(output) // 2)::BIGINT) AS h,
  regexp_extract(output, '(?is)^(.*)\b(yes|no)\b(.*)$', 1) AS yh, regexp_extract(output, '(?is)^(.*)\b(yes|no)\b(.*)$', 2) AS word, regexp_extract(output, '(?is)^(.*)\b(yes|no)\b(.*)$', 3) AS yt FROM cases),
made AS (
  SELECT case_id, 'truncated' AS mutant, output, CASE WHEN contains(h, ' ') THEN regexp_replace(h, '(?s) [^ ]*$', '') ELSE h END AS new_output FROM split
  UNION ALL SELECT case_id, 'number_changed', output, CASE WHEN number <> '' AND length(regexp_extract(number, '^[0-9]+')) <= 37 THEN head || (regexp_extract(number, '^[0-9]+')::HUGEINT + 1)::VARCHAR || substr(number, length(regexp_extract(number, '^[0-9]+')) + 1) || tail END FROM split
  UNION ALL SELECT case_id, 'yes_no_flipped', output, CASE WHEN word <> '' THEN yh || CASE WHEN lower(word) = 'yes' THEN CASE WHEN word = 'YES' THEN 'NO' WHEN substr(word, 1, 1) = 'Y' THEN 'No' ELSE 'no' END ELSE CASE WHEN word = 'NO' THEN 'YES' WHEN substr(word, 1, 1) = 'N' THEN 'Yes' ELSE 'yes' END END || yt END FROM split
  UNION ALL SELECT case_id, 'emptied', output, CASE WHEN output <> '' THEN '' END FROM split),
defects AS (SELECT case_id, mutant, new_output FROM made WHERE new_output IS NOT NULL AND new_output <> output),
bars AS (SELECT * FROM (VALUES ('lenient', 0.2::DOUBLE), ('strict', 0.05::DOUBLE), ('style', 0.08::DOUBLE)) j(evaluator, bar)),
firsts AS (SELECT evaluator, bar, case_id, CASE WHEN case_id % 29 <> 0 THEN coalesce(length(regexp_replace(output, '[\p{L}\s]', '', 'g')) / nullif(length(output), 0) < bar, false) END AS first FROM cases, bars),
seconds AS (SELECT evaluator, d.mutant, d.case_id, first, CASE WHEN d.case_id % 31 <> 0 THEN coalesce(length(regexp_replace(new_output, '[\p{L}\s]', '', 'g')) / nullif(length(new_output), 0) < bar, false) END AS passed FROM defects d JOIN firsts f ON f.case_id = d.case_id),
found AS (SELECT evaluator, mutant, CASE WHEN first IS NULL THEN 'error' WHEN NOT first THEN 'original_failed' WHEN passed IS NULL THEN 'error' WHEN passed THEN 'missed' ELSE 'caught' END AS status FROM seconds),
rates AS (SELECT evaluator, mutant, count(*) FILTER (status = 'caught') AS caught, count(*) FILTER (status = 'missed') AS missed, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'original_failed') AS original_failed, count(*) FILTER (status IN ('caught', 'missed')) AS judged FROM found GROUP BY ALL)"""
TEXT_MUTANTS = {k: v for k, v in mutation.DEFAULT.items() if k != "last_sentence_dropped"}


def mutation_rows(spark, sf_dir, mutants=TEXT_MUTANTS):
    """(mutants of known-good documents, outcomes of three style judges on them)."""
    cases = known_good(spark, sf_dir)
    made = mutation.mutants(cases, mutants)
    judges = F.explode(F.array(*(F.struct(F.lit(n).alias("evaluator"), F.lit(b).alias("bar")) for n, b in JUDGES)))
    verdict = lambda skip: F.when(F.col("case_id") % skip != 0, F.coalesce(symbol_share(F.col("output")) < F.col("bar"), F.lit(False))).alias("passed")
    originals = cases.select("case_id", "output", judges.alias("j")).select("case_id", "output", "j.*").select("evaluator", "case_id", verdict(29))
    verdicts = made.where("state = 'defect'").select("case_id", "mutant", "output", judges.alias("j")).select("case_id", "mutant", "output", "j.*").select("evaluator", "mutant", "case_id", verdict(31))
    return made, mutation.outcomes(made, originals, verdicts)


@query(f"WITH {MUTANTS} SELECT evaluator, mutant, caught, missed, errors, original_failed, judged, round(CASE WHEN judged = 0 THEN 0 ELSE {WL.format(k='caught', n='judged')} END, 9) AS low, round(CASE WHEN judged = 0 THEN 1 ELSE {WH.format(k='caught', n='judged')} END, 9) AS high FROM rates")
def kill_rate(spark, sf_dir):
    rows = mutation.kill_rates(mutation_rows(spark, sf_dir)[1])
    return rows.select("evaluator", "mutant", "caught", "missed", "errors", "original_failed", "judged", R(F.col("low")).alias("low"), R(F.col("high")).alias("high"))


@query(f"WITH {MUTANTS} SELECT mutant, count(*) FILTER (new_output IS NOT NULL AND new_output <> output) AS defects, count(*) FILTER (new_output IS NULL OR new_output = output) AS not_applicable FROM made GROUP BY mutant")
def mutant_summary(spark, sf_dir):
    return mutation.summary(mutation_rows(spark, sf_dir)[0]).select("mutant", "defects", "not_applicable")


def mutation_report(spark, sf_dir):
    """Kill rates of all five text mutants."""
    return mutation.kill_rates(mutation_rows(spark, sf_dir, mutation.DEFAULT)[1])


def pii_full(spark, sf_dir):
    """Findings of all kinds in every document, and the text without them."""
    found = pii.detect(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size("findings").alias("n"), F.to_json("findings").alias("findings"), F.sha2(pii.redact(F.col("text"), F.col("findings")), 256).alias("redacted_sha256"))


PLANTED = "UNION ALL ".join(f"SELECT case_id, '{c}' AS category, '{k}' AS kind, sha256(output || chr(10) || 'Contact: {pii.SYNTHETIC[c][i]}') AS output_sha256 FROM cases " for c in pii.CATEGORIES for i, k in ((0, "must_fail"), (1, "must_hold")))


@query(f"WITH {CASES} {PLANTED}")
def pii_controls(spark, sf_dir):
    return pii.planted(known_good(spark, sf_dir)).select("case_id", "category", "kind", F.sha2("output", 256).alias("output_sha256"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))::BIGINT AS emails FROM documents WHERE contains(text, '@')")
def pii_email_simple(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")).cast("long").alias("emails"))


@query("SELECT o_orderkey, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INTEGER ELSE (2 * substr(d, i, 1)::INTEGER) // 10 + (2 * substr(d, i, 1)::INTEGER) % 10 END)) % 10 = 0 AS valid FROM (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey)::VARCHAR AS d FROM orders)")
def luhn(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", T.luhn((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string")).alias("valid"))


def iban(spark, sf_dir):
    """IBAN checks of account texts made from suppliers: valid ones get their check digits by mod 97."""
    body = F.lpad((F.col("s_suppkey") * 104729).cast("string"), 18, "0")
    digits = 98 - (F.concat(body, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int")
    account = F.concat(F.lit("DE"), F.when(F.col("s_suppkey") % 2 == 0, F.lpad(digits.cast("string"), 2, "0")).otherwise("00"), body)
    return load(spark, sf_dir, "supplier").select("s_suppkey", account.alias("account"), T.iban_valid(account).alias("valid"))


Q["iban"] = iban


# -- traces: a conversation is a trace, its turns are spans, each under the one before -------
SPANS = "spans AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn % 5 = 0 THEN NULL ELSE turn - 1 END AS parent_id, role, text FROM conversations)"


def spans(spark, sf_dir):
    return turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.when(F.col("turn") % 5 != 0, (F.col("turn") - 1).cast("string")).alias("parent_id"))


@query(f"WITH RECURSIVE {SPANS}, up AS (SELECT trace_id, span_id, parent_id AS at, 0 AS depth, span_id AS root FROM spans UNION ALL SELECT u.trace_id, u.span_id, p.parent_id, u.depth + 1, p.span_id FROM up u JOIN spans p ON u.trace_id = p.trace_id AND u.at = p.span_id) SELECT trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, max(depth)::INTEGER AS depth, arg_max(root, depth)::VARCHAR AS root FROM up GROUP BY ALL")
def trace_nested(spark, sf_dir):
    return traces.ancestors(spark, spans(spark, sf_dir))


@query("SELECT conv_id, prompt, duplicates FROM (SELECT conv_id, text AS prompt, turn, count(*) OVER (PARTITION BY text) - 1 AS duplicates, row_number() OVER (PARTITION BY text ORDER BY turn, conv_id) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def trace_dedupe(spark, sf_dir):
    runs = turns(spark, sf_dir).select("conv_id", "role", F.col("text").alias("prompt"), F.col("turn").alias("start"), F.col("conv_id").alias("seq"))
    return traces.dedupe_runs(runs, F.col("role") == "user").select("conv_id", "prompt", "duplicates")


MSG = "m AS (SELECT user_id AS run_id, event_id AS no, CASE WHEN event_type IN ('view', 'signup') THEN 'tool_call' ELSE 'tool_call_response' END AS kind, event_id % 50 AS call_id FROM events), o AS (SELECT *, max(no) FILTER (kind = 'tool_call') OVER (PARTITION BY run_id, call_id ORDER BY no) AS call_no FROM m)"


@query(f"WITH {MSG} SELECT run_id, call_id, call_no, coalesce(max(no) FILTER (kind <> 'tool_call'), -1)::BIGINT AS response_no FROM o WHERE call_no IS NOT NULL GROUP BY ALL")
def tool_pairing(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "signup"), "tool_call").otherwise("tool_call_response")
    m = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("no"), kind.alias("kind"), (F.col("event_id") % 50).alias("call_id"))
    return traces.pair_tools(m).withColumn("response_no", F.coalesce("response_no", F.lit(-1)).cast("long"))


def recorded_runs(spark, sf_dir):
    """Conversations as recorded agent runs: one query row each, its turns as messages."""
    message = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"))).alias("parts"))
    per = turns(spark, sf_dir).groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])).alias("messages"), F.max_by("text", "turn").alias("last"))
    attributes = F.to_json(F.create_map(F.lit("gen_ai.operation.name"), F.lit("invoke_agent"), F.lit("gen_ai.agent.name"), F.lit("helper"), F.lit("recorded.all_messages"), F.col("messages"), F.lit("final_result"), F.col("last")))
    row = F.to_json(F.struct(F.lit("invoke_agent helper").alias("span_name"), F.hex(F.col("conv_id") + 1).alias("trace_id"), F.hex(F.col("conv_id") + 1).alias("span_id"), attributes.alias("attributes")))
    return traces.agent_runs(spark, span_source.normalise(span_source.flatten(per.select(row.alias("value")))))


@query("WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS t, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT lpad(lower(to_hex(f.conv_id + 1)), 32, '0') AS trace_id, sha256(c.text) AS prompt_sha256, (SELECT count(*) FROM conversations h WHERE h.conv_id = f.conv_id AND h.turn < f.t) AS history, (SELECT count(*) FROM conversations h WHERE h.conv_id = f.conv_id AND h.turn >= f.t) AS own, sha256(l.text) AS output_sha256 FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t JOIN conversations l ON l.conv_id = f.conv_id AND l.turn = f.last")
def agent_runs(spark, sf_dir):
    runs = recorded_runs(spark, sf_dir).where("prompt is not null")
    return runs.select("trace_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.size("history").cast("long").alias("history"), F.size("own").cast("long").alias("own"), F.sha2("output", 256).alias("output_sha256"))


@query("WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id), p AS (SELECT f.conv_id, c.text AS prompt, coalesce((SELECT string_agg(h.role || h.text, '|' ORDER BY h.turn) FROM conversations h WHERE h.conv_id = f.conv_id AND h.turn < f.t), '') AS history FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t), g AS (SELECT prompt, history, count(*) - 1 AS duplicates FROM p GROUP BY ALL) SELECT duplicates::INTEGER AS duplicates, count(*) AS cases FROM g GROUP BY duplicates")
def trace_cases(spark, sf_dir):
    kept = traces.select_runs(recorded_runs(spark, sf_dir))
    return kept.groupBy("duplicates").agg(F.count("*").alias("cases"))


@query(f"WITH plan AS (SELECT doc_id AS plan_no, sha256(text) AS content FROM documents), occ AS (SELECT plan_no, content, row_number() OVER (PARTITION BY content ORDER BY plan_no) - 1 AS occurrence FROM plan), cache AS (SELECT sha256(text) AS content, 0 AS occurrence FROM documents WHERE {U01.format(chr(39) + 'cached' + chr(39) + ', doc_id')} < 0.5) SELECT plan_no, content, occurrence FROM occ ANTI JOIN cache USING (content, occurrence)")
def cache_misses(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("plan_no"), F.sha2("text", 256).alias("content"))
    cached = docs.where(u01("cached", F.col("plan_no")) < 0.5).select("content", F.lit(0).alias("occurrence"))
    return traces.cache_misses(traces.occurrence(docs, ["content"], "plan_no"), cached, ["content", "occurrence"]).select("plan_no", "content", F.col("occurrence").cast("long").alias("occurrence"))


CHECKS = "checks AS (SELECT (user_id % 5)::VARCHAR AS judge_id, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE value > 10 END AS rejected FROM events)"


def canary_checks(spark, sf_dir):
    return load(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("judge_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("value") > 10).alias("rejected"))


@query(f"WITH {CHECKS} SELECT judge_id, seq, count(*) OVER w AS checks, count(*) FILTER (rejected) OVER w AS rejected FROM checks WHERE rejected IS NOT NULL WINDOW w AS (PARTITION BY judge_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def canary_window(spark, sf_dir):
    return canary.canary_window(canary_checks(spark, sf_dir))


@query(f"WITH {CHECKS}, last AS (SELECT judge_id, count(*) AS n, count(*) FILTER (rejected) AS k FROM (SELECT * FROM checks WHERE rejected IS NOT NULL QUALIFY row_number() OVER (PARTITION BY judge_id ORDER BY seq DESC) <= 100) GROUP BY judge_id) SELECT judge_id, n AS checks, k AS rejected, CASE WHEN n >= 20 AND {WL.format(k='k', n='n')} >= 0.8 THEN 'HEALTHY' WHEN n >= 20 AND {WH.format(k='k', n='n')} < 0.8 THEN 'DRIFTING' ELSE 'UNKNOWN' END AS health FROM last")
def canary_health(spark, sf_dir):
    rows = canary_checks(spark, sf_dir).where("rejected is not null")
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy("judge_id").orderBy(F.desc("seq")))).where(F.col("rn") <= canary.KEEP)
    per = last.groupBy("judge_id").agg(F.count("*").alias("checks"), F.count_if("rejected").alias("rejected"))
    return per.withColumn("health", canary.health("checks", "rejected"))


@query(f"""WITH pop AS (SELECT l.doc_id, l.quality = 1 AS h, d.n_chars >= 400 AS j, row_number() OVER (ORDER BY l.doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
draws AS (SELECT b, floor({U01.format(chr(39) + 'boot' + chr(39) + ', b, p.pos')} * n)::BIGINT AS pick FROM pop p, range(40) t(b)),
cells AS (SELECT b, count(*) FILTER (h AND j) AS a, count(*) FILTER (h AND NOT j) AS c, count(*) FILTER (NOT h AND j) AS d, count(*) FILTER (NOT h AND NOT j) AS e, count(*)::DOUBLE AS n FROM draws JOIN pop ON pos = pick GROUP BY b)
SELECT b::INTEGER AS draw, round(((a + e) / n - ((a + c) / n * ((a + d) / n) + (1 - (a + c) / n) * (1 - (a + d) / n))) / (1 - ((a + c) / n * ((a + d) / n) + (1 - (a + c) / n) * (1 - (a + d) / n))), 9) AS kappa FROM cells""")
def bootstrap_kappa(spark, sf_dir):
    from gavelframe.functions.stats import kappa

    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 400).alias("j"))
    rows = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("h")).join(docs, "doc_id")
    pop = rows.withColumn("pos", F.row_number().over(Window.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    draws = pop.select("pos", "n", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw")).select("draw", F.floor(u01("boot", F.col("draw"), F.col("pos")) * F.col("n")).alias("pos"))
    cells = draws.join(pop.select("pos", "h", "j"), "pos").groupBy("draw").agg(F.count_if(F.col("h") & F.col("j")).alias("a"), F.count_if(F.col("h") & ~F.col("j")).alias("b"), F.count_if(~F.col("h") & F.col("j")).alias("c"), F.count_if(~F.col("h") & ~F.col("j")).alias("d"))
    return cells.select("draw", R(kappa("a", "b", "c", "d")).alias("kappa"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


# -- annotations, certificates as tables ----------------------------------------------------
ANN = """ann AS (SELECT (event_id % 2000)::BIGINT AS run_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS reviewer, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'pass' WHEN 'error' THEN 'fail' ELSE 'neutral' END AS verdict, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS updated_at, event_id AS row_no FROM events),
own AS (SELECT *, CASE WHEN reviewer IS NULL THEN row_no END AS self FROM ann),
timed AS (SELECT *, count(*) FILTER (updated_at IS NULL) OVER (PARTITION BY run_id, reviewer, self) = 0 AS t FROM own),
latest AS (SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY run_id, reviewer, self ORDER BY CASE WHEN t THEN updated_at END DESC NULLS LAST, row_no DESC) = 1),
votes AS (SELECT run_id, count(*) FILTER (verdict = 'pass') AS p, count(*) FILTER (verdict = 'fail') AS f, count(*) FILTER (verdict = 'neutral') AS n FROM latest GROUP BY run_id),
labelled AS (SELECT *, CASE WHEN p > 0 AND f > 0 THEN CASE WHEN p > f THEN 'pass' WHEN f > p THEN 'fail' ELSE 'conflict' END WHEN p > 0 THEN 'pass' WHEN f > 0 THEN 'fail' ELSE 'neutral' END AS label FROM votes)"""


@query(f"WITH {ANN} SELECT (SELECT count(*) FROM ann) AS rows, 0::BIGINT AS missing_id, count(*) AS runs, count(*) FILTER (label IN ('pass', 'fail')) AS labelled, count(*) FILTER (label = 'pass') AS pass, count(*) FILTER (label = 'fail') AS fail, sum(n)::BIGINT AS neutral_annotations, count(*) FILTER (label = 'neutral') AS neutral_runs, count(*) FILTER (label = 'conflict') AS conflicts, (SELECT count(*) FROM ann) - (SELECT count(*) FROM latest) AS superseded FROM labelled")
def read_summary(spark, sf_dir):
    return labels.read_summary(annotations(spark, sf_dir), "majority")


@query(f"WITH {ANN}, j AS (SELECT doc_id AS run_id, CASE WHEN doc_id % 19 <> 0 THEN n_chars >= 900 END AS passed FROM documents), b AS (SELECT l.label, j.passed, l.run_id AS h, j.run_id AS g FROM (SELECT * FROM labelled WHERE label IN ('pass', 'fail')) l FULL JOIN j USING (run_id)) SELECT count(*) FILTER (label = 'pass' AND passed) AS both_pass, count(*) FILTER (label = 'pass' AND NOT passed) AS human_only_pass, count(*) FILTER (label = 'fail' AND passed) AS judge_only_pass, count(*) FILTER (label = 'fail' AND NOT passed) AS both_fail, count(*) FILTER (h IS NOT NULL AND g IS NOT NULL AND passed IS NULL) AS errors, count(*) FILTER (g IS NULL) AS human_only, count(*) FILTER (h IS NULL) AS judge_only FROM b")
def annotation_agreement(spark, sf_dir):
    human = labels.annotation_votes(labels.latest_annotations(annotations(spark, sf_dir)), "majority").where("label in ('pass', 'fail')")
    judge = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.when(F.col("doc_id") % 19 != 0, F.col("n_chars") >= 900).alias("passed"))
    return labels.agreement(human, judge, "run_id").select("both_pass", "human_only_pass", "judge_only_pass", "both_fail", "errors", "human_only", "judge_only")


@query(f"WITH {JUDGMENTS}, t AS (SELECT *, CASE WHEN kind = 'reference' AND repeat = 0 OR kind = 'must_hold' THEN true WHEN kind = 'must_fail' THEN false WHEN kind = 'human' THEN family = '1' END AS truth FROM judgments) SELECT judge_id, kind, family, count(*) FILTER (passed = truth) AS right, count(*) FILTER (passed <> truth) AS wrong, count(*) FILTER (passed IS NOT NULL AND truth IS NULL) AS unknown, count(*) FILTER (passed IS NULL) AS errors FROM t GROUP BY ALL")
def evidence_table(spark, sf_dir):
    return report.evidence_table(judgments(spark, sf_dir))


@query(f"WITH {FAMILIES} SELECT judge_id, case_id, n::BIGINT AS repeats FROM stable WHERE n >= 2 AND v = n AND hi = 0")
def consistent_rejections(spark, sf_dir):
    return report.consistent_rejections(judgments(spark, sf_dir))


def qualification(spark, sf_dir):
    """Which style judges may steer an agent that works in English, by rule."""
    rows = judgments(spark, sf_dir)
    config = lambda v: F.create_map(F.lit("bar"), F.lit(v), F.lit("include_input"), F.lit("true"))
    identities = spark.createDataFrame([(n, "0.1") for n, _ in JUDGES], "judge_id string, v string").select("judge_id", config("0.1").alias("certified"), config("0.1").alias("running"), F.lit(True).alias("reliable"), F.lit(3.0).alias("age_days"))
    return report.qualify(certify.checks(rows, draws=200), certify.families(rows), identities, "steer", "en", True, ("empty_prose",), 30)


def certificate_spans(spark, sf_dir):
    """Certificates as spans: judges, their checks, and examples of wrong verdicts."""
    rows = judgments(spark, sf_dir)
    return span_source.tree(certify.checks(rows, draws=200), rows).withColumn("attributes", F.to_json("attributes"))


def cases_needed(spark, sf_dir):
    """Cases that the share of long documents in each source would need to clear 0.3."""
    rates = load(spark, sf_dir, "documents").groupBy("source").agg(F.avg((F.col("n_chars") >= 1000).cast("int")).alias("rate"))
    return report.cases_needed(rates.withColumn("bar", F.lit(0.3)))


# -- searches -------------------------------------------------------------------------------
def many_symbols(parts):
    """Whether over a twentieth of the text are neither letters nor spaces."""
    joined = "".join(parts)
    return sum(not (c.isalpha() or c.isspace()) for c in joined) > 0.05 * max(1, len(joined))


def ddmin(spark, sf_dir):
    """The fewest turns of every conversation that still hold too many symbols."""
    return search.witnesses(turns(spark, sf_dir), ["conv_id"], "turn", "text", many_symbols).withColumn("witness", F.sha2(F.array_join("witness", "\n"), 256))


def stress_ucb(spark, sf_dir):
    """Attacks on empty-handed answers (customer names) that length-minded judges let pass, within 200 tries."""
    cases = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("output"))
    rows = controls.attack_rows(cases, F.col("output"), F.lit("The answer is complete."))
    judges = F.explode(F.array(*(F.struct(F.lit(n).alias("judge_id"), F.lit(b).alias("least")) for n, b in (("short", 60), ("long", 100)))))
    judged = rows.select("*", judges.alias("j")).select("case_id", "attack", "j.judge_id", (F.length("output") >= F.col("j.least")).alias("fooled"))
    return search.stress(judged, 200, ["judge_id"])


def evidence_budget(spark, sf_dir):
    """Which fields of a part can go before a judge that looks for economy parts changes its mind."""
    parts = load(spark, sf_dir, "part")
    fields = [c for c in ("p_name", "p_brand", "p_type", "p_container", "p_mfgr") if c in parts.columns]
    verdict = lambda left: F.upper(F.concat_ws(" ", *left.values())).contains("ECONOMY")
    return spark.createDataFrame(search.evidence_budget(parts, fields, verdict), "component string, chars long, moved long, dropped boolean")


def disagreement_clusters(spark, sf_dir):
    """Clusters of the documents that raters contest, by their words."""
    contested = panel.ranked_contested(panel.contested(ratings(spark, sf_dir))).select(F.col("item").alias("doc_id"))
    texts = load(spark, sf_dir, "documents").select("doc_id", "text").join(contested, "doc_id")
    return search.cluster_items(texts, "doc_id", "text")


Q |= {f.__name__: f for f in (mutation_report, pii_full, qualification, certificate_spans, cases_needed, disagreement_clusters, ddmin, stress_ucb, evidence_budget)}
