"""Personal data in texts by weak supervision; DataFrame operations only.

Base spans are the matches of four fixed patterns (e-mail addresses, IPv4 addresses, payment
cards, international phone numbers) that pass their checks.  Beside them stand looser
candidates: written-out addresses ("name (at) host (dot) com"), defanged IPs, cards of 13 to 15
digits or with other separators, numbers in national phone formats.

Labelers vote for, against or not at all on every candidate: the base pattern, a checksum or
range check, a gazetteer (top-level domains, card prefixes, area codes), words of context before
the span, and signs of another kind of number around it.  Votes are counted by pattern (at most
3^5 patterns a kind); expectation-maximisation over those counts estimates how often each
labeler is right, without labels.  The resulting probabilities are the soft labels of a naive
Bayes span classifier on the shape of a candidate.  A loose candidate becomes a span if both the
vote posterior and the classifier are at least ``accept`` sure, and it touches no base span.

Bounds of the looser candidates: local parts of written-out addresses hold at most 64 characters
and their hosts six labels, as mail allows; base spans have no bounds.

Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans.  Repeated rows give equal results, and rows
that share a key are told apart by their texts.  Spans
of one kind do not overlap; base spans are always kept.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
ROUNDS = 25
SMOOTH = 1.0

# The base patterns, possessive and anchored at run beginnings where that changes no match but bounds the work.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser candidates of each kind.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]++){1,5}+",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}+(?:[\x20._/-]?+[0-9]){9,15}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z])",
}
# Gazetteers and context words.
TLDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at", "ca", "au", "in", "jp")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35)"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|client|from)[^\n]{0,16}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|tarjeta|karte|carte)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|contact)[^\n]{0,16}$",
}
OTHER = {
    "email": r"(?i)(?:https?:/|ftp:/|/)\S*$",
    "ip": r"(?i)(?:\bv|version |release |section |[0-9.])$",
    "card": r"(?i)(?:isbn|id|no\.?|sha|hash|order|invoice|token|[0-9.=\"'x])[ :#=\"']{0,3}$",
    "phone": r"(?i)(?:isbn|\bid|order|invoice|version|[0-9=])[ :#=-]{0,3}$",
}


def _digits(c: F.Column) -> F.Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octets(c: F.Column) -> F.Column:
    parts = F.split(F.regexp_replace(c, r"[\[\]()]", ""), r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.cast("double") <= 255)


def _valid(kind: str, span: F.Column) -> F.Column:
    """Whether a match of a kind's base pattern counts."""
    digits = _digits(span)
    if kind == "ip":
        return _octets(span)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _vote(good: F.Column, bad: F.Column | None = None) -> F.Column:
    out = F.when(F.coalesce(good, F.lit(False)), 1)
    return (out.when(F.coalesce(bad, F.lit(False)), -1) if bad is not None else out).otherwise(0)


def _votes(kind: str, base: F.Column, span: F.Column, before: F.Column, after: F.Column) -> F.Column:
    """The five labelers' votes: pattern, check, gazetteer, context, other."""
    digits = _digits(span)
    if kind == "email":
        tld = F.lower(F.regexp_extract(span, r"([A-Za-z]+)$", 1))
        check, gazetteer = _vote(F.length(span).between(6, 254), F.length(span) > 254), _vote(tld.isin(*TLDS), F.length(tld) < 2)
    elif kind == "ip":
        check, gazetteer = _vote(_octets(span), ~_octets(span)), _vote(~span.rlike(r"(?:^|\.)0[0-9]") & ~span.startswith("0."), span.startswith("0."))
    elif kind == "card":
        luhn = F.call_function("luhn_check", digits)
        check, gazetteer = _vote(luhn, ~luhn), _vote(digits.rlike(CARD_PREFIX), ~digits.rlike(CARD_PREFIX))
    else:
        check, gazetteer = _vote(F.length(digits).between(10, 15), F.length(digits) < 8), _vote(span.rlike(r"^(?:\+|\(?[2-9][0-9]{2})"), span.rlike(r"^\(?[01]"))
    other = before.rlike(OTHER[kind]) | after.rlike(r"^(?:[A-Za-z0-9_]|\.[0-9])")
    return F.array(_vote(base), check, gazetteer, _vote(before.rlike(CONTEXT[kind])), _vote(F.lit(False), other))


def _features(kind_no: F.Column, span: F.Column, before: F.Column, after: F.Column) -> F.Column:
    """What the span classifier sees: shape only, as 'number=value' strings."""
    char = lambda c: F.when(c == "", "edge").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("sign")
    values = (F.length(_digits(span)), F.least(F.length(span) / 4, F.lit(16)).cast("int"), F.length(F.regexp_replace(span, r"[A-Za-z0-9]", "")), char(F.right(before, F.lit(1))), char(F.left(after, F.lit(1))), span.rlike(r"[()\[\]]"))
    return F.array(*(F.concat(F.lit(f"{i}="), v.cast("string")) for i, v in enumerate(values)))


def _found(text: F.Column, kind: str, pattern: str) -> F.Column:
    """array<struct<kind, base, i, span, before, after, gap>> of a pattern's matches; gap is the number of code points since the match before."""
    need = {"email": text.contains("@") if pattern == BASE["email"] else text.rlike(r"(?i)[(\[{] ?at ?[)\]}]"), "phone": text.contains("+")}.get(kind if pattern in BASE.values() or kind == "email" else "", text.rlike("[0-9]"))
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(F.sequence(F.lit(0), F.size(spans) - 1).alias("i"), spans.alias("span"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next")), lambda r: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(pattern == BASE[kind]).alias("base"), r["i"].alias("i"), r["span"].alias("span"), F.right(r["gap"], F.lit(40)).alias("before"), F.left(r["next"], F.lit(4)).alias("after"), F.length(r["gap"]).alias("gap")))
    return F.when(need & (F.size(spans) > 0), F.filter(rows, lambda r: r["span"].isNotNull()))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, kind, base, span, before, after, start, end) of base matches that count and of loose ones; t is the text's hash."""
    nothing = F.expr("cast(array() as array<struct<kind int, base boolean, i int, span string, before string, after string, gap int>>)")
    found = F.concat(*(F.coalesce(_found(F.col(text), kind, pattern), nothing) for patterns in (BASE, LOOSE) for kind, pattern in patterns.items()))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.explode(found).alias("m")).select("k", "t", "m.*").distinct()
    order = Window.partitionBy("k", "t", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(order)).withColumn("start", F.col("end") - F.length("span"))
    valid = F.coalesce(*(F.when(F.col("kind") == i, _valid(kind, F.col("span"))) for i, kind in enumerate(KINDS)), F.lit(False))
    return placed.where(~F.col("base") | valid).select("k", "t", "kind", "base", "span", "before", "after", "start", "end")


def _em(counts: DataFrame) -> DataFrame:
    """(kind, prior, pos, neg): for each kind, how often an instance is real, and each labeler's chances of -1, 0, 1 given real and not."""
    start = "struct(0.5D as prior, array(array(0.05D, 0.25D, 0.7D), array(0.05D, 0.25D, 0.7D), array(0.1D, 0.3D, 0.6D), array(0.05D, 0.65D, 0.3D), array(0.1D, 0.85D, 0.05D)) as pos, array(array(0.05D, 0.75D, 0.2D), array(0.6D, 0.2D, 0.2D), array(0.4D, 0.3D, 0.3D), array(0.05D, 0.9D, 0.05D), array(0.5D, 0.45D, 0.05D)) as neg)"
    odds = "ln(m.prior / (1 - m.prior)) + aggregate(sequence(0, 4), 0D, (a, j) -> a + ln(m.pos[j][p.v[j] + 1] / m.neg[j][p.v[j] + 1]))"
    weighted = f"transform(patterns, p -> struct(p.v as v, p.n as n, 1 / (1 + exp(-({odds}))) as w))"
    share = lambda w: f"transform(sequence(0, 4), j -> transform(sequence(-1, 1), o -> ({SMOOTH} + aggregate(q, 0D, (a, p) -> a + if(p.v[j] = o, p.n * {w}, 0D))) / (3 * {SMOOTH} + aggregate(q, 0D, (a, p) -> a + p.n * {w}))))"
    prior = f"({SMOOTH} + aggregate(q, 0D, (a, p) -> a + p.n * p.w)) / (2 * {SMOOTH} + aggregate(q, 0D, (a, p) -> a + p.n))"
    step = f"transform(array({weighted}), q -> struct({prior} as prior, {share('p.w')} as pos, {share('(1 - p.w)')} as neg))[0]"
    arrays = counts.groupBy("kind").agg(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n"))).alias("patterns"))
    return arrays.select("kind", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, r) -> {step})").alias("m")).select("kind", "m.*")


def label_model(judged: DataFrame) -> DataFrame:
    """(kind, prior, pos, neg) from candidates with votes v."""
    return _em(judged.groupBy("kind", "v").agg(F.count("*").alias("n")))


def located(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(k, t, base, spans) of every different (key, text hash) with spans: arrays of (kind number, start, end), base ones and all."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(candidates(docs, key, text), "pii-candidates")
    by_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == i, f(kind)) for i, kind in enumerate(KINDS)))
    judged = found.withColumn("v", by_kind(lambda kind: _votes(kind, F.col("base"), F.col("span"), F.col("before"), F.col("after")))).withColumn("f", _features(F.col("kind"), F.col("span"), F.col("before"), F.col("after")))
    model = label_model(judged)
    odds = F.expr("ln(prior / (1 - prior)) + aggregate(sequence(0, 4), 0D, (a, j) -> a + ln(pos[j][v[j] + 1] / neg[j][v[j] + 1]))")
    soft = judged.join(F.broadcast(model), "kind").withColumn("w", 1 / (1 + F.exp(-odds)))  # the model has a row a kind
    soft = scratch.save(soft.select("k", "t", "kind", "base", "start", "end", "f", "w"), "pii-soft")

    sums = soft.groupBy("kind").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no"))
    cells = soft.select("kind", "w", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("w").alias("y"), F.sum(1 - F.col("w")).alias("n"))
    share = (F.col("yes") + SMOOTH) / (F.col("yes") + F.col("no") + 2 * SMOOTH)
    ratio = F.log((F.col("y") + SMOOTH * share) / (F.col("n") + SMOOTH * (1 - share))) - F.log(share / (1 - share))  # rare shapes lean to the share of all
    trained = cells.join(sums, "kind").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("f", ratio))).alias("weights"), F.first(F.log((F.col("yes") + SMOOTH) / (F.col("no") + SMOOTH))).alias("bias"))
    loose = soft.where(~F.col("base") & (F.col("w") >= accept)).join(F.broadcast(trained), "kind")  # shapes have a bounded number of values
    belief = F.col("bias") + F.aggregate("f", F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at("weights", x), F.lit(0.0)))
    sure = loose.where(1 / (1 + F.exp(-belief)) >= accept).select("k", "t", "kind", "start", "end")
    base = soft.where("base").select("k", "t", "kind", "start", "end")
    touching = base.alias("b").join(sure.alias("s"), F.col("b.k").eqNullSafe(F.col("s.k")) & (F.col("b.t") == F.col("s.t")) & (F.col("b.start") < F.col("s.end")) & (F.col("s.start") < F.col("b.end")))
    blocked = touching.select("s.*").distinct()
    added = sure.alias("s").join(blocked.alias("b"), F.col("b.k").eqNullSafe(F.col("s.k")) & (F.col("b.t") == F.col("s.t")) & (F.col("b.kind") == F.col("s.kind")) & (F.col("b.start") == F.col("s.start")), "left_anti")
    spans = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    per_text = spans.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    return scratch.result(per_text, "pii-spans")


def _beside(docs: DataFrame, found: DataFrame, key: str, text: str, *extra: F.Column) -> DataFrame:
    """One row for every row of docs: its key, extra columns, base and spans."""
    nothing = F.expr("cast(array() as array<struct<kind int, start bigint, `end` bigint>>)")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), *extra)
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("t")), "left")
    return joined.select(F.col("id").alias(key), *(c for c in rows.columns if c not in ("id", "h")), F.coalesce("base", nothing).alias("base"), F.coalesce("spans", nothing).alias("spans"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(key, base, spans) of every row: arrays of (kind number, start, end), base ones and all."""
    return _beside(docs, located(docs, key, text, accept), key, text)


def spans_text(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(key, text) with every span replaced by its kind in brackets; overlapping spans are cut at the one before."""
    rows = _beside(docs, located(docs, key, text, accept), key, text, F.col(text).alias("x"))
    names = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = F.aggregate(by_start, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(F.col("x"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("out"), s["end"].alias("at"))))
    rest = F.substring(F.col("x"), (F.col("p.at") + 1).cast("int"), F.lit(2147483647))
    return rows.withColumn("p", pieces).select(key, F.when(F.size("spans") == 0, F.col("x")).otherwise(F.concat("p.out", rest)).alias("text"))
