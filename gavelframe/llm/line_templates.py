"""Dropping lines whose template recurs across documents, with a log-template tree; DataFrame operations only.

A line is split at white space; a token with a digit is a variable, ``<*>``.  The tree has a
fixed depth: the number of tokens, then the first ``depth`` tokens.  In a leaf that holds
different lines, the most frequent token at each position (among its distinct lines) makes the
leaf's first template; lines of at least ``min_tokens`` tokens that agree with it at ``similarity``
of the positions or more belong to it, with the positions where they differ as further variables.
The lines left over make the leaf's second template the same way, and so on: the second round
follows where the first took a line, others where the last took at least ``SHARE`` of the lines
it saw.  What is then left of a leaf is taken in the order of the lines' hashes: a line belongs to
the first leader it agrees with at ``similarity``, and is a leader itself if there is none.  So
every line of a leaf is grouped, however many templates the leaf holds; a number for ``templates``
stops after so many rounds, without leaders.  Every other line is a template of its own, variables
masked.

A template recurs if it stands in at least ``min_docs`` different texts.  It stays in the first
of them (smallest key, then text hash) and in exact copies of that text, and is dropped from all
others.  Copies of a text count once, so whole copies are left to document deduplication.

With ``long_words``, a line of more words than that recurs from two different texts on if it is
the same word for word (white space apart, numbers not masked); it stays in the first of them too.
Passages inside a line or across lines are not looked for.

Lines are carried as hashes; only leaves with several lines have their tokens counted, by
(leaf, position, token).  Rounds grow with the logarithm of a leaf's lines; leaders are found
``SLICE`` lines of a leaf at a time and cost lines times leaders of what the rounds left there.
Texts are shuffled once, to be rewritten.  What is broadcast are rows of one or two 64-bit hashes,
BROADCAST_ROWS at most (some 50 MB); more are joined by shuffle, where Spark splits the partitions
of hot templates and hot texts.

Defined results: null texts stay null and empty ones empty; blank lines are never dropped; a
null key sorts after all others; repeated rows give equal results; texts without a dropped line
are returned byte for byte.  Columns named n_lines and n_dropped are replaced, no others.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.storage import Scratch, fresh

DEPTH = 3
SIMILARITY = 0.75
MIN_DOCS = 3
MIN_TOKENS = 6
#: A leaf's rounds go on while one takes this share of the lines it sees; leaders group the others.
SHARE = 0.1
#: Lines of a leaf among which leaders are found at once, about.
SLICE = 1000
BROADCAST_ROWS = 1_000_000
_WS = " \\t\\r\\f\\x0B"
_VARIABLE = f"(?<![^{_WS}])[^{_WS}0-9]*+[0-9][^{_WS}]*+"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, pos, plain, masked): the lines of every text that are not blank; t is the text's hash."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r\f\x0b"))
    plain = rows.where(trimmed != "").select("k", "t", "pos", trimmed.alias("line"))
    masked = F.regexp_replace(F.regexp_replace("line", f"[{_WS}]+", " "), _VARIABLE, "<*>")
    return plain.select("k", "t", "pos", F.col("line").alias("plain"), F.when(F.col("line").rlike("[0-9\\t\\r\\f\\x0B]|  "), masked).otherwise(F.col("line")).alias("masked"))


def _size() -> F.Column:
    """Tokens of a masked line; one space stands between two."""
    return F.octet_length("masked") - F.octet_length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1


def _leaf(depth: int) -> F.Column:
    return F.xxhash64(_size(), F.substring_index("masked", " ", depth))


def _keepers(lines: DataFrame, name: str, least: int) -> DataFrame:
    """(name, keeper): what stands in at least that many different texts, and the first of these."""
    per_text = lines.groupBy(name, "t").agg(F.min(F.struct(F.col("k").isNull().alias("unknown"), "k")).alias("k"))
    often = per_text.groupBy(name).agg(F.count("*").alias("texts"), F.min(F.struct("k", "t")).alias("first")).where(F.col("texts") >= least)
    return often.select(name, F.col("first.t").alias("keeper"))


def _small(rows: DataFrame) -> DataFrame:
    """A saved table of hashes, marked for broadcast up to BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _fits(tokens: F.Column, template: F.Column, similarity: float) -> F.Column:
    same = F.aggregate(F.zip_with(tokens, template, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return same >= similarity * F.size(tokens)


def _generalised(scratch: Scratch, members: DataFrame, similarity: float, templates: int | None) -> DataFrame:
    """(leaf, line, template) of the lines that belong to one of a leaf's templates.

    members: leaf, line, tokens; one row a different line.
    """
    found, rest = [], []
    for step in itertools.count():
        if step == templates:
            return functools.reduce(DataFrame.unionByName, found)
        counts = members.select("leaf", F.posexplode("tokens").alias("i", "token")).groupBy("leaf", "i", "token").count()
        usual = counts.groupBy("leaf", "i").agg(F.max_by("token", F.struct("count", "token")).alias("token"))
        template = usual.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).getField("token").alias("template"))
        tested = members.join(template, "leaf").withColumn("fits", _fits(F.col("tokens"), F.col("template"), similarity))
        tested = scratch.save(tested.select("leaf", "line", "fits", F.when(~F.col("fits"), F.col("tokens")).alias("tokens")), f"template-tested-{step}")
        found.append(tested.where("fits").select("leaf", "line", F.xxhash64(F.lit("leaf"), "leaf", F.lit(step)).alias("template")))
        left = tested.where("not fits")
        if templates is None:
            share = tested.groupBy("leaf").agg(F.avg(F.col("fits").cast("int")).alias("share"))
            left = left.join(share, "leaf").withColumn("open", F.col("share") > 0 if step == 0 else F.col("share") >= SHARE)
            left = scratch.save(left.select("leaf", "line", "tokens", "open"), f"template-left-{step}", compact=True)
            rest.append(left.where("not open").select("leaf", "line", "tokens"))
            left = left.where("open")
            if left.isEmpty():
                return functools.reduce(DataFrame.unionByName, [*found, *_led(scratch, functools.reduce(DataFrame.unionByName, rest), similarity)])
        members = left.select("leaf", "line", "tokens")


def _led(scratch: Scratch, rest: DataFrame, similarity: float) -> list[DataFrame]:
    """(leaf, line, template) of all lines of rest, by their leaders; one table for each slice of the largest leaf.

    rest: leaf, line, tokens; one row a different line.  A leaf is cut into ranges of hashes.
    """
    slices = rest.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    part = F.floor((F.col("line") / float(1 << 64) + 0.5) * F.col("slices"))
    rest = scratch.save(rest.join(slices, "leaf").select("leaf", "line", "tokens", part.alias("part")), "template-rest", compact=True)
    found = []
    while not rest.isEmpty():
        first = rest.groupBy("leaf").agg(F.min("part").alias("part"))
        ordered = rest.join(first, ["leaf", "part"]).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("line", "tokens"))).alias("lines"))
        leaders = F.aggregate("lines", F.filter("lines", lambda x: F.lit(False)), lambda seen, x: F.when(F.exists(seen, lambda y: _fits(x["tokens"], y["tokens"], similarity)), seen).otherwise(F.concat(seen, F.array(x))))
        tested = rest.join(ordered.select("leaf", leaders.alias("leaders")), "leaf")
        leader = F.get(F.filter("leaders", lambda x: _fits(F.col("tokens"), x["tokens"], similarity)), F.lit(0))["line"]
        tested = tested.select("leaf", "line", "tokens", "part", leader.alias("leader"))
        tested = scratch.save(tested, f"template-led-{len(found)}", compact=True)
        found.append(tested.where("leader is not null").select("leaf", "line", F.xxhash64(F.lit("leader"), "leaf", "leader").alias("template")))
        rest = tested.where("leader is null").drop("leader")
    return found


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, long_words: int | None = None, templates: int | None = None) -> DataFrame:
    """(t, dropped): hash of a text, and the positions of its lines that are dropped."""
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs, key, text)
    exact = [] if long_words is None else [F.when(_size() > long_words, F.xxhash64(F.regexp_replace("plain", f"[{_WS}]+", " "))).alias("exact")]
    long_enough = F.when(_size() >= min_tokens, F.col("masked")).alias("masked")
    base = scratch.save(lines.select("k", "t", "pos", F.xxhash64("masked").alias("line"), _leaf(depth).alias("leaf"), _size().alias("n"), long_enough, *exact), "template-lines")

    # leaves with different lines, and the tokens of those lines
    held = base.where(F.col("n") >= min_tokens)
    shared = scratch.save(held.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("leaf"), "template-leaves")
    members = held.select("leaf", "line", "masked").join(_small(shared), "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    members = scratch.save(members.select("leaf", "line", F.split("masked", " ").alias("tokens")), "template-members")
    general = _generalised(scratch, members, similarity, templates)

    named = base.join(general, ["leaf", "line"], "left").select("k", "t", "pos", F.coalesce("template", F.xxhash64("leaf", "line")).alias("template"))
    named = scratch.save(named, "template-named")
    often = scratch.save(_keepers(named, "template", min_docs), "template-often")
    gone = named.join(_small(often), "template").where("t <> keeper").select("t", "pos")
    if exact:
        long = base.where("exact is not null")
        twice = scratch.save(_keepers(long, "exact", 2), "template-long")
        gone = gone.unionByName(long.join(_small(twice), "exact").where("t <> keeper").select("t", "pos"))
    return scratch.result(gone.groupBy("t").agg(F.collect_set("pos").alias("dropped")), "template-dropped")


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[str, str] = ("n_lines", "n_dropped"), **options) -> DataFrame:
    """docs with their texts rewritten, and n_lines and n_dropped (or two other names)."""
    columns = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    t, dropped = fresh(docs.columns, "_t"), fresh([*docs.columns, "_t"], "_dropped")
    found = recurring_lines(docs, key, text, **options).select(F.col("t").alias(t), F.col("dropped").alias(dropped))
    joined = docs.select(*columns, F.xxhash64(text).alias(t)).join(found.hint("merge"), t, "left")  # texts are dealt the same way at every size
    lines, gone = F.split(F.col(text), "\n"), F.col(dropped)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rewritten = F.when(gone.isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(breaks + 1).cast("long")
    n_dropped = F.when(F.col(text).isNull() | gone.isNull(), 0).otherwise(F.size(gone)).cast("long")
    return joined.select(*(rewritten.alias(c) if c == text else F.col(c) for c in columns), n_lines.alias(added[0]), n_dropped.alias(added[1]))


#: Stops after two rounds of a leaf, without leaders: equal where no template found after those recurs.
ORACLE_SQL = r"""
WITH texts AS (SELECT text AS t, min(doc_id) AS k FROM documents WHERE text IS NOT NULL GROUP BY text),
split AS (SELECT t, k, string_split(t, chr(10)) AS ls FROM texts),
exploded AS (SELECT t, k, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
trimmed AS (SELECT t, k, pos, regexp_replace(trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), '[ \t\r\f\x0B]+', ' ', 'g') AS line FROM exploded),
toks AS (SELECT t, k, pos, list_transform(string_split(line, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM trimmed WHERE line <> ''),
base AS (SELECT t, k, pos, tokens, len(tokens) AS n, tokens[1:3] AS head FROM toks),
members AS (SELECT DISTINCT n, head, tokens FROM base WHERE n >= 6),
leaves AS (SELECT n, head FROM members GROUP BY n, head HAVING count(*) > 1),
held AS (SELECT m.* FROM members m JOIN leaves l ON m.n = l.n AND m.head = l.head),
cells AS (SELECT n, head, unnest(tokens) AS token, unnest(range(n)) AS i FROM held),
usual AS (SELECT n, head, i, token FROM (SELECT n, head, i, token, count(*) AS c FROM cells GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n, head, i ORDER BY c DESC, encode(token) DESC) = 1),
agree AS (
  SELECT c.n, c.head, c.tokens FROM (SELECT n, head, tokens, unnest(tokens) AS token, unnest(range(n)) AS i FROM held) c
  LEFT JOIN usual u ON u.n = c.n AND u.head = c.head AND u.i = c.i AND u.token = c.token
  GROUP BY c.n, c.head, c.tokens HAVING count(u.i) >= 0.75 * c.n
),
rest AS (SELECT h.* FROM held h ANTI JOIN agree a ON a.n = h.n AND a.head = h.head AND a.tokens = h.tokens),
cells2 AS (SELECT n, head, tokens, unnest(tokens) AS token, unnest(range(n)) AS i FROM rest),
usual2 AS (SELECT n, head, i, token FROM (SELECT n, head, i, token, count(*) AS c FROM cells2 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n, head, i ORDER BY c DESC, encode(token) DESC) = 1),
agree2 AS (
  SELECT c.n, c.head, c.tokens FROM cells2 c LEFT JOIN usual2 u ON u.n = c.n AND u.head = c.head AND u.i = c.i AND u.token = c.token
  GROUP BY c.n, c.head, c.tokens HAVING count(u.i) >= 0.75 * c.n
),
general AS (SELECT *, 1 AS round FROM agree UNION ALL SELECT *, 2 FROM agree2),
named AS (
  SELECT b.t, b.k, b.pos, CASE WHEN a.n IS NULL THEN 'line ' || array_to_string(b.tokens, ' ') ELSE 'leaf ' || a.round || ' ' || b.n || ' ' || array_to_string(b.head, ' ') END AS template
  FROM base b LEFT JOIN general a ON a.n = b.n AND a.head = b.head AND a.tokens = b.tokens
),
often AS (
  SELECT template, min(k) AS keeper FROM (SELECT DISTINCT template, t, k FROM named) GROUP BY template HAVING count(*) >= 3
),
gone AS (SELECT n.t, n.pos FROM named n JOIN often o ON n.template = o.template WHERE n.k <> o.keeper),
kept AS (
  SELECT e.t, count(g.pos) AS n_dropped, count(*) AS n_lines, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS text
  FROM exploded e LEFT JOIN gone g ON g.t = e.t AND g.pos = e.pos GROUP BY e.t
)
SELECT d.doc_id, coalesce(x.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_dropped, 0)::BIGINT AS n_dropped, sha256(x.text) AS text_sha256
FROM documents d LEFT JOIN kept x ON x.t = d.text
"""
