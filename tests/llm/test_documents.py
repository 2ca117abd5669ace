"""Toxicity, mixing, PII, line templates, n-gram join and the pipeline."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gavelframe.llm import components, line_templates, mixing, ngram_join, pii, queries, toxicity
from gavelframe.llm.storage import Scratch
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])


# -- toxicity -------------------------------------------------------------------------------
LEXICON = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0, "veq*": 2.5}, ("trash can",), (-3.0, 2.0, 2.0))


@pytest.mark.parametrize("text, found", [("you idiot", 1), ("You 1D10T!", 1), ("two idiots", 1), ("idіot іdiot", 2), ("ｉｄｉｏｔ", 1), ("idiotic", 0), ("a trash can here", 0), ("trash cannot", 1), ("vequille", 1), ("préveq", 0), ("", 0), ("10.0.0.1 $$$", 0)])
def test_terms_found(text, found):
    assert LEXICON.score(text)[1] == found


def test_scores_fall_with_length():
    short, long = LEXICON.score("idiot")[0], LEXICON.score("idiot " + "fine word " * 500)[0]
    assert 0 <= LEXICON.score("fine")[0] < long < short <= 1


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    tp, fp, fn = (sum(1 for r in got if (r.predicted, r.toxic) == x) for x in ((1, 1), (1, 0), (0, 1)))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.6  # a share of the labels is noise: toxic texts without a term


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(odd_docs, labels)
    assert toxicity.score(odd_docs, lexicon).where("toxicity_score between 0 and 1").count() == odd_docs.count()
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0
    assert toxicity.train(odd_docs, labels.limit(0)) == toxicity.Lexicon({})
    clashing = odd_docs.selectExpr("*", "1 as _toxicity", "2 as _scored", "'old' as toxicity_score")
    got = toxicity.score(clashing, lexicon)
    assert got.columns == [*odd_docs.columns, "_toxicity", "_scored", "toxicity_score", "toxicity_terms"]
    assert got.where("_toxicity = 1 and _scored = 2").count() == odd_docs.count()


def test_padding_does_not_dilute_a_score():
    plain = LEXICON.score("you idiot")[0]
    for padding in (" " * 5000, "\t" * 5000, "\n" * 5000, " . , ! " * 500):
        assert LEXICON.score("you idiot" + padding)[0] == plain


def naive_matches(lexicon, text):
    """Terms found by trying every term at every place."""
    folded, alnum = toxicity.fold(text), lambda c: c.isalnum()
    starts = [i for i in range(len(folded)) if i == 0 or not alnum(folded[i - 1])]
    end_ok = lambda i: i == len(folded) or not alnum(folded[i]) or folded[i] == "s" and (i + 1 == len(folded) or not alnum(folded[i + 1]))
    clear = [(i, i + len(p)) for p in lexicon.exceptions for i in starts if folded.startswith(p, i) and end_ok(i + len(p))]
    total = found = 0
    for i in starts:
        fits = [(w, i + len(t.rstrip("*"))) for t, w in lexicon.terms.items() if folded.startswith(t.rstrip("*"), i) and (t.endswith("*") or end_ok(i + len(t)))]
        if fits:
            weight, end = max(fits)
            if not any(a <= i and end <= b for a, b in clear):
                total, found = total + weight, found + 1
    return round(total, 9), found


def test_automaton_equals_naive_matching():
    import random

    rng = random.Random(9)
    lexicon = toxicity.Lexicon({"idiot": 3.0, "idiots": 2.5, "id*": 0.5, "trash": 2.0, "veq*": 2.5, "a": 0.25}, ("trash can", "veq day", "a trash"))
    parts = ["idiot", "1d1ot", "ID", "iԁiot", "trash", "tr4sh", "can", "cans", "veq", "vequa", "day", "a", "s", " ", "  ", "-", "\n", "é", "7", "ａ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        total, found, _ = lexicon.sums(text)
        assert (round(total, 9), found) == naive_matches(lexicon, text), text


def test_training_rows_that_share_words_are_no_copies():
    import random

    rng = random.Random(3)
    common, rows = [f"common{chr(97 + i)}" for i in range(20)], []
    for i in range(30):
        words = common + [f"own{chr(97 + i)}{chr(97 + j)}" for j in range(10)]
        rng.shuffle(words)
        rows.append(" ".join(words))
    copies = [r + " more" for r in rows]
    assert toxicity.distinct_rows(rows + copies + ["", "a b"]) == [*range(30), 60, 61]


# -- mixing ---------------------------------------------------------------------------------
def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and mixing.mix_sources(no_docs).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd_docs).collect()))


def test_targets_and_taken(spark):
    got = queries.op6_mixing(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("n"), F.sum("size").alias("size")).collect()
    assert sum(r.target for r in got) == pytest.approx(sum(r["size"] for r in got))
    for r in got:
        assert r.n == r["size"] and r.target <= 3 * r.n + 1e-6
        assert abs(r.taken - r.target) <= 0.02 * r.target + 4 * mixing.BLOCK


# -- personal data --------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PII_TEXTS = ["a.b@c.d_e@f.gh x@y 1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "é 4111 1111 1111 1111, 4111-1111-1111-1112 😀 +1 (645) 555-3345.", "mail +49 30 123456 x@y.z@w.v", "+1+2 +3 4", "1" * 5000 + " a@" + "b." * 3000 + "c", "x" * 20000 + "@y.zz", None, "", "5555555555554444\n+12345678"]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)) + [(1, PII_TEXTS[1]), (None, PII_TEXTS[0])], "doc_id long, text string")
    got = pii.find(docs).select("doc_id", pii.spans_text(F.col("base")).alias("b"), pii.spans_text(F.col("spans")).alias("s")).collect()
    assert len(got) == len(PII_TEXTS) + 2
    for r in got:
        want = base_spans(PII_TEXTS[r.doc_id or 0] or "")
        assert r.b == want
        assert set(filter(None, want.split(","))) <= set(r.s.split(","))


def test_loose_candidates_are_added_where_sure(spark):
    rows = [(i, f"Write to user{i}@host{i}.com or call +1 (645) 555-{1000 + i}. Card: 4111 1111 1111 1111") for i in range(60)]
    rows += [(100 + i, f"Email: jane{i} (at) example (dot) com") for i in range(30)] + [(200 + i, f"order {i}4123 version 1.2.3") for i in range(30)]
    got = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect()}
    assert all(got[100 + i].startswith("email:7:") for i in range(30))
    assert all(got[200 + i] == "" for i in range(30))


def test_pii_of_odd_rows_and_redaction(spark, odd_docs, no_docs):
    assert pii.find(odd_docs).count() == odd_docs.count() and pii.find(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "é a@b.cd, ip 1.2.3.4!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "é [email], ip [ip]!", 2: None}


# -- lines ----------------------------------------------------------------------------------
def test_recurring_templates_stay_once(spark):
    line = "Served by node {} in zone west after {} retries today"
    docs = spark.createDataFrame([(i, f"own text number {chr(97 + i)} stays\n" + line.format(i * 7, i)) for i in range(5)] + [(9, "own text number e stays\nunlike any other line")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text.count("\n")) for r in line_templates.drop_recurring_lines(docs).collect()}
    assert got == {0: (2, 0, 1), **{i: (2, 1, 0) for i in range(1, 5)}, 9: (2, 0, 1)}


def test_templates_generalise_beyond_digits(spark):
    docs = spark.createDataFrame([(i, f"user {w} logged in from the {w} office again") for i, w in enumerate(["amber", "blue", "coral", "dusk"])], "doc_id long, text string")
    wide = line_templates.drop_recurring_lines(docs, depth=1, similarity=0.7)
    assert [r.n_dropped for r in wide.orderBy("doc_id").collect()] == [0, 1, 1, 1]
    assert line_templates.drop_recurring_lines(docs, depth=2).where("n_dropped > 0").count() == 0


def test_whole_copies_are_left_alone(spark):
    docs = spark.createDataFrame([(i, "the same long line in every copy of it\nsecond line") for i in range(6)], "doc_id long, text string")
    assert line_templates.drop_recurring_lines(docs).where("n_dropped > 0").count() == 0


def test_long_line_of_two_documents_stays_once(spark):
    passage = " ".join(f"passage{chr(97 + i % 26)} word{chr(97 + i // 26)}" for i in range(26))  # 52 words
    other = " ".join(f"{i}" for i in range(60))
    rows = [(1, f"first own line\n{passage}"), (2, f" {passage}\r\nsecond own line"), (2, f" {passage}\r\nsecond own line"), (3, "short line in two texts\nx"), (4, "short line in two texts\ny"), (5, other), (6, other.replace("7", "8"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, SF).collect())
    assert got == sorted((k, t, len(t)) for k, t in ((k, "second own line" if k == 2 else t) for k, t in rows))


def test_pipeline_drops_every_template_of_a_leaf(spark):
    ends = ["failed on host {} at noon sharp today again", "{} went very well and nobody had to care", "was put off by {} until some other quiet night", "needs {} more discs before anyone can start it"]
    rows = [(f"own words {chr(97 + i)}{w}", f"job alpha beta {end.format(w)}") for i, end in enumerate(ends) for w in ("amber", "blue", "coral")]
    docs = spark.createDataFrame([(i, "\n".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, SF).collect())
    want = ["\n".join(r) if i % 3 == 0 else r[0] for i, r in enumerate(rows)]
    assert got == [(i, t, len(t)) for i, t in enumerate(want)]


def test_a_leaf_has_several_templates(spark):
    first = [f"job alpha beta failed on host {w} at noon sharp today again" for w in ("amber", "blue", "coral", "dusk")]
    second = [f"job alpha beta {w} went very well and nobody had to care" for w in ("amber", "blue", "coral")]
    docs = spark.createDataFrame(list(enumerate(first + second)), "doc_id long, text string")
    dropped = lambda n: [r.n_dropped for r in line_templates.drop_recurring_lines(docs, templates=n).orderBy("doc_id").collect()]
    assert dropped(1) == [0, 1, 1, 1, 0, 0, 0]
    assert dropped(2) == [0, 1, 1, 1, 0, 1, 1]


def test_a_leaf_has_as_many_templates_as_it_takes(spark):
    ends = ["failed on host {} at noon sharp today again", "{} went very well and nobody had to care", "was put off by {} until some other quiet night", "needs {} more discs before anyone can start it", "lost its {} lock while nodes were being moved"]
    lines = [f"job alpha beta {end.format(w)}" for end in ends for w in ("amber", "blue", "coral", "dusk")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.n_dropped for r in line_templates.drop_recurring_lines(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1] * 5


def plain_templates(lines, place):
    """Template of each of a leaf's lines (tuples of tokens): rounds, then leaders in the order of their places."""
    fit = lambda a, b: sum(x == y for x, y in zip(a, b)) >= 0.75 * len(a)
    out, left = {}, set(lines)
    for step in range(len(lines) + 2):
        counts = [collections.Counter(column) for column in zip(*left)]
        usual = [max(c, key=lambda w, c=c: (c[w], w)) for c in counts]
        found = {x for x in left if fit(x, usual)}
        out |= dict.fromkeys(found, step)
        share, left = len(found) / max(len(left), 1), left - found
        if not left or (share == 0 if step == 0 else share < 0.1):
            break
    leaders = []
    for x in sorted(left, key=place.get):
        leader = next((y for y in leaders if fit(x, y)), x)
        leaders += [x] if leader == x else []
        out[x] = leader
    return out


def test_templates_equal_plain_rounds_and_leaders(spark, monkeypatch):
    import random

    rng = random.Random(4)
    heads = [("a", "b", "c"), ("a", "b", "d"), ("e", "f", "g")]
    rows = [(i, (*rng.choice(heads), *("w" + rng.choice("abcde") for _ in range(rng.choice((3, 6, 9)))))) for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    place = {tuple(r.text.split(" ")): r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    leaves = collections.defaultdict(set)
    for _, x in rows:
        leaves[len(x), x[:3]].add(x)
    template = {x: (leaf, t) for leaf, lines in leaves.items() for x, t in plain_templates(lines, place).items()}
    texts, keeper = collections.defaultdict(set), {}
    for i, x in rows:
        texts[template[x]].add(x)
        keeper.setdefault(template[x], x)
    want = [int(len(texts[template[x]]) >= 3 and keeper[template[x]] != x) for _, x in rows]
    assert sum(want) > 100 and any(isinstance(t, tuple) and len(texts[leaf, t]) >= 3 for leaf, t in texts)
    for size in (1000, 5):
        monkeypatch.setattr(line_templates, "SLICE", size)
        assert [r.n_dropped for r in line_templates.drop_recurring_lines(docs).orderBy("doc_id").collect()] == want


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted(map(tuple, line_templates.drop_recurring_lines(docs, long_words=50).collect()))
    small, groups = rows(), brute([tuple(r) for r in docs.collect()])
    monkeypatch.setattr(line_templates, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert rows() == small and joined(docs) == groups


def test_lines_of_odd_rows(odd_docs, no_docs):
    clashing = odd_docs.selectExpr("*", "1 as _t", "2 as _dropped", "3 as n_lines")
    got = line_templates.drop_recurring_lines(clashing)
    assert got.columns == [*odd_docs.columns, "_t", "_dropped", "n_lines", "n_dropped"]
    assert got.where("_t = 1 and _dropped = 2").count() == odd_docs.count()
    got = line_templates.drop_recurring_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert line_templates.drop_recurring_lines(no_docs).count() == 0


# -- n-gram join ----------------------------------------------------------------------------
def brute(rows, n=5):
    sets = []
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((key, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(sets):
        groups[find(i)].append(key)
    return sorted((str(key), len(s), min((k for k in groups[find(i)] if k is not None), default=None)) for i, (key, s) in enumerate(sets))


def joined(docs):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect())


def test_join_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(40)]
    for g in range(25):
        base = passage * (g % 2) + [rng.choice(words) for _ in range(rng.choice((3, 5, 20, 60, 120)))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_join_of_sf001_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert joined(docs) == brute([tuple(r) for r in docs.collect()])


def test_join_of_odd_rows(odd_docs, no_docs):
    assert joined(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert ngram_join.ngram_join(no_docs).count() == 0
    kept = ngram_join.keep_one(odd_docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "None", "5", "7"])


def test_one_row_of_each_group_with_repeated_and_null_keys(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    a, b, c, d = words
    rows = [(3, a, "x"), (5, a + " tail", "x"), (5, b, "x"), (5, b, "x"), (6, c, "x"), (6, c + " tail", "x"), (6, c, "y"), (None, d, "x"), (None, d + " tail", "x"), (None, d + " end", None), (7, None, "x"), (7, None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), (r.text or "none")[0]) for r in kept) == [("3", "a"), ("5", "b"), ("6", "c"), ("7", "n"), ("7", "n"), ("None", "d")]


def test_full_bin_of_frequent_ngrams(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    facts = spark.createDataFrame([(0, i, 9, None, None) for i in range(500)] + [(0, 1000, 90, None, None)], ngram_join.FACTS)
    for size, least in ((400, 320), (1, 1), (2000, 501)):
        monkeypatch.setattr(ngram_join, "TABLE", size)
        keys, counts = ngram_join._frequent(facts)
        assert least <= len(keys) <= size and (len(keys) == 1 or 1000 in keys) and (np.diff(keys) > 0).all() and set(counts) <= {9, 90}
        if size == 400:
            assert joined(docs) == brute([tuple(r) for r in docs.collect()])


def test_sets_that_share_a_class_start_the_join_again(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    want, seeds, real = brute([tuple(r) for r in docs.collect()]), [], ngram_join._joined
    monkeypatch.setattr(ngram_join, "_joined", lambda *a: None if seeds.append(a[-1]) or len(seeds) < 2 else real(*a))
    assert joined(docs) == want and seeds == [0, 2]


def test_suffix_filter_loses_no_pair():
    rng = np.random.default_rng(1)
    bounds = (np.arange(1, ngram_join.RANGES, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)
    sketch = lambda x: np.diff(np.searchsorted(x, bounds), prepend=0, append=len(x))[None, :]
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.int64).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.75, 0.9, 1.0])], rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.int64).astype(np.uint64)]))
        assert ngram_join.may_reach(sketch(x), sketch(y), 75)[0] or not ngram_join.similar(x, y, 75)


def test_rows_with_maps_are_told_apart(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'one two' AS text, map('a', 1) AS m UNION ALL SELECT 1L, 'one two', map('a', 1) UNION ALL SELECT 1L, NULL, map('a', 1) UNION ALL SELECT 1L, NULL, map('a', 2)")
    assert ngram_join.keep_one(docs).count() == 3


def test_distributed_components_equal_one_task(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10] + [(100, 3), (7, 100), (60, 60)], "a long, b long")
    scratch = Scratch(spark)
    one = sorted(map(tuple, components.components(scratch, edges, "one").collect()))
    many = sorted(map(tuple, components.components(scratch, edges, "many", one_task=0).collect()))
    assert one == many and (100, 1) in one


# -- pipeline -------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "bpe"]
    scratch = Scratch(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, before, SF), f"test-{name}")
        assert after.schema.names == docs.schema.names and 0 < after.count()
        if name != "mixing":
            assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() <= before.count()
        if name == "near_duplicates":
            kept = {r[0] for r in after.select("doc_id").collect()}
            rows = brute([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert kept == {c for _, _, c in rows}
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert final.count() == before.count()
    mine = {r.doc_id: r.decoded_sha256 for r in final.collect()}
    assert all(mine[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())


def test_pipeline_takes_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = Scratch(spark).save(stage(spark, out.selectExpr("*", "1 as _row", "2 as _t", "3 as _toxicity") if name != "bpe" and "_row" not in out.columns else out, str(tmp_path)), f"odd-{name}")
            if name == "near_duplicates":
                kept = sorted(str(r.doc_id) for r in out.collect())
                assert kept == (["0", "1", "2", "3", "4", "5", "7", "None"] if docs is odd_docs else [])
            assert name == "bpe" or out.where("not (_row = 1 and _t = 2 and _toxicity = 3)").isEmpty()
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(out.columns)
        assert (out.count() > 0) == (docs is odd_docs)
