"""Permutation index, embedding near-dedup and WARC."""

import base64
import collections
import gzip
import hashlib
import math

import numpy as np
import pytest

from gavelframe.llm import embedding_dedup, permutation_index, warc

SCHEMA = "vec_id long, embedding array<float>, label int"


def near_rows(n=300, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


def cosines(rows):
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("confidence, block_rows", [(4.5, 2048), (4.5, 20), (math.inf, 64)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, confidence, block_rows):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows)  # several cells and blocks a label
    rows = near_rows()
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]  # a group of copies
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), confidence=confidence).collect()}
    labels = np.array([r[2] for r in rows])
    link = (cosines(rows) >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows]
    seen: dict[int, int] = {}
    for i in range(len(rows)):
        if i not in seen:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in seen:
                    seen[j] = i
                    stack += np.flatnonzero(link[j]).tolist()
    for i, key in enumerate(ids):
        assert (got[key].n_links, got[key].component_id) == (link[i].sum(), ids[seen[i]])
        assert got[key].kept == (key == ids[seen[i]])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 600, 64)))
    turn = embedding_dedup.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, factors = embedding_dedup.encode(x, turn)
    guess, error = embedding_dedup.estimate(codes, factors, y @ turn)
    off = (guess - x @ y.T) / error[:, None]
    assert abs(off.mean()) < 0.05 and np.abs(off).max() < 6.5 and (np.abs(off) < embedding_dedup.CONFIDENCE).mean() > 0.9999


ODD = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [0.0, -1.0], 1), (9, [0.0, -1.0], 1), (10, [], 1)]


def test_near_dedup_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as c", "'x' as v", "2 as dim")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    want = sorted([("0", 1, 0), ("1", 1, 0), *((str(i), 0, i) for i in (2, 3, 4, 5, 6, 7, 8, 10)), ("None", 0, None), ("9", 1, 9), ("9", 1, 9)])
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_index_recall_of_every_length_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_BYTES", 900 * 64 * 8)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 16)
    sides = near_rows(2000), [(10_000 + k, v, n) for k, v, n in near_rows(1200, dim=32, seed=7)], [(20_000 + k, v, n) for k, v, n in near_rows(100, dim=3, seed=8)]
    df = spark.createDataFrame([r for side in sides for r in side], SCHEMA)
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, is_query=lambda k: k % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for side in sides:
        c, hits, total, first = cosines(side), 0, 0, side[0][0]
        for q in range(0, len(side), 20):
            best = [first + j for j in np.lexsort((np.arange(len(side)), -c[q])) if j != q][:5]
            mine = sorted(got[first + q])
            assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
            assert all(abs(s - c[q][v - first]) < 1e-12 for _, v, s in mine)
            hits += len(set(best) & {v for _, v, _ in mine})
            total += 5
        assert hits / total >= 0.9


def test_footrule():
    rng = np.random.default_rng(4)
    perms = np.array([rng.permutation(30)[:8] for _ in range(50)], "<u2")
    flat = perms.reshape(-1).astype(int)
    order = np.argsort(flat, kind="stable")
    files = np.searchsorted(flat[order], np.arange(31)).tolist(), order // 8, order % 8
    got = 8 * 9 - 2 * permutation_index.closeness(perms[0].astype(int).tolist(), files, 50, 8)
    place = lambda p: {v: i for i, v in enumerate(p.tolist())}
    a = place(perms[0])
    for x, d in zip(perms, got):
        b = place(x)
        assert d == sum(abs(a.get(v, 8) - b.get(v, 8)) for v in {*a, *b})


def test_vectors_without_permutations_are_all_compared():
    rng = np.random.default_rng(5)
    ids, x = np.arange(1000), rng.standard_normal((1000, 8))
    x[990:] = x[0] + rng.standard_normal((10, 8)) * 0.01
    none = np.empty((1000, 0), "<u2")
    [(q, found, _)] = permutation_index.Shard(ids, x, none, 16).search(ids[:1], x[:1], none[:1], 5, 0.12)
    assert q == 0 and found.min() >= 990 and len(found) == 5


def test_index_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as id", "'x' as v", "2 as perm")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in permutation_index.nearest(df, k=2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (1, 1, 0, 1.0), (1, 2, 7, 1.0), (7, 1, 0, 1.0), (7, 2, 1, 1.0), (9, 1, 0, 0.0), (9, 2, 1, 0.0)]  # a null label does not matter here
    assert permutation_index.nearest(df.limit(0)).count() == 0


ARC = [("http://a/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://x 0 0 0 3\n"), ("-", "0.0.0.0", "19970101000000", "text/html; charset=x", b"")]


@pytest.mark.parametrize("packed", [bytes, gzip.compress, lambda d: gzip.compress(d[:50]) + gzip.compress(d[50:])], ids=["plain", "one member", "two members"])
@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version, packed):
    about, *got = warc.parse_arc(packed(warc.write_arc("n.arc", version, ARC)))
    assert about.about and about.version == version
    assert [(r.url, r.ip, r.date, r.content_type, r.block) for r in got] == ARC and {r.version for r in got} == {version}


def broken(data):
    return [r.problem.split(":")[0] if isinstance(r, warc.Broken) else r.url for r in warc.parse_arc(data)]


@pytest.mark.parametrize("version", [1, 2])
def test_broken_records_are_rejected_and_the_rest_is_read(version):
    good = ("http://b/", "1.2.3.4", "20010203040506", "text/html", b"abc")
    whole = warc.write_arc("n.arc", version, [("http://a/", "0", "0", "text/html", b"no date"), good, ("http://c/", "0", "20010203040506", "t", b"x"), good])
    assert broken(whole) == ["filedesc://n.arc", "no date", "http://b/", "http://c/", "http://b/"]
    assert broken(whole.replace(b"http://c/ 0", b"http://c/")) == ["filedesc://n.arc", "no date", "http://b/", "broken header line", "http://b/"]
    long = warc.write_arc("n.arc", version, [good, good])
    first = long.index(b"http://b/")
    end = long.index(b"\n", first)
    assert broken(long[: end - 1] + b"99999" + long[end:]) == ["filedesc://n.arc", "the record ends early", "http://b/"]
    assert broken(b"http://b/ 0 0 t 3\nabc\n") == ["no version block"]
    assert broken(gzip.compress(long)[:-20])[-1] == "compressed data end early"


def test_types_bytes_and_seeking(spark, tmp_path):
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\ncaf\xe9 \xff".encode("latin-1")
    records = [("http://a/", "1.2.3.4", "20010203040506", "text/html", latin), ("dns:a", "1.2.3.4", "20010203040507", "text/dns", b"20010203 a IN A 1.2.3.4"), ("ftp://a/x", "1.2.3.4", "20010203040508", "image/gif", bytes(range(256))), ("http://b/", "1.2.3.4", "20010203040509", "text/html", latin), ("http://c/", "1.2.3.4", "00000000000000", "text/html", latin)]
    archives = spark.createDataFrame([("one.arc", warc.write_arc("one.arc", 1, records)), ("two.arc.gz", gzip.compress(warc.write_arc("two.arc", 2, records[:1]))), ("none.arc", None)], "name string, archive binary")
    scratch = warc.Scratch(spark)
    rows = scratch.save(warc.convert_arc(archives), "arc-rows")
    assert [(r.archive, r.problem.split(":")[0]) for r in warc.rejects(rows).collect()] == [("one.arc", "no date")]
    manifest = scratch.save(warc.write_warc(warc.with_revisits(scratch, rows, order="date"), str(tmp_path / "out"), file_bytes=300), "arc-manifest")
    read = warc.read_warc(manifest).collect()
    assert manifest.count() > 2 and sum(m.n_records for m in manifest.collect()) == len(read) == 7
    kinds = collections.Counter(r.record_type for r in read)
    assert kinds == {"warcinfo": 2, "response": 2, "revisit": 2, "resource": 1}
    for r in read:
        headers, block = warc.read_record(r.file, r.offset)
        assert headers["warc-record-id"] == r.record_id
        if r.record_type == "resource":
            assert block == bytes(range(256)) and headers["content-type"] == "image/gif"
        if r.uri == "http://a/" and r.record_type == "response":
            assert block == latin
        if r.record_type == "revisit":
            assert block == latin[: latin.index(b"\r\n\r\n") + 4]


def test_warc_contract(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}</p>") for i in range(7)] + [(10, None, None), (11, "a b\nc", ""), (None, "http://x", "<p>0</p>"), (12, "é", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (13, "u", "HTTP/1.1 200\r\n\r\nz\n" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as page", "'x' as header")
    path = str(tmp_path / "warc")
    got = {r.page_id: r for r in warc.warc_round_trip(pages, path=path).collect()}
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first: dict = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(digest(h), k)
    for k, _, h in rows:
        r, other = got[k], first[digest(h)]
        again = k is not None and other != k
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len((h or "").encode()), digest(h), "revisit" if again else "response", other if again else None)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.warc_round_trip(pages, least=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
