"""BPE codec and token files against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gavelframe.llm import bpe, queries, token_files
from gavelframe.llm.segments import pieces_of
from tests.llm.conftest import LONG

TEXTS = ["", " ", "  a  b ", "a\n b\n\n c ", "<|endoftext|> hi<|endoftext|>x  <|endoftext|>", "a" * 1000, "don't we'll I'M 12 ½ ² é 　x y\x1cz \x85 ​\U0001f600\U0001f468‍\U0001f469", "\ta\tb \r\n c", "的的的 漢字 テスト", " lead", "trail ", "\n \n", " \n x", "''s 's 'S", "ab\x1c cd \x1f ef", "x  y  z", LONG[:50_000]]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def split(ids, lengths):
    cut = np.concatenate([[0], np.cumsum(lengths)])
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


@pytest.mark.parametrize("make", [lambda: bpe.codec(queries.VOCABULARY).encode, lambda: token_files.library_encoder(queries.VOCABULARY)], ids=["merge rounds", "library"])
def test_same_ids_as_the_library(make, library):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "é", "ß", "12", "　", "!", "\U0001f600", "\t", "\x1c", "<|endoftext|>", "X"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    assert split(*make()(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_decode_equals_the_library(library):
    codec = bpe.codec(queries.VOCABULARY)
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 50257, n).tolist() for n in (0, 1, 2, 50, 400)] + [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    got = codec.decode(np.concatenate([np.array(x, np.int64) for x in lists]), np.array([len(x) for x in lists]))
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_memo_limits_change_nothing(library):
    codec = bpe.BytePairCodec(queries.VOCABULARY)
    codec.texts.pieces.limit = codec.texts.words.limit = 50
    for _ in range(3):
        assert split(*codec.encode(TEXTS)) == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


def test_pieces_join_back():
    for t in TEXTS:
        assert " ".join(pieces_of(t)) == t


def test_letters_and_white_space_are_those_of_the_library(library):
    rng = random.Random(8)
    alphabet = ["\u0558", "\u1c8a", "'s", "\u2019", " ", " ", "\x85", "\xa0", "\u3000", "\u2028", "\n", "\n\n", "\x00", "no", "7", "\u0663", "!", "<|endoftext|>", "\u201c", "\u0301"]
    texts = ["\u0558's x", "", "a\u201d \u2014 b"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(2_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    small = token_files.LibraryEncoder(queries.VOCABULARY, word_bytes=100)
    got = [ids for i in range(0, len(texts), 50) for ids in split(*small(pa.array(texts).slice(i, 50)))]
    assert got == want


def test_pieces_of_a_column_begin_at_safe_spaces():
    data, offsets = token_files.raw(pa.array(TEXTS).slice(1))
    cuts = set(token_files.safe_spaces(data, offsets).tolist())
    for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), TEXTS[1:]):
        at = [a, *sorted(c for c in cuts if a <= c < b), b]
        assert [bytes(data[x:y]).decode() for x, y in zip(at[:-1], at[1:])] == [" " * (i > 0) + p for i, p in enumerate(pieces_of(t))]


def test_encoding_takes_under_half_the_cpu_time_of_whole_texts_through_the_library(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(4_000).collect()]
    encoder = token_files.LibraryEncoder(queries.VOCABULARY)
    began = time.process_time()
    _, lengths = encoder(texts)
    middle = time.process_time()
    assert lengths.tolist() == [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert middle - began < 0.5 * (time.process_time() - middle)


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_op4_contract(spark, odd_docs, no_docs, library):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_digests(bpe.round_trip(odd_docs, queries.VOCABULARY)).collect())
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), digest(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(no_docs, queries.VOCABULARY).count() == 0


def test_encode_then_decode(odd_docs):
    back = bpe.decode(bpe.encode(odd_docs.where("doc_id is not null"), queries.VOCABULARY), queries.VOCABULARY)
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id is not None)


def test_op3_contract(spark, odd_docs, no_docs, library):
    got = token_files.token_files(spark, odd_docs, queries.VOCABULARY).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(spark, no_docs, queries.VOCABULARY).count() == 0


def test_files_are_flat_and_mapped(spark, odd_docs, tmp_path, library):
    path = str(tmp_path / "files")
    manifest = token_files.Scratch(spark).save(token_files.write_token_files(odd_docs, lambda: token_files.library_encoder(queries.VOCABULARY), path, 0, 4), "m")
    for m in manifest.collect():
        keys, nulls, offsets, ids = token_files.read_shard(m.bin, m.idx, 4)
        assert isinstance(ids, np.memmap) and ids.dtype == np.dtype("<u4") and offsets.dtype == np.dtype("<i8")
        assert len(ids) == offsets[-1] == m.n_tokens and len(keys) == m.n_docs == len(nulls)
    listed = token_files.read_token_files(manifest, 4, with_ids=True).where("doc_id = 0").first()
    assert listed.ids == [*library.encode("alpha beta gamma delta epsilon zeta eta theta", add_special_tokens=False).ids, 0]


def test_ids_that_do_not_fit_raise(spark, odd_docs, tmp_path):
    with pytest.raises(Exception, match="more than 1 bytes"):
        token_files.write_token_files(odd_docs, lambda: token_files.library_encoder(queries.VOCABULARY), str(tmp_path / "x"), 0, 1).collect()
