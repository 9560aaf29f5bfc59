import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldcohort.llm import bpe, registry, splitting, token_counts

RND = random.Random(1)
ODD = ["", "a" * 3000, "é" * 2000, "\x00\x01퟿", " \n\n  x", "abcab" * 1000, "1234567890" * 100, "<|endoftext|> it's we'll", "".join(chr(RND.choice([RND.randrange(32, 127), RND.randrange(160, 0xD7FF), RND.randrange(0x10000, 0x1FFFF)])) for _ in range(2000))]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encoding_matches_the_library(codec, library):
    ids, ends = codec.encode(ODD)
    for text, got in zip(ODD, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == library.encode_ordinary(text)
        assert codec.decode(got) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, library, text):
    ids, _ = codec.encode([text])
    assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_common_characters_split_alike(codec, library):
    assert P.PATTERN == splitting.PATTERN
    for c in [chr(c) for c in range(0x20B0) if not splitting.RARE.search(chr(c))]:
        text = f"a{c}b {c} 1{c}2{c}{c} '{c}s  {c}\n{c}"
        assert codec.split(text) == regex.compile(P.PATTERN).findall(text)
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1' .\n\t\r  éÄ²–€—,_'s")), max_size=60))
def test_common_texts_split_alike(text):
    assert splitting.splitter(P.PATTERN)(text) == regex.compile(P.PATTERN).findall(text)
    assert splitting.splitter(r"\w+")(text) == regex.compile(r"\w+").findall(text)


def test_memo_changes_nothing(codec, monkeypatch):
    texts = ["Unwahrscheinlichkeiten zurückgewiesen " * 3, "quintessentially xylophonic"] * 5
    want = codec.encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "MEMO", 2)
    codec.memo, codec.old = {}, {}
    assert codec.encode(texts)[0].tolist() == want


def test_perfect_hash_is_minimal(codec):
    h = codec.hash
    assert sorted(h.find(h.names).tolist()) == sorted(h.values.tolist()) and len(set(h.names)) == h.n == len(h.values)
    assert h.find(np.array(["no such token at all", ""], dtype=object)).tolist() == [-1, -1]
    assert bpe.PerfectHash([], []).find(np.array(["x"], dtype=object)).tolist() == [-1]


def test_encode_documents_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5), (3, "word " * 300_000, 5)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.ids_sha256 == empty for r in rows] == [True, True, False, False, False, False]
    assert rows[5].decoded_sha256 == hashlib.sha256(b"word " * 300_000).hexdigest() and rows[5].n_tokens == len(rows[5].ids)
    assert bpe.encode_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op3(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op3_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (500, 16), (4000, 200)])
def test_chunks_splice_exactly(chunk, overlap):
    tool = token_counts.Counter(P.path("piece_bpe_32k.model"), chunk, overlap)
    assert tool.stable
    for text in [*ODD, "ab cd" * 900, "   " * 900, "x  y   z " * 400, " a" * 1500, "▁ b" * 400, ("w" * 700 + " ") * 6, "é ü ñ " * 300]:
        assert tool.count(text) == len(tool.model.encode(text)), text[:20]
    assert tool.widened > 0 or chunk > 500


def test_count_cases(spark):
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "a", "<s> b</s>", "é b " * 40_000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, n_bytes string")
    rows = token_counts.count_documents(df, path).collect()
    assert [r.n_tokens for r in rows[:5]] == [len(model.encode(t or "")) for t in texts]
    assert [r.n_bytes for r in rows[:5]] == [len((t or "").encode()) for t in texts] and [r.over_limit for r in rows] == [False] * 4 + [True, False]
    assert token_counts.count_documents(df.limit(0), path).count() == 0


def test_op4(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in registry.op4_token_counts(spark, sf).collect()} == {k: len(model.encode(t)) for k, t in texts.items()}


def test_long_pretokens(monkeypatch):
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(5)
    runs = ["a" * 700, "ab" * 400, "".join(rnd.choice("etaoinshrdlu") for _ in range(3000)), "".join(rnd.choice("the ing and".replace(" ", "")) for _ in range(2000)), "é" * 500, "語" * 300 + "x" * 300]
    short = [codec.merge(r.encode()) for r in runs]
    monkeypatch.setattr(bpe, "LONG", 50)
    assert [codec.merge(r.encode()) for r in runs] == short
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert short[2] == library.encode_ordinary(runs[2])
