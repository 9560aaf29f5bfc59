import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from fieldcohort.llm import common, registry, token_files

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, kind string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def brute(rows, library):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) in file order, where ids are distinct."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def written(spark, docs, **how):
    path = common.scratch(spark, "test-tokens")
    token_files.write_files(docs, path, PATH, **how)
    return path


def read(spark, path):
    return sorted((tuple(r) for r in token_files.read_files(spark, path).collect()), key=lambda r: r[1])


def test_query_against_the_library(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in registry.op11_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == brute(docs, library)


def test_files_are_flat_and_mapped(spark, library):
    rows = [(k, f"document {k} " * (k % 7 + 1)) for k in random.Random(3).sample(range(-500, 500), 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = written(spark, docs, file_bytes=1500)
    files = token_files.corpus_files(spark, path).orderBy("number").collect()
    assert len(files) > 3
    want, base = brute(rows, library), 0
    texts, ids = dict(rows), []
    for f in files:
        raw = np.fromfile(re.sub("^file:/*", "/", f["ids_uri"]), dtype="<u2")
        index = np.fromfile(re.sub("^file:/*", "/", f["index_uri"]), dtype=token_files.INDEX)
        assert f["base"] == base and f["ids_size"] == 2 * len(raw) and list(index["start"]) == sorted(index["start"])
        pair = token_files.Pair(f["ids_uri"], f["ids_size"], f["index_uri"], f["index_size"])
        for k, doc_id in enumerate(index["doc_id"].tolist()):
            one = pair.document(k)
            assert one[-1] == 0 and library.decode(one[:-1].tolist()) == texts[doc_id]
        base += len(raw)
        ids += raw.tolist()
    assert read(spark, path) == want and len(ids) == base == want[-1][1] + want[-1][2]


def test_ranged_reads_equal_maps(spark):
    path = written(spark, spark.createDataFrame([(k, "a b c " * k) for k in range(20)], "doc_id long, text string"))
    f = token_files.corpus_files(spark, path).first()
    mapped = token_files.Flat(f["ids_uri"], np.dtype("<u2"), f["ids_size"])
    ranged = token_files.Flat(f["ids_uri"], np.dtype("<u2"), f["ids_size"])
    ranged.file = fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", f["ids_uri"]))
    assert mapped[3:9].tolist() == ranged[3:9].tolist() and mapped[:].tolist() == ranged[0 : mapped.n].tolist()


def test_odd_rows(spark, library, monkeypatch):
    # nulls, empty texts, special strings, long texts, other columns with names used inside
    rows = [(None, "no id", 7, "x"), (3, None, 7, "x"), (1, "", 7, None), (-(1 << 63), "smallest", 7, "x"), ((1 << 63) - 1, "a <|endoftext|> b", 7, "x"), (2, "word it's " * 100_000 + "\n\n  end", 7, "x"), (4, "y" * 50_000, 7, "x"), (5, "é 　 🙂 ", 7, "x")]
    monkeypatch.setattr(token_files, "READ_IDS", 1000)
    assert read(spark, written(spark, spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows], library)


def test_repeated_and_empty(spark, library):
    # a third of all rows share an id, others are equal in everything: all are there, next to each other, files stay even
    rows = [(7, f"text {k % 40}") for k in range(300)] + [(None, "same")] * 300 + [(k, "own") for k in range(1000, 1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = written(spark, docs, file_bytes=400)
    got = read(spark, path)
    assert [g[0] for g in got] == [None] * 300 + [7] * 300 + list(range(1000, 1300))
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    assert sorted((g[0] or -1, g[3]) for g in got) == sorted((r[0] or -1, crc([*library.encode(r[1]).ids, 0])) for r in rows)
    sizes = [r.index_size // 16 for r in token_files.corpus_files(spark, path).collect()]
    assert max(sizes) < 4 * len(rows) / len(sizes)
    assert read(spark, written(spark, docs.limit(0))) == []


def same(tool, library, text):
    return np.frombuffer(tool.encode(text), dtype=tool.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_change_nothing(library):
    tool = token_files.Encoder(PATH, piece=5)
    tool.split = None
    texts = ["one two  three   four\n five\tsix it's we'll 'tis  ", "<|endoftext|> a<|endoftext|> b", "a  b \x1c c   d", "x" * 100]
    assert len(tool.pieces(texts[0])) > 3
    for t in texts:
        assert same(tool, library, t)


def test_common_texts(library):
    tool = token_files.Encoder(PATH, most=7)
    texts = ["it's we'll IT'S 'tis  two   blanks\n\n\tÄrger ñandú ²½ 12345 – “quoted” … 5€ ", "a" * 500, ""]
    for t in texts * 2:
        assert tool.common(t) and same(tool, library, t)
    assert len(tool.memo) <= 7 and len(tool.memo.old) == 7 and "a" * 500 not in tool.memo
    for t in ("a\x0bb", "日本", "a\u00a0b", "x<|endoftext|>y", "🙂"):
        assert not tool.common(t) and same(tool, library, t)


@pytest.fixture(scope="module")
def tools():
    slow = token_files.Encoder(PATH, piece=3)
    slow.split = None
    return slow, token_files.Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1' .\n\t  éÄ²–€—,")), max_size=60) | st.text(max_size=40))
def test_any_text(tools, library, text):
    assert all(same(t, library, text) for t in tools)


def test_every_character_of_common_texts(library):
    tool = token_files.Encoder(PATH)
    chars = [chr(c) for c in range(0x20B0) if not token_files.RARE.search(chr(c))]
    assert len(chars) > 500
    for c in chars:
        assert same(tool, library, f"a{c}b {c} 1{c}2{c}{c} '{c}s")


def test_other_tokenizers():
    tool = token_files.Encoder(P.path("word_bpe_49k.json"), piece=5)
    assert not tool.cuts and not tool.common("a") and tool.pieces("a b c d e f g") == ["a b c d e f g"] and tool.dtype == np.dtype("<u2")
