import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_neardup import brute

import corpus_pipeline
from fieldcohort.llm import bpe, common, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf):
    path = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r.doc_id: r.text for r in raw.collect()}
    toxic = {r.doc_id for r in toxicity.score_documents(raw, spark.read.parquet(f"{path}/labels.parquet")).where("toxic").collect()}
    clean = {k: t for k, t in texts.items() if k not in toxic}
    single = {k: clean[k] for k, (_, c) in brute(clean, 5).items() if k == c}
    items = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    left = {k: t for k, t in single.items() if not any(x in t for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) <= set(left) and len(left) - len(got) <= 1
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    masked = {r.doc_id: r.text for r in secrets.redact(raw).collect()}
    for k, r in got.items():
        ids = library.encode_ordinary(masked[k])
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert sum(masked[k] != texts[k] for k in got) > 5


def test_stages_keep_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (None, "some text", "en", "s", 9, 2), (2, "", "en", "s", 0, 3), (3, "word " * 200_000, "en", "s", 1_000_000, 4)], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = common.staged(stage(spark, now, sf), "test")
            assert now.count() == (0 if empty else 4)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == [*COLUMNS, "shard"]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]


def test_stages_on_repeated_rows(spark, sf):
    # rows that repeat, texts that tie, ids that repeat: a stage decides by id, keeps every row of a kept one, and again the same
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long, "en", "s", 9)] * 3 + [(2, long, "en", "s", 9), (2, "another text of its own", "en", "s", 9), (3, "short", "en", "s", 5), (4, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    count = lambda df: sorted(r.doc_id for r in df.collect())
    kept = [1, 1, 1, 3]
    # 2 is a copy of 1 by one of its texts, 4 of 3
    for (name, stage), want in zip(corpus_pipeline.STAGES, ([1, 1, 1, 2, 2, 3, 4], kept, kept, kept, kept), strict=True):
        docs = common.staged(stage(spark, docs, sf), "test")
        assert count(docs) == want, name
