import glob
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from fieldcohort.llm import registry, sharding, topk


def brute(rows, k=20, every=20):
    out = []
    for q, a in rows:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16384, 1024), (37, 3)])
@pytest.mark.parametrize("values", [4, 1000])
@pytest.mark.parametrize("seeds", [4096, 30])
def test_against_brute_force(spark, monkeypatch, blocks, values, seeds):
    monkeypatch.setattr(topk, "SEED", seeds)
    monkeypatch.setattr(topk, "LEAST", 40)
    rng = np.random.default_rng(values)
    rows = [(k, (rng.integers(-values, values, 6) / 64).astype(np.float32)) for k in range(150)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, candidate_block=blocks[0], query_block=blocks[1]).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute([(k, np.floor(64 * v.astype(float)).astype(int)) for k, v in rows])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [3.0, -1.0]), (5, [3.0, -1.0]), (6, [1.0]), (40, []), (7, [])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(df, k=3).collect()
    by = {q: [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 40)}
    assert by[0] == [(1, 5, 64 * 64), (2, 5, 64 * 64), (3, 20, 0)] and by[20] == [(1, 0, 0), (2, 5, 0), (3, 5, 0)] and by[40] == [(1, 7, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_reading_stops_early():
    # one dimension carries the scores: its list alone settles the answer
    rng = np.random.default_rng(0)
    v = np.column_stack((rng.permutation(20000), rng.integers(0, 2, 20000))).astype(np.float64)
    ids, scores, read = topk.SortedLists(np.arange(20000), v).top(-1, np.array([10.0, 0.0]), 5)
    assert scores.tolist() == [199990, 199980, 199970, 199960, 199950] and read < 1000


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
@pytest.mark.parametrize("spread", [0.0, 0.5, 1.5])
def test_lists_against_products(kind, spread):
    # weights that fall off: the steeper, the less is read; a floor changes nothing above it
    rng = np.random.default_rng(int(10 * spread))
    v = np.floor(rng.normal(size=(3000, 12)) * 40 / (1 + np.arange(12)) ** spread).astype(kind)
    lists, ids = topk.SortedLists(np.arange(3000), v), np.arange(3000)
    queries, owns = v[:60], np.arange(60)
    floors = np.array([np.sort(q @ v[:500].T)[-8] for q in queries], dtype=kind)
    want = [sorted(zip((-(v @ q)).tolist(), ids.tolist(), strict=True)) for q in queries]
    want = [[x for x in w if x[1] != own][:7] for w, own in zip(want, owns, strict=True)]
    for got in (
        {p: (i, s) for p, i, s, _ in lists.answer(owns, queries, 7, floors)},
        {p: (i, s) for p, i, s, _ in lists.answer(owns, queries, 7, np.full(60, topk._lowest(np.dtype(kind)), dtype=kind))},
        {p: lists.top(owns[p], queries[p], 7)[:2] for p in range(60)},
        {p: lists.top(owns[p], queries[p], 7, floors[p])[:2] for p in range(60)},
    ):
        assert {p: list(zip((-s).tolist(), i.tolist(), strict=True)) for p, (i, s) in got.items()} == dict(enumerate(want))
    read = [lists.top(owns[p], queries[p], 7, floors[p])[2] for p in range(60)]
    assert np.mean(read) < 3000 * (1.01 if spread < 1 else 0.3)
    none = lists.top(-1, queries[0], 7, kind(10**6))
    assert none[2] == 0 and not len(none[0])


def test_op6_matches_sql(spark, sf):
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, registry.op6_threshold_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(duckdb.sql(f"select query_id, rank, vec_id, score from ({registry.OP6_SQL})").fetchall())


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_curve_is_continuous(spark, bits):
    n = 1 << bits
    grid = spark.range(n**3).selectExpr(f"cast(id % {n} as int) a", f"cast(id div {n} % {n} as int) b", f"cast(id div {n * n} as int) c")
    rows = sorted(tuple(r) for r in grid.select(sharding.hilbert_index([grid.a, grid.b, grid.c], bits).alias("h"), "a", "b", "c").collect())
    assert [r[0] for r in rows] == list(range(n**3))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def check_rows_law(rows, n, shards=16):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and (n < shards or max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in rows} <= {"rows"} and {r.grown_shard for r in rows} <= {None}


def test_op7(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op7_hilbert_sharding(spark, sf).collect()
    check_rows_law(rows, len(texts))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def hilbert(point, bits):
    """The place of a point on the curve, by going down the octants and turning the rest of the way into each."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(n):
            if x[k] >> b & 1:
                x[0] ^= low
            else:
                t = (x[0] ^ x[k]) & low
                x[0], x[k] = x[0] ^ t, x[k] ^ t
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_op7_by_sorting_everything(spark, sf):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    cell = lambda v: zlib.crc32(("null" if v is None else v).encode()) % 16

    def salt(*values):
        h = 42
        for v in values:
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h % 256 if h < 1 << 63 else (h - (1 << 64)) % 256

    rows = []
    for doc_id, text, lang, source in docs:
        size, crc = len((text or "").encode()) + 1, None if text is None else zlib.crc32(text.encode())
        curve = hilbert((cell(source), cell(lang), min(15, size.bit_length() - 1)), 4)
        rows.append((curve, salt(doc_id, size, crc), doc_id, size, crc))
    rows.sort()
    n = len(rows)
    got = {r.doc_id: (r.curve, r.size, r.text_crc32, r.shard, r.slot) for r in registry.op7_hilbert_sharding(spark, path).collect()}
    for rank, (curve, _, doc_id, size, crc) in enumerate(rows):
        shard = rank * 16 // n
        assert got[doc_id] == (curve, size, crc, shard, rank - (shard * n + 15) // 16)
    assert len(got) == n


def test_sharding_cases(spark):
    rows = [(k % 7, "same text", "en", "src0", 1) for k in range(40)] + [(None, None, None, None, 1), (100, "", "de", "x", 1), (101, "é" * 100_000, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = sharding.shard(df, salts=3).collect()
    check_rows_law(got, 43)
    by = {r.doc_id: r for r in got}
    assert (by[None].size, by[None].text_crc32, by[100].size, by[100].text_crc32, by[101].size) == (1, None, 1, 0, 200_001)
    assert sharding.shard(df.limit(0)).count() == 0


def test_written_shards_prune(spark, sf):
    from fieldcohort.llm import common

    path = common.scratch(spark, "shards")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, path, shards=4)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def opened(path, column, cell):
    """How many of the shards' files a reader opens that knows their min/max statistics, how many hold the cell, and how many there are."""
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/shard=*/*.parquet")]
    at = files[0].schema_arrow.names.index(column)
    stats = [[f.metadata.row_group(g).column(at).statistics for g in range(f.metadata.num_row_groups)] for f in files]
    may = [any(s.min <= cell <= s.max for s in groups) for groups in stats]
    holds = [cell in f.read([column])[column].to_pylist() for f in files]
    assert all(m for m, h in zip(may, holds, strict=True) if h)
    return sum(may), sum(holds), len(files)


def test_filters_skip_files(spark):
    from fieldcohort.llm import common

    docs, path = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), common.scratch(spark, "shards")
    sharding.write_shards(docs, path)
    back, local = spark.read.parquet(path), path.removeprefix("file://")
    assert back.columns == [*docs.columns, "source_cell", "lang_cell", "size_cell", "slot", "curve", "shard"]
    for column in ("source", "lang"):
        read = []
        for value in [r[0] for r in docs.select(column).distinct().collect()]:
            cell = sharding.cells_of(**{column: value})[f"{column}_cell"]
            number = spark.range(1).select(cell).first()[0]
            read.append(opened(local, f"{column}_cell", number))
            want = docs.where(docs[column] == value).count()
            assert back.where((back[f"{column}_cell"] == cell) & (back[column] == value)).count() == want
        files = read[0][2]
        # a reader without the coordinate has to open all files
        assert files >= 16 and np.mean([m for m, _, _ in read]) <= 0.75 * files, read
    sizes = [opened(local, "size_cell", k) for k in (7, 9, 11)]
    assert np.mean([m for m, _, _ in sizes]) <= 0.9 * files, sizes


def test_written_shards_of_odd_rows(spark):
    from fieldcohort.llm import common

    rows = [(k % 5, "same text", "en", "src0", k) for k in range(20)] + [(None, None, None, None, 1), (None, None, None, None, 2), (100, "", "de", "x", 3)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int"), common.scratch(spark, "shards")
    sharding.write_shards(df, path, shards=3)
    back = spark.read.parquet(path).collect()
    assert sorted(Counter((r.doc_id or -1, r.text or "") for r in back).items()) == sorted(Counter((d or -1, t or "") for d, t, *_ in rows).items())
    check_rows_law([r for r in spark.createDataFrame(back).withColumnsRenamed({}).selectExpr("shard", "slot", "'rows' law", "cast(null as int) grown_shard").collect()], 23, 3)
    sharding.write_shards(df.limit(0), path + "-none", shards=3)


def test_written_shards_keep_every_column(spark):
    from fieldcohort.llm import common

    names = ["__id", "__size", "__crc", "__k", "id", "size", "crc", "k", "row", "cells", "a.b", "rank", "salt", "shard"]
    rows = [(n, f"text {n % 3}", "en", "s", *[f"{c}{n}" for c in names]) for n in range(30)]
    df, path = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names]), common.scratch(spark, "shards")
    sharding.write_shards(df, path, shards=3)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"doc_id", "text", "lang", "source", *names, *sharding.ADDED}
    for r in back.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in names if c not in sharding.ADDED) and r.text == f"text {r.doc_id % 3}"
