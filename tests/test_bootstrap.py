from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcohort.operators import bootstrap as B
from fieldcohort.operators import inference


@pytest.mark.parametrize("sizes", [[5], [3, 0, 4], [10, 1, 1, 8, 20, 5, 2]])
def test_draws_of_blocks_add_up(sizes):
    ends = np.cumsum(sizes).tolist()
    each = np.array([B.block_draws(ends, k, 4000, 7, "g") for k in range(len(sizes))])
    assert (each.sum(axis=0) == sum(sizes)).all() and (each[np.array(sizes) == 0] == 0).all()
    # a multinomial's means and variances
    share = np.array(sizes) / sum(sizes)
    assert np.allclose(each.mean(axis=1), sum(sizes) * share, atol=0.15)
    assert np.allclose(each.var(axis=1), sum(sizes) * share * (1 - share), rtol=0.15, atol=0.05)
    assert (B.block_draws(ends, 0, 50, 7, "h") != B.block_draws(ends, 0, 50, 7, "g")).any() or len(sizes) == 1


def plain_sums(values, draws, seed, group, block):
    """One draw after the other."""
    values, out = np.sort(values), []
    at = B._generator(seed, group, block).integers(0, len(values), int(draws.sum())) if draws.sum() <= B.DRAWS else None
    for m, end in zip(draws, np.cumsum(draws), strict=True):
        out.append(sum(values[i] for i in at[end - m : end]))
    return out


def test_sums_of_a_block(monkeypatch):
    rng = np.random.default_rng(1)
    values, draws = rng.normal(size=30), rng.integers(0, 60, 50)
    assert B.block_sums(values, draws, 3, "g", 2) == pytest.approx(plain_sums(values, draws, 3, "g", 2), abs=1e-9)
    # in pieces of any size, each of its own draws
    monkeypatch.setattr(B, "DRAWS", 7)
    ones = B.block_sums(np.ones(30), draws, 3, "g", 2)
    assert ones.tolist() == draws.tolist() and B.block_sums(values, np.zeros(4, dtype=int), 3, "g", 2).tolist() == [0] * 4


def test_sums_of_repeated_values(monkeypatch):
    rng = np.random.default_rng(4)
    values, draws = rng.choice([1.0, 2.0, 7.0], 3000, p=[0.5, 0.3, 0.2]), np.full(4000, 3000)
    made = []
    monkeypatch.setattr(B, "bisect_right", lambda *a: made.append(a))
    got = B.block_sums(values, draws, 3, "g", 0)
    # no draw is made by itself; mean and variance are those of draws with replacement
    assert not made and got.mean() == pytest.approx(values.sum(), rel=0.001) and got.var() == pytest.approx(3000 * values.var(), rel=0.08)
    monkeypatch.setattr(B, "DRAWS", 5)
    assert B.block_sums(np.ones(60), np.arange(9), 3, "g", 0).tolist() == list(range(9))


def test_means_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    n = 900
    rows = [(["a", "hot", "hot", "hot", None][k % 5], k, float(rng.normal()) if k % 11 else None) for k in range(n)] + [("one", n, 2.5), ("none", n + 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    got = {r.g: r for r in B.bootstrap_means(df, "v", ["g"], "k", replicates=60, seed=4, rows=50).collect()}
    assert set(got) == {"a", "hot", None, "one"}
    blocks = df.where("v is not null and not isnan(v)").select("g", "v", F.xxhash64("k").alias("h")).collect()
    for g, r in got.items():
        own = [(x.h, x.v) for x in blocks if x.g == g]
        many = -(-len(own) // 50)
        parts = [[v for h, v in own if h % many == b] for b in range(many)]
        label = '{"g0":null,"_":0}' if g is None else f'{{"g0":"{g}","_":0}}'
        ends = np.cumsum([len(p) for p in parts]).tolist()
        means = np.zeros(60)
        for b, part in enumerate(parts):
            if part:
                means += plain_sums(np.array(part), B.block_draws(ends, b, 60, 4, label), 4, label, b)
        means /= len(own)
        assert r.n == len(own) and r["mean"] == pytest.approx(np.mean([v for _, v in own]))
        assert (r.ci025, r.ci975) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)
    again = {r.g: r for r in B.bootstrap_means(df.repartition(7), "v", ["g"], "k", replicates=60, seed=4, rows=50).collect()}
    assert set(again) == set(got) and all(tuple(again[g])[1:] == pytest.approx(tuple(got[g])[1:]) for g in got)


def test_means_cover_and_odd_tables(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"k": range(4000), "v": rng.normal(5, 2, 4000)}))
    r = B.bootstrap_means(df, "v", [], "k", replicates=2000, rows=500).first()
    # the standard error is 2 / sqrt(4000)
    assert r.n == 4000 and r.ci025 == pytest.approx(r["mean"] - 1.96 * 2 / 4000**0.5, abs=0.01) and r.ci975 == pytest.approx(r["mean"] + 1.96 * 2 / 4000**0.5, abs=0.01)
    assert B.bootstrap_means(df.limit(0), "v", [], "k").count() == 0
    clash = df.select(F.lit("x").alias("v0"), F.lit("y").alias("label"), F.col("v").alias("block"), F.col("k").alias("h"))
    assert B.bootstrap_means(clash, "block", ["label", "v0"], "h", replicates=10).columns == ["label", "v0", "n", "mean", "ci025", "ci975"]
    monkeypatch.setattr(B, "BLOCKS", 3)
    with pytest.raises(ValueError, match="blocks"):
        B.bootstrap_means(df, "v", [], "k", rows=100)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 5000])
def test_keyed_permutations(n):
    p = B.keyed_permutation(n, 5, "x")
    assert sorted(p.tolist()) == list(range(n)) and p.tolist() == B.keyed_permutation(n, 5, "x").tolist()
    if n > 100:
        assert p.tolist() != B.keyed_permutation(n, 6, "x").tolist()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_permuted_products_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    a, b, whole = rng.normal(size=1000), rng.normal(size=1000), B.keyed_permutation(1000, 5, "x")
    monkeypatch.setattr(B, "PIECE", 64)
    assert (B.keyed_permutation(1000, 5, "x") == whole).all() and B.permuted_product(a, b, 5, "x") == pytest.approx(a @ b[whole])
    assert B.keyed_permutation(0, 5).tolist() == []


def test_permutations_are_uniform():
    seen = Counter(tuple(B.keyed_permutation(4, k).tolist()) for k in range(6000))
    assert len(seen) == 24 and min(seen.values()) > 120 and max(seen.values()) < 480


def test_rank_draws_equal_ranking_anew():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 4)), 1)
    x[:, 1] += x[:, 0]
    own = B.RankDraws(x)
    assert own.rho(np.ones(80)) == pytest.approx(inference.partial_rank(x)[0], abs=1e-12)
    ordered = x[np.lexsort(x.T[::-1])]
    for k in range(30):
        counts = own.draw(1, 2, k)
        assert counts.sum() == 80
        assert own.rho(counts) == pytest.approx(inference.partial_rank(np.repeat(ordered, counts.astype(int), axis=0))[0], abs=1e-9)
    assert B.RankDraws(np.column_stack((x[:, 0], x[:, 1], x[:, 0]))).rho(np.ones(80)) is None
    two = x[:, :2]
    assert B.RankDraws(two).rho(np.ones(80)) == pytest.approx(np.corrcoef(pd.DataFrame(two).rank().T)[0, 1])


def test_partial_draws_against_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(60, 4)), columns=["e", "f", "aq", "c"])
    pdf["f"] = pdf["f"] + 0.8 * pdf["aq"]
    replicates = 70
    got = {r.association: r for r in inference.adjusted_associations(spark.createDataFrame(pdf), {"one": "e", "two": "f"}, "aq", ("c",), replicates, seed=9).collect()}
    for number, (name, column) in enumerate({"one": "e", "two": "f"}.items()):
        x = pdf[[column, "aq", "c"]].to_numpy()
        seen, *_ = inference.partial_rank(x)
        x = x[np.lexsort(x.T[::-1])]
        _, a, b = inference.partial_rank(x)
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        draws, hits = [], 0
        for k in range(replicates):
            at = B._generator(9, number, k).integers(0, 60, 60)
            draws.append(inference.partial_rank(x[at])[0])
            hits += abs(a @ b[B.keyed_permutation(60, 9, number, k, "permuted")]) >= abs(seen) - 1e-12
        r = got[name]
        assert (r.n, r.partial_rho, r.p_value) == (60, pytest.approx(seen), pytest.approx((1 + hits) / (replicates + 1)))
        assert (r.ci025, r.ci975) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])))
    assert got["two"].p_value < 0.05 and got["two"].p_value_holm == pytest.approx(min(1, 2 * got["two"].p_value))
    monkeypatch.setattr(B, "TASK_ROWS", 59)
    with pytest.raises(ValueError, match="60 rows"):
        inference.adjusted_associations(spark.createDataFrame(pdf), {"one": "e"}, "aq", ("c",), 5)


def test_undefined_draws_raise(spark):
    # of two distinct values one is there once: many samples lack it
    rows = [(float(k == 0), float(k), float(k % 5)) for k in range(12)]
    df = spark.createDataFrame(rows, "e double, aq double, c double")
    with pytest.raises(Exception, match="too many undefined"):
        inference.adjusted_associations(df, {"one": "e"}, "aq", ("c",), 50).collect()
    with pytest.raises(Exception, match="undefined"):
        inference.adjusted_associations(df, {"one": "c"}, "aq", ("c",), 5).collect()


@pytest.mark.parametrize("cell", [1, 2, 3])
def test_shuffled_blocks_are_uniform(monkeypatch, cell):
    monkeypatch.setattr(B, "CELL", cell)
    seen = Counter(tuple(B.keyed_permutation(4, k).tolist()) for k in range(6000))
    assert len(seen) == 24 and min(seen.values()) > 180 and max(seen.values()) < 320
    p = B.keyed_permutation(1000, 5, "x")
    assert sorted(p.tolist()) == list(range(1000)) and abs(np.corrcoef(np.arange(1000), p)[0, 1]) < 0.1
    a, b = np.random.default_rng(7).normal(size=(2, 1000))
    assert B.permuted_product(a, b, 5, "x") == pytest.approx(a @ b[p])


def test_draws_of_many_rows_go_block_by_block(monkeypatch):
    monkeypatch.setattr(B, "CELL", 16)
    x = np.random.default_rng(8).normal(size=(50, 3))
    own, ordered = B.RankDraws(x), x[np.lexsort(x.T[::-1])]
    each = np.array([own.draw(1, 2, k) for k in range(4000)])
    # a multinomial's sums, means, variances and covariances
    assert (each.sum(axis=1) == 50).all() and np.allclose(each.mean(axis=0), 1, atol=0.08) and np.allclose(each.var(axis=0), 49 / 50, atol=0.12)
    assert np.cov(each.T)[~np.eye(50, dtype=bool)].mean() == pytest.approx(-1 / 50, abs=0.002)
    for counts in each[:10]:
        assert own.rho(counts) == pytest.approx(inference.partial_rank(np.repeat(ordered, counts, axis=0))[0], abs=1e-9)


def test_repeated_rows_are_one_count():
    rng = np.random.default_rng(9)
    x, often = np.round(rng.normal(size=(20, 3)), 1), rng.integers(4, 30, 20)
    x[:, 1] += x[:, 0]
    own, whole = B.RankDraws(x, often), np.repeat(x, often, axis=0)
    assert (own.n, own.total) == (20, often.sum()) and own.rho(own.often.astype(float)) == pytest.approx(inference.partial_rank(whole)[0], abs=1e-12)
    each = np.array([own.draw(1, 2, k) for k in range(4000)])
    share = own.often / own.total
    assert (each.sum(axis=1) == own.total).all() and np.allclose(each.mean(axis=0), own.often, rtol=0.03) and np.allclose(each.var(axis=0), own.total * share * (1 - share), rtol=0.15)
    ordered = x[np.lexsort(x.T[::-1])]
    assert own.rho(each[0]) == pytest.approx(inference.partial_rank(np.repeat(ordered, each[0].astype(int), axis=0))[0], abs=1e-9)
    # rows that hardly repeat are rows of their own
    assert B.RankDraws(x, np.minimum(often, 3)).n == np.minimum(often, 3).sum()


def test_repeated_rows_of_a_table(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame(rng.normal(size=(40, 3)), columns=["e", "aq", "c"])
    pdf["e"] += pdf["aq"]
    pdf = pd.concat([pdf] * 6)
    got = inference.adjusted_associations(spark.createDataFrame(pdf), {"one": "e"}, "aq", ("c",), 400, seed=3)
    # replicates are drawn in one place of the plan, not again for each of their summaries
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    r, x = got.first(), pdf.to_numpy()
    draws = [inference.partial_rank(x[rng.integers(0, 240, 240)])[0] for _ in range(400)]
    assert (r.n, r.partial_rho) == (240, pytest.approx(inference.partial_rank(x)[0])) and r.p_value == pytest.approx(1 / 401)
    assert (r.ci025, r.ci975) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])), abs=0.03)
