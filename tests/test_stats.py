import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.functions import special
from fieldcohort.operators import inference, resample, stats


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1)], "k string, p double, g int")
    got = {r.k: r.p_holm for r in stats.holm(df, "p", ["g"], "k").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_ranks_and_rho(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.arange(60) % 2, "x": rng.integers(0, 8, 60).astype(float), "y": rng.normal(size=60)})
    rows = stats.spearman(spark.createDataFrame(pdf), "x", "y", ["g"]).collect()
    for r in rows:
        part = pdf[pdf.g == r.g]
        assert r.rho == pytest.approx(np.corrcoef(part.x.rank(), part.y.rank())[0, 1], abs=1e-12) and r.n == 30


def test_constant_column_has_no_rho(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").withColumn("g", F.lit(1))
    assert stats.spearman(df, "x", "y", ["g"]).first().rho is None


def test_t_tail_by_integration():
    for r, n in ((0.3, 20), (-0.7, 210), (0.05, 12)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        u = np.linspace(0, 1, 400_001)[:-1]
        x = t + u / (1 - u)
        f = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2) / (1 - u) ** 2
        assert special.correlation_p(r, n) == pytest.approx(2 * np.trapezoid(f, u), rel=1e-5)
    assert special.correlation_p(1.0, 10) == 0 and math.isnan(special.correlation_p(0.5, 2))


def test_wilcoxon_against_enumeration(spark):
    d = [1.0, -2.0, 3.0, 4.0, 0.0, -5.0, 6.0]
    df = spark.createDataFrame([(1, v) for v in d], "g int, d double")
    r = stats.wilcoxon(df, "d", ["g"], "wilcox").first()
    assert (r.n, r.w_plus, r.w_minus, r.statistic) == (6, 1 + 3 + 4 + 6, 2 + 5, 7)
    p = stats.wilcoxon(df, "d", ["g"], "pratt").first()
    assert (p.n, p.w_plus, p.w_minus) == (7, 2 + 4 + 5 + 7, 3 + 6)
    zero = stats.wilcoxon(spark.createDataFrame([(1, 0.0)], "g int, d double"), "d", ["g"]).first()
    assert zero.statistic == 0 and zero.z is None


def test_paired_advantage(spark):
    long = spark.createDataFrame([(f"s{s}", m, r, e + s / 100) for s in range(25) for m, e in (("reference", 4.0), ("better", 3.0)) for r in (1, 2)], "subject string, model string, repeat int, absolute_error double")
    r = inference.paired_comparisons(long, "reference", ["better"], 100).first()
    assert r.mean_advantage == pytest.approx(1.0) and r.ci025 > 0.99 and r.improved_fraction == 1.0 and r.p_value < 1e-4


def test_summary_skips_nonfinite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (3.0,)], "v double")
    r = df.agg(*X.summary(F.col("v"), "v")).first()
    assert r.v_n_voxels == 3 and r.v_median == 2.0
    empty = df.where("v < 0").agg(*X.summary(F.col("v"), "v")).first()
    assert empty.v_n_voxels == 0 and empty.v_mean is None


def test_summarize_one_repeat(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "repeat int, model string, mae double")
    assert stats.summarize_metrics(df, "model", "repeat", ["mae"]).first().mae_sd == 0.0


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 5, 10]], "v double")
    n = [r.n for r in stats.histogram(df, "v", 10).orderBy("bin").collect()]
    assert n == np.histogram([0, 0, 1, 5, 10], 10)[0].tolist()
    flat = stats.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in flat] == np.histogram([2, 2, 2], 4)[0].tolist() and flat[0].low == 1.5


def test_bootstrap_depends_on_nothing_but_keys(spark):
    df = spark.createDataFrame([(1, k, float(k * k % 17)) for k in range(40)], "g int, k int, v double")
    a = resample.bootstrap_mean(df, "v", ["g"], "k", 200).first()
    b = resample.bootstrap_mean(df.repartition(3), "v", ["g"], "k", 200).first()
    assert a == b and a.ci025 < a["mean"] < a.ci975


def test_permutation(spark):
    df = spark.createDataFrame([(1, k, float(k), float(k)) for k in range(20)], "g int, k int, x double, y double")
    assert resample.permutation_test(df, "x", "y", ["g"], "k", 99).first().p_value == pytest.approx(0.01)


def test_partial_rank_takes_out_a_confounder(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=200)
    x, y = c + rng.normal(scale=0.1, size=200), c + rng.normal(scale=0.1, size=200)
    crude = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert crude > 0.9 and abs(inference.partial_rank(np.column_stack((x, y, c)))[0]) < 0.3
    with pytest.raises(ValueError):
        inference.partial_rank(np.column_stack((c, y, c)))


def test_adjusted_associations_repeat(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(40, 4)), columns=["e", "f", "aq", "c"])
    df = spark.createDataFrame(pdf)
    run = lambda: sorted(map(tuple, inference.adjusted_associations(df, {"one": "e", "two": "f"}, "aq", ("c",), 50).collect()))
    assert run() == run() and len(run()) == 2


def test_pipelines_must_pair_up(spark):
    from fieldcohort.operators.contracts import ContractError

    a = spark.createDataFrame([(k, f"s{k}", 1, 1, "m", float(k), 1.0) for k in range(4)], "case_id int, subject string, repeat int, outer_fold int, model string, predicted double, absolute_error double")
    assert inference.paired_pipelines(a, a, 5).first()["mean"] == 0.0
    with pytest.raises(ContractError):
        inference.paired_pipelines(a, a.limit(3), 5)


def test_variant_agreement(spark):
    rows = [(k, 20.0 + 3 * k, float(k), k / 50, k / 70) for k in range(24)]
    primary = spark.createDataFrame(rows, "case_id int, wab_aq double, hhd_a double, hhd_b double, hhd_c double")
    variant = primary.select("case_id", F.lit("same").alias("variant"), (F.col("case_id") != 3).cast("string").alias("velocity_qc_pass"), *[F.col(f"hhd_{f}").alias(f) for f in "abc"])
    got = inference.variant_agreement(primary, variant, ["a", "b", "c"], "wab_aq").collect()
    assert len(got) == 3 and all(r.n == 23 and r.rho_primary == pytest.approx(1) and r.median_abs_difference == 0 for r in got)
    assert inference.feature_ranges(spark.createDataFrame(got)).count() == 3


def test_ranks_by_runs(spark):
    # values of all sizes and signs, with ties: runs must not change their order
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-8, 9, 300), rng.integers(-4, 5, 200).astype(float), 2.0 ** np.arange(-20, 20), -(2.0 ** np.arange(-20, 20)), np.nextafter(2.0 ** np.arange(-20, 20), 0)])
    pdf = pd.DataFrame({"g": np.arange(len(v)) % 3, "v": v, "k": np.arange(len(v))})
    got = {r.k: r.r for r in stats.ranked(spark.createDataFrame(pdf), "v", ["g"], "r").collect()}
    want = pdf.groupby("g")["v"].rank()
    assert [got[k] for k in range(len(v))] == want.tolist()
    runs = [r.x for r in spark.createDataFrame([(x,) for x in sorted(v.tolist())], "v double").select(stats.run_of(F.col("v")).alias("x")).collect()]
    assert runs == sorted(runs)


def test_exact_signed_rank_p(spark):
    d = [1.5, -2.0, 3.0, 4.0, -5.5, 6.0, 7.0]
    r = stats.signed_rank_test(spark.createDataFrame([(1, v) for v in d], "g int, d double"), "d", ["g"]).first()
    sums = [sum(k + 1 for k in range(7) if m >> k & 1) for m in range(128)]
    assert r.statistic == 7 and r.p_value == pytest.approx(min(1, 2 * sum(s <= 7 for s in sums) / 128))
    # zeros, ties or many differences: the normal approximation
    for rows in ([0.0, *d], [1.5, *d], list(range(1, 60))):
        df = spark.createDataFrame([(1, float(v)) for v in rows], "g int, d double")
        z = stats.wilcoxon(df, "d", ["g"]).first().z
        assert stats.signed_rank_test(df, "d", ["g"]).first().p_value == pytest.approx(special.normal_two_sided(z))
    assert stats.signed_rank_test(spark.createDataFrame([(1, 0.0)], "g int, d double"), "d", ["g"]).first().p_value == 1


def test_numbering_in_runs(spark, monkeypatch):
    monkeypatch.setattr(stats, "ONE_TASK", 10)
    monkeypatch.setattr(stats, "CUTS", 7)
    rows = [(f"s{k * 7919 % 300:03d}", k % 5, k) for k in range(400)] + [(None, 1, 400), (None, 1, 401)]
    got = stats.dense_index(spark.createDataFrame(rows, "a string, b int, k int").repartition(5), ["a", "b", "k"], "row").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [r.k for r in sorted(got, key=lambda r: r.row)] == [k for _, _, k in want] and sorted(r.row for r in got) == list(range(402))


def test_folds_have_equal_sizes(spark):
    for n, k in ((3, 5), (23, 5), (100, 4)):
        got = [r.fold for r in resample.folds(spark.range(n), "id", k).collect()]
        sizes = [got.count(f) for f in range(1, k + 1)]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_nested_sums_against_plain_fits(spark):
    from fieldcohort.operators import cv

    rng = np.random.default_rng(4)
    x, outer, inner = rng.normal(size=(120, 3)) * [1, 50, 0.1] + [0, 300, 5], np.arange(120) % 4 + 1, np.arange(120) // 4 % 3 + 1
    y, alphas = x @ [1, 0.02, 3] + rng.normal(size=120), [0.01, 1.0, 10.0, 100.0]
    df = spark.createDataFrame([(*map(float, r), float(t), int(o), int(i)) for r, t, o, i in zip(x, y, outer, inner, strict=True)], "a double, b double, c double, y double, outer int, inner int")
    got = {r.outer: r for r in cv.nested_sums(df, ["a", "b", "c"], "y", alphas).collect()}

    def error(train, test, alpha):
        prepare = cv.Preprocess(x[train])
        w = cv.ridge_path(prepare(x[train]), y[train], np.array([alpha]))[:, 0]
        return np.abs(y[test] - prepare(x[test]) @ w - y[train].mean()).mean()

    for o in range(1, 5):
        rest = outer != o
        errors = [np.mean([error(rest & (inner != i), rest & (inner == i), a) for i in (1, 2, 3)]) for a in alphas]
        best = alphas[int(np.argmin(errors))]
        assert got[o].alpha == best and got[o].mae == pytest.approx(error(rest, ~rest, best), abs=1e-9) and got[o].n == 30


def test_permuted_rows_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y")).write.parquet(path)
    got = resample.permutation_test(spark.read.parquet(path), "x", "y", ["g"], "k", 20)
    # the observed correlations, a row a group, may be; the replicates' rows may not
    assert "__j" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in x or "BroadcastHashJoin" in x)
    assert got.count() == 2


def test_ranks_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(500).select(F.lit(1).alias("g"), (F.col("id") * 7 % 250).cast("double").alias("v")).write.parquet(path)
    got = stats.ranked(spark.read.parquet(path), "v", ["g"], "r")
    # sums by run may be: there are half a million at most
    assert "SortMergeJoin [g#" in got._jdf.queryExecution().executedPlan().toString().replace("+- ", "").split("BroadcastHashJoin")[0]
    assert sorted(r.r for r in got.collect()) == sorted(pd.Series([k * 7 % 250 for k in range(500)]).rank().tolist())


def test_pairs_meet_in_one_pass(spark):
    from fieldcohort.operators.contracts import ContractError

    row = "case_id int, subject string, repeat int, outer_fold int, model string, predicted double, absolute_error double"
    rows = [(k, f"s{k % 3}", 1, 1, m, float(k), float(k % 4)) for k in range(12) for m in ("m", "base")]
    a, b = spark.createDataFrame([*rows, (0, "s0", 1, 1, "only_a", 1.0, 1.0)], row), spark.createDataFrame([(*r[:6], r[6] + (r[4] == "m")) for r in rows], row)
    got = {r.model: r for r in inference.paired_pipelines(a, b, 5, baseline="base").collect()}
    assert set(got) == {"m", "base"} and (got["m"].n, got["m"]["mean"], got["base"]["mean"]) == (3, 1.0, 0.0)
    # the tables are read for the check alone: what follows reads what it wrote
    assert "paired-" in str(inference.paired_pipelines(a, b, 5).inputFiles())
    with pytest.raises(ContractError, match="baseline"):
        inference.paired_pipelines(a, b.withColumn("predicted", F.col("predicted") + (F.col("case_id") == 3).cast("double")), 5, baseline="base")
    # equal counts, other keys
    with pytest.raises(ContractError, match="pair up"):
        inference.paired_pipelines(a, b.withColumn("case_id", F.col("case_id") + 1), 5)


def plain_draws(values, seed, replicates):
    """The drawn values of each replicate, one hash after the other."""
    n = len(values)
    return [[values[int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)] for b in replicates]


@pytest.mark.parametrize("n", [1, 2, 7, 10, 11, 100, 1234])
def test_draws_hashed_together(monkeypatch, n):
    values, replicates = np.random.default_rng(n).normal(size=(2, n)), [0, 3, 9, 10, 99, 100, 4999]
    for seed, lanes in ((9, 1 << 15), (-5, 50), (123456789, 1)):
        monkeypatch.setattr(resample, "LANES", lanes)
        got = resample.drawn_sums(list(values), seed, replicates if lanes > 1 or n < 20 else replicates[:2])
        for own, column in zip(got, values, strict=True):
            assert own.tolist() == pytest.approx([sum(x) for x in plain_draws(column, seed, replicates)][: len(own)], abs=1e-9)


def test_bootstrap_means_equal_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, k, None if g == "gaps" and k % 3 else float(rng.normal())) for g, n in (("a", 30), ("b", 30), ("c", 7), ("gaps", 30), ("one", 1)) for k in range(n)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r.g: r for r in resample.bootstrap_mean(df, "v", ["g"], "k", 70, seed=4).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        means = [np.mean(kept) for x in plain_draws([v for h, _, v in rows if h == g], 4, range(70)) if (kept := [v for v in x if v is not None])]
        assert r.n == sum(h == g for h, *_ in rows)
        assert (r.ci025, r.ci975) == (pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9) if means else (None, None))


def test_pipelines_are_compared_with_all_replicates(spark, sf, monkeypatch):
    from fieldcohort.plans import catalogue

    asked, real = [], resample.bootstrap_mean
    monkeypatch.setattr(resample, "bootstrap_mean", lambda df, value, groups, key, replicates, seed=1: asked.append(replicates) or real(df, value, groups, key, 3, seed))
    catalogue.queries()["q85_pipeline_intervals"](spark, sf)
    assert asked == [5000] and "range(5000)" in catalogue.oracle_sql()["q85_pipeline_intervals"]
