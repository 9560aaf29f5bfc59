import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from fieldcohort.operators import cv, stats


def design(spark, n=30):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    pdf["wab_aq"] = rng.normal(60, 15, n) + 8 * pdf["a"]
    pdf.loc[2, "b"] = np.nan
    pdf.insert(0, "row", range(n))
    pdf.insert(1, "case_id", [f"case-{k:03d}" for k in range(n)])
    pdf.insert(2, "subject", [f"sub-{k:03d}" for k in range(n)])
    return pdf, spark.createDataFrame(pdf)


def test_folds_match_the_shuffle():
    f = cv.kfold(11, 4, 5)
    assert sorted(np.bincount(f).tolist()) == [2, 3, 3, 3] and (cv.kfold(11, 4, 5) == f).all()


def test_ridge_matches_normal_equations():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    x -= x.mean(axis=0)
    for alpha in (0.1, 10.0):
        want = np.linalg.solve(x.T @ x + alpha * np.eye(5), x.T @ (y - y.mean()))
        assert np.allclose(cv.ridge_path(x, y, np.array([alpha]))[:, 0], want)


def test_nested_cv(spark):
    pdf, df = design(spark)
    models = {"intercept_only": (), "one": ("a",), "all": ("a", "b", "c")}
    config = cv.CvConfig(repeats=2, outer_folds=5, alphas=(0.1, 1.0, 10.0))
    tasks = cv.nested_cv(df, models, config)
    long = cv.predictions(tasks, df)
    assert long.count() == 30 * 3 * 2
    rows = long.toPandas()
    y = pdf["wab_aq"].to_numpy()
    folds = cv.kfold(30, 5, config.seed)
    first = rows[(rows.model == "intercept_only") & (rows["repeat"] == 1)].set_index("case_id")
    for k in range(30):
        assert first.loc[f"case-{k:03d}", "predicted"] == pytest.approx(y[folds != folds[k]].mean())
    again = cv.predictions(cv.nested_cv(df, models, config), df).toPandas()
    key = ["case_id", "repeat", "model"]
    assert rows.sort_values(key)["predicted"].tolist() == again.sort_values(key)["predicted"].tolist()
    assert cv.coefficient_summary(cv.coefficients(tasks, models)).count() == 4
    assert stats.error_metrics(long, "observed", "predicted", ["repeat", "model"]).count() == 6


def test_settings_and_empty_features(spark):
    with pytest.raises(ValueError):
        cv.CvConfig(alphas=(0.0,)).check(100)
    with pytest.raises(ValueError):
        cv.CvConfig().check(4)
    with pytest.raises(ValueError, match="no value"):
        cv.Preprocess(np.full((3, 1), np.nan))


def test_registered_query_has_all_repeats(spark, sf):
    from fieldcohort.plans import catalogue

    rows = catalogue.queries()["q59_nested_cv"](spark, sf).collect()
    assert {r.repeat for r in rows} == set(range(1, cv.CvConfig().repeats + 1)) and len(rows) == 60


def shuffled_folds(n, config):
    """The folds of ``nested_cv`` as ``nested_ridge`` takes them: for each row, over repeats, outer and inner by outer."""
    out = [[] for _ in range(n)]
    for r in range(config.repeats):
        seed = config.seed + 1009 * r
        outer = cv.kfold(n, config.outer_folds, seed)
        inner = np.zeros((n, config.outer_folds), dtype=int)
        for a in range(config.outer_folds):
            train = np.flatnonzero(outer != a)
            inner[train, a] = cv.kfold(len(train), config.inner_folds, seed + a + 1)
        for k in range(n):
            out[k].append((int(outer[k]), inner[k].tolist()))
    return out


FOLDS = "folds array<struct<outer:int,inner:array<int>>>"


@pytest.mark.parametrize("n,missing", [(60, 0.0), (61, 0.15), (15_000, 0.1)])
def test_large_form_equals_the_small_one(spark, n, missing):
    rng = np.random.default_rng(n)
    # a mean far above the spread, whose squares hold no digit of it
    x = rng.normal(size=(n, 3)) * [1, 5, 1e-3] + [0, 1e6, 7]
    y = 60 + 8 * x[:, 0] + (x[:, 1] - 1e6) + rng.normal(0, 10, n)
    x[rng.random((n, 3)) < missing] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 0.5, x[:, 0])
    few = cv.CvConfig(repeats=2, outer_folds=4, inner_folds=3, alphas=(0.01, 1.0, 30.0, 1000.0))
    models = {"intercept_only": (), "one": ("a",), "all": ("c", "b", "a")}
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(wab_aq=y, row=range(n))
    df = spark.createDataFrame(pdf)
    tasks = cv.nested_cv(df, models, few)
    want = {(r.repeat, r.outer_fold, r.model): r for r in tasks.collect()}
    folds = spark.createDataFrame([(k, f) for k, f in enumerate(shuffled_folds(n, few))], f"row long, {FOLDS}")
    fits, sums = cv.nested_ridge(df.join(folds, "row"), models, few)
    got = {(r.repeat, r.outer, r.model): r for r in fits.collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert r.alpha == want[key].alpha
        assert r.coefficients == pytest.approx(want[key].coefficients, rel=1e-6, abs=1e-9)
    old = {(r.repeat, r.model): r for r in stats.error_metrics(cv.predictions(tasks, df.withColumn("case_id", df["row"])), "observed", "predicted", ["repeat", "model"]).collect()}
    new = {(r.repeat, r.model): r for r in cv.scores(sums, ["repeat", "model"]).collect()}
    for key, r in old.items():
        assert new[key].n == r.n == n
        for c in ("mae", "rmse", "r2"):
            assert new[key][c] == pytest.approx(r[c], rel=1e-7, abs=1e-9), (key, c)
        if key[1] != "intercept_only":
            assert new[key].pearson_r == pytest.approx(r.pearson_r, rel=1e-6)


def test_hashed_folds_and_odd_designs(spark):
    few = cv.CvConfig(repeats=3, outer_folds=4, inner_folds=3, alphas=(1.0,), outcome="y")
    ids = spark.range(400)
    df = ids.select("id", cv.hashed_folds(ids["id"], few).alias("folds"))
    rows = df.collect()
    assert rows == df.repartition(7).orderBy("id").collect()
    for r in rows:
        assert len(r.folds) == 3 and all(0 <= f.outer < 4 and len(f.inner) == 4 and set(f.inner) <= {0, 1, 2} for f in r.folds)
    assert len({tuple(f.outer for f in r.folds) for r in rows}) > 30
    data = df.selectExpr("folds", "case when id % 9 = 0 then null when id % 9 = 1 then double('NaN') else double(id) end y", "double(id) a", "cast(null as double) b", "case when id < 3 then 1.0 end c")
    fits, sums = cv.nested_ridge(data, {"m": ("a",)}, few)
    assert fits.count() == 12 and {r.n for r in cv.scores(sums, ["repeat"]).collect()} == {sum(k % 9 > 1 for k in range(400))}
    for feature, said in (("b", "has rows"), ("c", "no value")):
        with pytest.raises(ValueError, match=said):
            cv.nested_ridge(data, {"m": ("a", feature)}, few)
    with pytest.raises(ValueError, match="has rows"):
        cv.nested_ridge(data.limit(0), {"m": ("a",)}, few)


def test_folds_are_hashed_by_many_tasks_and_once(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("y"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x"))
    config = cv.CvConfig(outcome="y", repeats=2, outer_folds=3, inner_folds=2, alphas=(1.0, 10.0))
    rows = cv.with_hashed_folds(df, "k", config)
    # small rows would all come to one task
    assert rows.rdd.getNumPartitions() == cv.PARTS
    assert {r.k: r.folds for r in rows.collect()} == {r.k: r.folds for r in df.withColumn("folds", cv.hashed_folds(F.col("k"), config)).collect()}
    design = cv._design(rows, ["x"], "y", "folds")
    assert "md5" not in design.rows._jdf.queryExecution().executedPlan().toString()
