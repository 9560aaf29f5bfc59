import pytest
from pyspark.sql import functions as F

from fieldcohort.operators import contracts as C


def frame(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def test_unique_tolerates_one_null(spark):
    assert C.require_unique(frame(spark, "a", "b", None), "k").count() == 3


@pytest.mark.parametrize("keys", [("a", "a"), (None, None), ("a", None, "b", "b")])
def test_unique_rejects(spark, keys):
    with pytest.raises(C.ContractError):
        C.require_unique(frame(spark, *keys), "k")


def test_missing_column(spark):
    with pytest.raises(C.ContractError, match="lacks"):
        C.require_unique(frame(spark, "a"), "other")


def test_version(spark):
    C.require_version(frame(spark, " v1", "v1 ", None), "k", "v1")
    for bad in ([None], ["v1", "v2"], ["v2"]):
        with pytest.raises(C.ContractError):
            C.require_version(frame(spark, *bad), "k", "v1")


def test_all_rows_null_fails(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "v double")
    with pytest.raises(C.ContractError):
        C.require_all(df, F.col("v") == 0, "v")
    C.require_all(df.where("v is not null"), F.col("v") == 0, "v")


def test_counts_and_keys(spark):
    a, b = frame(spark, "1", "2"), frame(spark, "2", "1")
    C.require_count(a, 2)
    C.require_same_keys(a, b, "k")
    with pytest.raises(C.ContractError):
        C.require_count(a, 3)
    with pytest.raises(C.ContractError):
        C.require_same_keys(a, frame(spark, "1"), "k")


def test_exact_selection(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert sorted(r.k for r in C.select_exact(df, frame(spark, "3", "1"), "k").collect()) == [1, 3]
    with pytest.raises(C.ContractError, match="not found"):
        C.select_exact(df, frame(spark, "4"), "k")
    with pytest.raises(C.ContractError, match="unique"):
        C.select_exact(df.unionByName(df), frame(spark, "1"), "k")
