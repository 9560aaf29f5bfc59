import pytest
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.operators import cohort
from fieldcohort.operators.contracts import ContractError


def tables(spark, n=6):
    manifest = spark.createDataFrame(
        [(f"case-{k}", f"sub-{k}", "v2", "true" if k else "no", 0.01 if k != 1 else float("nan"), 2000 if k != 2 else 10, "left") for k in range(n)],
        "case_id string, subject string, method_version string, laterality_supported string, normalized_field_folding_fraction double, mass_effect_3_20mm_magnitude_mm_n_voxels long, lesion_side string",
    )
    clinical = spark.createDataFrame([(f"case-{k}", f"sub-{k}", str(50 + k) if k != 3 else "x", float(k)) for k in range(n)], "case_id string, participant_id string, wab_aq string, wab_days double")
    return manifest, clinical


def test_design(spark):
    m, c = tables(spark)
    design, audit = cohort.build_design(m, c, cohort.DesignConfig(method_version="v2"))
    rows = design.orderBy("row").collect()
    assert [r.case_id for r in rows] == ["case-4", "case-5"]
    assert [r.row for r in rows] == [0, 1] and rows[0].wab_aq == 54.0 and rows[0].me_lesion_side == "left"
    assert (audit["joined"], audit["qc_pass"], audit["with_outcome"]) == (6, 3, 2)
    assert "log1p_wab_days" in design.columns


def test_wrong_version(spark):
    m, c = tables(spark)
    with pytest.raises(ContractError):
        cohort.build_design(m, c, cohort.DesignConfig(method_version="v3"))


def test_optional_sources(spark):
    m, c = tables(spark)
    design, _ = cohort.build_design(m, c)
    part = spark.createDataFrame([("case-4", 1.0)], "case_id string, e double")
    same, used = cohort.join_optional(design, part, "unc_", 0.95)
    assert not used and "unc_e" not in same.columns
    with pytest.raises(ContractError):
        cohort.join_optional(design, part, "hhd_", 0.95, required=True)
    whole = spark.createDataFrame([("case-4", 1.0), ("case-5", 2.0)], "case_id string, e double")
    joined, used = cohort.join_optional(design, whole, "unc_", 0.95)
    assert used and joined.select(F.sum("unc_e")).first()[0] == 3.0


def test_two_cases_of_a_subject(spark):
    m, c = tables(spark)
    c = c.withColumn("participant_id", F.lit("one"))
    with pytest.raises(ContractError, match="subject"):
        cohort.build_design(m, c)


def test_booleans_and_numbers(spark):
    df = spark.createDataFrame([(" Yes",), ("1",), ("1.0",), ("TRUE",), (None,)], "s string")
    got = df.select(X.truthy(F.col("s")).alias("t"), X.strict_true(F.col("s")).alias("u")).collect()
    assert [r.t for r in got] == [True, True, False, True, False]
    assert [r.u for r in got] == [False, False, False, True, False]
    num = spark.createDataFrame([("1d",), ("1e3",), (" 2 ",), ("nan",), (".5",), ("",)], "s string").select(X.finite(X.to_number(F.col("s"))).alias("v")).collect()
    assert [r.v for r in num] == [None, 1000.0, 2.0, None, 0.5, None]


def test_nan_does_not_pass(spark):
    df = spark.createDataFrame([("true", float("nan"), float("nan"))], "s string, f double, n double")
    assert not df.select(cohort.qc_filter(F.col("s"), F.col("f"), F.col("n"), None)).first()[0]


def test_manifest_report(spark):
    r = cohort.manifest_report(tables(spark)[0]).first()
    assert (r.cases, r.qc_pass, r.qc_fail, r.side_left) == (6, 3, 3, 6)
