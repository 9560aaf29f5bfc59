import numpy as np
import pandas as pd
import pytest

from fieldcohort.functions import vocabulary as N
from fieldcohort.operators import cohort, cv
from fieldcohort.operators.contracts import ContractError
from fieldcohort.plans import pipelines


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(7)
    n = 40
    ids = [f"case-{k:03d}" for k in range(n)]
    manifest = pd.DataFrame({"case_id": ids, "subject": [f"sub-{k:03d}" for k in range(n)], "method_version": N.METHOD_VERSION, "effect_field_support": N.SUPPORT, "contralesional_effect_value": 0.0, "lesion_side": ["left"] * 30 + ["right"] * 10, "laterality_supported": True, "normalized_field_folding_fraction": 0.01, "mass_effect_3_20mm_magnitude_mm_n_voxels": 2000} | {c: "x" for c in N.MAPS} | {f.removeprefix("me_"): rng.normal(size=n) for f in N.DEFORMATION})
    clinical = pd.DataFrame({"case_id": ids, "subject": manifest["subject"], "wab_days": rng.uniform(10, 900, n), "age_at_stroke": rng.normal(60, 9, n)} | {f: rng.normal(size=n) for f in N.LESION})
    clinical["wab_aq"] = rng.normal(60, 15, n) + 8 * clinical["lesion_volume_ml"]
    return spark.createDataFrame(manifest), spark.createDataFrame(clinical)


def test_audit(inputs):
    got = pipelines.audit_manifest(inputs[0], expected=40)
    assert got["cases"] == 40 and got["qc_pass"] == 40 and got["side_left"] == 30
    with pytest.raises(ContractError):
        pipelines.audit_manifest(inputs[0], expected=41)
    with pytest.raises(ContractError):
        pipelines.audit_manifest(inputs[0].drop("lesion_side"))


def test_feature_sets(spark, inputs):
    design, _ = cohort.build_design(*inputs)
    sets = pipelines.feature_sets(design, False, False)
    assert {m: len(f) for m, f in sets.items()} == {"intercept_only": 0, "clinical_only": 2, "lesion_standard": 6, "lesion_plus_mass_effect": 14}
    with pytest.raises(ContractError):
        pipelines.feature_sets(design, True, False)


def test_model_run(spark, inputs, tmp_path):
    run = pipelines.ModelRun(cv=cv.CvConfig(repeats=1, alphas=(1.0, 10.0)), replicates=20)
    tables, audit = pipelines.run_model(*inputs, run)
    assert audit["with_outcome"] == 40 and tables["predictions"].count() == 160
    assert tables["paired_comparisons"].count() == 3 and tables["associations"].count() == 6 and tables["adjusted_associations"].count() == 3
    assert tables["left_model_summary"].count() == 4
    written = pipelines.write_report(tables, str(tmp_path))
    assert set(written) == {"paired_comparisons.tex", "model_summary.tex", "macros.tex", "associations.tex"}
    text = (tmp_path / "macros.tex").read_text()
    ages = np.array([r[0] for r in tables["design"].select("age_at_stroke").collect()])
    assert r"\newcommand{\CohortMeLesionSideLeft}{30}" in text and f"\\newcommand{{\\CohortAgeAtStrokeMedian}}{{{np.median(ages):.2f}}}" in text
    assert f"\\newcommand{{\\CohortFoldingPercentQThree}}{{{1.0:.2f}}}" in text and not any(x in text for x in ("CohortSex", "Minimum", "Maximum"))
    assert pipelines.cohort_summary(tables["design"], ["wab_aq"], ["me_lesion_side"]).count() == 7


def test_report_has_a_macro_for_every_model(spark, tmp_path):
    names = [f"model_{chr(97 + k // 11)}{chr(97 + k % 11)}" for k in range(121)]
    summary = spark.createDataFrame([(n, 1.0, 0.5, 1.5, 0.2) for n in names], "model string, mae_mean double, mae_p025 double, mae_p975 double, r2_mean double")
    pipelines.write_report({"model_summary": summary}, str(tmp_path))
    text = (tmp_path / "macros.tex").read_text()
    assert all("MaeModel" + n[6:].capitalize() in text for n in names)


def test_cli(spark, inputs, tmp_path):
    from fieldcohort import cli

    inputs[0].toPandas().to_csv(tmp_path / "manifest.csv", index=False)
    assert cli.main(["audit", "--manifest", str(tmp_path / "manifest.csv"), "--output", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/cohort_audit.json").exists()


def test_macros_of_cohort_and_decomposition(spark, tmp_path):
    rows = [("count", "sex", "F", 12.0), ("count", "sex", None, 2.0), ("quantile", "wab_days", "median", 41.5), ("quantile", "wab_days", "q1", None)]
    summary = spark.createDataFrame(rows, "kind string, name string, level string, value double")
    hodge = {"method_version": "v", "cases": 214, "passed": 213, "curl_free_energy_fraction": {"median": 0.25, "maximum": 4.9e-8, "minimum": None}}
    pipelines.write_report({"cohort_summary": summary}, str(tmp_path), {"joined": 211, "hodge_used": True, "models": {"clinical_only": 2}}, hodge)
    lines = (tmp_path / "macros.tex").read_text().splitlines()
    for want in (r"{\CohortSexF}{12}", r"{\CohortSexMissing}{2}", r"{\CohortWabDaysMedian}{41.50}", r"{\CohortWabDaysQOne}{nan}", r"{\HodgeCases}{214}", r"{\HodgeCurlFreeEnergyFractionMedian}{0.25}", r"{\HodgeCurlFreeEnergyFractionMaximum}{4.90e-08}", r"{\FlowJoined}{211}", r"{\FlowModelsClinicalOnly}{2}"):
        assert r"\newcommand" + want in lines
    assert len(lines) == 10 and sum("WabDays" in x for x in lines) == 2
    with pytest.raises(ValueError, match="at most 3"):
        pipelines.summary_macros(summary, 3)
