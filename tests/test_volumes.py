"""From manifests with text ids and file paths to volumes, records and reports, by the command line."""

import json

import numpy as np
import pandas as pd
import pytest

from fieldcohort import cli
from fieldcohort.functions import vocabulary as N
from fieldcohort.operators import cases
from fieldcohort.operators import kernels as K
from fieldcohort.operators import voxel as V
from fieldcohort.operators.contracts import ContractError
from fieldcohort.plans import pipelines, volumes
from fieldcohort.sources import nifti, report

SHAPE = (21, 17, 15)
AFFINE = np.array([[1.0, 0, 0, -10], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])


def smooth_field(seed, size=0.4):
    rng = np.random.default_rng(seed)
    return np.stack([K.gaussian(rng.normal(size=SHAPE), 2.5) for _ in range(3)], axis=-1).astype(np.float32) * size * 20


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    """Two cases with ids that are no numbers, in a folder that has moved since the manifest was written."""
    root = tmp_path_factory.mktemp("data")
    rows = []
    grid = np.stack(np.meshgrid(*map(np.arange, SHAPE), indexing="ij"), axis=-1).astype(np.float32)
    lesion = np.zeros(SHAPE, np.uint8)
    lesion[3:6, 6:10, 5:9] = 1
    inside = np.zeros(SHAPE, np.uint8)
    inside[1:-1, 1:-1, 1:-1] = 1
    for k, name in enumerate(("sub-M2001_ses-1", "sub-M2002_ses-1")):
        folder = root / f"case {k}".replace(" ", "")
        folder.mkdir()
        u = smooth_field(k) * inside[..., None]
        files = {"inverse_map": (grid + u).astype(np.float32), "subject_t1": grid[..., 0], "subject_mask": np.ones(SHAPE, np.uint8), "lesion_mask": lesion, "inpainting_target": lesion}
        row = {"case_id": name, "subject": f"sub-M200{k + 1}", "session": "ses-1"}
        for n, data in files.items():
            (folder / f"{n}.nii.gz").write_bytes(nifti.render(data, AFFINE))
            row[n] = f"/old/place/ARC/case{k}/{n}.nii.gz"
        rows.append(row)
    (root / "atlas.nii.gz").write_bytes(nifti.render(grid[..., 0], AFFINE))
    (root / "atlas_mask.nii.gz").write_bytes(nifti.render(np.ones(SHAPE, np.uint8), AFFINE))
    manifest = root / "inputs.csv"
    pd.DataFrame(rows).to_csv(manifest, index=False)
    return root, manifest


@pytest.fixture(scope="module")
def extracted(spark, study, tmp_path_factory):
    root, manifest = study
    out = tmp_path_factory.mktemp("out")
    assert cli.main(["extract", "--manifest", str(manifest), "--data", str(root), "--output", str(out), "--atlas-image", str(root / "atlas.nii.gz"), "--atlas-mask", str(root / "atlas_mask.nii.gz"), "--minimum-points", "100", "--subsample", "1"]) == 0
    return out


def test_extraction_writes_files(spark, study, extracted):
    folder = extracted / "sub-M2001/ses-1/sub-M2001_ses-1"
    assert len(list(folder.glob("*.nii.gz"))) == 7
    record = json.loads((folder / "mass_effect_metrics.json").read_text())
    assert record["case_id"] == "sub-M2001_ses-1" and record["lesion_side"] == "left" and record["method_version"] == N.METHOD_VERSION
    vector, affine, spacing = nifti.parse((extracted / record["mass_effect_vector_path"]).read_bytes())
    assert vector.shape == (*SHAPE, 3) and np.allclose(affine, AFFINE) and spacing == (1.0, 1.0, 1.0)
    valid = nifti.parse((extracted / record["valid_mask_path"]).read_bytes())[0]
    assert not vector[11:].any() and valid.any() and not vector[valid == 0].any()
    assert spark.read.parquet(str(extracted / "cases")).count() == 2


@pytest.fixture(scope="module")
def collected(spark, extracted, tmp_path_factory):
    """The manifest that the collected records make, as one file."""
    docs = [json.loads(f.read_text()) for f in sorted(extracted.rglob("mass_effect_metrics.json"))]
    path = tmp_path_factory.mktemp("manifest") / "manifest.csv"
    pd.DataFrame(docs).assign(mass_effect_3_20mm_magnitude_mm_n_voxels=2000).to_csv(path, index=False)
    return path


def test_hodge_from_a_manifest(spark, extracted, collected, tmp_path):
    how = ["--data", str(extracted), "--output", str(tmp_path), "--stride", "1", "--padding", "2", "--taper", "2", "--sigma", "0.8"]
    assert cli.main(["hodge", "--manifest", str(collected), *how]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "hodge_manifest")).orderBy("case_id").collect()
    assert [r.case_id for r in rows] == ["sub-M2001_ses-1", "sub-M2002_ses-1"] and rows[0].subject == "sub-M2001" and rows[0].session == "ses-1"
    summary = json.loads((tmp_path / "hodge_summary.json").read_text())
    assert summary["cases"] == 2 and abs(summary["energy_fraction_sum"]["median"] - 1) < 1e-3
    assert json.loads((tmp_path / "hodge_config.json").read_text())["input_manifest_basename"] == "manifest.csv"
    # the same from fields in columns, as bytes and as numbers
    record = json.loads(next(extracted.rglob("sub-M2001_ses-1/mass_effect_metrics.json")).read_text())
    u, valid = (nifti.parse((extracted / record[c]).read_bytes())[0] for c in ("mass_effect_vector_path", "valid_mask_path"))
    config = K.HodgeConfig(stride=1, padding=2, taper=2, sigma=0.8)
    packed = spark.createDataFrame([("x-1", list(SHAPE), u.astype("<f4").tobytes(), valid.astype(np.uint8).tobytes())], "case_id string, shape array<int>, field binary, valid binary")
    plain = spark.createDataFrame([("x-1", list(SHAPE), u.ravel().tolist(), valid.ravel().tolist())], "case_id string, shape array<int>, field array<double>, valid array<int>")
    a, b = cases.hodge(packed, config).first(), cases.hodge(plain, config).first()
    assert a == b and a.case_id == "x-1" and float(rows[0].total_rms_mm) == pytest.approx(a.total_rms_mm, rel=1e-6)


def test_text_ids_everywhere(spark):
    u = smooth_field(3, 0.1)
    df = spark.createDataFrame([("c-1", list(SHAPE), u.ravel().tolist(), [1] * u[..., 0].size)], "case_id string, shape array<int>, field array<double>, valid array<int>")
    assert cases.flow_exp(df).first().case_id == "c-1" and cases.flow_log(df).first().case_id == "c-1"
    assert cases.affine_fits(df, 1, 100).first().case_id == "c-1"
    got = cases.hodge_sensitivity(df, {"a": K.HodgeConfig(1, 2, 2, 0.5), "b": K.HodgeConfig(2, 2, 2, 0.5)}).collect()
    assert sorted((r.variant, r.case_id) for r in got) == [("a", "c-1"), ("b", "c-1")]


def test_audit_of_maps(spark, extracted, collected, tmp_path):
    how = ["audit", "--manifest", str(collected), "--data", str(extracted), "--output", str(tmp_path), "--maps", "--legacy", str(collected), "--expected", "2"]
    assert cli.main(how) == 0
    got = json.loads((tmp_path / "cohort_audit.json").read_text())
    assert got["stored_maps_checked"] == 10 and got["contralesional_nonzero_values"] == 0 and got["legacy_maximum_absolute_feature_delta"] == 0 and got["status"] == "pass"
    record = json.loads(next(extracted.rglob("sub-M2002_ses-1/mass_effect_metrics.json")).read_text())
    target = extracted / record["mass_effect_radial_path"]
    before, (data, affine, _) = target.read_bytes(), nifti.parse(target.read_bytes())
    data = data.copy()
    data[15, 5, 5] = -2.5
    target.write_bytes(nifti.render(data, affine))
    with pytest.raises(ContractError, match="2.5"):
        cli.main(how)
    target.write_bytes(before)


def test_missing_inputs_raise(spark, study, extracted, collected, tmp_path):
    out = ["--output", str(tmp_path)]
    for command in (["hodge"], ["hodge-sensitivity"], ["extract"], ["model"], ["collect"], ["hodge", "--manifest", str(collected)], ["report", "--tables", str(tmp_path / "none")]):
        with pytest.raises((ValueError, FileNotFoundError)):
            cli.main([*command, *out])
    (study[0] / "case0/lesion_mask.nii.gz").rename(study[0] / "case0/elsewhere.nii.gz")
    with pytest.raises(FileNotFoundError, match="lesion_mask of sub-M2001_ses-1"):
        nifti_rows = spark.read.option("header", True).csv(str(study[1]))
        volumes.extract(spark, nifti_rows, str(study[0]), volumes.read_atlas(spark, str(study[0] / "atlas.nii.gz"), str(study[0] / "atlas_mask.nii.gz")))
    (study[0] / "case0/elsewhere.nii.gz").rename(study[0] / "case0/lesion_mask.nii.gz")


def test_volumes_as_bytes(spark, study, tmp_path):
    df = nifti.read_volumes(spark, str(study[0] / "case0"), as_bytes=True)
    r = df.where("name = 'subject_t1.nii.gz'").first()
    assert np.array_equal(np.frombuffer(r.data, "<f4").reshape(r.shape)[..., 0, 0], np.arange(SHAPE[0]))
    nifti.write_volumes(df.where("name <> 'inverse_map.nii.gz'"), str(tmp_path / "packed"))
    report.write_files(spark.read.parquet(str(tmp_path / "packed")), str(tmp_path / "files"))
    assert nifti.parse((tmp_path / "files/lesion_mask.nii.gz").read_bytes())[0].sum() == 48
    with pytest.raises(Exception, match="leaves"):
        report.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), str(tmp_path / "files"))


def test_report_from_stored_tables(spark, tmp_path):
    models, ci = ["lesion_standard", "lesion_plus_mass_effect"], "double, ci025 double, ci975 double"
    made = {
        "paired_comparisons": spark.createDataFrame([(models[1], 0.4, -0.1, 0.9, 0.04, "primary")], f"model string, mean_advantage {ci}, p_value_holm double, context string"),
        "model_summary": spark.createDataFrame([(m, 16.0, 15.0, 17.0, 0.5) for m in models], "model string, mae_mean double, mae_p025 double, mae_p975 double, r2_mean double"),
        "adjusted_associations": spark.createDataFrame([("adjusted_x", -0.16, -0.3, 0.0, 0.0001)], f"association string, partial_rho {ci}, p_value_holm double"),
        "agreement": spark.createDataFrame([("grid_3mm", "total_rms_mm", 0.99, 0.2, 0.1)], "variant string, feature string, rho_primary double, rho_outcome double, median_abs_difference double"),
        "metrics_by_repeat": spark.createDataFrame([(k, m, 16.0 + k) for k in range(4) for m in models], "repeat int, model string, mae double"),
    }
    pipelines.write_tables(made, str(tmp_path / "model"))
    assert cli.main(["report", "--output", str(tmp_path)]) == 0
    text = (tmp_path / "report/macros.tex").read_text() + (tmp_path / "report/supplement_macros.tex").read_text()
    for line in (r"\newcommand{\PairedComparisonsPrimaryLesionPlusMassEffectLow}{-0.10}", r"\newcommand{\MaeLesionStandard}{16.00}", r"\newcommand{\AdjustedAssociationsAdjustedXP}{<0.001}", r"\newcommand{\SensitivityLeastTotalRmsMm}{0.99}"):
        assert line in text
    assert "lesion\\_plus\\_mass\\_effect & 0.40 (-0.10, 0.90) & 0.040" in (tmp_path / "report/paired_comparisons.tex").read_text()
    assert {p.name for p in (tmp_path / "report").iterdir() if p.is_dir()} == {"paired_forest", "adjusted_forest", "sensitivity_points", "model_boxes"}


def test_compare_two_pipelines(spark, tmp_path):
    rng = np.random.default_rng(0)
    features = [f.removeprefix("me_") for f in N.DEFORMATION][:2]
    manifest = pd.DataFrame({"case_id": [f"c{k}" for k in range(30)], "deformation_qc_pass": "True"} | {f: rng.normal(size=30) for f in features})
    predictions = pd.DataFrame([(f"c{k}", f"s{k}", r, 1, m, 50.0 if m == "intercept_only" else 50 + rng.normal(), 5 + rng.normal()) for k in range(30) for r in (1, 2) for m in ("intercept_only", "lesion_standard")], columns=["case_id", "subject", "repeat", "outer_fold", "model", "predicted", "absolute_error"])
    for name, df in (("a", manifest), ("b", manifest.iloc[:25]), ("p", predictions), ("q", predictions.assign(absolute_error=predictions["absolute_error"] + 1))):
        df.to_csv(tmp_path / f"{name}.csv", index=False)
    assert cli.main(["compare", "--manifest", str(tmp_path / "a.csv"), "--other-manifest", str(tmp_path / "b.csv"), "--predictions", str(tmp_path / "p.csv"), "--other-predictions", str(tmp_path / "q.csv"), "--replicates", "50", "--output", str(tmp_path / "out")]) == 0
    got = json.loads((tmp_path / "out/frozen/aggregates.json").read_text())
    assert got["flow"] == {"first": 30, "second": 25, "common": 25} and got["manifest"]["n"] == 30
    table = spark.read.option("header", True).csv(str(tmp_path / "out/comparison/predictive_comparison")).collect()
    assert all(float(r["mean"]) == pytest.approx(1.0) for r in table) and len(table) == 2
    frozen = json.loads((tmp_path / "out/frozen/manifest.json").read_text())
    assert frozen["provenance"]["input_manifest_basename"] == "a.csv"


def test_sampling_of_halves(spark):
    # nearest and linear, on rows and in the kernel, at halves, borders and outside
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4, 3, 5))
    at = np.array([[0.5, 1.5, 2.5, 3.0, -0.4, 3.2, 1.49, 0.0, np.nan], [0.5, 1.5, 0.5, 2.0, 0.0, 1.0, 0.51, 0.0, 0.0], [3.5, 0.5, 2.5, 4.0, 1.0, 1.0, 3.99, 0.0, 0.0]])
    points = spark.createDataFrame([("c", k, *map(float, p)) for k, p in enumerate(at.T)], "case_id string, k int, cx double, cy double, cz double")
    source = spark.createDataFrame([("c", *map(int, i), float(v[tuple(i)])) for i in np.argwhere(np.ones(v.shape))], "case_id string, x int, y int, z int, v double")
    c = ("cx", "cy", "cz")
    near = {r.k: r.sampled for r in V.nearest_sample(points, source, c, "v", v.shape).collect()}
    linear = {r.k: r.sampled for r in V.trilinear_sample(points, source, c, "v", v.shape).collect()}
    assert [near[k] for k in range(9)] == K.sample(v, at, linear=False).tolist()
    assert np.allclose([linear[k] for k in range(9)], K.sample(v, at))
    mask = source.where("v > 0")
    kept = {r.k: r.valid for r in V.valid_map(points.selectExpr("*", "true target"), mask, v.shape).collect()}
    assert [kept[k] for k in range(9)] == (K.sample((v > 0).astype(float), at, linear=False) > 0.5).tolist()


@pytest.fixture(scope="module")
def cohort_files(tmp_path_factory):
    """A cohort of 24 whose cases share four small fields, with its clinical table."""
    root, rng, n = tmp_path_factory.mktemp("cohort"), np.random.default_rng(1), 24
    keep = np.zeros(SHAPE, np.uint8)
    keep[:10, 2:-2, 2:-2] = 1
    for k in range(4):
        (root / f"u{k}.nii.gz").write_bytes(nifti.render((smooth_field(k + 10, 0.6) * keep[..., None]).astype(np.float32), AFFINE))
    (root / "valid.nii.gz").write_bytes(nifti.render(keep, AFFINE))
    (root / "flat.nii.gz").write_bytes(nifti.render(np.zeros(SHAPE, np.float32), AFFINE))
    ids = [f"sub-{k:03d}_x" for k in range(n)]
    manifest = pd.DataFrame({"case_id": ids, "subject": [f"sub-{k:03d}" for k in range(n)], "session": "ses-1", "method_version": N.METHOD_VERSION, "effect_field_support": N.SUPPORT, "contralesional_effect_value": 0.0, "lesion_side": "left", "laterality_supported": True, "normalized_field_folding_fraction": 0.01, "mass_effect_3_20mm_magnitude_mm_n_voxels": 2000, "deformation_qc_pass": True})
    manifest = manifest.assign(**{f.removeprefix("me_"): rng.normal(size=n) for f in N.DEFORMATION}).assign(**dict.fromkeys(N.MAPS, "flat.nii.gz"))
    manifest = manifest.assign(mass_effect_vector_path=[f"u{k % 4}.nii.gz" for k in range(n)], valid_mask_path="valid.nii.gz")
    clinical = pd.DataFrame({"case_id": ids, "subject": manifest["subject"], "wab_days": rng.uniform(10, 900, n), "age_at_stroke": rng.normal(60, 9, n)} | {f: rng.normal(size=n) for f in N.LESION})
    clinical["wab_aq"] = rng.normal(60, 15, n) + 8 * clinical["lesion_volume_ml"]
    out = tmp_path_factory.mktemp("tables")
    manifest.to_csv(out / "manifest.csv", index=False)
    clinical.to_csv(out / "clinical.csv", index=False)
    return root, out


def test_reproduce_and_second(spark, cohort_files, tmp_path):
    root, given = cohort_files
    how = ["--data", str(root), "--clinical", str(given / "clinical.csv"), "--repeats", "1", "--replicates", "20", "--taper", "1", "--sigma", "0.5", "--padding", "2"]
    assert cli.main(["reproduce", "--manifest", str(given / "manifest.csv"), "--output", str(tmp_path / "first"), "--stride", "3", *how]) == 0
    made = {p.name for p in (tmp_path / "first/model").iterdir()}
    assert {"predictions", "agreement", "failures", "paired_comparisons", "design"} <= made
    text = (tmp_path / "first/report/macros.tex").read_text()
    assert "LesionPlusMassEffectPlusHodge" in text and (tmp_path / "first/report/sensitivity.tex").exists()
    predictions = spark.read.option("header", True).csv(str(tmp_path / "first/model/predictions"))
    assert predictions.select("case_id").distinct().count() == 24
    # a second pipeline with a version of its own
    own = pd.read_csv(given / "manifest.csv").assign(method_version="second_v1", mass_effect_3_20mm_magnitude_mm_n_voxels=150)
    own.to_csv(given / "own.csv", index=False)
    assert cli.main(["second", "--manifest", str(given / "manifest.csv"), "--other-manifest", str(given / "own.csv"), "--predictions", str(tmp_path / "first/model/predictions"), "--method-version", "second_v1", "--minimum-voxels", "125", "--stride", "2", "--output", str(tmp_path / "second"), *how]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "second/comparison/predictive_comparison")).collect()
    # the models without decompositions are the same in both
    assert {r["model"]: abs(float(r["mean"])) < 1e-9 for r in rows if "hodge" not in r["model"]} == {m: True for m in ("intercept_only", "clinical_only", "lesion_standard", "lesion_plus_mass_effect")}
    assert json.loads((tmp_path / "second/frozen/aggregates.json").read_text())["flow"]["common"] == 24
    assert (tmp_path / "second/comparison/predictive_comparison.tex").exists()


def test_slices_and_grids(spark):
    rows = [("c", 0, y, z) for z, n in ((2, 3), (5, 9), (6, 1), (30, 1)) for y in range(n)]
    mask = spark.createDataFrame(rows, "case_id string, x int, y int, z int")
    r = V.fullest_slice(mask, "z", 4).first()
    low, high = np.percentile([z for *_, z in rows], [2.5, 97.5])
    assert (r["z"], r["n"], r["first"], r["last"]) == (5, 9, min(int(np.floor(low)), 1), max(int(np.ceil(high)), 9))
    a, b = np.diag([2.0, 2, 2, 1]), np.diag([1.0, 1, 1, 1])
    a[:3, 3] = (-4, 1, 0)
    assert np.allclose(nifti.voxel_map(a, b, [[2, 0, 1]]), [[0, 1, 2]]) and np.allclose(nifti.voxel_map(b, a, nifti.voxel_map(a, b, [[2, 5, 1]])), [[2, 5, 1]])


def test_redacted_maps(spark):
    df = spark.createDataFrame([({"path": "/a/b.nii", "keep": "v", "x_manifest": "c/d.csv", "abs": "/e/f", "gone_path": None},), (None,), ({},)], "m map<string,string>")
    got = [r.m for r in df.select(report.redact_map(df.m).alias("m")).collect()]
    assert got == [{"path_basename": "b.nii", "keep": "v", "x_manifest_basename": "d.csv", "abs_basename": "f"}, None, {}]
