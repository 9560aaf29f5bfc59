import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcohort.sources import nifti, report, tables


def test_read_table(spark, tmp_path):
    p = tmp_path / "t.TSV"
    p.write_text("case_id\tn\tv\tflag\ts\nc1\t1\t1.5\tTrue\tNA\nc2\tn/a\tinf\tFalse\tx\n")
    df = tables.read_table(spark, str(p))
    assert dict(df.dtypes) == {"case_id": "string", "n": "bigint", "v": "double", "flag": "boolean", "s": "string"}
    rows = df.orderBy("case_id").collect()
    assert (rows[0].n, rows[0].v, rows[0].flag, rows[0].s) == (1, 1.5, True, None) and rows[1].n is None and rows[1].v is None
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "none.csv")).count()


def test_collect(spark, tmp_path):
    for sub, case in (("sub-2", "case-2"), ("sub-1", "case-1")):
        d = tmp_path / sub
        d.mkdir()
        (d / tables.METRICS_FILE).write_text(json.dumps({"subject": sub, "case_id": case, "m": [[1.0, 2.0]], "v": None if sub == "sub-1" else 2.5}))
        (d / tables.MARKER).write_text("")
    assert [r.case_id for r in tables.collect_cases(spark, str(tmp_path)).collect()] == ["case-1", "case-2"]
    assert tables.marker_counts(spark, str(tmp_path)) == {"complete": 2, "errors": 0}
    d = tmp_path / "sub-3"
    d.mkdir()
    (d / tables.METRICS_FILE).write_text(json.dumps({"subject": "sub-3", "case_id": "case-1"}))
    with pytest.raises(Exception, match="repeated"):
        tables.collect_cases(spark, str(tmp_path))


def test_resume(spark, tmp_path):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    done = spark.createDataFrame([(1, "v2"), (2, "v1")], "case_id int, method_version string")
    assert sorted(r.case_id for r in tables.pending(cases, done, "v2").collect()) == [2, 3]
    f = tmp_path / "request.json"
    assert not tables.same_request(f, {"a": 1})
    f.write_text('{"a": 1}')
    assert tables.same_request(f, {"a": 1})
    with pytest.raises(ValueError):
        tables.same_request(f, {"a": 2})


def test_paths(spark, tmp_path):
    never = lambda p: False
    assert tables.localized("/x/ARC/y/ARC/sub/f.nii", tmp_path, exists=never) == str(tmp_path / "sub/f.nii")
    with pytest.raises(ValueError):
        tables.localized("/x/ARC/../../f", tmp_path, exists=never)
    with pytest.raises(ValueError):
        tables.localized("/x/y", tmp_path, exists=never)
    df = spark.createDataFrame([("/a/ARC/b/ARC/c/d.nii",), ("/a/b",), (None,)], "p string")
    assert [r[0] for r in df.select(tables.localized_column(F.col("p"), "/root/")).collect()] == ["/root/c/d.nii", "/a/b", None]
    with pytest.raises(FileNotFoundError):
        tables.required([str(tmp_path), None])


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[model]\nseed = 5\n")
    c = tables.load_config(f)
    assert tables.setting(c, "model", "seed", 1) == 5 and tables.setting(c, "model", "seed", 1, 0) == 0 and tables.setting(c, "x", "y", 3) == 3


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(60, dtype=np.float32).reshape(5, 4, 3)
    affine = np.array([[2.0, 0, 0, -4], [0, 2, 0, 1], [0, 0, 2, 3], [0, 0, 0, 1]])
    (tmp_path / "a.nii.gz").write_bytes(nifti.render(data, affine, "x" * 100))
    r = nifti.read_volumes(spark, str(tmp_path)).first()
    assert r.shape == [5, 4, 3] and r.spacing == [2.0, 2.0, 2.0] and np.allclose(np.array(r.data).reshape(5, 4, 3), data) and np.allclose(r.affine, affine)
    assert nifti.parse(nifti.render(data > 3, affine, compress=False))[0].dtype == np.uint8
    with pytest.raises(ValueError):
        nifti.parse(b"\0" * 400)
    df = nifti.read_volumes(spark, str(tmp_path))
    nifti.write_volumes(df, str(tmp_path / "out"))
    assert np.allclose(nifti.parse(bytes(spark.read.parquet(str(tmp_path / "out")).first().content))[0], data)


def test_geometry():
    affine = np.diag([1.0, 1, 1, 1])
    affine[0, 3] = -4
    assert nifti.check_geometry((9, 5, 5), affine) == (1.0, 1.0, 1.0)
    moved = affine.copy()
    moved[0, 3] += 0.5
    for shape, a in (((9, 5, 5), moved), ((8, 5, 5), affine), ((9, 5, 5), np.diag([-1.0, 1, 1, 1]))):
        with pytest.raises(ValueError):
            nifti.check_geometry(shape, a)
    assert nifti.check_template((9, 5, 5), affine, np.ones((9, 5, 5))) == 1.0
    lopsided = np.zeros((9, 5, 5))
    lopsided[:4] = 1
    with pytest.raises(ValueError):
        nifti.check_template((9, 5, 5), affine, lopsided)
    assert nifti.same_geometry(((9, 5, 5), affine), ((9, 5, 5), affine + 1e-5))
    origin, spacing, direction = np.array([98.0, 134, -72]), np.array([2.0, 2, 2]), np.diag([-1.0, -1, 1])
    index = np.array([[3.0, 4, 5]])
    assert np.allclose(nifti.point_to_index(nifti.index_to_point(index, origin, spacing, direction), origin, spacing, direction), index)
    assert np.allclose(nifti.lps_affine(origin, spacing, direction)[:3, 3], [-98, -134, -72])


def test_report(spark, tmp_path):
    value = {"path": "/a/b.nii", "nested": {"x_manifest": "/c/d.csv", "keep": 1, "none_path": None}, "list": [{"abs": "/e/f"}], "rel": "g/h"}
    assert report.redact(value) == {"path_basename": "b.nii", "nested": {"x_manifest_basename": "d.csv", "keep": 1}, "list": [{"abs_basename": "f"}], "rel": "g/h"}
    assert report.strict_json({1: (float("nan"), np.float32(1.5))}) == {"1": [None, 1.5]}
    f = report.write_json(tmp_path / "a/b.json", {"v": 1.5, "n": float("inf")})
    assert json.loads(f.read_text()) == {"v": 1.5, "n": None}
    assert report.outside(tmp_path / "out", tmp_path / "data").is_dir()
    for bad in (tmp_path / "data", tmp_path / "data/x"):
        with pytest.raises(ValueError):
            report.outside(bad, tmp_path / "data")
    assert report.file_hashes(spark, str(tmp_path / "a")).first().sha256 == __import__("hashlib").sha256(f.read_bytes()).hexdigest()
    assert report.tex_macros({"Mae": 1.234, "Name": "a_b"}) == "\\newcommand{\\Mae}{1.23}\n\\newcommand{\\Name}{a\\_b}\n"
    df = spark.createDataFrame([("a_b", -0.0561, -0.4161, 0.2879)], "m string, v double, l double, h double")
    text = report.tex_table(df.withColumn("i", report.interval_text("v", "l", "h")), {"m": "Model", "i": "MAE"}, ["m"])
    assert "a\\_b & -0.06 (-0.42, 0.29)" in text
    assert not report.forest_data(df, "m", "v", "l", "h").first().excludes_zero
    assert report.single_row(df, "m = 'a_b'")["v"] == -0.0561
    with pytest.raises(LookupError):
        report.single_row(df, "m = 'x'")
    frozen = report.freeze(spark.range(10).selectExpr("cast(id as double) v", "id secret"), ["v", "absent"])
    assert frozen["n"] == 10 and list(frozen["columns"]) == ["v"] and sum(frozen["columns"]["v"]["counts"]) == 10 and len(frozen["columns"]["v"]["edges"]) == 21


def test_stream(spark, tmp_path):
    from fieldcohort.streaming import collect

    src = tmp_path / "in/sub-1"
    src.mkdir(parents=True)
    (src / tables.METRICS_FILE).write_text(json.dumps({"case_id": "c1", "deformation_qc_pass": True}))
    stream = collect.case_stream(spark, str(tmp_path / "in"), "case_id string, deformation_qc_pass boolean")
    collect.write_cases(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_localized_paths_stay_below_the_root(spark):
    rows = ["/a/ARC/x/../y", "/a/ARC/x/y", "no anchor/../x", None, "/a/ARC/./x//y/../../z"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = [r[0] for r in df.select(tables.localized_column(df["p"], "/data/")).collect()]
    assert got == ["/data/x/../y", "/data/x/y", "no anchor/../x", None, "/data/./x//y/../../z"]
    for bad in ("/a/ARC/../../etc/x", "/a/ARC/x/../../y/z", "/a/ARC/.."):
        with pytest.raises(Exception, match="leaves /data"):
            spark.createDataFrame([(bad,)], "p string").select(tables.localized_column(F.col("p"), "/data")).collect()


def volumes(tmp_path):
    rng = np.random.default_rng(4)
    made = {}
    for name, shape, packed in (("a.nii", (5, 4, 7), False), ("b.nii.gz", (3, 2, 4, 3), True), ("c.nii.gz", (4, 4, 1), True)):
        data = rng.normal(size=shape).astype(np.float32)
        (tmp_path / "vol").mkdir(exist_ok=True)
        (tmp_path / "vol" / name).write_bytes(nifti.render(data, np.diag([2.0, 1, 1, 1]), compress=packed))
        made[name] = data
    return made, str(tmp_path / "vol")


def test_headers_are_read_alone(spark, tmp_path):
    made, path = volumes(tmp_path)
    # nothing behind the header is needed
    (tmp_path / "vol/a.nii").write_bytes((tmp_path / "vol/a.nii").read_bytes()[: nifti.HEAD])
    got = {r["name"]: r for r in nifti.read_headers(spark, path).collect()}
    assert {n: tuple(r["shape"]) for n, r in got.items()} == {n: d.shape for n, d in made.items()}
    assert got["a.nii"].spacing == [2.0, 1.0, 1.0] and got["a.nii"].affine[0] == [2.0, 0, 0, 0] and got["b.nii.gz"]["type"] == "f4"
    (tmp_path / "vol/d.nii").write_bytes(b"short")
    with pytest.raises(Exception, match="not a NIfTI-1 file"):
        nifti.read_headers(spark, path).collect()


@pytest.mark.parametrize("thickness", [1, 3, 16])
def test_slabs_make_the_volume(spark, tmp_path, thickness):
    made, path = volumes(tmp_path)
    rows = nifti.read_slabs(spark, path, thickness).collect()
    for name, data in made.items():
        own = sorted((r for r in rows if r["name"] == name), key=lambda r: r["first"])
        assert [r["first"] for r in own] == list(range(0, data.shape[-1], thickness))
        parts = [np.frombuffer(r["data"], "<f4").reshape((*data.shape[:-1], r["thick"])) for r in own]
        assert np.array_equal(np.concatenate(parts, axis=-1), data)
    (tmp_path / "vol/a.nii").write_bytes((tmp_path / "vol/a.nii").read_bytes()[:-1])
    with pytest.raises(Exception, match="ends before"):
        nifti.read_slabs(spark, path, thickness).collect()
    with pytest.raises(ValueError, match="at least one"):
        nifti.read_slabs(spark, path, 0)


def test_files_by_name_of_a_store(spark, tmp_path):
    df = spark.createDataFrame([("a/b.bin", bytearray(b"one")), ("c.bin", bytearray(b"two"))], "name string, content binary")
    for _ in range(2):
        report.write_files(df, f"file://{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a/b.bin": b"one", "c.bin": b"two"}
    for bad in ("/x", "a/../../x", ""):
        with pytest.raises(Exception, match="leaves"):
            report.write_files(spark.createDataFrame([(bad, bytearray(b"1"))], "name string, content binary"), str(tmp_path / "out"))
