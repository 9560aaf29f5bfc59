import numpy as np
import pytest

from fieldcohort.operators import affine
from fieldcohort.operators import kernels as K


def field(seed, shape=(7, 6, 5), share=0.15, noise=0.01):
    """Values of an affine map with noise and a share of outliers."""
    rng = np.random.default_rng(seed)
    places = np.argwhere(np.ones(shape, bool))
    true = rng.normal(size=(4, 3)) * 0.3 + np.vstack((np.eye(3), np.zeros(3)))
    values = np.column_stack((places, np.ones(len(places)))) @ true + rng.normal(size=(len(places), 3)) * noise
    bad = rng.random(len(places)) < share
    values[bad] += rng.normal(size=(bad.sum(), 3)) * 5
    return places, values


def frame(spark, cases, kind="string"):
    rows = [(c, *map(int, p), *map(float, v)) for c, (places, values) in cases.items() for p, v in zip(places, values, strict=True)]
    return spark.createDataFrame(rows, f"case_id {kind}, x int, y int, z int, u0 double, u1 double, u2 double")


@pytest.mark.parametrize("in_task", [0, 1_000_000])
def test_rows_equal_the_kernel(spark, monkeypatch, in_task):
    monkeypatch.setattr(affine, "IN_TASK", in_task)
    cases = {"clean": field(1, share=0), "some": field(2), "many": field(3, share=0.35), "rough": field(4, noise=0.5), "exact": field(5, share=0.05, noise=0)}
    got = {r.case_id: r for r in affine.robust_affine(frame(spark, cases), minimum=50).collect()}
    assert set(got) == set(cases)
    for c, (places, values) in cases.items():
        at = np.full((7, 6, 5, 3), np.nan)
        at[tuple(places.T)] = values
        want = K.robust_affine(at, np.ones((7, 6, 5), bool), 1, 50)
        r = got[c]
        assert (r.points, r.inliers) == (want.points, pytest.approx(want.inliers)), c
        assert r.rmse == pytest.approx(want.rmse, rel=1e-9, abs=1e-12)
        assert np.allclose(np.array(r.affine).reshape(4, 3), want.coefficients)
    assert got["many"].rounds > got["clean"].rounds or got["many"].rounds == K.ROUNDS
    one = affine.robust_affine(frame(spark, {"some": cases["some"]}), minimum=50, rounds=1).first()
    at = np.full((7, 6, 5, 3), np.nan)
    at[tuple(cases["some"][0].T)] = cases["some"][1]
    assert one.points == K.robust_affine(at, np.ones((7, 6, 5), bool), 1, 50, rounds=1).points and one.rounds == 1


def test_too_few_and_empty(spark):
    df = frame(spark, {1: field(1), 2: (np.zeros((3, 3), int), np.zeros((3, 3)))}, "long")
    with pytest.raises(ValueError, match="fewer than 20 points"):
        affine.robust_affine(df, minimum=20)
    assert affine.robust_affine(df.limit(0)).count() == 0
    # a round that would leave too few points is not taken
    places, values = field(6, share=0.3)
    kept = affine.robust_affine(frame(spark, {1: (places, values)}, "long"), minimum=len(places)).first()
    assert kept.points == len(places) and kept.rounds == 0
