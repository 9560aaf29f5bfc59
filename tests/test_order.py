import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcohort.operators import order

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0, math.nextafter(2, 0), 3.0, 0.1, -0.1, 1e300, 1e-300, float(2**53 + 2), 8.0, math.nextafter(8, 0)]


def test_places_are_the_bits(spark):
    rnd = random.Random(4)
    values = EDGES + [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    values = [v for v in values if math.isfinite(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", order.place_of(F.col("v")).alias("p")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.p == (bits if r.v > 0 else -bits), r.v
        assert order.value_of(r.p) == r.v


@pytest.mark.parametrize("kind", ["normal", "ties", "narrow", "wide", "mixed"])
def test_quantiles_equal_a_sort(spark, kind):
    rng = np.random.default_rng(3)
    n = 3000
    make = {
        "normal": lambda: rng.normal(size=n),
        "ties": lambda: rng.integers(-3, 4, n).astype(float),
        "narrow": lambda: 1000 + rng.random(n) * 1e-9,
        "wide": lambda: rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
        "mixed": lambda: rng.choice([*EDGES[:9], np.nan, np.inf, -np.inf], n),
    }[kind]
    v, g = make(), rng.choice(["a", "b", "hot", "hot", "hot", "hot"], n)
    df = spark.createDataFrame([(str(k) if k != "b" else None, float(x) if not np.isnan(x) or i % 2 else None) for i, (k, x) in enumerate(zip(g, v, strict=True))], "g string, v double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.g, r.prob): (r.n, r.quantile) for r in order.quantiles(df, "v", ["g"], probs).collect()}
    for k in set(g):
        own = np.sort(v[(g == k) & np.isfinite(v)])
        for p in probs:
            low, high, share = order.around(len(own), p)
            want = own[low] if own[low] == own[high] or not share else own[low] + (own[high] - own[low]) * share
            assert got[None if k == "b" else k, p] == (len(own), want)


def test_sets_of_cells(spark):
    rng = np.random.default_rng(5)
    o, i, v = rng.integers(0, 4, 2000), rng.integers(0, 3, 2000), rng.normal(size=2000)
    df = spark.createDataFrame(list(zip(o.tolist(), i.tolist(), v.tolist(), strict=True)), "o int, i int, v double")
    sets = lambda cell: [(a, b) for a in range(4) if a != cell[0] for b in [None, 0, 1, 2] if b != cell[1]]
    size, got = order.order_statistics(df, "v", ["o", "i"], sets, lambda n: [0, n // 2, n - 1])
    for a in range(4):
        for b in [None, 0, 1, 2]:
            own = np.sort(v[(o != a) & (i != (-1 if b is None else b))])
            assert size[a, b] == len(own)
            for k in (0, len(own) // 2, len(own) - 1):
                assert got[(a, b), k] == own[k]


def test_odd_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "g string, v double")
    assert order.quantiles(empty, "v", ["g"], [0.5]).collect() == []
    one = spark.createDataFrame([("a", 3.5, 1), ("b", None, 1), ("a", float("nan"), 1)], "g string, v double, prob int")
    assert [tuple(r) for r in order.quantiles(one, "v", ["g"], [0.5]).collect()] == [("a", 1, 0.5, 3.5)]
    # no groups; columns named like those of the operator
    clash = one.select(F.col("v").alias("__v"), F.col("v").alias("__p"), F.lit(1).alias("__cell"))
    assert [tuple(r) for r in order.quantiles(clash, "__v", [], [0.0, 1.0]).collect()] == [(1, 0.0, 3.5), (1, 1.0, 3.5)]
    monkeypatch.setattr(order, "CELLS", 1)
    with pytest.raises(ValueError, match="cells"):
        order.quantiles(spark.range(5).select("id", F.col("id").cast("double").alias("v")), "v", ["id"], [0.5])


def test_rows_spread_over_cells(spark):
    # a row in several cells, a few bits of its value at a time; rows of other runs are left out before they are spread
    rng = np.random.default_rng(8)
    v = np.concatenate((rng.normal(size=400), rng.integers(0, 3, 100)))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "k int, v double")
    given = []

    def spread(rows):
        given.append(rows)
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("o")).where("k % 5 <> o")

    size, got = order.order_statistics(df, "v", ["o"], lambda c: [c[0]], lambda n: [0, n // 2], spread, 11)
    for o in range(5):
        own = np.sort(v[np.arange(len(v)) % 5 != o])
        assert (size[o], got[o, 0], got[o, len(own) // 2]) == (len(own), own[0], own[len(own) // 2])
    assert given[-1].count() < len(v) / 4


def test_a_place_is_computed_once_a_row(spark):
    # in every round, the later ones with their filter on runs too
    v = EDGES + np.random.default_rng(9).normal(size=300).tolist()
    df = spark.createDataFrame([("a", x) for x in [*v, None, float("nan")]], "g string, v double")
    given = []
    size, got = order.order_statistics(df, "v", ["g"], lambda c: [c[0]], lambda n: [0, n // 2, n - 1], lambda rows: given.append(rows) or rows)
    own = sorted(v)
    assert size == {"a": len(v)} and got == {("a", k): own[k] for k in (0, len(v) // 2, len(v) - 1)}
    plans = [rows.select("g", "__q")._jdf.queryExecution().optimizedPlan().toString() for rows in given]
    assert len(plans) > 2 and [p.upper().count("LOG2(") for p in plans] == [1] * len(plans)
