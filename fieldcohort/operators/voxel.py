"""Volumes as voxel rows: (case_id, x, y, z, value columns).

All operators are partitioned by case, so one exchange on case_id serves a chain of them (mirroring, gradients, Jacobians,
distances, shells).  Neighbour access is a window over a grid line; the mirror is an equi-join on the reflected index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X

#: Distance shells in mm, lower bound in, upper bound out; the near shell overlaps the others. Fixed values.
SHELLS = (("3_5mm", 3.0, 5.0), ("5_10mm", 5.0, 10.0), ("10_20mm", 10.0, 20.0), ("20_40mm", 20.0, 40.0))
NEAR = ("near_3_20mm", 3.0, 20.0)
AXES = ("x", "y", "z")


def explode_volume(df: DataFrame, case: str, data: str, shape: tuple[int, int, int], value: str = "value") -> DataFrame:
    """One row for each voxel of an array in C order."""
    _, ny, nz = shape
    rows = df.select(F.col(case).alias("case_id"), F.posexplode(data).alias("pos", value))
    return rows.select("case_id", F.expr(f"pos div {ny * nz}").cast("int").alias("x"), F.expr(f"(pos div {nz}) % {ny}").cast("int").alias("y"), (F.col("pos") % nz).cast("int").alias("z"), F.col(value).cast("double").alias(value))


def register_functions(spark: SparkSession) -> None:
    """Register the table function explode_volume(data, ny, nz) for SQL: a row (x, y, z, value) for each voxel of an array in C
    order.  Its body is SQL, so that queries which use it are planned as a whole."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION explode_volume(data ARRAY<DOUBLE>, ny INT, nz INT) RETURNS TABLE (x INT, y INT, z INT, value DOUBLE) "
        "RETURN SELECT CAST(pos DIV (ny * nz) AS INT), CAST((pos DIV nz) % ny AS INT), CAST(pos % nz AS INT), col FROM posexplode(data)"
    )


def collect_volume(df: DataFrame, value: str, out: str = "data") -> DataFrame:
    """One array for each case, in C order; meant for grids that fit a row."""
    return df.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "z", value))), lambda v: v[value]).alias(out))


def hemisphere(x: Column, size: int, side: str | Column, buffer: float = 0.0) -> Column:
    """Whether a voxel lies beyond the midline by more than ``buffer`` on ``side`` (left: small x); others are false."""
    middle = (size - 1) / 2
    side = F.lit(side) if isinstance(side, str) else side
    return F.when(side == "left", x < middle - buffer).when(side == "right", x > middle + buffer).otherwise(F.lit(False))


def contralateral(x: Column, size: int, side: str | Column, buffer: float = 2.0) -> Column:
    """The hemisphere opposite ``side``, away from the midline; sides other than left and right raise."""
    side = F.lit(side) if isinstance(side, str) else side
    other = F.when(side == "left", "right").when(side == "right", "left").otherwise(F.raise_error(F.concat(F.lit("no contralateral side of "), F.coalesce(side, F.lit("null")))))
    return hemisphere(x, size, other, buffer)


def nearest(c: Column) -> Column:
    """The voxel index nearest to a coordinate; halves go up."""
    return F.floor(c + 0.5).cast("int")


def in_grid(coordinates: tuple[str, str, str], shape: tuple[int, int, int]) -> Column:
    """Whether all coordinates are finite and between the first and the last voxel centre."""
    out = F.lit(True)
    for c, n in zip(coordinates, shape, strict=True):
        v = X.finite(F.col(c))
        out = out & v.isNotNull() & (v >= 0) & (v <= n - 1)
    return out


def valid_map(df: DataFrame, masks: DataFrame, shape: tuple[int, int, int], coordinates: tuple[str, str, str] = ("cx", "cy", "cz"), target: str = "target") -> DataFrame:
    """Add ``valid``: the target mask holds, the coordinates are finite and in bounds, and the nearest source voxel lies
    in the source mask (``masks``: case_id, x, y, z of voxels inside)."""
    inside = F.col(target) & in_grid(coordinates, shape)
    near = [nearest(X.finite(F.col(c))).alias(f"__{a}") for a, c in zip(AXES, coordinates, strict=True)]
    source = masks.select(F.col("case_id"), *[F.col(a).alias(f"__{a}") for a in AXES]).distinct().withColumn("__in", F.lit(True))
    joined = df.select("*", *near).join(source, ["case_id", "__x", "__y", "__z"], "left")
    return joined.withColumn("valid", F.coalesce(inside & F.col("__in"), F.lit(False))).drop("__x", "__y", "__z", "__in")


def laterality(lesion: DataFrame, size: int) -> DataFrame:
    """Left and right voxel counts of each case's lesion, its side and its laterality index; midline voxels count on neither
    side, a tie is bilateral, no voxel on either side gives NULL for side and index."""
    middle = (size - 1) / 2
    counted = lesion.groupBy("case_id").agg(F.count_if(F.col("x") < middle).alias("left_voxels"), F.count_if(F.col("x") > middle).alias("right_voxels"))
    left, right = F.col("left_voxels"), F.col("right_voxels")
    side = F.when(left + right == 0, None).when(left > right, "left").when(right > left, "right").otherwise("bilateral")
    return counted.select("case_id", "left_voxels", "right_voxels", side.alias("side"), F.try_divide(F.abs(left - right).cast("double"), (left + right).cast("double")).alias("laterality_index"))


def mirrored(df: DataFrame, size: int, vector: list[str], scalars: list[str] = (), prefix: str = "m_") -> DataFrame:
    """The reflection across the first axis, as rows of the reflected places: the first vector component changes sign."""
    first, *rest = vector
    return df.select("case_id", (F.lit(size - 1) - F.col("x")).cast("int").alias("x"), "y", "z", (-F.col(first)).alias(prefix + first), *[F.col(c).alias(prefix + c) for c in [*rest, *scalars]])


def effect(df: DataFrame, size: int, vector: list[str] = ("u0", "u1", "u2"), valid: str = "valid", target: str = "target", side: str = "side", jacobian: str | None = "jac") -> DataFrame:
    """The lesion effect: vector minus its mirror image, kept on the lesional side where both partners are valid and neither
    lies in the target; zero elsewhere.  With ``jacobian``, log-Jacobian asymmetry on pairs of positive Jacobians too."""
    vector = list(vector)
    scalars = [valid, target] + ([jacobian] if jacobian else [])
    both = df.join(mirrored(df, size, vector, scalars), ["case_id", *AXES])
    keep = F.col(valid) & F.col(f"m_{valid}") & ~F.col(target) & ~F.col(f"m_{target}") & hemisphere(F.col("x"), size, F.col(side))
    if jacobian:
        keep = keep & (F.col(jacobian) > 0) & (F.col(f"m_{jacobian}") > 0)
    keep = F.coalesce(keep, F.lit(False))
    out = [F.when(keep, F.col(c) - F.col(f"m_{c}")).otherwise(F.lit(0.0)).alias(f"e{k}") for k, c in enumerate(vector)]
    if jacobian:
        logs = [F.ln(F.when(F.col(c) > 0, F.col(c))) for c in (jacobian, f"m_{jacobian}")]
        out.append(F.when(keep, logs[0] - logs[1]).otherwise(F.lit(0.0)).alias("logj"))
    return both.select("case_id", *AXES, keep.alias("effect_valid"), *out)


def gradient(value: str, axis: str, spacing: float = 1.0) -> Column:
    """Derivative along an axis: central inside, one-sided at the ends; a line of one voxel gives NULL."""
    across = [a for a in AXES if a != axis]
    w = Window.partitionBy("case_id", *across).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    here = F.col(value)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * spacing)).when(after.isNotNull(), (after - here) / spacing).when(before.isNotNull(), (here - before) / spacing)


def gradients(df: DataFrame, values: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Add d<value>_d<axis> for each value and axis."""
    return df.select("*", *[gradient(v, a, h).alias(f"d{v}_d{a}") for v in values for a, h in zip(AXES, spacing, strict=True)])


def jacobian(df: DataFrame, vector: list[str] = ("u0", "u1", "u2"), spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), out: str = "jac") -> DataFrame:
    """Add det(I + grad u)."""
    g = gradients(df, list(vector), spacing)
    f = [[F.col(f"d{v}_d{a}") + (1.0 if i == j else 0.0) for j, a in enumerate(AXES)] for i, v in enumerate(vector)]
    det = f[0][0] * (f[1][1] * f[2][2] - f[1][2] * f[2][1]) - f[0][1] * (f[1][0] * f[2][2] - f[1][2] * f[2][0]) + f[0][2] * (f[1][0] * f[2][1] - f[1][1] * f[2][0])
    return g.withColumn(out, det).drop(*[f"d{v}_d{a}" for v in vector for a in AXES])


def folding(df: DataFrame, jac: str = "jac", valid: Column | None = None) -> DataFrame:
    """Share of valid voxels with a Jacobian of 0 or less, and the smallest Jacobian, for each case."""
    rows = df.where(valid) if valid is not None else df
    return rows.groupBy("case_id").agg(F.avg((F.col(jac) <= 0).cast("double")).alias("folding_fraction"), F.min(jac).alias("minimum_jacobian"))


#: Voxels of the lines that a task sweeps at once.
SWEPT = 1 << 20


def _swept(places: np.ndarray, d: np.ndarray, step: float) -> np.ndarray:
    """The least of d + (step * way)^2 along each line (a row of places and of d, NaN where there is none)."""
    out, at = np.full(d.shape, np.inf), places * step
    known = np.where(np.isnan(d), np.inf, d)
    for j in np.flatnonzero(np.isfinite(known).any(axis=0)):
        np.minimum(out, known[:, j : j + 1] + (at - at[:, j : j + 1]) ** 2, out=out)
    return np.where(np.isinf(out), np.nan, out)


def _line_sweep(df: DataFrame, axis: str, step: float) -> DataFrame:
    """The least of d + (step * way)^2 along the lines of an axis, for rows (case_id, x, y, z, d) where d may be NULL.

    A line is one row, so each voxel is shuffled once; lines of one length are swept together as an array, once for each
    place at which any of them has a value."""
    keys = ["case_id", *[a for a in AXES if a != axis]]
    lines = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("a"), F.col("d").alias("d")))).alias("line"))
    lines = lines.select(*keys, F.transform("line", lambda x: x["a"].cast("int")).alias("a"), F.transform("line", lambda x: x["d"]).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("a")).to_numpy()
            a, d = batch.column("a").flatten().to_numpy(), batch.column("d").flatten().to_numpy(zero_copy_only=False)
            first, out = np.cumsum(sizes) - sizes, np.empty(len(d))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for part in np.array_split(rows, -(-len(rows) * int(n) // SWEPT)):
                    at = first[part][:, None] + np.arange(n)
                    out[at] = _swept(a[at].astype(np.float64), d[at].astype(np.float64), step)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            found = pa.ListArray.from_arrays(ends, pa.array(out, pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.ListArray.from_arrays(ends, pa.array(a, pa.int32())), found], names=[*keys, "a", "d"])

    swept = lines.mapInArrow(run, lines.schema)
    rows = swept.select(*keys, F.explode(F.arrays_zip("a", "d")).alias("p"))
    return rows.select(*keys, F.col("p.a").alias(axis), F.col("p.d").alias("d"))


def lesion_distance(grid: DataFrame, lesion: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Add ``distance`` to the nearest lesion voxel of the case (NULL where a case has none).

    Separable: along x the nearest lesion voxel of each line, then the best over y, then over z (``_line_sweep``): no line is
    joined with itself."""
    marks = lesion.select("case_id", *AXES).distinct().withColumn("__l", F.lit(True))
    d = grid.join(marks, ["case_id", *AXES], "left").select("case_id", *AXES, F.when(F.col("__l"), F.lit(0.0)).alias("d"))
    for axis, step in zip(AXES, spacing, strict=True):
        d = _line_sweep(d, axis, float(step))
    return grid.join(d.select("case_id", *AXES, F.sqrt("d").alias("distance")), ["case_id", *AXES])


def normals(df: DataFrame, distance: str = "distance", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Add n0, n1, n2: the unit gradient of the distance, zero where it is 1e-6 or shorter."""
    g = gradients(df, [distance], spacing)
    parts = [F.coalesce(F.col(f"d{distance}_d{a}"), F.lit(0.0)) for a in AXES]
    norm = F.sqrt(sum(p * p for p in parts))
    g = g.withColumn("__n", norm)
    out = [F.when(F.col("__n") > 1e-6, p / F.col("__n")).otherwise(F.lit(0.0)).alias(f"n{k}") for k, p in enumerate(parts)]
    return g.select(*df.columns, *out)


def radial_magnitude(vector: list[str], normal: list[str], valid: Column) -> list[Column]:
    """Projection on the normal and length of the effect, zero off its support."""
    dot = sum(F.col(a) * F.col(b) for a, b in zip(vector, normal, strict=True))
    length = F.sqrt(sum(F.col(a) * F.col(a) for a in vector))
    return [F.when(valid, dot).otherwise(F.lit(0.0)).alias("radial"), F.when(valid, length).otherwise(F.lit(0.0)).alias("magnitude")]


def shell_rows(df: DataFrame, shells: tuple = (*SHELLS, NEAR), distance: str = "distance") -> DataFrame:
    """Each voxel once for every shell it lies in; the near shell is one more, not a roll-up of the others."""
    d = F.col(distance)
    shells = F.filter(F.array(*[F.when((d >= a) & (d < b), F.lit(n)) for n, a, b in shells]), lambda s: s.isNotNull())
    return df.withColumn("shell", F.explode(shells))


def shell_summary(df: DataFrame, analysis: Column, voxel_mm3: float = 1.0, shells: tuple = (*SHELLS, NEAR)) -> DataFrame:
    """For each case and shell: summaries of magnitude, radial and logj over the analysis voxels, the outward and inward
    shares, the mean absolute radial part and the clipped integrals (times voxel volume in ml)."""
    ml = voxel_mm3 / 1000.0
    r, m, j = F.col("radial"), F.col("magnitude"), F.col("logj")
    zero = F.lit(0.0)
    return shell_rows(df.where(analysis), shells).groupBy("case_id", "shell").agg(
        *X.summary(m, "magnitude"),
        *X.summary(r, "radial"),
        *X.summary(j, "logj"),
        F.avg((r > 0).cast("double")).alias("outward_fraction"),
        F.avg((r < 0).cast("double")).alias("inward_fraction"),
        F.avg(F.abs(r)).alias("mean_absolute_radial"),
        (F.sum(F.greatest(r, zero)) * ml).alias("outward_integral"),
        (F.sum(F.greatest(-r, zero)) * ml).alias("inward_integral"),
        (F.sum(m) * ml).alias("magnitude_integral"),
        (F.sum(F.greatest(j, zero)) * ml).alias("expansion_integral"),
        (F.sum(F.greatest(-j, zero)) * ml).alias("compression_integral"),
    )


def qc_flags(df: DataFrame, minimum_laterality: float = 0.8, maximum_folding: float = 0.05, minimum_mm3: float = 1000.0, voxel_mm3: float = 1.0) -> DataFrame:
    """Add signal_ratio and deformation_qc_pass to case rows (laterality_index, folding_fraction, near_voxels,
    magnitude_median, sensitivity_median)."""
    import math

    least = math.ceil(minimum_mm3 / voxel_mm3)
    good = (F.col("laterality_index") >= minimum_laterality) & (F.col("folding_fraction") <= maximum_folding) & (F.col("near_voxels") >= least)
    return df.withColumns({"signal_ratio": X.clean_ratio(X.finite(F.col("magnitude_median")), X.finite(F.col("sensitivity_median"))), "deformation_qc_pass": F.coalesce(good, F.lit(False))})


def strided(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th voxel of each axis, with the indices of the smaller grid."""
    keep = df.where(" and ".join(f"{a} % {step} = 0" for a in AXES))
    return keep.withColumns({a: F.expr(f"{a} div {step}").cast("int") for a in AXES})


def strided_rows(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th voxel of each case in C order of the rows that are there."""
    order = Window.partitionBy("case_id").orderBy(*AXES)
    return df.withColumn("__k", F.row_number().over(order) - 1).where(f"__k % {step} = 0").drop("__k")


def support_audit(df: DataFrame, value: str, size: int, side: str = "side") -> DataFrame:
    """Voxels that are not zero, and the largest absolute value, on the side that must be empty."""
    opposite = contralateral(F.col("x"), size, F.col(side), 0.0)
    return df.where(opposite).groupBy("case_id").agg(F.count_if(F.coalesce(F.col(value) != 0, F.lit(True))).alias("nonzero"), F.max(F.abs(value)).alias("largest"))


def support_of_maps(df: DataFrame, values: list[str], size: int, side: str = "side") -> DataFrame:
    """``support_audit`` of several maps at once: (case_id, map, nonzero, largest)."""
    opposite = contralateral(F.col("x"), size, F.col(side), 0.0)
    wide = df.where(opposite).groupBy("case_id").agg(*[x for v in values for x in (F.count_if(F.coalesce(F.col(v) != 0, F.lit(True))).alias(f"{v}__nonzero"), F.max(F.abs(v)).alias(f"{v}__largest"))])
    cells = F.array(*[F.struct(F.lit(v).alias("map"), F.col(f"{v}__nonzero").alias("nonzero"), F.col(f"{v}__largest").alias("largest")) for v in values])
    return wide.select("case_id", F.explode(cells).alias("m")).select("case_id", "m.*")


def nearest_sample(df: DataFrame, source: DataFrame, coordinates: tuple[str, str, str], value: str, shape: tuple[int, int, int], out: str = "sampled") -> DataFrame:
    """The source voxel nearest to each coordinate (halves go up), 0 where a coordinate is outside the grid."""
    near = [nearest(X.finite(F.col(c))).alias(f"__{a}") for a, c in zip(AXES, coordinates, strict=True)]
    looked = source.select("case_id", *[F.col(a).alias(f"__{a}") for a in AXES], F.col(value).alias("__v"))
    joined = df.select("*", *near).join(looked, ["case_id", "__x", "__y", "__z"], "left")
    return joined.withColumn(out, F.when(in_grid(coordinates, shape), F.coalesce("__v", F.lit(0.0))).otherwise(F.lit(0.0))).drop("__x", "__y", "__z", "__v")


def trilinear_sample(df: DataFrame, source: DataFrame, coordinates: tuple[str, str, str], value: str, shape: tuple[int, int, int], out: str = "sampled") -> DataFrame:
    """Trilinear interpolation at each coordinate from the eight corners; 0 where a coordinate is outside the grid.

    Each source voxel is handed to the eight cells that it is a corner of; a cell is then one row with its corners, and a
    coordinate meets one cell.  Cells are dealt by the keys of that join, so the source is exchanged once, ``df`` once."""
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    spread = source.select("case_id", *AXES, F.col(value).cast("double").alias("__v"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(AXES, c, strict=True)], F.lit(n).alias("n")) for n, c in enumerate(corners)])).alias("__c"))
    spread = spread.select("case_id", *[(F.col(a) - F.col(f"__c.{a}")).alias(f"__{a}") for a in AXES], F.col("__c.n").alias("__n"), "__v")
    cells = spread.groupBy("case_id", "__x", "__y", "__z").agg(*[F.max(F.when(F.col("__n") == n, F.col("__v"))).alias(f"__v{n}") for n in range(8)])
    low = {f"__{a}": F.floor(X.finite(F.col(c))).cast("int") for a, c in zip(AXES, coordinates, strict=True)}
    joined = df.withColumns(low).join(cells, ["case_id", "__x", "__y", "__z"], "left")
    part = [X.finite(F.col(c)) - F.col(f"__{a}") for a, c in zip(AXES, coordinates, strict=True)]
    total = F.lit(0.0)
    for n, corner in enumerate(corners):
        weight = F.lit(1.0)
        for t, up in zip(part, corner, strict=True):
            weight = weight * (t if up else 1 - t)
        total = total + F.coalesce(F.col(f"__v{n}"), F.lit(0.0)) * weight
    return joined.withColumn(out, F.when(in_grid(coordinates, shape), total).otherwise(F.lit(0.0))).drop("__x", "__y", "__z", *[f"__v{n}" for n in range(8)])


def smooth_axis(df: DataFrame, value: str, axis: str, weights: list[float], out: str) -> DataFrame:
    """Convolve one axis with a symmetric kernel (weights from the centre outwards), zeros beyond the grid."""
    across = [a for a in AXES if a != axis]
    w = Window.partitionBy("case_id", *across).orderBy(axis)
    total = F.col(value) * weights[0]
    for k, weight in enumerate(weights[1:], start=1):
        total = total + (F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) + F.coalesce(F.lead(value, k).over(w), F.lit(0.0))) * weight
    return df.withColumn(out, total)


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised Gaussian weights from the centre outwards, cut at int(4 sigma + 0.5)."""
    import math

    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [r / total for r in raw]


def affine_normal_equations(df: DataFrame, coordinates: tuple[str, str, str]) -> DataFrame:
    """Sums of products of a least-squares affine fit of coordinates on voxel indices, one row for each case: the 10 of the
    design and the 12 of design and target."""
    terms = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "c": F.lit(1)}
    names = list(terms)
    design = [F.sum((terms[a] * terms[b]).cast("double")).alias(f"s_{a}{b}") for k, a in enumerate(names) for b in names[k:]]
    target = [F.sum(terms[a].cast("double") * F.col(c)).alias(f"t_{a}_{c}") for a in names for c in coordinates]
    return df.groupBy("case_id").agg(*design, *target)


def fullest_slice(mask: DataFrame, axis: str = "z", window: int = 0) -> DataFrame:
    """For each case the slice of ``axis`` with the most voxels of a mask, weighed against its place (ten voxels make up for
    one slice), and the largest count: (case_id, axis, n).  With ``window``, the first and last slice to show around it, the
    2.5 and 97.5 percentiles of the voxels' places wherever these lie further out."""
    counted = mask.groupBy("case_id", axis).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("case_id").agg(F.max_by(F.col(axis).cast("long"), F.col("n") * 10 - F.col(axis)).alias(axis), F.max("n").alias("n"))
    if not window:
        return best
    p = F.percentile(F.col(axis).cast("double"), F.array(F.lit(0.025), F.lit(0.975)))
    ends = mask.groupBy("case_id").agg(F.floor(F.get(p, 0)).alias("__a"), F.ceil(F.get(p, 1)).alias("__b"))
    return best.join(ends, "case_id").select("case_id", axis, "n", F.least("__a", F.col(axis) - window).alias("first"), F.greatest("__b", F.col(axis) + window).alias("last"))


def vector_error(df: DataFrame, vector: list[str]) -> DataFrame:
    """n, root mean square and largest length of a vector over each case's rows, as for cycle errors."""
    square = sum(F.col(c) ** 2 for c in vector)
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(square)).alias("rmse"), F.max(F.sqrt(square)).alias("largest"))


def volumes_ml(df: DataFrame, masks: list[str], voxel_mm3: float = 1.0) -> DataFrame:
    """The volume of each mask column in ml, for each case: its voxels times their volume."""
    return df.groupBy("case_id").agg(*[(F.count_if(F.col(m)) * F.lit(voxel_mm3) / 1000.0).alias(f"{m}_ml") for m in masks])


def field_energy(df: DataFrame, vector: list[str], other: list[str], valid: Column) -> DataFrame:
    """For each case the energy of a vector field (sum of squares), its root mean square on the valid voxels, and how far
    another field lies from it: the root mean square of the difference over that of the field."""
    square = sum(F.col(c) ** 2 for c in vector)
    gap = sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(vector, other, strict=True))
    return df.groupBy("case_id").agg(F.sum(square).alias("energy"), F.sqrt(F.avg(F.when(valid, square))).alias("rms"), (F.sqrt(F.avg(gap)) / F.greatest(F.sqrt(F.avg(square)), F.lit(1e-12))).alias("relative_rmse"))


def affine_prediction(coefficients: list[list[float]]) -> list[Column]:
    """The coordinates that an affine map (rows for x, y, z and the shift) gives each voxel."""
    terms = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    return [sum(t * F.lit(float(row[k])) for t, row in zip(terms, coefficients, strict=True)).alias(f"p{k}") for k in range(3)]


def sensitivity(effect_rows: DataFrame, other: DataFrame, vector: tuple[str, ...] = ("e0", "e1", "e2"), valid: str = "effect_valid") -> DataFrame:
    """How far two effects of a case lie apart at each voxel, zero off their common support (zeros count in summaries)."""
    keys = ["case_id", *AXES]
    both = effect_rows.select(*keys, valid, *vector).join(other.select(*keys, F.col(valid).alias("__v"), *[F.col(c).alias(f"__{c}") for c in vector]), keys)
    apart = F.sqrt(sum((F.col(c) - F.col(f"__{c}")) ** 2 for c in vector))
    return both.select(*keys, F.when(F.col(valid) & F.col("__v"), apart).otherwise(F.lit(0.0)).alias("sensitivity"))


def compose(outer: DataFrame, inner: DataFrame, shape: tuple[int, int, int], vector: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The displacement of (identity + outer) after (identity + inner), as voxel rows; the identity continues beyond the grid.
    Each component of ``outer`` is sampled where ``inner`` leads."""
    at = [f"__c{a}" for a in AXES]
    moved = inner.select("case_id", *AXES, *vector, *[(F.col(a) + F.col(u) / h).alias(c) for a, u, h, c in zip(AXES, vector, spacing, at, strict=True)])
    for u in vector:
        moved = trilinear_sample(moved, outer, tuple(at), u, shape, f"__{u}")
    return moved.select("case_id", *AXES, *[(F.col(u) + F.col(f"__{u}")).alias(u) for u in vector])


def mirror_dice(mask: DataFrame, size: int) -> DataFrame:
    """Overlap of each case's mask (rows of voxels inside) with its own mirror image."""
    places = mask.select("case_id", *AXES).distinct()
    image = places.select("case_id", (F.lit(size - 1) - F.col("x")).cast("int").alias("x"), "y", "z")
    common = places.join(image, ["case_id", *AXES]).groupBy("case_id").agg(F.count(F.lit(1)).alias("__both"))
    sizes = places.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    return sizes.join(common, "case_id", "left").select("case_id", (F.coalesce("__both", F.lit(0)) / F.col("__n")).alias("dice"))


def physical_point(index: list[Column], origin: list[float], spacing: list[float], direction: list[list[float]]) -> list[Column]:
    """The physical point (LPS) of voxel indices, as columns p0, p1, p2."""
    steps = [i * F.lit(float(h)) for i, h in zip(index, spacing, strict=True)]
    return [(sum(F.lit(float(d)) * s for d, s in zip(row, steps, strict=True)) + F.lit(float(o))).alias(f"p{k}") for k, (row, o) in enumerate(zip(direction, origin, strict=True))]
