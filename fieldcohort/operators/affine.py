"""The robust affine fit of a field on voxel rows, for cases that fit no task.

Iterated trimming: a least-squares fit per case from sums of products, the residual lengths of all points, a limit from the
median and the median absolute deviation of the points kept so far, and a new set of kept points; a case whose set no longer
changes, or would become too small, is done.  Each round is two aggregates, exact medians (by ``order`` where a case fits no task) and joins of a
row a case; between rounds the points are staged, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.operators import cohort, order
from fieldcohort.operators import kernels as K
from fieldcohort.session import staged

PLACES, VALUES = ("px", "py", "pz"), ("u0", "u1", "u2")


def _fits(kept: DataFrame) -> DataFrame:
    """(case_id, fit): the 4 by 3 coefficients, row by row, of each case's points (centred places and values)."""
    terms = [*[F.col(p) for p in PLACES], F.lit(1.0)]
    sums = [F.sum(a * b) for a in terms for b in (*terms, *map(F.col, VALUES))]
    made = kept.groupBy("case_id").agg(F.array(*sums).alias("sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = batch.column("sums").flatten().to_numpy().reshape(-1, 4, 7)
                fits = np.stack([K.affine_from_sums(s) for s in sums]).reshape(len(sums), 12)
                yield pa.RecordBatch.from_arrays([batch.column("case_id"), pa.array(list(fits), pa.list_(pa.float64()))], names=["case_id", "fit"])

    case = kept.schema["case_id"].dataType.simpleString()
    return made.mapInArrow(solve, f"case_id {case}, fit array<double>")


def _missed(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Add ``miss``, the length of the residual of each point under its case's fit."""
    off = [F.col(v) - sum((F.get("fit", 3 * i + k) * F.col(p) for i, p in enumerate(PLACES)), F.get("fit", 9 + k)) for k, v in enumerate(VALUES)]
    return points.join(cohort.small(fits), "case_id").withColumn("miss", F.sqrt(sum((e * e for e in off[1:]), off[0] * off[0])))


#: Points of a case up to which a task takes its median from a table of its distinct values.
IN_TASK = 1_000_000


def _medians(rows: DataFrame, value: str, out: str, largest: int) -> DataFrame:
    """The exact median of each case; ``largest``: the points of the largest one."""
    if largest <= IN_TASK:
        return rows.groupBy("case_id").agg(F.percentile(value, F.lit(0.5)).alias(out))
    return order.quantiles(rows, value, ["case_id"], [0.5]).select("case_id", F.col("quantile").alias(out))


def robust_affine(df: DataFrame, minimum: int = 10_000, rounds: int = K.ROUNDS) -> DataFrame:
    """Fit an affine map from (x, y, z) to (u0, u1, u2) for each case of voxel rows, as ``kernels.robust_affine`` does.

    Points beyond median + 4.5 * 1.4826 MAD of the residual length are rejected in up to ``rounds`` rounds, each from all points;
    a round that would leave under ``minimum`` points (4 at least) is not taken.  Returns case_id, points, rmse and inliers
    (share) of the kept points, rounds taken, and affine (4 by 3 coefficients, row by row, the last for the constant).  Rows
    with a NULL are left out; a case of fewer than ``minimum`` points raises; an empty table gives no rows."""
    rows = df.select("case_id", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[F.col(v).cast("double").alias(v) for v in VALUES]).dropna()
    middle = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in "xyz"])
    few = middle.where(F.col("n") < max(4, minimum)).select("case_id", "n").limit(5).collect()
    if few:
        raise ValueError(f"cases of fewer than {max(4, minimum)} points: {sorted(map(tuple, few))}")
    middle = staged(middle, "affine-cases")
    largest = middle.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    centred = rows.join(cohort.small(middle), "case_id").select("case_id", *[(F.col(a) - F.col(f"m{a}")).alias(f"p{a}") for a in "xyz"], *VALUES)
    points = staged(centred.withColumns({"kept": F.lit(True), "done": F.lit(False), "taken": F.lit(0)}), "affine-points")
    for _ in range(rounds):
        now = staged(_missed(points, _fits(points.where("kept"))), "affine-misses")
        live = now.where("kept and not done")
        usual = _medians(live, "miss", "usual", largest)
        apart = live.join(cohort.small(usual), "case_id").select("case_id", F.abs(F.col("miss") - F.col("usual")).alias("way"))
        limits = usual.join(_medians(apart, "way", "mad", largest), "case_id").select("case_id", (F.col("usual") + K.LIMIT * F.greatest(K.MAD * F.col("mad"), F.lit(K.LEAST_SCALE))).alias("most"))
        near = now.join(cohort.small(limits), "case_id", "left").withColumn("near", F.coalesce(F.col("miss") <= F.col("most"), F.col("kept")))
        moves = near.groupBy("case_id").agg((~F.max("done") & (F.count_if("near") >= max(4, minimum)) & F.max(F.col("near") != F.col("kept"))).alias("moves"))
        kept = F.when(F.col("moves"), F.col("near")).otherwise(F.col("kept"))
        points = near.join(cohort.small(moves), "case_id").select("case_id", *PLACES, *VALUES, kept.alias("kept"), (~F.col("moves")).alias("done"), (F.col("taken") + F.col("moves").cast("int")).alias("taken"))
        points = staged(points, "affine-points")
        if points.where("not done").isEmpty():
            break
    fits = staged(_fits(points.where("kept")), "affine-fits")
    error = _missed(points, fits).groupBy("case_id").agg(F.count_if("kept").cast("int").alias("points"), F.sqrt(F.avg(F.when(F.col("kept"), F.col("miss") * F.col("miss")))).alias("rmse"), F.avg(F.col("kept").cast("double")).alias("inliers"), F.max("taken").alias("rounds"))
    constant = [F.get("fit", 9 + k) - sum(F.get("fit", 3 * i + k) * F.col(f"m{a}") for i, a in enumerate("xyz")) for k in range(3)]
    whole = fits.join(cohort.small(middle), "case_id").select("case_id", F.concat(F.slice("fit", 1, 9), F.array(*constant)).alias("affine"))
    return error.join(cohort.small(whole), "case_id")
