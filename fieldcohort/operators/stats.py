"""Rank statistics, tests and summaries as windows and aggregates.

Ranks of whole tables come from counts of distinct values (``ranks``): tied rows are counted before they are shuffled, and
a group's values are ranked in many runs of neighbouring values, whose offsets are sums over a small table.  A group that
holds a third of the rows is thus ranked by many tasks.  ``average_rank`` is the same as a column, for groups that fit a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.functions import special


def average_rank(column: str, groups: list[str]) -> Column:
    """Rank from 1 within the groups, ties sharing the mean of their places; NULL stays NULL."""
    order = Window.partitionBy(*groups).orderBy(F.col(column).asc_nulls_last())
    ties = Window.partitionBy(*groups, F.col(column))
    return F.when(F.col(column).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


#: Runs of values between a power of two and the next.
OCTAVE = 256


def run_of(value: Column) -> Column:
    """The run (long) that a finite double lies in: a larger value is never in an earlier run.

    A run is a stretch of 1 / OCTAVE of the way from one power of two to the next, mirrored for negative values; so the
    runs depend on the value alone, and are at most about half a million whatever the input."""
    size = F.abs(value)
    power = F.floor(F.log2(size)).cast("long")
    # a power that is one too small or too large at a border gives the same run
    place = power * OCTAVE + F.floor(size / F.pow(F.lit(2.0), power) * OCTAVE).cast("long") + 1100 * OCTAVE
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, place).otherwise(-place)


def ranks(counts: DataFrame, value: str, n: str, groups: list[str], out: str) -> DataFrame:
    """Add the mean rank from 1 of each distinct value within its group, from (groups, value, n): how often it occurs."""
    run = "__run"
    rows = counts.withColumn(run, run_of(F.col(value)))
    sums = rows.groupBy(*groups, run).agg(F.sum(n).alias("__m"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, run, F.coalesce(F.sum("__m").over(before.partitionBy(*groups).orderBy(run)), F.lit(0)).alias("__from"))
    inside = F.coalesce(F.sum(n).over(before.partitionBy(*groups, run).orderBy(value)), F.lit(0))
    rank = F.col("__from") + F.col("__in") + (F.col(n) + 1) / 2.0
    return rows.withColumn("__in", inside).join(offsets, [*groups, run]).withColumn(out, rank).drop(run, "__in", "__from")


def ranked(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """Add the mean rank of ``value`` (no NULLs) within the groups to the rows of ``df``."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    # as many ranks as distinct values: Spark's estimate, from the files' bytes, would send millions of them through the driver
    return df.join(ranks(counts, value, "__n", groups, out).drop("__n").hint("merge"), [*groups, value])


def spearman(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """n and rho for each group, over the rows where both are there; rho is NULL without spread.

    Rows are first counted by their pair of values, and both columns are ranked in one pass over these counts, which is all
    that is shuffled; ranks go back to the pairs."""
    pairs = df.select(*groups, X.finite(F.col(x)).alias("__x"), X.finite(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    pairs = pairs.groupBy(*groups, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("__w"), F.col(f"__{w}").alias("__v")) for w in "xy"])).alias("__s")
    counts = pairs.select(*groups, "__n", sides).groupBy(*groups, F.col("__s.__w").alias("__w"), F.col("__s.__v").alias("__v")).agg(F.sum("__n").alias("__n"))
    rank = ranks(counts, "__v", "__n", [*groups, "__w"], "__r").drop("__n")
    of = {w: rank.where(F.col("__w") == w).select(*groups, F.col("__v").alias(f"__{w}"), F.col("__r").alias(f"__r{w}")) for w in "xy"}
    both = pairs.join(of["x"], [*groups, "__x"]).join(of["y"], [*groups, "__y"])
    weighted = lambda a, b: F.sum(F.col("__n") * F.col(a) * F.col(b)) / F.sum("__n")
    sums = both.groupBy(*groups).agg(F.sum("__n").alias("n"), weighted("__rx", "__rx").alias("xx"), weighted("__ry", "__ry").alias("yy"), weighted("__rx", "__ry").alias("xy"))
    # ranks of n rows have the mean (n + 1) / 2, with and without ties
    vx, vy, cov = (F.col(c) - F.pow((F.col("n") + 1) / 2, 2) for c in ("xx", "yy", "xy"))
    return sums.select(*groups, "n", F.when((F.col("n") >= 2) & (vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("rho"))


def numbered(df: DataFrame, runs: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``, the place from 0 of each row in the order of ``runs`` and then ``order``, and ``__total``, the number of
    rows.  Each run is numbered by a task of its own; the runs' offsets are sums over a table of their sizes, so there must
    be few of them (thousands)."""
    sizes = df.groupBy(*runs).agg(F.count(F.lit(1)).alias("__m"))
    before = Window.orderBy(*runs).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each run
    offsets = sizes.select(*[F.col(r).alias(f"__o{k}") for k, r in enumerate(runs)], F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__from"), F.sum("__m").over(Window.partitionBy()).alias("__total"))
    inside = df.withColumn("__in", F.row_number().over(Window.partitionBy(*runs).orderBy(*order)) - 1)
    same = [inside[r].eqNullSafe(offsets[f"__o{k}"]) for k, r in enumerate(runs)]
    return inside.join(F.broadcast(offsets), same).withColumn(out, F.col("__from") + F.col("__in")).drop("__in", "__from", *[f"__o{k}" for k in range(len(runs))])


#: Rows up to which a table is numbered by one task, and runs that a larger one is cut into.
ONE_TASK, CUTS = 100_000, 256


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``, the place (int, from 0) of each row in the order of the columns ``order``.

    A larger table is cut at the ordered values of a bounded number of its rows (those with the smallest hashes); where the
    cuts lie changes the work of the tasks, not the numbers."""
    if df.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) - 1)
    sample = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(CUTS).distinct()
    cuts = sample.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("__cuts"))  # one row of CUTS places at most
    here = F.struct(*order)
    rows = df.join(F.broadcast(cuts)).withColumn("__run", F.size(F.filter("__cuts", lambda c: c <= here))).drop("__cuts")
    return numbered(rows, ["__run"], order, out).withColumn(out, F.col(out).cast("int")).drop("__run", "__total")


def holm(df: DataFrame, p: str, groups: list[str], tie: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family: running maximum of (m - rank) * p over ascending p, 1 at most."""
    order = Window.partitionBy(*groups).orderBy(p, tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    scaled = df.withColumn("__s", (size - F.row_number().over(order) + 1) * F.col(p))
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def signed_ranks(df: DataFrame, d: str, groups: list[str], zeros: str = "pratt") -> DataFrame:
    """What a signed-rank test of the differences ``d`` needs: n, n_zero, ties, w_plus, w_minus, statistic and z, from the
    counts of the distinct absolute differences."""
    rows = df.select(*groups, X.finite(F.col(d)).alias("__d")).where("__d is not null")
    if zeros == "wilcox":
        rows = rows.where("__d <> 0")
    sizes = rows.groupBy(*groups, F.abs("__d").alias("__a")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__d") > 0).alias("__p"), F.count_if(F.col("__d") < 0).alias("__m"))
    rank = ranks(sizes, "__a", "__n", groups, "__r")
    got = rank.groupBy(*groups).agg(
        F.sum("__n").cast("double").alias("n"),
        F.coalesce(F.sum(F.when(F.col("__a") == 0, F.col("__n"))), F.lit(0)).cast("double").alias("n_zero"),
        F.sum(F.col("__p") * F.col("__r")).alias("w_plus"),
        F.sum(F.col("__m") * F.col("__r")).alias("w_minus"),
        # t^3 - t over groups of tied values that are not zero
        F.coalesce(F.sum(F.when(F.col("__a") != 0, F.pow(F.col("__n").cast("double"), 3) - F.col("__n"))), F.lit(0.0)).alias("ties"),
    )
    mean = "(n * (n + 1) - n_zero * (n_zero + 1)) / 4"
    variance = "(n * (n + 1) * (2 * n + 1) - n_zero * (n_zero + 1) * (2 * n_zero + 1)) / 24 - ties / 48"
    return got.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("z", F.expr(f"case when {variance} > 0 then (statistic - {mean}) / sqrt({variance}) end"))


def wilcoxon(df: DataFrame, d: str, groups: list[str], zeros: str = "pratt") -> DataFrame:
    """Signed-rank statistic of the differences ``d``: n, w_plus, w_minus, statistic and z (normal approximation with tie
    correction, no continuity correction).  ``zeros``: "pratt" ranks them and takes them out, "wilcox" drops them first.
    All-zero groups have statistic 0 and z NULL (p is 1)."""
    return signed_ranks(df, d, groups, zeros).select(*groups, F.col("n").cast("long").alias("n"), "w_plus", "w_minus", "statistic", "z")


#: Differences up to which the signed-rank p is exact, if none is zero and none are tied. Fixed value.
EXACT = 50


def signed_rank_test(df: DataFrame, d: str, groups: list[str], zeros: str = "pratt") -> DataFrame:
    """statistic and two-sided p_value of the signed-rank test: exact for at most EXACT differences without zeros and ties,
    else by the normal approximation; 1 where all differences are zero."""
    got = signed_ranks(df, d, groups, zeros)
    exact = (F.col("n") <= EXACT) & (F.col("n_zero") == 0) & (F.col("ties") == 0)
    return got.select(*groups, "statistic", F.coalesce(special.p_of_signed_ranks(F.col("statistic"), F.col("n"), F.col("z"), exact), F.lit(1.0)).alias("p_value"))


def summarize_metrics(df: DataFrame, model: str, repeat: str, metrics: list[str]) -> DataFrame:
    """For each model: mean, sample deviation (0 for one row) and the 2.5 and 97.5 percentiles of each metric, and the
    place of its first appearance by ``repeat``."""
    aggregates = []
    for m in metrics:
        v = X.finite(F.col(m))
        p = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
        aggregates += [F.avg(v).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{m}_sd"), F.get(p, 0).alias(f"{m}_p025"), F.get(p, 1).alias(f"{m}_p975")]
    return df.groupBy(model).agg(*aggregates, F.min(repeat).alias("first_repeat"))


def error_metrics(df: DataFrame, observed: str, predicted: str, groups: list[str]) -> DataFrame:
    """n, mae, rmse, r2 and pearson_r for each group.

    The residuals' sum of squares and the observed values' spread come from one aggregate."""
    o, p = F.col(observed).cast("double"), F.col(predicted).cast("double")
    rows = df.select(*groups, o.alias("__o"), p.alias("__p"))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("__o") - F.col("__p"))).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col("__o") - F.col("__p"), 2))).alias("rmse"),
        (1 - F.try_divide(F.avg(F.pow(F.col("__o") - F.col("__p"), 2)), F.var_pop("__o"))).alias("r2"),
        X.pearson("__o", "__p").alias("pearson_r"),
    )


def subject_errors(df: DataFrame, subject: str, model: str, error: str, models: list[str]) -> DataFrame:
    """Mean error of each subject, a column for each model."""
    return df.groupBy(subject).pivot(model, models).agg(F.avg(error))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum, the last one closed; a constant column gets half a unit to
    either side.  Returns bin (from 0), low, high, n; empty bins are there with 0."""
    v = df.select(X.finite(F.col(column)).alias("v")).where("v is not null")
    span = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counted = v.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # span is one row
    frame = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    width = (F.col("b") - F.col("a")) / bins
    return frame.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def paired_advantage(errors: DataFrame, subject: str, reference: str, models: list[str], least: float = 0.0) -> DataFrame:
    """For each model: mean of reference error - model error over subjects, and the share of subjects where that exceeds
    ``least``."""
    rows = errors.select(subject, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(reference) - F.col(m)).alias("d")) for m in models])).alias("r")).select(subject, "r.*")
    return rows.where("d is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("d").alias("mean_advantage"), F.avg((F.col("d") > least).cast("double")).alias("improved_fraction"))


def first_appearance(df: DataFrame, group: str, place: Column, out: str = "first") -> DataFrame:
    """The least ``place`` of each group, by which groups come in the order in which they first appear."""
    return df.groupBy(group).agg(F.min(place).alias(out))


def flow_counts(df: DataFrame, unit: str, parts: dict[str, Column], totals: dict[str, Callable[[], Column]]) -> DataFrame:
    """One row of a flow table: ``parts`` are aggregates for each ``unit``, ``totals`` aggregates over the units.  The parts
    are summed before they are shuffled, the totals come from one conditional aggregate."""
    each = df.groupBy(unit).agg(*[c.alias(n) for n, c in parts.items()])
    return each.agg(*[make().alias(n) for n, make in totals.items()])
