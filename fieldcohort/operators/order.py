"""Exact order statistics of groups of any size, by refining runs of values.

Every finite double has a place among all doubles, a whole number whose leading bits name the run of values it lies in.
Rows are counted by run, a bounded table; the counts say in which run a wanted rank lies, and only the rows of that run are
counted again, by the next bits.  After four rounds of BITS a run is one value; a run that holds one distinct value is done before.
No group is sorted, gathered or sampled: what leaves an executor are counters, and what reaches the driver is a row for each
wanted rank.

Groups may overlap: rows are counted by *cell*, and a *set* is any union of cells.  The training rows of a nested
validation, all rows outside two folds, are such sets; each row is still counted once a round.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from fieldcohort.functions import expr as X

#: Bits of a place that one round looks at.
BITS = 16
#: Cells and ranks that an operation may have: each is a row on the driver.
CELLS, RANKS = 200_000, 1_000_000


def _power(value: Column) -> Column:
    """The power of two (int) below a finite double, or one next to it: a logarithm may round to the other side of a power."""
    return F.greatest(F.least(F.floor(F.log2(F.abs(value))), F.lit(1023)), F.lit(-1022)).cast("int")


def _place(value: Column, power: Column, unit: Column) -> Column:
    """The place of a finite double, from ``_power`` of it and two to that power."""
    size = F.abs(value)
    up, down = (size / 2 >= unit) & (power < 1023), (size < unit) & (power > -1022)
    power = power + F.when(up, 1).when(down, -1).otherwise(0)
    share = size / unit * F.when(up, 0.5).when(down, 2.0).otherwise(1.0)
    return F.signum(value).cast("long") * ((power + 1022).cast("long") * F.lit(1 << 52) + (share * F.lit(float(1 << 52))).cast("long"))


def place_of(value: Column) -> Column:
    """The place (long) of a finite double: larger values have larger places, equal ones equal places, both zeros 0.

    Positive doubles have the whole number that their bits spell, from their power of two and their fraction, whose
    scaling by powers of two is exact; negative ones mirror them."""
    return _place(value, _power(value), F.pow(F.lit(2.0), _power(value)))


def placed(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``, the place of a finite ``value`` (no NULLs), in steps that are columns, so that each is computed once a row.

    The place is never NULL for Spark: a test for NULL would be moved to before the steps, and would repeat them all."""
    steps = rows.withColumn("__power", _power(F.col(value))).withColumn("__unit", F.pow(F.lit(2.0), F.col("__power")))
    return steps.withColumn(out, F.coalesce(_place(F.col(value), F.col("__power"), F.col("__unit")), F.lit(0).cast("long"))).drop("__power", "__unit")


def value_of(place: int) -> float:
    """The double at a place."""
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(place)))[0], place) if place else 0.0


def order_statistics(
    df: DataFrame, value: str, cells: list[str], sets: Callable[[tuple], Iterable], ranks: Callable[[int], Iterable[int]], spread: Callable[[DataFrame], DataFrame] | None = None, bits: int = BITS
) -> tuple[dict, dict]:
    """Sizes of sets, and the values at wanted ranks of them.

    ``cells`` are columns; ``sets`` tells from a cell's values the (hashable) keys of the sets it is part of; ``ranks`` tells
    from a set's size the ranks wanted, from 0.  Rows whose ``value`` is NULL or not finite do not count; NULLs in cells are a
    value.  Returns {set: size} and {(set, rank): value}; sets without values are in neither.

    Where a row counts in many cells, ``spread`` makes a row for each of them, with the columns ``cells``, and keeps what
    else there is; it is given only the rows that a round still looks at.  Fewer ``bits`` mean more rounds with fewer runs.
    """
    spark = df.sparkSession
    names = [f"__c{k}" for k in range(len(cells))]
    spread = spread or (lambda rows: rows)
    rows = df.withColumn("__w", X.finite(F.col(value))).where("__w is not null")
    rows = placed(rows, "__w", "__q")
    celled = lambda rows, *more: spread(rows).select(*[F.col(c).alias(n) for c, n in zip(cells, names, strict=True)], *more)
    found = celled(rows).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).limit(CELLS + 1).collect()
    if len(found) > CELLS:
        raise ValueError(f"over {CELLS} cells; fewer groups, or window functions where groups are small")
    numbers: dict = {}
    members, size = [], {}
    for cell, r in enumerate(found):
        for key in sets(tuple(r)[:-1]):
            members.append((cell, numbers.setdefault(key, len(numbers))))
            size[key] = size.get(key, 0) + r["n"]
    wanted = [(numbers[key], rank, 0, rank) for key, n in size.items() for rank in sorted(set(ranks(n)))]  # set, rank, run, rank in it
    if len(wanted) > RANKS:
        raise ValueError(f"over {RANKS} ranks")
    if not wanted:
        return size, {}
    keys = {k: key for key, k in numbers.items()}
    table = None
    if names:
        types = celled(rows).schema
        table = spark.createDataFrame([(k, *tuple(r)[:-1]) for k, r in enumerate(found)], StructType([StructField("__cell", LongType()), *[StructField(f"__t{n}", types[n].dataType) for n in names]]))

    def numbered(rows: DataFrame) -> DataFrame:
        placed = celled(rows, F.col("__q").alias("__p"))
        if table is None:
            return placed.select(F.lit(0).cast("long").alias("__cell"), "__p")
        return placed.join(F.broadcast(table), [F.col(n).eqNullSafe(F.col(f"__t{n}")) for n in names]).select("__cell", "__p")  # CELLS rows at most

    parts = F.broadcast(spark.createDataFrame(members, "__cell long, __set long"))
    got: dict = {}
    shift = before = 64
    while shift:
        shift, before = max(shift - bits, 0), shift
        left = rows
        if before < 64:
            # a row for each run; an inner join stays above the steps of a place, where a semi-join would be moved below them
            runs = spark.createDataFrame(sorted({(w[2],) for w in wanted}), "__only long")
            left = rows.join(F.broadcast(runs), F.shiftright("__q", before) == F.col("__only")).drop("__only")
        outer = F.lit(0).cast("long") if before == 64 else F.shiftright("__p", before)
        inside = numbered(left).select("__cell", "__p", outer.alias("__outer"), F.shiftright("__p", shift).alias("__run"))
        counts = inside.groupBy("__cell", "__outer", "__run").agg(F.count(F.lit(1)).alias("n"), F.min("__p").alias("low"), F.max("__p").alias("high"))
        of_sets = counts.join(parts, "__cell").groupBy("__set", "__outer", "__run").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # the runs of one run, 2^bits at most, in their order
        ladder = of_sets.groupBy("__set", "__outer").agg(F.array_sort(F.collect_list(F.struct("__run", "n", "low", "high"))).alias("runs"))
        asked = F.broadcast(spark.createDataFrame(wanted, "__set long, rank long, __outer long, left long"))
        # walk the runs until the rank lies within one
        step = F.aggregate(
            "runs",
            F.struct(F.col("left").alias("left"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")),
            lambda a, x: F.when(a["run"].isNotNull(), a)
            .when(a["left"] < x["n"], F.struct(a["left"].alias("left"), x["__run"].alias("run"), x["low"].alias("low"), x["high"].alias("high")))
            .otherwise(F.struct((a["left"] - x["n"]).alias("left"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))),
        )
        wanted_next = []
        for r in ladder.join(asked, ["__set", "__outer"]).select("__set", "rank", step.alias("s")).collect():  # a row for each rank
            if r["s"]["low"] == r["s"]["high"]:
                got[keys[r["__set"]], r["rank"]] = value_of(r["s"]["low"])
            else:
                wanted_next.append((r["__set"], r["rank"], r["s"]["run"], r["s"]["left"]))
        wanted = wanted_next
        if not wanted:
            break
    return size, got


def around(n: int, prob: float) -> tuple[int, int, float]:
    """The two ranks between which a quantile lies, and how far from the first (linear interpolation)."""
    at = (n - 1) * prob
    low = min(int(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def interpolated(got: dict, key, n: int, prob: float) -> float:
    low, high, share = around(n, prob)
    a, b = got[key, low], got[key, high]
    return a if a == b or not share else a + (b - a) * share


def quantiles(df: DataFrame, value: str, groups: list[str], probs: list[float]) -> DataFrame:
    """The exact quantiles (linear interpolation) of the finite values of each group: groups, n, prob, quantile.

    For groups of any size, of which there are CELLS at most.  NULL in a group column is a group; groups without values
    give no rows; an empty table gives none."""
    ranks = lambda n: [k for p in probs for k in around(n, p)[:2]]
    size, got = order_statistics(df, value, groups, lambda cell: [cell], ranks)
    schema = StructType([*[StructField(g, df.schema[g].dataType) for g in groups], StructField("n", LongType()), StructField("prob", DoubleType()), StructField("quantile", DoubleType())])
    return df.sparkSession.createDataFrame([(*key, n, float(p), interpolated(got, key, n, p)) for key, n in size.items() for p in probs], schema)
