"""Job: public tables of a cohort, by site, in which no participant can be found.

Analyses publish aggregates, never rows of participants.  This job joins participants, visits and measurements, applies the
quality limits, and writes for each site the flow of participants, summaries of each descriptor, histograms and rank
correlations with the outcome.  Sites with fewer participants than ``minimum_cell`` are withheld; histogram counts below it
are hidden, and where a histogram would hide a single count, the next smallest is hidden with it, so that totals do not give
it away.  Extremes are no part of the summaries, and histograms run from the 5th to the 95th percentile, with a count below and above.

    python -m jobs.release_tables --data DIR --output DIR --work DIR [--config FILE]

``data`` holds customer (participants), nation and region (sites), orders (visits) and lineitem (measurements) as Parquet.
``work`` gets the participants' table, which stays private; ``output`` is written anew by each run, partitioned by table and
site, so that a site which falls below the limit leaves nothing behind.  Same input, same output.  Paths may be remote.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.operators import contracts as C
from fieldcohort.operators import order, stats
from fieldcohort.session import get_session, table
from fieldcohort.sources import tables

LOG = logging.getLogger("jobs.release_tables")
CONFIG = Path(__file__).with_suffix(".toml")
RELEASE = "descriptor string, item string, value double, n long, table string, site string"
#: Percentiles of the summaries; the first and the last are the ends of the histograms.
PROBS = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


@dataclass(frozen=True)
class Settings:
    """What the settings file may change."""

    minimum_visits: int = 3
    minimum_cell: int = 20
    bins: int = 20
    descriptors: tuple[str, ...] = ("visits", "mean_price", "span_days", "returned_share", "mean_quantity")


def load_settings(path: str | Path | None = None) -> Settings:
    config = dict(tables.load_config(path or CONFIG).get("release", {}))
    unknown = set(config) - set(Settings.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "descriptors" in config:
        config["descriptors"] = tuple(config["descriptors"])
    return Settings(**config)


def participants(spark: SparkSession, data: str) -> DataFrame:
    """A row for each participant: key, site, outcome, items measured and the descriptors, recorded to six digits.

    Measurements are summed by visit and visits by participant before anything is joined to the participants."""
    customer = C.require_unique(table(spark, data, "customer"), "c_custkey", "participants")
    sites = table(spark, data, "nation").join(table(spark, data, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("site"))
    lines = table(spark, data, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    visits = table(spark, data, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = visits.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("visits"),
        F.avg("o_totalprice").alias("mean_price"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span_days"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.try_divide(F.sum("returned"), F.sum("items")).alias("returned_share"),
        F.try_divide(F.sum("quantity"), F.sum("items")).alias("mean_quantity"),
    )
    joined = customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(sites, "c_nationkey", "left")
    six = lambda c: X.rounded(X.finite(F.col(c))).alias(c)
    return joined.select(F.col("c_custkey").alias("key"), F.coalesce("site", F.lit("(none)")).alias("site"), X.finite(F.col("c_acctbal")).alias("outcome"), F.coalesce("items", F.lit(0)).alias("items"), *[six(c) for c in Settings.descriptors])


def flow(people: DataFrame, settings: Settings) -> DataFrame:
    """Participants of each site after each limit: site, all, visited, measured, complete."""
    visited = F.coalesce(F.col("visits") >= settings.minimum_visits, F.lit(False))
    measured = visited & (F.col("items") > 0)
    return people.groupBy("site").agg(F.count(F.lit(1)).alias("all"), F.count_if(visited).alias("visited"), F.count_if(measured).alias("measured"), F.count_if(measured & F.col("outcome").isNotNull()).alias("complete"))


def hidden(cells: DataFrame, groups: list[str], n: str, least: int, order_by: list[str]) -> DataFrame:
    """Counts below ``least`` as NULL, zeros too; where that hides one count of a group alone, the next smallest as well."""
    small = F.col(n) < least
    alone = F.sum(small.cast("int")).over(Window.partitionBy(*groups)) == 1
    # the smallest of the others, the first of equals
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(small, n, *order_by))
    return cells.withColumns({"__hide": small | (alone & (place == 1) & ~small)}).withColumn(n, F.when(~F.col("__hide"), F.col(n))).drop("__hide")


def histograms(long: DataFrame, ends: DataFrame, settings: Settings) -> DataFrame:
    """Counts by bin between the ends (descriptor, site, low, high), with bins -1 and ``bins`` for what lies outside."""
    keys, bins = ["site", "descriptor"], settings.bins
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), bins).when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    # a row for each site and descriptor
    counted = long.join(F.broadcast(ends), keys).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select(*keys, (F.col("low")).alias("low"), width.alias("width"), F.explode(F.sequence(F.lit(-1), F.lit(bins))).alias("bin"))
    cells = frame.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = hidden(cells, keys, "n", settings.minimum_cell, ["bin"])
    edge = F.when(F.col("bin") >= 0, X.rounded(F.col("low") + F.col("bin") * F.col("width")))
    return cells.select("site", "descriptor", F.col("bin").cast("string").alias("item"), edge.alias("value"), "n", F.lit("histogram").alias("table"))


def release(people: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The public tables of a participants' table: descriptor, item, value, n, table, site."""
    steps = flow(people, settings)
    withheld = F.col("complete") < settings.minimum_cell
    open_sites = steps.where(~withheld).select("site")
    # a row for each site; by Spark's estimate, from the files' bytes, a large table would be shuffled by site, a task for each
    good = people.where((F.col("visits") >= settings.minimum_visits) & (F.col("items") > 0) & F.col("outcome").isNotNull()).join(F.broadcast(open_sites), "site", "left_semi")
    long = good.unpivot(["site", "key", "outcome"], [F.col(d).cast("double").alias(d) for d in settings.descriptors], "descriptor", "v").where("v is not null")
    keys, blank = ["site", "descriptor"], F.lit(None)
    names = ["all", "visited", "measured", "complete"]
    shown = steps.where(~withheld).unpivot(["site"], names, "item", "n").select("site", blank.cast("string").alias("descriptor"), "item", blank.cast("double").alias("value"), "n", F.lit("flow").alias("table"))
    closed = steps.where(withheld).select("site", blank.cast("string").alias("descriptor"), F.lit("withheld").alias("item"), blank.cast("double").alias("value"), blank.cast("long").alias("n"), F.lit("flow").alias("table"))
    moments = long.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n")).unpivot([*keys, "n"], ["mean", "sd"], "item", "value")
    points = order.quantiles(long, "v", keys, list(PROBS.values()))
    labels = F.create_map(*[F.lit(x) for name, p in PROBS.items() for x in (p, name)])
    quantiles = points.select(*keys, "n", labels[F.col("prob")].alias("item"), F.col("quantile").alias("value"))
    summary = moments.unionByName(quantiles).select("site", "descriptor", "item", X.rounded(F.col("value")).alias("value"), "n", F.lit("summary").alias("table"))
    ends = points.groupBy(*keys).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    rho = stats.spearman(long, "v", "outcome", keys).select("site", "descriptor", F.lit("spearman").alias("item"), X.rounded(F.col("rho")).alias("value"), "n", F.lit("association").alias("table"))
    out = shown
    for part in (closed, summary, histograms(long, ends, settings), rho):
        out = out.unionByName(part)
    return out.select("descriptor", "item", "value", "n", "table", "site")


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(RELEASE).parquet(output)


def run(spark: SparkSession, data: str, output: str, work: str, settings: Settings = Settings()) -> dict[str, int]:
    """Write the participants' table to ``work`` and the public tables to ``output``."""
    unknown = set(settings.descriptors) - set(Settings.descriptors)
    if unknown or not settings.descriptors or settings.minimum_cell < 2:
        raise ValueError(f"bad settings: {settings}")
    LOG.info("reading customer, nation, region, orders and lineitem below %s", data)
    # read by every table of the release: written once
    participants(spark, data).write.mode("overwrite").parquet(work)
    people = spark.read.parquet(work)
    n = people.count()
    LOG.info("wrote %d participants to %s", n, work)
    # few rows, a file for each table and site
    release(people, settings).repartition("table", "site").write.mode("overwrite").partitionBy("table", "site").parquet(output)
    rows = read_output(spark, output).count()
    LOG.info("wrote %d public rows to %s", rows, output)
    return {"participants": n, "rows": rows}


def _sql(settings: Settings = Settings()) -> str:
    k, bins, d = settings.minimum_cell, settings.bins, settings.descriptors
    six = lambda x: f"round({x}, 6) + 0.0"
    return f"""
WITH l AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
v AS (
  SELECT o_custkey, count(*) AS visits, avg(o_totalprice) AS mean_price, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS span_days,
    coalesce(sum(items), 0) AS items, sum(returned) / sum(items) AS returned_share, sum(quantity) / sum(items) AS mean_quantity
  FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1),
p AS (
  SELECT c_custkey AS key, coalesce(r_name, '(none)') AS site, c_acctbal AS outcome, coalesce(items, 0) AS items, {", ".join(f"{six(f'{c}::DOUBLE')} AS {c}" for c in Settings.descriptors)}
  FROM customer LEFT JOIN v ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
s AS (
  SELECT site, count(*) AS "all", count(*) FILTER (visits >= {settings.minimum_visits}) AS visited, count(*) FILTER (visits >= {settings.minimum_visits} AND items > 0) AS measured,
    count(*) FILTER (visits >= {settings.minimum_visits} AND items > 0 AND outcome IS NOT NULL) AS complete FROM p GROUP BY 1),
g AS (SELECT p.* FROM p JOIN s USING (site) WHERE complete >= {k} AND visits >= {settings.minimum_visits} AND items > 0 AND outcome IS NOT NULL),
x AS ({" UNION ALL ".join(f"SELECT site, outcome, '{c}' AS descriptor, {c} AS v FROM g WHERE {c} IS NOT NULL" for c in d)}),
q AS (SELECT site, descriptor, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, {", ".join(f"quantile_cont(v, {p}) AS {name}" for name, p in PROBS.items())} FROM x GROUP BY 1, 2),
b AS (
  SELECT x.site, x.descriptor, CASE WHEN v < p05 THEN -1 WHEN v > p95 THEN {bins} WHEN p95 > p05 THEN least(floor((v - p05) / (p95 - p05) * {bins}), {bins - 1}) ELSE 0 END::INT AS bin, count(*) AS n
  FROM x JOIN q ON x.site = q.site AND x.descriptor = q.descriptor GROUP BY 1, 2, 3),
h AS (SELECT q.site, q.descriptor, u.bin, p05, p95, coalesce(b.n, 0) AS n FROM q CROSS JOIN (SELECT unnest(range(-1, {bins + 1}))::INT AS bin) u LEFT JOIN b ON b.site = q.site AND b.descriptor = q.descriptor AND b.bin = u.bin),
w AS (SELECT *, n < {k} AS small, count(*) FILTER (n < {k}) OVER (PARTITION BY site, descriptor) AS m, row_number() OVER (PARTITION BY site, descriptor ORDER BY n < {k}, n, bin) AS place FROM h),
r AS (
  SELECT site, descriptor, rank() OVER (PARTITION BY site, descriptor ORDER BY v) + (count(*) OVER (PARTITION BY site, descriptor, v) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY site, descriptor ORDER BY outcome) + (count(*) OVER (PARTITION BY site, descriptor, outcome) - 1) / 2.0 AS o FROM x)
SELECT NULL::VARCHAR AS descriptor, item, NULL::DOUBLE AS value, n, 'flow' AS "table", site FROM (UNPIVOT (SELECT * FROM s WHERE complete >= {k}) ON "all", visited, measured, complete INTO NAME item VALUE n)
UNION ALL SELECT NULL, 'withheld', NULL, NULL, 'flow', site FROM s WHERE complete < {k}
UNION ALL SELECT descriptor, item, {six('value')}, n, 'summary', site FROM (UNPIVOT q ON mean, sd, {", ".join(PROBS)} INTO NAME item VALUE value)
UNION ALL SELECT descriptor, bin::VARCHAR, CASE WHEN bin >= 0 THEN {six(f'p05 + bin * ((p95 - p05) / {bins})')} END, CASE WHEN NOT (small OR (m = 1 AND place = 1)) THEN n END, 'histogram', site FROM w
UNION ALL SELECT descriptor, 'spearman', {six('corr(a, o)')}, count(*), 'association', site FROM r GROUP BY site, descriptor
"""  # fmt: skip


#: DuckDB text of the output with the default settings.
SQL = _sql()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.release_tables", description=__doc__.split("\n")[0])
    parser.add_argument("--data", required=True, help="folder with customer, nation, region, orders and lineitem as Parquet")
    parser.add_argument("--output", required=True)
    parser.add_argument("--work", required=True, help="private folder for the participants' table")
    parser.add_argument("--config", default=None, help=f"settings, {CONFIG.name} beside the job by default")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("release-tables")
    try:
        run(spark, given.data, given.output, given.work, load_settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
