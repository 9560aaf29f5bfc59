"""Views of the supplied tables that stand for cohort inputs, as DataFrames and as DuckDB text.

Volumes: an embedding of 64 numbers is a 4 x 4 x 4 volume in C order; three consecutive ones are a vector field of case
vec_id div 3.  Tables: customers are a manifest, their orders a clinical table, line items long facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcohort.operators import voxel as V
from fieldcohort.session import staged, table

SIZE, SHAPE = 4, (4, 4, 4)
LESION = 0.1


def vox(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, x, y, z, value): every embedding as a scalar volume."""
    return V.explode_volume(table(spark, d, "embeddings"), "vec_id", "embedding", SHAPE)


def vfield(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, x, y, z, u0, u1, u2) of complete triples."""
    rows = vox(spark, d).withColumn("comp", F.col("case_id") % 3).withColumn("case_id", F.expr("case_id div 3"))
    pick = [F.max(F.when(F.col("comp") == k, F.col("value"))).alias(f"u{k}") for k in range(3)]
    return rows.groupBy("case_id", "x", "y", "z").agg(*pick, F.count(F.lit(1)).alias("n")).where("n = 3").drop("n")


def lesion(field: DataFrame) -> DataFrame:
    """Voxels of a field whose first component exceeds a limit."""
    return field.where(F.col("u0") > LESION).select("case_id", "x", "y", "z")


def sided(spark: SparkSession, d: str) -> DataFrame:
    """The field with target (lesion voxels), valid (third component above -0.3) and the lesion's side."""
    f = vfield(spark, d)
    side = V.laterality(lesion(f), SIZE).select("case_id", "side")
    return f.join(side, "case_id", "left").withColumns({"target": F.col("u0") > LESION, "valid": F.col("u2") > -0.3, "side": F.coalesce("side", F.lit("bilateral"))})


def staged_field(spark: SparkSession, d: str) -> DataFrame:
    """The field with side and Jacobian, dealt by case and staged, since effect, distance and lesion each read it."""
    return staged(V.jacobian(sided(spark, d)).repartition("case_id"), "field")


def effect_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lesion effect of every voxel with distance, radial part and magnitude."""
    f = staged_field(spark, d)
    e = V.effect(f, SIZE)
    grid = V.lesion_distance(f.select("case_id", "x", "y", "z"), lesion(f))
    both = V.normals(grid).join(e, ["case_id", "x", "y", "z"])
    return both.select("case_id", "x", "y", "z", "distance", "effect_valid", "logj", *V.radial_magnitude(["e0", "e1", "e2"], ["n0", "n1", "n2"], F.col("effect_valid")))


#: DuckDB text of the views above, each built on those before it.
SQL = {
    "vox": "SELECT vec_id AS case_id, (p - 1) // 16 AS x, ((p - 1) // 4) % 4 AS y, (p - 1) % 4 AS z, embedding[p]::DOUBLE AS value FROM embeddings, unnest(range(1, 65)) u(p)",
    "vfield": "SELECT case_id // 3 AS case_id, x, y, z, max(CASE WHEN case_id % 3 = 0 THEN value END) AS u0, max(CASE WHEN case_id % 3 = 1 THEN value END) AS u1, max(CASE WHEN case_id % 3 = 2 THEN value END) AS u2 FROM vox GROUP BY 1, 2, 3, 4 HAVING count(*) = 3",
    "lesion": "SELECT case_id, x, y, z FROM vfield WHERE u0 > 0.1",
    "lat": "SELECT case_id, count(*) FILTER (WHERE x < 1.5) AS l, count(*) FILTER (WHERE x > 1.5) AS r FROM lesion GROUP BY 1",
    "side": "SELECT case_id, CASE WHEN l > r THEN 'left' WHEN r > l THEN 'right' ELSE 'bilateral' END AS side FROM lat",
    "sided": "SELECT f.*, u0 > 0.1 AS target, u2 > -0.3 AS valid, coalesce(s.side, 'bilateral') AS side FROM vfield f LEFT JOIN side s USING (case_id)",
}


def _gradient(value: str, axis: str) -> str:
    across = ", ".join(a for a in "xyz" if a != axis)
    w = f"OVER (PARTITION BY case_id, {across} ORDER BY {axis})"
    b, a = f"lag({value}) {w}", f"lead({value}) {w}"
    return f"CASE WHEN {b} IS NOT NULL AND {a} IS NOT NULL THEN ({a} - {b}) / 2 WHEN {a} IS NOT NULL THEN {a} - {value} ELSE {value} - {b} END"


SQL["grads"] = "SELECT *, " + ", ".join(f"{_gradient(f'u{k}', a)} AS g{k}{a}" for k in range(3) for a in "xyz") + " FROM sided"
SQL["jac"] = (
    "SELECT case_id, x, y, z, u0, u1, u2, target, valid, side, (1 + g0x) * ((1 + g1y) * (1 + g2z) - g1z * g2y) - g0y * (g1x * (1 + g2z) - g1z * g2x) + g0z * (g1x * g2y - (1 + g1y) * g2x) AS jac FROM grads"
)
SQL["effect0"] = (
    "SELECT a.*, -b.u0 AS m0, b.u1 AS m1, b.u2 AS m2, b.jac AS mj, a.valid AND b.valid AND NOT a.target AND NOT b.target AND a.jac > 0 AND b.jac > 0 "
    "AND ((a.side = 'left' AND a.x < 1.5) OR (a.side = 'right' AND a.x > 1.5)) AS ev FROM jac a JOIN jac b ON a.case_id = b.case_id AND a.x = 3 - b.x AND a.y = b.y AND a.z = b.z"
)
SQL["effect"] = "SELECT case_id, x, y, z, ev, CASE WHEN ev THEN u0 - m0 ELSE 0 END AS e0, CASE WHEN ev THEN u1 - m1 ELSE 0 END AS e1, CASE WHEN ev THEN u2 - m2 ELSE 0 END AS e2, CASE WHEN ev THEN ln(jac) - ln(mj) ELSE 0 END AS logj FROM effect0"
SQL["dist"] = "SELECT f.case_id, f.x, f.y, f.z, min(sqrt((f.x - l.x) ** 2 + (f.y - l.y) ** 2 + (f.z - l.z) ** 2)) AS distance FROM vfield f LEFT JOIN lesion l USING (case_id) GROUP BY 1, 2, 3, 4"
SQL["dgrad"] = "SELECT *, " + ", ".join(f"coalesce({_gradient('distance', a)}, 0) AS d{a}" for a in "xyz") + " FROM dist"
SQL["norm"] = "SELECT case_id, x, y, z, distance, " + ", ".join(f"CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) > 1e-6 THEN d{a} / sqrt(dx * dx + dy * dy + dz * dz) ELSE 0 END AS n{k}" for k, a in enumerate("xyz")) + " FROM dgrad"
SQL["rows"] = "SELECT e.case_id, x, y, z, distance, ev, logj, CASE WHEN ev THEN e0 * n0 + e1 * n1 + e2 * n2 ELSE 0 END AS radial, CASE WHEN ev THEN sqrt(e0 * e0 + e1 * e1 + e2 * e2) ELSE 0 END AS magnitude FROM effect e JOIN norm USING (case_id, x, y, z)"
SQL["manifest"] = "SELECT c_custkey AS case_id, c_custkey AS subject, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS bal, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS laterality_supported, abs(c_acctbal) / 200000.0 AS normalized_field_folding_fraction, c_custkey % 4000 AS n_voxels, CASE c_nationkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'bilateral' END AS lesion_side FROM customer"
SQL["clinical"] = "SELECT o_custkey AS case_id, avg(o_totalprice) AS outcome, count(*) AS n_orders, min(o_totalprice) AS low FROM orders GROUP BY 1"
SQL["pred_long"] = (
    "SELECT o_orderkey, c_custkey AS subject, o_orderkey % 4 + 1 AS repeat, m.model, o_totalprice AS observed, CASE m.model WHEN 'segment' THEN avg(o_totalprice) OVER (PARTITION BY c_mktsegment, m.model) WHEN 'nation' THEN avg(o_totalprice) OVER (PARTITION BY c_nationkey, m.model) "
    "ELSE avg(o_totalprice) OVER (PARTITION BY m.model) END AS predicted FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('segment'), ('nation'), ('global')) m(model)"
)
SQL["metrics_long"] = "SELECT l_linenumber AS repeat, l_returnflag AS model, l_extendedprice / l_quantity AS mae, l_discount AS r2 FROM lineitem"


def sql(*names: str) -> str:
    """A WITH clause of the named views and all that they are built on."""
    order, out = list(SQL), set()

    def need(n: str) -> None:
        if n in out:
            return
        out.add(n)
        import re

        for word in re.findall(r"(?:FROM|JOIN)\s+(\w+)", SQL[n]):
            if word in SQL:
                need(word)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order if n in out) + " "


def manifest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    nation = F.col("c_nationkey") % 3
    return c.select(
        F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"),
        F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("laterality_supported"), (F.abs("c_acctbal") / 200000.0).alias("normalized_field_folding_fraction"),
        (F.col("c_custkey") % 4000).alias("n_voxels"), F.when(nation == 0, "left").when(nation == 1, "right").otherwise("bilateral").alias("lesion_side"),
    )


def clinical(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.avg("o_totalprice").alias("outcome"), F.count(F.lit(1)).alias("n_orders"), F.min("o_totalprice").alias("low"))


def pred_long(spark: SparkSession, d: str) -> DataFrame:
    """(subject, repeat, model, observed, predicted): three predictors, each a mean of a grouping."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.select("o_orderkey", F.col("c_custkey").alias("subject"), (F.col("o_orderkey") % 4 + 1).alias("repeat"), F.col("o_totalprice").alias("observed"), "c_mktsegment", "c_nationkey")
    # sums by both groups, a small table, give all three means and are joined back; a window over the whole table would be one task
    cells = j.groupBy("c_mktsegment", "c_nationkey").agg(F.sum("observed").alias("s"), F.count("observed").alias("n"))
    mean = lambda *by: F.sum("s").over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by))
    means = cells.select("c_mktsegment", "c_nationkey", mean("c_mktsegment").alias("p_segment"), mean("c_nationkey").alias("p_nation"), mean().alias("p_global"))
    wide = j.join(F.broadcast(means), ["c_mktsegment", "c_nationkey"])  # a row a segment and nation
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("predicted")) for m in ("segment", "nation", "global")])
    return wide.select("o_orderkey", "subject", "repeat", "observed", F.explode(models).alias("m")).select("o_orderkey", "subject", "repeat", "m.model", "observed", "m.predicted")


def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("repeat"), F.col("l_returnflag").alias("model"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mae"), F.col("l_discount").alias("r2"))
