"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm.common import EASY, HOT, passing, staged


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The smallest id reachable from each id of ``edges`` (a long, b long): (id, label).

    ``before``: (id, label) of earlier edges; then ``edges`` are taken between labels, and ids of both come back.

    Every round takes the smallest label of the neighbours, then the label of that label, until nothing changes: stars
    need one round, chains about the logarithm of their length.  Beyond EASY rows, nodes and labels that more
    than one in HOT rows lead to (HOT of each at most) are joined by a broadcast, the others by shuffling; a minimum is
    taken before each shuffle.  Each
    round is staged in the shared folder; these tables are removed at the end.  No edges: no rows; edges with a null id are left
    out; repeated edges and edges from an id to itself change nothing.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null")
    with passing(spark):
        if before is not None:
            left = before.select(F.col("id").alias("a"), F.col("label").alias("la"))
            right = before.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            edges = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        edges = edges.where(F.col("a") != F.col("b"))
        both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        rows = both.count()
        divide = rows > EASY
        busy = staged(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > rows).select("b"), "busy") if divide else None
        labels = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label"))
        while True:
            with passing(spark):
                moved = staged(_round(both, busy, labels), "labels", keep=True)
            labels = moved.select("id", "label")
            if moved.where("label <> was").isEmpty():
                break
        if before is None:
            return staged(labels, "labels", keep=True)
        known = before.select("id", F.col("label").alias("id0"))
        step = labels.select(F.col("id").alias("id0"), "label")
        old = known.join(step, "id0", "left").select("id", F.coalesce("label", "id0").alias("label"))
        new = labels.join(before.select("id"), "id", "left_anti")
        return staged(old.unionByName(new), "labels", keep=True)


def _round(both: DataFrame, busy: DataFrame | None, labels: DataFrame) -> DataFrame:
    """(id, was, label): each id's label, and the smallest that its neighbours, and the label's own label, offer; ``busy``:
    ends with very many edges, where these are to be joined apart."""
    of = labels.select(F.col("id").alias("b"), "label")
    jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
    if busy is None:
        offered = both.join(of, "b")
    else:
        ends = F.broadcast(busy)
        offered = both.join(F.broadcast(of.join(ends, "b")), "b").unionByName(both.join(ends, "b", "left_anti").join(of, "b"))
    near = offered.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    less = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
    if busy is None:
        further = less.join(jump, "label", "left")
    else:
        less = staged(less, "nearer")
        common = F.broadcast(less.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > less.count()).select("label"))
        hot = less.join(common, "label").join(F.broadcast(jump.join(common, "label")), "label", "left")
        further = hot.unionByName(less.join(common, "label", "left_anti").join(jump, "label", "left"))
    return further.select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
