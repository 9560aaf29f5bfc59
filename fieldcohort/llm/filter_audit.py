"""How text filters interact: what each removes, in every order of them.

Five filters read whole texts; a document's failures are a mask of five bits.  Four look at the text alone, the fifth at
all other documents: a text that a smaller doc_id has as well.  Those duplicates are found by sorting: rows are dealt to
ranges of (fingerprint, doc_id) and sorted by fingerprint, full text and doc_id; then each row is compared with the one
before it.  A range knows nothing of the row before its first one, so it leaves a boundary record (the texts at its two
ends, and the first doc_id of its last text), and rows of its first text wait for the merge of these records.

Masks are additive: everything that the audit says of any order follows from how many documents of a part have each mask,
so ranges are counted where they are, and only 32 counters a part meet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm.common import BROADCAST_IDS, slices, staged, within

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: What the sorted pass hands on: rows of documents, and one boundary record for each range.
ROW = "range int, doc_id long, part string, mask int, waits boolean, first binary, last binary, least long, whole boolean"


def text_mask(text: str) -> int:
    """The failures of one text, but for duplicates: A too few words, B too few distinct ones, C too many capitals,
    D any of MARKS.  Words are maximal runs of bytes other than ASCII blanks, compared as they are."""
    raw = text.encode()
    words = raw.split()
    return (
        (len(words) < WORDS)
        | (100 * len(set(words)) < DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > CAPITALS * len(text)) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """The mask of every row of ``docs`` (doc_id, text, lang): doc_id, part (lang, null as the empty string), mask.

    A null text is an empty one, and equal to it.  A row fails E if any smaller doc_id has its text; rows that share an id
    do not make each other duplicates, and a null doc_id is neither smaller nor greater than another.  Copies are spread
    over ranges by doc_id and place, however many they are.  Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("print"), F.monotonically_increasing_id().alias("place"))
    by_id = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    # full texts are no range keys: Spark samples these keys into the driver
    ordered = rows.repartitionByRange("print", *by_id).sortWithinPartitions("print", "text", *by_id).drop("place")
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, first, last, before, least, groups, mask = TaskContext.get().partitionId(), None, None, None, None, 0, 0
        for batch in slices(batches, "text"):
            out = []
            for doc_id, part, text, fingerprint in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text", "print")), strict=True):
                if fingerprint != last or text != before:
                    first, last, before, least, groups = fingerprint if first is None else first, fingerprint, text, doc_id, groups + 1
                    mask = text_mask(text)
                again = DUPLICATE if least is not None and doc_id is not None and least < doc_id else 0
                out.append((here, doc_id, part, mask | again, groups == 1, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if groups:
            edge = (here, None, None, None, None, first, last, least, groups == 1)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(edge, kinds, strict=True)], names=names)

    found = staged(ordered.mapInArrow(run, ROW), "filter-ranges")
    waiting = found.where("mask is not null")
    carried = _carry(found.where("mask is null").select("range", "first", "last", "least", "whole").orderBy("range").collect())  # one row a range
    if not carried:
        return waiting.select("doc_id", "part", "mask")
    carried = docs.sparkSession.createDataFrame(carried, "range int, carried long")
    late = F.when(F.col("waits") & (F.col("carried") < F.col("doc_id")), F.lit(DUPLICATE)).otherwise(0)
    return waiting.join(F.broadcast(carried), "range", "left").select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask"))


def _carry(edges: list) -> list[tuple[int, int]]:
    """For each range whose first text the range before it ends with: the smallest doc_id of that text there or earlier."""
    out, last, least = [], None, None
    for edge in edges:
        goes_on = edge["first"] == last and least is not None
        if goes_on:
            out.append((edge["range"], least))
        # a range of one text hands on what it got
        last, least = edge["last"], least if goes_on and edge["whole"] else edge["least"]
    return out


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: n documents, and how many of them the labels call good (quality 1) and toxic (1).

    Of several labels of an id the greatest counts; labels up to BROADCAST_IDS rows are broadcast, others shuffled."""
    masks = masks.select("doc_id", "part", "mask")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = F.broadcast(known) if within(labels.select("doc_id"), BROADCAST_IDS) else known
    one = lambda c: F.count(F.when(F.col(c) == 1, 1))
    rows = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = masks.join(known, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    return rows.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``counters``; see ``audit``."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [{"filter_order": o, "step": k + 1, "bit": bit[f], "before": sum(bit[x] for x in o[:k])} for o in orders for k, f in enumerate(o)]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    # 32 entries a part at most
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("all"))
    rows = parts.select("part", "all", F.inline(plan))

    def total(value, when):
        return F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["mask"]), value(x)).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    n = lambda x: x["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(n, lambda m: fails(m) & ~gone(m)).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda x: x["good"], lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total(lambda x: x["toxic"], lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        # of the orders of k failed filters, one in k begins with this one
        total(lambda x: (F.lit(len(orders)).cast("long") * x["n"] / F.bit_count(x["mask"])).cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    One row for each part (a lang value, null as the empty string), filter_order (all 120) and step (1 to 5): kept after
    the step, removed by it, redundant (failing its filter, removed before), unique_fails (failing it alone), good_lost and
    toxic_lost (removed by it and labelled so) and shapley, what its filter removes summed over all orders.  An empty
    ``docs`` has no parts and gives no rows; nulls, ties and repeated rows are as in ``failures`` and ``counters``.
    """
    return interactions(counters(failures(docs), labels))
