"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen and Thorup 2017): in round i every shingle is hashed to a bin and a value; an empty bin keeps
the smallest value of the first round that reaches it.  From round t on, all shingles go to bin i - t, so that 2t rounds
fill every coordinate; two sets agree in a coordinate with probability J, and the number of agreements is concentrated
as for independent hashes.  Most texts need two rounds.

Texts with equal shingle sets are one node.  Bands of the sketch give buckets; with BANDS bands of ROWS coordinates a pair
of similarity 0.8 shares a bucket but with probability (1 - 0.8^4)^32 < 5e-8.  Only components matter, so not all pairs of a
bucket are looked at: first each node meets the best connected node of its buckets (its hub).  Where a bucket then still
spans several components, the nodes outside its largest component meet all others that they are not joined to: as pairs
where these are at most PAIRS.  The members of larger buckets meet by their rarest shingles instead (``prefixes``), which
keeps every pair of the wanted similarity and none of most texts that merely share a common line; such a group of more
than PAIRS pairs is compared block by block inside tasks that return links only.  After that every pair that shares a
bucket is in one component or has been verified; no bucket is cut or left out.

Verification: pairs whose sketches agree in under AGREE of their coordinates are dropped (for a pair of similarity 0.8 or more
that has a probability under 2e-9 by Chernoff's bound); the others are compared on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm import hashing
from fieldcohort.llm.common import BROADCAST_IDS, EASY, join_by_key, passing, slices, small_batches, staged, within, without
from fieldcohort.llm.components import components

BANDS, ROWS, WORDS, PERCENT = 32, 4, 5, 80
#: Pairs of a bucket up to which they are formed as rows; shingles and rows of a block where a group has more pairs.
PAIRS, BLOCK, BLOCK_ROWS = 256, 1 << 18, 2048
#: Parts of a group of equal sets.
SALTS = 64
#: Counters by which shingles are ordered from rare to common; a shingle shares its counter with those of its hash.
COUNTERS = 1 << 18
AGREE = 0.55
U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The fast similarity sketch of each set of 64-bit hashes, as rows of ``size`` coordinates; empty sets: all EMPTY."""
    n = len(sets)
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, dtype=U)
    owner = np.repeat(np.arange(n), counts)
    out = np.full(n * size, EMPTY)
    open_bins = np.where(counts > 0, size, 0)
    for r in range(2 * size):
        live = open_bins[owner] > 0
        if not live.all():
            flat, owner = flat[live], owner[live]
        if not len(flat):
            break
        h = hashing.mix(flat ^ hashing.seed(r))
        slot = owner * size + ((h % U(size)).astype(np.int64) if r < size else r - size)
        best = np.full(n * size, EMPTY)
        np.minimum.at(best, slot, h >> U(8))
        fresh = np.flatnonzero((best != EMPTY) & (out == EMPTY))
        out[fresh] = hashing.mix(best[fresh] + (U(r) << U(56)))
        open_bins -= np.bincount(fresh // size, minlength=n)
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each sketch; bands have keys of their own."""
    keys = np.zeros((len(sketch), bands), dtype=U)
    for j in range(rows):
        keys = hashing.mix(keys + sketch[:, j::rows][:, :bands] * (hashing.seed(300 + j) | U(1)))
    return hashing.mix(keys + np.arange(bands, dtype=U) * hashing.seed(400))


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    hashed, owner, *_ = hashing.words(texts)
    return hashing.shingles(hashed, owner, len(texts), words)


def sketch_documents(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, low): the size, identity and band keys of each document's shingle set, and the
    low 16 bits of its sketch's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _sets(batch, words)
            sketch = sketches(sets, bands * rows)
            keys = band_keys(sketch, bands, rows)
            low = (sketch & U(0xFFFF)).astype(np.uint16).view(np.int16)
            sums = np.array([(s.sum(dtype=U), hashing.mix(s).sum(dtype=U)) if len(s) else (U(0), U(0)) for s in sets], dtype=U).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[:, 0].astype(np.int64)),
                    pa.array(sums[:, 1].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), pa.array(keys.astype(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32)), pa.array(low.ravel())),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "low"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, low array<smallint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full shingle set of each document, as sorted longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.astype(np.int64) for s in _sets(batch, words)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def verified(pairs: DataFrame, lows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    near = pairs.join(lows.select(F.col("id").alias("a"), F.col("low").alias("la"), F.col("n").alias("na")), "a").join(lows.select(F.col("id").alias("b"), F.col("low").alias("lb"), F.col("n").alias("nb")), "b")
    agree = F.size(F.filter(F.zip_with("la", "lb", lambda x, y: x == y), lambda x: x))
    near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(agree >= AGREE * F.size("la")).select("a", "b").distinct()
    joined = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return joined.withColumn("both", both).where(F.expr(f"100 * both >= {percent} * (size(sa) + size(sb) - both)")).select("a", "b").distinct()


def _counted(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in ``sets`` (shingles), by counter; COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches, "shingles", 4 << 20):
            seen += np.bincount(_counter(batch.column("shingles").flatten().to_numpy()), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    total = np.zeros(COUNTERS, dtype=np.int64)
    with small_batches(sets.sparkSession):
        rows = sets.select("shingles").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return total


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(U) % U(COUNTERS)).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, id, label, outer, n, small): the rarest shingles of each of ``sets`` (id, label, outer, shingles).

    Shingles are ordered by counter and value.  Of two sets x and y with |y| <= |x| and 100 * |x and y| >= percent * |x or y|,
    at least percent / 100 * |x| of x and, as they share as much as if both had y's size, 2 * percent / (100 + percent) * |y|
    of y are common, so that the first |x| - ceil(percent / 100 * |x|) + 1 shingles of x and the first
    |y| - ceil(2 * percent / (100 + percent) * |y|) + 1 of y have one in common (prefix filtering; Chaudhuri, Ganti and
    Kaushik 2006, Bayardo, Ma and Srikant 2007).  ``small`` marks those of the second kind.  Shingles that no set with
    ``outer`` counts are left out."""

    table = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in slices(batches, "shingles", 4 << 20):
            column = batch.column("shingles")
            n = pc.list_value_length(column).to_numpy().astype(np.int64)
            flat, owner = column.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            common = counts[_counter(flat)]
            order = np.lexsort((flat, common, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            most, few = n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1
            keep = (place < most[owner]) & (common[order] > 0)
            at, place = order[keep], place[keep]
            row = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at]), *[batch.column(c).take(row) for c in ("id", "label", "outer")], pa.array(n[owner[at]]), pa.array(place < few[owner[at]])],
                names=["token", "id", "label", "outer", "n", "small"],
            )

    return sets.select("id", "label", "outer", "shingles").mapInArrow(run, "token long, id long, label long, outer boolean, n long, small boolean")


def _links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of (id, label, shingles) across labels."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return none

    def sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = t["shingles"].combine_chunks()
        sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
        return column.flatten().to_numpy(), np.repeat(np.arange(t.num_rows), sizes), sizes

    (x, owner_x, size_x), (y, owner_y, size_y) = sets(left), sets(right)
    # only shingles of both sides count; their columns are taken some thousands at a time
    shared = np.intersect1d(x, y)
    both = np.zeros((left.num_rows, right.num_rows), dtype=np.float32)
    at_x, at_y = np.searchsorted(shared, x), np.searchsorted(shared, y)
    at_x[at_x == len(shared)], at_y[at_y == len(shared)] = 0, 0
    in_x, in_y = (shared[at_x] == x, shared[at_y] == y) if len(shared) else (np.zeros(len(x), bool), np.zeros(len(y), bool))
    at_x, owner_x, at_y, owner_y = at_x[in_x], owner_x[in_x], at_y[in_y], owner_y[in_y]
    order_x, order_y = np.argsort(at_x, kind="stable"), np.argsort(at_y, kind="stable")
    at_x, owner_x, at_y, owner_y = at_x[order_x], owner_x[order_x], at_y[order_y], owner_y[order_y]
    step = 4096
    for k in range(0, len(shared), step):
        width = min(step, len(shared) - k)
        p, q = (slice(*np.searchsorted(a, (k, k + width))) for a in (at_x, at_y))
        m, n = np.zeros((left.num_rows, width), dtype=np.float32), np.zeros((right.num_rows, width), dtype=np.float32)
        m[owner_x[p], at_x[p] - k] = 1
        n[owner_y[q], at_y[q] - k] = 1
        both += m @ n.T
    both = both.astype(np.int64)
    union = size_x[:, None] + size_y[None, :] - both
    good = (100 * both >= percent * union) & (left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :])
    i, j = np.nonzero(good)
    return pa.table({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j]}) if len(i) else none


def _by_prefix(hot: DataFrame, sets: DataFrame, lows: DataFrame, percent: int) -> DataFrame:
    """Links across labels among ``hot`` (id, label, outer), but for pairs of which neither is ``outer``."""
    full = staged(sets.join(hot, "id"), "hot-sets")
    counts = _counted(full.where("outer"))
    tokens = staged(prefixes(full, counts, percent), "prefixes")
    parts = tokens.groupBy("token", "label").agg(F.count_if("small").alias("s"), F.count(F.lit(1)).alias("n"))
    cost = F.sum("s") * F.sum("n") - F.max(F.col("s") * F.col("n"))
    split = staged(parts.groupBy("token").agg(cost.alias("cost"), F.max_by("label", F.col("s") * F.col("n")).alias("largest")).where("cost > 0"), "prefix-groups")
    wanted = F.broadcast(split) if within(split, BROADCAST_IDS) else split
    tokens = staged(tokens.join(wanted, "token"), "met")
    few = tokens.where(f"cost <= {PAIRS}")
    y = few.where("small").select("token", *[F.col(c).alias(f"{c}_y") for c in ("id", "label", "outer", "n")])
    fits = F.expr(f"label_y <> label and (outer or outer_y) and n_y <= n and 100 * n_y >= {percent} * n")
    pairs = y.join(few.select("token", "id", "label", "outer", "n"), "token").where(fits).select(F.least("id_y", "id").alias("a"), F.greatest("id_y", "id").alias("b")).distinct()
    links = verified(pairs, lows, sets, percent)
    # larger groups in blocks: the small sides outside the largest label with all, those inside it with the others
    many = tokens.where(f"cost > {PAIRS}").join(full.select("id", "shingles"), "id").withColumn("inside", F.col("label") == F.col("largest"))
    side = lambda rows, name, part: rows.select("token", F.lit(part).alias("part"), "id", "label", "shingles").withColumn("side", F.lit(name))
    small = F.col("small")
    sides = [side(many.where(small & ~F.col("inside")), "y", 0), side(many, "x", 0), side(many.where(small & F.col("inside")), "y", 1), side(many.where(~F.col("inside")), "x", 1)]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    sizes = many.groupBy("token").agg(*[F.greatest(F.ceil(F.sum(F.when(c, F.size("shingles"))) / BLOCK), F.ceil(F.count_if(c) / BLOCK_ROWS)).cast("int").alias(f"{n}{p}") for n, p, c in (("y", 0, small & ~F.col("inside")), ("x", 0, F.lit(True)), ("y", 1, small & F.col("inside")), ("x", 1, ~F.col("inside")))])
    own = lambda n: F.when(F.col("part") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    rows = rows.join(sizes, "token").withColumns({"blocks": F.when(F.col("side") == "y", own("y")).otherwise(own("x")), "other": F.when(F.col("side") == "y", own("x")).otherwise(own("y"))}).where("other > 0")
    block, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    left = rows.where("side = 'y'").select("token", "part", block.alias("s"), every.alias("m"), "id", "label", "shingles")
    # both sides come from one table; names of its own keep the right side's columns apart
    right = rows.where("side = 'x'").select(F.col("token").alias("t2"), F.col("part").alias("p2"), every.alias("s2"), block.alias("m2"), *[F.col(c).alias(f"{c}2") for c in ("id", "label", "shingles")])
    names = ["token", "part", "s", "m", "id", "label", "shingles"]
    cells = left.groupBy(*names[:4]).cogroup(right.groupBy("t2", "p2", "s2", "m2")).applyInArrow(lambda x, y: _links(x, y.rename_columns(names), percent), "a long, b long")
    return links.unionByName(cells.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _labelled(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """Add the label of the ids in ``column``; an id without one is its own."""
    found = labels.select(F.col("id").alias(column), F.col("label").alias("__label"))
    return df.join(found, column, "left").withColumn(out, F.coalesce("__label", column)).drop("__label")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The component of every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; the shingles are runs of ``words`` words, or the
    whole sequence where there are fewer words.  Documents are linked where 100 * |A and B| >= percent * |A or B|; a text
    that is null, empty or without words has no shingles and no links.  component_id is the smallest doc_id reachable; kept
    says that it is the document's own.  Rows that share a doc_id are one document, linked where any of their texts is; a
    row without doc_id takes no part: component_id null, kept true.  An empty table gives no rows; other columns are not
    read.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    with passing(docs.sparkSession):
        rows_of = staged(sketch_documents(docs, words, bands, rows), "sketches", keep=True)
        labels = staged(_labels(docs, rows_of, words, percent, bands), "labels", keep=True)
    final = rows_of.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return final.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce(F.col("label").isNull() | (F.col("label") == F.col("doc_id")), F.lit(True)).alias("kept"))


def _labels(docs: DataFrame, rows_of: DataFrame, words: int, percent: int, bands: int) -> DataFrame:
    """(id, label) of all documents that have links, from the sketches of all rows."""
    some = rows_of.where("n_shingles > 0 and doc_id is not null")
    total = rows_of.count()
    # the links of equal sets, by way of a part of the group: each document with the smallest of its part, these with the
    # smallest of all; a group of any size is thus dealt to SALTS keys
    salted = some.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id")
    part = salted.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = part.groupBy("h1", "h2").agg(F.min("first").alias("rep"))
    copies = salted.join(part.where("n > 1").drop("n"), ["h1", "h2", "salt"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    copies = copies.unionByName(part.join(same, ["h1", "h2"]).where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b"))).distinct()
    nodes = some.join(same.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    keyed = nodes.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    total *= bands
    keyed = staged(keyed, "keys") if total > EASY else keyed
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").select("key", "n")
    members = staged(join_by_key(keyed, shared, ["key"], "n", total), "buckets")
    total = members.count()
    # a node's weight: the members of its buckets, all told; a bucket's hub: its node of the largest weight
    weights = members.groupBy("id").agg(F.sum("n").alias("w"))
    hubs = members.join(weights, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("hub"), F.count(F.lit(1)).alias("k"))
    wanted = weights.select(F.col("id").alias("doc_id"))
    near = F.broadcast(wanted) if within(wanted, BROADCAST_IDS) else wanted
    sets = staged(shingle_sets(docs.join(near, "doc_id", "left_semi"), words), "sets")
    lows = staged(some.join(near, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "low", F.col("n_shingles").alias("n")), "lows")

    # first each node and the heaviest hub of its buckets
    met = join_by_key(members.select("key", "id"), hubs, ["key"], "k", total).select("id", F.col("hub.w").alias("w"), F.col("hub.m").alias("m")).where("id <> -m")
    pairs = met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("w", "m")).alias("best")).select("a", (-F.col("best.m")).alias("b"))
    labels = components(copies.unionByName(verified(pairs, lows, sets, percent)))
    # then all that share a bucket and are not joined
    labelled = _labelled(members.select("key", "id"), labels, "id", "label")
    labelled = staged(labelled, "labelled") if total > EASY else labelled
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    split = split.select("key", F.col("most.label").alias("largest"), "n", (F.col("n") * (F.col("n") - F.col("most.n"))).alias("cost"))
    active = staged(join_by_key(labelled, split, ["key"], "n", total), "active")
    few = active.where(f"cost <= {PAIRS}")
    outside = few.where("label <> largest").select("key", F.col("id").alias("u"), F.col("label").alias("lu"))
    pairs = outside.join(few.select("key", "id", "label"), "key").where("lu <> label").select(F.least("u", "id").alias("a"), F.greatest("u", "id").alias("b")).distinct()
    links = verified(pairs, lows, sets, percent)
    # a node of a larger bucket may be in the largest component of one and outside that of another
    hot = active.where(f"cost > {PAIRS}").groupBy("id", "label").agg(F.max(F.col("label") != F.col("largest")).alias("outer"))
    found = staged(links.unionByName(_by_prefix(hot, sets, lows, percent)).distinct(), "edges")
    return labels if found.isEmpty() else components(found, labels)


def reject_copies(docs: DataFrame, **how) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id; same columns.

    Of rows that repeat a kept doc_id all stay; rows without doc_id are kept."""
    return without(docs, near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("id")), "copy-ids")
