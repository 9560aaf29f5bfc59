"""Sharding by Hilbert-curve order, in DataFrame functions only.

Several metadata dimensions are quantised to ``bits`` bits each, a document's place on the Hilbert curve through that
grid orders the corpus, and the order is cut into runs of equal counts.  Documents that are near in several dimensions
land in the same shard, so a reader that filters on any of them skips whole files by their min/max statistics.

Ranks are found without a global sort: counts per curve cell (a table of 2^(bits x dimensions) rows at most) give each
cell its offset, counts per (cell, salt) give each salted part of a cell its offset, and only within such a part are
rows numbered.  A cell that holds a third of the corpus is thus numbered by ``salts`` tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcohort.llm.common import staged

BITS, SHARDS, SALTS = 4, 16, 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The Hilbert index (long) of integer grid coordinates from 0 to 2^bits - 1.

    Skilling's published transform (2004): from the highest bit down, a set bit of an axis inverts the lower bits of the
    first axis, a clear one exchanges them; Gray encoding follows; the index interleaves the bits, the first axis leading.
    Each step is a lambda over the array of coordinates, so that the expression grows with the number of steps only.
    """
    n = len(coordinates)
    steps: list[Callable[[Column], list[Column]]] = []

    def exchange(k: int, q: int) -> Callable[[Column], list[Column]]:
        def step(v: Column) -> list[Column]:
            x = [F.get(v, j) for j in range(n)]
            bit, low = x[k].bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)
            t = x[0].bitwiseXOR(x[k]).bitwiseAND(low)
            out = list(x)
            out[0] = F.when(bit, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(t))
            if k:
                out[k] = F.when(bit, x[k]).otherwise(x[k].bitwiseXOR(t))
            return out

        return step

    def gray(k: int) -> Callable[[Column], list[Column]]:
        return lambda v: [F.get(v, j).bitwiseXOR(F.get(v, k - 1)) if j == k else F.get(v, j) for j in range(n)]

    def flip(v: Column) -> list[Column]:
        t = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(F.get(v, n - 1).bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0) for b in range(1, bits)], F.lit(0))
        return [F.get(v, j).bitwiseXOR(t) for j in range(n)]

    steps += [exchange(k, 1 << b) for b in range(bits - 1, 0, -1) for k in range(n)]
    steps += [gray(k) for k in range(1, n)] + [flip]

    def run(v: Column, left: list) -> Column:
        if left:
            return _let(F.array(*left[0](v)), lambda w: run(w, left[1:]))
        return reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(F.get(v, j), b).bitwiseAND(F.lit(1)).cast("long"), b * n + n - 1 - j) for b in range(bits) for j in range(n)])

    return _let(F.array(*[c.cast("int") for c in coordinates]), lambda v: run(v, steps))


def _hashed(value: Column, bits: int) -> Column:
    return (F.crc32(F.coalesce(value.cast("string"), F.lit("null")).cast("binary")) % (1 << bits)).cast("int")


def cells_of(bits: int = BITS, source: str | None = None, lang: str | None = None, size: int | None = None) -> dict[str, Column]:
    """The coordinates of given values, by column name: what a reader of ``write_shards``' files adds to its filter, so that
    whole files are skipped by their min/max statistics."""
    given = {"source_cell": source, "lang_cell": lang}
    out = {c: _hashed(F.lit(v), bits) for c, v in given.items() if v is not None}
    return out | ({"size_cell": _size_cell(F.lit(size), bits)} if size is not None else {})


def _size_cell(size: Column, bits: int) -> Column:
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size.cast("double"))).cast("int"))


def quantised(text: Column, lang: Column, source: Column, bits: int) -> list[Column]:
    """The grid coordinates of a document: hashed source, hashed language, and the size on a log scale.

    Nulls get a cell of their own kind: they hash as the word "null"."""
    return [_hashed(source, bits), _hashed(lang, bits), _size_cell(F.coalesce(F.octet_length(text), F.lit(0)) + 1, bits)]


def shard(df: DataFrame, shards: int = SHARDS, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """Assign every row of ``df`` (doc_id, text, lang, source) to a shard by its place on the Hilbert curve.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard and curve (the Hilbert index).
    The law is ``rows``: counts of shards differ by one at most, and slots count from 0 without gaps.  Within a cell rows
    follow a salt from id, size and checksum, then these.  A null text has size 1 and no checksum; a null id sorts first; rows
    that are alike in all of these get neighbouring slots in any order; an empty table gives no rows.
    Other columns of ``df``, whatever their names, are not read.
    """
    where = quantised(F.col("text"), F.col("lang"), F.col("source"), bits)
    rows = df.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        hilbert_index(where, bits).alias("curve"),
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(salts)).cast("int"))
    # rows are narrow and are read three times; the texts are read once
    rows = staged(rows, "shard-rows")
    parts = rows.groupBy("curve", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = parts.groupBy("curve").agg(F.sum("n").alias("m"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per curve cell, 2^(3 bits) at most, whatever the input
    cells = cells.select("curve", F.coalesce(F.sum("m").over(before.orderBy("curve")), F.lit(0)).alias("cell_from"), F.sum("m").over(Window.partitionBy()).alias("total"))
    parts = parts.select("curve", "salt", F.coalesce(F.sum("n").over(before.partitionBy("curve").orderBy("salt")), F.lit(0)).alias("part_from"))
    parts = parts.join(cells, "curve").select("curve", "salt", (F.col("cell_from") + F.col("part_from")).alias("offset"), "total")
    inside = Window.partitionBy("curve", "salt").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("k", F.row_number().over(inside) - 1).join(parts, ["curve", "salt"])
    rank = (F.col("offset") + F.col("k")).cast("long")
    owner = F.expr(f"cast((rank * {shards}) div total as int)")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("rank", rank)
        .withColumn("shard", owner)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )


#: Columns that ``write_shards`` adds.
ADDED = ("shard", "slot", "curve", "source_cell", "lang_cell", "size_cell")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, salts: int = SALTS) -> None:
    """Write the rows of ``df`` (doc_id, text, lang, source and others) as one folder per shard, in slot order.

    Files hold the columns of ``df`` and ADDED: shard, slot, curve index and the coordinates it comes from, small integers
    whose ranges in a file are narrow; a filter on them (``cells_of``) skips files on every quantised dimension.  Columns of
    ``df`` with one of these names are replaced.  Null texts and null or repeated doc_ids are rows like others: rows that
    are alike in id, size and checksum are numbered on both sides, so that each gets one place.  An empty table writes no
    rows.  A text travels to its place in the order, where it meets its shard, and from there to its shard."""
    df = df.drop(*ADDED)
    keys, of = ["id", "size", "crc"], Window.partitionBy("id", "size", "crc").orderBy(F.lit(1))
    placed = shard(df, shards, bits, salts).select(F.col("doc_id").alias("id"), "size", F.col("text_crc32").alias("crc"), "shard", "slot", "curve")
    placed = placed.withColumn("k", F.row_number().over(of))
    # a row travels as one column, so that none of its names meets one of these
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    cells = F.struct(*[c.alias(n) for n, c in zip(ADDED[3:], quantised(F.col("text"), F.col("lang"), F.col("source"), bits), strict=True)]).alias("cells")
    rows = df.select(row, cells, F.col("doc_id").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("crc"))
    rows = rows.withColumn("k", F.row_number().over(of))
    same = [rows[k].eqNullSafe(placed[k]) for k in [*keys, "k"]]
    joined = rows.join(placed, same).select("row", "cells", "shard", "slot", "curve").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out = joined.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], *[F.col(f"cells.{c}") for c in ADDED[3:]], "shard", "slot", "curve")
    out.write.partitionBy("shard").parquet(path)
