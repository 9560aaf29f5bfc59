"""Resampling with hashed draws: bootstrap and permutation tests.

A draw is a hash of (seed, replicate, place) modulo the size of the group, so results depend on no random state, can be
recomputed after a lost executor, and can be checked in another engine.  A group's rows travel as one array, once for each
of CHUNKS chunks of replicates; draws read the array in place.  The means of ``bootstrap_mean`` are summed inside tasks, whose
draws are hashed LANES at a time; ``bootstrap_spearman`` ranks a replicate's draws by windows, for which they are shuffled.
Groups are cohort tables: one of them fits a task as an array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fieldcohort.functions import expr as X
from fieldcohort.operators import stats
from fieldcohort.operators.stats import average_rank


def _indexed(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(key)
    return df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*groups)))


#: Chunks of replicates: as many tasks work on one group, and as many copies of its array travel.
CHUNKS = 32


def _chunked(df: DataFrame, groups: list[str], key: str, values: list[str], replicates: int) -> tuple[DataFrame, int, list[str]]:
    """(groups, an array of each value in the key's order, __c) once for each chunk of replicates, how many chunks there are,
    and the arrays' names."""
    rows = df.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("__key"), *values))).alias("__rows"))
    chunks, arrays = min(CHUNKS, replicates), [f"__v{k}" for k in range(len(values))]
    # an array of plain values takes a fourth of one of rows
    columns = [F.col(f"__rows.{v}").alias(a) for v, a in zip(values, arrays, strict=True)]
    return rows.select(*groups, *columns).select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("__c")), chunks, arrays


def resampled(df: DataFrame, groups: list[str], key: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(groups, b, values): ``replicates`` samples with replacement of each group, each of the group's size; all rows of a
    replicate come from one task."""
    dealt, chunks, arrays = _chunked(df, groups, key, values, replicates)
    dealt = dealt.repartition(*groups, "__c")
    # replicates c, c + chunks, c + 2 chunks, ... of each chunk; then a slot for each row
    of = F.explode(F.sequence(F.col("__c"), F.lit(replicates - 1), F.lit(chunks))).alias("b")
    size = F.size(arrays[0])
    slots = dealt.select(*groups, *arrays, of).select(*groups, *arrays, "b", F.explode(F.sequence(F.lit(0), size - 1)).alias("__i"))
    drawn = slots.withColumn("__j", X.draw(size, F.lit(seed), F.col("b"), F.col("__i")).cast("int"))
    return drawn.select(*groups, "b", *[F.get(a, F.col("__j")).alias(v) for v, a in zip(values, arrays, strict=True)])


#: Draws hashed at once: some arrays of them fit a processor's cache.  Values that a task holds at once, if not of one group.
LANES, HELD = 1 << 15, 1 << 25
#: Additive constants and rotations of MD5 (RFC 1321), and its first word before the first step.
SINES, TURNS, FIRST = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], 0x67452301


def _words(texts: list[bytes] | np.ndarray, at: int, end: int) -> np.ndarray:
    """Texts of one length as MD5's words, a row a word: they start at byte ``at`` of a message whose last byte is before ``end``."""
    raw = np.asarray(texts, dtype="S")
    out = np.zeros((len(raw), 64), np.uint8)
    width = raw.dtype.itemsize
    out[:, at : at + width] = raw.view(np.uint8).reshape(len(raw), width)
    if at + width == end:
        out[:, end] = 0x80
        out[:, 56:60] = np.frombuffer(np.uint32(8 * end).astype("<u4").tobytes(), np.uint8)
    return np.ascontiguousarray(out.view("<u4").T)


def _md5_start(words: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The first four bytes of the MD5 of messages of one block, as numbers; ``words`` broadcast to ``shape``.

    The same steps for all at once.  The word that is wanted is last changed by the 61st of 64 steps."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (FIRST, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for step in range(61):
        part = step // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word, sine = words[((step, 5 * step + 1, 3 * step + 5, 7 * step)[part]) % 16], np.uint32(SINES[step])
        f += a
        if word.size == 1:
            f += np.uint32((int(word.flat[0]) + SINES[step]) & 0xFFFFFFFF)
        else:
            f += word
            f += sine
        turn = TURNS[part][step % 4]
        np.left_shift(f, np.uint32(turn), out=turned)
        f >>= np.uint32(32 - turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(FIRST)


def drawn_sums(columns: list[np.ndarray], seed: int, replicates: list[int]) -> np.ndarray:
    """For each column, all of one size, the sum of the values that each replicate draws, as many as there are: those at
    ``X.draw`` of (seed, replicate, place), which are the same for all columns and are hashed once."""
    n, out = len(columns[0]), np.zeros((len(columns), len(replicates)))
    names, size = [f"{seed}:{b}:".encode() for b in replicates], np.uint32(n)
    for length in sorted({len(x) for x in names}):
        which = np.array([k for k, x in enumerate(names) if len(x) == length])
        for digits in range(1, len(str(max(n - 1, 0))) + 1):
            first, last = 10 ** (digits - 1) if digits > 1 else 0, min(10**digits, n)
            heads = _words([names[k] for k in which], 0, length + digits)
            for start in range(first, last, LANES):
                places = np.arange(start, min(start + LANES, last))
                tails = _words(places.astype(f"S{digits}"), length, length + digits)
                some = max(1, LANES // len(places))
                for low in range(0, len(which), some):
                    own = heads[:, low : low + some, None]
                    # a word without digits of a place is the same for all places
                    words = [own[k] | tails[k] if length // 4 <= k <= (length + digits) // 4 else own[k] | tails[k, :1] for k in range(16)]
                    drawn = _md5_start(words, (own.shape[1], len(places))).byteswap()
                    drawn -= drawn // size * size
                    at = drawn.astype(np.intp)
                    for sums, values in zip(out, columns, strict=True):
                        sums[which[low : low + some]] += values.take(at, mode="clip").sum(axis=1)
    return out


def bootstrap_mean(df: DataFrame, value: str, groups: list[str], key: str, replicates: int, seed: int = 1) -> DataFrame:
    """Mean of each group with its 2.5 and 97.5 bootstrap percentiles."""
    dealt, chunks, (array,) = _chunked(df.withColumn(value, F.col(value).cast("double")), groups, key, [value], replicates)
    # a task a chunk, which has all groups: those of one size share their draws
    dealt = dealt.repartitionById(chunks, "__c")
    schema = StructType([*[dealt.schema[g] for g in groups], StructField("b", IntegerType()), StructField("m", DoubleType())])

    def means_of(rows: list[tuple[pa.RecordBatch, pa.Array]], chunk: int) -> Iterator[pa.RecordBatch]:
        mine = list(range(chunk, replicates, chunks))
        columns = [found.fill_null(0.0).to_numpy() for _, found in rows]
        # of a group with NULLs it counts too how many of the drawn are there
        columns += [found.is_valid().cast(pa.float64()).to_numpy() for _, found in rows if found.null_count]
        sums = drawn_sums(columns, seed, mine)
        there = iter(sums[len(rows) :].tolist())
        for (row, found), own in zip(rows, sums.tolist(), strict=False):
            of = next(there) if found.null_count else [float(len(found))] * len(mine)
            means = pa.array([s / k if k else None for s, k in zip(own, of, strict=True)], pa.float64())
            yield pa.record_batch([*[row.column(g).take(pa.array([0] * len(mine))) for g in groups], pa.array(mine, pa.int32()), means], names=[*groups, "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[pa.RecordBatch, pa.Array]]] = {}
        many = 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                found = row.column(array).flatten()
                held.setdefault((row.column("__c")[0].as_py(), len(found)), []).append((row, found))
                many += len(found)
                if many > HELD:
                    for (chunk, _), rows in held.items():
                        yield from means_of(rows, chunk)
                    held, many = {}, 0
        for (chunk, _), rows in held.items():
            yield from means_of(rows, chunk)

    means = dealt.mapInArrow(run, schema)
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    ci = means.groupBy(*groups).agg(F.get(p, 0).alias("ci025"), F.get(p, 1).alias("ci975"))
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(ci, groups)


def bootstrap_spearman(df: DataFrame, x: str, y: str, groups: list[str], key: str, replicates: int, seed: int = 1) -> DataFrame:
    """Percentiles of Spearman's rho over bootstrap samples, re-ranked within each; undefined ones are left out."""
    drawn = resampled(df, groups, key, [x, y], replicates, seed)
    part = [*groups, "b"]
    rho = drawn.select(*part, average_rank(x, part).alias("rx"), average_rank(y, part).alias("ry")).groupBy(*part).agg(X.pearson("rx", "ry").alias("rho"))
    p = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975)))
    return rho.groupBy(*groups).agg(F.count("rho").alias("defined"), F.get(p, 0).alias("ci025"), F.get(p, 1).alias("ci975"))


def permutation_test(df: DataFrame, x: str, y: str, groups: list[str], key: str, replicates: int, seed: int = 1) -> DataFrame:
    """Two-sided permutation p of the correlation of x and y: (1 + #{|r*| >= |r|}) / (replicates + 1).

    A permutation orders the group by a hash of (seed, replicate, place)."""
    rows = _indexed(df.select(*groups, key, x, y), groups, key)
    slots = rows.select(*groups, "__i", F.col(x).alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    order = Window.partitionBy(*groups, "b").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("b"), F.col("__i")).cast("binary")), "__i")
    mixed = slots.withColumn("__j", F.row_number().over(order) - 1).drop("__i")
    # Spark's estimate knows nothing of the replicates: left to itself it may broadcast the permuted rows through the driver
    pairs = mixed.hint("merge").join(rows.select(*groups, F.col("__i").alias("__j"), F.col(y).alias("__y")), [*groups, "__j"])
    each = pairs.groupBy(*groups, "b").agg(X.pearson("__x", "__y").alias("r"))
    seen = df.groupBy(*groups).agg(X.pearson(x, y).alias("observed"))
    joined = each.join(seen, groups)
    hits = F.count_if(F.abs("r") >= F.abs("observed") - 1e-12)
    return joined.groupBy(*groups).agg(F.first("observed").alias("observed"), ((1 + hits) / (replicates + 1.0)).alias("p_value"))


def folds(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """Add ``fold`` (1 to k): rows ordered by a hash of seed and key, the first n mod k folds one row larger.

    The hash's first digits cut the order into runs, which are numbered by a task each."""
    hashed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))).withColumn("__run", F.substring("__h", 1, 2))
    rows, n = stats.numbered(hashed, ["__run"], ["__h", key], "__i"), F.col("__total")
    small, larger = F.expr(f"__total div {k}"), n % k
    # the first ``larger`` folds have one row more
    fold = F.when(F.col("__i") < larger * (small + 1), F.expr(f"__i div (__total div {k} + 1)")).otherwise(larger + F.expr(f"(__i - (__total % {k}) * (__total div {k} + 1)) div greatest(__total div {k}, 1)"))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("__h", "__run", "__i", "__total")
