"""Bootstrap and permutation without gathering groups, re-sorting draws or sorting permutations.

*Means* (``bootstrap_means``): a group's rows are dealt to blocks.  How many of a replicate's draws fall into a block follows
from the group's size by splitting it top-down over halves of the blocks, each split a binomial draw whose generator is keyed
by seed, group and node; so every task finds its own block's share by walking from the root, without hearing of others, and
then draws its own rows, or, where values repeat, how often each value comes up.  What leaves a task is a sum for each replicate.  Groups may be of any size.

*Ranks* (``partial_rank_draws``): a replicate is a vector of counts, one for each row, or, where whole rows repeat, one for
each distinct row.  Rows are put in the order of each column once; mean ranks under the counts are then prefix sums of counts
along that order.  *Permutations* are keyed shuffles of blocks that fit a processor's cache: how many rows go from each block
to each other is drawn first.  Ranks need a group as a whole, so each chunk of replicates is a task with a copy of the group's
distinct rows, packed; groups have TASK_ROWS rows at most, which is checked.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fieldcohort.functions import expr as X
from fieldcohort.operators import cohort

#: Rows of a block on average, and blocks of a table; sizes of blocks are known to the driver and all tasks, 8 bytes each.
BLOCK_ROWS, BLOCKS = 100_000, 1_000_000
#: Draws made at once.
DRAWS = 1 << 20
#: Rows a distinct value from which draws are counted by value: a binomial takes about as long as a few draws.
REPEATS = 4
#: Rows of a group whose ranks are drawn, and tasks that share its replicates.
TASK_ROWS, CHUNKS = 8_000_000, 32
#: Places of a permutation multiplied at once, and rows of a block that are drawn or shuffled in a processor's cache.
PIECE, CELL = 1 << 16, 1 << 16


def _generator(*key: int | str, bits: type = np.random.Philox) -> np.random.Generator:
    """A generator that the key decides, in whatever task it is made."""
    words = [k if isinstance(k, int) else zlib.crc32(k.encode()) for k in key]
    return np.random.Generator(bits(np.random.SeedSequence(words)))


def block_draws(ends: list[int], block: int, replicates: int, seed: int, group: str) -> np.ndarray:
    """How many draws of each replicate fall into ``block``; ``ends`` are the blocks' sizes, added up.

    From all blocks down to this one: the draws of a node fall to its first half by a binomial with that half's share."""
    low, high, draws = 0, len(ends), np.full(replicates, ends[-1], dtype=np.int64)
    before = lambda k: ends[k - 1] if k else 0
    while high - low > 1:
        middle = (low + high) // 2
        total, first = before(high) - before(low), before(middle) - before(low)
        left = _generator(seed, group, low, high).binomial(draws, first / total if total else 0.0)
        draws, low, high = (left, low, middle) if block < middle else (draws - left, middle, high)
    return draws


def block_sums(values: np.ndarray, draws: np.ndarray, seed: int, group: str, block: int) -> np.ndarray:
    """The sum of each replicate's draws from a block's values, which are put in order first.

    Where values repeat, how often each is drawn is one multinomial draw, whatever the rows: the same distribution."""
    values, out = np.sort(values), np.zeros(len(draws))
    generator, ends = _generator(seed, group, block), np.cumsum(draws)
    distinct, often = np.unique(values, return_counts=True)
    if len(distinct) * REPEATS <= len(values):
        step = max(1, DRAWS // len(distinct))
        for start in range(0, len(draws), step):
            out[start : start + step] = generator.multinomial(draws[start : start + step], often / len(values)) @ distinct
        return out
    for start in range(0, int(ends[-1]) if len(ends) else 0, DRAWS):
        got = values[generator.integers(0, len(values), min(DRAWS, int(ends[-1]) - start))]
        sums = np.concatenate(([0.0], np.cumsum(got)))
        first = bisect_right(ends, start)
        last = int(np.searchsorted(ends, start + len(got)))
        cuts = np.clip(ends[first : last + 1] - start, 0, len(got))
        out[first : first + len(cuts)] += np.diff(sums[np.concatenate(([0], cuts))])
    return out


def bootstrap_means(df: DataFrame, value: str, groups: list[str], key: str, replicates: int = 5000, seed: int = 1, rows: int = BLOCK_ROWS) -> DataFrame:
    """n, mean and the 2.5 and 97.5 percentiles of ``replicates`` bootstrap means of each group, of any size.

    ``key`` decides the block of a row, so results do not depend on how rows are partitioned; rows whose value is NULL or not
    finite are left out; NULL is a group; an empty table gives no rows."""
    spark, names = df.sparkSession, [f"g{k}" for k in range(len(groups))]
    kept = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], X.finite(F.col(value)).alias("v"), F.xxhash64(key).alias("h")).where("v is not null")
    sizes = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    count = F.ceil(F.col("n") / rows).cast("long")
    counted = cohort.small(sizes.select(*[F.col(n).alias(f"s{n}") for n in names], count.alias("blocks")))
    same = [F.col(n).eqNullSafe(F.col(f"s{n}")) for n in names]
    dealt = kept.join(counted, same or F.lit(True)).select(*names, "v", F.pmod("h", "blocks").alias("block"), F.to_json(F.struct(*names, F.lit(0).alias("_")), {"ignoreNullFields": "false"}).alias("label"))
    found = dealt.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n")).limit(BLOCKS + 1).collect()  # a row for each block
    if len(found) > BLOCKS:
        raise ValueError(f"over {BLOCKS} blocks; larger blocks, or fewer groups")
    ends: dict[str, list[int]] = {}
    for r in sorted(found):
        own = ends.setdefault(r["label"], [])
        own += [own[-1] if own else 0] * (r["block"] + 1 - len(own))  # blocks without rows
        own[r["block"]] += r["n"]
    table = spark.sparkContext.broadcast(ends)
    schema = StructType([*[StructField(n, kept.schema[n].dataType) for n in names], StructField("sums", ArrayType(DoubleType()))])

    def run(part: pa.Table) -> pa.Table:
        label, block = part.column("label")[0].as_py(), part.column("block")[0].as_py()
        draws = block_draws(table.value[label], block, replicates, seed, label)
        sums = block_sums(part.column("v").to_numpy(), draws, seed, label, block)
        return pa.table({**{n: part.column(n).slice(0, 1) for n in names}, "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    sums = dealt.groupBy(*names, "label", "block").applyInArrow(lambda part: run(part), schema)
    means = sums.select(*names, F.posexplode("sums").alias("b", "s")).groupBy(*names, "b").agg(F.sum("s").alias("s"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    total = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    renamed = total.select(*[F.col(n).alias(f"t{n}") for n in names], "n", "mean")
    joined = means.join(cohort.small(renamed), [F.col(n).eqNullSafe(F.col(f"t{n}")) for n in names] or F.lit(True)).withColumn("m", F.col("s") / F.col("n"))
    out = joined.groupBy(*names).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.get(p, 0).alias("ci025"), F.get(p, 1).alias("ci975"))
    return out.where("n is not null").select(*[F.col(n).alias(g) for g, n in zip(groups, names, strict=True)], "n", "mean", "ci025", "ci975")


def _cells(n: int) -> np.ndarray:
    """Where the blocks of n rows begin, and n."""
    return np.append(np.arange(0, n, CELL), n)


def permuted(values: np.ndarray, *key: int | str) -> np.ndarray:
    """A keyed uniform permutation of the values.

    The blocks that the rows of a block go to are drawn without replacement, as counts; the block is shuffled and dealt out by
    them, and what a block has been dealt is shuffled in turn."""
    generator, at = _generator(*key, bits=np.random.SFC64), _cells(len(values))
    if len(at) <= 2:
        return generator.permutation(values)
    out, fill, room = np.empty_like(values), at[:-1].copy(), np.diff(at)
    for low, high in zip(at[:-1], at[1:], strict=True):
        own, share = values[low:high].copy(), generator.multivariate_hypergeometric(room, high - low)
        generator.shuffle(own)
        for start, to, k in zip((np.cumsum(share) - share).tolist(), fill.tolist(), share.tolist(), strict=True):
            out[to : to + k] = own[start : start + k]
        fill += share
        room -= share
    for low, high in zip(at[:-1], at[1:], strict=True):
        generator.shuffle(out[low:high])
    return out


def keyed_permutation(n: int, *key: int | str) -> np.ndarray:
    """A permutation of 0 to n - 1."""
    return permuted(np.arange(n), *key)


def permuted_product(a: np.ndarray, b: np.ndarray, *key: int | str) -> float:
    """The product of ``a`` and the permuted ``b``."""
    mixed = permuted(b, *key)
    return float(sum(a[start : start + PIECE] @ mixed[start : start + PIECE] for start in range(0, len(b), PIECE)))


class RankDraws:
    """Partial rank correlation of columns 0 and 1 given the others, of bootstrap samples of the rows.

    Rows are in the order of column 0.  Twice a rank less the mean is a whole number; those of a column are found along its own
    order and taken back to the rows, single bytes of counts and four bytes of a rank at a time.  ``often`` says how often each
    row of ``x`` is there: with REPEATS or more on average, a count stands for all copies of a row, else each copy is a row."""

    def __init__(self, x: np.ndarray, often: np.ndarray | None = None):
        # the order of the rows decides nothing
        order, often = np.lexsort(x.T[::-1]), np.ones(len(x), np.int64) if often is None else often
        x, often, self.total = x[order], often[order], int(often.sum())
        if len(x) * REPEATS > self.total > len(x):
            x, often = np.repeat(x, often, axis=0), np.ones(self.total, np.int64)
        self.n, self.often = len(x), often
        self.codes, self.orders, self.sizes = [], [], []
        for c in x.T:
            values, code = np.unique(c, return_inverse=True)
            single = len(values) == self.n
            self.sizes.append(len(values))
            self.codes.append(code.astype(np.int32))
            # of a column without ties the rows in its order; None where that is theirs
            self.orders.append(np.argsort(code).astype(np.int32) if single and not np.array_equal(code, np.arange(self.n)) else None)

    def doubled(self, j: int, counts: np.ndarray, few: np.ndarray | None, drawn: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Twice the mean ranks of a column in the sample with these counts of rows, less the mean, by their places in a table,
        and each row's place; None where that is the row's own."""
        code, order = self.codes[j], self.orders[j]
        if self.sizes[j] < self.n:
            own = np.bincount(code, counts, self.sizes[j])
        elif order is not None:
            own = (few if few is not None else counts).take(order, mode="clip")
        else:
            own = few if few is not None else counts
        kind = np.int32 if few is not None and drawn < 1 << 29 else np.float64
        table = np.cumsum(own, dtype=kind)
        table *= 2
        table -= own.astype(kind, copy=False)
        table -= kind(drawn)
        return table, None if self.sizes[j] == self.n and order is None else code

    def ranks(self, counts: np.ndarray) -> np.ndarray:
        """Mean ranks from 1 of each row's values in the sample with these counts of rows, less their mean."""
        drawn = int(counts.sum())
        each = [self.doubled(j, counts, None, drawn) for j in range(len(self.codes))]
        return np.column_stack([(table if code is None else table.take(code, mode="clip")) / 2 for table, code in each])

    def gram(self, counts: np.ndarray) -> np.ndarray:
        """Products of the ranks of all pairs of columns, summed over the sample: as many rows at a time as fit a cache."""
        size, drawn = len(self.codes), int(counts.sum())
        few = counts.astype(np.uint8) if counts.max(initial=0) < 256 else None
        each = [self.doubled(j, counts, few, drawn) for j in range(size)]
        out, space = np.zeros((size, size)), np.empty((size, min(CELL, self.n)))
        for start in range(0, self.n, CELL):
            own = counts[start : start + CELL]
            ranks = space[:, : len(own)]
            for row, (table, code) in zip(ranks, each, strict=True):
                # no place lies beyond a table; without that check a row takes half the time
                row[:] = table[start : start + CELL] if code is None else table.take(code[start : start + CELL], mode="clip")
            out += (ranks * own) @ ranks.T
        return out / 4

    def left(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How the ranks of the other columns make up those of columns 0 and 1, and the products of what they leave."""
        fit = np.linalg.lstsq(gram[2:, 2:], gram[2:, :2], rcond=None)[0] if len(gram) > 2 else np.zeros((0, 2))
        return fit, gram[:2, :2] - gram[:2, 2:] @ fit

    def residuals(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the ranks of the other columns leave of the ranks of columns 0 and 1, and the products of these."""
        r, (fit, left) = self.ranks(counts), self.left(self.gram(counts))
        return r[:, :2] - r[:, 2:] @ fit, left

    def rho(self, counts: np.ndarray) -> float | None:
        """The partial correlation under these counts; None where a column has no spread of its own."""
        left = self.left(self.gram(counts))[1]
        spread = np.sqrt(max(left[0, 0], 0) * max(left[1, 1], 0))
        return float(left[0, 1] / spread) if spread > 1e-9 * max(1.0, counts.sum() ** 3 / 12) else None

    def draw(self, seed: int, number: int, replicate: int) -> np.ndarray:
        """The counts of a replicate: of rows that repeat in one multinomial draw, of many rows block by block."""
        if self.total > self.n:
            return _generator(seed, number, replicate).multinomial(self.total, self.often / self.total).astype(float)
        if self.n <= CELL:
            return np.bincount(_generator(seed, number, replicate).integers(0, self.n, self.n), minlength=self.n).astype(float)
        generator, at, out = _generator(seed, number, replicate, bits=np.random.SFC64), _cells(self.n), np.empty(self.n, np.int32)
        for low, high, k in zip(at[:-1], at[1:], generator.multinomial(self.n, np.diff(at) / self.n), strict=True):
            out[low:high] = np.bincount(generator.integers(0, high - low, k, np.uint16), minlength=high - low)
        return out


def partial_rank_draws(long: DataFrame, group: str, number: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """For each group of ``long`` (group, its number, columns without NULLs): n, the partial rank correlation of the first two
    columns given the others, percentiles of its bootstrap draws, and the two-sided p of permuted residuals.

    A correlation that is undefined, or under 99 % of its draws defined, raises; so does a group of over TASK_ROWS rows."""
    sizes = long.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if sizes["n"] and sizes["n"] > TASK_ROWS:
        raise ValueError(f"a group of {sizes['n']} rows; ranks are drawn for {TASK_ROWS} at most")
    parts, chunks, width = 64, min(CHUNKS, replicates), len(columns) + 1
    distinct = long.select(F.col(group).alias("group"), F.col(number).cast("int").alias("number"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    x = [f"x{k}" for k in range(len(columns))]
    distinct = distinct.groupBy("group", "number", *x).agg(F.count(F.lit(1)).alias("often"))
    packed = distinct.groupBy("group", "number", F.pmod(F.xxhash64(*x), F.lit(parts)).alias("part")).agg(F.flatten(F.collect_list(F.array(*x, F.col("often").cast("double")))).alias("rows"))
    dealt = packed.select("group", "number", "rows", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    # few bytes may be much work: a given number of partitions is left as it is, and most of the tasks get one of their own
    dealt = dealt.repartition(4 * max(1, sizes["groups"]) * chunks, "group", "chunk")
    schema = "`group` string, n long, seen double, draws array<double>, hits long"

    def run(key: tuple, part: pa.Table) -> pa.Table:
        rows = np.concatenate([rows.flatten().to_numpy() for rows in part.column("rows").chunks]).reshape(-1, width)
        own, which = RankDraws(rows[:, :-1], rows[:, -1].astype(np.int64)), part.column("number")[0].as_py()
        whole = own.often.astype(float)
        if (seen := own.rho(whole)) is None:
            raise ValueError(f"the partial rank correlation of {key[0].as_py()} is undefined")
        (a, b), mine = (np.repeat(c, own.often) for c in own.residuals(whole)[0].T), range(key[1].as_py(), replicates, chunks)
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        draws = [r for k in mine if (r := own.rho(own.draw(seed, which, k))) is not None]
        hits = sum(bool(abs(permuted_product(a, b, seed, which, k, "permuted")) >= abs(seen) - 1e-12) for k in mine)
        return pa.table({"group": [key[0].as_py()], "n": [own.total], "seen": [seen], "draws": [draws], "hits": [hits]}, schema=pa.schema([("group", pa.string()), ("n", pa.int64()), ("seen", pa.float64()), ("draws", pa.list_(pa.float64())), ("hits", pa.int64())]))

    each = dealt.groupBy("group", "chunk").applyInArrow(run, schema)
    p = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    # a row for each replicate, the first of a chunk with its hits: a second reading of ``each`` would draw all anew
    drawn = each.select("group", "n", "seen", "hits", F.posexplode_outer("draws").alias("k", "d"))
    test = drawn.groupBy("group").agg(
        F.first("n").alias("n"), F.first("seen").alias("partial_rho"), F.count("d").alias("defined"), F.get(p, 0).alias("ci025"), F.get(p, 1).alias("ci975"),
        ((1 + F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col("hits")))) / (replicates + 1.0)).alias("p_value"),
    )
    few = F.raise_error(F.concat(F.lit("too many undefined draws for "), F.col("group")))
    return test.select(F.col("group").alias(group), "n", "partial_rho", F.when(F.col("defined") < 0.99 * replicates, few.cast("double")).otherwise(F.col("ci025")).alias("ci025"), "ci975", "p_value")
