"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates and queries are dealt into blocks; a task holds one block of each.  It sorts its candidates by every dimension
once and answers all its queries from these lists.  The lists are read from their good ends (the largest values for a
positive weight, the smallest for a negative one) in runs, those with the largest product of weight and value first, across
all lists.  Candidates that come up are scored in full; the products at the reading positions add up to what an unread
candidate can score at most, and reading stops when that bound is below the kth score so far (not at it: a tie may have a
smaller id).

Each query brings a kth score from a first set of at most SEED candidates, so that a block whose bound is below it at the
very start is not read at all.  The same score tells beforehand how far the lists would have to be read: where that is half
of the block's candidates or more, all of them are scored by one matrix product, which costs less than drawing them from
the lists.  The blocks' lists of k are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcohort.llm.common import staged

TOP, EVERY, SCALE = 20, 20, 64
#: Rows of a block at most; with many dimensions fewer, so that a block has at most CELL components.
CANDIDATE_BLOCK, QUERY_BLOCK, CELL = 65536, 16384, 1 << 22
#: Candidates that every query is scored against first, and rows under which a block is not divided for more tasks.
SEED, LEAST = 4096, 2048
#: Runs of a list, and queries that are looked at together.
RUNS, TOGETHER = 256, 128


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold a null, NaN or infinity, and rows
    without vec_id, are left out."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & good).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _lowest(kind: np.dtype) -> float | int:
    return np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best, best first and ties by id."""
    if len(scores) > k > 0:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def score_all(ids: np.ndarray, vectors: np.ndarray, owns: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k best (ids, scores) for each query by one product; scores under a query's floor are left out."""
    products = queries @ vectors.T
    lowest = _lowest(products.dtype)
    for own, score, floor in zip(owns, products, floors, strict=True):
        at = np.flatnonzero((ids != own) if floor == lowest else (score >= floor) & (ids != own))
        best = at[_ranked(ids[at], score[at], k)]
        yield ids[best], score[best]


class SortedLists:
    """Candidates sorted by every dimension; the lists are read in runs of equal length from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(vectors, self.order, axis=0)
        self.step = max(1, -(-n // RUNS))
        at = np.arange(0, n, self.step)
        # the first value of each run from the top and from the bottom
        self.high, self.low = ordered[n - 1 - at], ordered[at]

    def heads(self, query: np.ndarray) -> np.ndarray:
        """Weight times value at the head of every run of every list, or of a stack of queries."""
        q = query[..., None, :]
        return np.where(q > 0, self.high, self.low) * q

    def far(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Whether half of the candidates or more would be read before the bound falls below the floor."""
        # every fourth run will do to tell
        q = queries[:, None, :]
        heads = np.where(q > 0, self.high[::4], self.low[::4]) * q
        first = np.sort(heads[:, 0, :].astype(np.float64), axis=1)
        d = first.shape[1]
        # the level where sum(min(level, first)) is the floor; what lies above the level is read.  The sum is concave, so that
        # its straight pieces meet the floor at this level or below it
        before = np.concatenate((np.zeros((len(first), 1)), np.cumsum(first, axis=1)[:, :-1]), axis=1)
        level = (floors[:, None].astype(np.float64) - before) / (d - np.arange(d))
        level = np.where(floors > first.sum(axis=1), np.inf, level.max(axis=1, initial=-np.inf))
        read = ((heads > level[:, None, None]) & (queries != 0)[:, None, :]).sum(axis=(1, 2)) * self.step * 4
        return (read * 2 >= len(self.ids)) | ~queries.any(axis=1)

    def top(self, own: int, query: np.ndarray, k: int, floor: float | int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores), best first and ties by id, and how many candidates were scored; with a ``floor``, scores
        below it may be left out."""
        n = len(self.ids)
        used = self.ids != own
        want = min(k, int(used.sum()))
        least = _lowest(query.dtype) if floor is None else floor
        seen, scores = np.zeros(n, dtype=bool), np.zeros(n, dtype=query.dtype)
        heads, lists = self.heads(query), np.flatnonzero(query)
        runs = len(heads)
        # all runs of all lists, those with the largest products first; within a list they come in order
        turn = np.argsort(-heads[:, lists], axis=None, kind="stable")
        run_of, list_of = turn // max(1, len(lists)), lists[turn % max(1, len(lists))]
        next_run, done, batch = np.zeros(len(query), dtype=np.int64), 0, max(1, -(-2 * k // self.step))
        while not seen.all():
            bound = heads[np.minimum(next_run, runs - 1), np.arange(len(query))].sum() if len(lists) else 0
            if bound < least:
                break
            if done * self.step * 2 >= n or not len(lists) or (next_run[lists] >= runs).any():
                # a list is at its end, or half of the block is read: the rest is scored as well
                fresh = ~seen
            else:
                fresh = np.zeros(n, dtype=bool)
                for r, d in zip(run_of[done : done + batch].tolist(), list_of[done : done + batch].tolist(), strict=True):
                    a, b = r * self.step, min(n, (r + 1) * self.step)
                    fresh[self.order[n - b : n - a, d] if query[d] > 0 else self.order[a:b, d]] = True
                    next_run[d] = r + 1
                done, batch = done + batch, batch * 2
                fresh &= ~seen
            new = np.flatnonzero(fresh)
            scores[new] = self.vectors[new] @ query
            seen |= fresh
            got = scores[seen & used]
            if len(got) >= want > 0:
                least = max(least, np.partition(got, len(got) - want)[len(got) - want])
        at = np.flatnonzero(seen & used)
        best = at[_ranked(self.ids[at], scores[at], want)] if want else at[:0]
        return self.ids[best], scores[best], int(seen.sum())

    def answer(self, owns: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query's place, ids, scores, candidates scored) for each query."""
        for start in range(0, len(queries), TOGETHER):
            part = slice(start, start + TOGETHER)
            far = self.far(queries[part], floors[part])
            places = start + np.flatnonzero(far)
            for place, (ids, scores) in zip(places.tolist(), score_all(self.ids, self.vectors, owns[places], queries[places], k, floors[places]), strict=True):
                yield place, ids, scores, len(self.ids)
            for place in (start + np.flatnonzero(~far)).tolist():
                yield place, *self.top(owns[place], queries[place], k, floors[place])


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` best rows by integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows than ``k``: all of them.
    Rows that share the query's vec_id are not its candidates; equal query rows ask once; among repeated candidates each
    counts.  Vectors meet only vectors of their own length; empty ones score 0.  Invalid vectors (see ``quantised``) take no
    part; an empty table gives no rows; other columns are not read.
    """
    valid = staged(quantised(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    asked = valid.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    facts = valid.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"), F.max("dim").alias("dim"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).first()
    n, wide = facts["n"], max(1, facts["dim"] or 0)
    rows = max(1, min(candidate_block, CELL // wide))
    parallel = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST))
    cells_c, cells_q = max(1, -(-n // rows), parallel), max(1, -(-(facts["q"] or 0) // max(1, min(query_block, CELL // wide))))
    # sums of products stay exact in the narrowest kind that holds them
    largest = (facts["dim"] or 0) * (facts["most"] or 0) ** 2
    kind = np.dtype(np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64)
    width = "array<smallint>" if (facts["most"] or 0) < 1 << 15 else "array<bigint>"
    candidates = valid.select("vec_id", F.col("v").cast(width).alias("v"), "dim", (F.monotonically_increasing_id() % cells_c).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(cells_q - 1))))
    # the hash tells query rows of one id apart
    query = F.xxhash64("vec_id", "v")
    queries = asked.select("vec_id", F.col("v").cast(width).alias("v"), "dim", query.alias("query"), F.pmod(query, F.lit(cells_q)).cast("int").alias("qb"))
    # at most SEED rows, fewer where they are wide
    first = valid.select("vec_id", F.col("v").cast(width).alias("v"), "dim").limit(max(1, min(SEED, CELL // wide))).toArrow()
    seed = valid.sparkSession.sparkContext.broadcast({int(d): (part["vec_id"].to_numpy(), _matrix(part["v"], kind)) for d in pc.unique(first["dim"]).to_pylist() if (part := first.filter(pc.equal(first["dim"], d))).num_rows})

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, least = pa.Table.from_batches([batch]), [None] * batch.num_rows
            for d in pc.unique(table["dim"]).to_pylist():
                ids, matrix = seed.value.get(d, (np.zeros(0, dtype=np.int64), np.zeros((0, d), dtype=kind)))
                at = np.flatnonzero(table["dim"].to_numpy() == d)
                for start in range(0, len(at), TOGETHER):
                    some = at[start : start + TOGETHER]
                    part = table.take(pa.array(some))
                    low = np.full(len(some), _lowest(kind), dtype=kind)
                    for place, (_, scores) in zip(some.tolist(), score_all(ids, matrix, part["vec_id"].to_numpy(), _matrix(part["v"], kind), k, low), strict=True):
                        if len(scores) == k > 0:
                            least[place] = int(scores[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])

    asking = queries.mapInArrow(floors, f"vec_id long, v {width}, dim int, query long, qb int, least long")
    asking = asking.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells_c - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            lists = SortedLists(right["vec_id"].to_numpy(), _matrix(right["v"], kind))
            owns, names = left["vec_id"].to_numpy(), left["query"].to_numpy()
            least = np.array([_lowest(kind) if x is None else x for x in left["least"].to_pylist()], dtype=kind)
            for place, ids, scores, _ in lists.answer(owns, _matrix(left["v"], kind), k, least):
                out.append((np.full(len(ids), owns[place]), np.full(len(ids), names[place]), ids, scores.astype(np.int64)))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table(dict(zip(("query_id", "query", "vec_id", "score"), columns, strict=True)))

    keys = ["dim", "qb", "cb"]
    found = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, "query_id long, query long, vec_id long, score long")
    rank = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
