"""Toxicity: a classifier chain of linear models on hashed words.

The chain goes through the label columns in order.  The model of each column sees the words and the probabilities of the
columns before it; in training those are out-of-fold predictions, so that a later model learns from probabilities of the
kind it will meet.  Each model is a logistic regression with an L1 penalty (accelerated proximal gradient), which leaves
words without a clear effect at zero; long texts then gather no noise from thousands of small weights.

Words are runs of ASCII letters and digits and non-ASCII characters.  Words and their first bytes (stems of the lengths
STEMS) are hashed to buckets.  Features say that a word is in the text, or that a stem makes up a share of its words (the
steps SHARES), with one word or with two different ones at least; shares keep long texts comparable with short ones.
The features kept are those with the largest chi-square over any label, counted in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm import hashing
from fieldcohort.llm.common import passing, release, slices, staged, within, without
from fieldcohort.llm.quality import training_rows

#: Labelled rows that the chain is fitted on, at most.
TRAIN_ROWS = 16_000
FEATURES, PENALTY, STEPS, INNER = 1024, 0.0003, 300, 4
#: Buckets for words and for stems of each length; a feature is a bucket and one of KINDS ways to be there.
BITS, STEMS, SHARES, KINDS = 18, (4, 5, 6), (0.004, 0.008, 0.016), 8
THRESHOLD = 0.5
#: name: label column and the value that counts as the category; earlier ones feed later ones.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def present(texts: list[bytes], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (text index, feature) of all texts, ordered; with ``kept``, a flag for each bucket, of those buckets only."""
    hashed, owner, starts, ends, low = hashing.words(texts, hashing.NOT_ALNUM)
    sizes = np.bincount(owner, minlength=len(texts))
    # the distinct words of each text, with a place where each occurs and how often
    order = np.lexsort((hashed, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    at = order[first]
    text = owner[at].astype(np.int64)
    mask, width = np.uint64((1 << BITS) - 1), (1 + len(STEMS)) << BITS
    bucket = (hashed[at] & mask).astype(np.int64)
    use = slice(None) if kept is None else kept[bucket]
    found = [(text[use] * width + bucket[use]) * KINDS]
    for k, length in enumerate(STEMS):
        long = ends[at] - starts[at] >= length
        stem = hashing.prefixes(low, starts[at][long], length)
        bucket = (stem & mask).astype(np.int64) + ((k + 1) << BITS)
        owners, counts = text[long], times[long]
        if kept is not None:
            use = kept[bucket]
            bucket, owners, counts = bucket[use], owners[use], counts[use]
        keys, inverse, different = np.unique(owners * width + bucket, return_inverse=True, return_counts=True)
        share = np.bincount(inverse, counts, len(keys)) / np.maximum(1, sizes[keys // width])
        for j, least in enumerate(SHARES):
            found.append(keys[share >= least] * KINDS + 1 + 2 * j)
            found.append(keys[(share >= least) & (different > 1)] * KINDS + 2 + 2 * j)
    pairs = np.unique(np.concatenate(found))
    return pairs // (width * KINDS), pairs % (width * KINDS)


class Sparse:
    """Rows of 0/1 features as (row, column) pairs ordered by row, with dense columns beside them."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n: int, width: int, dense: np.ndarray):
        self.rows, self.columns, self.n, self.width, self.dense = rows, columns, n, width, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], self.n) + self.dense @ w[self.width :]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.columns, v[self.rows], self.width), v @ self.dense))

    def part(self, keep: np.ndarray) -> Sparse:
        number = np.cumsum(keep) - 1
        inside = keep[self.rows]
        return Sparse(number[self.rows[inside]], self.columns[inside], int(keep.sum()), self.width, self.dense[keep])

    def beside(self, column: np.ndarray) -> Sparse:
        return Sparse(self.rows, self.columns, self.n, self.width, np.column_stack((self.dense, column)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p)) / 4


def fit_linear(x: Sparse, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic regression; the last dense column is the intercept and is not penalised."""
    size = x.width + x.dense.shape[1]
    free = np.zeros(size, dtype=bool)
    free[-1] = True
    v = np.random.Generator(np.random.PCG64(1)).standard_normal(size)
    for _ in range(12):
        v = x.back(x.dot(v / max(np.linalg.norm(v), 1e-300)))
    rate = 1 / max(0.25 * np.linalg.norm(v) * 1.1 / max(1, x.n), 1e-9)
    w = z = np.zeros(size)
    momentum = 1.0
    for _ in range(steps):
        step = z - rate * x.back(_sigmoid(x.dot(z)) - y) / max(1, x.n)
        new = np.where(free, step, np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


class Chain:
    """A fitted chain: the kept features and a weight vector for each category."""

    def __init__(self, kept: np.ndarray, names: tuple[str, ...]):
        self.kept, self.names, self.weights = kept, names, []
        self.used = np.zeros((1 + len(STEMS)) << BITS, dtype=bool)
        self.used[kept // KINDS] = True

    def rows(self, texts: list[bytes]) -> Sparse:
        row, feature = present(texts, self.used)
        return self.sparse(row, feature, len(texts))

    def sparse(self, row: np.ndarray, bucket: np.ndarray, n: int) -> Sparse:
        at = np.searchsorted(self.kept, bucket)
        at[at == len(self.kept)] = 0
        found = self.kept[at] == bucket if len(self.kept) else np.zeros(len(bucket), dtype=bool)
        return Sparse(row[found], at[found], n, len(self.kept), np.ones((n, 1)))

    def fit(self, x: Sparse, labels: np.ndarray, fold: np.ndarray) -> Chain:
        """``labels``: a column of 0/1 for each category; ``fold``: 0 to INNER - 1 for each row."""
        for k in range(labels.shape[1]):
            y = labels[:, k]
            out_of_fold = np.zeros(x.n)
            if k < labels.shape[1] - 1:
                for f in range(INNER):
                    held = fold == f
                    out_of_fold[held] = _sigmoid(x.part(held).dot(fit_linear(x.part(~held), y[~held])))
            self.weights.append(fit_linear(x, y))
            # probabilities go before the intercept, which stays last
            x = Sparse(x.rows, x.columns, x.n, x.width, np.column_stack((x.dense[:, :-1], _logit(out_of_fold), x.dense[:, -1:])))
        return self

    def predict(self, x: Sparse) -> np.ndarray:
        """A column of probabilities for each category."""
        out = []
        for w in self.weights:
            out.append(_sigmoid(x.dot(w)))
            x = Sparse(x.rows, x.columns, x.n, x.width, np.column_stack((x.dense[:, :-1], _logit(out[-1]), x.dense[:, -1:])))
        return np.column_stack(out)


def fit_chain(docs: DataFrame, labels: DataFrame, chain=CHAIN, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Chain:
    """Fit a chain on at most ``train_rows`` labelled rows outside the held-out fold."""
    with passing(docs.sparkSession):
        fitted = _fit_chain(docs, labels, chain, train_rows, features)
    release()  # the driver goes on without the sample
    return fitted


def _fit_chain(docs: DataFrame, labels: DataFrame, chain, train_rows: int, features: int) -> Chain:
    names = tuple(c[0] for c in chain)
    wanted = list(dict.fromkeys(c[1] for c in chain))
    chosen = training_rows(labels, wanted, train_rows)
    joined = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id")
    flags = [(F.col(column) == value).cast("int").alias(name) for name, column, value in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, bucket = present([(t or "").encode() for t in batch.column("text").to_pylist()])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(n) for n in names], pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["doc_id", *names, "words"])

    fields = ", ".join(f"{n} int" for n in names)
    found = joined.select("doc_id", "text", *flags).mapInArrow(run, f"doc_id long, {fields}, words array<int>")
    # repeated doc_ids may have more documents than labels: as many rows are kept as there may be labels
    sample = staged(found, "toxic-sample")
    if not within(sample, train_rows):
        sample = staged(sample.orderBy(F.xxhash64("doc_id"), "doc_id", *names, "words").limit(train_rows), "toxic-sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not totals["n"]:
        return Chain(np.zeros(0, dtype=np.int64), names)
    n = float(totals["n"])
    counted = sample.select(*names, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("df"), *[F.sum(c).cast("double").alias(c) for c in names])
    # chi-square of presence and label: n (n11 - df * pos / n)^2 / (df (n - df) p (1 - p)) up to constants
    gains = []
    for c in names:
        share = min(max(totals[c] / n, 1e-9), 1 - 1e-9)
        gains.append(F.pow(F.col(c) - F.col("df") * share, 2) / (F.col("df") * (1 + 1e-9 - F.col("df") / n) * share * (1 - share)))
    best = counted.where("df >= 3").select("word", (F.greatest(*gains) if len(gains) > 1 else gains[0]).alias("gain")).orderBy(F.col("gain").desc(), "word").limit(features).collect()
    kept = np.sort(np.array([r["word"] for r in best], dtype=np.int64))
    allowed = F.array(*[F.lit(int(b)) for b in kept]) if len(kept) else F.array().cast("array<int>")
    rows = sample.select("doc_id", *names, F.array_intersect("words", allowed).alias("words")).orderBy("doc_id", *names, "words").collect()
    fitted = Chain(kept, names)
    sizes = [len(r["words"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    bucket = np.array([w for r in rows for w in r["words"]], dtype=np.int64)
    labelled = np.array([[r[c] for c in names] for r in rows], dtype=np.float64)
    fold = np.array([r["doc_id"] for r in rows], dtype=np.int64)
    fold = (hashing.mix(fold.astype(np.uint64)) % np.uint64(INNER)).astype(np.int64)
    return fitted.fit(fitted.sparse(row, bucket, len(rows)), labelled, fold)


def score_documents(docs: DataFrame, labels: DataFrame, chain=CHAIN, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The chain's probabilities for every whole text: doc_id, p_<category> for each, and toxic, which says that the last
    category's probability is ``threshold`` or more.

    Labels with a null are left out, repeated ones each count; without labels all probabilities are 0.5 and nothing is
    toxic.  A null text counts as empty.  Rows with null or repeated doc_ids are scored one by one; an empty table gives
    no rows; other columns are not read.
    """
    names = tuple(c[0] for c in chain)
    fitted = fit_chain(docs, labels, chain, train_rows)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tool = model.value
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            p = tool.predict(tool.rows(texts)) if tool.weights else np.full((len(texts), len(names)), 0.5)
            toxic = p[:, -1] >= threshold if tool.weights else np.zeros(len(texts), dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(toxic)], names=["doc_id", *[f"p_{n}" for n in names], "toxic"])

    fields = ", ".join(f"p_{n} double" for n in names)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {fields}, toxic boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id no toxic row has; same columns.  Rows without doc_id are kept."""
    return without(docs, score_documents(docs, labels, **how).where("toxic").select(F.col("doc_id").alias("id")), "toxic-ids")
