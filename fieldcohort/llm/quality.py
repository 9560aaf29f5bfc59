"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Boosting goes round the features; each turn fits a shallow tree to one feature's
bins (three leaves at most) and adds it to the feature's lookup table.  Then pairs of features are ranked by what a
table over both would gain, and the best pairs get tables of their own in the same way.  A score is a sum of looked-up
values, one for each feature and pair, so scoring is a few vectorised additions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm.common import crc32_fold, slices

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 150, 60, 0.1

FEATURES = ("log_bytes", "log_words", "word_length", "long_words", "distinct_words", "top_word", "letters", "digits", "marks", "symbols", "upper", "blank", "wide", "log_lines", "words_a_line", "repeated_lines", "mark_ends", "bare_words", "short_lines")
_CLASS = np.zeros((256, 6), dtype=np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_b < 128 and _c.isalpha(), _b < 128 and _c.isdigit(), _c in ".,;:!?'\"()-", _b < 128 and 32 < _b and not _c.isalnum() and _c not in ".,;:!?'\"()-", _b < 128 and _c.isupper(), _b in (9, 10, 13, 32)]


def features(text: str) -> list[float]:
    """The features of one whole text; those of an empty text are zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters, digits, marks, symbols, upper, blank = (counts @ _CLASS / n).tolist()
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    tails = bytes([w[-1] for w in words])
    ends = sum(tails.count(c) for c in b".,;:!?")
    odd = sum(c < 128 and not 97 <= c | 32 <= 122 and c not in b".,;:!?'\")" for c in tails)
    tally = Counter(words)
    top = max(tally.values(), default=0)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float((lengths > 14).mean()) if len(words) else 0.0,
        len(tally) / m**0.9, top / m, letters, digits, marks, symbols, upper, blank, float(counts[128:].sum()) / n,
        float(np.log1p(k)), len(words) / k, 1 - len(set(lines)) / k, ends / m, odd / m, sum(len(x) < 20 for x in lines) / k,
    ]


@dataclass
class Model:
    """Lookup tables of a fitted model."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows of features."""
        total = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values of a tree of up to ``leaves`` leaves over ordered bins, from the bins' gradients and curvatures."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                j = int(gain.argmax())
                best = max(best, (float(gain[j]), int(k[j])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values of a tree over a grid - one cut of one axis, then a cut of the other on each side - and its gain."""
    found = (np.zeros_like(g), 0.0)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(a)):
            halves, gain = [], 0.0
            for part in (slice(0, k), slice(k, None)):
                gp, hp = a[part].sum(axis=0), b[part].sum(axis=0)
                value = _tree(gp, hp, 2)
                gain += float((value * gp).sum())
                halves.append(np.repeat(value[None], len(a[part]), axis=0))
            if gain > found[1]:
                grid = np.concatenate(halves)
                found = (grid if axis == 0 else grid.T, gain)
    return found


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit a model to rows of features and their labels (0 or 1)."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    edges, pair_edges = ([_edges(x[:, j], n) for j in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    bins, pair_bins = ([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(es)] for es in (edges, pair_edges))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            size = len(table)
            step = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), 3)
            table += step
            total += step[bins[j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        return np.bincount(pair_bins[i] * b + pair_bins[j], v, a * b).reshape(a, b)

    p = 1 / (1 + np.exp(-total))
    gains = {(i, j): _tree2(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1] for i, j in combinations(range(x.shape[1]), 2)}
    pairs = [k for k in sorted(gains, key=lambda k: -gains[k])[:PAIRS] if gains[k] > 0]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree2(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0]
            table += step
            total += step[pair_bins[i], pair_bins[j]]
    return Model(edges, base, tables, pairs, pair_edges, pair_tables)


def training_rows(labels: DataFrame, columns: list[str], most: int = TRAIN_ROWS) -> DataFrame:
    """Up to ``most`` labelled rows outside the held-out fold, those with the smallest hashes of their doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & (crc32_fold(F.col("doc_id"), FOLDS) != 0)).select(F.col("doc_id").cast("long"), *columns)
    return rows.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", *[c.split(" ")[-1] for c in columns]).limit(most)


def _features_of(docs: DataFrame, extra: str = "") -> DataFrame:
    names = [x.split()[0] for x in extra.split(",") if x.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])

    return docs.mapInArrow(run, f"{extra}, x array<double>")


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (likelihood of quality 1), predicted.

    Labels come only from rows with crc32(doc_id) mod 5 other than 0, at most ``train_rows`` of them and of the documents that
    they meet; null labels are left out, repeated ones each count.  Without any label all scores are 0.5.  A null text scores as an empty one.  A null
    doc_id is scored, held_out false.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chosen = training_rows(labels, ["quality"], train_rows)
    # repeated doc_ids may have more documents than labels: those with the smallest hashes are taken
    sample = _features_of(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int")), "doc_id long, quality int")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(train_rows).collect()
    y = np.array([r["quality"] for r in sample], dtype=np.float64)
    x = np.array([r["x"] for r in sample], dtype=np.float64).reshape(len(sample), len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, (y > 0).astype(np.float64)) if len(y) else Model([], 0.0, [], [], [], []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.value.score(np.array([features(t or "") for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    scored = docs.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc32_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
