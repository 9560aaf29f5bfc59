"""Repeated nested cross-validation of ridge regression.

``nested_ridge`` takes designs of any size, with missing values: a fit needs sums of products only, and a median of a training
fold comes from counts of runs of values (``order``).  ``nested_cv`` runs a table of tasks (repeat, outer fold, model), each a
group of a pandas function over the design, which is broadcast: a cohort table, bounded by DESIGN_ROWS and checked; larger
designs are refused there rather than collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.operators import order
from fieldcohort.session import staged

DESIGN_ROWS = 200_000
#: Parts of a table whose rows take long for their bytes, and bits of a value that a round of medians looks at: training sets are many.
PARTS, MEDIAN_BITS = 96, 11


@dataclass(frozen=True)
class CvConfig:
    """Settings of the validation; the defaults are the analysis's own."""

    outcome: str = "wab_aq"
    repeats: int = 20
    outer_folds: int = 5
    inner_folds: int = 4
    alphas: tuple[float, ...] = tuple(np.logspace(-4, 4, 17))
    seed: int = 2026

    def check(self, n: int) -> None:
        if self.repeats < 1 or self.outer_folds < 2 or self.inner_folds < 2 or not self.alphas or min(self.alphas) <= 0:
            raise ValueError(f"bad settings: {self}")
        if n < self.outer_folds or n - -(-n // self.outer_folds) < self.inner_folds:
            raise ValueError(f"{n} rows are too few")


def kfold(n: int, k: int, seed: int) -> np.ndarray:
    """The fold (from 0) of each row: a shuffle of the row numbers by MT19937 cut into k runs, the first n mod k longer."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    out = np.empty(n, dtype=np.int64)
    for f, part in enumerate(np.array_split(order, k)):
        out[part] = f
    return out


class Preprocess:
    """Median imputation and standardisation (population deviation), from training rows only."""

    def __init__(self, x: np.ndarray):
        if np.isnan(x).all(axis=0).any():
            raise ValueError("a feature has no value in a training fold")
        self.median = np.nanmedian(x, axis=0)
        filled = np.where(np.isnan(x), self.median, x)
        self.mean, deviation = filled.mean(axis=0), filled.std(axis=0)
        self.scale = np.where(deviation > 0, deviation, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.median, x) - self.mean) / self.scale


def ridge_path(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coefficients for every alpha, a column each, from one decomposition; x is centred, y is centred here."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    return vt.T @ (s[:, None] / (s[:, None] ** 2 + alphas[None, :]) * (u.T @ (y - y.mean()))[:, None])


def fit_fold(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, alphas: np.ndarray, inner: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Predictions of the test rows, coefficients and alpha; alpha has the least mean over inner folds of the mean absolute
    error, the first (smallest) of equals."""
    folds = kfold(len(train), min(inner, len(train)), seed)
    errors = np.zeros(len(alphas))
    for f in np.unique(folds):
        a, b = train[folds != f], train[folds == f]
        prepare = Preprocess(x[a])
        errors += np.abs(y[b][:, None] - (prepare(x[b]) @ ridge_path(prepare(x[a]), y[a], alphas) + y[a].mean())).mean(axis=0)
    best = int(np.argmin(errors))
    prepare = Preprocess(x[train])
    w = ridge_path(prepare(x[train]), y[train], alphas[best : best + 1])[:, 0]
    return prepare(x[test]) @ w + y[train].mean(), w, float(alphas[best])


def nested_cv(design: DataFrame, models: dict[str, tuple[str, ...]], config: CvConfig = CvConfig()) -> DataFrame:
    """One row for each task: repeat, outer_fold, model, alpha and arrays of the test rows' numbers, predictions and the
    coefficients.  ``design`` has ``row`` (dense, from 0), the outcome and the features.  Models share the outer folds."""
    spark = design.sparkSession
    features = sorted({f for fs in models.values() for f in fs})
    rows = design.select("row", F.col(config.outcome).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f) for f in features])
    if rows.limit(DESIGN_ROWS + 1).count() > DESIGN_ROWS:
        raise ValueError(f"a design has at most {DESIGN_ROWS} rows")
    table = rows.orderBy("row").toPandas()
    config.check(len(table))
    data = spark.sparkContext.broadcast((table["__y"].to_numpy(float), {f: table[f].to_numpy(float) for f in features}))
    alphas = np.array(sorted(config.alphas))
    schema = "repeat int, outer_fold int, model string, alpha double, rows array<int>, predicted array<double>, coefficients array<double>"

    def run(task: pd.DataFrame) -> pd.DataFrame:
        y, columns = data.value
        out = []
        for r in task.itertuples():
            seed = config.seed + 1009 * (r.repeat - 1)
            outer = kfold(len(y), config.outer_folds, seed)
            train, test = np.flatnonzero(outer != r.outer_fold - 1), np.flatnonzero(outer == r.outer_fold - 1)
            if models[r.model]:
                x = np.column_stack([columns[f] for f in models[r.model]])
                p, w, alpha = fit_fold(x, y, train, test, alphas, config.inner_folds, seed + r.outer_fold)
            else:
                p, w, alpha = np.full(len(test), y[train].mean()), np.zeros(0), 0.0
            out.append((r.repeat, r.outer_fold, r.model, alpha, test.tolist(), p.tolist(), w.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    tasks = spark.createDataFrame([(r, f, m) for r in range(1, config.repeats + 1) for f in range(1, config.outer_folds + 1) for m in models], "repeat int, outer_fold int, model string")
    return tasks.groupBy("repeat", "outer_fold", "model").applyInPandas(run, schema)


def predictions(tasks: DataFrame, design: DataFrame, outcome: str = "wab_aq") -> DataFrame:
    """The long table of predictions: keys, repeat, outer_fold, model, observed, predicted, absolute_error, alpha."""
    long = tasks.select("repeat", "outer_fold", "model", "alpha", F.explode(F.arrays_zip("rows", "predicted")).alias("p")).select("repeat", "outer_fold", "model", "alpha", F.col("p.rows").alias("row"), F.col("p.predicted").alias("predicted"))
    keys = [c for c in ("case_id", "subject", "session") if c in design.columns]
    joined = long.join(design.select("row", *keys, F.col(outcome).cast("double").alias("observed")), "row")
    return joined.select(*keys, "repeat", "outer_fold", "model", "observed", "predicted", F.abs(F.col("observed") - F.col("predicted")).alias("absolute_error"), "alpha")


def coefficients(tasks: DataFrame, models: dict[str, tuple[str, ...]]) -> DataFrame:
    """The long table of coefficients: repeat, outer_fold, model, feature, standardized_coefficient, alpha."""
    names = F.create_map(*[x for m, fs in models.items() for x in (F.lit(m), F.array(*map(F.lit, fs)) if fs else F.array().cast("array<string>"))])
    zipped = tasks.where(F.size("coefficients") > 0).withColumn("f", F.explode(F.arrays_zip(names[F.col("model")].alias("feature"), F.col("coefficients"))))
    return zipped.select("repeat", "outer_fold", "model", F.col("f.feature").alias("feature"), F.col("f.coefficients").alias("standardized_coefficient"), "alpha")


def coefficient_summary(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, median and count of each model's coefficients."""
    c = F.col("standardized_coefficient")
    return long.groupBy("model", "feature").agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.percentile(c, F.lit(0.5)).alias("median"), F.count(c).alias("n"))


# --- validation of large designs, in Spark ----------------------------------------------------------------------------


def fold_sums(df: DataFrame, features: list[str], outcome: str, folds: list[str] = ["fold"]) -> DataFrame:
    """For each fold (or cell of several kinds of folds) the sums of products that a linear fit needs, over all its rows: one
    row a fold, whatever the design."""
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(outcome).cast("double")]
    sums = [F.sum(a * b) for k, a in enumerate(terms) for b in terms[k:]]
    return df.groupBy(*folds).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("products"))


def _ridge_from_sums(products: np.ndarray, size: int, alphas: list[float]) -> list[tuple[float, list[float], list[float], list[float], float]]:
    """(alpha, means, scales, slopes on standardised features, intercept) from summed products of (1, features, outcome)."""
    full = np.zeros((size + 2, size + 2))
    full[np.triu_indices(size + 2)] = products
    return _ridge_from_gram(full + np.triu(full, 1).T, size, alphas)


def _ridge_from_gram(full: np.ndarray, size: int, alphas: list[float]) -> list[tuple[float, list[float], list[float], list[float], float]]:
    """The same from the whole matrix of products."""
    n, mean = full[0, 0], full[0, 1:] / full[0, 0]
    central = full[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(central)[:size], 0) / n)
    scale = np.where(scale > 0, scale, 1.0)
    gram, cross = central[:size, :size] / np.outer(scale, scale), central[:size, size] / scale
    fits = [np.linalg.solve(gram + a * np.eye(size), cross) if size else np.zeros(0) for a in alphas]
    return [(float(a), mean[:size].tolist(), scale.tolist(), w.tolist(), float(mean[size])) for a, w in zip(alphas, fits, strict=True)]


def fold_fits(df: DataFrame, features: list[str], outcome: str, alphas: list[float]) -> DataFrame:
    """Ridge fits on all rows outside each fold (no missing values), for every alpha: fold, alpha, means, scales, slopes,
    intercept.  Only the folds' sums leave the executors, so the design may be of any size."""
    rows = fold_sums(df, features, outcome).orderBy("fold").collect()  # a row for each fold
    total = np.sum([r["products"] for r in rows], axis=0)
    made = [(r["fold"], *fit) for r in rows for fit in _ridge_from_sums(total - np.array(r["products"]), len(features), alphas)]
    return df.sparkSession.createDataFrame(made, "fold int, alpha double, means array<double>, scales array<double>, slopes array<double>, intercept double")


def _predicted(features: list[str]) -> Column:
    """What a fit in columns (means, scales, slopes, intercept) says of a row's features."""
    out = F.col("intercept")
    for k, f in enumerate(features):
        out = out + F.get("slopes", k) * (F.col(f).cast("double") - F.get("means", k)) / F.get("scales", k)
    return out


def fold_scores(df: DataFrame, fits: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Every fit on the rows of its own fold: fold, alpha, n, mae, intercept, slopes."""
    joined = df.join(F.broadcast(fits), "fold")  # folds times alphas rows
    each = joined.groupBy("fold", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(outcome) - _predicted(features))).alias("mae"))
    return each.join(F.broadcast(fits.select("fold", "alpha", "intercept", "slopes")), ["fold", "alpha"])


def nested_sums(df: DataFrame, features: list[str], outcome: str, alphas: list[float], outer: str = "outer", inner: str = "inner") -> DataFrame:
    """Nested validation of ridge regression for designs of any size, without missing values, whose folds are columns.

    For each outer fold, alpha has the least mean over the inner folds of the mean absolute error on the rows of that inner
    fold outside the outer one (the smallest of equals); the fit on all rows outside the outer fold is scored inside it.
    Returns outer, alpha, n, mae, intercept, slopes.  The sums of the cells of both kinds of folds reach the driver (a few
    rows), fits go back by a broadcast, and errors are averaged before they are shuffled."""
    # sums of squares hold the spread only if the means are out of them
    centre = list(df.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)) for f in [*features, outcome]]).first())
    moved = df.select(outer, inner, *[(F.col(f).cast("double") - F.lit(c)).alias(f) for f, c in zip([*features, outcome], centre, strict=True)])
    cells = fold_sums(moved, features, outcome, [outer, inner]).collect()
    fits = []
    for o in sorted({r[outer] for r in cells}):
        for i in [None, *sorted({r[inner] for r in cells})]:
            products = np.sum([r["products"] for r in cells if r[outer] != o and r[inner] != i], axis=0)
            for alpha, means, scales, slopes, intercept in _ridge_from_sums(products, len(features), sorted(alphas)):
                fits.append((o, i, alpha, [m + c for m, c in zip(means, centre, strict=False)], scales, slopes, intercept + centre[-1]))
    table = df.sparkSession.createDataFrame(fits, "o int, i int, alpha double, means array<double>, scales array<double>, slopes array<double>, intercept double")
    error = F.abs(F.col(outcome) - _predicted(features))
    tuned = df.join(F.broadcast(table.where("i is not null")), (F.col(outer) != F.col("o")) & (F.col(inner) == F.col("i")))
    each = tuned.groupBy("o", "i", "alpha").agg(F.avg(error).alias("mae")).groupBy("o", "alpha").agg(F.avg("mae").alias("mae"))
    best = each.groupBy("o").agg(F.min(F.struct("mae", "alpha")).alias("best")).select("o", "best.alpha")
    final = table.where("i is null").drop("i").join(best, ["o", "alpha"])
    scored = df.join(F.broadcast(final), F.col(outer) == F.col("o"))
    return scored.groupBy(F.col("o").alias(outer), "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.first("intercept").alias("intercept"), F.first("slopes").alias("slopes"))


# --- the whole validation, for designs of any size with missing values --------------------------------------------------


def hashed_folds(key: Column, config: CvConfig) -> Column:
    """Folds of a row for ``nested_ridge``, decided by hashes of seed, repeat and key: an array over repeats of the outer fold
    and, for each outer fold, the inner fold that the row is in when that one is held out; all from 0."""

    def of(repeat: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.lit(config.outer_folds - 1)), lambda a: X.draw(F.lit(config.inner_folds), F.lit(config.seed), repeat, a, key).cast("int"))
        return F.struct(X.draw(F.lit(config.outer_folds), F.lit(config.seed), repeat, key).cast("int").alias("outer"), inner.alias("inner"))

    return F.transform(F.sequence(F.lit(1), F.lit(config.repeats)), of)


def with_hashed_folds(df: DataFrame, key: str, config: CvConfig, out: str = "folds") -> DataFrame:
    """Add the folds of each row.  A row takes over a hundred hashes but few bytes, so rows are dealt to PARTS tasks, whatever
    their size, before they are hashed."""
    return df.repartition(PARTS, key).withColumn(out, hashed_folds(F.col(key), config))


@dataclass
class _Design:
    """Columns of a design as terms of linear models: 1, each feature less its mean (missing: 0), an indicator for each feature
    that has gaps, and the outcome less its mean.  An imputed feature is a sum of its term and a multiple of its indicator."""

    rows: DataFrame
    features: list[str]
    gaps: list[int]
    centre: np.ndarray

    @property
    def size(self) -> int:
        return 1 + len(self.features) + len(self.gaps)

    def terms(self) -> list[Column]:
        x = [F.coalesce(F.col(f"x{k}") - F.lit(float(self.centre[k])), F.lit(0.0)) for k in range(len(self.features))]
        return [F.lit(1.0), *x, *[F.col(f"x{k}").isNull().cast("double") for k in self.gaps], F.col("y") - F.lit(float(self.centre[-1]))]

    def imputed(self, medians: np.ndarray) -> np.ndarray:
        """The matrix from terms to (1, imputed features, outcome)."""
        p = len(self.features)
        out = np.zeros((self.size + 1, p + 2))
        out[: p + 1, : p + 1], out[-1, -1] = np.eye(p + 1), 1
        for j, k in enumerate(self.gaps):
            out[1 + p + j, 1 + k] = medians[j] - self.centre[k]
        return out


def _design(df: DataFrame, features: list[str], outcome: str, folds: str) -> _Design:
    rows = df.select(X.finite(F.col(outcome)).alias("y"), *[X.finite(F.col(f)).alias(f"x{k}") for k, f in enumerate(features)], F.col(folds).alias("folds")).where("y is not null")
    # read by every pass of a validation: folds are hashed once
    rows = staged(rows, "design")
    seen = rows.agg(F.count("y").alias("n"), F.avg("y").alias("y"), *[F.count(f"x{k}").alias(f"n{k}") for k in range(len(features))], *[F.avg(f"x{k}").alias(f"x{k}") for k in range(len(features))]).first()
    if not seen["n"] or any(not seen[f"n{k}"] for k in range(len(features))):
        raise ValueError("a design has rows, and each feature values")
    gaps = [k for k in range(len(features)) if seen[f"n{k}"] < seen["n"]]
    return _Design(rows, features, gaps, np.array([seen[f"x{k}"] for k in range(len(features))] + [seen["y"]]))


def _held_out(rows: DataFrame, *columns: Column) -> DataFrame:
    """repeat, outer, inner and ``columns`` of each row, once for each outer fold of each repeat that it trains for."""
    each = rows.select("*", F.posexplode("folds").alias("repeat", "f")).select("*", F.posexplode("f.inner").alias("outer", "inner"))
    return each.where("outer <> f.outer").select("repeat", "outer", "inner", *columns)


def _medians(design: _Design, inner: int) -> dict:
    """The median of each feature with gaps in each training set: (repeat, outer, held-out inner fold or None, feature)."""
    if not design.gaps:
        return {}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"x{k}").alias("v")) for k in design.gaps])).alias("g")
    long = design.rows.select("folds", values).select("folds", "g.feature", "g.v")
    sets = lambda c: [(c[0], c[1], b, c[3]) for b in [None, *range(inner)] if b != c[2]]
    spread = lambda rows: _held_out(rows, *[F.col(c) for c in rows.columns if c != "folds"])
    size, got = order.order_statistics(long, "v", ["repeat", "outer", "inner", "feature"], sets, lambda n: order.around(n, 0.5)[:2], spread, MEDIAN_BITS)
    return {key: order.interpolated(got, key, n, 0.5) for key, n in size.items()}


def _fit_terms(design: _Design, products: np.ndarray, medians: np.ndarray, picked: list[int], alphas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """For each alpha: what a term adds to a prediction (of the outcome less its mean), and slopes on standardised features."""
    a = design.imputed(medians)
    take = [0, *[1 + k for k in picked], a.shape[1] - 1]
    full = (a.T @ products @ a)[np.ix_(take, take)]
    fits = _ridge_from_gram(full, len(picked), alphas)
    out = np.zeros((len(alphas), design.size))
    for row, (_, means, scales, slopes, intercept) in zip(out, fits, strict=True):
        raw = np.array(slopes) / np.array(scales)
        beta = np.zeros(a.shape[1])
        beta[take[:-1]] = [intercept - raw @ np.array(means), *raw]
        row[:] = (a @ beta)[:-1]
    return out, np.array([f[3] for f in fits])


def nested_ridge(df: DataFrame, models: dict[str, tuple[str, ...]], config: CvConfig, folds: str = "folds") -> tuple[DataFrame, DataFrame]:
    """Repeated nested validation of ridge regression for designs of any size, with missing values.

    ``folds`` is a column as ``hashed_folds`` makes it.  In each training set features with gaps get the median of that set,
    and features are standardised by it (population deviation).  For each repeat, outer fold and model, alpha has the least
    mean over inner folds of the mean absolute error, the smallest of equals; models without features have alpha 0.

    Returns the fits (repeat, outer, model, alpha, coefficients on standardised features) and the sums of their errors on the
    held-out rows (repeat, outer, model, n, absolute, squared, and sums of observed and predicted less the outcome's mean), from
    which ``scores`` makes metrics.  Rows without an outcome take no part.  Sums by fold, and medians, reach the driver; their
    number depends on repeats, folds and features alone.  Fits go back by a broadcast, errors are summed where the rows are.
    """
    spark = df.sparkSession
    features = sorted({f for fs in models.values() for f in fs})
    names, alphas = list(models), sorted(config.alphas)
    picked = [[features.index(f) for f in models[m]] for m in names]
    design = _design(df, features, config.outcome, folds)
    size, inner = design.size, config.inner_folds
    terms = design.terms()
    upper = np.triu_indices(size + 1)
    sums = _held_out(design.rows, F.array(*terms).alias("t")).groupBy("repeat", "outer", "inner").agg(F.array(*[F.sum(F.get("t", int(i)) * F.get("t", int(j))) for i, j in zip(*upper, strict=True)]).alias("s"))
    cells: dict = {}
    for r in sums.collect():  # a row for each repeat, outer and inner fold
        full = np.zeros((size + 1, size + 1))
        full[upper] = r["s"]
        cells[r["repeat"], r["outer"], r["inner"]] = full + np.triu(full, 1).T
    medians = _medians(design, inner)

    def fit(r: int, a: int, b: int | None, m: int, at: list[float]) -> tuple[np.ndarray, np.ndarray]:
        parts = [cells[r, a, c] for c in range(inner) if c != b and (r, a, c) in cells]
        if not parts or any((r, a, b, k) not in medians for k in design.gaps):
            raise ValueError("a training fold has no rows, or a feature no value in it")
        return _fit_terms(design, np.sum(parts, axis=0), np.array([medians[r, a, b, k] for k in design.gaps]), picked[m], at)

    places = list(product(range(config.repeats), range(config.outer_folds)))
    tune = {(r, a, b): np.vstack([fit(r, a, b, m, alphas)[0] for m in range(len(names)) if picked[m]] or [np.zeros((0, size))]) for r, a in places for b in range(inner)}
    errors = _tuning_errors(design, tune, config)
    fits, final = [], {}
    tuned = [m for m in range(len(names)) if picked[m]]
    for r, a in places:
        mean = np.mean([errors[r, a, b] for b in range(inner) if (r, a, b) in errors], axis=0).reshape(len(tuned), len(alphas))
        betas = []
        for m, name in enumerate(names):
            alpha = alphas[int(np.argmin(mean[tuned.index(m)]))] if picked[m] else 0.0
            beta, slopes = fit(r, a, None, m, [alpha])
            betas.append(beta[0])
            fits.append((r + 1, a + 1, name, float(alpha), slopes[0].tolist()))
        final[r, a] = np.array(betas)
    table = spark.createDataFrame(fits, "repeat int, outer int, model string, alpha double, coefficients array<double>")
    return table, _held_out_sums(design, final, names)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, outcome, outer folds (rows by repeats) and inner folds (rows by repeats by outer folds) of Arrow batches."""
    for batch in batches:
        if n := batch.num_rows:
            t = batch.column("t").flatten().to_numpy().reshape(n, size + 1)
            outer = batch.column("outer").flatten().to_numpy().reshape(n, -1)
            yield t[:, :size], t[:, size], outer, batch.column("inner").flatten().to_numpy().reshape(n, outer.shape[1], -1)


def _arrays(design: _Design) -> DataFrame:
    return design.rows.select(F.array(*design.terms()).alias("t"), F.transform("folds", lambda f: f["outer"]).alias("outer"), F.flatten(F.transform("folds", lambda f: f["inner"])).alias("inner"))


def _tuning_errors(design: _Design, fits: dict, config: CvConfig) -> dict:
    """The mean absolute error of each fit (repeat, outer, inner; one after the other) on the rows of its inner fold."""
    data, size = design.rows.sparkSession.sparkContext.broadcast(fits), design.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for t, y, outer, inner in _batches(batches, size):
            for (r, a, b), beta in data.value.items():
                rows = np.flatnonzero((outer[:, r] != a) & (inner[:, r, a] == b))
                if len(rows) and len(beta):
                    off = np.abs(y[rows][:, None] - t[rows] @ beta.T).sum(axis=0)
                    n, seen = total.get((r, a, b), (0, 0.0))
                    total[r, a, b] = n + len(rows), seen + off
        keys = sorted(total)
        columns = [pa.array([k[j] for k in keys], pa.int32()) for j in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.float64()))], names=["repeat", "outer", "inner", "n", "off"])

    got = _arrays(design).mapInArrow(run, "repeat int, outer int, inner int, n long, off array<double>")
    one = got.select("repeat", "outer", "inner", "n", F.posexplode("off").alias("k", "off")).groupBy("repeat", "outer", "inner", "k").agg((F.sum("off") / F.sum("n")).alias("mae"))
    each = one.groupBy("repeat", "outer", "inner").agg(F.array_sort(F.collect_list(F.struct("k", "mae"))).alias("mae"))  # as many as models times alphas
    return {(r["repeat"], r["outer"], r["inner"]): np.array([x["mae"] for x in r["mae"]]) for r in each.collect()}


def _held_out_sums(design: _Design, fits: dict, names: list[str]) -> DataFrame:
    data, size = design.rows.sparkSession.sparkContext.broadcast(fits), design.size
    fields = ["n", "absolute", "squared", "s_y", "s_yy", "s_p", "s_pp", "s_yp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for t, y, outer, _ in _batches(batches, size):
            for (r, a), beta in data.value.items():
                rows = np.flatnonzero(outer[:, r] == a)
                if len(rows):
                    o, p = y[rows][:, None], t[rows] @ beta.T
                    e = o - p
                    sums = [np.full(len(names), float(len(rows))), np.abs(e).sum(axis=0), (e * e).sum(axis=0), np.repeat(o.sum(), len(names)), np.repeat((o * o).sum(), len(names)), p.sum(axis=0), (p * p).sum(axis=0), (o * p).sum(axis=0)]
                    total[r, a] = total.get((r, a), 0) + np.array(sums)
        keys = [(r, a, m) for r, a in sorted(total) for m in range(len(names))]
        columns = [pa.array([r + 1 for r, _, _ in keys], pa.int32()), pa.array([a + 1 for _, a, _ in keys], pa.int32()), pa.array([names[m] for _, _, m in keys], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([float(total[r, a][j, m]) for r, a, m in keys], pa.float64()) for j in range(len(fields))]], names=["repeat", "outer", "model", *fields])

    got = _arrays(design).mapInArrow(run, "repeat int, outer int, model string, " + ", ".join(f"{f} double" for f in fields))
    return got.groupBy("repeat", "outer", "model").agg(F.sum("n").cast("long").alias("n"), *[F.sum(f).alias(f) for f in fields[1:]])


def scores(sums: DataFrame, groups: list[str]) -> DataFrame:
    """n, mae, rmse, r2 and pearson_r for each group from the sums of ``nested_ridge``."""
    added = sums.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("n", "absolute", "squared", "s_y", "s_yy", "s_p", "s_pp", "s_yp")])
    n = F.col("n")
    yy, pp, yp = (F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n for a, b in ("yy", "pp", "yp"))
    return added.select(
        *groups, "n", (F.col("absolute") / n).alias("mae"), F.sqrt(F.col("squared") / n).alias("rmse"), (1 - F.try_divide(F.col("squared"), yy)).alias("r2"),
        F.when((yy > 1e-12 * n) & (pp > 1e-12 * n), yp / F.sqrt(yy * pp)).alias("pearson_r"),
    )
