"""Associations, partial rank correlations, paired comparisons, agreement of two pipelines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.functions import special
from fieldcohort.operators import contracts as C
from fieldcohort.operators import bootstrap, resample, stats
from fieldcohort.session import staged

#: name -> (first variable, second variable); outcome stands for the configured one. Fixed values.
OUTCOME = "outcome"
ASSOCIATIONS = {
    "lesion_volume_vs_aq": ("lesion_volume_ml", OUTCOME),
    "magnitude_vs_lesion_volume": ("me_mass_effect_3_20mm_magnitude_mm_median", "lesion_volume_ml"),
    "absolute_radial_vs_lesion_volume": ("me_mass_effect_3_20mm_mean_absolute_radial_mm", "lesion_volume_ml"),
    "magnitude_vs_registration_sensitivity": ("me_mass_effect_3_20mm_magnitude_mm_median", "me_registration_sensitivity_3_20mm_mm_median"),
    "absolute_radial_vs_registration_sensitivity": ("me_mass_effect_3_20mm_mean_absolute_radial_mm", "me_registration_sensitivity_3_20mm_mm_median"),
    "magnitude_vs_aq": ("me_mass_effect_3_20mm_magnitude_mm_median", OUTCOME),
    "absolute_radial_vs_aq": ("me_mass_effect_3_20mm_mean_absolute_radial_mm", OUTCOME),
    "radial_direction_vs_aq": ("me_mass_effect_3_20mm_radial_mm_median", OUTCOME),
    "hodge_total_rms_vs_lesion_volume": ("hhd_total_rms_mm", "lesion_volume_ml"),
    "hodge_total_rms_vs_aq": ("hhd_total_rms_mm", OUTCOME),
    "hodge_curl_free_fraction_vs_aq": ("hhd_curl_free_energy_fraction", OUTCOME),
    "hodge_divergence_free_fraction_vs_aq": ("hhd_divergence_free_energy_fraction", OUTCOME),
}


def long_pairs(design: DataFrame, named: dict[str, tuple[str, str]], key: str, outcome: str) -> DataFrame:
    """(name, key, x, y) for the named pairs whose columns exist; rows with a missing value are left out, and with them
    pairs that have none."""
    pick = {n: tuple(outcome if c == OUTCOME else c for c in pair) for n, pair in named.items()}
    there = {n: p for n, p in pick.items() if all(c in design.columns for c in p)}
    rows = F.array(*[F.struct(F.lit(n).alias("association"), X.finite(F.col(a)).alias("x"), X.finite(F.col(b)).alias("y")) for n, (a, b) in there.items()])
    return design.select(key, F.explode(rows).alias("r")).select("r.association", key, "r.x", "r.y").where("x is not null and y is not null")


def associations(design: DataFrame, outcome: str, key: str = "row", named: dict | None = None, replicates: int = 5000, seed: int = 1) -> DataFrame:
    """Spearman's rho of each named pair with bootstrap percentiles, p and Holm-adjusted p over the pairs tested."""
    pairs = long_pairs(design, named or ASSOCIATIONS, key, outcome)
    rho = stats.spearman(pairs, "x", "y", ["association"])
    ci = resample.bootstrap_spearman(pairs, "x", "y", ["association"], key, replicates, seed)
    tested = rho.join(ci, "association").withColumn("p_value", special.p_of_correlation(F.col("rho"), F.col("n")))
    return stats.holm(tested.withColumn("family", F.lit(1)), "p_value", ["family"], "association", "p_value_holm").drop("family")


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.column_stack([pd.Series(c).rank().to_numpy() for c in x.T])


def partial_rank(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Correlation of the rank residuals of columns 0 and 1 given the ranks of the others, and those residuals."""
    r = _ranks(x)
    q, _ = np.linalg.qr(np.column_stack((np.ones(len(r)), r[:, 2:])))
    a, b = (c - q @ (q.T @ c) for c in (r[:, 0], r[:, 1]))
    spread = np.sqrt((a @ a) * (b @ b))
    if not spread > 1e-9 * max(1.0, float((r**2).sum())):
        raise ValueError("a partial rank correlation is undefined")
    return float(a @ b / spread), a, b


def adjusted_associations(design: DataFrame, exposures: dict[str, str], outcome: str, covariates: tuple[str, ...], replicates: int = 5000, seed: int = 1) -> DataFrame:
    """Partial rank correlation of each exposure with the outcome given the covariates: bootstrap percentiles (ranked anew in
    every draw; under 99 % defined ones raise), residual-permutation p and Holm's adjustment.  Replicates are shared by many
    tasks (``bootstrap.partial_rank_draws``)."""
    columns = [outcome, *covariates]
    rows = F.array(*[F.struct(F.lit(n).alias("association"), F.lit(k).alias("number"), X.finite(F.col(e)).alias("exposure")) for k, (n, e) in enumerate(exposures.items())])
    names = [f"c{k}" for k in range(len(columns))]
    long = design.select(F.explode(rows).alias("r"), *[X.finite(F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)]).select("r.*", *names).dropna()
    tested = bootstrap.partial_rank_draws(long, "association", "number", ["exposure", *names], replicates, seed)
    return stats.holm(tested.withColumn("family", F.lit(1)), "p_value", ["family"], "association", "p_value_holm").drop("family")


def paired_comparisons(long: DataFrame, reference: str, models: list[str], replicates: int = 5000, seed: int = 1) -> DataFrame:
    """Each model against the reference over subjects' mean absolute errors: mean advantage with bootstrap percentiles, share
    improved, signed-rank test (zeros by Pratt's method; exact for small samples without ties) and Holm's adjustment over the models."""
    wide = stats.subject_errors(long, "subject", "model", "absolute_error", [reference, *models])
    point = stats.paired_advantage(wide, "subject", reference, models)
    d = wide.select("subject", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(reference) - F.col(m)).alias("d")) for m in models])).alias("r")).select("subject", "r.*").where("d is not null")
    ci = resample.bootstrap_mean(d, "d", ["model"], "subject", replicates, seed).select("model", "ci025", "ci975")
    test = stats.signed_rank_test(d, "d", ["model"])
    joined = point.join(ci, "model").join(test, "model").withColumn("reference", F.lit(reference))
    return stats.holm(joined, "p_value", ["reference"], "model", "p_value_holm")


def mae_inference(long: DataFrame, replicates: int = 5000, seed: int = 1) -> DataFrame:
    """Mean of subjects' mean absolute errors for each model with bootstrap percentiles and quartiles."""
    each = long.groupBy("model", "subject").agg(F.avg("absolute_error").alias("error"))
    p = F.percentile("error", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    quartiles = each.groupBy("model").agg(*[F.get(p, k).alias(n) for k, n in enumerate(("q25", "q50", "q75"))])
    return resample.bootstrap_mean(each, "error", ["model"], "subject", replicates, seed).join(quartiles, "model")


def descriptor_agreement(a: DataFrame, b: DataFrame, descriptors: list[str], key: str = "case_id", replicates: int = 5000, seed: int = 1, good: Callable | None = X.strict_true, flag: str | None = None) -> DataFrame:
    """Spearman's rho of each descriptor between two pipelines' tables over common cases that pass ``flag`` in both."""
    if flag and good:
        a, b = a.where(good(F.col(flag))), b.where(good(F.col(flag)))
    long = lambda df, v: df.select(key, *[X.finite(F.col(c)).alias(c) for c in descriptors]).unpivot([key], descriptors, "descriptor", v)
    both = long(a, "x").join(long(b, "y"), [key, "descriptor"]).dropna()
    return stats.spearman(both, "x", "y", ["descriptor"]).join(resample.bootstrap_spearman(both, "x", "y", ["descriptor"], key, replicates, seed), "descriptor")


PREDICTION_KEYS = ["case_id", "subject", "repeat", "outer_fold", "model"]


def paired_pipelines(a: DataFrame, b: DataFrame, replicates: int = 5000, seed: int = 1, baseline: str | None = None, keys: list[str] = PREDICTION_KEYS) -> DataFrame:
    """Mean difference in absolute error (b minus a) for each model over subjects, with percentiles and a signed-rank test
    (zeros dropped).  Both tables must have the same keys, once each, for common models; ``baseline`` predictions must agree
    to 1e-12 absolutely plus 1e-5 relatively."""
    side = lambda t, name: t.select(*keys, F.lit(name).alias("__side"), F.col("predicted").alias("__p"), F.col("absolute_error").alias("__e"))
    of = lambda name, c: F.max(F.when(F.col("__side") == name, F.col(c)))
    count = lambda name: F.count_if(F.col("__side") == name)
    # both tables are read once and meet in one shuffle; a row a key
    met = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg(count("a").alias("na"), count("b").alias("nb"), of("a", "__p").alias("pa"), of("b", "__p").alias("pb"), of("a", "__e").alias("ea"), of("b", "__e").alias("eb"))
    agree = F.coalesce(F.abs(F.col("pa") - F.col("pb")) <= 1e-12 + 1e-5 * F.abs("pb"), F.lit(False))
    paired = F.coalesce((F.col("na") == 1) & (F.col("nb") == 1) & F.least(*[F.col(k).isNotNull() for k in keys]), F.lit(False))
    checked = met.groupBy("model", "subject").agg(F.avg(F.col("eb") - F.col("ea")).alias("d"), F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.count_if(paired).alias("paired"), F.count_if(~agree).alias("apart"))
    checked = staged(checked, "paired")
    counts = {r["model"]: r for r in checked.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "paired", "apart")]).collect() if r["na"] and r["nb"] and r["model"] is not None}  # a row a model
    found = {sum(r[c] for r in counts.values()) for c in ("na", "nb", "paired")}
    if len(found) > 1:
        raise C.ContractError(f"predictions do not pair up: {sorted(found)}")
    if baseline in counts and counts[baseline]["apart"]:
        raise C.ContractError(f"baseline predictions: {counts[baseline]['apart']} rows differ")
    each = checked.where(F.col("model").isin(list(counts))).select("model", "subject", "d")
    test = stats.signed_rank_test(each, "d", ["model"], zeros="wilcox")
    return resample.bootstrap_mean(each, "d", ["model"], "subject", replicates, seed).join(test, "model", "left")


def variant_agreement(primary: DataFrame, variants: DataFrame, features: list[str], outcome: str, key: str = "case_id") -> DataFrame:
    """For each variant and feature: cases, rho with the primary setting, median absolute difference, rho with the outcome;
    only rows whose check passed."""
    good = variants.where(X.truthy(F.col("velocity_qc_pass")))
    old = primary.select(key, X.finite(F.col(outcome)).alias("y"), *[X.finite(F.col(f"hhd_{f}")).alias(f) for f in features]).unpivot([key, "y"], features, "feature", "p")
    new = good.select(key, "variant", *[X.finite(F.col(f)).alias(f) for f in features]).unpivot([key, "variant"], features, "feature", "v")
    both = old.join(new, [key, "feature"]).dropna()
    groups = ["variant", "feature"]
    stable = stats.spearman(both, "p", "v", groups).withColumnRenamed("rho", "rho_primary")
    outcome_rho = stats.spearman(both, "v", "y", groups).select(*groups, F.col("rho").alias("rho_outcome"))
    gap = both.groupBy(*groups).agg(F.percentile(F.abs(F.col("p") - F.col("v")), F.lit(0.5)).alias("median_abs_difference"))
    return stable.join(outcome_rho, groups).join(gap, groups)


def feature_ranges(agreement: DataFrame) -> DataFrame:
    """Least and largest agreement of each feature over the variants."""
    return agreement.groupBy("feature").agg(F.min("rho_primary").alias("minimum_rho"), F.max("rho_primary").alias("maximum_rho"), F.max("median_abs_difference").alias("maximum_difference"))


def failure_counts(variants: DataFrame) -> DataFrame:
    """How often each variant failed and why; no reason is none."""
    return variants.groupBy("variant", F.coalesce(F.nullif(F.trim("failure_reason"), F.lit("")), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def partial_rank_sums(df: DataFrame, x: str, y: str, covariates: list[str]) -> DataFrame:
    """n and the partial rank correlation of x and y given the covariates, for tables of any size: ranks from counts of
    distinct values, then sums of products of ranks, which are all that reaches the driver.  NULL where it is undefined."""
    columns = [x, y, *covariates]
    rows = df.select(F.lit(1).alias("__g"), *[X.finite(F.col(c)).alias(f"__v{k}") for k, c in enumerate(columns)]).dropna()
    for k in range(len(columns)):
        rows = stats.ranked(rows, f"__v{k}", ["__g"], f"__r{k}")
    # mean ranks of n rows are around (n + 1) / 2
    middle = (rows.count() + 1) / 2
    ranks = [F.col(f"__r{k}") - F.lit(middle) for k in range(len(columns))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(f"s{k}") for k, r in enumerate(ranks)], *[F.sum(ranks[i] * ranks[j]).alias(f"p{i}_{j}") for i in range(len(ranks)) for j in range(i, len(ranks))]).first()
    n, size = sums["n"], len(columns)
    rho = None
    if n > size:
        mean = np.array([sums[f"s{k}"] / n for k in range(size)])
        gram = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] - n * mean[i] * mean[j] for j in range(size)] for i in range(size)])
        # what the covariates explain goes out of the block of x and y
        left = gram[:2, :2] - gram[:2, 2:] @ np.linalg.lstsq(gram[2:, 2:], gram[2:, :2], rcond=None)[0] if covariates else gram
        if left[0, 0] > 1e-9 * n and left[1, 1] > 1e-9 * n:
            rho = float(left[0, 1] / np.sqrt(left[0, 0] * left[1, 1]))
    return df.sparkSession.createDataFrame([(n, rho)], "n long, partial_rho double")
