"""From manifests to a design table: contracts, joins, quality filters, optional sources.

The counts of an audit come from one conditional aggregate over the joined rows, not from an action at each step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.operators import contracts as C
from fieldcohort.operators import stats

#: Rows up to which a manifest is broadcast in joins; larger ones are joined by shuffling both sides.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class DesignConfig:
    """Settings of a design; the defaults are the analysis's own."""

    method_version: str | None = None
    outcome: str = "wab_aq"
    maximum_folding: float = 0.05
    minimum_voxels: int = 1000
    minimum_coverage: float = 0.95
    version_column: str = "method_version"
    supported_column: str = "laterality_supported"
    folding_column: str = "normalized_field_folding_fraction"
    voxels_column: str = "mass_effect_3_20mm_magnitude_mm_n_voxels"
    registration_column: str = "registration_qc_pass"


def prefix_nonkeys(df: DataFrame, prefix: str, keys: tuple[str, ...] = ("case_id", "subject", "session")) -> DataFrame:
    """Every column that is no key gets the prefix."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as finite doubles, NULL where they hold no number."""
    return df.withColumns({c: X.finite(X.to_number(F.col(c))) for c in columns if c in df.columns})


def finite_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as NULL."""
    return df.withColumns({f.name: X.finite(F.col(f.name)).cast(f.dataType) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def qc_filter(supported: Column, folding: Column, voxels: Column, registration: Column | None, maximum_folding: float = 0.05, minimum_voxels: int = 1000) -> Column:
    """Supported, little folding, enough voxels and, where given, registration passed; NULL anywhere fails."""
    good = X.truthy(supported) & (X.finite(folding) <= maximum_folding) & (X.finite(voxels) >= minimum_voxels)
    if registration is not None:
        good = good & X.truthy(registration)
    return F.coalesce(good, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def coverage(design: DataFrame, other: DataFrame, key: str = "case_id") -> float | None:
    """Share of the design's rows whose key the other table has; None for an empty design."""
    flagged = design.select(key).join(other.select(key).distinct().withColumn("__in", F.lit(1.0)), key, "left")
    return flagged.agg(F.avg(F.coalesce("__in", F.lit(0.0)))).first()[0]


def join_optional(design: DataFrame, other: DataFrame, prefix: str, minimum: float, required: bool = False, key: str = "case_id") -> tuple[DataFrame, bool]:
    """Inner join with a source of its own prefix if it covers the design; below ``minimum`` a required source raises and
    another is left out."""
    C.require_unique(other, key, f"{prefix}table")
    share = coverage(design, other, key)
    if share is None or not share >= minimum:
        if required:
            raise C.ContractError(f"{prefix}table covers {share}, less than {minimum}")
        return design, False
    return design.join(small(prefix_nonkeys(other.drop("subject", "session"), prefix)), key), True


def build_design(manifest: DataFrame, clinical: DataFrame, config: DesignConfig = DesignConfig(), uncertainty: DataFrame | None = None, hodge: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The design table, ordered by subject and case with a dense ``row`` index, and the audit counts.

    The imaging columns get ``me_``, uncertainty ``unc_``, decompositions ``hhd_``.  NULL keys join nothing and are refused
    by the uniqueness contracts if repeated; one case for each subject must be left."""
    if "subject" not in clinical.columns and "participant_id" in clinical.columns:
        clinical = clinical.withColumnRenamed("participant_id", "subject")
    C.require_unique(manifest, "case_id", "manifest")
    C.require_unique(clinical, "case_id", "clinical table")
    C.require_columns(clinical, ["subject", config.outcome], "clinical table")
    if config.method_version is not None:
        C.require_version(manifest, config.version_column, config.method_version, "manifest")
    imaging = prefix_nonkeys(manifest.drop("subject", "session") if "subject" in clinical.columns else manifest, "me_")
    joined = clinical.join(small(imaging), "case_id")
    registration = F.col(f"me_{config.registration_column}") if f"me_{config.registration_column}" in joined.columns else None
    good = qc_filter(F.col(f"me_{config.supported_column}"), F.col(f"me_{config.folding_column}"), F.col(f"me_{config.voxels_column}"), registration, config.maximum_folding, config.minimum_voxels)
    numeric = [c for c in (config.outcome, "wab_days", "age_at_stroke") if c in joined.columns]
    joined = finite_numbers(coerced(joined.withColumn("__good", good), numeric))
    if "wab_days" in joined.columns:
        joined = joined.withColumn("log1p_wab_days", F.log1p("wab_days"))
    has = F.col(config.outcome).isNotNull()
    counts = joined.agg(F.count(F.lit(1)).alias("joined"), F.count_if("__good").alias("qc_pass"), F.count_if(F.col("__good") & has).alias("with_outcome")).first()
    design = joined.where(F.col("__good") & has).drop("__good")
    audit = counts.asDict() | {"registration_qc_used": registration is not None, "uncertainty_used": False, "hodge_used": False}
    if uncertainty is not None:
        design, audit["uncertainty_used"] = join_optional(design, uncertainty, "unc_", config.minimum_coverage)
    if hodge is not None:
        passing = hodge.where(X.truthy(F.col("velocity_qc_pass")))
        design, audit["hodge_used"] = join_optional(design, passing, "hhd_", config.minimum_coverage, required=True)
    C.require_unique(design, "subject", "design")
    return stats.dense_index(finite_numbers(design), ["subject", "case_id"], "row"), audit


def manifest_report(manifest: DataFrame) -> DataFrame:
    """One row: cases, subjects, QC passes and failures (fixed limits, no registration term) and counts by side."""
    good = qc_filter(F.col("laterality_supported"), F.col("normalized_field_folding_fraction"), F.col("mass_effect_3_20mm_magnitude_mm_n_voxels"), None, 0.05, 1000)
    side = lambda s: F.count_if(F.col("lesion_side") == s).alias(f"side_{s}")
    return manifest.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("subject").alias("subjects"), F.count_if(good).alias("qc_pass"), F.count_if(~good).alias("qc_fail"), side("left"), side("right"), side("bilateral"))


def compare_features(current: DataFrame, legacy: DataFrame, key: str, features: list[str], tolerance: float = 1e-10) -> DataFrame:
    """For each feature of two tables of equal keys: comparable values, values missing on one side only, differences above
    the tolerance, and the largest difference (0 where there is none)."""
    C.require_same_keys(current, legacy, key)
    long = lambda df, out: df.select(key, *[X.finite(F.col(c)).alias(c) for c in features]).unpivot([key], features, "feature", out)
    both = long(current, "new").join(long(legacy, "old"), [key, "feature"])
    gap = F.abs(F.col("new") - F.col("old"))
    return both.groupBy("feature").agg(F.count(gap).alias("comparable"), F.count_if(F.col("new").isNull() != F.col("old").isNull()).alias("one_sided"), F.count_if(gap > tolerance).alias("above_tolerance"), F.coalesce(F.max(gap), F.lit(0.0)).alias("largest"))
