"""Kernels over tables of cases: one row for each case, volumes as arrays, results as columns.

Volumes are array columns or, smaller and faster, bytes: little-endian single precision in C order, masks a byte for each voxel.
Spark cuts the batches that Python gets by their bytes (64 MB unless the session says otherwise), so that large volumes come
one by one; results go back case by case.  Cases are independent, so a lost executor costs the cases it was working on.
case_id may have any type; results have the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fieldcohort.operators import kernels as K
from fieldcohort.sources.report import strict_json

#: Columns of a decomposition. Fixed values.
HODGE_SCHEMA = (
    "stride int, padding int, boundary_taper_width_voxels double, displacement_smoothing_sigma_voxels double, velocity_squaring_steps int, velocity_maximum_iterations int, "
    "velocity_reconstruction_tolerance double, valid_downsampled_voxels long, total_rms_mm double, curl_free_energy_fraction double, divergence_free_energy_fraction double, "
    "harmonic_energy_fraction double, curl_free_rms_mm double, divergence_free_rms_mm double, harmonic_rms_mm double, hodge_reconstruction_relative_rmse double, velocity_log_iterations int, "
    "velocity_reconstruction_relative_rmse double, displacement_minimum_jacobian double, velocity_reconstruction_minimum_jacobian double, velocity_qc_pass boolean, energy_fraction_sum double, taper_mean_on_valid_domain double"
)
HODGE_COLUMNS = [x.split()[0] for x in HODGE_SCHEMA.split(", ")]


#: Result rows, and bytes of their arrays and files, that are handed back together.
ROWS, BYTES = 256, 8 << 20


def _size(value: object) -> int:
    if isinstance(value, list):
        return sum(_size(v) for v in value)
    if isinstance(value, dict):
        return sum(_size(v) for v in value.values())
    return value.nbytes if isinstance(value, np.ndarray) else len(value) if isinstance(value, bytes | str) else 8


def map_cases(df: DataFrame, run: Callable[[dict], dict | list[dict]], schema: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """The result rows of each case row (``run`` gives one or a list): ``keys`` as they are in ``df``, then ``schema``."""
    names = [*keys, *[x.split()[0] for x in schema.split(", ")]]

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, size = [], 0
        for part in parts:
            for k in range(len(part)):
                row = part.iloc[k].to_dict()
                got = run(row)
                got = got if isinstance(got, list) else [got]
                made += [{key: row[key] for key in keys} | r for r in got]
                size += _size(got)
                if len(made) >= ROWS or size >= BYTES:
                    yield pd.DataFrame(made, columns=names)
                    made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=names)

    return df.mapInPandas(over, ", ".join([*[f"`{key}` {df.schema[key].dataType.simpleString()}" for key in keys], schema]))


def field(row: dict, name: str = "field", last: int = 3) -> np.ndarray:
    """The array of a row, in the shape that the row gives."""
    shape = (*[int(n) for n in row["shape"]], *([last] if last else []))
    if isinstance(row[name], bytes | bytearray):
        return np.frombuffer(row[name], dtype="<f4" if last else np.uint8).reshape(shape)
    return np.asarray(row[name], dtype=np.float32).reshape(shape)


Loader = Callable[[dict], tuple[np.ndarray, np.ndarray, tuple[float, float, float] | None]]


def stored(row: dict) -> tuple[np.ndarray, np.ndarray, None]:
    """Field and mask of a row that holds them as columns."""
    return field(row), field(row, "valid", 0).astype(bool), None


def decomposed(row: dict, config: K.HodgeConfig, spacing: tuple[float, float, float], isolate: bool, load: Loader = stored) -> dict:
    """Decomposition scalars of a case row; with ``isolate`` a field that folds gives a row that fails its check."""
    nothing = dict.fromkeys(HODGE_COLUMNS) | {"failure_reason": None}
    u, valid, own = load(row)
    try:
        return nothing | K.hodge_features(u, valid, own or spacing, config)
    except K.NonPositiveJacobian:
        if not isolate:
            raise
        return nothing | {"stride": config.stride, "padding": config.padding, "velocity_qc_pass": False, "failure_reason": "nonpositive_jacobian"}


def hodge(df: DataFrame, config: K.HodgeConfig = K.HodgeConfig(), spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), isolate: bool = False, load: Loader = stored, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Decomposition scalars of (case_id, shape, field, valid), or of rows that ``load`` makes a field, a mask and a spacing
    of.  With ``isolate`` a field that folds becomes a row that fails its check, with the reason; any other error ends the
    job."""
    return map_cases(df, lambda row: decomposed(row, config, spacing, isolate, load), f"{HODGE_SCHEMA}, failure_reason string", keys)


def sensitivity_variants(base: K.HodgeConfig = K.HodgeConfig()) -> dict[str, K.HodgeConfig]:
    """One-factor changes of the settings; the grid variants keep the physical taper and smoothing widths."""
    mm = 4.0  # of the base grid

    def grid(step: int, padding: int) -> K.HodgeConfig:
        return replace(base, stride=step, padding=padding, taper=base.taper * mm / step, sigma=base.sigma * mm / step)

    changes = {"smoothing_8mm": {"sigma": 8 / mm}, "smoothing_12mm": {"sigma": 12 / mm}, "taper_12mm": {"taper": 12 / mm}, "taper_20mm": {"taper": 20 / mm}, "padding_16mm": {"padding": 4}, "padding_32mm": {"padding": 8}}
    return {k: replace(base, **v) for k, v in changes.items()} | {"grid_3mm": grid(3, 8), "grid_5mm": grid(5, 5)}


def hodge_sensitivity(df: DataFrame, variants: dict[str, K.HodgeConfig] | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), load: Loader = stored) -> DataFrame:
    """Every case under every variant, folding cases as failed rows: (variant, case_id, scalars, failure_reason).  A case's
    volumes are taken up once for all variants."""
    variants = variants if variants is not None else sensitivity_variants()

    def run(row: dict) -> list[dict]:
        taken = load(row)
        return [{"variant": name} | decomposed(row, config, spacing, True, lambda _: taken) for name, config in variants.items()]

    found = map_cases(df, run, f"variant string, {HODGE_SCHEMA}, failure_reason string")
    return found.select("variant", "case_id", *HODGE_COLUMNS, "failure_reason")


def flow_log(df: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), **how) -> DataFrame:
    """Logarithm of (case_id, shape, field): iterations, error, Jacobians and the velocity."""

    def run(row: dict) -> dict:
        got = K.logarithm(field(row), spacing, **how)
        return {"iterations": got.iterations, "relative_rmse": got.relative_rmse, "minimum_jacobian": got.minimum_jacobian, "reconstruction_minimum_jacobian": got.reconstruction_minimum_jacobian, "velocity": got.velocity.ravel()}

    return map_cases(df, run, "iterations int, relative_rmse double, minimum_jacobian double, reconstruction_minimum_jacobian double, velocity array<float>")


def flow_exp(df: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), squarings: int = 6) -> DataFrame:
    """Exponential of (case_id, shape, field)."""
    return map_cases(df, lambda row: {"field": K.exponential(field(row), spacing, squarings).ravel()}, "field array<float>")


def affine_fits(df: DataFrame, subsample: int = 1, minimum: int = 4, rounds: int = K.ROUNDS) -> DataFrame:
    """Robust affine fit of (case_id, shape, field as coordinates, valid)."""

    def run(row: dict) -> dict:
        fit = K.robust_affine(field(row).astype(np.float64), field(row, "valid", 0).astype(bool), subsample, minimum, rounds)
        return {"coefficients": fit.coefficients.ravel(), "rmse": fit.rmse, "points": fit.points, "inliers": fit.inliers}

    return map_cases(df, run, "coefficients array<double>, rmse double, points int, inliers double")


# --- extraction ------------------------------------------------------------------------------------------------------

#: Distance shells in mm. Fixed values.
SHELLS = ((3.0, 5.0), (5.0, 10.0), (10.0, 20.0), (20.0, 40.0))
NEAR = (3.0, 20.0)


def finite_summary(values: np.ndarray, prefix: str) -> dict:
    """Count, mean and percentiles of the finite values; none: count 0 and NaN."""
    v = np.asarray(values, dtype=np.float64)
    v = v[np.isfinite(v)]
    names = ("mean", "median", "p25", "p75", "p95")
    stats = [v.mean(), *np.percentile(v, [50, 25, 75, 95])] if len(v) else [np.nan] * 5
    return {f"{prefix}_n_voxels": len(v)} | {f"{prefix}_{n}": float(s) for n, s in zip(names, stats, strict=True)}


def case_metrics(lesion: np.ndarray, target: np.ndarray, norm: K.Normalized, effect: np.ndarray, logj: np.ndarray, valid: np.ndarray, spacing: tuple[float, float, float], sensitivity: np.ndarray | None = None, minimum_laterality: float = 0.8, minimum_near_mm3: float = 1000.0) -> dict:
    """The flat record of a case: laterality, volumes, fit, summaries by shell, clipped integrals, ratio and check."""
    side, index, left, right = K.laterality(lesion)
    ml = float(np.prod(spacing)) / 1000.0
    away, normal = K.distance_and_normals(lesion, spacing)
    analysis = valid & K.hemisphere(lesion.shape, side)
    maps = {"magnitude_mm": np.linalg.norm(effect.astype(np.float64), axis=-1), "radial_mm": (effect.astype(np.float64) * normal).sum(axis=-1), "log_jacobian_asymmetry": logj.astype(np.float64)}
    out = {
        "effect_field_support": "lesional_hemisphere_only",
        "contralesional_effect_value": 0.0,
        "lesion_side": side,
        "lesion_laterality_index": index,
        "laterality_supported": bool(index >= minimum_laterality),
        "lesion_left_voxels_atlas": left,
        "lesion_right_voxels_atlas": right,
        "lesion_volume_atlas_ml": float(lesion.sum() * ml),
        "inpainting_target_volume_atlas_ml": float(target.sum() * ml),
        "valid_analysis_volume_ml": float(analysis.sum() * ml),
        "contralateral_affine_fit_rmse_mm": norm.rmse_mm,
        "contralateral_affine_fit_points": norm.fit.points,
        "contralateral_affine_fit_inlier_fraction": norm.fit.inliers,
        "normalized_field_folding_fraction": norm.folding,
    }
    regions = {"ipsilateral": analysis} | {f"shell_{a:g}_{b:g}mm".replace(".", "p"): analysis & (away >= a) & (away < b) for a, b in SHELLS}
    near = analysis & (away >= NEAR[0]) & (away < NEAR[1])
    for name, region in (regions | {"mass_effect_3_20mm": near}).items():
        for m, values in maps.items():
            out |= finite_summary(values[region], f"{name}_{m}")
        if name.startswith("shell"):
            r = maps["radial_mm"][region]
            out |= {f"{name}_outward_fraction": float((r > 0).mean()) if len(r) else np.nan, f"{name}_inward_fraction": float((r < 0).mean()) if len(r) else np.nan}
    magnitude, radial, logs = (maps[m][near] for m in maps)
    gain = lambda v: float(np.maximum(v, 0).sum() * ml)
    out |= {
        "mass_effect_3_20mm_mean_absolute_radial_mm": float(np.abs(radial).mean()) if near.any() else np.nan,
        "mass_effect_3_20mm_outward_integral_ml_mm": gain(radial),
        "mass_effect_3_20mm_inward_integral_ml_mm": gain(-radial),
        "mass_effect_3_20mm_magnitude_integral_ml_mm": float(magnitude.sum() * ml),
        "mass_effect_3_20mm_logjac_expansion_integral_ml": gain(logs),
        "mass_effect_3_20mm_logjac_compression_integral_ml": gain(-logs),
    }
    out |= finite_summary(sensitivity[near], "registration_sensitivity_3_20mm_mm") if sensitivity is not None else {"registration_sensitivity_3_20mm_mm_n_voxels": 0}
    signal, noise = out["mass_effect_3_20mm_magnitude_mm_median"], out.get("registration_sensitivity_3_20mm_mm_median", np.nan)
    out["mass_effect_to_registration_sensitivity_ratio"] = float(signal / noise) if np.isfinite(signal) and noise > 0 else np.nan
    least = int(np.ceil(minimum_near_mm3 / np.prod(spacing)))
    out["deformation_qc_pass"] = bool(out["laterality_supported"] and norm.folding <= 0.05 and int(near.sum()) >= least)
    return out


@dataclass(frozen=True)
class Extracted:
    """What a case's extraction gives: the flat record and the maps, on the atlas grid."""

    record: dict
    maps: dict[str, np.ndarray]


def extract_maps(at: np.ndarray, source_mask: np.ndarray, target_mask: np.ndarray, lesion: np.ndarray, target: np.ndarray, spacing: tuple[float, float, float], source_spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), raw: np.ndarray | None = None, smoothing_mm: float = 2.0, subsample: int = 8, minimum_points: int = 10_000, raw_mask: np.ndarray | None = None, **limits) -> Extracted:
    """From a coordinate map and masks on the atlas grid to the case's record and maps; ``raw`` is a second map whose effect
    gives the registration sensitivity, zero off the common support (with the source mask ``raw_mask``, if it has its own)."""
    lesion, target = lesion.astype(bool), target.astype(bool) | lesion.astype(bool)
    side = K.laterality(lesion)[0]

    def field_of(coordinates: np.ndarray, mask: np.ndarray) -> tuple:
        valid = K.valid_coordinates(coordinates, mask, target_mask)
        norm = K.normalize(coordinates, valid, side, spacing, source_spacing, smoothing_mm, subsample, minimum_points)
        return norm, *K.effect(norm.displacement, norm.valid, norm.jacobian, target, side)

    norm, effect, logj, keep = field_of(at, source_mask)
    sensitivity = None
    if raw is not None:
        _, other, _, other_keep = field_of(raw, source_mask if raw_mask is None else raw_mask)
        sensitivity = np.where(keep & other_keep, np.linalg.norm(effect - other, axis=-1), 0.0).astype(np.float32)
    _, normals = K.distance_and_normals(lesion, spacing)
    maps = {
        "mass_effect_vector": effect,
        "mass_effect_magnitude": np.where(keep, np.linalg.norm(effect, axis=-1), 0).astype(np.float32),
        "mass_effect_radial": np.where(keep, (effect * normals).sum(axis=-1), 0).astype(np.float32),
        "log_jacobian_asymmetry": logj,
        "valid_mask": keep.astype(np.uint8),
        "lesion_atlas": lesion.astype(np.uint8),
        "target_atlas": target.astype(np.uint8),
    } | ({"registration_sensitivity": sensitivity} if sensitivity is not None else {})
    return Extracted(case_metrics(lesion, target, norm, effect, logj, keep, spacing, sensitivity, **limits), maps)


def extract_case(*arrays, **how) -> dict:
    """The record of ``extract_maps``."""
    return extract_maps(*arrays, **how).record


EXTRACTED = "lesion_side string, lesion_laterality_index double, deformation_qc_pass boolean, metrics string"


def extracted_row(record: dict) -> dict:
    """A record as JSON text, beside the columns that filters need."""
    return {c: record[c] for c in ("lesion_side", "lesion_laterality_index", "deformation_qc_pass")} | {"metrics": json.dumps(strict_json(record))}


def extract_cases(df: DataFrame, spacing: tuple[float, float, float], **how) -> DataFrame:
    """Records of (case_id, shape, field as coordinates, source_shape, source_mask, mask, lesion, target) rows, as JSON text
    beside the columns that filters need."""

    def run(row: dict) -> dict:
        source = np.asarray(row["source_mask"]).reshape([int(n) for n in row["source_shape"]]).astype(bool)
        masks = [field(row, n, 0).astype(bool) for n in ("mask", "lesion", "target")]
        return extracted_row(extract_case(field(row).astype(np.float64), source, *masks, spacing, **how))

    return map_cases(df, run, EXTRACTED)
