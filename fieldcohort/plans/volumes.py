"""From a manifest's path columns to volumes and back: extraction, decomposition and audits of stored maps.

Cases are rows with their packed files; each is unpacked, worked on and packed again in one task, one after the other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcohort.functions import vocabulary as N
from fieldcohort.operators import cases
from fieldcohort.operators import contracts as C
from fieldcohort.operators import kernels as K
from fieldcohort.operators.cohort import small
from fieldcohort.sources import nifti, tables
from fieldcohort.sources.report import strict_json

KEYS = ("case_id", "subject", "session")
#: Columns of an extraction manifest; those of the second registration may be empty.
INPUTS = ("inverse_map", "subject_t1", "subject_mask", "lesion_mask", "inpainting_target")
RAW = ("raw_inverse_map", "raw_subject_t1", "raw_subject_mask")
#: Map -> (manifest column, file name ending, description in the file). Fixed values.
STORED = {
    "mass_effect_vector": ("mass_effect_vector_path", "deformation_atlas_mm", "Lesional-only deformation proxy, atlas-axis mm"),
    "mass_effect_magnitude": ("mass_effect_magnitude_path", "magnitude_atlas_mm", "Lesional-only deformation magnitude, mm"),
    "mass_effect_radial": ("mass_effect_radial_path", "radial_atlas_mm", "Radial deformation: outward positive, mm"),
    "log_jacobian_asymmetry": ("log_jacobian_asymmetry_path", "logjac_asymmetry", "Lesional minus mirrored contralesional log-J"),
    "valid_mask": ("valid_mask_path", "valid_mask", "Valid lesional deformation proxy support"),
    "lesion_atlas": ("lesion_atlas_path", "lesion_atlas", "Lesion mapped to symmetric atlas"),
    "target_atlas": ("target_atlas_path", "excluded_target_atlas", "Excluded inpainting target mapped to atlas"),
    "registration_sensitivity": ("registration_sensitivity_path", "registration_sensitivity_mm", "Inpainted minus direct registration sensitivity, mm"),
}


@dataclass(frozen=True)
class Atlas:
    """The grid that cases are brought to."""

    affine: np.ndarray
    mask: np.ndarray
    spacing: tuple[float, float, float]


def read_atlas(spark: SparkSession, image: str, mask: str) -> Atlas:
    """The atlas from its image and mask files; a grid that is not fit for mirroring, or a mask of another grid, raises."""
    found = []
    for path in (image, mask):
        row = spark.read.format("binaryFile").load(path).select("content").first()
        found.append(nifti.parse(bytes(row["content"])))
    (data, affine, _), (inside, mask_affine, _) = found
    if not nifti.same_geometry((data.shape, affine), (inside.shape, mask_affine)):
        raise ValueError("atlas image and mask differ in geometry")
    return Atlas(affine, inside > 0, nifti.check_geometry(data.shape, affine))


def _unpacked(row: dict, names: tuple[str, ...]) -> dict:
    return {n: nifti.parse(bytes(row[n])) for n in names}


def extracted(row: dict, atlas: Atlas, **how) -> tuple[dict, list[tuple[str, bytes]]]:
    """The record of a case with packed INPUTS, and its files."""
    has_raw = [row.get(n) is not None for n in RAW]
    if any(has_raw) and not all(has_raw):
        raise FileNotFoundError(f"case {row['case_id']} has a part of the second registration only")
    got = _unpacked(row, INPUTS + (RAW if all(has_raw) else ()))
    grid = lambda n: (got[n][0].shape[:3], got[n][1])
    if not all(nifti.same_geometry(grid("subject_t1"), grid(n)) for n in ("lesion_mask", "inpainting_target")):
        raise ValueError(f"image, lesion and target of case {row['case_id']} differ in geometry")
    at = got["inverse_map"][0].astype(np.float64)
    on_atlas = lambda n: K.sample((got[n][0] > 0).astype(np.float32), np.moveaxis(at, -1, 0), linear=False) > 0.5
    masks = {n: got[n][0] > 0 for n in ("subject_mask", "raw_subject_mask") if n in got}
    second = {"raw": got["raw_inverse_map"][0].astype(np.float64), "raw_mask": masks["raw_subject_mask"]} if all(has_raw) else {}
    result = cases.extract_maps(at, masks["subject_mask"], atlas.mask, on_atlas("lesion_mask"), on_atlas("inpainting_target"), atlas.spacing, got["subject_t1"][2], **second, **how)
    ids = {k: str(row[k]) for k in KEYS}
    folder = "/".join(ids[k] for k in ("subject", "session", "case_id"))
    names = {m: f"{folder}/{ids['case_id']}_{STORED[m][1]}.nii.gz" for m in result.maps}
    record = ids | {"method_version": N.METHOD_VERSION} | result.record | {STORED[m][0]: n for m, n in names.items()}
    files = [(n, nifti.render(result.maps[m], atlas.affine, STORED[m][2])) for m, n in names.items()]
    return record, [*files, (f"{folder}/{tables.METRICS_FILE}", (json.dumps(strict_json(record), indent=2) + "\n").encode())]


def extract(spark: SparkSession, manifest: DataFrame, root: str, atlas: Atlas, anchor: str = "ARC", **how) -> DataFrame:
    """Extraction of every case of a manifest (KEYS, INPUTS and perhaps RAW columns): KEYS, the columns that filters need, the
    record as JSON text, and ``files``, whose names begin with subject, session and case.  Missing columns or files raise."""
    C.require_columns(manifest, [*KEYS, *INPUTS], "extraction manifest")
    C.require_unique(manifest, "case_id", "extraction manifest")
    there = [n for n in RAW if n in manifest.columns]
    packed = nifti.case_files(spark, manifest, {n: n for n in (*INPUTS, *there)}, root, anchor, tuple(there), KEYS)
    shared = spark.sparkContext.broadcast(atlas)  # one volume, whatever the number of cases

    def run(row: dict) -> dict:
        record, files = extracted(row, shared.value, **how)
        return cases.extracted_row(record) | {"files": [{"name": n, "content": c} for n, c in files]}

    return cases.map_cases(packed, run, f"{cases.EXTRACTED}, files array<struct<name:string,content:binary>>", KEYS)


def fields(spark: SparkSession, manifest: DataFrame, root: str, version: str = N.METHOD_VERSION, anchor: str = "ARC") -> DataFrame:
    """The packed field and mask of every case of a manifest, for ``cases.hodge`` with ``nifti.vector_and_mask``."""
    C.require_unique(manifest, "case_id", "manifest")
    C.require_columns(manifest, [*KEYS, "method_version", "mass_effect_vector_path", "valid_mask_path"], "manifest")
    C.require_version(manifest, "method_version", version, "manifest")
    return nifti.case_files(spark, manifest, {"field": "mass_effect_vector_path", "valid": "valid_mask_path"}, root, anchor, keep=KEYS)


def audit_maps(spark: SparkSession, manifest: DataFrame, root: str, anchor: str = "ARC") -> DataFrame:
    """(case_id, map, nonzero, largest) for each stored map: what lies on the side that must be empty.

    Maps of a case that differ in shape, and values there that are not finite, raise."""
    packed = nifti.case_files(spark, manifest, {c: c for c in N.MAPS}, root, anchor)
    sides = small(manifest.select("case_id", "lesion_side"))

    def run(row: dict) -> list[dict]:
        out, shape = [], None
        for name in N.MAPS:
            data = nifti.parse(bytes(row[name]))[0]
            shape = shape or data.shape[:3]
            if data.shape[:3] != shape:
                raise ValueError(f"maps of case {row['case_id']} differ in shape")
            values = data[K.contralateral(shape, row["lesion_side"], 0.0)].astype(np.float64)
            if not np.isfinite(values).all():
                raise ValueError(f"{name} of case {row['case_id']} has values that are not finite")
            out.append({"map": name, "nonzero": int(np.count_nonzero(values)), "largest": float(np.abs(values).max(initial=0.0))})
        return out

    return cases.map_cases(packed.join(sides, "case_id"), run, "map string, nonzero long, largest double")


def require_empty(audited: DataFrame) -> dict:
    """The counts of an audit of maps; any value that is not zero raises."""
    got = audited.agg(F.count(F.lit(1)).alias("stored_maps_checked"), F.coalesce(F.sum("nonzero"), F.lit(0)).alias("contralesional_nonzero_values"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("contralesional_maximum_absolute_value")).first().asDict()
    if got["contralesional_nonzero_values"]:
        raise C.ContractError(f"stored maps have {got['contralesional_nonzero_values']} values on the empty side, the largest {got['contralesional_maximum_absolute_value']}")
    return got
