"""Names of methods, features and models."""

from __future__ import annotations

# Identifiers that tables of this kind carry.
METHOD_VERSION = "contralateral_control_lesional_only_v2"
HODGE_METHOD_VERSION = "log_svf_tapered_periodic_fft_hhd_v1"
REPRESENTATION = "stationary_velocity_log_of_tapered_displacement"
SUPPORT = "lesional_hemisphere_only"

# Feature columns.
CLINICAL = ("age_at_stroke", "log1p_wab_days")
LESION = ("lesion_volume_ml", "left_language_lesion_ml", "right_language_lesion_ml", "lesion_laterality_index")
DEFORMATION = (
    "me_mass_effect_3_20mm_magnitude_mm_median",
    "me_mass_effect_3_20mm_magnitude_mm_p95",
    "me_mass_effect_3_20mm_radial_mm_median",
    "me_mass_effect_3_20mm_mean_absolute_radial_mm",
    "me_mass_effect_3_20mm_outward_integral_ml_mm",
    "me_mass_effect_3_20mm_inward_integral_ml_mm",
    "me_mass_effect_3_20mm_logjac_expansion_integral_ml",
    "me_mass_effect_3_20mm_logjac_compression_integral_ml",
)
HODGE = ("hhd_total_rms_mm", "hhd_curl_free_energy_fraction", "hhd_divergence_free_energy_fraction")
REGISTRATION_QC = ("me_registration_sensitivity_3_20mm_mm_median", "me_contralateral_affine_fit_rmse_mm")
UNCERTAINTY = (
    "unc_expected_lesion_volume_ml",
    "unc_expected_left_lesion_volume_ml",
    "unc_expected_right_lesion_volume_ml",
    "unc_maximum_lesion_probability",
    "unc_entropy_mass_ml",
    "unc_left_entropy_mass_ml",
    "unc_right_entropy_mass_ml",
    "unc_candidate_mean_entropy",
    "unc_boundary_mean_entropy",
    "unc_high_uncertainty_volume_ml",
    "unc_volume_p25_ml",
    "unc_volume_p75_ml",
)
# Columns that point to a case's stored maps.
MAPS = ("mass_effect_vector_path", "mass_effect_magnitude_path", "mass_effect_radial_path", "log_jacobian_asymmetry_path", "valid_mask_path")
# Exposures of the adjusted associations.
EXPOSURES = {
    "adjusted_magnitude_vs_aq": "me_mass_effect_3_20mm_magnitude_mm_median",
    "adjusted_absolute_radial_vs_aq": "me_mass_effect_3_20mm_mean_absolute_radial_mm",
    "adjusted_radial_direction_vs_aq": "me_mass_effect_3_20mm_radial_mm_median",
    "adjusted_hodge_total_rms_vs_aq": "hhd_total_rms_mm",
    "adjusted_hodge_curl_free_fraction_vs_aq": "hhd_curl_free_energy_fraction",
    "adjusted_hodge_divergence_free_fraction_vs_aq": "hhd_divergence_free_energy_fraction",
}
BASE = CLINICAL + LESION
#: Model name -> (features, what the design must have for it). Fixed values.
MODELS = {
    "intercept_only": ((), None),
    "clinical_only": (CLINICAL, None),
    "lesion_standard": (BASE, None),
    "lesion_plus_mass_effect": (BASE + DEFORMATION, None),
    "lesion_plus_mass_effect_and_registration_qc": (BASE + DEFORMATION + REGISTRATION_QC, "registration_qc"),
    "lesion_plus_uncertainty": (BASE + UNCERTAINTY, "uncertainty"),
    "lesion_uncertainty_plus_mass_effect": (BASE + UNCERTAINTY + DEFORMATION, "uncertainty"),
    "lesion_plus_hodge": (BASE + HODGE, "hodge"),
    "lesion_plus_mass_effect_plus_hodge": (BASE + DEFORMATION + HODGE, "hodge"),
}
