"""Calibration factors and the choice of a model from small JSON files."""

from tidewick.sources import forecasts
from tidewick.sources.paths import write_json

MANIFESTS = {"flat": {"alpha": 1.2}, "other_key": {"calibrator_alpha": 0.8}, "nested": {"calibration": {"alpha": 0.7}}, "flat_first": {"report": {"alpha": 3}, "alpha_calibrator": 2}, "none": {"k_label": 10}, "no_number": {"alpha": "1.5", "meta": {"alpha": 4}}}
METRICS = {"lower_rmse": {"gbm": {"rmse_test": 2}, "en": {"rmse_test": 1}}, "equal": {"gbm": {"RMSE_TEST": 1}, "en": {"rmse_test": 1}}, "by_mae": {"gbm": {"rmse_test": 1, "mae_test": 2}, "en": {"MAE_TEST": 1}}, "one_model": {"en": {"rmse_test": 1}}}


def test_manifest_factors(spark, tmp_path):
    for name, facts in MANIFESTS.items():
        write_json(spark, f"{tmp_path}/{name}.json", facts)
    write_json(spark, f"{tmp_path}/models.json", {"alpha_gbm": 1.25, "alpha_en": None})
    got = {n: forecasts.manifest_alpha(spark, f"{tmp_path}/{n}.json") for n in [*MANIFESTS, "missing"]}
    assert got == {"flat": 1.2, "other_key": 0.8, "nested": 0.7, "flat_first": 2.0, "none": 1.0, "no_number": 4.0, "missing": 1.0}
    assert [forecasts.model_alpha(spark, f"{tmp_path}/models.json", m) for m in ("gbm", "en")] == [1.25, 1.0]


def test_picked_models(spark, tmp_path):
    for name, facts in METRICS.items():
        write_json(spark, f"{tmp_path}/{name}.json", facts)
    got = {n: forecasts.pick_model(spark, f"{tmp_path}/{n}.json") for n in [*METRICS, "missing"]}
    assert got == {"lower_rmse": "en", "equal": "gbm", "by_mae": "en", "one_model": "gbm", "missing": "gbm"}
