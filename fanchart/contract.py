"""Shared schemas and the fixed values of the evaluation contract."""

from __future__ import annotations

from pyspark.sql import types as T

#: Key of one submitted forecast. Panels and corpora are keyed by ``unit_id`` alone.
UNIT_KEYS = ["submission_id", "unit_id"]
CELL_KEYS = ["submission_id", "unit_id", "asset", "horizon"]

# They must equal the published contract for results to agree.
DRAW_COLUMNS = ("draw", "asset", "horizon", "value")
SUBMISSION_FILES = ("forecast.parquet", "forecast_meta.json", "forecast_rationale.md")
MIN_DRAWS = 200
DEFAULT_DRAWS = 500
MAX_DRAWS = 20_000
MAX_META_BYTES = 256 * 1024
MAX_RATIONALE_BYTES = 1024 * 1024
MAX_DRAWS_FILE_BYTES = 64 * 1024 * 1024
MAX_UNCOMPRESSED_BYTES = 2 * 1024 * 1024 * 1024
MAX_ROW_GROUPS = 64
MAX_ROWS = 5_000_000
MAX_COLUMNS = 8
DOMAIN_MIN = 0.0
DOMAIN_MAX = 4.0
FAILURE_SCORE = 4.0
DEFAULT_WEIGHTS = {"marginal": 0.5, "joint": 0.3, "tail": 0.2}
DEFAULT_TAIL_LEVELS = (0.01, 0.05, 0.95, 0.99)
DEFAULT_TAIL_METRIC = "pinball"
DEFAULT_JOINT = "variogram"
RETURN_TARGETS = ("log_return", "return", "simple_return", "pct_change")
VOL_FLOOR = 1e-6
RELATIVE_VOL_FLOOR = 1e-4
GAP_FACTOR = 10.0
GAP_FLOOR_DAYS = 5.0
MIN_ALIGNED_ROWS = 30
VOL_SCALE_RANGE = (0.5, 2.0)
DRIFT_SD_CLAMP = 3.0
MAX_DOC_CHARS = 6000
MAX_DOCS = 8
MAX_TOKENS_IN = 1_000_000
MAX_TOKENS_OUT = 100_000
UNIT_SECONDS = 1_800
PHASE_SECONDS = 43_200
UNSCORED_REASON = "no_reference_in_mounted_unit"
SCALE_KEYS = ("marginal", "joint", "tail")
SCALE_PROVENANCE_KEYS = ("method", "seed", "generated")

# Public failure code -> diagnostic label.
LABEL_FOR_CODE = {
    "no_output": "schema_invalid_output",
    "malformed_output": "schema_invalid_output",
    "schema_invalid": "schema_invalid_output",
    "incomplete_output": "schema_invalid_output",
    "resource_timeout": "resource_timeout",
    "resource_oom": "resource_oom",
    "container_crashed": "schema_invalid_output",
    "image_unusable": "integrity_bad_image_hash",
    "network_violation": "leakage_network",
    "cutoff_violation": "leakage_cutoff",
    "contamination_detected": "contamination_canary",
}

# Text-blind model names and their seeds.
TEXT_BLIND_MODELS = {
    "theta_arima": 1,
    "chronos": 11,
    "timesfm": 22,
    "lag_llama": 33,
    "moirai": 44,
}

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("panel_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("asset", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

DRAWS_SCHEMA = T.StructType(
    [
        T.StructField("submission_id", T.StringType()),
        T.StructField("unit_id", T.StringType()),
        T.StructField("draw", T.IntegerType()),
        T.StructField("asset", T.StringType()),
        T.StructField("horizon", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

META_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("asof", T.StringType()),
        T.StructField("representation", T.StringType()),
        T.StructField("asset_ids", T.ArrayType(T.StringType())),
        T.StructField("horizons", T.ArrayType(T.IntegerType())),
        T.StructField("n_draws", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField(
            "rationale",
            T.StructType(
                [T.StructField("file", T.StringType()), T.StructField("method", T.StringType())]
            ),
        ),
    ]
)

UNIT_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("forecast_asof", T.StringType()),
        T.StructField("data_cutoff", T.StringType()),
        T.StructField("asset_ids", T.ArrayType(T.StringType())),
        T.StructField("horizons", T.ArrayType(T.IntegerType())),
        T.StructField("target_dates", T.ArrayType(T.StringType())),
        T.StructField("target_type", T.StringType()),
        T.StructField("tail_levels", T.ArrayType(T.DoubleType())),
        T.StructField("joint", T.StringType()),
        T.StructField("tail_metric", T.StringType()),
        T.StructField("n_draws_min", T.IntegerType()),
        T.StructField("w_marginal", T.DoubleType()),
        T.StructField("w_joint", T.DoubleType()),
        T.StructField("w_tail", T.DoubleType()),
        T.StructField("canary_guid", T.StringType()),
        T.StructField("text_cutoff", T.StringType()),
        T.StructField("n_documents", T.IntegerType()),
        T.StructField("panel_end", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
