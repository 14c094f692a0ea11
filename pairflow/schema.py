"""Column roles and explicit schemas of the tables the library exchanges."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY_COLUMNS = ["m1", "m2"]
TEMPERATURE = "temperature_k"
COMPOSITION = "x1"
TARGETS = ["ln_gamma_1", "ln_gamma_2"]
FEATURES = [TEMPERATURE, COMPOSITION]
GROUP_KEYS = ENTITY_COLUMNS + [TEMPERATURE]
ROW_ID = "row_id"

SPLITS = ["train", "valid_cont", "valid_mix", "valid_indp", "test_mix", "test_indp"]
HOLDOUTS = ["valid_cont", "valid_mix", "valid_indp", "test_indp", "test_mix"]

# Column names of the files this library reads and their canonical names.
COMPUTED_NAMES = {"temperature (K)": "temperature_k", "x(1)": "x1", "x(2)": "x2"}
EXPERIMENTAL_NAMES = {"TRange": "temperature_k", "x1": "x1"}

BATCH_SCHEMA = T.StructType(
    [
        T.StructField("temperature (K)", T.DoubleType()),
        T.StructField("x(1)", T.DoubleType()),
        T.StructField("x(2)", T.DoubleType()),
        T.StructField("ln_gamma_1", T.DoubleType()),
        T.StructField("ln_gamma_2", T.DoubleType()),
        T.StructField("cas_number_1", T.StringType()),
        T.StructField("cas_number_2", T.StringType()),
        T.StructField("names_1", T.StringType()),
        T.StructField("names_2", T.StringType()),
    ]
)


def coefficient_names(degree: int = 4, n_targets: int = 2) -> list[str]:
    """Names of the widened polynomial coefficients: power first, then target."""
    return [f"c{j}_{i}" for i in range(n_targets) for j in range(degree + 1)]
