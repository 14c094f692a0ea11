"""Patterns and constants that must equal those of the data they read."""

# Registry number inside a string: 2 to 6 leading digits, two digits, one digit.
REGISTRY_ID_PATTERN = r"\b[1-9]{1}[0-9]{1,5}-\d{2}-\d\b"

# Block-structured result files.
LINES_PER_BLOCK = 8
CONDITION_LINE = 3
TARGET_LINES = (7, 8)
TEMPERATURE_PATTERN = r"(?<=T= )\d+.\d+"
COMPOSITION_1_PATTERN = r"(?<=x\(1\)= )\d+.\d+"
COMPOSITION_2_PATTERN = r"(?<=x\(2\)= )\d+.\d+"
TARGET_PATTERN = r"\-?\d+.\d+$"
NAME_PATTERN = r"(?<=\s\s\s\d\s)[\w\(\)\,\-]+(?=\s+)"
ID_SEPARATOR = "__"
RESULT_SUFFIX_PATTERN = r"_ct\.tab$"

# Strings that stand for a missing value in CSV input.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

KELVIN_OFFSET = 273.15
HISTOGRAM_EDGES = [-60, -40, -20, -10, -5, 0, 5, 10, 20, 40, 60]
ALPHA_BOUNDS = (1e-4, 1.0)
TAU_BOUNDS = (-366.0, 366.0)
POLYNOMIAL_DEGREE = 4
MIN_GROUP_ROWS = 4
FINGERPRINT_BITS = 2048
