"""Token lists, delimiters, phases and limits that define the results.

They are data, not logic: changing an entry changes what counts as missing, splittable, and so on.
"""

# Text that stands for "no value" after stripping whitespace.
PLACEHOLDERS = [
    "?", "N/A", "n/a", "NA", "na", "NaN", "nan", "None", "none",
    "--", "-", ".", "..", "...", "missing", "Missing", "MISSING",
    "undefined", "Undefined", "UNDEFINED", "null", "Null", "NULL",
    "not available", "Not Available", "unknown", "Unknown", "UNKNOWN",
    "-99", "-999", "99999", "#N/A", "#NA", "#VALUE!", "",
]

# Text decoded to NULL while reading CSV (exact, unstripped match).
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Text set to NULL before any cleaning step (exact, unstripped match).
CLEAN_NULLS = ["NaN", "nan", "None", "none", "N/A", "n/a"]

# Delimiters tried for splittable columns, in order of preference.
DELIMITERS = [",", ";", "|", " - ", " / ", ":"]

# Cleaning phases in execution order.
PHASES = [
    "treat_nulls", "treat_duplicates", "populate_missing",
    "drop_columns", "split_columns", "standardize",
]

# Characters removed by strip() (Unicode whitespace plus the four separators U+001C..U+001F).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Suffixes that mark a numeric code column.
CODE_SUFFIXES = [".num", "_num", "_id", ".id"]

# Sample sizes.
SPLIT_SAMPLE = 100
TIME_SAMPLE = 20
TOP_VALUES = 10
SAMPLE_VALUES = 5

# Column that holds the file order of a loaded table; it is never data.
ROW_ID = "_rid"
