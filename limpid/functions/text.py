"""Text expressions: Column in, Column out, no UDF.  NULL in gives NULL out everywhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions.constants import CLEAN_NULLS, WHITESPACE


def quote(name: str) -> Column:
    """Column reference that is safe for names with dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(v: Column) -> Column:
    """Remove Unicode whitespace at both ends (Spark's one-argument trim removes only U+0020)."""
    return F.btrim(v, F.lit(WHITESPACE))


def blank_to_null(v: Column) -> Column:
    """NULL for blank text and for the exact null tokens; other text unchanged."""
    return F.when((strip(v) == "") | v.isin(CLEAN_NULLS), None).otherwise(v)


def title_case(v: Column) -> Column:
    """Capitalise after every non-letter, so "o'neil 3rd" becomes "O'Neil 3Rd" (initcap does not)."""
    runs = F.regexp_extract_all(F.lower(v), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    capital = F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))
    return F.array_join(capital, "")


def change_case(v: Column, case: str | None) -> Column:
    if case == "lower":
        return F.lower(v)
    if case == "upper":
        return F.upper(v)
    if case == "title":
        return title_case(v)
    return v


def remove_chars(v: Column, chars: str) -> Column:
    """Delete every character of `chars`."""
    return F.translate(v, chars, "") if chars else v


def count_of(v: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    return ((F.length(v) - F.length(F.replace(v, F.lit(token), F.lit("")))) / len(token)).cast("int")


def split_regex(delimiter: str) -> str:
    """Java regex for a delimiter.

    A comma between two digits is a thousands separator and does not split.  Any other single
    character is literal; a longer delimiter is itself a regex.
    """
    if delimiter == ",":
        return r"(?<!\d),|,(?!\d)"
    return re.escape(delimiter) if len(delimiter) == 1 else delimiter


def split_parts(v: Column, delimiter: str) -> Column:
    """Array of stripped parts."""
    return F.transform(F.split(v, split_regex(delimiter), -1), strip)


def repair_pattern(pattern: str) -> str:
    """Give a pattern its capture group and close one unbalanced parenthesis."""
    opening, closing = pattern.count("("), pattern.count(")")
    if opening == 0:
        pattern = f"({pattern})"
    elif opening > closing:
        pattern += ")"
    elif opening < closing:
        pattern = "(" + pattern
    groups = re.compile(pattern).groups
    if groups != 1:
        raise ValueError(f"pattern needs exactly one capture group, has {groups}")
    return pattern.replace("(?P<", "(?<")


def extract(v: Column, pattern: str) -> Column:
    """The capture group of the first match; NULL without a match (regexp_extract gives '')."""
    java = repair_pattern(pattern)
    return F.when(v.rlike(java), F.regexp_extract(v, java, 1))
