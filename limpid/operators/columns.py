"""Column operators: schema changes and value standardisation.  All are projections except where a
width or a type test has to look at the data first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import datetimes, numbers, text
from limpid.functions.constants import ROW_ID, TIME_SAMPLE
from limpid.functions.text import quote
from limpid.operators import scale


def data(df: DataFrame) -> DataFrame:
    """The table without the row id."""
    return df.drop(ROW_ID)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if numbers.is_numeric(f.dataType)]


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(quote(c), F.lit(None)) for c in floats}) if floats else df


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Blank text and exact null tokens become NULL; surrounding whitespace of other text stays."""
    names = text_columns(df)
    df = df.withColumns({c: text.blank_to_null(quote(c)) for c in names}) if names else df
    return nan_to_null(df)


# --- schema ------------------------------------------------------------------------------------

def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(quote(column))


def rename(df: DataFrame, column: str, new_name: str) -> DataFrame:
    return df.withColumnRenamed(column, new_name)


def preview(df: DataFrame, order_by: list[str], columns: int = 25, rows: int = 100) -> DataFrame:
    """The first columns and rows (a report: the limit is the feature)."""
    shown = df.orderBy(*scale.columns_of(order_by)).limit(rows)
    return shown.select(*scale.columns_of(df.columns[:columns]))


def split_width(df: DataFrame, column: str, delimiter: str) -> int:
    """Parts of the widest row."""
    widest = df.agg(F.max(F.size(F.split(quote(column).cast("string"), text.split_regex(delimiter), -1)))).first()[0]
    return max(widest or 1, 1)


def split_names(column: str, n_parts: int, new_columns: list[str] | None = None) -> list[str]:
    """The given names if there are enough of them, else {column}_part1, {column}_part2, ..."""
    if new_columns and len(new_columns) >= n_parts:
        return list(new_columns[:n_parts])
    return [f"{column}_part{i + 1}" for i in range(n_parts)]


def split_column(df: DataFrame, column: str, delimiter: str = ",", new_columns: list[str] | None = None,
                 n_parts: int | None = None) -> DataFrame:
    """Split into stripped parts that are appended last; the column goes.  Missing parts are NULL.

    Without `n_parts` one aggregate finds the widest row.
    """
    n_parts = n_parts or split_width(df, column, delimiter)
    names = split_names(column, n_parts, new_columns)
    taken = [n for n in names if n in df.columns and n != column]
    if taken:
        raise ValueError(f"split would create columns that exist: {taken}")
    kept = [c for c in df.columns if c != column]
    parts = df.withColumn("__parts", text.split_parts(quote(column).cast("string"), delimiter))
    return parts.select(*scale.columns_of(kept),
                        *[F.get("__parts", F.lit(i)).alias(n) for i, n in enumerate(names)])


# --- values ------------------------------------------------------------------------------------

def replace_match(df: DataFrame, column: str, old):
    """Predicate: the cell equals `old` (text: after stripping; numbers: as a number)."""
    dtype = df.schema[column].dataType
    value = quote(column)
    if isinstance(dtype, T.StringType):
        return F.coalesce(text.strip(value) == str(old), F.lit(False))
    if not isinstance(dtype, T.NumericType):
        return F.coalesce(value == F.lit(str(old)).try_cast(dtype), F.lit(False))
    # A plan in JSON may write -999 as -999.0.  As decimals both are equal, and long numbers stay exact.
    kind = "double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "decimal(38,18)"
    return F.coalesce(value.try_cast(kind) == F.lit(str(old)).try_cast(kind), F.lit(False))


def replace(df: DataFrame, column: str, old, new) -> DataFrame:
    """Replace one value; the new value "NaN" or "nan" means NULL.

    A numeric column is compared with `old` read as a number.
    """
    dtype = df.schema[column].dataType
    if new in ("NaN", "nan", None):
        target = F.lit(None).cast(dtype)
    elif isinstance(dtype, T.StringType):
        target = F.lit(str(new))
    elif isinstance(dtype, T.IntegralType):
        target = F.lit(str(new)).try_cast("decimal(38,18)").try_cast(dtype)
    else:
        target = F.lit(str(new)).try_cast(dtype)
    return df.withColumn(column, F.when(replace_match(df, column, old), target).otherwise(quote(column)))


def strip_whitespace(df: DataFrame, column: str | None = None) -> DataFrame:
    """Strip one column, or every text column for None or "ALL_OBJECT"."""
    names = text_columns(df) if column in (None, "ALL_OBJECT") else [column]
    return df.withColumns({c: text.strip(quote(c).cast("string")) for c in names}) if names else df


def clean_text(df: DataFrame, column: str, remove_chars: str = "", case: str | None = None) -> DataFrame:
    if not remove_chars and case not in ("lower", "upper", "title"):
        return df
    value = text.remove_chars(quote(column).cast("string"), remove_chars)
    return df.withColumn(column, text.change_case(value, case))


def extract_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Keep the capture group of the first match; NULL without one.

    A pattern the regex engine rejects is an error here, before any row is read.
    """
    java = text.repair_pattern(pattern)
    df.sparkSession.range(1).select(F.regexp_extract(F.lit(""), java, 1)).collect()
    return df.withColumn(column, text.extract(quote(column).cast("string"), pattern))


def is_time_only(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """One row: sampled, matched, is_time_only.

    Looks at the first 20 non-null values in row order; more than 60 % must be times of day.
    """
    first = (df.where(quote(column).isNotNull()).orderBy(*scale.columns_of(order_by)).limit(TIME_SAMPLE)
             .select(datetimes.is_time_text(quote(column).cast("string")).alias("hit")))
    share = F.try_divide(F.count_if("hit"), F.count(F.lit(1)))
    return first.agg(F.count(F.lit(1)).alias("sampled"), F.count_if("hit").alias("matched"),
                     F.coalesce(share > 0.6, F.lit(False)).alias("is_time_only"))


def holds_times(df: DataFrame, column: str, order_by: list[str] | None) -> bool:
    """is_time_only for any column; only text can hold times of day."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return False
    if not order_by:
        raise ValueError("a date step looks at the first values and needs order_by")
    return is_time_only(df, column, order_by).first()["is_time_only"]


def standardize_time(df: DataFrame, column: str) -> DataFrame:
    return datetimes.with_clock_time(df, column)


def parse_date(df: DataFrame, column: str, formats: list[str] | None = None) -> DataFrame:
    """Text to timestamp.  The stripped text is a projection of its own, so it is computed once."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        df = df.withColumn(column, text.strip(quote(column)))
    return df.withColumn(column, datetimes.to_timestamp(quote(column), dtype, formats))


def cast_type(df: DataFrame, column: str, dtype: str, order_by: list[str] | None = None,
              formats: list[str] | None = None, times: bool | None = None) -> DataFrame:
    """int (unreadable: 0), float and datetime (unreadable: NULL), str.

    A text column of times of day is standardised to HH:MM instead of becoming a datetime;
    `times` tells what the column holds if that is known.
    """
    value, current = quote(column), df.schema[column].dataType
    if dtype == "int":
        return df.withColumn(column, numbers.to_long(value, current))
    if dtype == "float":
        return df.withColumn(column, numbers.to_double(value, current))
    if dtype == "datetime":
        if holds_times(df, column, order_by) if times is None else times:
            return standardize_time(df, column)
        return parse_date(df, column, formats)
    if dtype in ("str", "string", "object", "category"):
        return df.withColumn(column, numbers.plain_text(value, current))
    raise ValueError(f"unsupported type '{dtype}'")


def format_datetime(df: DataFrame, column: str, fmt: str = "%Y-%m-%d", order_by: list[str] | None = None,
                    formats: list[str] | None = None, times: bool | None = None) -> DataFrame:
    """Text of a date in a strftime format; unreadable: NULL; times of day become HH:MM."""
    if holds_times(df, column, order_by) if times is None else times:
        return standardize_time(df, column)
    pattern = datetimes.strftime_pattern(fmt)
    return parse_date(df, column, formats).withColumn(column, F.date_format(quote(column), pattern))
