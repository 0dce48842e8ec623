"""Number parsing and canonical numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.text import strip

# What counts as a number in text.  Spark's own cast would also take "1f" and "1d".
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def finite(v: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_double(v: Column, dtype: T.DataType) -> Column:
    """Number or NULL.  Text must match NUMBER after stripping; infinities become NULL."""
    if isinstance(dtype, T.BooleanType):
        return v.cast("int").cast("double")
    if is_numeric(dtype):
        return finite(v.cast("double"))
    if isinstance(dtype, T.StringType):
        text = strip(v)
        return F.when(text.rlike(NUMBER), finite(text.try_cast("double")))
    raise ValueError(f"cannot read {dtype.simpleString()} as a number")


def to_long(v: Column, dtype: T.DataType) -> Column:
    """Whole number, truncated toward zero; anything unreadable is 0."""
    if isinstance(dtype, T.IntegralType):
        return F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))
    number = to_double(v, dtype).try_cast("bigint")
    if isinstance(dtype, T.StringType):
        # Long digit strings keep all digits instead of going through double.
        text = strip(v)
        number = F.when(text.rlike(INTEGER), text.try_cast("bigint")).otherwise(number)
    return F.coalesce(number, F.lit(0).cast("bigint"))


def read_as(v: Column, dtype: T.DataType) -> Column:
    """Text read as a given type, NULL if it does not fit.  The shape is tested first: a failing
    try_cast costs far more than a regex."""
    if isinstance(dtype, T.StringType):
        return v
    text = strip(v)
    if isinstance(dtype, T.IntegralType):
        return F.when(text.rlike(INTEGER), text.try_cast(dtype))
    if is_numeric(dtype):
        return F.when(text.rlike(NUMBER), text.try_cast(dtype))
    if isinstance(dtype, T.BooleanType):
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    return text.try_cast(dtype)


def plain_text(v: Column, dtype: T.DataType) -> Column:
    """Text of a value in which equal numbers look equal: -0.0 is 0.0."""
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return F.when(v == 0, F.lit(0.0)).otherwise(v).cast("string")
    return v.cast("string")


def _four_places(v: Column) -> Column:
    """Decimal text rounded to four places, without trailing zeros; NULL if out of range."""
    text = v.try_cast("decimal(38,4)").cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def canonical(v: Column, dtype: T.DataType) -> Column:
    """Comparable text of a cell: numbers to four places, other text stripped and lower-cased."""
    if isinstance(dtype, T.IntegralType):
        return v.cast("string")
    if is_numeric(dtype):
        return F.coalesce(_four_places(v), v.cast("string"))
    text = F.lower(strip(v.cast("string")))
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.when(text.rlike(NUMBER), _four_places(text)), text)
    return text


def same_cell(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Null-safe equality of two canonical cells, without building text for like-typed numbers."""
    if isinstance(a_type, T.IntegralType) and isinstance(b_type, T.IntegralType):
        return a.eqNullSafe(b)
    if is_numeric(a_type) and is_numeric(b_type):
        return F.round(a.cast("double"), 4).eqNullSafe(F.round(b.cast("double"), 4))
    return canonical(a, a_type).eqNullSafe(canonical(b, b_type))
