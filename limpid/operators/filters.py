"""Row filters: missing values and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.functions.numbers import is_numeric
from limpid.functions.text import quote
from limpid.operators import scale


def drop_missing(df: DataFrame, column: str | None = None) -> DataFrame:
    """Drop rows that are null in the column, or in any column if it is not given or unknown."""
    names = [column] if column in df.columns else df.columns
    return df.na.drop("any", subset=["`" + n.replace("`", "``") + "`" for n in names])


def zscore_bounds(df: DataFrame, column: str, threshold: float = 3) -> tuple[float, float, float] | None:
    """(mean, sample std, threshold), or None when the spread is zero or undefined."""
    v = quote(column).cast("double")
    mean, std = df.agg(F.avg(v), F.stddev_samp(v)).first()
    return (mean, std, threshold) if std and std > 0 else None


def iqr_bounds(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Fences 1.5 interquartile ranges outside the exact quartiles."""
    quartiles = scale.exact_quantiles_of(df, column, [0.25, 0.75])
    if quartiles is None:
        return None
    q1, q3 = quartiles
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def remove_outliers(df: DataFrame, column: str, method: str = "z-score", threshold: float = 3,
                    keep_nulls: bool = False) -> DataFrame:
    """Keep rows inside the bounds; null rows go too unless `keep_nulls`.

    The z-score test is strict (<), the quartile test is not, and it ignores the threshold.
    An unknown method removes nothing.
    """
    if not is_numeric(df.schema[column].dataType):
        raise ValueError(f"column '{column}' is not numeric")
    v = quote(column).cast("double")
    if method == "z-score":
        bounds = zscore_bounds(df, column, threshold)
        if bounds is None:
            return df
        mean, std, limit = bounds
        inside = F.abs((v - mean) / std) < limit
    elif method == "iqr":
        fences = iqr_bounds(df, column)
        if fences is None:
            return df if keep_nulls else df.where(F.lit(False))
        inside = (v >= fences[0]) & (v <= fences[1])
    else:
        return df
    return df.where(v.isNull() | inside) if keep_nulls else df.where(inside)
