"""Sinks: the cleaned table and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.constants import ROW_ID
from limpid.functions.text import quote


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header, no index, rows in the order of the row id if there is one.

    The row id goes; other nested columns are written as JSON.  The files' names sort in row order.
    """
    if ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    columns = [(F.to_json(quote(f.name)) if isinstance(f.dataType, nested) else quote(f.name)).alias(f.name) for f in df.schema if f.name != ROW_ID]
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    df.select(*columns).write.mode(mode).options(**options).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small report table as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)
