"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.constants import ROW_ID
from limpid.operators import scale


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates (first of each group not counted), ratio.  Nulls are equal.

    Copies collapse before the shuffle, so a group of copies of any size is cheap.
    """
    names = [c for c in df.columns if c != ROW_ID]
    groups = df.groupBy(*scale.columns_of(names)).agg(F.count(F.lit(1)).alias("__n"))
    rows = F.coalesce(F.sum("__n"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
    ratio = F.coalesce(F.round(F.try_divide(extra.cast("double"), rows.cast("double")), 4), F.lit(0.0))
    return groups.agg(rows.alias("rows"), extra.alias("total_duplicates"), ratio.alias("duplicate_ratio"))


def drop_duplicates(df: DataFrame, subset: list[str] | None = None,
                    order_by: list[str] | None = None) -> DataFrame:
    """Drop copies.  With a subset the first row in row order stays; unknown columns are ignored.

    The rank limit is applied in each task before the shuffle, so a hot key sends one row per task.
    """
    known = [c for c in subset or [] if c in df.columns]
    if not known:
        if ROW_ID not in df.columns:
            return df.dropDuplicates()
        names = [c for c in df.columns if c != ROW_ID]
        first_row = F.min(ROW_ID).alias(ROW_ID)
        return df.groupBy(*scale.columns_of(names)).agg(first_row).select(*scale.columns_of(df.columns))
    if not order_by:
        raise ValueError("drop_duplicates on a subset needs order_by")
    first = Window.partitionBy(*scale.columns_of(known)).orderBy(*scale.columns_of(order_by))
    return df.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
