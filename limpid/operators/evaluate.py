"""Before/after quality of a cleaning run: small metric tables from one aggregate per side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.operators import dedupe, scale
from limpid.operators import profile as profiling
from limpid.operators.columns import data


def quality_nulls(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """column, raw_missing, clean_missing, status, per raw column ("column_dropped" if gone)."""
    before = profiling.null_counts(data(raw)).select("column", F.col("null_count").alias("raw_missing"))
    after = profiling.null_counts(data(clean)).select("column", F.col("null_count").alias("clean_missing"))
    kept = [c for c in data(raw).columns if c in clean.columns]
    # One row per column on both sides.
    return before.join(after, "column", "left").withColumn(
        "status", F.when(F.col("column").isin(kept), "kept").otherwise("column_dropped"))


def totals(df: DataFrame) -> DataFrame:
    """rows, columns, missing, duplicates in one row."""
    table = data(df)
    nulls = profiling.null_counts(table).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("missing"))
    copies = dedupe.duplicate_count(table).select(F.col("total_duplicates").alias("duplicates"))
    return side_by_side(nulls, copies)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Join one-row tables."""
    out = rows[0].withColumn("__k", F.lit(1))
    for other in rows[1:]:
        out = out.join(other.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2), F.lit(0.0))


def _both(raw: DataFrame, clean: DataFrame, measure) -> DataFrame:
    """The same one-row measure of both tables, columns suffixed _raw and _clean."""
    def suffixed(df, end):
        return df.select(*[F.col(c).alias(f"{c}_{end}") for c in df.columns])

    return side_by_side(suffixed(measure(raw), "raw"), suffixed(measure(clean), "clean"))


def _null_totals(df: DataFrame) -> DataFrame:
    return profiling.null_counts(data(df)).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("missing"))


def quality_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """total_missing_raw, total_missing_clean, reduction_pct."""
    t = _both(raw, clean, _null_totals)
    return t.select(F.col("missing_raw").alias("total_missing_raw"), F.col("missing_clean").alias("total_missing_clean"),
                    _percent(F.col("missing_raw") - F.col("missing_clean"), F.col("missing_raw")).alias("reduction_pct"))


def quality_completeness(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """completeness_raw, completeness_clean in percent of cells; placeholders count as values."""
    t = _both(raw, clean, _null_totals)

    def complete(end: str) -> Column:
        cells = F.col(f"rows_{end}") * F.col(f"columns_{end}")
        share = 1 - F.try_divide(F.col(f"missing_{end}").cast("double"), cells.cast("double"))
        return F.coalesce(F.round(share * 100, 2), F.lit(0.0)).alias(f"completeness_{end}")

    return t.select(complete("raw"), complete("clean"))


def quality_duplicates(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """duplicates_raw, duplicates_clean, duplicates_removed."""
    t = _both(raw, clean, lambda df: dedupe.duplicate_count(data(df)).select(F.col("total_duplicates").alias("duplicates")))
    return t.withColumn("duplicates_removed", F.col("duplicates_raw") - F.col("duplicates_clean"))


def quality_rows(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """rows_raw, rows_clean, retention_pct."""
    t = _both(raw, clean, lambda df: df.agg(F.count(F.lit(1)).alias("rows")))
    return t.withColumn("retention_pct", _percent(F.col("rows_clean"), F.col("rows_raw")))


def quality_schema(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """columns_raw, columns_clean, dropped and new columns: known from the schemas alone."""
    before, after = data(raw).columns, data(clean).columns
    dropped = [c for c in before if c not in after]
    new = [c for c in after if c not in before]
    return scale.local_table(
        raw.sparkSession, [(len(before), len(after), ", ".join(dropped), len(dropped), ", ".join(new), len(new))],
        "columns_raw bigint, columns_clean bigint, columns_dropped string, columns_dropped_count bigint,"
        " new_columns string, new_columns_count bigint")


def quality(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """All of the above (but the per-column table) in one row."""
    t = _both(raw, clean, totals)

    def complete(end: str) -> Column:
        cells = F.col(f"rows_{end}") * F.col(f"columns_{end}")
        share = 1 - F.try_divide(F.col(f"missing_{end}").cast("double"), cells.cast("double"))
        return F.coalesce(F.round(share * 100, 2), F.lit(0.0)).alias(f"completeness_{end}")

    values = t.select(
        F.col("missing_raw").alias("total_missing_raw"), F.col("missing_clean").alias("total_missing_clean"),
        _percent(F.col("missing_raw") - F.col("missing_clean"), F.col("missing_raw")).alias("reduction_pct"),
        "duplicates_raw", "duplicates_clean",
        (F.col("duplicates_raw") - F.col("duplicates_clean")).alias("duplicates_removed"),
        complete("raw"), complete("clean"), "rows_raw", "rows_clean",
        _percent(F.col("rows_clean"), F.col("rows_raw")).alias("retention_pct"))
    return side_by_side(values, quality_schema(raw, clean))
