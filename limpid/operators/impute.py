"""Missing-value filling: global, grouped and ordered.

Statistics are fitted by one aggregate; applying them is a projection (global) or one join (grouped).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.numbers import is_numeric
from limpid.functions.text import quote
from limpid.operators import ordered, scale

FILL_TEXT = "Unknown"
GLOBAL_STATISTICS = ("mean", "median", "mode")


def effective_strategy(strategy: str | None, dtype: T.DataType) -> str:
    """What a global strategy means for a column type: text has no mean, median or interpolation."""
    if strategy in ("mean", "median"):
        return strategy if is_numeric(dtype) else "constant"
    if strategy == "interpolate":
        return "interpolate" if is_numeric(dtype) else "mode_or_unknown"
    return strategy if strategy in ("mode", "ffill", "bfill") else "constant"


# --- fitting -----------------------------------------------------------------------------------

def fit(df: DataFrame, wanted: dict[str, str]) -> dict[str, object]:
    """Global mean, median or mode of several columns: one read per kind of statistic, side by side.

    The mode is the smallest of the most frequent values.
    """
    out: dict[str, object] = dict.fromkeys(wanted)
    jobs = []
    means = [c for c, s in wanted.items() if s == "mean"]
    if means:
        jobs.append(lambda: zip(means, df.agg(*[F.avg(quote(c)).alias(str(i)) for i, c in enumerate(means)]).first()))
    medians = [c for c, s in wanted.items() if s == "median"]
    if medians:
        jobs.append(lambda: _medians(df, medians).items())
    by_type: dict[str, list[str]] = {}
    for c in (c for c, s in wanted.items() if s == "mode"):
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for columns in by_type.values():
        jobs.append(lambda columns=columns: _modes(df, columns).items())
    for fitted in scale.in_parallel(df.sparkSession, *jobs) if jobs else []:
        out.update(fitted)
    return out


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    cells = scale.long_form(df, [(i, quote(c).cast("double")) for i, c in enumerate(columns)], "v")
    found = scale.fitted_quantiles(cells, F.col("ordinal"), F.col("v"), [0.5])  # one row per column
    return {columns[i]: q[0] for i, q in found.items()}


def _modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    cells = scale.long_form(df, [(i, quote(c)) for i, c in enumerate(columns)], "v")
    counts = cells.groupBy("ordinal", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("ordinal").agg(_most_frequent("v", "n").alias("v"))
    return {columns[r["ordinal"]]: r["v"] for r in best.collect()}  # one row per column


def _most_frequent(value: str, n: str) -> Column:
    """Aggregate over counted values: the most frequent one, the smallest of equals; nulls do not count."""
    known = F.col(value).isNotNull()
    return F.min_by(value, F.when(known, F.struct((-F.col(n)).alias("n"), F.col(value).alias("v"))))


# --- applying ----------------------------------------------------------------------------------

def fill_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace nulls by one value per column.  A fractional value turns a whole-number column
    into double."""
    changed = {}
    for name, value in values.items():
        if value is None:
            continue
        current = quote(name)
        if isinstance(value, float) and isinstance(df.schema[name].dataType, T.IntegralType):
            current = current.cast("double")
        changed[name] = F.coalesce(current, F.lit(value))
    return df.withColumns(changed) if changed else df


def fill_statistic(df: DataFrame, columns: list[str], strategy: str, value=None) -> DataFrame:
    """Fill with the global mean, median or mode; `value` serves columns that have no mode."""
    fitted = fit(df, {c: strategy for c in columns})
    return fill_values(df, {c: v if v is not None else value for c, v in fitted.items()})


def fill_constant(df: DataFrame, column: str, value=None) -> DataFrame:
    """Fill with a constant, by default "Unknown".

    A constant the column type cannot hold is an error: a column has one type.
    """
    value = FILL_TEXT if value is None else value
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.StringType):
        text = F.lit(str(value)).try_cast(dtype)
        if df.sparkSession.range(1).select(text.alias("v")).first()["v"] is None:
            raise ValueError(f"{value!r} does not fit column '{column}' of type {dtype.simpleString()}")
        return df.withColumn(column, F.coalesce(quote(column), text))
    return df.withColumn(column, F.coalesce(quote(column), F.lit(str(value))))


def fill_group(df: DataFrame, column: str, group_by: str, strategy: str, *, rest: str | None = None, value=None,
               group_rows: int | None = None) -> DataFrame:
    """Fill with the mean, median or mode of the row's group; rows without a group keep their value.

    `rest` is the statistic of the column after the grouped pass that fills what is still null,
    `value` its substitute if there is none.  Both passes are fitted from one read of the rows: a
    staged table with one row per group, in which the fills of the first pass are counted in.
    """
    dtype = df.schema[column].dataType
    current = quote(column).cast("double") if strategy in ("mean", "median") else quote(column)
    summary, fallback = _fit_groups(df.select(quote(group_by).alias("__group"), current.alias("v")), strategy, rest)
    sizes = summary.where("__group is not null").select(F.col("__group").alias("key"), "n")
    groups = scale.groups_of(sizes, group_rows)
    values = summary.where("__group is not null and __fill is not null").select("__group", "__fill")
    joined = scale.join_group_values(df, values, group_by, groups, group_rows)
    filled = F.coalesce(current, F.col("__fill"))
    if rest is not None:
        fallback = value if fallback is None else fallback
        filled = F.coalesce(filled, F.lit(fallback).try_cast("double" if strategy in ("mean", "median") else dtype))
    return joined.withColumn(column, filled).drop("__fill")


def _fit_groups(cells: DataFrame, strategy: str, rest: str | None) -> tuple[DataFrame, object]:
    """(staged table "__group", n, nulls, "__fill"; global statistic after the grouped pass).

    `cells` has "__group" and v.  Every form aggregates before it shuffles.
    """
    if strategy == "mean":
        sums = cells.groupBy("__group").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.sum("v").alias("total"))
        own = F.when(F.col("__group").isNotNull(), F.col("total") / (F.col("n") - F.col("nulls")))
        known = F.col("n") > F.col("nulls")
        summary = scale.stage(sums.withColumn("__fill", F.when(known, own)), "groups")
        if rest is None:
            return summary, None
        gained = F.when(F.col("__fill").isNotNull(), F.col("nulls")).otherwise(0)
        total = F.sum(F.coalesce("total", F.lit(0.0)) + gained * F.coalesce("__fill", F.lit(0.0)))
        count = F.sum(F.col("n") - F.col("nulls") + gained)
        return summary, summary.agg(F.try_divide(total, count)).first()[0]
    counts = cells.groupBy("__group", "v").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = counts.groupBy("__group").agg(
            F.sum("c").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("nulls"),
            _most_frequent("v", "c").alias("mode"))
        if strategy == "mode":
            own = F.when(F.col("__group").isNotNull(), F.col("mode"))
            summary = sizes.select("__group", "n", "nulls", own.alias("__fill"))
        else:
            known = counts.where("__group is not null and v is not null")
            medians = scale.quantiles_of_counts(known, [0.5]).select(F.col("__group").alias("g"), F.col("q")[0].alias("__fill"))
            summary = sizes.join(medians, F.col("__group") == F.col("g"), "left").select("__group", "n", "nulls", "__fill")
        summary = scale.stage(summary, "groups")
        if rest is None:
            return summary, None
        gained = summary.where("__fill is not null and nulls > 0").select(F.col("__fill").alias("v"), F.col("nulls").alias("c"))
        after = counts.where("v is not null").select("v", "c").unionByName(gained).groupBy("v").agg(F.sum("c").alias("c"))
        if rest == "mode":
            return summary, after.agg(_most_frequent("v", "c")).first()[0]
        quantile = scale.quantiles_of_counts(after.select(F.lit(0).alias("__group"), "v", "c"), [0.5]).first()
        return summary, quantile["q"][0] if quantile else None
    finally:
        counts.unpersist()


def fill_na(df: DataFrame, column: str, strategy: str | None, *, value=None, group_by: str | None = None,
            order_by: list[str] | None = None) -> DataFrame:
    """The whole fill operator.

    With `group_by`: first inside the group (mode for any strategy that has no grouped form), then
    the rest globally.  Ordered strategies need `order_by`.
    """
    dtype = df.schema[column].dataType
    numeric = is_numeric(dtype)
    if group_by and group_by in df.columns:
        if strategy in ("ffill", "bfill"):
            out = ordered.carry(df, column, _order(order_by), group_by, forward=strategy == "ffill")
            return fill_statistic(out, [column], "mode", value)
        if strategy in ("mean", "median") and numeric:
            return fill_group(df, column, group_by, strategy, rest=strategy)
        rest = "mode" if strategy in ("mode", "interpolate") else None
        return fill_group(df, column, group_by, "mode", rest=rest, value=value)
    kind = effective_strategy(strategy, dtype)
    if kind in ("mean", "median"):
        return fill_statistic(df, [column], kind)
    if kind == "mode":
        return fill_statistic(df, [column], "mode", value)
    if kind == "mode_or_unknown":
        return fill_statistic(df, [column], "mode", FILL_TEXT)
    if kind in ("ffill", "bfill"):
        return ordered.carry(df, column, _order(order_by), forward=kind == "ffill")
    if kind == "interpolate":
        return ordered.interpolate(df, column, _order(order_by))
    return fill_constant(df, column, value)


def _order(order_by: list[str] | None) -> list[str]:
    if not order_by:
        raise ValueError("an ordered fill needs order_by")
    return order_by
