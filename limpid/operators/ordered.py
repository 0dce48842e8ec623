"""Operators that depend on row order: forward fill, backward fill, linear interpolation.

A window over the whole table would run in one task.  Here rows are cut into range buckets; each
bucket is filled locally and takes what reaches over its edge from a summary with one row per
bucket.  Small groups need no buckets; hot groups are cut by (group, order).  Ties of the order are
broken by a hash of the row, so every table has one order and any key may repeat or be NULL.
The summary is joined by shuffle unless its real size, which adaptive execution sees, allows a
broadcast; the rows are already partitioned by bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.text import quote
from limpid.operators import scale


@dataclass(frozen=True)
class Layout:
    """Rows with their window partition: "__group" (NULL key kept apart) and "__bucket"."""

    rows: DataFrame
    order: list[str]
    cut: DataFrame | None  # the rows of groups that are cut into several buckets

    def window(self, ascending: bool = True):
        order = scale.columns_of(self.order)
        return Window.partitionBy("__group", "__bucket").orderBy(*(order if ascending else [c.desc() for c in order]))


def layout(df: DataFrame, order_by: list[str], group_by: str | None, group_rows: int | None = None,
           buckets: int | None = None) -> Layout:
    order, df = [*order_by, scale.TIE], scale.with_tie(df)
    if group_by is None:
        ranges = scale.range_buckets(df, order, buckets=buckets)
        rows = df.withColumn("__group", F.lit(0)).withColumn("__bucket", ranges.bucket())
        return Layout(rows, order, rows if ranges.count > 1 else None)
    key = quote(group_by)
    groups = scale.group_sizes(df, key, group_rows)
    bucket = F.lit(0)
    if groups.hot:
        hot = df.where(groups.is_hot(key))
        if buckets is None:
            buckets = 2 * math.ceil(sum(groups.hot.values()) / (group_rows or scale.GROUP_ROWS))
        # Bounds over (group, order): a group has as many pieces as its share of the hot rows.
        ranges = scale.range_buckets(hot, [group_by, *[c for c in order if c != group_by]], buckets)
        bucket = F.when(groups.is_hot(key), ranges.bucket()).otherwise(0)
    # Rows without a group are not filled here; spread them instead of giving them to one task.
    spread = F.pmod(F.col(scale.TIE), F.lit(scale.NULL_PARTS)).cast("int")
    bucket = F.when(key.isNull(), spread).otherwise(bucket)
    rows = df.withColumn("__group", key).withColumn("__bucket", bucket)
    return Layout(rows, order, rows.where(groups.is_hot(key)) if groups.hot else None)


def carry(df: DataFrame, column: str, order_by: list[str], group_by: str | None = None, *,
          forward: bool = True, group_rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Fill nulls with the nearest earlier (forward) or later value, inside each group if given.

    Rows whose group is NULL keep their value.
    """
    parts = layout(df, order_by, group_by, group_rows, buckets)
    value = quote(column)
    to_here = parts.window(ascending=forward).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = parts.rows.withColumn("__near", F.last(value, ignorenulls=True).over(to_here))
    far = F.lit(None)
    if parts.cut is not None:
        filled = filled.join(_edges(parts, value, forward), ["__group", "__bucket"], "left")
        far = F.col("__far")
    own = F.coalesce(value, F.col("__near"), far)
    if group_by is not None:
        own = F.when(F.col("__group").isNull(), value).otherwise(own)
    return filled.withColumn(column, own).select(*scale.columns_of(df.columns))


def _edges(parts: Layout, value: Column, forward: bool) -> DataFrame:
    """Per piece of a cut group, the value that reaches it from the pieces before (after) it."""
    key = F.when(value.isNotNull(), scale.order_key(parts.order))
    edge = F.max_by(value, key) if forward else F.min_by(value, key)
    summary = parts.cut.groupBy("__group", "__bucket").agg(edge.alias("__edge"))
    order = F.col("__bucket") if forward else F.desc("__bucket")
    before = Window.partitionBy("__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.last("__edge", ignorenulls=True).over(before)
    return summary.select("__group", "__bucket", reach.alias("__far")).where("__far is not null")


def interpolate(df: DataFrame, column: str, order_by: list[str], *, buckets: int | None = None) -> DataFrame:
    """Linear interpolation over row positions, as double.

    Leading nulls stay; trailing nulls take the last value.
    """
    value = quote(column).cast("double")
    tied, keys = scale.with_tie(df), [*order_by, scale.TIE]
    ranges = scale.range_buckets(tied, keys, buckets=buckets)
    order = scale.columns_of(keys)
    local = Window.partitionBy("__bucket").orderBy(*order)
    rows = (tied.withColumn("__bucket", ranges.bucket()).withColumn("__v", value)
            .withColumn("__pos", F.row_number().over(local)))
    # The summary pass shuffles only the order key and the value.
    edge = F.when(F.col("__v").isNotNull(), F.col("__pos"))
    summary = rows.groupBy("__bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("__v", edge).alias("first_v"), F.min(edge).alias("first_pos"),
        F.max_by("__v", edge).alias("last_v"), F.max(edge).alias("last_pos"))
    # "From the end" frames: a frame that ends at unboundedFollowing is rescanned for every row.
    ahead = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__offset", F.coalesce(F.sum("n").over(behind), F.lit(0)))
    reach = summary.select(
        "__bucket", "__offset",
        F.last("last_v", True).over(behind).alias("__far_pv"),
        F.last(F.col("last_pos") + F.col("__offset"), True).over(behind).alias("__far_pp"),
        F.last("first_v", True).over(ahead).alias("__far_nv"),
        F.last(F.col("first_pos") + F.col("__offset"), True).over(ahead).alias("__far_np"))
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__pos").alias("p")))
    back = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forth = (Window.partitionBy("__bucket").orderBy(*[c.desc() for c in order])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = (rows.withColumn("__prev", F.last(known, True).over(back))
            .withColumn("__next", F.last(known, True).over(forth))
            .join(scale.few(reach, ranges), "__bucket", "left"))
    offset = F.col("__offset")
    prev_v = F.coalesce(F.col("__prev.v"), F.col("__far_pv"))
    prev_p = F.coalesce(F.col("__prev.p") + offset, F.col("__far_pp"))
    next_v = F.coalesce(F.col("__next.v"), F.col("__far_nv"))
    next_p = F.coalesce(F.col("__next.p") + offset, F.col("__far_np"))
    pos = F.col("__pos") + offset
    between = prev_v + (next_v - prev_v) * (pos - prev_p) / (next_p - prev_p)
    filled = (F.when(F.col("__v").isNotNull(), F.col("__v"))
              .when(next_v.isNull(), prev_v)
              .when(prev_v.isNotNull(), between))
    return near.withColumn(column, filled).select(*scale.columns_of(df.columns))
