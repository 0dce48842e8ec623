"""Exact duplicates by a content sort.

Sampled splitters range-partition the normalised bytes, an external sort places equal texts next to each other, and
the window that follows compares neighbouring rows in full.  Rows are ordered by a prefix, a digest and then the whole
text, so splitters stay short however long the texts are.  Nothing but DataFrame expressions runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.llm.common import hot_groups, no_space

#: Characters of the normalised text that splitters see before they fall back on the digest.
PREFIX = 32
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `df` with keep_id (id of the row of its group that stays), group_size (long), kept (boolean) and
    text_sha256 (of the normalised text, lowercase hex).

    Two texts are equal when they are identical after deleting ASCII white space; a null text counts as empty.  The
    row with the most code points in its original text stays, then the one with the smallest id; a null id comes
    after all others.  Of rows that tie on both, exactly one is kept.  Input columns named like the added ones are
    replaced.  An empty table gives an empty table.

    Groups with more rows than 1 / (2 x shuffle partitions) of the table are found first from hashes, counted with
    map-side combination.  They are sorted in salted parts, so no task holds one whole, and their survivor comes from
    an aggregation that collapses copies before the shuffle; its result, one short row for each of the at most
    2 x shuffle partitions hot groups, is broadcast.
    """
    df = df.drop(*ADDED)
    columns = df.columns
    rows = df.withColumns({"__norm": no_space(F.col(text_col)), "__points": F.coalesce(F.length(text_col), F.lit(0))}) \
        .withColumns({"__prefix": F.substring("__norm", 1, PREFIX), "__hash": F.xxhash64("__norm")})
    hot, limit = hot_groups(rows.select(F.col("__hash").alias("key")), df.count())
    key = ["__prefix", "__hash"]
    if hot:
        parts = df.sparkSession.createDataFrame([(h, math.ceil(n / limit)) for h, n in hot.items()], "__hash long, __parts int")
        rows = rows.join(F.broadcast(parts), "__hash", "left")
        rows = rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), "__parts"), F.lit(0)))
        key.append("__salt")
    sorted_rows = rows.repartitionByRange(*key)  # by all that the window sorts by but the text, so it needs no further exchange
    group = Window.partitionBy(*key, "__norm")
    best_first = group.orderBy(F.desc("__points"), F.asc_nulls_last(id_col))
    marked = sorted_rows.withColumns({
        "keep_id": F.first(id_col).over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "group_size": F.count(F.lit(1)).over(group),
        "kept": F.row_number().over(best_first) == 1,
    }).withColumn("text_sha256", F.sha2("__norm", 256))
    if hot:
        marked = _settle_hot(marked, rows, id_col)
    return marked.select(*columns, *ADDED)


def _settle_hot(marked: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Replace what the parts of a hot group found by what holds for the whole group."""
    order = F.struct((-F.col("__points")).alias("p"), F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"))
    whole = rows.where("__parts is not null").groupBy("__norm").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("__n")) \
        .select(F.sha2("__norm", 256).alias("__sha"), "best", "__n")
    joined = marked.join(F.broadcast(whole), (F.col("text_sha256") == F.col("__sha")) & F.col("__parts").isNotNull(), "left")
    is_best = (F.col("__points") == -F.col("best.p")) & F.col(id_col).eqNullSafe(F.col("best.id"))
    is_hot = F.col("__n").isNotNull()
    return joined.withColumns({
        "keep_id": F.when(is_hot, F.col("best.id")).otherwise(F.col("keep_id")),
        "kept": F.when(is_hot, F.col("kept") & is_best).otherwise(F.col("kept")),
        "group_size": F.when(is_hot, F.col("__n")).otherwise(F.col("group_size")),
    })


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that mark_copies keeps, with their own columns."""
    own = [c for c in df.columns if c not in ADDED]
    if len(own) < len(df.columns):
        clash = {c: f"__own_{c}" for c in df.columns if c in ADDED}
        return drop_copies(df.withColumnsRenamed(clash), id_col, text_col).withColumnsRenamed({v: k for k, v in clash.items()}).select(df.columns)
    return mark_copies(df, id_col, text_col).where("kept").select(df.columns)
