"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import math
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.functions.text import quote
from limpid.operators import scale

#: ASCII white space, the class [\x20\x09-\x0D], as Java and RE2 patterns write it.
SPACE = r"\x20\x09-\x0D"
#: Arrow batches towards Python are cut at this many bytes, so that long texts do not pile up in a worker.
BATCH_BYTES = 4 << 20
#: A group below this many rows is never worth splitting.
SMALLEST_HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, and nothing else: extra columns cannot clash with computed ones."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a file to the shared folder, through Spark's own file systems; its path."""
    path = f"{scale.shared_dir(spark)}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    for at in range(0, len(content), 1 << 24):
        out.write(bytearray(content[at : at + (1 << 24)]))
    out.close()
    return path


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where the session was started without it on PYTHONPATH."""
    package = Path(__file__).parents[1]
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(package.name in f for f in context._python_includes):
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(shared_file(spark, f"{package.name}-{context.applicationId}.zip", archive.getvalue()))


def python_stages(spark: SparkSession) -> None:
    """Prepare Python stages: the workers know this package, and one Arrow batch is bounded in rows and bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_HELD: dict[bytes, object] = {}


def held(key: bytes, make: Callable[[], object]):
    """What a Python worker keeps between tasks under a key.  A worker keeps one thing: another key drops it, so
    operators that follow each other in the same workers do not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: what follows survives lost executors and never repeats this work."""
    return scale.stage(df, label)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_limit(spark: SparkSession, rows: int, smallest: int = SMALLEST_HOT) -> int:
    """Rows above which a group counts as hot.  At most 2 x shuffle partitions groups can be above it."""
    return max(smallest, math.ceil(rows / (2 * partitions(spark))))


def hot_groups(keys: DataFrame, rows: int, smallest: int = SMALLEST_HOT) -> tuple[dict, int]:
    """{key: rows} of the groups above hot_limit, and the limit.  `keys` has one column `key` (long) and is counted
    after a map-side aggregation; the result has at most 2 x shuffle partitions entries."""
    limit = hot_limit(keys.sparkSession, rows, smallest)
    found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect() if rows > limit else []
    return {r["key"]: r["n"] for r in found}, limit


def ranked(df: DataFrame, group: str, order_by: list[str]) -> DataFrame:
    """`df` with idx (0-based place of a row in its group, nulls first, as in `order_by`) and n (rows of the group).

    The rows are sorted by a range exchange and written with the number of their partition; the offset of a group in a
    partition is a running sum over the counts of earlier partitions.  No group is sorted or counted in one task.
    The rows are computed twice, as the range exchange samples them.  Columns named __part and __row are replaced."""
    keys = [quote(c) for c in [group, *order_by]]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stage(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    held = rows.groupBy("__part", quote(group).alias("__group")).agg(F.count(F.lit(1)).alias("__held"), F.min("__row").alias("__first"))
    group_parts = Window.partitionBy("__group")
    earlier = group_parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("__part", "__group", "__first", F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"), F.sum("__held").over(group_parts).alias("n"))
    # One row per partition and group that meet: partitions + groups at most.
    offsets = offsets.withColumnRenamed("__part", "__in")
    placed = rows.join(offsets, (F.col("__part") == F.col("__in")) & quote(group).eqNullSafe(F.col("__group")))
    return placed.withColumn("idx", F.col("__before") + F.col("__row") - F.col("__first")).select(*df.columns, "idx", "n")


def words_pattern() -> str:
    return f"[^{SPACE}]+"


def no_space(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty.  Chained literal replacements are several times
    faster here than one regular expression."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(char), F.lit(""))
    return out
