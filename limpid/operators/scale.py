"""Building blocks that keep ordered, grouped and repeated work distributed at any size.

* shared staging instead of driver or machine-local state,
* range buckets with prefix sums instead of one-partition windows,
* hot-key detection and salting instead of one task per group.
"""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import inheritable_thread_target

from limpid.functions.text import quote

# A group above this many rows is not left to one task.
GROUP_ROWS = 2_000_000
# Target rows per range bucket; the number of buckets follows from the rows.
BUCKET_ROWS = 1_000_000
# Up to this many rows a bucket may hold all rows that tie in the order: comparing keys without the tie column is faster.
SMALL_ROWS = 4_000_000
# Characters of a text key that a bucket's bound keeps.  Any prefix is a valid bound.
BOUND_TEXT = 64
# Largest table that is broadcast; rows and text bytes are always counted first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# At most this many groups are hot, so any other group is smaller than this share of the rows.
MAX_HOT = 4096
# Parts that the rows without a group are spread over.
NULL_PARTS = 512


# --- staging -----------------------------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.  Taken from spark.checkpoint.dir; a scratch folder is made
    only for a local session without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="limpid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{_stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def _stage_root(spark: SparkSession) -> str:
    """Folder of this application alone, so that release() cannot touch another one's data."""
    return f"{shared_dir(spark)}/limpid-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to shared storage and read back: short lineage, column pruning kept, and nothing
    to recompute when an executor is lost."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged.  Call when its results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- ordering ----------------------------------------------------------------------------------

def columns_of(names: list[str]) -> list[Column]:
    return [quote(name) for name in names]


TIE = "__tie"


def with_tie(df: DataFrame) -> DataFrame:
    """Add a hash of the row that breaks ties of the order.  Rows that tie in it as well are equal in
    all columns and may change places."""
    hashable = [f.name for f in df.schema if f.name != TIE and "map<" not in f.dataType.simpleString()]
    return df.withColumn(TIE, F.xxhash64(*columns_of(hashable)))


def order_key(order_by: list[str]) -> Column:
    """One orderable value for the row order."""
    return quote(order_by[0]) if len(order_by) == 1 else F.struct(*columns_of(order_by))


def _literal(value) -> Column:
    if isinstance(value, tuple):  # Row of a composite key
        return F.struct(*[_literal(value[f]).alias(f) for f in value.__fields__])
    return F.lit(value)


def _short(df: DataFrame, name: str) -> Column:
    return (F.left(quote(name), F.lit(BOUND_TEXT)) if isinstance(df.schema[name].dataType, T.StringType) else quote(name)).alias(name)


@dataclass(frozen=True)
class Ranges:
    """Sorted lower bounds of buckets 1..n; bucket 0 lies below the first bound."""

    order_by: tuple[str, ...]
    bounds: tuple

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def bucket(self) -> Column:
        """Bucket number of a row: how many bounds are <= its key, by binary search."""
        size = len(self.bounds)
        if size == 0:
            return F.lit(0)
        key = order_key(list(self.order_by))
        bounds = F.array(*[_literal(b) for b in self.bounds])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])

        def narrow(low: Column, step: Column) -> Column:
            reachable = (low + step <= size) & (F.get(bounds, low + step - 1) <= key)
            return F.when(reachable, low + step).otherwise(low)

        return F.aggregate(steps, F.lit(0), narrow)


def range_buckets(df: DataFrame, order_by: list[str], buckets: int | None = None) -> Ranges:
    """Bounds that cut the rows, in the order of some columns, into buckets of about equal size.

    Equal keys fall into one bucket; add the tie column (with_tie) to the order to spread them, NULL
    keys included.  The bounds come from a sample chosen by a hash of the key, so a rerun gives the
    same bounds, and they enter later plans as one literal, so every pass assigns rows alike without
    stored state.  There are about 32 sample rows and one bound per bucket.
    """
    rows = df.count()
    if rows <= SMALL_ROWS and order_by[-1] == TIE and len(order_by) > 1:
        order_by = order_by[:-1]  # the order of the rows is the same; only a bucket may hold all ties of a key
    if buckets is None:
        wanted = max(math.ceil(rows / BUCKET_ROWS), 2 * df.sparkSession.sparkContext.defaultParallelism)
        buckets = min(wanted, max(1, rows // 64))
    if buckets <= 1:
        return Ranges(tuple(order_by), ())
    every = max(1, rows // (buckets * 32))
    key = order_key(order_by)
    chosen = df.where(F.pmod(F.xxhash64(*columns_of(order_by)), F.lit(every)) == 0)
    sample = chosen.select(*[_short(df, c) for c in order_by]).select(key.alias("key")).where("key is not null")
    tiles = (sample.select("key", F.ntile(buckets).over(Window.orderBy("key")).alias("tile"))
             .groupBy("tile").agg(F.min("key").alias("key")).where("tile > 1").orderBy("key"))
    return Ranges(tuple(order_by), tuple(dict.fromkeys(r["key"] for r in tiles.collect())))


def few(summary: DataFrame, ranges: Ranges) -> DataFrame:
    """A table of a few numbers per bucket, broadcast if there are not too many buckets."""
    return F.broadcast(summary) if ranges.count <= BROADCAST_ROWS else summary


def with_position(df: DataFrame, order_by: list[str], name: str, ranges: Ranges | None = None) -> DataFrame:
    """Add the dense 0-based row position: bucket offset plus row number inside the bucket.

    Ties of the order are broken by a hash of the row.  The only one-task step works on one row per
    bucket.
    """
    order = [*order_by, TIE]
    tied = with_tie(df)
    ranges = ranges or range_buckets(tied, order)
    bucketed = tied.withColumn("__bucket", ranges.bucket())
    sizes = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy("__bucket").orderBy(*columns_of(order))
    return (bucketed.withColumn("__local", F.row_number().over(local))
            .join(few(offsets, ranges), "__bucket", "left")
            .withColumn(name, F.col("__offset") + F.col("__local") - 1)
            .drop("__bucket", "__offset", "__local", TIE))


# --- groups ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Groups:
    """Size facts of a grouping: how many groups, and the rows of the hot ones by hash of their key.

    A group that shares its hash with a hot one is treated like it, which costs nothing but time.
    """

    rows: int
    count: int
    hot: dict
    key_bytes: int = 0

    def is_hot(self, key: Column) -> Column:
        if not self.hot:
            return F.lit(False)
        return key.isNotNull() & F.xxhash64(key).isin(list(self.hot))

    def salts(self, spark: SparkSession, group_rows: int) -> DataFrame:
        """(__hash, __salts): parts of each hot group; at most MAX_HOT rows of two numbers."""
        return local_table(spark, [(h, math.ceil(n / group_rows) + 1) for h, n in self.hot.items()], "__hash bigint, __salts bigint")


def group_sizes(df: DataFrame, key: Column, group_rows: int | None = None) -> Groups:
    """Count groups and find the hot ones; counts are pre-aggregated before the shuffle."""
    sizes = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return groups_of(sizes, group_rows)


def groups_of(sizes: DataFrame, group_rows: int | None = None) -> Groups:
    """The same from a table (key, n)."""
    group_rows = group_rows or GROUP_ROWS
    total = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"),
                      F.sum(F.octet_length(F.col("key").cast("string"))).alias("bytes")).first()
    hot = {}
    if total["largest"] and total["largest"] > group_rows:
        largest = sizes.where(F.col("n") > group_rows).select(F.xxhash64("key").alias("hash"), "n").orderBy(F.desc("n"), "hash").limit(MAX_HOT)
        for r in largest.collect():
            hot[r["hash"]] = max(r["n"], hot.get(r["hash"], 0))
    return Groups(total["rows"] or 0, total["groups"], hot, total["bytes"] or 0)


def join_group_values(df: DataFrame, values: DataFrame, key: str, groups: Groups,
                      group_rows: int | None = None) -> DataFrame:
    """Left join one row of values per group back to the rows.

    `values` holds column "__group" and the value columns.  Few groups: broadcast.  Otherwise a
    shuffle join in which the rows of each hot group are spread over salts by a hash of the row,
    and the value of that group is repeated once per salt.
    """
    if groups.count <= BROADCAST_ROWS and groups.key_bytes + _text_bytes(values) <= BROADCAST_BYTES:
        return df.join(F.broadcast(values), quote(key) == F.col("__group"), "left").drop("__group")
    spark, zero = df.sparkSession, F.lit(0).cast("bigint")
    parts = F.broadcast(groups.salts(spark, group_rows or GROUP_ROWS))
    row_hash = F.xxhash64(*columns_of(df.columns))
    # Rows without a group match nothing; negative salts spread them too.
    salt = (F.when(quote(key).isNull(), -1 - F.pmod(row_hash, F.lit(NULL_PARTS)))
            .when(F.col("__salts").isNotNull(), F.pmod(row_hash, F.col("__salts"))).otherwise(zero))
    left = df.join(parts, F.xxhash64(quote(key)) == F.col("__hash"), "left").withColumn("__salt", salt).drop("__hash", "__salts")
    every_salt = F.sequence(zero, F.coalesce(F.col("__salts"), F.lit(1).cast("bigint")) - 1)
    right = values.join(parts, F.xxhash64("__group") == F.col("__hash"), "left").withColumn("__right_salt", F.explode(every_salt)).drop("__hash", "__salts")
    matched = (quote(key) == F.col("__group")) & (F.col("__salt") == F.col("__right_salt"))
    return left.join(right, matched, "left").drop("__group", "__salt", "__right_salt")


def _text_bytes(values: DataFrame) -> int:
    """Bytes of the text columns besides the key; other columns have a fixed width."""
    texts = [f.name for f in values.schema if isinstance(f.dataType, T.StringType) and f.name != "__group"]
    return values.agg(sum((F.sum(F.octet_length(c)) for c in texts), F.lit(0))).first()[0] or 0 if texts else 0


# --- quantiles ---------------------------------------------------------------------------------

# Most distinct values of a group that one task sorts for an exact quantile.
QUANTILE_VALUES = 1_000_000
_SLICES = 256


def value_counts(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """"__group", v (double), c: how often each value occurs; equal values meet before the shuffle."""
    points = df.select(group.alias("__group"), value.cast("double").alias("v")).where("v is not null")
    return points.groupBy("__group", "v").agg(F.count(F.lit(1)).alias("c"))


def exact_quantiles(df: DataFrame, group: Column, value: Column, probs: list[float],
                    max_values: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns "__group", "n", "q" (array)."""
    return quantiles_of_counts(value_counts(df, group, value), probs, max_values)


def quantiles_of_counts(counts: DataFrame, probs: list[float], max_values: int | None = None) -> DataFrame:
    """Quantiles from a table ("__group", v, c) of value counts.

    The value at a rank is found by a running count over the sorted distinct values.  A group with
    more than `max_values` of them is not sorted in one task: its values are cut into slices whose
    exact counts tell which slice holds the rank, again and again until the slice is small.
    """
    max_values = max_values or QUANTILE_VALUES
    groups = group_sizes(counts, F.col("__group"), max_values)
    small = counts.where(~groups.is_hot(F.col("__group"))) if groups.hot else counts
    result = _running_quantiles(small, probs)
    if not groups.hot:
        return result
    hot = stage(counts.where(groups.is_hot(F.col("__group"))), "hot-counts")
    rows = _sliced_quantiles(hot, probs, max_values)
    # One row per hot group, at most MAX_HOT.
    return result.unionByName(local_table(counts.sparkSession, rows, result.schema))


def fitted_quantiles(df: DataFrame, group: Column, value: Column, probs: list[float], max_values: int | None = None) -> dict:
    """group -> exact quantiles on the driver, for few groups; the values are not shuffled.

    A mergeable sketch of every group gives values that bracket each rank.  A second scan counts what lies below a bracket
    and how often each value inside it occurs; only these values, about 0.1 % of all, leave their tasks.  The counts show
    whether the bracket holds the rank; a group where it does not is done by exact_quantiles.
    """
    spark = df.sparkSession
    points = df.select(group.alias("__group"), value.cast("double").alias("v")).where("v is not null")
    facts = points.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [j / _GRID for j in range(_GRID + 1)], _SKETCH).alias("marks")).collect()
    places = [(r["__group"], r["n"], p, *_ranks(r["n"], p), r["marks"]) for r in facts for p in probs]
    if not places:
        return {}
    kind = points.schema["__group"].dataType
    counts = stage(_bracket_counts(points, [(g, *_bracket(n, k, last, marks)) for g, n, _, k, last, marks in places], kind), "bracket-counts")
    sums = {r["__group"]: r for r in counts.groupBy("__group").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("inside"),
        F.count("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    ranks, slices, missed = {}, {}, set()
    for i, (g, _, _, k, last, _) in enumerate(places):
        s = sums.get(i)
        if s is None or not s["below"] <= k or not last < s["below"] + s["inside"]:
            missed.add(g)
        else:
            ranks[i, 0], slices[i, 0] = (k, last), (s["below"], s["lo"], s["hi"], s["values"])
    found = _find(counts.where("v is not null"), ranks, slices, max_values or QUANTILE_VALUES)
    out = {}
    for i, (g, n, p, k, _, _) in enumerate(places):
        if g not in missed:
            low, high = found[i, 0]
            out.setdefault(g, []).append(low + (high - low) * (p * (n - 1) - k))
    if missed:
        again = points.where(F.col("__group").isin(list(missed)))
        out.update({r["__group"]: list(r["q"]) for r in exact_quantiles(again, F.col("__group"), F.col("v"), probs, max_values).collect()})
    return out


# Values that a sketch gives of a group, and its accuracy: a rank is wrong by 1 / _SKETCH of the rows at most.
_GRID, _SKETCH = 4096, 10_000


def _ranks(n: int, p: float) -> tuple[int, int]:
    """The two ranks, from 0, that a quantile of n values lies between."""
    k = math.floor(p * (n - 1))
    return k, min(k + 1, n - 1)


def _bracket(n: int, k: int, last: int, marks: list[float]) -> tuple[float, float]:
    """Values that the ranks k to last lie between: marks two steps further out than the ranks."""
    low, high = math.floor(k / n * _GRID) - 2, math.ceil((last + 1) / n * _GRID) + 2
    return (-math.inf if low <= 0 else marks[low]), (math.inf if high >= _GRID else marks[high])


def _bracket_counts(points: DataFrame, brackets: list[tuple], kind: T.DataType) -> DataFrame:
    """"__group" (number of the bracket), v, c: how often each value inside a bracket (group, lo, hi) occurs; v is null
    for all values below it."""
    schema = T.StructType().add("g", kind).add("i", "integer").add("lo", "double").add("hi", "double")
    table = local_table(points.sparkSession, [(g, i, lo, hi) for i, (g, lo, hi) in enumerate(brackets)], schema)  # groups x probabilities
    met = points.join(F.broadcast(table), (F.col("__group") == F.col("g")) & (F.col("v") <= F.col("hi")))
    return met.groupBy(F.col("i").alias("__group"), F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def exact_quantiles_of(df: DataFrame, column: str, probs: list[float]) -> list[float] | None:
    """Exact quantiles of one column, or None when it has no value."""
    return fitted_quantiles(df, F.lit(0), quote(column), probs).get(0)


def _running_quantiles(counts: DataFrame, probs: list[float]) -> DataFrame:
    inside = Window.partitionBy("__group")
    running = inside.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (counts.withColumn("upto", F.sum("c").over(running))
              .withColumn("n", F.sum("c").over(inside)))
    picks = []
    for p in probs:
        at = F.floor(p * (F.col("n") - 1))
        after = F.least(at + 1, F.col("n") - 1)
        picks += [F.min(F.when(F.col("upto") > at, F.col("v"))).alias(f"low{len(picks)}"),
                  F.min(F.when(F.col("upto") > after, F.col("v"))).alias(f"high{len(picks)}")]
    found = ranked.groupBy("__group").agg(F.max("n").alias("n"), *picks)
    values = []
    for i, p in enumerate(probs):
        low, high = F.col(f"low{2 * i}"), F.col(f"high{2 * i}")
        at = p * (F.col("n") - 1)
        values.append(low + (high - low) * (at - F.floor(at)))
    return found.select("__group", "n", F.array(*values).alias("q"))


def _sliced_quantiles(counts: DataFrame, probs: list[float], max_values: int) -> list[tuple]:
    """Quantiles of the hot groups, read off as the values at ranks k and k+1 of each probability."""
    facts = counts.groupBy("__group").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    # (group, prob index) -> (ranks, counted below the slice, slice bounds, distinct values inside)
    ranks, slices = {}, {}
    for r in facts:
        for i, p in enumerate(probs):
            ranks[r["__group"], i] = _ranks(r["n"], p)
            slices[r["__group"], i] = (0, r["lo"], r["hi"], r["values"])
    found = _find(counts, ranks, slices, max_values)
    out = []
    for r in facts:
        q = []
        for i, p in enumerate(probs):
            at = p * (r["n"] - 1)
            low, high = found[r["__group"], i]
            q.append(low + (high - low) * (at - math.floor(at)))
        out.append((r["__group"], r["n"], q))
    return out


def _find(counts: DataFrame, ranks: dict, slices: dict, max_values: int) -> dict:
    """(group, prob index) -> values at its two ranks, from slices (counted below, lo, hi, distinct values) that hold them."""
    spark, group_type, found, slices = counts.sparkSession, counts.schema["__group"].dataType, {}, dict(slices)
    schema = T.StructType([
        T.StructField("g", group_type), T.StructField("i", T.IntegerType()), T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()), T.StructField("below", T.LongType())])
    while slices:
        # Bounded: hot groups times probabilities.
        targets = local_table(spark, [(g, i, lo, hi, below) for (g, i), (below, lo, hi, _) in slices.items()], schema)
        inside = counts.join(F.broadcast(targets), (F.col("__group") == F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        done = [key for key, (*_, values) in slices.items() if values <= max_values]
        found.update(_values_at(inside, {key: ranks[key] for key in done}, group_type))
        slices = _narrow(inside, {key: ranks[key] for key in slices if key not in found}, slices, group_type)
    return found


def _only(inside: DataFrame, keys: list, group_type: T.DataType, extra: list, kind: T.DataType) -> DataFrame:
    """Rows of some (group, prob index) pairs, with one extra value each."""
    schema = T.StructType([T.StructField("g2", group_type), T.StructField("i2", T.IntegerType()),
                           T.StructField("extra", kind)])
    table = local_table(inside.sparkSession, [(g, i, e) for (g, i), e in zip(keys, extra)], schema)
    return inside.join(F.broadcast(table), (F.col("g") == F.col("g2")) & (F.col("i") == F.col("i2")))


def _values_at(inside: DataFrame, ranks: dict, group_type: T.DataType) -> dict:
    """Values at the two ranks of each finished slice (its distinct values are few)."""
    if not ranks:
        return {}
    rows = _only(inside, list(ranks), group_type, [{"k": k, "last": last} for k, last in ranks.values()], T.StructType().add("k", "long").add("last", "long"))
    running = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("below") + F.sum("c").over(running)
    picked = rows.withColumn("upto", upto).groupBy("g", "i").agg(
        F.min(F.when(F.col("upto") > F.col("extra.k"), F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") > F.col("extra.last"), F.col("v"))).alias("high")).collect()
    return {(r["g"], r["i"]): (r["low"], r["high"]) for r in picked}


def _slice_of(value: Column, cuts: Column) -> Column:
    """How many of at most _SLICES - 1 sorted cuts are <= a value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_SLICES.bit_length() - 1))])

    def narrow(low: Column, step: Column) -> Column:
        reachable = (low + step <= F.size(cuts)) & (F.get(cuts, low + step - 1) <= value)
        return F.when(reachable, low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), narrow)


def _narrow(inside: DataFrame, ranks: dict, slices: dict, group_type: T.DataType) -> dict:
    """The slice (or the two) that hold the ranks, with exact counts of what lies below."""
    if not ranks:
        return {}
    keys = list(ranks)
    same: dict = {}
    for key in keys:  # ranks of a group in the same slice share its cuts and counts
        same.setdefault((key[0], *slices[key][:3]), key)
    cut = list(same.values())
    marks = [j / _SLICES for j in range(1, _SLICES)]
    chosen = _only(inside, cut, group_type, [0] * len(cut), T.IntegerType())
    cuts = {(r["g"], r["i"]): sorted(set(r["e"])) for r in chosen.groupBy("g", "i").agg(
        F.percentile_approx("v", marks, 10_000).alias("e")).collect()}
    tagged = _only(inside, cut, group_type, [cuts[key] for key in cut], T.ArrayType(T.DoubleType()))
    rows = tagged.groupBy("g", "i", _slice_of(F.col("v"), F.col("extra")).alias("s")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    counted: dict = {}
    for r in sorted(rows, key=lambda r: r["s"]):
        counted.setdefault((r["g"], r["i"]), []).append(r)
    out = {}
    for key in keys:
        k, last = ranks[key]
        seen = slices[key][0]
        for r in counted[same[key[0], *slices[key][:3]]]:
            if key not in out and seen + r["c"] > k:
                out[key] = (seen, r["lo"], r["hi"], r["values"])
            elif key in out:  # k and k+1 lie in neighbouring slices
                below, lo, _, values = out[key]
                out[key] = (below, lo, r["hi"], values + r["values"])
            seen += r["c"]
            if seen > last:
                break
    return out


# --- driver ------------------------------------------------------------------------------------

def in_parallel(spark: SparkSession, *jobs):
    """Run independent jobs at the same time, so that one job's last tasks do not idle the cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Small table of driver-side rows (statistics, plans, reports).  As Arrow data it becomes a
    local relation, which the optimizer folds, instead of a distributed collection."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)
    arrays = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, schema=fields), schema)


# --- shape -------------------------------------------------------------------------------------

def has_more_rows(df: DataFrame, n: int) -> bool:
    """True if there are more than n rows; reads only as many partitions as it needs."""
    return len(df.select(F.lit(1)).take(n + 1)) > n


def long_form(df: DataFrame, cells: list[tuple[int, Column]], name: str) -> DataFrame:
    """One row per (row, cell): ordinal and the value; nulls left out.  All cells have one type."""
    flat = [x for ordinal, value in cells for x in (F.lit(ordinal), value)]
    return df.select(F.stack(F.lit(len(cells)), *flat).alias("ordinal", name)).where(F.col(name).isNotNull())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
