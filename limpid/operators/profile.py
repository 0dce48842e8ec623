"""Table profile: a fixed number of jobs whatever the number of columns.

The rows are read for one value-frequency table (distinct values, placeholders, frequent values,
samples, moments, quantiles and outliers all come from it), the first rows, the duplicate count and
the dependency checks; these four run at the same time.

Each piece is also a function of its own that returns one row per column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import aggregates, numbers, text
from limpid.functions.constants import (
    CODE_SUFFIXES, DELIMITERS, PLACEHOLDERS, SAMPLE_VALUES, SPLIT_SAMPLE, TOP_VALUES,
)
from limpid.functions.text import quote
from limpid.operators import dedupe, scale
from limpid.operators.columns import data, nan_to_null, numeric_columns, text_columns

# Columns per aggregate, so that generated code stays within compiler limits.
WIDE = 50

_COUNTED = "array<struct<value:string,count:bigint>>"
PROFILE_FIELDS = {
    "ordinal": "int", "column": "string", "dtype": "string", "rows": "bigint",
    "null_count": "bigint", "placeholder_count": "bigint", "detected_placeholders": _COUNTED,
    "missing_count": "bigint", "missing_ratio": "double", "unique_count": "bigint", "sample_values": "array<string>",
    "mean": "double", "std": "double", "min": "double", "max": "double", "median": "double",
    "skewness": "double", "zeros_count": "bigint", "q1": "double", "q3": "double",
    "potential_outliers": "bigint", "iqr_outliers": "bigint",
    "top_values": _COUNTED, "is_categorical": "boolean",
    "splittable": "boolean", "suggested_delimiter": "string", "occurrence_ratio": "double",
    "drop_reasons": "array<string>", "high_duplication": "boolean", "duplication_ratio": "double",
    "redundant_with": "array<string>",
}
PROFILE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PROFILE_FIELDS.items())


def kind_name(dtype: T.DataType) -> str:
    """Column kind under the name the plan rules and reports use."""
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.NumericType):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def column_index(df: DataFrame, names: list[str]) -> list[tuple[int, str]]:
    position = {c: i for i, c in enumerate(df.columns)}
    return [(position[c], c) for c in names]


def _per_column(df: DataFrame, names: list[str], measures: dict) -> DataFrame:
    """Several aggregates of every column in one scan, reshaped to one row per column."""
    parts = []
    indexed = column_index(df, names)
    for start in range(0, len(indexed), WIDE):
        batch = indexed[start:start + WIDE]
        wide = df.agg(*[F.struct(*[m(quote(c), df.schema[c].dataType).alias(k) for k, m in measures.items()])
                        .alias(f"c{i}") for i, c in batch])
        rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"c{i}").alias("m"))
                         for i, c in batch])
        parts.append(wide.select(F.inline(rows)).select("ordinal", "column", "m.*"))
    return scale.union_all(parts)


# --- 1: one scan -------------------------------------------------------------------------------

def null_counts(df: DataFrame) -> DataFrame:
    """ordinal, column, rows, null_count."""
    return _per_column(df, df.columns, {
        "rows": lambda v, t: F.count(F.lit(1)), "null_count": lambda v, t: aggregates.null_count(v)})


def numeric_stats(df: DataFrame) -> DataFrame:
    """ordinal, column, mean, std, min, max, skewness, zeros_count of the numeric columns.

    Aggregated over the long form: as one wide aggregate the generated code would grow with the
    number of columns and stop being compiled.
    """
    v = F.col("v")
    stats = numeric_cells(df).groupBy("ordinal").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        aggregates.sample_skewness(v).alias("skewness"), F.count_if(v == 0).alias("zeros_count"))
    return named(df, stats)


# --- 2: value frequencies ----------------------------------------------------------------------

# Text above LONG_TEXT characters is counted under a short key: its first KEY_TEXT characters and a 128-bit digest.
LONG_TEXT, KEY_TEXT, KEY_MARK = 160, 96, "\u2026#"


def short_key(value: Column) -> Column:
    """Stands for the value in counts; texts meet under one key only if start and digest agree."""
    key = F.concat(F.left(value, F.lit(KEY_TEXT)), F.lit(KEY_MARK), F.md5(value.cast("binary")))
    return F.when(F.length(value) > LONG_TEXT, key).otherwise(value)


def is_short_key(value: str | None) -> bool:
    return value is not None and len(value) == KEY_TEXT + len(KEY_MARK) + 32 and value[KEY_TEXT:].startswith(KEY_MARK)


def full_texts(df: DataFrame, keys: set[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """(ordinal, key) -> text, for the few keys that a report shows."""
    if not keys:
        return {}
    wanted = scale.local_table(df.sparkSession, sorted(keys), "o int, k string")
    cells = scale.long_form(df, [(i, quote(df.columns[i]).cast("string")) for i in sorted({i for i, _ in keys})], "value")
    found = cells.join(F.broadcast(wanted), (F.col("ordinal") == F.col("o")) & (short_key(F.col("value")) == F.col("k"))) \
        .groupBy("o", "k").agg(F.min("value").alias("value"))
    return {(r["o"], r["k"]): r["value"] for r in found.collect()}


def value_freq(df: DataFrame, names: list[str] | None = None, short: bool = False) -> DataFrame:
    """ordinal, value (text), v (double, of numeric columns), cnt.  Nulls are left out.

    With `short`, long text is counted under its short_key, so the shuffle does not carry the texts.

    Equal values meet before the shuffle, so frequent values cost nothing, and there is no copy of
    the table per column as several count(distinct) would plan.  Whole numbers, fractions and text
    are counted in their own type and become text only once per distinct value.
    """
    wholes, fractions, others, decimals = [], [], [], []
    for i, c in column_index(df, names or df.columns):
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            wholes.append((i, quote(c).cast("bigint")))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            fractions.append((i, quote(c).cast("double")))
        else:
            value = quote(c).cast("string")
            others.append((i, short_key(value) if short else value))
            decimals += [i] if isinstance(kind, T.DecimalType) else []
    parts = []
    for cells, kind in ((wholes, T.LongType()), (fractions, T.DoubleType()), (others, T.StringType())):
        if cells:
            counts = scale.long_form(df, cells, "value").groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("cnt"))
            number = F.col("value").try_cast("double")
            if isinstance(kind, T.StringType):
                number = F.when(F.col("ordinal").isin(decimals), number) if decimals else F.lit(None).cast("double")
            parts.append(counts.select("ordinal", numbers.plain_text(F.col("value"), kind).alias("value"), number.alias("v"), "cnt"))
    return scale.union_all(parts)


def named(df: DataFrame, result: DataFrame) -> DataFrame:
    """Put the column name behind the ordinal."""
    names = F.array(*[F.lit(c) for c in df.columns])
    rest = [c for c in result.columns if c != "ordinal"]
    return result.select("ordinal", F.get(names, F.col("ordinal")).alias("column"), *rest)


def distinct_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy("ordinal").agg(F.count(F.lit(1)).alias("unique_count"))


#: Log2 of the registers of a distinct-count sketch, and three standard errors of its estimate.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, names: list[str] | None = None, by: list[Column] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """*by, ordinal, sketch: a HyperLogLog sketch of every column, of 2^bits bytes at most, made in one scan.

    Values never leave their tasks.  Sketches can be stored and merged across parts, files and runs (merge_sketches).
    """
    keys = [c.alias(f"__by{i}") for i, c in enumerate(by or [])]
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), numbers.plain_text(quote(c), df.schema[c].dataType).alias("value")) for i, c in column_index(df, names or df.columns)])
    long = df.select(*keys, F.inline(cells)).where("value is not null")
    return long.groupBy(*[f"__by{i}" for i in range(len(keys))], "ordinal").agg(F.hll_sketch_agg("value", bits).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, sketch: one sketch for all that share the keys."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def approx_distinct(sketches: DataFrame) -> DataFrame:
    """The sketches' keys with unique_count, which is wrong by SKETCH_ERROR (at the default size) at most, three standard errors."""
    return sketches.withColumn("unique_count", F.hll_sketch_estimate("sketch")).drop("sketch")


def placeholder_cells(df: DataFrame) -> DataFrame:
    """ordinal, token, cnt of placeholder text in text columns, straight from the rows.

    Only placeholder cells reach the shuffle, and there are at most 35 tokens per column.
    Nulls are not placeholders: they are counted as nulls.
    """
    names = text_columns(df)
    if not names:
        return scale.local_table(df.sparkSession, [], "ordinal int, token string, cnt bigint")
    tokens = scale.long_form(df, [(i, text.strip(quote(c))) for i, c in column_index(df, names)], "token")
    found = tokens.where(F.col("token").isin(PLACEHOLDERS))
    return found.groupBy("ordinal", "token").agg(F.count(F.lit(1)).alias("cnt"))


def placeholder_freq(df: DataFrame, freq: DataFrame) -> DataFrame:
    """The same from a value-frequency table."""
    ordinals = [i for i, _ in column_index(df, text_columns(df))]
    found = freq.where(F.col("ordinal").isin(ordinals)).withColumn("token", text.strip("value"))
    return found.where(F.col("token").isin(PLACEHOLDERS)).groupBy("ordinal", "token").agg(F.sum("cnt").alias("cnt"))


def top_values(freq: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """ordinal, rank, value, cnt: the k most frequent values, ties by value.

    The rank limit runs in every task before the shuffle, so each sends at most k rows per column.
    """
    order = Window.partitionBy("ordinal").orderBy(F.desc("cnt"), "value")
    return freq.select("ordinal", "value", "cnt", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def sample_text(df: DataFrame) -> Column:
    """Text of a frequency-table value in plain decimal notation, for reports."""
    fractional = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.FractionalType)]
    plain = F.coalesce(F.col("value").try_cast("decimal(38,6)").cast("string"), F.col("value"))
    return F.when(F.col("ordinal").isin(fractional), plain).otherwise(F.col("value")) if fractional else F.col("value")


# Values of a column whose marks are sorted for a sample, about.
SAMPLE_POOL = 1000


def sample_mark(value: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(value, F.lit(f"|{seed}")))


def mark_limit(unique: Column) -> Column:
    """No mark above it is among the first ones of a column with so many values, but with a chance below 10^-400: about
    SAMPLE_POOL marks are below it, and all marks of a column with few values.  Callers check that they got enough."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_POOL)) / unique)
    return F.lpad(F.lower(F.hex((share * (2 ** 32 - 1)).cast("bigint"))), 8, "0")


def sample_values(df: DataFrame, freq: DataFrame, k: int = SAMPLE_VALUES, seed: int = 42, unique: dict[int, int] | None = None) -> DataFrame:
    """ordinal, rank, value: k distinct values chosen by a seeded hash, so the sample does not
    depend on partitioning.

    With `unique`, the distinct values of every column, only marks that can be among the first k are sorted."""
    shown = freq.select("ordinal", sample_text(df).alias("value")).withColumn("mark", sample_mark(F.col("value"), seed))
    order = Window.partitionBy("ordinal").orderBy("mark", "value")

    def first(marked: DataFrame) -> DataFrame:
        return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("mark")

    if not unique:
        return first(shown)
    sizes = scale.local_table(df.sparkSession, sorted(unique.items()), "o int, n bigint")
    limits = F.broadcast(sizes.select("o", mark_limit(F.col("n")).alias("upto")))  # one row per column
    found = scale.stage(first(shown.join(limits, (F.col("ordinal") == F.col("o")) & (F.left("mark", F.lit(8)) <= F.col("upto"))).drop("o", "upto")), "samples")
    have = {r["ordinal"]: r["n"] for r in found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [o for o, n in unique.items() if have.get(o, 0) < min(k, n)]
    return found.where(~F.col("ordinal").isin(short)).unionByName(first(shown.where(F.col("ordinal").isin(short)))) if short else found


def missing_profile(df: DataFrame) -> DataFrame:
    """ordinal, column, rows, null_count, placeholder_count, missing_count, missing_ratio."""
    tokens = placeholder_cells(df).groupBy("ordinal").agg(F.sum("cnt").alias("placeholder_count"))
    # One row per column on both sides.
    joined = null_counts(df).join(tokens, "ordinal", "left").na.fill(0, ["placeholder_count"])
    missing = F.col("null_count") + F.col("placeholder_count")
    return (joined.withColumn("missing_count", missing)
            .withColumn("missing_ratio", F.when(F.col("rows") > 0, F.round(missing / F.col("rows"), 4)).otherwise(0.0)))


# --- 3 and 4: quantiles and outliers -----------------------------------------------------------

def numeric_cells(df: DataFrame) -> DataFrame:
    """Long form of the numeric columns: ordinal, v (double), nulls left out."""
    return scale.long_form(df, [(i, quote(c).cast("double")) for i, c in column_index(df, numeric_columns(df))], "v")


def quantiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """ordinal, q1, median, q3 of the numeric columns; exact unless `approx`."""
    long = numeric_cells(df)
    if approx:
        out = long.groupBy("ordinal").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], 10_000).alias("q"))
    else:
        found = scale.fitted_quantiles(long, F.col("ordinal"), F.col("v"), [0.25, 0.5, 0.75])  # one row per column
        out = scale.local_table(df.sparkSession, sorted(found.items()), "ordinal int, q array<double>")
    return out.select("ordinal", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def outlier_counts(df: DataFrame) -> DataFrame:
    """ordinal, column, potential_outliers (|z| > 3), iqr_outliers."""
    moments = numeric_stats(df).select("ordinal", "mean", "std")
    stats = moments.join(quantiles(df), "ordinal", "left").collect()  # one row per column
    return named(df, count_outliers(numeric_cells(df).withColumn("cnt", F.lit(1)), stats))


def count_outliers(values: DataFrame, stats: list) -> DataFrame:
    """ordinal, potential_outliers, iqr_outliers from (ordinal, v, cnt) and fitted (mean, std, q1, q3).

    A spread of zero has no outliers.
    """
    bounds = scale.local_table(
        values.sparkSession, [(r["ordinal"], r["mean"], r["std"] or None, r["q1"], r["q3"]) for r in stats],
        "o int, mean double, std double, q1 double, q3 double")
    v, reach = F.col("v"), 1.5 * (F.col("q3") - F.col("q1"))
    far = F.abs((v - F.col("mean")) / F.col("std")) > 3
    outside = (v < F.col("q1") - reach) | (v > F.col("q3") + reach)

    def counted(test: Column, name: str) -> Column:
        return F.sum(F.when(test, F.col("cnt")).otherwise(0)).cast("bigint").alias(name)

    return (values.join(F.broadcast(bounds), F.col("ordinal") == F.col("o"))  # one row per column
            .groupBy("ordinal").agg(counted(far, "potential_outliers"), counted(outside, "iqr_outliers")))


# --- 6: first values ---------------------------------------------------------------------------

def first_values(df: DataFrame, names: list[str], order_by: list[str], k: int) -> DataFrame:
    """ordinal, value: the first k non-null values of each column in row order.

    One bounded top-k scan usually holds them all.  All columns too sparse for it share one further
    scan, in which every task keeps k values per column before the shuffle.
    """
    order = scale.columns_of(order_by)
    indexed = column_index(df, names)
    reach = 10 * k
    head = df.orderBy(*order).limit(reach)
    pairs = [F.struct(F.lit(i).alias("ordinal"), quote(c).alias("value")) for i, c in indexed]
    key = scale.order_key(order_by).alias("key")
    long = head.select(key, F.inline(F.array(*pairs))).where("value is not null")  # few rows
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("ordinal").orderBy("key")))
    found = scale.stage(ranked.where(F.col("rank") <= k).select("ordinal", "value"), "first-values")
    have = {r["ordinal"]: r["n"] for r in found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).collect()}
    sparse = [(i, c) for i, c in indexed if have.get(i, 0) < k]
    if not sparse or not scale.has_more_rows(df, reach):
        return found
    dense = found.where(~F.col("ordinal").isin([i for i, _ in sparse]))
    cells = F.filter(F.array(*[F.struct(F.lit(i).alias("ordinal"), quote(c).alias("value")) for i, c in sparse]), lambda x: x["value"].isNotNull())
    first = Window.partitionBy("ordinal").orderBy("key")
    late = df.select(key, F.inline(cells)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return dense.unionByName(late.select("ordinal", "value"))


def splittable(df: DataFrame, order_by: list[str]) -> DataFrame:
    """ordinal, delimiter, occurrence_ratio of text columns that look like several values in one.

    The first delimiter counts that is in more than 30 % of the first 100 values, has a median of
    1 to 3 and at most 5 per value, while values are shorter than 50 characters on average.
    """
    names = text_columns(df)
    if not names:
        return scale.local_table(df.sparkSession, [], "ordinal int, delimiter string, occurrence_ratio double")
    sample = first_values(df, names, order_by, SPLIT_SAMPLE)
    tries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("delimiter"),
                               text.count_of(F.col("value"), d).alias("n")) for p, d in enumerate(DELIMITERS)])
    measured = (sample.select("ordinal", F.length("value").alias("len"), F.inline(tries))
                .groupBy("ordinal", "p", "delimiter")
                .agg(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("share"), F.avg("len").alias("len"),
                     F.max("n").alias("most"), F.median("n").alias("mid")))
    fits = measured.where("share > 0.3 and len < 50 and mid > 0 and mid <= 3 and most <= 5")
    best = fits.groupBy("ordinal").agg(F.min_by(F.struct("delimiter", "share"), "p").alias("b"))
    return best.select("ordinal", F.col("b.delimiter").alias("delimiter"),
                       F.round("b.share", 4).alias("occurrence_ratio"))


# --- flags -------------------------------------------------------------------------------------

def drop_reasons(rows: Column, unique: Column, missing: Column, is_text: Column, name: Column) -> Column:
    """Array of reasons to drop a column, in fixed order."""
    lowered = F.lower(name)
    dated = lowered.contains("date") | lowered.contains("time") | lowered.contains("year")
    unique_id = is_text & (unique == rows) & (rows > 100) & ~dated
    return F.filter(F.array(
        F.when(unique <= 1, F.lit("constant_value")),
        F.when(F.try_divide(missing.cast("double"), rows.cast("double")) > 0.95, F.lit("almost_all_missing")),
        F.when(unique_id, F.lit("likely_unique_id"))), lambda x: x.isNotNull())


def column_flags(df: DataFrame, freq: DataFrame) -> DataFrame:
    """ordinal, column, unique_count, is_categorical, high_duplication, duplication_ratio, drop_reasons."""
    base = missing_profile(df).join(distinct_counts(freq), "ordinal", "left").na.fill(0, ["unique_count"])
    numeric = [i for i, _ in column_index(df, numeric_columns(df))]
    texts = [i for i, _ in column_index(df, text_columns(df))]
    unique, rows = F.col("unique_count"), F.col("rows")
    ratio = F.coalesce(1 - F.try_divide(unique.cast("double"), rows.cast("double")), F.lit(0.0))
    return base.select(
        "ordinal", "column", "unique_count",
        (~F.col("ordinal").isin(numeric) & (unique > 0) & (unique < 50)).alias("is_categorical"),
        ((ratio > 0.99) & (unique > 1)).alias("high_duplication"), F.round(ratio, 4).alias("duplication_ratio"),
        drop_reasons(rows, unique, F.col("missing_count"), F.col("ordinal").isin(texts), F.col("column"))
        .alias("drop_reasons"))


def redundant_candidates(df: DataFrame) -> list[tuple[str, str]]:
    """(numeric column, text column) whose names suggest a code and its label."""
    pairs = []
    for code in numeric_columns(df):
        base = next((code[:-len(s)] for s in CODE_SUFFIXES if code.endswith(s)), code)
        pairs += [(code, label) for label in text_columns(df) if base and label.startswith(base)]
    return pairs


def redundant_pairs(df: DataFrame) -> DataFrame:
    """column, related_column: every label has exactly one code.

    Per label only the smallest and largest code are kept, so nothing grows with the group, and
    all candidate pairs share one job.
    """
    pairs = redundant_candidates(df)
    if not pairs:
        return scale.local_table(df.sparkSession, [], "column string, related_column string")
    position = {c: i for i, c in enumerate(df.columns)}
    checks = F.array(*[F.struct(
        F.lit(position[c]).alias("o"), F.lit(c).alias("column"), F.lit(l).alias("related_column"),
        quote(l).alias("label"), quote(c).cast("double").alias("code")) for c, l in pairs])
    per_label = (df.select(F.inline(checks)).where("label is not null and code is not null")
                 .groupBy("column", "related_column", "label").agg(F.min("code").alias("lo"), F.max("code").alias("hi")))
    verdict = per_label.groupBy("column", "related_column").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("ok"))
    return verdict.where("ok").select("column", "related_column")


def target_distribution(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """value, cnt: the most frequent values of one column."""
    counts = df.where(quote(column).isNotNull()).groupBy(quote(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "value").limit(k)


# --- the whole profile -------------------------------------------------------------------------

def profile(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per column with PROFILE_FIELDS, one row of table facts)."""
    copies, columns = scale.in_parallel(
        df.sparkSession, lambda: dedupe.duplicate_count(data(nan_to_null(df))).first(), lambda: profile_columns(df, order_by))
    return columns, health(columns, copies["total_duplicates"], copies["duplicate_ratio"])


def profile_columns(df: DataFrame, order_by: list[str]) -> DataFrame:
    """One row per column with PROFILE_FIELDS.

    Every collect below returns a bounded number of rows per column (at most 35 tokens, 10
    frequent values, 5 samples).
    """
    ordered = nan_to_null(df)
    df = data(ordered)
    out: list[dict] = [dict.fromkeys(PROFILE_FIELDS) for _ in df.columns]
    for i, column in enumerate(df.schema):
        out[i].update(ordinal=i, column=column.name, dtype=kind_name(column.dataType), unique_count=0, filled=0,
                      detected_placeholders=[], sample_values=[], top_values=[], splittable=False, redundant_with=[])
    rows, _, splits, pairs = scale.in_parallel(
        df.sparkSession, df.count, lambda: _from_frequencies(df, out),
        lambda: splittable(ordered, order_by).collect(), lambda: redundant_pairs(df).collect())
    for r in splits:
        out[r["ordinal"]].update(splittable=True, suggested_delimiter=r["delimiter"], occurrence_ratio=r["occurrence_ratio"])
    for r in pairs:
        out[df.columns.index(r["column"])]["redundant_with"].append(r["related_column"])
    for row in out:
        row["redundant_with"].sort(key=df.columns.index)
        _derive(row, rows)
    return scale.local_table(df.sparkSession, [tuple(r[f] for f in PROFILE_FIELDS) for r in out], PROFILE_SCHEMA)


def _from_frequencies(df: DataFrame, out: list[dict]) -> None:
    """Everything the value-frequency table tells about the columns."""
    freq = scale.stage(value_freq(df, short=True), "frequencies")
    known = freq.where("v is not null")
    v, cnt = F.col("v"), F.col("cnt")
    for r in freq.groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("unique_count"), F.sum(cnt).alias("filled"), F.min(v).alias("min"), F.max(v).alias("max"),
            (F.sum(v * cnt) / F.sum(cnt)).alias("mean"), F.sum(F.when(v == 0, cnt).otherwise(0)).alias("zeros_count")).collect():
        row = out[r["ordinal"]]
        names = ("unique_count", "filled") if r["mean"] is None else r.asDict()
        row.update({k: r[k] for k in names})
    numeric = [r for r in out if r["dtype"] in ("int64", "float64")]
    scale.in_parallel(df.sparkSession, lambda: _listed(df, freq, out), lambda: _numeric(known, out, numeric))


def _listed(df: DataFrame, freq: DataFrame, out: list[dict]) -> None:
    """Placeholders, frequent values and samples in one job."""
    other = [r["ordinal"] for r in out if r["dtype"] not in ("int64", "float64")]
    order = F.array_position(F.array(*[F.lit(t) for t in PLACEHOLDERS]), F.col("token")).cast("int")
    parts = [
        placeholder_freq(df, freq).select(F.lit("detected_placeholders").alias("list"), "ordinal", order.alias("rank"), F.col("token").alias("value"), "cnt"),
        top_values(freq.where(F.col("ordinal").isin(other))).select(F.lit("top_values").alias("list"), "ordinal", "rank", "value", "cnt"),
        sample_values(df, freq, unique={r["ordinal"]: r["unique_count"] for r in out if r["unique_count"]}).select(F.lit("sample_values").alias("list"), "ordinal", "rank", "value", F.lit(0).cast("bigint").alias("cnt"))]
    rows = sorted(scale.union_all(parts).collect(), key=lambda r: (r["list"], r["ordinal"], r["rank"]))
    texts = full_texts(df, {(r["ordinal"], r["value"]) for r in rows if is_short_key(r["value"])})
    for r in rows:
        value = texts.get((r["ordinal"], r["value"]), r["value"])
        out[r["ordinal"]][r["list"]].append(value if r["list"] == "sample_values" else {"value": value, "count": r["cnt"]})


def _numeric(values: DataFrame, out: list[dict], numeric: list[dict]) -> None:
    """Spread, shape, quantiles and outliers from (ordinal, v, cnt)."""
    if not numeric:
        return
    spark, fitted = values.sparkSession, [r for r in numeric if r["filled"]]
    means = scale.local_table(spark, [(r["ordinal"], r["mean"]) for r in fitted], "o int, m double")
    off = F.col("v") - F.col("m")
    centred = values.join(F.broadcast(means), F.col("ordinal") == F.col("o"))  # one row per column
    counts = values.select(F.col("ordinal").alias("__group"), "v", F.col("cnt").alias("c"))
    moments, quartiles = scale.in_parallel(
        spark,
        lambda: centred.groupBy("ordinal").agg(F.sum(F.col("cnt") * off * off).alias("m2"),
                                               F.sum(F.col("cnt") * off * off * off).alias("m3")).collect(),
        lambda: scale.quantiles_of_counts(counts, [0.25, 0.5, 0.75]).collect())
    for r in moments:
        row = out[r["ordinal"]]
        row["std"], row["skewness"] = _shape(row["filled"], r["m2"], r["m3"], row["min"] == row["max"])
    for r in quartiles:
        out[r["__group"]].update(zip(("q1", "median", "q3"), r["q"]))
    for r in numeric:
        r.update(potential_outliers=0, iqr_outliers=0, zeros_count=r["zeros_count"] or 0)
    for r in count_outliers(values, fitted).collect():
        out[r["ordinal"]].update(r.asDict())


def _shape(n: int, m2: float, m3: float, constant: bool) -> tuple[float | None, float | None]:
    """Sample standard deviation and bias-corrected skewness from central sums."""
    std = math.sqrt(m2 / (n - 1)) if n > 1 else None
    if n < 3:
        return std, None
    if constant or m2 == 0:
        return std, 0.0
    return std, math.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / (m2 / n) ** 1.5


def _round4(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


def _derive(row: dict, rows: int) -> None:
    """Counts, ratios and flags that follow from the measured facts."""
    numeric, unique = row["dtype"] in ("int64", "float64"), row["unique_count"]
    row["rows"], row["null_count"] = rows, rows - row["filled"]
    row["placeholder_count"] = sum(p["count"] for p in row["detected_placeholders"])
    row["missing_count"] = row["null_count"] + row["placeholder_count"]
    missing = row["missing_count"] / rows if rows else 0.0
    spread = 1 - unique / rows if rows else 0.0
    dated = any(w in row["column"].lower() for w in ("date", "time", "year"))
    row["missing_ratio"], row["duplication_ratio"] = _round4(missing), _round4(spread)
    row["is_categorical"] = not numeric and 0 < unique < 50
    row["high_duplication"] = spread > 0.99 and unique > 1
    reasons = [("constant_value", unique <= 1), ("almost_all_missing", missing > 0.95),
               ("likely_unique_id", row["dtype"] == "object" and unique == rows and rows > 100 and not dated)]
    row["drop_reasons"] = [name for name, holds in reasons if holds]


def table_keys(df: DataFrame) -> list[str]:
    """The column that tells tables apart, if a profile covers several."""
    return [c for c in df.columns if c == "file"]


def each_table(df: DataFrame, *order) -> WindowSpec:
    """Rows of one table in an order."""
    keys = table_keys(df)
    return (Window.partitionBy(*keys) if keys else Window).orderBy(*order)


def droppable(profile: DataFrame) -> DataFrame:
    """seq, column, reasons, related_column: columns with drop reasons in table order, then redundant pairs."""
    keys = table_keys(profile)
    own = profile.where(F.size("drop_reasons") > 0).select(
        *keys, F.lit(0).alias("part"), "ordinal", F.lit(0).alias("n"), "column",
        F.array_join("drop_reasons", ", ").alias("reasons"), F.lit(None).cast("string").alias("related_column"))
    pairs = profile.select(*keys, "ordinal", "column", F.posexplode("redundant_with").alias("n", "related_column")).select(
        *keys, F.lit(1).alias("part"), "ordinal", "n", "column",
        F.concat(F.lit("redundant_encoding_of_"), "related_column").alias("reasons"), "related_column")
    both = own.unionByName(pairs)
    seq = F.row_number().over(each_table(both, "part", "ordinal", "n"))
    return both.select(*keys, seq.alias("seq"), "column", "reasons", "related_column")


def table_facts(profile: DataFrame) -> DataFrame:
    """One row per table: rows, columns, cells, gaps and flags."""
    keys = table_keys(profile)
    flags = profile.groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("rows").alias("total_cells"),
        F.sum("missing_count").alias("total_missing_cells"), F.sum("placeholder_count").alias("total_placeholder_cells"),
        F.sum(F.when(F.size("drop_reasons") > 0, 1).otherwise(0) + F.size("redundant_with")).cast("bigint")
        .alias("droppable_columns_count"),
        F.count_if("splittable").alias("splittable_columns_count"))
    complete = 1 - F.try_divide(F.col("total_missing_cells").cast("double"), F.col("total_cells").cast("double"))
    return flags.select(
        *keys, "rows", "columns", "total_cells", "total_missing_cells", "total_placeholder_cells",
        F.coalesce(F.round(complete, 4), F.lit(0.0)).alias("completeness_score"), "droppable_columns_count", "splittable_columns_count")


def health(profile: DataFrame, total_duplicates: int, duplicate_ratio: float) -> DataFrame:
    """One row: rows, columns, duplicates and overall health."""
    return table_facts(profile).select(
        "rows", "columns", "total_cells", "total_missing_cells", "total_placeholder_cells", "completeness_score",
        F.lit(total_duplicates).cast("bigint").alias("duplicate_rows"),
        F.lit(duplicate_ratio).alias("duplicate_ratio"),
        "droppable_columns_count", "splittable_columns_count")


def profile_json(profile: DataFrame, table: DataFrame) -> DataFrame:
    """One row with the profile as JSON text: one entry per column plus the table facts."""
    columns = profile.agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct("*").alias("analysis")))).alias("c"))
    facts = table.select(F.struct("*").alias("overall_health"))
    # Both sides have exactly one row.
    both = columns.withColumn("k", F.lit(1)).join(facts.withColumn("k", F.lit(1)), "k")
    return both.select(F.to_json(F.struct(
        F.col("c.analysis").alias("column_analysis"), "overall_health")).alias("profile"))
