"""Effect of cleaning on a model: a random forest on the raw and on the cleaned table."""

from __future__ import annotations

import math

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import datetimes, numbers
from limpid.functions.constants import ROW_ID, TIME_SAMPLE
from limpid.functions.text import quote
from limpid.operators import forest, impute, scale
from limpid.operators.columns import text_columns, timestamp_columns
from limpid.operators.profile import first_values

TREES = 50
SEED = 42
# Rows of a model's table in one task: they are few bytes but much work, so their number decides, not their size.
TASK_ROWS = 25_000
# Tasks for each core at most: every task of a forest sends sums of all nodes, whatever rows it has.
CORE_TASKS = 3


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, unique_count, task_type ("classification", "regression", "skip")."""
    dtype = df.schema[target].dataType
    values = df.groupBy(quote(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    facts = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("v").alias("unique_count"))
    unique = F.col("unique_count")
    few = (unique <= 20) | ((F.try_divide(unique.cast("double"), F.col("rows").cast("double")) < 0.05) & (unique <= 50))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        task = F.lit("regression")
    elif numbers.is_numeric(dtype):
        task = F.when(few, "classification").otherwise("regression")
    else:
        task = F.when(few | (unique <= 100), "classification").otherwise("skip")
    return facts.withColumn("task_type", task)


def alphabetical_codes(df: DataFrame, column: str) -> DataFrame:
    """Replace text by the position of its value in the sorted distinct values (0-based); null stays.

    The codes are dense positions over the distinct values, built in range buckets, and joined
    back by value: no label list passes through the driver.
    """
    counts = df.where(quote(column).isNotNull()).groupBy(quote(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    counts = scale.stage(counts, "label-counts")
    groups = scale.groups_of(counts)
    codes = scale.with_position(counts.select(F.col("key").alias("__group")), ["__group"], "__code")
    joined = scale.join_group_values(df, codes, column, groups)
    return joined.withColumn(column, F.col("__code").cast("double")).drop("__code")


def text_codes(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict]:
    """(ordinal, value, n, code) of every value of every text column, n its rows, and per column (values, bytes of the
    values, largest n).

    The values of all columns are counted, ordered and numbered together, so the number of jobs does
    not depend on the number of columns.
    """
    cells = scale.long_form(df, [(i, quote(n)) for i, n in enumerate(names)], "value")
    counts = scale.stage(cells.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    placed = scale.with_position(counts, ["ordinal", "value"], "pos")
    first = placed.groupBy("ordinal").agg(F.min("pos").alias("first"))  # one row per column
    codes = scale.stage(placed.join(F.broadcast(first), "ordinal").select("ordinal", "value", "n", (F.col("pos") - F.col("first")).cast("double").alias("code")), "codes")
    facts = counts.groupBy("ordinal").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.octet_length("value")).alias("bytes"), F.max("n").alias("largest"))
    return codes, {r["ordinal"]: (r["groups"], r["bytes"], r["largest"]) for r in facts.collect()}


def with_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """Every text column of `names` as the position of its value among the column's sorted values (0-based); null stays.

    Columns with few values, few in all, are looked up in broadcast tables.  All others share one long-form join:
    (row, column, value) meets the codes by (column, value) and is regrouped by row, so the exchanges do not depend on
    the number of columns.  Values of more than GROUP_ROWS rows are looked up before that join and never shuffled.
    A column __row of the input is replaced and goes.
    """
    if not names:
        return df
    codes, facts = text_codes(df, names)
    small, values, size = set(), 0, 0
    for i in sorted(range(len(names)), key=lambda i: facts.get(i, (0, 0, 0))[:2]):
        values, size = values + facts.get(i, (0, 0, 0))[0], size + facts.get(i, (0, 0, 0))[1]
        if values <= scale.BROADCAST_ROWS and size <= scale.BROADCAST_BYTES:
            small.add(i)
    large = [i for i in range(len(names)) if i not in small]
    if large:
        df = scale.stage(df.withColumn("__row", F.monotonically_increasing_id()), "rows-to-code")
        own = df.columns
        flat = [x for i in large for x in (F.lit(i), quote(names[i]))]
        cells = df.select("__row", F.stack(F.lit(len(large)), *flat).alias("ordinal", "value")).where(F.col("value").isNotNull())
        by_row = _coded(cells, codes, any(facts[i][2] > scale.GROUP_ROWS for i in large)) \
            .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "code"))).alias("__codes"))
        found = {names[i]: F.try_element_at("__codes", F.lit(i)).alias(names[i]) for i in large}
        df = df.join(by_row, "__row", "left").select(*[found.get(c, quote(c)) for c in own if c != "__row"])
    for i in sorted(small):
        own = codes.where(F.col("ordinal") == i).select(F.col("value").alias("__group"), F.col("code").alias("__code"))
        df = df.join(F.broadcast(own), quote(names[i]) == F.col("__group"), "left").withColumn(names[i], F.col("__code")).drop("__group", "__code")
    return df


def _coded(cells: DataFrame, codes: DataFrame, any_hot: bool) -> DataFrame:
    """(__row, ordinal, code) of (__row, ordinal, value)."""
    known = codes.select("ordinal", "value", "code")
    if not any_hot:
        return cells.join(known, ["ordinal", "value"]).select("__row", "ordinal", "code")
    # The table of frequent values stays below BROADCAST_ROWS x 256 bytes; a value beyond it takes the join.
    hot = codes.where((F.col("n") > scale.GROUP_ROWS) & (F.octet_length("value") <= 256)).orderBy(F.desc("n"), "ordinal", "value") \
        .limit(scale.BROADCAST_ROWS).select("ordinal", "value", F.col("code").alias("hot_code"))
    met = cells.join(F.broadcast(hot), ["ordinal", "value"], "left")
    rest = met.where(F.col("hot_code").isNull()).join(known, ["ordinal", "value"]).select("__row", "ordinal", "code")
    return met.where(F.col("hot_code").isNotNull()).select("__row", "ordinal", F.col("hot_code").alias("code")).unionAll(rest)


def date_like(df: DataFrame, names: list[str], order_by: list[str]) -> list[str]:
    """Text columns whose first 20 values all read as dates or times."""
    if not names:
        return []
    sample = first_values(df, names, order_by, TIME_SAMPLE)
    reads = (datetimes.to_timestamp(F.col("value"), T.StringType()).isNotNull() | datetimes.is_time_text(F.col("value")))
    rows = sample.groupBy("ordinal").agg(F.bool_and(reads).alias("ok")).where("ok").collect()
    return [df.columns[r["ordinal"]] for r in rows]


def features(df: DataFrame, target: str, task: str, order_by: list[str]) -> DataFrame:
    """__id (row key hash), numeric feature columns, label.

    Rows without target go; timestamps and date-like text go; text becomes alphabetical codes;
    nulls take the most frequent value; columns without any value go.
    """
    df = df.where(quote(target).isNotNull())
    dated = set(timestamp_columns(df)) | set(date_like(df, [c for c in text_columns(df) if c != target], order_by))
    names = [c for c in df.columns if c not in dated and c not in (target, ROW_ID)]
    dtype = df.schema[target].dataType
    clash = {n: f"{n}_feature" for n in names if n.lower() in ("label", "__id")}  # the result has columns of these names
    df, names = df.withColumnsRenamed(clash), [clash.get(n, n) for n in names]
    keys = [quote(clash.get(c, c)).cast("string") for c in order_by]
    digest = F.md5(F.concat_ws(",", *keys, F.lit(str(SEED))).cast("binary"))
    row = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("__id")
    out = df.select(row, *scale.columns_of(names), _label(dtype, target, task).alias("label"))
    texts = [n for n in names if isinstance(out.schema[n].dataType, T.StringType)]
    out = with_codes(out, texts).withColumns({n: quote(n).cast("double") for n in names if n not in texts})
    rows, *present = out.agg(F.count(F.lit(1)), *[F.count(quote(n)) for n in [*names, "label"]]).first()
    empty = [n for n, k in zip(names, present) if not k]
    gaps = [n for n, k in zip(names, present) if 0 < k < rows]  # the others need no mode
    out = impute.fill_values(out.drop(*empty), impute.fit(out, {n: "mode" for n in gaps}))
    if task == "classification":
        return alphabetical_codes(out, "label")
    return impute.fill_statistic(out, ["label"], "median") if present[-1] < rows else out


def _label(dtype: T.DataType, target: str, task: str):
    value = quote(target)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value, dtype = datetimes.minutes_of_day(value), T.IntegerType()
    if task == "classification":
        return numbers.plain_text(value, dtype)
    return numbers.to_double(value, dtype)


def assembled(table: DataFrame) -> DataFrame:
    """__id, features (array), label.  Codes count as plain numbers, so no category limit applies."""
    names = [c for c in table.columns if c not in ("__id", "label")]
    values = F.array(*[F.coalesce(quote(c).cast("double"), F.lit(float("nan"))) for c in names])
    return table.select("__id", values.cast("array<double>").alias("features"), "label")


def split(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """80/20 by a hash of the row key: the same for both tables and for any partitioning."""
    part = F.pmod(F.col("__id"), F.lit(10))
    return table.where(part < 8), table.where(part >= 8)


def spread(table: DataFrame) -> DataFrame:
    """The rows dealt by their key to tasks whose number follows from the rows and is bounded by the cores, and sorted."""
    tasks = min(math.ceil(table.count() / TASK_ROWS), CORE_TASKS * table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(max(1, tasks), "__id").sortWithinPartitions("__id", *[c for c in table.columns if c != "__id"])


def score(df: DataFrame, target: str, task: str, order_by: list[str], max_depth: int = 10) -> dict[str, float]:
    """Accuracy and weighted F1, or R2 and RMSE, on the held-out fifth."""
    table = scale.stage(assembled(features(df, target, task, order_by)), "features")
    train, test = split(spread(table))
    if task == "classification":
        metrics = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy"),
                   "f1": MulticlassClassificationEvaluator(metricName="f1")}
    else:
        metrics = {"r2": RegressionEvaluator(metricName="r2"), "rmse": RegressionEvaluator(metricName="rmse")}
    classes = task == "classification"
    model = forest.fit(train, split(table)[0], classes=classes, trees=TREES, depth=max_depth, per_node="sqrt" if classes else "all", seed=SEED)
    predicted = scale.stage(model.predict(test), "predictions")
    return {name: evaluator.evaluate(predicted) for name, evaluator in metrics.items()}


def evaluate(raw: DataFrame, clean: DataFrame, target: str, order_by: list[str], max_depth: int = 10) -> DataFrame:
    """metric, raw, clean, improvement (percentage points; RMSE in its own unit), or one skipped row."""
    spark = raw.sparkSession
    schema = "task_type string, metric string, raw double, clean double, improvement double, reason string"
    if target not in raw.columns or target not in clean.columns:
        return scale.local_table(spark, [("skip", None, None, None, None, f"no column {target}")], schema)
    facts = task_type(raw, target).first()
    task = facts["task_type"]
    if task == "skip":
        reason = f"{facts['unique_count']} different values are too many for classes"
        return scale.local_table(spark, [("skip", None, None, None, None, reason)], schema)
    scale.shared_dir(spark)  # one for both sides
    before, after = scale.in_parallel(spark, *[lambda side=side: score(side, target, task, order_by, max_depth) for side in (raw, clean)])
    rows = []
    for name in before:
        gain = round(before[name] - after[name], 4) if name == "rmse" else round((after[name] - before[name]) * 100, 2)
        rows.append((task, name, round(before[name], 4), round(after[name], 4), gain, None))
    return scale.local_table(spark, rows, schema)
