"""Running a plan, before/after quality, ground-truth comparison and the model check."""

from __future__ import annotations

from pyspark.sql import functions as F

from limpid.operators import benchmark, columns, evaluate, filters, ml, scale
from limpid.plans import cleaning, intake, planner, runner
from registry.base import query

# A plan as an outside planner would send it, on dup_orders.
PLAN = {"steps": [
    {"step_id": 1, "phase": "treat_nulls", "column": "o_orderpriority", "operation": "replace", "params": {"old": "?", "new": "NaN"}},
    {"step_id": 2, "phase": "treat_nulls", "column": "o_orderpriority", "operation": "replace", "params": {"old": "unknown", "new": "NaN"}},
    {"step_id": 3, "phase": "treat_nulls", "column": "o_totalprice", "operation": "fill_na", "params": {"strategy": "median"}},
    {"step_id": 4, "phase": "treat_nulls", "column": "o_orderstatus", "operation": "fill_na", "params": {"strategy": "mode"}},
    {"step_id": 5, "phase": "treat_nulls", "column": "o_orderpriority", "operation": "fill_na",
     "params": {"strategy": "mode", "group_by": "o_orderstatus"}},
    {"step_id": 6, "phase": "treat_nulls", "column": "ALL_OBJECT", "operation": "strip_whitespace"},
    {"step_id": 7, "phase": "treat_duplicates", "column": None, "operation": "drop_duplicates"},
    {"step_id": 8, "phase": "populate_missing", "column": "o_totalprice", "operation": "fill_na", "params": {"strategy": "interpolate"}},
    {"step_id": 9, "phase": "drop_columns", "column": "o_custkey", "operation": "drop_column"},
    {"step_id": 10, "phase": "drop_columns", "column": "no_such_column", "operation": "drop_column"},
    {"step_id": 11, "phase": "split_columns", "column": "o_datestr", "operation": "split_column",
     "params": {"delimiter": "-", "new_columns": ["o_year", "o_month", "o_day"]}},
    {"step_id": 12, "phase": "standardize", "column": "o_pricestr", "operation": "clean_text", "params": {"remove_chars": "$,"}},
    {"step_id": 13, "phase": "standardize", "column": "o_pricestr", "operation": "cast_type", "params": {"dtype": "int"}},
    {"step_id": 14, "phase": "standardize", "column": "o_messydate", "operation": "extract_pattern",
     "params": {"pattern": "([0-9]+ [A-Za-z]+ [0-9]{4})"}},
    {"step_id": 15, "phase": "standardize", "column": "o_messydate", "operation": "format_datetime", "params": {"format": "%Y-%m-%d"}},
    {"step_id": 16, "phase": "standardize", "column": "o_timestr", "operation": "format_datetime"},
    {"step_id": 17, "phase": "standardize", "column": "o_totalprice", "operation": "remove_outliers", "params": {"method": "iqr"}},
    {"step_id": 18, "phase": "standardize", "column": "o_pricestr", "operation": "rename", "params": {"new_name": "o_price"}},
    {"step_id": 19, "phase": "standardize", "column": "o_price", "operation": "extract_pattern", "params": {"pattern": "(a)(b)"}},
    {"step_id": 20, "phase": "polish", "column": "o_price", "operation": "sparkle"},
]}

# The same plan step by step.
RUN_CTES = """
n1 AS (SELECT * REPLACE (CASE WHEN o_orderpriority = 'N/A' THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM dup_orders),
n2 AS (SELECT * REPLACE (CASE WHEN trim(o_orderpriority) IN ('?', 'unknown') THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM n1),
n3 AS (SELECT * REPLACE (coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM n2)) AS o_totalprice,
  coalesce(o_orderstatus, (SELECT o_orderstatus FROM n2 WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus) FROM n2),
gm AS (SELECT g, v FROM (SELECT o_orderstatus AS g, o_orderpriority AS v, count(*) AS n FROM n3 WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, v) = 1),
n5 AS (SELECT n3.* REPLACE (coalesce(o_orderpriority, v) AS o_orderpriority) FROM n3 LEFT JOIN gm ON o_orderstatus = g),
n6 AS (SELECT * REPLACE (trim(o_orderpriority) AS o_orderpriority) FROM n5),
n7 AS (SELECT DISTINCT * FROM n6),
n16 AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(replace(replace(o_pricestr, '$', ''), ',', '') AS BIGINT) AS o_price,
  printf('%02d:%s', CAST((o_orderkey % 12 + 1) % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 0 END AS BIGINT), lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')) AS o_timestr,
  strftime(strptime(regexp_extract(o_messydate, '([0-9]+ [A-Za-z]+ [0-9]{4})', 1), '%d %B %Y'), '%Y-%m-%d') AS o_messydate,
  split_part(o_datestr, '-', 1) AS o_year, split_part(o_datestr, '-', 2) AS o_month, split_part(o_datestr, '-', 3) AS o_day FROM n7),
fences AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM n16),
cleaned AS (SELECT n16.* FROM n16, fences WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"""


def demo(t):
    """(raw, cleaned, log) of PLAN on dup_orders."""
    raw = scale.stage(t.dup_orders, "raw")
    clean, log = runner.run(raw, intake.steps_table(t.spark, PLAN), ["o_orderkey"])
    return raw, clean, log


def after_run(body: str) -> str:
    return f"WITH {RUN_CTES.strip()}\n{body}"


# --- running -----------------------------------------------------------------------------------

@query("run_workflow", after_run("SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice) FROM cleaned"), ("dup_orders",))
def run_workflow(t):
    return demo(t)[1].withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("execution_summary", after_run("""
SELECT phase, executed, skipped, failed, CAST(affected AS BIGINT) AS affected FROM (VALUES
  ('treat_nulls', 6, 0, 0, (SELECT count(*) FILTER (trim(o_orderpriority) IN ('?', 'unknown')) FROM n1)
    + (SELECT count(*) FILTER (o_totalprice IS NULL) + count(*) FILTER (o_orderstatus IS NULL) FROM n2)
    + (SELECT count(*) FILTER (o_orderpriority IS NULL) FROM n3)),
  ('treat_duplicates', 1, 0, 0, (SELECT count(*) FROM n6) - (SELECT count(*) FROM n7)), ('populate_missing', 1, 0, 0, 0),
  ('drop_columns', 1, 1, 0, 0), ('split_columns', 1, 0, 0, 0), ('standardize', 7, 1, 1, (SELECT count(*) FROM n16) - (SELECT count(*) FROM cleaned)),
  ('other', 0, 1, 0, 0)) AS s(phase, executed, skipped, failed, affected)"""), ("dup_orders",))
def execution_summary(t):
    """Steps of each phase, and the rows and cells that they changed."""
    log = demo(t)[2]
    summary = runner.execution_summary(log)
    changed = log.groupBy("phase").agg(F.coalesce(F.sum("affected"), F.lit(0).cast("bigint")).alias("affected"))
    return summary.select("phase", *[F.col(c).cast("int").alias(c) for c in ("executed", "skipped", "failed")]).join(changed, "phase")


@query("step_counts", after_run("""
SELECT 1 AS step_id, 'replace' AS operation, (SELECT count(*) FROM n1 WHERE trim(o_orderpriority) = '?') AS affected
UNION ALL SELECT 2, 'replace', (SELECT count(*) FROM n1 WHERE trim(o_orderpriority) = 'unknown')
UNION ALL SELECT 3, 'fill_na', (SELECT count(*) FROM n2 WHERE o_totalprice IS NULL)
UNION ALL SELECT 4, 'fill_na', (SELECT count(*) FROM n2 WHERE o_orderstatus IS NULL)
UNION ALL SELECT 5, 'fill_na', (SELECT count(*) FROM n3 WHERE o_orderpriority IS NULL)
UNION ALL SELECT 7, 'drop_duplicates', (SELECT count(*) FROM n6) - (SELECT count(*) FROM n7)
UNION ALL SELECT 8, 'fill_na', 0
UNION ALL SELECT 17, 'remove_outliers', (SELECT count(*) FROM n16) - (SELECT count(*) FROM cleaned)"""), ("dup_orders",))
def step_counts(t):
    return runner.step_counts(demo(t)[2]).where("affected IS NOT NULL").select("step_id", "operation", "affected")


# The rules find placeholders, gaps, copies and two columns to split; `plan_all` checks the plan itself.
@query("rule_based_run", """
WITH n1 AS (SELECT * REPLACE (CASE WHEN trim(o_orderpriority) IN ('?', 'N/A', 'unknown') THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM dup_orders),
n2 AS (SELECT * REPLACE (
  coalesce(o_orderstatus, (SELECT o_orderstatus FROM n1 WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus,
  coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM n1)) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM n1 WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM n1)
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, trim(o_orderpriority) AS o_orderpriority, o_datestr, o_messydate,
  trim(o_pricestr) AS o_pricestr_part1, trim(split_part(o_timestr, ':', 1)) AS o_timestr_part1, trim(split_part(o_timestr, ':', 2)) AS o_timestr_part2 FROM n2""", ("dup_orders",))
def rule_based_run(t):
    raw = scale.stage(t.dup_orders, "raw")
    analysis = cleaning.analyze(raw, ["o_orderkey"])
    return runner.run(raw, analysis.steps, ["o_orderkey"])[0].withColumn("o_totalprice", F.round("o_totalprice", 4))


# --- before and after --------------------------------------------------------------------------

RAW_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_datestr", "o_pricestr", "o_timestr", "o_messydate"]
CLEAN_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_price", "o_timestr", "o_messydate", "o_year", "o_month", "o_day"]


def missing(table: str, names: list[str]) -> str:
    return "(SELECT " + " + ".join(f"(count(*) - count({c}))" for c in names) + f" FROM {table})"


@query("quality_nulls", after_run("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT count(*) - count({c}) FROM dup_orders) AS raw_missing, "
    + (f"(SELECT count(*) - count({c}) FROM cleaned)" if c in CLEAN_COLUMNS else "NULL") + " AS clean_missing, "
    + (f"'{'kept' if c in CLEAN_COLUMNS else 'column_dropped'}' AS status") for c in RAW_COLUMNS)), ("dup_orders",))
def quality_nulls(t):
    raw, clean, _ = demo(t)
    return evaluate.quality_nulls(raw, clean).withColumnRenamed("column", "column_name")


_RAW_MISSING, _CLEAN_MISSING = missing("dup_orders", RAW_COLUMNS), missing("cleaned", CLEAN_COLUMNS)


@query("quality_reduction", after_run(f"""
SELECT {_RAW_MISSING} AS total_missing_raw, {_CLEAN_MISSING} AS total_missing_clean,
  round(({_RAW_MISSING} - {_CLEAN_MISSING}) / {_RAW_MISSING} * 100, 2) AS reduction_pct"""), ("dup_orders",))
def quality_reduction(t):
    raw, clean, _ = demo(t)
    return evaluate.quality_summary(raw, clean)


@query("quality_duplicates", after_run("""
SELECT r AS duplicates_raw, c AS duplicates_clean, r - c AS duplicates_removed FROM
  (SELECT (SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS r,
          (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS c)"""), ("dup_orders",))
def quality_duplicates(t):
    raw, clean, _ = demo(t)
    return evaluate.quality_duplicates(raw, clean)


@query("quality_completeness", after_run(f"""
SELECT round((1 - {_RAW_MISSING} / (SELECT count(*) * {len(RAW_COLUMNS)} FROM dup_orders)) * 100, 2) AS completeness_raw,
  round((1 - {_CLEAN_MISSING} / (SELECT count(*) * {len(CLEAN_COLUMNS)} FROM cleaned)) * 100, 2) AS completeness_clean"""), ("dup_orders",))
def quality_completeness(t):
    raw, clean, _ = demo(t)
    return evaluate.quality_completeness(raw, clean)


@query("quality_schema", after_run(f"""
SELECT {len(RAW_COLUMNS)}::BIGINT AS columns_raw, {len(CLEAN_COLUMNS)}::BIGINT AS columns_clean,
  '{", ".join(c for c in RAW_COLUMNS if c not in CLEAN_COLUMNS)}' AS columns_dropped,
  {len([c for c in RAW_COLUMNS if c not in CLEAN_COLUMNS])}::BIGINT AS columns_dropped_count,
  '{", ".join(c for c in CLEAN_COLUMNS if c not in RAW_COLUMNS)}' AS new_columns,
  {len([c for c in CLEAN_COLUMNS if c not in RAW_COLUMNS])}::BIGINT AS new_columns_count,
  (SELECT count(*) FROM dup_orders) * {len(RAW_COLUMNS)} AS cells_raw, (SELECT count(*) FROM cleaned) * {len(CLEAN_COLUMNS)} AS cells_clean"""), ("dup_orders",))
def quality_schema(t):
    raw, clean, _ = demo(t)
    cells = (df.agg((F.count(F.lit(1)) * len(df.columns)).alias(name)) for df, name in ((raw, "cells_raw"), (clean, "cells_clean")))
    return evaluate.side_by_side(evaluate.quality_schema(raw, clean), *cells)


@query("quality_rows", after_run("""
SELECT r AS rows_raw, c AS rows_clean, round(c / r * 100, 2) AS retention_pct FROM
  (SELECT (SELECT count(*) FROM dup_orders) AS r, (SELECT count(*) FROM cleaned) AS c)"""), ("dup_orders",))
def quality_rows(t):
    raw, clean, _ = demo(t)
    return evaluate.quality_rows(raw, clean)


# --- ground truth ------------------------------------------------------------------------------

# The cleaned side loses rows to a cleaning step, so positions shift against the truth.
SHIFTED = """
a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, * FROM (SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL)),
b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, * FROM bench_orders),
pairs AS (SELECT a.pos, a.o_orderkey AS ck, b.o_orderkey AS tk, a.o_orderpriority AS cp, b.o_orderpriority AS tp, a.o_orderstatus AS cs, b.o_orderstatus AS ts,
  a.o_totalprice AS cv, b.o_totalprice AS tv FROM a JOIN b USING (pos))"""
CELLS = """
tests AS (SELECT pos, ck IS NOT DISTINCT FROM tk AS k, lower(trim(cp)) IS NOT DISTINCT FROM lower(trim(tp)) AS p,
  lower(trim(cs)) IS NOT DISTINCT FROM lower(trim(ts)) AS s, round(cv, 4) IS NOT DISTINCT FROM round(tv, 4) AS v FROM pairs),
per_column AS (
  SELECT 'o_orderkey' AS column_name, count(*) FILTER (k) AS matches, count(*) AS total FROM tests
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (p), count(*) FROM tests
  UNION ALL SELECT 'o_orderstatus', count(*) FILTER (s), count(*) FROM tests
  UNION ALL SELECT 'o_totalprice', count(*) FILTER (v), count(*) FROM tests),
nulls AS (SELECT count(*) + count(*) FILTER ((cp IS NULL) = (tp IS NULL)) + count(*) FILTER ((cs IS NULL) = (ts IS NULL))
  + count(*) FILTER ((cv IS NULL) = (tv IS NULL)) AS null_matches, 4 * count(*) AS total_cells FROM pairs),
valued AS (SELECT count(*) + count(*) FILTER (cp IS NOT NULL AND tp IS NOT NULL) + count(*) FILTER (cs IS NOT NULL AND ts IS NOT NULL)
  + count(*) FILTER (cv IS NOT NULL AND tv IS NOT NULL) AS valued_cells,
  count(*) FILTER (ck = tk) + count(*) FILTER (lower(trim(cp)) = lower(trim(tp))) + count(*) FILTER (lower(trim(cs)) = lower(trim(ts)))
  + count(*) FILTER (round(cv, 4) = round(tv, 4)) AS value_matches FROM pairs)"""


def compared(body: str) -> str:
    return f"WITH {SHIFTED.strip()},\n{CELLS.strip()}\n{body}"


def sides(t):
    return filters.drop_missing(t.dirty_orders, "o_totalprice"), t.bench_orders


def comparison(t):
    return benchmark.Comparison(benchmark.align(*sides(t), ["o_orderkey"]))


@query("bench_align", compared("SELECT pos, ck, tk, cp, tp FROM pairs"), ("dirty_orders", "bench_orders"))
def bench_align(t):
    aligned = benchmark.align(*sides(t), ["o_orderkey"])
    return aligned.select(F.col("pos").cast("bigint").alias("pos"), F.col("c.o_orderkey").alias("ck"), F.col("t.o_orderkey").alias("tk"),
                          F.col("c.o_orderpriority").alias("cp"), F.col("t.o_orderpriority").alias("tp"))


@query("bench_by_key", """
SELECT count(*) AS rows, count(*) FILTER (c.o_orderkey = t.o_orderkey AND lower(trim(c.o_orderpriority)) IS NOT DISTINCT FROM t.o_orderpriority
  AND lower(c.o_orderstatus) IS NOT DISTINCT FROM lower(t.o_orderstatus) AND c.o_totalprice IS NOT DISTINCT FROM t.o_totalprice) AS matching_rows,
  count(*) FILTER (c.o_orderkey = t.o_orderkey) AS matched, count(*) FILTER (t.o_orderkey IS NULL) AS only_clean, count(*) FILTER (c.o_orderkey IS NULL) AS only_truth
FROM (SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL) c
FULL JOIN (SELECT * FROM bench_orders WHERE o_orderpriority IS NOT NULL) t ON c.o_orderkey = t.o_orderkey""", ("dirty_orders", "bench_orders"))
def bench_by_key(t):
    """Both sides have lost rows to a cleaning step."""
    clean, truth = filters.drop_missing(t.dirty_orders, "o_totalprice"), filters.drop_missing(t.bench_orders, "o_orderpriority")
    compare = benchmark.Comparison(benchmark.align(clean, truth, ["o_orderkey"], key=["o_orderkey"]))
    return evaluate.side_by_side(compare.row_matches(), compare.sides().drop("rows"))


@query("bench_cells", compared("""
SELECT CAST(sum(matches) AS BIGINT) AS matching_cells, CAST(sum(total) AS BIGINT) AS total_cells,
  round(sum(matches) / sum(total) * 100, 2) AS overall_cell_accuracy FROM per_column"""), ("dirty_orders", "bench_orders"))
def bench_cells(t):
    return benchmark.cell_accuracy(comparison(t).columns())


@query("bench_columns", compared("""
SELECT column_name, round(matches / total * 100, 2) AS accuracy, matches, total, total - matches AS mismatches FROM per_column
"""), ("dirty_orders", "bench_orders"))
def bench_columns(t):
    return benchmark.column_accuracy(comparison(t).columns()).withColumnRenamed("column", "column_name")


@query("bench_mismatch_samples", compared("""
SELECT * FROM (
  SELECT 'o_orderkey' AS column_name, pos, CAST(ck AS VARCHAR) AS cleaned_value, CAST(tk AS VARCHAR) AS benchmark_value FROM pairs JOIN tests USING (pos) WHERE NOT k
  UNION ALL SELECT 'o_orderpriority', pos, coalesce(cp, 'nan'), coalesce(tp, 'nan') FROM pairs JOIN tests USING (pos) WHERE NOT p
  UNION ALL SELECT 'o_orderstatus', pos, coalesce(cs, 'nan'), coalesce(ts, 'nan') FROM pairs JOIN tests USING (pos) WHERE NOT s
  UNION ALL SELECT 'o_totalprice', pos, coalesce(CAST(cv AS VARCHAR), 'nan'), coalesce(CAST(tv AS VARCHAR), 'nan') FROM pairs JOIN tests USING (pos) WHERE NOT v)
QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY pos) <= 3"""), ("dirty_orders", "bench_orders"))
def bench_mismatch_samples(t):
    found = comparison(t).mismatches()
    return found.withColumnRenamed("column", "column_name").withColumn("pos", F.col("pos").cast("bigint"))


@query("bench_rows", compared("""
SELECT count(*) AS rows, count(*) FILTER (k AND p AND s AND v) AS matching_rows,
  round(count(*) FILTER (k AND p AND s AND v) / count(*) * 100, 2) AS row_exact_match_rate FROM tests"""), ("dirty_orders", "bench_orders"))
def bench_rows(t):
    return benchmark.row_accuracy(comparison(t).row_matches())


@query("bench_nulls", compared("""
SELECT null_matches, total_cells, round(null_matches / total_cells * 100, 2) AS null_handling_accuracy FROM nulls"""), ("dirty_orders", "bench_orders"))
def bench_nulls(t):
    return benchmark.null_accuracy(comparison(t).columns())


@query("bench_values", compared("""
SELECT value_matches, valued_cells, round(value_matches / valued_cells * 100, 2) AS value_match_accuracy FROM valued"""), ("dirty_orders", "bench_orders"))
def bench_values(t):
    return benchmark.value_accuracy(comparison(t).columns())


@query("schema_match", """
SELECT 'o_orderkey, o_orderpriority, o_orderstatus, o_totalprice' AS common_columns, '' AS missing_from_cleaned,
  'o_custkey, o_datestr, o_messydate, o_pricestr, o_timestr' AS extra_in_cleaned,
  round(4 / 9, 4) AS schema_precision, 1.0::DOUBLE AS schema_recall, round(2 * (4 / 9) / (4 / 9 + 1), 4) AS schema_f1,
  (SELECT count(*) FROM dirty_orders) AS cleaned_rows, (SELECT count(*) FROM bench_orders) AS benchmark_rows""",
       ("dirty_orders", "bench_orders"))
def schema_match(t):
    clean, truth = t.dirty_orders, t.bench_orders
    counts = (clean.agg(F.count(F.lit(1)).alias("cleaned_rows")), truth.agg(F.count(F.lit(1)).alias("benchmark_rows")))
    return evaluate.side_by_side(benchmark.schema_match(clean, truth), *counts)


@query("bench_summary", compared("""
SELECT round(cells * 100, 2) AS overall_cell_accuracy, round(exact * 100, 2) AS row_exact_match_rate, round(nul * 100, 2) AS null_handling_accuracy,
  round(val * 100, 2) AS value_match_accuracy, round(2 * (4 / 9) / (4 / 9 + 1), 4) AS schema_f1,
  (SELECT count(*) FROM a) AS cleaned_rows, (SELECT count(*) FROM b) AS benchmark_rows, (SELECT count(*) FROM pairs) AS rows_compared,
  (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS row_count_match,
  'Agreement: ' || round(cells * 100, 2) || '% of cells, ' || round(exact * 100, 2) || '% of whole rows, ' ||
  round(val * 100, 2) || '% of cells with values on both sides; column names: F1 ' || round(2 * (4 / 9) / (4 / 9 + 1), 4) AS summary
FROM (SELECT (SELECT sum(matches) / sum(total) FROM per_column) AS cells, (SELECT count(*) FILTER (k AND p AND s AND v) / count(*) FROM tests) AS exact,
  (SELECT null_matches / total_cells FROM nulls) AS nul, (SELECT value_matches / valued_cells FROM valued) AS val)"""), ("dirty_orders", "bench_orders"))
def bench_summary(t):
    return benchmark.summary(*sides(t), ["o_orderkey"])


# --- model -------------------------------------------------------------------------------------

@query("ml_task_type", """
SELECT target, n_rows, unique_count, CASE WHEN unique_count <= 20 OR (unique_count / n_rows < 0.05 AND unique_count <= 50) THEN 'classification'
  WHEN numeric THEN 'regression' WHEN unique_count > 100 THEN 'skip' ELSE 'classification' END AS task_type
FROM (SELECT 'o_orderstatus' AS target, false AS numeric, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS unique_count FROM dirty_orders
  UNION ALL SELECT 'o_totalprice', true, count(*), count(DISTINCT o_totalprice) FROM dirty_orders
  UNION ALL SELECT 'o_messydate', false, count(*), count(DISTINCT o_messydate) FROM dirty_orders)""", ("dirty_orders",))
def ml_task_type(t):
    parts = [ml.task_type(t.dirty_orders, c).withColumn("target", F.lit(c)) for c in ("o_orderstatus", "o_totalprice", "o_messydate")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumnRenamed("rows", "n_rows")


def model_sides(t):
    """Events with and without their gaps."""
    raw = t.dirty_events
    clean = columns.normalize_nulls(raw).na.fill({"event_type": "unknown", "user_id": -1, "value": 0.0})
    return raw, clean


# The features of dirty_events in SQL: codes by sorted value, nulls by mode.
@query("ml_features", """
WITH f AS (SELECT event_id, user_id, value, event_type, props FROM dirty_events WHERE event_type IS NOT NULL),
m AS (SELECT (SELECT user_id FROM f WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mu,
  (SELECT value FROM f WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mv)
SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(coalesce(user_id, mu) AS DOUBLE) AS user_id, coalesce(value, mv) AS value,
  CAST(dense_rank() OVER (ORDER BY props) - 1 AS DOUBLE) AS props, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS label
FROM f, m""", ("dirty_events",))
def ml_features(t):
    return ml.features(t.dirty_events, "event_type", "classification", ["event_id"]).drop("__id")


def model_check(t, target: str):
    """What of an evaluation is exact: task, metrics and their ranges, the improvement as the rounded difference,
    and the rows of both sides' training and test parts."""
    raw, clean = model_sides(t)
    found = ml.evaluate(raw, clean, target, ["event_id"])
    task = found.first()["task_type"]
    sizes = {}
    for side, df in (("raw", raw), ("clean", clean)):
        parts = ml.split(ml.features(df, target, task, ["event_id"]))
        sizes.update({f"{side}_train": parts[0].count(), f"{side}_test": parts[1].count()})
    high = F.when(F.col("metric") == "rmse", float("inf")).otherwise(1.0)
    scale_of = F.when(F.col("metric") == "rmse", 1.0).otherwise(100.0)
    low = F.when(F.col("metric") == "r2", float("-inf")).otherwise(0.0)
    ranged = F.col("raw").between(low, high) & F.col("clean").between(low, high)
    return found.select("task_type", "metric", ranged.alias("in_range"),
                        (F.abs(F.abs(F.col("improvement")) - F.abs(F.col("clean") - F.col("raw")) * scale_of) < 0.02).alias("is_difference"),
                        *[F.lit(n).cast("bigint").alias(name) for name, n in sizes.items()])


def _model_sql(task: str, metrics: tuple[str, str], target: str) -> str:
    # Every row of the clean side has a target, and the raw side those that the view left in place.
    part = f"CAST('0x' || substr(md5(concat_ws(',', CAST(event_id AS VARCHAR), '{ml.SEED}')), 1, 15) AS BIGINT) % 10 < 8"
    sides = ", ".join(f"(SELECT count(*) FROM dirty_events WHERE {keep} AND ({'' if name.endswith('train') else 'NOT '}{part})) AS {name}"
                      for name, keep in (("raw_train", f"{target} IS NOT NULL"), ("raw_test", f"{target} IS NOT NULL"), ("clean_train", "true"), ("clean_test", "true")))
    return "\nUNION ALL ".join(f"SELECT '{task}' AS task_type, '{m}' AS metric, true AS in_range, true AS is_difference, {sides}" for m in metrics)


@query("ml_classification", _model_sql("classification", ("accuracy", "f1"), "event_type"), ("dirty_events",))
def ml_classification(t):
    return model_check(t, "event_type")


@query("ml_regression", _model_sql("regression", ("r2", "rmse"), "value"), ("dirty_events",))
def ml_regression(t):
    return model_check(t, "value")


@query("ml_scores")
def ml_scores(t):
    """The scores themselves, of both tasks; a fixture in the tests holds the models to known ones."""
    raw, clean = model_sides(t)
    found = [ml.evaluate(raw, clean, target, ["event_id"]) for target in ("event_type", "value")]
    return scale.union_all(found).select("task_type", "metric", "raw", "clean", "improvement")


@query("run_report", after_run("""
, a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, * FROM cleaned),
b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, * FROM bench_orders),
n AS (SELECT count(*) AS n FROM a JOIN b USING (pos))
SELECT 'quality_metrics' AS section, (SELECT count(*) FROM dup_orders) || ' ' || (SELECT count(*) FROM cleaned) AS fact
UNION ALL SELECT 'execution_summary', (SELECT count(*) FILTER (s IN ('treat_nulls', 'treat_duplicates', 'populate_missing', 'drop_columns', 'split_columns', 'standardize')) + 1
  FROM (SELECT DISTINCT phase AS s FROM (VALUES ('treat_nulls'), ('treat_duplicates'), ('populate_missing'), ('drop_columns'), ('split_columns'), ('standardize')) AS v(phase))) || ''
UNION ALL SELECT 'benchmark_accuracy', (SELECT count(*) FROM cleaned) || ' ' || (SELECT count(*) FROM bench_orders) || ' ' || n FROM n
UNION ALL SELECT 'benchmark_columns', 'o_orderkey ' || n || ' ' || (SELECT count(*) FROM a JOIN b USING (pos) WHERE a.o_orderkey = b.o_orderkey) FROM n
UNION ALL SELECT 'benchmark_mismatches', 'o_orderkey ' || coalesce((SELECT min(pos) FROM a JOIN b USING (pos) WHERE a.o_orderkey <> b.o_orderkey) || '', 'none')
UNION ALL SELECT 'benchmark_schema', 'o_orderkey, o_orderpriority, o_orderstatus, o_totalprice'""").replace("BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))\n\n,", "BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),"),
       ("dup_orders", "bench_orders"))
def run_report(t):
    """Every section of the report with a fact read back from its JSON."""
    raw, truth = t.dup_orders, t.bench_orders
    steps = planner.validate(intake.steps_table(t.spark, PLAN))
    report = cleaning.report(cleaning.clean(raw, ["o_orderkey"], steps=steps, truth=truth))
    rows = F.from_json("report", "array<struct<rows_raw:string,rows_clean:string,cleaned_rows:string,benchmark_rows:string,rows_compared:string,column:string,"
                                 "total:string,matches:string,pos:bigint,common_columns:string>>")
    keys = F.filter("r", lambda x: x["column"] == "o_orderkey")
    one = F.get("r", F.lit(0))
    fact = (F.when(F.col("section") == "quality_metrics", F.concat_ws(" ", one["rows_raw"], one["rows_clean"]))
            .when(F.col("section") == "execution_summary", F.size("r").cast("string"))
            .when(F.col("section") == "benchmark_accuracy", F.concat_ws(" ", one["cleaned_rows"], one["benchmark_rows"], one["rows_compared"]))
            .when(F.col("section") == "benchmark_columns", F.concat_ws(" ", F.lit("o_orderkey"), F.get(keys, F.lit(0))["total"], F.get(keys, F.lit(0))["matches"]))
            .when(F.col("section") == "benchmark_mismatches", F.concat(F.lit("o_orderkey "), F.coalesce(F.array_min(F.transform(keys, lambda x: x["pos"])).cast("string"), F.lit("none"))))
            .when(F.col("section") == "benchmark_schema", one["common_columns"]).otherwise(F.col("report")))
    return report.withColumn("r", rows).select("section", fact.alias("fact"))
