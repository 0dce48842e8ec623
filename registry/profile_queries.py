"""Profile, snapshot, issues and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from limpid.operators import dedupe, scale
from limpid.operators import profile as profiling
from limpid.operators import snapshot
from limpid.plans import issues, planner
from registry.base import query
from registry.profile_sql import KEYS, NUMERIC, OUTLIER_TEXT, SKEW_TEXT, SKEWED, fixed, plan_cte, profile_ctes


def over(view: str, body: str) -> str:
    """Check SQL on top of the profile of one view."""
    return f"WITH {profile_ctes(view)}\n{body}"


def planned(view: str, body: str) -> str:
    return f"WITH {profile_ctes(view)},\n{plan_cte()}\n{body}"


def profiled(t, view: str):
    """(profile, table facts) of a view."""
    return profiling.profile(getattr(t, view), [KEYS[view]])


def by_name(df):
    return df.drop("ordinal").withColumnRenamed("column", "column_name").withColumnRenamed("rows", "n_rows")


# --- pieces of the profile ---------------------------------------------------------------------

@query("null_counts", over("dirty_orders", "SELECT column_name, n_rows, null_count FROM profile"), ("dirty_orders",))
def null_counts(t):
    return by_name(profiling.null_counts(t.dirty_orders))


@query("placeholder_counts", over("dirty_orders", "SELECT column_name, token, cnt FROM tokens"), ("dirty_orders",))
def placeholder_counts(t):
    return by_name(profiling.named(t.dirty_orders, profiling.placeholder_cells(t.dirty_orders)))


@query("missing_profile", over("dirty_orders", """
SELECT column_name, n_rows, null_count, placeholder_count, missing_count, missing_ratio FROM profile"""), ("dirty_orders",))
def missing_profile(t):
    return by_name(profiling.missing_profile(t.dirty_orders))


@query("duplicate_rows", over("dup_orders", """
SELECT (SELECT count(*) FROM dup_orders) AS n_rows, dups AS total_duplicates,
  round(dups / (SELECT count(*) FROM dup_orders), 4) AS duplicate_ratio FROM copies"""), ("dup_orders",))
def duplicate_rows(t):
    return by_name(dedupe.duplicate_count(t.dup_orders))


@query("distinct_counts", over("dirty_orders", "SELECT column_name, unique_count FROM profile"), ("dirty_orders",))
def distinct_counts(t):
    return by_name(profiling.named(t.dirty_orders, profiling.distinct_counts(profiling.value_freq(t.dirty_orders))))


@query("approx_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS within_error FROM lineitem" for c in
    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")))
def approx_distinct(t):
    """Sketches of seven parts of the rows, merged, against exact counts."""
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    parts = scale.stage(profiling.distinct_sketches(df, by=[F.col("l_orderkey") % 7]), "sketches")
    about = profiling.approx_distinct(profiling.merge_sketches(parts, ["ordinal"])).withColumnRenamed("unique_count", "about")
    exact = profiling.distinct_counts(profiling.value_freq(df))
    both = profiling.named(df, exact.join(about, "ordinal"))
    return both.select(F.col("column").alias("column_name"), F.col("unique_count").alias("exact"),
                       (F.abs(F.col("about") - F.col("unique_count")) <= F.greatest(F.lit(1.0), F.col("unique_count") * profiling.SKETCH_ERROR)).alias("within_error"))


@query("sample_values", over("dirty_orders", """
SELECT column_name, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY md5(value || '|42'), value) AS rank
  FROM (SELECT column_name, CASE WHEN column_name = 'o_totalprice' THEN CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR) ELSE value END AS value FROM freq))
WHERE rank <= 5"""), ("dirty_orders",))
def sample_values(t):
    df = t.dirty_orders
    return by_name(profiling.named(df, profiling.sample_values(df, profiling.value_freq(df))))


@query("numeric_stats", over("dirty_part", """
SELECT column_name, round(mean, 4) AS mean, round(std, 4) AS std, min_v, max_v, zeros FROM profile WHERE mean IS NOT NULL"""), ("dirty_part",))
def numeric_stats(t):
    return profiling.numeric_stats(t.dirty_part).select(
        F.col("column").alias("column_name"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.col("min").alias("min_v"), F.col("max").alias("max_v"), F.col("zeros_count").alias("zeros"))


@query("skewness_adj", over("dirty_orders", "SELECT column_name, round(skew, 4) AS skew FROM profile WHERE mean IS NOT NULL"), ("dirty_orders",))
def skewness_adj(t):
    return profiling.numeric_stats(t.dirty_orders).select(F.col("column").alias("column_name"), F.round("skewness", 4).alias("skew"))


@query("quantiles", over("dirty_orders", """
SELECT column_name, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3 FROM profile WHERE mean IS NOT NULL"""), ("dirty_orders",))
def quantiles(t):
    out = profiling.named(t.dirty_orders, profiling.quantiles(t.dirty_orders))
    return out.select(F.col("column").alias("column_name"), F.round("q1", 4).alias("q1"), F.round("median", 4).alias("med"), F.round("q3", 4).alias("q3"))


@query("outlier_counts", over("dirty_part", "SELECT column_name, z_out, iqr_out FROM profile WHERE mean IS NOT NULL"), ("dirty_part",))
def outlier_counts(t):
    return profiling.outlier_counts(t.dirty_part).select(
        F.col("column").alias("column_name"), F.col("potential_outliers").alias("z_out"), F.col("iqr_outliers").alias("iqr_out"))


@query("top_values", over("dirty_part", """
SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank, value, cnt FROM freq
WHERE column_name NOT IN ('p_partkey', 'p_type_num', 'p_retailprice') QUALIFY rank <= 10"""), ("dirty_part",))
def top_values(t):
    df = t.dirty_part
    freq = profiling.value_freq(df, profiling.text_columns(df))
    return by_name(profiling.named(df, profiling.top_values(freq)))


_REASONS = "coalesce((SELECT string_agg(reason, ', ' ORDER BY r) FROM reasons x WHERE x.ordinal = p.ordinal), '') AS drop_reasons"


@query("column_flags", over("dirty_part", f"""
SELECT column_name, unique_count, NOT ({NUMERIC}) AND unique_count > 0 AND unique_count < 50 AS is_categorical, {_REASONS} FROM profile p
"""), ("dirty_part",))
def column_flags(t):
    flags = profiling.column_flags(t.dirty_part, profiling.value_freq(t.dirty_part))
    return flags.select(F.col("column").alias("column_name"), "unique_count", "is_categorical",
                        F.array_join("drop_reasons", ", ").alias("drop_reasons"))


@query("high_duplication", over("dirty_orders", """
SELECT column_name, unique_count, round(1 - unique_count / n_rows, 4) AS duplication_ratio FROM profile
WHERE 1 - unique_count / n_rows > 0.99 AND unique_count > 1"""), ("dirty_orders",))
def high_duplication(t):
    flags = profiling.column_flags(t.dirty_orders, profiling.value_freq(t.dirty_orders)).where("high_duplication")
    return flags.select(F.col("column").alias("column_name"), "unique_count", "duplication_ratio")


@query("splittable", over("dirty_part", "SELECT column_name, delimiter, split_ratio FROM profile WHERE delimiter IS NOT NULL"), ("dirty_part",))
def splittable(t):
    df = t.dirty_part
    return by_name(profiling.named(df, profiling.splittable(df, ["p_partkey"]))).withColumnRenamed("occurrence_ratio", "split_ratio")


@query("redundant_pairs", over("dirty_part", "SELECT column_name, related AS related_column FROM redundant"), ("dirty_part",))
def redundant_pairs(t):
    return by_name(profiling.redundant_pairs(t.dirty_part))


@query("droppable", over("dirty_part", "SELECT seq, column_name, reasons, related FROM droppable"), ("dirty_part",))
def droppable(t):
    columns, _ = profiled(t, "dirty_part")
    return profiling.droppable(columns).select(
        F.col("seq").cast("bigint").alias("seq"), F.col("column").alias("column_name"), "reasons", F.col("related_column").alias("related"))


_HEALTH = """
SELECT max(n_rows) AS n_rows, count(*) AS columns, CAST(sum(n_rows) AS BIGINT) AS total_cells,
  CAST(sum(missing_count) AS BIGINT) AS total_missing_cells, CAST(sum(placeholder_count) AS BIGINT) AS total_placeholder_cells,
  round(1 - sum(missing_count) / sum(n_rows), 4) AS completeness_score, any_value(dups) AS duplicate_rows,
  round(any_value(dups) / max(n_rows), 4) AS duplicate_ratio,
  (SELECT count(*) FROM droppable) AS droppable_columns_count, CAST(count(delimiter) AS BIGINT) AS splittable_columns_count
FROM profile, copies"""


@query("profile_table", over("dup_orders", _HEALTH), ("dup_orders",))
def profile_table(t):
    return by_name(profiled(t, "dup_orders")[1])


@query("overall_health", over("dirty_part", _HEALTH), ("dirty_part",))
def overall_health(t):
    return by_name(profiled(t, "dirty_part")[1])


@query("profile_json", over("dirty_orders", """
SELECT column_name, n_rows, null_count, missing_count, missing_ratio, unique_count, round(q1, 4) AS q1, round(q3, 4) AS q3, delimiter IS NOT NULL AS splittable,
  (SELECT CAST(sum(missing_count) AS BIGINT) FROM profile) AS total_missing_cells, dups AS duplicate_rows FROM profile, copies"""), ("dirty_orders",))
def profile_json(t):
    """The JSON document read back, one row per column."""
    kind = ("struct<column_analysis:array<struct<column:string,rows:bigint,null_count:bigint,missing_count:bigint,missing_ratio:double,unique_count:bigint,"
            "q1:double,q3:double,splittable:boolean>>,overall_health:struct<total_missing_cells:bigint,duplicate_rows:bigint>>")
    document = profiling.profile_json(*profiled(t, "dirty_orders")).select(F.from_json("profile", kind).alias("p"))
    rows = document.select(F.inline("p.column_analysis"), "p.overall_health.*")
    return by_name(rows.withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)}))


@query("target_distribution", """
SELECT o_orderpriority AS value, count(*) AS cnt FROM dirty_orders WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY cnt DESC, value LIMIT 5""", ("dirty_orders",))
def target_distribution(t):
    return profiling.target_distribution(t.dirty_orders, "o_orderpriority")


# --- snapshot ----------------------------------------------------------------------------------

@query("snapshot_rows", """
SELECT doc_id, left(text, 30) AS text, left(lang, 30) AS lang, left(source, 30) AS source, n_chars FROM documents ORDER BY doc_id LIMIT 5""")
def snapshot_rows(t):
    return snapshot.snapshot_rows(t.documents, ["doc_id"])


_COLUMN_LINE = f"""'  ' || column_name || ': ' || dtype || ', ' || unique_count || ' distinct, ' || missing_count || ' gaps' ||
  CASE WHEN {NUMERIC} THEN '; mean ' || {fixed('mean')} || ', median ' || {fixed('med')} || ', deviation ' || {fixed('std')} ||
    ', skew ' || {SKEW_TEXT} || ', outliers ' || {OUTLIER_TEXT}
  ELSE coalesce('; often ' || (SELECT string_agg('''' || value || ''' ' || cnt, ', ' ORDER BY cnt DESC, value) FROM
      (SELECT value, cnt FROM freq f WHERE f.ordinal = p.ordinal ORDER BY cnt DESC, value LIMIT 3)), '') ||
    coalesce('; hidden gaps ' || (SELECT string_agg('''' || token || ''' ' || cnt, ', ' ORDER BY n) FROM tokens k WHERE k.ordinal = p.ordinal), '')
  END"""


@query("snapshot_columns", over("dirty_orders", f"SELECT column_name, {_COLUMN_LINE} AS line FROM profile p"), ("dirty_orders",))
def snapshot_columns(t):
    columns, _ = profiled(t, "dirty_orders")
    return columns.select(F.col("column").alias("column_name"), snapshot.column_line(columns).alias("line"))


_PART = ["p_partkey", "p_brandtype", "p_csv", "p_type_num", "p_type", "p_retailprice", "p_const", "p_sparse", "p_sku"]
_CELLS = ", ".join(f"coalesce(left(CAST({c} AS VARCHAR), 30), 'nan')" for c in _PART)


@query("snapshot_text", over("dirty_part", f"""
SELECT concat_ws(chr(10) || chr(10),
  'Table' || chr(10) || '  ' || (SELECT max(n_rows) FROM profile) || ' rows, ' || (SELECT count(*) FROM profile) || ' columns' || chr(10) || '  target: p_type' || chr(10) ||
    '  its values: ' || (SELECT string_agg('''' || p_type || ''' ' || c, ', ' ORDER BY c DESC, p_type) FROM (SELECT p_type, count(*) AS c FROM dirty_part GROUP BY 1 ORDER BY c DESC, p_type LIMIT 5)),
  'First rows' || chr(10) || '{" | ".join(_PART)}' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY p_partkey) FROM (
    SELECT p_partkey, concat_ws(' | ', {_CELLS}) AS line FROM dirty_part ORDER BY p_partkey LIMIT 5)),
  'Columns' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY ordinal) FROM (SELECT ordinal, {_COLUMN_LINE} AS line FROM profile p)),
  'Columns that can go' || chr(10) || (SELECT string_agg('  ' || column_name || ': ' || reasons || coalesce(', says the same as ' || related, ''), chr(10) ORDER BY seq) FROM droppable),
  (SELECT 'Rows that repeat another: ' || dups FROM copies WHERE dups > 0),
  'Columns that join values' || chr(10) || (SELECT string_agg('  ' || column_name || ': by ''' || delimiter || ''' in ' || CAST(round(split_ratio * 100) AS INTEGER) || '% of the cells', chr(10) ORDER BY ordinal)
    FROM profile WHERE delimiter IS NOT NULL)) || chr(10) AS snapshot"""), ("dirty_part",))
def snapshot_text(t):
    columns, table = profiled(t, "dirty_part")
    return snapshot.snapshot_text(snapshot.snapshot_lines(t.dirty_part, columns, table, ["p_partkey"], "p_type"))


# --- issues ------------------------------------------------------------------------------------

_NULL_ISSUES = f"""
SELECT column_name, 'null_treatment' AS issue_type, 'treat_nulls' AS category,
  null_count || ' NULL cells; gaps of all kinds: ' || {fixed('missing_ratio * 100', 1)} || '%' AS description,
  CASE WHEN missing_ratio > 0.5 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN missing_ratio > 0.5 THEN 'drop_column: more than half are gaps'
    WHEN {NUMERIC} AND {SKEWED} THEN 'fill_na, median: skew ' || {SKEW_TEXT} || ', outliers ' || {OUTLIER_TEXT}
    WHEN {NUMERIC} THEN 'fill_na, mean: skew ' || {SKEW_TEXT}
    ELSE 'fill_na, mode: not a number' END AS recommended_action
FROM profile WHERE null_count > 0"""
_TOKEN_ISSUES = """
SELECT column_name, 'placeholder' AS issue_type, 'treat_nulls' AS category,
  '''' || token || ''' hides gaps in ' || cnt || ' cells' AS description, 'high' AS severity,
  'replace ''' || token || ''' by NaN; fill_na, mode' AS recommended_action FROM tokens"""
_DROP_ISSUES = """
SELECT column_name, 'drop_column' AS issue_type, 'drop_columns' AS category, 'profile says: ' || reason AS description,
  'medium' AS severity, 'drop_column' AS recommended_action FROM (
    SELECT column_name, reason FROM reasons
    UNION ALL SELECT column_name, 'redundant_encoding_of_' || related FROM profile
      WHERE related IS NOT NULL AND column_name NOT IN (SELECT column_name FROM reasons))"""
_SPLIT_ISSUES = """
SELECT column_name, 'split_column' AS issue_type, 'split_columns' AS category,
  'values joined by ''' || delimiter || '''' AS description, 'low' AS severity,
  'split_column at ''' || delimiter || '''' AS recommended_action FROM profile WHERE delimiter IS NOT NULL"""
_COPY_ISSUES = """
SELECT 'ALL' AS column_name, 'duplicate' AS issue_type, 'treat_duplicates' AS category,
  dups || ' rows repeat another row' AS description, 'high' AS severity, 'drop_duplicates' AS recommended_action
FROM copies WHERE dups > 0"""


@query("issues_nulls", over("dirty_part", _NULL_ISSUES), ("dirty_part",))
def issues_nulls(t):
    return by_name(issues.null_issues(profiled(t, "dirty_part")[0]))


@query("issues_placeholders", over("dirty_orders", _TOKEN_ISSUES), ("dirty_orders",))
def issues_placeholders(t):
    return by_name(issues.placeholder_issues(profiled(t, "dirty_orders")[0]))


@query("issues_drop", over("dirty_part", _DROP_ISSUES), ("dirty_part",))
def issues_drop(t):
    return by_name(issues.drop_issues(profiled(t, "dirty_part")[0]))


@query("issues_split", over("dirty_part", _SPLIT_ISSUES), ("dirty_part",))
def issues_split(t):
    return by_name(issues.split_issues(profiled(t, "dirty_part")[0]))


@query("issues_duplicates", over("dup_orders", _COPY_ISSUES), ("dup_orders",))
def issues_duplicates(t):
    return by_name(issues.duplicate_issues(profiled(t, "dup_orders")[1]))


@query("issue_summary", over("dup_orders", f"""
SELECT category, count(*) AS issues FROM ({_NULL_ISSUES} UNION ALL {_TOKEN_ISSUES} UNION ALL {_DROP_ISSUES}
  UNION ALL {_SPLIT_ISSUES} UNION ALL {_COPY_ISSUES}) GROUP BY 1"""), ("dup_orders",))
def issue_summary(t):
    return issues.issue_summary(issues.all_issues(*profiled(t, "dup_orders")))


@query("compact_stats", over("dirty_orders", f"""
SELECT column_name, dtype, unique_count, missing_count, placeholder_count, round(mean, 2) AS mean, round(med, 2) AS median, round(std, 2) AS std,
  round(skew, 2) AS skewness, z_out AS potential_outliers, zeros AS zeros_count,
  coalesce((SELECT string_agg(token || '=' || cnt, ',' ORDER BY n) FROM tokens k WHERE k.ordinal = p.ordinal), '') AS placeholders,
  CASE WHEN {NUMERIC} THEN '' ELSE coalesce((SELECT string_agg(value || '=' || cnt, ',' ORDER BY cnt DESC, value) FROM
    (SELECT value, cnt FROM freq f WHERE f.ordinal = p.ordinal ORDER BY cnt DESC, value LIMIT 10)), '') END AS top FROM profile p"""), ("dirty_orders",))
def compact_stats(t):
    """The JSON of every column, read back."""
    pairs = "array<struct<value:string,count:bigint>>"
    s = F.from_json("stats", "dtype string, unique_count bigint, missing_count bigint, placeholder_count bigint, mean double, median double, std double,"
                             f" skewness double, potential_outliers bigint, zeros_count bigint, detected_placeholders {pairs}, top_values {pairs}")
    rows = by_name(issues.compact_stats(profiled(t, "dirty_orders")[0])).select("column_name", s.alias("s")).select("column_name", "s.*")

    def listed(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ",")

    return rows.withColumns({"placeholders": listed("detected_placeholders"), "top": listed("top_values")}).drop("detected_placeholders", "top_values")


# --- planning ----------------------------------------------------------------------------------

def steps_of(t, view: str):
    return planner.plan(*profiled(t, view))


def shown(steps):
    return steps.withColumnRenamed("column", "column_name")


def _register_plan(name: str, view: str, condition: str) -> None:
    @query(name, planned(view, f"SELECT * FROM plan WHERE {condition}"), (view,))
    def run(t):
        return shown(steps_of(t, view)).where(condition)


_register_plan("plan_replace", "dirty_orders", "operation = 'replace'")
_register_plan("plan_fill", "dirty_part", "phase = 'treat_nulls' AND operation IN ('fill_na', 'drop_na')")
_register_plan("plan_dedupe", "dup_orders", "phase = 'treat_duplicates'")
_register_plan("plan_populate", "dirty_orders", "phase = 'populate_missing'")
_register_plan("plan_drop", "dirty_part", "phase = 'drop_columns'")
_register_plan("plan_split", "dirty_part", "phase = 'split_columns'")
_register_plan("plan_all", "dup_orders", "true")


@query("validate_plan", planned("dirty_orders", "SELECT * FROM valid_plan"), ("dirty_orders",))
def validate_plan(t):
    return shown(planner.validate(steps_of(t, "dirty_orders")))


@query("order_steps", planned("dirty_part", """
SELECT CAST(row_number() OVER (ORDER BY i, step_id) AS INTEGER) AS run_order, step_id, phase, operation, column_name
FROM valid_plan JOIN phases USING (phase)"""), ("dirty_part",))
def order_steps(t):
    ordered = planner.execution_order(planner.validate(steps_of(t, "dirty_part")))
    return shown(ordered).select("run_order", "step_id", "phase", "operation", "column_name")
