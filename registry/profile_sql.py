"""Checking SQL for the profile: generated per table from its column list."""

from __future__ import annotations

from limpid.functions.constants import DELIMITERS, PLACEHOLDERS

# (column, kind) in table order.
COLUMNS = {
    "dirty_orders": [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "object"), ("o_totalprice", "float64"),
                     ("o_orderpriority", "object"), ("o_datestr", "object"), ("o_pricestr", "object"), ("o_timestr", "object"),
                     ("o_messydate", "object")],
    "dirty_part": [("p_partkey", "int64"), ("p_brandtype", "object"), ("p_csv", "object"), ("p_type_num", "int64"),
                   ("p_type", "object"), ("p_retailprice", "float64"), ("p_const", "object"), ("p_sparse", "object"),
                   ("p_sku", "object")],
}
COLUMNS["dup_orders"] = COLUMNS["dirty_orders"]
KEYS = {"dirty_orders": "o_orderkey", "dirty_part": "p_partkey", "dup_orders": "o_orderkey"}
# Pairs (numeric column, text column) whose names suggest a code and its label.
CANDIDATES = {"dirty_part": [("p_type_num", "p_type")], "dirty_orders": [], "dup_orders": []}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _union(parts: list[str], empty: str) -> str:
    return "\nUNION ALL ".join(parts) if parts else empty


def profile_ctes(view: str) -> str:
    """CTEs tokens, freq, stats, top, splits, redundant, copies and profile (one row per column)."""
    cols, key = COLUMNS[view], KEYS[view]
    texts = [(i, c) for i, (c, k) in enumerate(cols) if k == "object"]
    numbers = [(i, c) for i, (c, k) in enumerate(cols) if k != "object"]
    base = _union([f"SELECT {i} AS ordinal, '{c}' AS column_name, '{k}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS null_count, "
                   f"count(DISTINCT {c}) AS unique_count FROM {view}" for i, (c, k) in enumerate(cols)], "")
    token_list = ", ".join(f"({n}, {quoted(t)})" for n, t in enumerate(PLACEHOLDERS))
    tokens = _union([f"SELECT {i} AS ordinal, '{c}' AS column_name, n, token, count(*) AS cnt FROM {view} JOIN token_list ON trim({c}) = token GROUP BY ALL"
                     for i, c in texts], "")
    stats = _union([f"""SELECT {i} AS ordinal, '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min_v,
  CAST(max({c}) AS DOUBLE) AS max_v, CASE WHEN min({c}) = max({c}) AND count({c}) >= 3 THEN 0.0 ELSE skewness({c}) END AS skew,
  CAST(count(*) FILTER ({c} = 0) AS BIGINT) AS zeros, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {view}""" for i, c in numbers], "")
    outliers = _union([f"""SELECT {i} AS ordinal, CAST(count(*) FILTER (abs(({c} - s.mean) / s.std) > 3) AS BIGINT) AS z_out,
  CAST(count(*) FILTER ({c} < s.q1 - 1.5 * (s.q3 - s.q1) OR {c} > s.q3 + 1.5 * (s.q3 - s.q1)) AS BIGINT) AS iqr_out
  FROM {view}, stats s WHERE s.ordinal = {i}""" for i, c in numbers], "")
    freq = _union([f"SELECT {i} AS ordinal, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {view} WHERE {c} IS NOT NULL GROUP BY ALL"
                   for i, (c, _) in enumerate(cols)], "")
    delims = ", ".join(f"({p}, {quoted(d)})" for p, d in enumerate(DELIMITERS))
    firsts = _union([f"(SELECT {i} AS ordinal, {c} AS v FROM {view} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 100)" for i, c in texts], "")
    pairs = _union([f"SELECT '{n}' AS column_name, '{o}' AS related FROM (SELECT {o}, count(DISTINCT {n}) AS d FROM {view} "
                    f"WHERE {n} IS NOT NULL AND {o} IS NOT NULL GROUP BY ALL) HAVING bool_and(d = 1)" for n, o in CANDIDATES[view]],
                   "SELECT '' AS column_name, '' AS related WHERE false")
    return f"""base AS ({base}),
token_list(n, token) AS (VALUES {token_list}),
tokens AS ({tokens}),
stats AS ({stats}),
outliers AS ({outliers}),
freq AS ({freq}),
delims(p, d) AS (VALUES {delims}),
firsts AS ({firsts}),
counted AS (SELECT ordinal, p, d, length(v) AS len, CAST((length(v) - length(replace(v, d, ''))) / length(d) AS BIGINT) AS n FROM firsts, delims),
measured AS (SELECT ordinal, p, d, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS share, avg(len) AS len, max(n) AS most, median(n) AS mid FROM counted GROUP BY ALL),
splits AS (SELECT ordinal, d AS delimiter, round(share, 4) AS ratio FROM measured
  WHERE share > 0.3 AND len < 50 AND mid > 0 AND mid <= 3 AND most <= 5 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY p) = 1),
redundant AS ({pairs}),
copies AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS dups FROM (SELECT count(*) AS c FROM {view} GROUP BY {", ".join(c for c, _ in cols)})),
placeholders AS (SELECT ordinal, CAST(sum(cnt) AS BIGINT) AS placeholder_count FROM tokens GROUP BY ALL),
profile AS (
  SELECT b.*, coalesce(p.placeholder_count, 0) AS placeholder_count, null_count + coalesce(p.placeholder_count, 0) AS missing_count,
    round((null_count + coalesce(p.placeholder_count, 0)) / n_rows, 4) AS missing_ratio,
    s.* EXCLUDE (ordinal, column_name), o.z_out, o.iqr_out, sp.delimiter, sp.ratio AS split_ratio, r.related,
    unique_count <= 1 AS is_constant, (null_count + coalesce(p.placeholder_count, 0)) / n_rows > 0.95 AS is_sparse,
    dtype = 'object' AND unique_count = n_rows AND n_rows > 100 AND NOT regexp_matches(lower(b.column_name), 'date|time|year') AS is_id
  FROM base b LEFT JOIN placeholders p USING (ordinal) LEFT JOIN stats s USING (ordinal) LEFT JOIN outliers o USING (ordinal)
    LEFT JOIN splits sp USING (ordinal) LEFT JOIN redundant r ON r.column_name = b.column_name),
reasons AS (
  SELECT ordinal, column_name, 0 AS r, 'constant_value' AS reason FROM profile WHERE is_constant
  UNION ALL SELECT ordinal, column_name, 1, 'almost_all_missing' FROM profile WHERE is_sparse
  UNION ALL SELECT ordinal, column_name, 2, 'likely_unique_id' FROM profile WHERE is_id),
droppable AS (
  SELECT row_number() OVER (ORDER BY part, ordinal) AS seq, column_name, reasons, related FROM (
    SELECT 0 AS part, ordinal, column_name, string_agg(reason, ', ' ORDER BY r) AS reasons, NULL AS related FROM reasons GROUP BY ALL
    UNION ALL SELECT 1, ordinal, column_name, 'redundant_encoding_of_' || related, related FROM profile WHERE related IS NOT NULL))"""


# Text fragments shared by issue and plan checks.
NUMERIC = "dtype IN ('int64', 'float64')"
SKEWED = "(coalesce(abs(skew) > 1.0, false) OR coalesce(z_out > 0, false))"


def fixed(expr: str, places: int = 2) -> str:
    return f"CAST(CAST(round({expr}, {places}) AS DECIMAL(38,{places})) AS VARCHAR)"


SKEW_TEXT = f"coalesce({fixed('skew')}, 'nan')"
OUTLIER_TEXT = "CAST(coalesce(z_out, 0) AS VARCHAR)"


def plan_cte() -> str:
    """CTE plan(step_id, phase, column_name, operation, params, reason) on top of profile_ctes."""
    return f"""raw_steps AS (
  SELECT 1 AS part, ordinal AS a, n AS b, 'treat_nulls' AS phase, column_name, 'replace' AS operation,
    '{{"old":"' || token || '","new":"NaN"}}' AS params,
    '''' || token || ''' stands for a gap in ' || cnt || ' cells' AS reason FROM tokens
  UNION ALL SELECT 2, ordinal, 0, 'treat_nulls', column_name, CASE WHEN missing_ratio > 0.5 THEN 'drop_na' ELSE 'fill_na' END,
    CASE WHEN missing_ratio > 0.5 THEN '{{}}' WHEN {NUMERIC} AND ({SKEWED} OR zeros / n_rows > 0.5) THEN '{{"strategy":"median"}}'
      WHEN {NUMERIC} THEN '{{"strategy":"mean"}}' ELSE '{{"strategy":"mode"}}' END,
    CASE WHEN missing_ratio > 0.5 THEN CAST(round(missing_ratio * 100, 0) AS BIGINT) || '% of the cells are gaps: their rows go'
      WHEN {NUMERIC} AND {SKEWED} THEN missing_count || ' gaps; skew ' || {SKEW_TEXT} || ', outliers ' || {OUTLIER_TEXT} || ': the median withstands both'
      WHEN {NUMERIC} AND zeros / n_rows > 0.5 THEN missing_count || ' gaps; ' || CAST(round(zeros / n_rows * 100, 0) AS BIGINT) || '% of the rows hold zero: the median'
      WHEN {NUMERIC} THEN missing_count || ' gaps; skew ' || {SKEW_TEXT} || ', no outliers: the mean'
      ELSE missing_count || ' gaps; not a number: the commonest value' END
    FROM profile WHERE missing_count > 0
  UNION ALL SELECT 3, 0, 0, 'treat_nulls', NULL, 'no_action', '{{}}', 'no gaps' FROM copies WHERE NOT EXISTS (FROM profile WHERE missing_count > 0)
  UNION ALL SELECT 4, 0, 0, 'treat_duplicates', NULL, CASE WHEN dups > 0 THEN 'drop_duplicates' ELSE 'no_action' END, '{{}}',
    CASE WHEN dups > 0 THEN dups || ' rows repeat another row' ELSE 'all rows differ' END FROM copies
  UNION ALL SELECT 5, ordinal, 0, 'populate_missing', column_name, 'fill_na', '{{"strategy":"interpolate"}}',
    'gaps that are left in ' || column_name || ' lie between neighbours' FROM profile WHERE {NUMERIC} AND null_count > 0
  UNION ALL SELECT 5, 0, 0, 'populate_missing', NULL, 'no_action', '{{}}', 'no number column has gaps'
    FROM copies WHERE NOT EXISTS (FROM profile WHERE {NUMERIC} AND null_count > 0)
  UNION ALL SELECT 6, seq, 0, 'drop_columns', column_name, 'drop_column', '{{}}', 'profile says: ' || reasons FROM droppable
  UNION ALL SELECT 6, 0, 0, 'drop_columns', NULL, 'no_action', '{{}}', 'every column is of use' FROM copies WHERE NOT EXISTS (FROM droppable)
  UNION ALL SELECT 7, ordinal, 0, 'split_columns', column_name, 'split_column',
    '{{"delimiter":"' || delimiter || '","new_columns":["' || column_name || '_part1","' || column_name || '_part2"]}}',
    'values joined by ''' || delimiter || '''' FROM profile WHERE delimiter IS NOT NULL
  UNION ALL SELECT 7, 0, 0, 'split_columns', NULL, 'no_action', '{{}}', 'no column joins values' FROM copies WHERE NOT EXISTS (FROM splits)
  UNION ALL SELECT 9, 0, 0, 'treat_nulls', 'ALL_OBJECT', 'strip_whitespace', '{{}}', 'blanks around text carry no meaning' FROM copies),
plan AS (SELECT CAST(row_number() OVER (ORDER BY part, a, b) AS INTEGER) AS step_id, phase, column_name, operation, params, reason FROM raw_steps),
phases(i, phase) AS (VALUES (0, 'treat_nulls'), (1, 'treat_duplicates'), (2, 'populate_missing'), (3, 'drop_columns'), (4, 'split_columns'), (5, 'standardize')),
valid_plan AS (
  SELECT * FROM plan
  UNION ALL SELECT CAST((SELECT max(step_id) FROM plan) + row_number() OVER (ORDER BY i) AS INTEGER), phase, NULL, 'no_action', '{{}}',
    'nothing to do in ' || phase FROM phases WHERE phase NOT IN (SELECT phase FROM plan))"""
