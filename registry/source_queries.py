"""CSV sources: line breaks in quotes, encodings, and whole folders of files with different columns."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from limpid.functions.constants import CSV_NULLS, DELIMITERS, PHASES, PLACEHOLDERS, ROW_ID
from limpid.operators import columns, scale
from limpid.plans import catalog
from limpid.sources import csv, sinks
from registry.base import query
from registry.profile_sql import COLUMNS, quoted

# --- files ---------------------------------------------------------------------------------------

_MANY_LINES = """concat('"', coalesce(text, ''), '",', chr(10), coalesce(lang, ''), chr(10), '",', coalesce(source, ''))"""


@query("csv_multiline_parallel", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, sha256({_MANY_LINES}) AS text_sha256, coalesce(source, '-') AS source FROM documents""")
def csv_multiline_parallel(t):
    """Quotes, separators and line breaks inside fields, cut by many tasks, in the order of the file."""
    rows = t.documents.select("doc_id", F.expr(_MANY_LINES).alias("text"), F.coalesce("source", F.lit("-")).alias("source"), F.struct("doc_id").alias(ROW_ID))
    path = scale.stage_path(t.spark, "csv-lines")
    sinks.write_csv(rows, path)
    back = csv.load_csv(t.spark, path)
    return columns.data(scale.with_position(back, [ROW_ID], "pos")).select("pos", "doc_id", F.sha2("text", 256).alias("text_sha256"), "source")


@query("csv_mixed_encodings", """
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN chr(65533) || ' ' || t ELSE regexp_replace(t, '[^\\x{00}-\\x{ff}]', '?', 'g') END) AS text_sha256
FROM (SELECT doc_id, 'é ' || coalesce(text, '') AS t FROM documents)""")
def csv_mixed_encodings(t):
    """One file in UTF-8 that holds a replacement character, one in latin1, read as one table."""
    text = F.concat(F.lit("é "), F.coalesce("text", F.lit("")))
    even = F.col("doc_id") % 2 == 0
    parts = {"UTF-8": t.documents.where(even).select("doc_id", F.concat(F.lit("� "), text).alias("text")),
             "ISO-8859-1": t.documents.where(~even).select("doc_id", F.regexp_replace(text, "[^\\x00-\\xff]", "?").alias("text"))}
    path = scale.stage_path(t.spark, "csv-encodings")
    for encoding, df in parts.items():
        df.write.options(header=True, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{encoding}")
    return columns.data(csv.load_csv(t.spark, f"{path}/*/*.csv")).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


# --- folders -------------------------------------------------------------------------------------

#: View, its key, the number of files that it is dealt to: 20 files of three schemas.
FOLDER = (("dirty_orders", "o_orderkey", 8), ("dirty_part", "p_partkey", 6), ("dirty_events", "event_id", 6))
_KINDS = COLUMNS | {"dirty_events": [("event_id", "int64"), ("user_id", "int64"), ("event_type", "object"), ("value", "float64"), ("props", "object")]}
#: Number and text columns whose names go together.
_PAIRS = [("p_type_num", "p_type")]


def folder(t) -> str:
    """Write the files; the name of each is view/part=number/..."""
    path = scale.stage_path(t.spark, "csv-folder")

    def write(view: str, key: str, files: int) -> None:
        df = getattr(t, view).withColumn("part", F.col(key) % files)
        # With as many tasks as files, several files would often meet in one task.
        df.repartition(8 * files, "part").sortWithinPartitions("part", key).write.partitionBy("part").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{view}")

    scale.in_parallel(t.spark, *[functools.partial(write, *one) for one in FOLDER])
    return path


def named(df):
    """The short name of a file instead of its path."""
    name = F.concat_ws("-", F.regexp_extract("file", "/([a-z_]+)/part=([0-9]+)/", 1), F.regexp_extract("file", "/part=([0-9]+)/", 1))
    return df.withColumn("name", name).drop("file")


def _cells() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{view}-' || ({key} % {files}) AS name, {key} AS rid, {i} AS ordinal, '{c}' AS column_name, '{kind}' AS kind, CAST({c} AS VARCHAR) AS raw FROM {view}"
        for view, key, files in FOLDER for i, (c, kind) in enumerate(_KINDS[view]))


_FOLDER_SQL = f"""
cells AS (SELECT name, rid, ordinal, column_name, kind, CASE WHEN raw NOT IN ({", ".join(quoted(x) for x in CSV_NULLS)}) THEN raw END AS value FROM ({_cells()})),
kinds AS (
  SELECT name, ordinal, column_name, CASE WHEN count(value) = 0 THEN 'float64' ELSE any_value(kind) END AS dtype, count(*) AS n_rows, count(*) - count(value) AS null_count,
    count(DISTINCT value) AS unique_count FROM cells GROUP BY ALL),
numbers AS (SELECT c.name, c.ordinal, CAST(value AS DOUBLE) AS v FROM cells c JOIN kinds k USING (name, ordinal) WHERE dtype <> 'object' AND value IS NOT NULL),
stats AS (
  SELECT name, ordinal, avg(v) AS mean, stddev_samp(v) AS std, CASE WHEN min(v) = max(v) AND count(v) >= 3 THEN 0.0 ELSE skewness(v) END AS skew, quantile_cont(v, 0.25) AS q1,
    quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, count(*) FILTER (v = 0) AS zeros FROM numbers GROUP BY ALL),
outliers AS (
  SELECT name, ordinal, count(*) FILTER (abs((v - mean) / nullif(std, 0)) > 3) AS z_out, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_out
  FROM numbers JOIN stats USING (name, ordinal) GROUP BY ALL),
token_list(token) AS (VALUES {", ".join(f"({quoted(x)})" for x in PLACEHOLDERS)}),
tokens AS (SELECT name, ordinal, column_name, token, count(*) AS cnt FROM cells JOIN kinds USING (name, ordinal, column_name) JOIN token_list ON trim(value) = token WHERE dtype = 'object' GROUP BY ALL),
placeholders AS (SELECT name, ordinal, sum(cnt) AS placeholder_count FROM tokens GROUP BY ALL),
freq AS (SELECT name, ordinal, value, count(*) AS cnt FROM cells JOIN kinds USING (name, ordinal) WHERE dtype = 'object' AND value IS NOT NULL GROUP BY ALL),
tops AS (SELECT name, ordinal, string_agg(value || '=' || cnt, ',' ORDER BY cnt DESC, value) AS top FROM
  (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY name, ordinal ORDER BY cnt DESC, value) <= 10) GROUP BY ALL),
firsts AS (SELECT name, ordinal, value FROM cells JOIN kinds USING (name, ordinal) WHERE dtype = 'object' AND value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name, ordinal ORDER BY rid) <= 100),
delims(p, d) AS (VALUES {", ".join(f"({p}, {quoted(d)})" for p, d in enumerate(DELIMITERS))}),
measured AS (
  SELECT name, ordinal, p, d, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS share, avg(len) AS len, max(n) AS most, median(n) AS mid
  FROM (SELECT name, ordinal, p, d, length(value) AS len, (length(value) - length(replace(value, d, ''))) // length(d) AS n FROM firsts, delims) GROUP BY ALL),
splits AS (SELECT name, ordinal, d AS delimiter FROM measured WHERE share > 0.3 AND len < 50 AND mid > 0 AND mid <= 3 AND most <= 5
  QUALIFY row_number() OVER (PARTITION BY name, ordinal ORDER BY p) = 1),
codes AS (
  SELECT name, column_name, related FROM (
    SELECT a.name, a.column_name, b.column_name AS related, b.value, count(DISTINCT a.value) AS codes
    FROM cells a JOIN cells b ON a.name = b.name AND a.rid = b.rid AND (a.column_name, b.column_name) IN ({", ".join(f"('{c}', '{x}')" for c, x in _PAIRS)})
    WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)
  GROUP BY ALL HAVING bool_and(codes = 1)),
profile AS (
  SELECT k.*, coalesce(placeholder_count, 0) AS placeholder_count, null_count + coalesce(placeholder_count, 0) AS missing_count, s.* EXCLUDE (name, ordinal), z_out, iqr_out, top, delimiter,
    related, unique_count <= 1 AS is_constant, (null_count + coalesce(placeholder_count, 0)) / n_rows > 0.95 AS is_sparse,
    dtype = 'object' AND unique_count = n_rows AND n_rows > 100 AND NOT regexp_matches(lower(k.column_name), 'date|time|year') AS is_id
  FROM kinds k LEFT JOIN placeholders USING (name, ordinal) LEFT JOIN stats s USING (name, ordinal) LEFT JOIN outliers USING (name, ordinal) LEFT JOIN tops USING (name, ordinal)
    LEFT JOIN splits USING (name, ordinal) LEFT JOIN codes USING (name, column_name)),
reasons AS (SELECT name, ordinal, concat_ws(', ', CASE WHEN is_constant THEN 'constant_value' END, CASE WHEN is_sparse THEN 'almost_all_missing' END, CASE WHEN is_id THEN 'likely_unique_id' END) AS reasons FROM profile),
row_values AS (SELECT name, rid, string_agg(coalesce(value, chr(0)), chr(1) ORDER BY ordinal) AS fields FROM cells GROUP BY ALL),
copies AS (SELECT name, CAST(sum(c - 1) AS BIGINT) AS dups FROM (SELECT name, count(*) AS c FROM row_values GROUP BY name, fields) GROUP BY ALL)"""

_VIEWS = tuple(view for view, _, _ in FOLDER)


@query("profile_folder", f"""WITH {_FOLDER_SQL.strip()}
SELECT name, column_name, dtype, n_rows, null_count, CAST(missing_count AS BIGINT) AS missing_count, unique_count, round(mean, 4) AS mean, round(std, 4) AS std, round(skew, 4) AS skew, round(q1, 4) AS q1,
  round(med, 4) AS med, round(q3, 4) AS q3, CASE WHEN dtype <> 'object' THEN coalesce(z_out, 0) END AS z_out, CASE WHEN dtype <> 'object' THEN coalesce(iqr_out, 0) END AS iqr_out,
  coalesce(top, '') AS top, coalesce(delimiter, '') AS delimiter, r.reasons AS drop_reasons, coalesce(related, '') AS related
FROM profile JOIN reasons r USING (name, ordinal)""", _VIEWS)
def profile_folder(t):
    found = named(catalog.profile_folder(t.spark, folder(t)).columns)
    four = {n: F.round(c, 4) for n, c in (("mean", "mean"), ("std", "std"), ("skew", "skewness"), ("q1", "q1"), ("med", "median"), ("q3", "q3"))}
    top = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ",")
    return found.select(
        "name", F.col("column").alias("column_name"), "dtype", F.col("rows").alias("n_rows"), "null_count", "missing_count", "unique_count", *[v.alias(k) for k, v in four.items()],
        F.col("potential_outliers").alias("z_out"), F.col("iqr_outliers").alias("iqr_out"), top.alias("top"), F.coalesce("suggested_delimiter", F.lit("")).alias("delimiter"),
        F.array_join("drop_reasons", ", ").alias("drop_reasons"), F.array_join("redundant_with", ", ").alias("related"))


_SKEWED = "(coalesce(abs(skew) > 1.0, false) OR coalesce(z_out > 0, false))"


@query("plan_folder", f"""WITH {_FOLDER_SQL.strip()},
steps AS (
  SELECT name, 'treat_nulls' AS phase, column_name, 'replace' AS operation, '{{"old":"' || token || '","new":"NaN"}}' AS params FROM tokens
  UNION ALL SELECT name, 'treat_nulls', column_name, CASE WHEN round(missing_count / n_rows, 4) > 0.5 THEN 'drop_na' ELSE 'fill_na' END,
    CASE WHEN round(missing_count / n_rows, 4) > 0.5 THEN '{{}}' WHEN dtype <> 'object' AND ({_SKEWED} OR zeros / n_rows > 0.5) THEN '{{"strategy":"median"}}'
      WHEN dtype <> 'object' THEN '{{"strategy":"mean"}}' ELSE '{{"strategy":"mode"}}' END FROM profile WHERE missing_count > 0
  UNION ALL SELECT name, 'treat_nulls', NULL, 'no_action', '{{}}' FROM profile GROUP BY name HAVING sum(missing_count) = 0
  UNION ALL SELECT name, 'treat_duplicates', NULL, CASE WHEN dups > 0 THEN 'drop_duplicates' ELSE 'no_action' END, '{{}}' FROM copies
  UNION ALL SELECT name, 'populate_missing', column_name, 'fill_na', '{{"strategy":"interpolate"}}' FROM profile WHERE dtype <> 'object' AND null_count > 0
  UNION ALL SELECT name, 'populate_missing', NULL, 'no_action', '{{}}' FROM profile GROUP BY name HAVING count(*) FILTER (dtype <> 'object' AND null_count > 0) = 0
  UNION ALL SELECT name, 'drop_columns', column_name, 'drop_column', '{{}}' FROM profile WHERE is_constant OR is_sparse OR is_id
  UNION ALL SELECT name, 'drop_columns', column_name, 'drop_column', '{{}}' FROM profile WHERE related IS NOT NULL
  UNION ALL SELECT name, 'drop_columns', NULL, 'no_action', '{{}}' FROM profile GROUP BY name HAVING count(*) FILTER (is_constant OR is_sparse OR is_id OR related IS NOT NULL) = 0
  UNION ALL SELECT name, 'split_columns', column_name, 'split_column', '{{"delimiter":"' || delimiter || '","new_columns":["' || column_name || '_part1","' || column_name || '_part2"]}}'
    FROM profile WHERE delimiter IS NOT NULL
  UNION ALL SELECT name, 'split_columns', NULL, 'no_action', '{{}}' FROM profile GROUP BY name HAVING count(delimiter) = 0
  UNION ALL SELECT name, 'treat_nulls', 'ALL_OBJECT', 'strip_whitespace', '{{}}' FROM copies
  UNION ALL SELECT name, {quoted(PHASES[-1])}, NULL, 'no_action', '{{}}' FROM copies)
SELECT name, phase, coalesce(column_name, '') AS column_name, operation, params, max(n) OVER (PARTITION BY name) AS n_steps FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM steps)""", _VIEWS)
def plan_folder(t):
    steps = named(catalog.profile_folder(t.spark, folder(t)).steps)
    last = steps.groupBy("name").agg(F.max("step_id").cast("bigint").alias("n_steps"))
    return steps.join(last, "name").select("name", "phase", F.coalesce("column", F.lit("")).alias("column_name"), "operation", "params", "n_steps")


@query("health_folder", f"""WITH {_FOLDER_SQL.strip()}
SELECT name, max(n_rows) AS n_rows, count(*) AS columns, CAST(sum(missing_count) AS BIGINT) AS total_missing_cells, round(1 - sum(missing_count) / sum(n_rows), 4) AS completeness_score,
  any_value(dups) AS duplicate_rows, count(delimiter) AS splittable_columns_count,
  CAST(count(*) FILTER (is_constant OR is_sparse OR is_id) + count(related) AS BIGINT) AS droppable_columns_count
FROM profile JOIN copies USING (name) GROUP BY name""", _VIEWS)
def health_folder(t):
    found = named(catalog.profile_folder(t.spark, folder(t)).tables)
    return found.select("name", F.col("rows").alias("n_rows"), "columns", "total_missing_cells", "completeness_score", "duplicate_rows", "splittable_columns_count", "droppable_columns_count")
