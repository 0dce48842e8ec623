"""Sources, projections, filters, scalar functions, fills and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from limpid.functions import datetimes, numbers
from limpid.functions.constants import ROW_ID
from limpid.functions.text import quote
from limpid.operators import columns, dedupe, filters, impute, ordered, scale
from limpid.plans import intake
from limpid.sources import csv, sinks
from registry.base import query


def rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 4) for n in names})


def through_csv(df):
    """Write a table as CSV into the shared folder and give the path back."""
    path = scale.stage_path(df.sparkSession, "csv-input")
    sinks.write_csv(df, path)
    return path


# --- sources -----------------------------------------------------------------------------------

@query("csv_multiline", """
SELECT doc_id, text, concat('say "', coalesce(source, ''), '",', chr(10), chr(10), coalesce(lang, '')) AS quoted
FROM documents WHERE text IS NOT NULL""")
def csv_multiline(t):
    quoted = F.concat(F.lit('say "'), F.coalesce("source", F.lit("")), F.lit('",\n\n'), F.coalesce("lang", F.lit("")))
    df = t.documents.where("text is not null").select("doc_id", "text", quoted.alias("quoted"))
    return columns.data(csv.load_csv(t.spark, through_csv(df)))


@query("csv_roundtrip_order", """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_orderstatus FROM dirty_orders""", ("dirty_orders",))
def csv_roundtrip_order(t):
    """Rows shuffled and written with a row id come back in its order."""
    rows = t.dirty_orders.select("o_orderkey", "o_orderstatus", F.struct("o_orderkey").alias(ROW_ID)).repartition(7, "o_orderstatus")
    back = csv.load_csv(t.spark, through_csv(rows))
    return columns.data(scale.with_position(back, [ROW_ID], "pos")).select("pos", "o_orderkey", "o_orderstatus")


@query("csv_scan", "SELECT * REPLACE (CAST(p_type_num AS BIGINT) AS p_type_num) FROM dirty_part", ("dirty_part",))
def csv_scan(t):
    return columns.data(csv.load_csv(t.spark, through_csv(t.dirty_part)))


@query("na_tokens", """
SELECT o_orderkey, CASE WHEN token IN ('NA', 'null', '#N/A', 'nan') THEN NULL ELSE token END AS token FROM token_orders
""", ("token_orders",))
def na_tokens(t):
    return columns.data(csv.load_csv(t.spark, through_csv(t.token_orders)))


@query("validate_schema", """
SELECT c.column_name AS required_column, c.present, false AS valid, (SELECT count(*) FROM dirty_orders) AS rows
FROM (VALUES ('o_orderkey', true), ('o_totalprice', true), ('o_comment', false)) AS c(column_name, present)
""", ("dirty_orders",))
def validate_schema(t):
    df, required = t.dirty_orders, ["o_orderkey", "o_totalprice", "o_comment"]
    absent = csv.missing_columns(df, required)
    report = F.array(*[F.struct(F.lit(c).alias("required_column"), F.lit(c not in absent).alias("present")) for c in required])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.inline(report), F.lit(csv.validate_schema(df, required)).alias("valid"), "rows")


# --- projections -------------------------------------------------------------------------------

@query("drop_column", "SELECT * EXCLUDE (p_const) FROM dirty_part", ("dirty_part",))
def drop_column(t):
    return columns.drop_column(t.dirty_part, "p_const")


@query("rename", "SELECT * RENAME (p_sku AS sku) FROM dirty_part", ("dirty_part",))
def rename(t):
    return columns.rename(t.dirty_part, "p_sku", "sku")


@query("split_delim", """
SELECT * EXCLUDE (p_brandtype), trim(split_part(p_brandtype, ' - ', 1)) AS brand, trim(split_part(p_brandtype, ' - ', 2)) AS kind
FROM dirty_part""", ("dirty_part",))
def split_delim(t):
    return columns.split_column(t.dirty_part, "p_brandtype", " - ", ["brand", "kind"])


@query("split_comma_smart", """
WITH safe AS (SELECT p_partkey, string_split(regexp_replace(regexp_replace(p_csv, '([0-9]),([0-9])', '\\1~\\2', 'g'),
                                                        '([0-9]),([0-9])', '\\1~\\2', 'g'), ',') AS parts FROM dirty_part)
SELECT p_partkey, trim(replace(parts[1], '~', ',')) AS p_csv_part1, trim(replace(parts[2], '~', ',')) AS p_csv_part2,
  trim(replace(parts[3], '~', ',')) AS p_csv_part3 FROM safe""", ("dirty_part",))
def split_comma_smart(t):
    return columns.split_column(t.dirty_part.select("p_partkey", "p_csv"), "p_csv")


@query("preview", "SELECT * FROM dirty_orders ORDER BY o_orderkey LIMIT 100", ("dirty_orders",))
def preview(t):
    return columns.preview(t.dirty_orders, ["o_orderkey"])


# --- filters -----------------------------------------------------------------------------------

@query("drop_na_col", "SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL", ("dirty_orders",))
def drop_na_col(t):
    return filters.drop_missing(t.dirty_orders, "o_totalprice")


@query("drop_na_any", """
SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
""", ("dirty_orders",))
def drop_na_any(t):
    return filters.drop_missing(t.dirty_orders)


@query("outliers_zscore", """
SELECT p.* FROM dirty_part p, (SELECT avg(p_retailprice) m, stddev_samp(p_retailprice) s FROM dirty_part)
WHERE abs((p_retailprice - m) / s) < 3""", ("dirty_part",))
def outliers_zscore(t):
    return filters.remove_outliers(t.dirty_part, "p_retailprice")


@query("outliers_iqr", """
SELECT p.* FROM dirty_part p, (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.75) b FROM dirty_part)
WHERE p_retailprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""", ("dirty_part",))
def outliers_iqr(t):
    return filters.remove_outliers(t.dirty_part, "p_retailprice", "iqr")


# --- scalar functions --------------------------------------------------------------------------

@query("normalize_nulls", """
SELECT o_orderkey, CASE WHEN trim(note) = '' OR note IN ('NaN', 'nan', 'None', 'none', 'N/A', 'n/a') THEN NULL ELSE note END AS note
FROM blank_orders""", ("blank_orders",))
def normalize_nulls(t):
    return columns.normalize_nulls(t.blank_orders)


@query("replace_placeholder", """
SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN trim(o_orderpriority) = '?' THEN NULL WHEN trim(o_orderpriority) = 'unknown' THEN 'low' ELSE o_orderpriority END AS o_orderpriority
FROM dirty_orders""", ("dirty_orders",))
def replace_placeholder(t):
    df = t.dirty_orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    df = columns.replace(df, "o_orderpriority", "?", "NaN")
    df = columns.replace(df, "o_orderpriority", "unknown", "low")
    return columns.replace(df, "o_custkey", "7", "NaN")


@query("strip_whitespace", """
SELECT * REPLACE (trim(o_orderstatus) AS o_orderstatus, trim(o_orderpriority) AS o_orderpriority) FROM dirty_orders
""", ("dirty_orders",))
def strip_whitespace(t):
    return columns.strip_whitespace(t.dirty_orders, "ALL_OBJECT")


@query("clean_text_remove", "SELECT o_orderkey, replace(replace(o_pricestr, '$', ''), ',', '') AS o_pricestr FROM dirty_orders",
       ("dirty_orders",))
def clean_text_remove(t):
    return columns.clean_text(t.dirty_orders.select("o_orderkey", "o_pricestr"), "o_pricestr", "$,")


@query("clean_text_case", """
WITH s AS (SELECT p_partkey, concat(p_name, '''s 3rd-', p_type, ' éclair') AS v FROM part)
SELECT p_partkey, lower(v) AS low, upper(v) AS up,
  array_to_string(list_transform(regexp_extract_all(lower(v), '\\p{L}+|\\P{L}+'), lambda x: concat(upper(x[1]), x[2:])), '') AS title
FROM s""")
def clean_text_case(t):
    v = F.concat("p_name", F.lit("'s 3rd-"), "p_type", F.lit(" éclair"))
    df = t.part.select("p_partkey", v.alias("low"), v.alias("up"), v.alias("title"))
    df = columns.clean_text(df, "low", case="lower")
    df = columns.clean_text(df, "up", case="upper")
    return columns.clean_text(df, "title", case="title")


_NUMBER_SQL = """
WITH n AS (SELECT o_orderkey, CASE WHEN regexp_full_match(trim(txt), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                                   THEN try_cast(trim(txt) AS DOUBLE) END AS v FROM number_text)
"""


@query("cast_float", _NUMBER_SQL + "SELECT o_orderkey, v AS txt FROM n", ("number_text",))
def cast_float(t):
    return columns.cast_type(t.number_text, "txt", "float")


@query("cast_int", _NUMBER_SQL + "SELECT o_orderkey, coalesce(CAST(trunc(v) AS BIGINT), 0) AS txt FROM n", ("number_text",))
def cast_int(t):
    return columns.cast_type(t.number_text, "txt", "int")


@query("cast_str", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM dirty_orders
""", ("dirty_orders",))
def cast_str(t):
    df = t.dirty_orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return columns.cast_type(columns.cast_type(df, "o_custkey", "str"), "o_totalprice", "str")


@query("cast_datetime", """
SELECT o_orderkey, strftime(strptime(iso, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS iso,
  strftime(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%m/%d/%Y'), try_strptime(txt, '%d %B %Y')), '%Y-%m-%d %H:%M:%S') AS txt
FROM date_text""", ("date_text",))
def cast_datetime(t):
    df = t.date_text
    for name in ("iso", "txt"):
        df = columns.cast_type(df, name, "datetime", ["o_orderkey"])
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("iso", "txt")})


@query("format_datetime", """
SELECT o_orderkey, strftime(strptime(iso, '%Y-%m-%d'), '%d/%m/%y') AS iso,
  strftime(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%m/%d/%Y'), try_strptime(txt, '%d %B %Y')), '%a %d %b %Y') AS txt
FROM date_text""", ("date_text",))
def format_datetime(t):
    df = columns.format_datetime(t.date_text, "iso", "%d/%m/%y", ["o_orderkey"])
    return columns.format_datetime(df, "txt", "%a %d %b %Y", ["o_orderkey"])


# The instant that each spelling stands for, from the day itself.
_SPELLED = """CASE o_orderkey % 16 WHEN 8 THEN date_trunc('month', CAST(day AS TIMESTAMP)) WHEN 12 THEN NULL WHEN 15 THEN NULL
  ELSE CAST(day AS TIMESTAMP) END + CASE o_orderkey % 16 WHEN 0 THEN INTERVAL '10:30:00' WHEN 1 THEN INTERVAL '18:03:00'
  WHEN 2 THEN INTERVAL '18:03:00' WHEN 5 THEN INTERVAL '10:30:00' WHEN 9 THEN INTERVAL '08:30:00' WHEN 11 THEN INTERVAL '00:05:00'
  WHEN 13 THEN INTERVAL '23:59:58.5' ELSE INTERVAL '00:00:00' END"""


@query("cast_datetime_spellings", f"""
SELECT o_orderkey, strftime({_SPELLED}, '%Y-%m-%d %H:%M:%S') AS txt FROM date_spellings""", ("date_spellings",))
def cast_datetime_spellings(t):
    df = columns.cast_type(t.date_spellings, "txt", "datetime", ["o_orderkey"])
    return df.select("o_orderkey", F.date_format("txt", "yyyy-MM-dd HH:mm:ss").alias("txt"))


@query("format_datetime_spellings", f"""
SELECT o_orderkey, strftime({_SPELLED}, '%d/%m/%y %H:%M') AS txt FROM date_spellings""", ("date_spellings",))
def format_datetime_spellings(t):
    return columns.format_datetime(t.date_spellings, "txt", "%d/%m/%y %H:%M", ["o_orderkey"]).select("o_orderkey", "txt")


_TIME_ONLY_SQL = "(regexp_matches(trim({0}), '(?i)^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?\\s*(a\\.?m\\.?|p\\.?m\\.?)?$')" \
                 " OR regexp_matches(trim({0}), '(?i)^[0-9]{{1,2}}\\s*(a\\.?m\\.?|p\\.?m\\.?)$'))"


@query("is_time_only", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS sampled, CAST(count(*) FILTER ({_TIME_ONLY_SQL.format(c)}) AS BIGINT) AS matched,
  count(*) FILTER ({_TIME_ONLY_SQL.format(c)}) / count(*) > 0.6 AS is_time_only
FROM (SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 20)""" for c in ("o_timestr", "o_datestr")),
       ("dirty_orders",))
def is_time_only(t):
    return scale.union_all([columns.is_time_only(t.dirty_orders, c, ["o_orderkey"]).withColumn("column_name", F.lit(c))
                            for c in ("o_timestr", "o_datestr")])


def _clock_sql(c: str) -> str:
    return f"""CASE WHEN lower(trim({c})) IN ('nan', 'none', 'nat', '') THEN NULL
  WHEN regexp_matches({c}, '(?i)[0-9]{{1,2}}:[0-9]{{2}}|[0-9]{{1,2}}\\s*[ap]\\.?m') AND
    CASE WHEN regexp_matches({c}, '(?i)[0-9]\\s*[ap]\\.?m') THEN hour_{c} <= 12 ELSE hour_{c} <= 23 END
  THEN printf('%02d:%02d', CAST(CASE WHEN regexp_matches({c}, '(?i)[0-9]\\s*p\\.?m') THEN hour_{c} % 12 + 12
                            WHEN regexp_matches({c}, '(?i)[0-9]\\s*a\\.?m') THEN hour_{c} % 12 ELSE hour_{c} END AS BIGINT),
              CAST(coalesce(nullif(regexp_extract({c}, '[0-9]{{1,2}}:([0-9]{{2}})', 1), ''), '0') AS BIGINT))
  ELSE coalesce(strftime(try_strptime({c}, '%Y-%m-%d'), '%Y-%m-%d %H:%M'), {c}) END AS {c}"""


def _hour_sql(c: str) -> str:
    return f"CAST(nullif(regexp_extract({c}, '(?i)([0-9]{{1,2}})(:[0-9]{{2}}|\\s*[ap]\\.?m)', 1), '') AS BIGINT) AS hour_{c}"


@query("standardize_time", f"""
WITH h AS (SELECT *, {_hour_sql('clock')}, {_hour_sql('other')} FROM time_text)
SELECT o_orderkey, {_clock_sql('clock')}, {_clock_sql('other')} FROM h""", ("time_text",))
def standardize_time(t):
    return columns.standardize_time(columns.standardize_time(t.time_text, "clock"), "other")


@query("extract_pattern", """
SELECT o_orderkey, nullif(regexp_extract(o_messydate, '([0-9]+ [A-Za-z]+ 19[67][0-9])', 1), '') AS o_messydate FROM dirty_orders
""", ("dirty_orders",))
def extract_pattern(t):
    return columns.extract_pattern(t.dirty_orders.select("o_orderkey", "o_messydate"), "o_messydate", "[0-9]+ [A-Za-z]+ 19[67][0-9]")


def _canonical_sql(text_sql: str) -> str:
    return f"""CASE WHEN regexp_full_match({text_sql}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
  THEN regexp_replace(regexp_replace(CAST(CAST({text_sql} AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', '') ELSE {text_sql} END"""


@query("normalize_cell", f"""
SELECT o_orderkey, coalesce({_canonical_sql("lower(trim(txt))")}, '__NULL__') AS number_cell,
  coalesce(regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', ''), '__NULL__') AS price_cell,
  coalesce({_canonical_sql("lower(trim(o_orderpriority))")}, '__NULL__') AS text_cell
FROM number_text JOIN dirty_orders USING (o_orderkey)""", ("number_text", "dirty_orders"))
def normalize_cell(t):
    def cell(df, c):
        return F.coalesce(numbers.canonical(quote(c), df.schema[c].dataType), F.lit("__NULL__"))

    orders, txt = t.dirty_orders, t.number_text
    left = txt.select("o_orderkey", cell(txt, "txt").alias("number_cell"))
    right = orders.select("o_orderkey", cell(orders, "o_totalprice").alias("price_cell"), cell(orders, "o_orderpriority").alias("text_cell"))
    return left.join(right, "o_orderkey")


@query("minutes_of_day", """
WITH m AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN hour(ts) * 60 + minute(ts) END AS v FROM events)
SELECT event_id, coalesce(CAST(v AS DOUBLE), (SELECT quantile_cont(v, 0.5) FROM m)) AS minutes FROM m""")
def minutes_of_day(t):
    value = F.when(F.col("event_id") % 9 != 0, datetimes.minutes_of_day(F.col("ts"))).cast("double")
    return impute.fill_statistic(t.events.select("event_id", value.alias("minutes")), ["minutes"], "median")


@query("parse_issues_json", """
SELECT doc_id, lang AS column_name, 'null_treatment' AS issue_type, 'treat_nulls' AS category, 'high' AS severity FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, source, 'split_column', 'split_columns', 'low' FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, lang, 'duplicate', NULL, 'high' FROM documents WHERE doc_id % 5 = 4
UNION ALL SELECT doc_id, source, 'drop_column', 'drop_columns', 'medium' FROM documents WHERE doc_id % 5 = 4
UNION ALL SELECT doc_id, 'not parsed', NULL, NULL, NULL FROM documents WHERE doc_id % 5 = 2""")
def parse_issues_json(t):
    parsed = intake.parse_issues(t.issue_replies)
    found = intake.exploded(parsed, "issues").select(
        "doc_id", F.col("column").alias("column_name"), "issue_type", "category", "severity")
    broken = parsed.where(F.col("issues").isNull()).select(
        "doc_id", F.lit("not parsed").alias("column_name"), *[F.lit(None).cast("string").alias(c) for c in ("issue_type", "category", "severity")])
    return found.unionByName(broken)


@query("parse_steps_json", """
SELECT p_partkey, '1' AS step_id, 'treat_nulls' AS phase, p_type AS column_name, 'fill_na' AS operation, 'mode' AS argument, 'r' AS reason FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, '2', 'drop_columns', concat('c', CAST(p_size AS VARCHAR)), 'drop_column', NULL, 's' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR), 'standardize', p_type, 'cast_type', 'int', 't' FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, NULL, 'not parsed', NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 2""")
def parse_steps_json(t):
    parsed = intake.parse_steps(t.step_replies)
    argument = F.coalesce(F.get_json_object("params", "$.strategy"), F.get_json_object("params", "$.dtype"))
    found = intake.exploded(parsed, "steps").select(
        "p_partkey", "step_id", "phase", F.col("column").alias("column_name"), "operation", argument.alias("argument"), "reason")
    broken = parsed.where(F.col("steps").isNull()).select(
        "p_partkey", F.lit(None).cast("string").alias("step_id"), F.lit("not parsed").alias("phase"),
        *[F.lit(None).cast("string").alias(c) for c in ("column_name", "operation", "argument", "reason")])
    return found.unionByName(broken)


# --- fills -------------------------------------------------------------------------------------

@query("fill_mean", """
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty_orders)), 4) AS o_totalprice FROM dirty_orders
""", ("dirty_orders",))
def fill_mean(t):
    df = t.dirty_orders.select("o_orderkey", "o_totalprice")
    return rounded(impute.fill_na(df, "o_totalprice", "mean"), "o_totalprice")


@query("fill_median", """
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty_orders)), 4) AS o_totalprice FROM dirty_orders
""", ("dirty_orders",))
def fill_median(t):
    df = t.dirty_orders.select("o_orderkey", "o_totalprice")
    return rounded(impute.fill_na(df, "o_totalprice", "median"), "o_totalprice")


def _mode_sql(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("fill_mode", f"""
SELECT o_orderkey, coalesce(o_orderstatus, {_mode_sql('dirty_orders', 'o_orderstatus')}) AS o_orderstatus,
  coalesce(o_orderpriority, {_mode_sql('dirty_orders', 'o_orderpriority')}) AS o_orderpriority FROM dirty_orders""", ("dirty_orders",))
def fill_mode(t):
    df = t.dirty_orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return impute.fill_statistic(df, ["o_orderstatus", "o_orderpriority"], "mode")


@query("fill_ffill", """
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM dirty_events
""", ("dirty_events",))
def fill_ffill(t):
    return impute.fill_na(t.dirty_events.select("event_id", "value"), "value", "ffill", order_by=["event_id"])


@query("fill_bfill", """
SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM dirty_events""", ("dirty_events",))
def fill_bfill(t):
    return impute.fill_na(t.dirty_events.select("event_id", "value"), "value", "bfill", order_by=["event_id"])


@query("fill_interpolate", """
WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS pos FROM dirty_events),
k AS (SELECT *, CASE WHEN value IS NOT NULL THEN pos END AS vp FROM p),
n AS (SELECT *, last_value(value IGNORE NULLS) OVER w1 AS pv, last_value(vp IGNORE NULLS) OVER w1 AS pp,
        first_value(value IGNORE NULLS) OVER w2 AS nv, first_value(vp IGNORE NULLS) OVER w2 AS np FROM k
      WINDOW w1 AS (ORDER BY pos ROWS UNBOUNDED PRECEDING), w2 AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv WHEN pv IS NULL THEN NULL
  ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END, 4) AS value FROM n""", ("dirty_events",))
def fill_interpolate(t):
    df = t.dirty_events.select("event_id", "value")
    return rounded(impute.fill_na(df, "value", "interpolate", order_by=["event_id"]), "value")


@query("fill_interpolate_text", f"""
SELECT event_id, coalesce(event_type, {_mode_sql('dirty_events', 'event_type')}) AS event_type FROM dirty_events""", ("dirty_events",))
def fill_interpolate_text(t):
    return impute.fill_na(t.dirty_events.select("event_id", "event_type"), "event_type", "interpolate", order_by=["event_id"])


@query("fill_constant", """
SELECT event_id, coalesce(event_type, 'Unknown') AS event_type, coalesce(value, 0.0) AS value, coalesce(user_id, -1) AS user_id
FROM dirty_events""", ("dirty_events",))
def fill_constant(t):
    df = t.dirty_events.select("event_id", "event_type", "value", "user_id")
    df = impute.fill_na(df, "event_type", "mean")
    return impute.fill_na(impute.fill_na(df, "value", None, value="0"), "user_id", "constant", value=-1)


def _group_sql(stat: str, c: str = "value") -> str:
    return f"""
WITH g AS (SELECT user_id AS g, {stat} AS fill FROM dirty_events WHERE user_id IS NOT NULL AND {c} IS NOT NULL GROUP BY 1)
SELECT event_id, user_id, round(coalesce(value, fill), 4) AS value FROM dirty_events LEFT JOIN g ON user_id = g"""


@query("fill_group_mean", _group_sql("avg(value)"), ("dirty_events",))
def fill_group_mean(t):
    return rounded(impute.fill_group(t.dirty_events.select("event_id", "user_id", "value"), "value", "user_id", "mean"), "value")


@query("fill_group_median", _group_sql("quantile_cont(value, 0.5)"), ("dirty_events",))
def fill_group_median(t):
    return rounded(impute.fill_group(t.dirty_events.select("event_id", "user_id", "value"), "value", "user_id", "median"), "value")


_GROUP_MODE = """
WITH c AS (SELECT user_id AS g, event_type AS v, count(*) AS n FROM dirty_events
           WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
m AS (SELECT g, v FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, v) = 1)
"""


@query("fill_group_mode", _GROUP_MODE + """
SELECT event_id, user_id, coalesce(event_type, v) AS event_type FROM dirty_events LEFT JOIN m ON user_id = g""", ("dirty_events",))
def fill_group_mode(t):
    return impute.fill_group(t.dirty_events.select("event_id", "user_id", "event_type"), "event_type", "user_id", "mode")


@query("fill_group_ffill", """
SELECT event_id, user_id, CASE WHEN user_id IS NULL THEN value
  ELSE last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS value
FROM dirty_events""", ("dirty_events",))
def fill_group_ffill(t):
    return ordered.carry(t.dirty_events.select("event_id", "user_id", "value"), "value", ["event_id"], "user_id")


@query("fill_group_bfill", """
SELECT event_id, user_id, CASE WHEN user_id IS NULL THEN value
  ELSE first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS value
FROM dirty_events""", ("dirty_events",))
def fill_group_bfill(t):
    return ordered.carry(t.dirty_events.select("event_id", "user_id", "value"), "value", ["event_id"], "user_id", forward=False)


@query("fill_group_fallback", f"""
WITH g AS (SELECT user_id AS g, avg(value) AS fill FROM dirty_events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1),
c AS (SELECT user_id AS g, event_type AS v, count(*) AS n FROM dirty_events
      WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
m AS (SELECT g, v FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, v) = 1),
a AS (SELECT event_id, user_id, coalesce(value, fill) AS value, coalesce(event_type, v) AS event_type
      FROM dirty_events e LEFT JOIN g ON e.user_id = g.g LEFT JOIN m ON e.user_id = m.g)
SELECT event_id, user_id, round(coalesce(value, (SELECT avg(value) FROM a)), 4) AS value,
  coalesce(event_type, {_mode_sql('a', 'event_type')}) AS event_type FROM a""", ("dirty_events",))
def fill_group_fallback(t):
    df = t.dirty_events.select("event_id", "user_id", "value", "event_type")
    df = impute.fill_na(df, "value", "mean", group_by="user_id")
    return rounded(impute.fill_na(df, "event_type", "interpolate", group_by="user_id"), "value")


# --- duplicates --------------------------------------------------------------------------------

@query("dedupe_full", "SELECT DISTINCT * FROM dup_orders", ("dup_orders",))
def dedupe_full(t):
    return dedupe.drop_duplicates(t.dup_orders)


@query("dedupe_subset", """
SELECT * FROM dirty_events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
""", ("dirty_events",))
def dedupe_subset(t):
    return dedupe.drop_duplicates(t.dirty_events, ["user_id", "event_type", "no_such_column"], ["event_id"])


