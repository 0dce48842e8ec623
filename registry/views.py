"""Dirty views over the clean tables.  The SQL text is valid in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "dirty_orders": """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ? '
       WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 19 = 0 THEN 'unknown'
       ELSE concat(' ', lower(o_orderpriority)) END AS o_orderpriority,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_datestr,
  concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',',
         lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')) AS o_pricestr,
  concat(CAST(o_orderkey % 12 + 1 AS STRING), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'),
         CASE WHEN o_orderkey % 2 = 0 THEN ' p.m.' ELSE ' AM' END) AS o_timestr,
  concat(CAST(o_orderkey % 28 + 1 AS STRING), ' September ', CAST(1960 + o_orderkey % 40 AS STRING), ' (USA)') AS o_messydate
FROM orders""",
    "dup_orders": """
SELECT * FROM dirty_orders UNION ALL SELECT * FROM dirty_orders WHERE o_orderkey % 23 = 0""",
    "dirty_part": """
SELECT p_partkey, concat(p_brand, ' - ', p_type) AS p_brandtype,
  CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ', ', p_type, ',1,000') ELSE concat(p_name, ', ', p_type) END AS p_csv,
  CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END AS p_type_num, p_type,
  CASE WHEN p_partkey % 50 = 0 THEN CAST(1000000.0 AS DOUBLE) ELSE p_retailprice END AS p_retailprice,
  'const' AS p_const, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE NULL END AS p_sparse,
  concat('SKU-', CAST(p_partkey AS STRING)) AS p_sku
FROM part""",
    "dirty_events": """
SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 6 IN (0, 1) THEN NULL ELSE value END AS value, props
FROM events""",
    "bench_orders": """
SELECT o_orderkey, lower(trim(o_orderpriority)) AS o_orderpriority,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders""",
    # Text that is blank, a null token, or a token with spaces around it.
    "blank_orders": """
SELECT o_orderkey,
  CASE o_orderkey % 7 WHEN 0 THEN '   ' WHEN 1 THEN 'N/A' WHEN 2 THEN ' N/A ' WHEN 3 THEN 'none'
       WHEN 4 THEN '' WHEN 5 THEN NULL ELSE concat('  ', o_orderpriority) END AS note
FROM orders""",
    # Text around the number grammar.
    "number_text": """
SELECT o_orderkey,
  CASE o_orderkey % 12 WHEN 0 THEN '1e3' WHEN 1 THEN concat(' ', CAST(o_orderkey AS STRING), '.75 ')
       WHEN 2 THEN '-3.7' WHEN 3 THEN 'abc' WHEN 4 THEN '1_000' WHEN 5 THEN '1f' WHEN 6 THEN NULL
       WHEN 7 THEN '.5' WHEN 8 THEN '-5.' WHEN 9 THEN '0x10' WHEN 10 THEN '1,000'
       ELSE CAST(o_custkey AS STRING) END AS txt
FROM orders""",
    # Dates in several formats.
    "date_text": """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
       WHEN 1 THEN concat(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/',
                          substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/',
                          substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4))
       WHEN 2 THEN concat(CAST(o_orderkey % 28 + 1 AS STRING), ' September ', CAST(1960 + o_orderkey % 40 AS STRING))
       WHEN 3 THEN 'no date' ELSE NULL END AS txt
FROM orders""",
    # One instant in many spellings; the number of the spelling is the order key modulo 16.
    "date_spellings": """
SELECT o_orderkey, d AS day, concat(CAST(o_orderkey % 12 + 1 AS STRING), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) AS clock,
  CASE o_orderkey % 16
    WHEN 0 THEN concat(y, '-', m, '-', dd, 'T10:30:00Z') WHEN 1 THEN concat(y, '-', m, '-', dd, ' 6:03 p.m.')
    WHEN 2 THEN concat(m, '/', dd, '/', y, ' 6:03 PM') WHEN 3 THEN concat(m, '.', dd, '.', y)
    WHEN 4 THEN concat(CAST(CAST(dd AS INT) AS STRING), '-', mon, '-', y) WHEN 5 THEN concat(mon, ' ', CAST(CAST(dd AS INT) AS STRING), ', ', y, ' 10:30')
    WHEN 6 THEN concat(m, '/', dd, '/', substring(y, 3, 2)) WHEN 7 THEN concat('Thu, ', dd, ' ', mon, ' ', y)
    WHEN 8 THEN concat(mon, ' ', y) WHEN 9 THEN concat(y, '-', m, '-', dd, 'T10:30:00+02:00')
    WHEN 10 THEN concat(CAST(CAST(dd AS INT) AS STRING), 'th ', upper(mon), ' ', y) WHEN 11 THEN concat(y, m, dd, ' 12:05 am')
    WHEN 12 THEN concat(m, '/', dd, '/', y, ' 13:03 PM') WHEN 13 THEN concat(y, '.', m, '.', dd, ' 23:59:58.5')
    WHEN 14 THEN concat('Monday ', mon, ' ', dd, ' ', y) ELSE concat('about ', y) END AS txt
FROM (
  SELECT o_orderkey, d, substring(d, 1, 4) AS y, substring(d, 6, 2) AS m, substring(d, 9, 2) AS dd,
    substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substring(d, 6, 2) AS INT) * 3 - 2, 3) AS mon
  FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) AS o) AS p""",
    # Times of day in several spellings.
    "time_text": """
SELECT o_orderkey,
  concat(CAST(o_orderkey % 12 + 1 AS STRING), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'),
         CASE o_orderkey % 7 WHEN 0 THEN ' p.m.' WHEN 1 THEN 'AM' WHEN 2 THEN ' pm (Estimated runway)'
              WHEN 3 THEN ':59' WHEN 4 THEN ' a.m.' ELSE '' END) AS clock,
  CASE o_orderkey % 6 WHEN 0 THEN '25:00' WHEN 1 THEN concat(CAST(o_orderkey % 12 + 1 AS STRING), ' PM')
       WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 3 THEN 'noon' WHEN 4 THEN 'nan'
       ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 10:30') END AS other
FROM orders""",
    # Text as a CSV reader would meet it.
    "token_orders": """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'NA' WHEN 1 THEN ' null ' WHEN 2 THEN '--' WHEN 3 THEN ' None'
       WHEN 4 THEN 'null' WHEN 5 THEN '#N/A' WHEN 6 THEN 'nan' WHEN 7 THEN NULL ELSE o_orderpriority END AS token
FROM orders""",
    # Replies of an outside analyser, one per document.
    "issue_replies": """
SELECT doc_id, lang, source,
  CASE doc_id % 5
    WHEN 0 THEN concat('```json ', '[LB]"issues": [[LB]"column": "', lang, '", "issue_type": "null_treatment", "category": "treat_nulls", "severity": "high"[RB]][RB]', ' ```')
    WHEN 1 THEN concat('[[LB]"column": "', source, '", "issue_type": "split_column", "category": "split_columns", "severity": "low"[RB]]')
    WHEN 2 THEN '[LB]"issues": [[LB]"column": "broken'
    WHEN 3 THEN '[LB]"note": "nothing found"[RB]'
    ELSE concat('[LB]"issues": [[LB]"column": "', lang, '", "issue_type": "duplicate", "severity": "high"[RB], ',
                '[LB]"column": "', source, '", "issue_type": "drop_column", "category": "drop_columns", "severity": "medium"[RB]][RB]')
  END AS reply
FROM documents""",
    # Replies of an outside planner, one per part.
    "step_replies": """
SELECT p_partkey, p_type, p_size,
  CASE p_partkey % 4
    WHEN 0 THEN concat('```json ', '[LB]"steps": [[LB]"step_id": 1, "phase": "treat_nulls", "column": "', p_type, '", "operation": "fill_na", "params": [LB]"strategy": "mode"[RB], "reason": "r"[RB], ',
                       '[LB]"step_id": 2, "phase": "drop_columns", "column": "c', CAST(p_size AS STRING), '", "operation": "drop_column", "params": [LB][RB], "reason": "s"[RB]][RB] ```')
    WHEN 1 THEN concat('[LB]"steps": [[LB]"step_id": ', CAST(p_size AS STRING), ', "phase": "standardize", "column": "', p_type, '", "operation": "cast_type", "params": [LB]"dtype": "int"[RB], "reason": "t"[RB]][RB]')
    WHEN 2 THEN 'Sorry, here is no plan'
    ELSE '[LB]"steps": [][RB]' END AS reply
FROM part""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _text(name: str) -> str:
    # Braces in JSON text are written as [LB] and [RB], because Spark's SQL formatter reads braces.
    return VIEWS[name].replace("[LB]", "{").replace("[RB]", "}")


def _inputs(name: str) -> list[str]:
    return [t for t in [*VIEWS, *TABLES] if t != name and re.search(rf"FROM {t}\b", VIEWS[name])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a dirty view of it."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {t: view(spark, sf_dir, t) for t in _inputs(name)}
    query = _text(name).replace("{", "{{").replace("}", "}}")
    for t in inputs:
        query = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", query)
    return spark.sql(query, **inputs)


def ctes(*names: str) -> str:
    """The views as DuckDB common table expressions, without the leading WITH."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for t in _inputs(name):
            if t in VIEWS:
                add(t)
        out[name] = _text(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({q})" for n, q in out.items())
