"""Issues and plans made elsewhere: JSON replies, one per row, or plain Python objects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions.text import extract, quote, strip
from limpid.operators import scale
from limpid.operators.columns import extract_pattern
from limpid.plans.issues import COLUMNS
from limpid.plans.planner import STEPS_SCHEMA

_ISSUE = "struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ">"
# params stays text: its fields differ by operation.
_STEP = "struct<step_id:string,phase:string,column:string,operation:string,params:string,reason:string>"


def unfenced(reply: Column) -> Column:
    """Reply text without code fences."""
    return strip(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def parse_issues(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add parsed (is it JSON at all) and issues.

    Accepts {"issues": [...]} and a bare list.  Other JSON gives an empty list; broken text gives
    NULL, for which the caller uses the rule-based issues.
    """
    text = unfenced(F.col(reply))
    kind = F.substring(text, 1, 1)
    listed = F.from_json(text, f"array<{_ISSUE}>")
    wrapped = F.from_json(text, f"struct<issues:array<{_ISSUE}>>")["issues"]
    valid = F.is_valid_json(text) if hasattr(F, "is_valid_json") else F.try_parse_json(text).isNotNull()
    empty = F.from_json(F.lit("[]"), f"array<{_ISSUE}>")
    issues = F.when(valid, F.coalesce(F.when(kind == "[", listed).otherwise(wrapped), empty))
    return replies.withColumn("parsed", F.coalesce(valid, F.lit(False))).withColumn("issues", issues)


def parse_steps(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add parsed and steps; broken text or text without an object gives NULL steps."""
    text = unfenced(F.col(reply))
    valid = F.coalesce(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.lit(False))
    steps = F.from_json(text, f"struct<steps:array<{_STEP}>>")["steps"]
    empty = F.from_json(F.lit("[]"), f"array<{_STEP}>")
    return replies.withColumn("parsed", valid).withColumn("steps", F.when(valid, F.coalesce(steps, empty)))


def exploded(parsed: DataFrame, field: str) -> DataFrame:
    """One row per issue or step, next to the other columns of the reply."""
    rest = [c for c in parsed.columns if c not in (field, "parsed")]
    return parsed.where("parsed").select(*rest, F.inline(field))


def steps_table(spark: SparkSession, workflow) -> DataFrame:
    """Steps table from a plan given as dict, list or JSON text."""
    if isinstance(workflow, str):
        workflow = json.loads(workflow.replace("```json", "").replace("```", "").strip())
    steps = workflow.get("steps", []) if isinstance(workflow, dict) else workflow

    def number(value):
        try:
            return int(value)
        except (TypeError, ValueError):
            return None

    rows = [(number(s.get("step_id")), s.get("phase", "other"), s.get("column"), s.get("operation"),
             json.dumps(s.get("params") or {}), s.get("reason", "")) for s in steps]
    return scale.local_table(spark, rows, STEPS_SCHEMA)


def lint(df: DataFrame, steps: DataFrame) -> list[str]:
    """Warnings about extract_pattern steps that match no row.

    Plans written from a garbled example pattern parse well and then blank the column.  All patterns
    are counted over all rows in one aggregate.
    """
    warnings, counts = [], {}
    for step in steps.where("operation = 'extract_pattern'").collect():
        pattern = json.loads(step["params"] or "{}").get("pattern")
        if not pattern or step["column"] not in df.columns:
            continue
        try:
            extract_pattern(df, step["column"], pattern)
        except Exception as error:  # a pattern either engine rejects
            warnings.append(f"step {step['step_id']}: invalid pattern: {error}")
            continue
        counts[step["step_id"]] = F.count(extract(quote(step["column"]).cast("string"), pattern))
    if counts:
        hits = df.agg(*[n.alias(f"step{i}") for i, n in enumerate(counts.values())]).first()
        warnings += [f"step {number}: its pattern matches no row" for number, n in zip(counts, hits) if not n]
    return warnings
