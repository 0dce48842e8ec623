"""The whole run: profile, issues, plan, clean, evaluate, compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.functions.constants import ROW_ID
from limpid.operators import benchmark, evaluate, ml, scale
from limpid.operators import profile as profiling
from limpid.plans import issues as issue_rules
from limpid.plans import planner, runner
from limpid.sources import csv, sinks


@dataclass(frozen=True)
class Analysis:
    """Profile of a table and what the rules make of it; all small tables."""

    columns: DataFrame
    table: DataFrame
    issues: DataFrame
    steps: DataFrame


def analyze(df: DataFrame, order_by: list[str], steps: DataFrame | None = None) -> Analysis:
    """Profile and plan; `steps` replaces the rule-based plan by one made elsewhere."""
    columns, table = profiling.profile(df, order_by)
    found = issue_rules.all_issues(columns, table)
    plan = planner.validate(steps if steps is not None else planner.plan(columns, table))
    return Analysis(columns, table, found, plan)


@dataclass(frozen=True)
class Result:
    analysis: Analysis
    clean: DataFrame
    log: DataFrame
    quality: DataFrame
    model: DataFrame | None
    benchmark: DataFrame | None
    per_column: DataFrame | None = None  # accuracy of each common column
    mismatches: DataFrame | None = None  # the first differing cells of each column
    schema: DataFrame | None = None  # which columns both tables have
    errors: tuple[tuple[str, str], ...] = ()  # (part, message) of evaluations that failed


def clean(df: DataFrame, order_by: list[str], steps: DataFrame | None = None, target: str | None = None,
          truth: DataFrame | None = None, truth_order: list[str] | None = None) -> Result:
    """Everything for one table.

    A model or a comparison that fails is noted in `errors` and loses nothing else.  The row order of
    the input serves throughout, whatever the plan does to the columns it comes from.  The input and the
    cleaned table are read many times, so both are staged.
    """
    df = scale.stage(df, "input")
    analysis = analyze(df, order_by, steps)
    raw = df if order_by == [ROW_ID] else df.withColumn(ROW_ID, F.struct(*scale.columns_of(order_by)))
    kept, log = runner.run(raw, analysis.steps, [ROW_ID], keep_order=True)
    cleaned = kept if ROW_ID in df.columns else kept.drop(ROW_ID)
    errors = []

    def isolated(part: str, job):
        try:
            return job()
        except Exception as error:
            errors.append((part, f"{type(error).__name__}: {str(error).splitlines()[0]}"))
            return None

    def compare():
        right = truth if (truth_order or order_by) == [ROW_ID] else truth.withColumn(ROW_ID, F.struct(*scale.columns_of(truth_order or order_by)))
        if not benchmark.common_columns(kept, right):
            return benchmark.summary(kept, right, [ROW_ID]), None, None, benchmark.schema_match(kept, right)
        both = benchmark.Comparison(scale.stage(benchmark.align(kept, right, [ROW_ID]), "compared"))
        found = benchmark.summary(kept, right, [ROW_ID], compare=both)
        return found, benchmark.column_accuracy(both.columns()), both.mismatches(), benchmark.schema_match(kept, right)

    quality = evaluate.quality(df, cleaned)
    model = isolated("ml_metrics", lambda: ml.evaluate(raw, kept, target, [ROW_ID])) if target else None
    compared = (isolated("benchmark_accuracy", compare) if truth is not None else None) or (None, None, None, None)
    return Result(analysis, cleaned, log, quality, model, *compared, errors=tuple(errors))


def report(result: Result) -> DataFrame:
    """One JSON document per report section: section, report."""
    def section(name: str, df: DataFrame) -> DataFrame:
        rows = df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("report"))
        return rows.select(F.lit(name).alias("section"), "report")

    parts = [section("quality_metrics", result.quality),
             section("execution_summary", runner.execution_summary(result.log))]
    if result.model is not None:
        parts.append(section("ml_metrics", result.model))
    for name, df in (("benchmark_accuracy", result.benchmark), ("benchmark_columns", result.per_column),
                     ("benchmark_mismatches", result.mismatches), ("benchmark_schema", result.schema)):
        if df is not None:
            parts.append(section(name, df))
    if result.errors:
        spark = result.log.sparkSession
        parts.append(section("errors", scale.local_table(spark, list(result.errors), "part string, message string")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean_csv(spark, filename: str, data_path: str = "data/raw", out_path: str = "data/processed",
              benchmark_folder: str | None = None, target: str | None = None, **options) -> Result:
    """CSV in, cleaned CSV and JSON reports out.  The default target is the last column.

    The result still reads staged tables; call scale.release(spark) when it is no longer needed.  If
    the run fails they are deleted here.
    """
    try:
        return _clean_csv(spark, filename, data_path, out_path, benchmark_folder, target, **options)
    except Exception:
        scale.release(spark)
        raise


def _clean_csv(spark, filename, data_path, out_path, benchmark_folder, target, **options) -> Result:
    raw = csv.load_csv(spark, filename, data_path, **{"stage": False, **options})  # clean() stages it
    target = target or csv.target_column(raw)
    truth_file = csv.benchmark_path(spark, benchmark_folder, filename) if benchmark_folder else None
    truth = csv.load_csv(spark, truth_file, benchmark_folder) if truth_file else None
    result = clean(raw, [csv.ROW_ID], target=target, truth=truth)
    name = csv.safe_name(filename)
    sinks.write_report(result.analysis.columns, f"{out_path}/profile_{name}")
    sinks.write_report(result.analysis.issues, f"{out_path}/issues_{name}")
    sinks.write_report(result.analysis.steps, f"{out_path}/plan_{name}")
    sinks.write_report(result.log, f"{out_path}/execution_{name}")
    sinks.write_csv(result.clean, f"{out_path}/clean_{name}", mode="overwrite")
    sinks.write_report(report(result), f"{out_path}/evaluation_{name}")
    sinks.write_report(runner.step_report(result.log), f"{out_path}/steps_{name}")
    if result.benchmark is not None:
        sinks.write_report(result.benchmark, f"{out_path}/benchmark_{name}")
    return result
