"""Run a cleaning plan: an ordered fold of DataFrame operators with a step log.

Steps stay lazy.  Data is read only where a step needs a statistic or changes the number of rows:
* adjacent global fills share one fit,
* cells changed by a step are marked in a flag column and all flags are counted by one aggregate
  per segment, so counts cost one job per segment instead of one per step and stay exact when
  tasks are rerun,
* after a step that shuffles, later steps read a staged table instead of replaying the prefix,
* the result is staged, so its readers do not replay the steps since then (dates cost tens of microseconds a cell).
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.constants import PHASES, ROW_ID
from limpid.functions.numbers import is_numeric
from limpid.functions.text import quote
from limpid.operators import columns, dedupe, filters, impute, scale
from limpid.plans.planner import execution_order

LOG_SCHEMA = ("run_order int, step_id int, phase string, operation string, column string, status string,"
              " reason string, result string, affected bigint")

@dataclass
class Entry:
    """Log entry of one step; `result` may hold {n}, filled in once the count is known."""

    run_order: int
    step_id: int | None
    phase: str
    operation: str | None
    column: str | None
    reason: str | None
    status: str = "skipped"
    result: str = ""
    affected: int | None = None

    def row(self) -> tuple:
        result = self.result.replace("{n}", str(self.affected)) if self.affected is not None else self.result
        phase = self.phase if self.phase in PHASES else "other"
        return (self.run_order, self.step_id, phase, self.operation, self.column, self.status, self.reason,
                result, self.affected)


@dataclass
class Run:
    """State of a run: the table so far, flags still to be counted, and the log."""

    df: DataFrame
    order_by: list[str]
    eager: bool = False
    rows: int | None = None
    flags: list[tuple[Entry, str]] = field(default_factory=list)
    complete: set[str] = field(default_factory=set)  # columns that a step has left without gaps
    log: list[Entry] = field(default_factory=list)

    def visible(self) -> list[str]:
        hidden = {name for _, name in self.flags}
        return [c for c in self.df.columns if c not in hidden]

    def mark(self, entry: Entry, hit: Column) -> None:
        """Remember which rows a step is about to change."""
        name = f"__hit{entry.run_order}"
        self.df = self.df.withColumn(name, hit)
        self.flags.append((entry, name))

    def settle(self) -> None:
        """Count rows and all open flags in one aggregate."""
        counts = self.df.agg(F.count(F.lit(1)), *[F.count_if(quote(n)) for _, n in self.flags]).first()
        self.rows = counts[0]
        for (entry, _), n in zip(self.flags, counts[1:]):
            entry.affected = n
        self.df = self.df.select(*scale.columns_of(self.visible()))
        self.flags = []


def parse_params(step) -> dict:
    return json.loads(step["params"] or "{}")


def run(df: DataFrame, steps: DataFrame, order_by: list[str], stage: bool = True, keep_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean `df`; returns (cleaned table, log table).

    The row order is frozen in the row id before the first step, so a step may drop, rename or split
    the columns it comes from; `keep_order` leaves the row id in the result.  A failing step is logged
    as failed and leaves the table as it was.  Steps are lazy; if one fails only when rows are read,
    the plan runs again with every step computed at once, which shows the step to blame.
    """
    ordered_steps = execution_order(steps).orderBy("run_order").collect()  # a few rows per column
    frozen = df if order_by == [ROW_ID] else df.withColumn(ROW_ID, F.struct(*scale.columns_of(order_by)))
    try:
        state = _run_all(frozen, ordered_steps, stage, eager=False)
        if stage:
            state.df = scale.stage(state.df, "cleaned")
        state.settle()
    except PySparkException:
        state = _run_all(frozen, ordered_steps, stage, eager=True)
        state.settle()
    log = scale.local_table(df.sparkSession, [e.row() for e in state.log], LOG_SCHEMA)
    return state.df if keep_order or ROW_ID in df.columns else state.df.drop(ROW_ID), log


def _run_all(df: DataFrame, steps: list, stage: bool, eager: bool) -> Run:
    state = Run(columns.normalize_nulls(df), [ROW_ID], eager=eager)
    i = 0
    while i < len(steps):
        group = [steps[i]] if eager else _fill_group(steps, i, state)
        if len(group) > 1:
            _run_fills(group, state)
        else:
            _run_step(group[0], state, stage and i + 1 < len(steps))
        i += len(group)
    return state


def _entry(step) -> Entry:
    return Entry(step["run_order"], step["step_id"], step["phase"] or "other", step["operation"], step["column"], step["reason"])


# --- fused global fills ------------------------------------------------------------------------

def _fusable(step, state: Run) -> bool:
    if step["operation"] != "fill_na" or step["column"] not in state.df.columns:
        return False
    params = parse_params(step)
    if params.get("group_by") in state.df.columns:
        return False
    dtype = state.df.schema[step["column"]].dataType
    return impute.effective_strategy(params.get("strategy"), dtype) in impute.GLOBAL_STATISTICS


def _fill_group(steps: list, start: int, state: Run) -> list:
    """The step, with the global fills of other columns that follow it directly."""
    group, seen = [], set()
    for step in steps[start:]:
        if not _fusable(step, state) or step["column"] in seen:
            break
        group.append(step)
        seen.add(step["column"])
    return group or [steps[start]]


def _run_fills(group: list, state: Run) -> None:
    wanted = {s["column"]: parse_params(s)["strategy"] for s in group}
    try:
        fitted = impute.fit(state.df, wanted)
    except Exception as error:
        for step in group:
            entry = _entry(step)
            entry.status, entry.result = "failed", str(error)
            state.log.append(entry)
        return
    values = {}
    for step in group:
        entry, name = _entry(step), step["column"]
        value = fitted[name] if fitted[name] is not None else parse_params(step).get("value")
        state.mark(entry, quote(name).isNull())
        values[name] = value
        if value is not None:
            state.complete.add(name)
        entry.status, entry.result = "executed", _fill_text(wanted[name], value)
        state.log.append(entry)
    state.df = impute.fill_values(state.df, values)


def _fill_text(strategy: str, value) -> str:
    if strategy in ("mean", "median"):
        return f"{{n}} gaps <- {strategy} {value:.2f}" if value is not None else f"{{n}} gaps: the {strategy} is unknown"
    return f"{{n}} gaps <- {strategy} '{value}'"


# --- single steps ------------------------------------------------------------------------------

def _run_step(step, state: Run, stage: bool) -> None:
    entry = _entry(step)
    before = state.df, list(state.flags), state.rows
    try:
        handler = HANDLERS.get(entry.operation)
        if entry.operation == "no_action":
            entry.result = "nothing to do"
        elif handler is None:
            entry.result = f"no such operation: {entry.operation}"
        else:
            if entry.operation in MAY_LEAVE_GAPS:
                names = parse_params(step)
                state.complete -= {entry.column, names.get("new_name"), *names.get("new_columns", [])}
            handler(state, entry, parse_params(step), stage)
            if state.eager:
                state.df = scale.stage(state.df, "step")
                state.settle()
    except Exception as error:
        if isinstance(error, PySparkException) and not isinstance(error, AnalysisException) and not state.eager and _pending(state):
            raise  # an earlier step may be to blame
        state.df, state.flags, state.rows = before
        entry.status, entry.result = "failed", str(error).split("\n")[0]
    state.log.append(entry)


def _pending(state: Run) -> bool:
    return any(e.status == "executed" for e in state.log)


def _known(state: Run, entry: Entry) -> bool:
    if entry.column in state.df.columns and entry.column != ROW_ID:
        return True
    entry.result = f"no column {entry.column}"
    return False


def _done(entry: Entry, result: str) -> None:
    entry.status, entry.result = "executed", result


def _replace(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if not _known(state, entry):
        return
    old, new = params.get("old"), params.get("new")
    state.mark(entry, columns.replace_match(state.df, entry.column, old))
    state.df = columns.replace(state.df, entry.column, old, new)
    _done(entry, f"{{n}} cells: '{old}' -> {'NULL' if new in ('NaN', 'nan') else repr(new)}")


def _fill(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if not _known(state, entry):
        return
    strategy, group = params.get("strategy"), params.get("group_by")
    name, dtype = entry.column, state.df.schema[entry.column].dataType
    if strategy == "interpolate" and is_numeric(dtype) and not group:
        # Usually a fill came first and nothing is left: then there is nothing to order.
        if name in state.complete or state.df.where(quote(name).isNull()).limit(1).count() == 0:
            entry.affected = 0
            _done(entry, "{n} gaps interpolated")
            return
    state.mark(entry, quote(name).isNull())
    if group in state.df.columns or strategy in ("ffill", "bfill", "interpolate"):
        state.settle()
        state.df = impute.fill_na(state.df, name, strategy, value=params.get("value"), group_by=group, order_by=state.order_by)
        if stage:
            state.df = scale.stage(state.df, "fill")
        if group in state.df.columns:
            _done(entry, f"{{n}} gaps <- {strategy} within {group}")
        else:
            text = {"ffill": "{n} gaps <- value before", "bfill": "{n} gaps <- value after",
                    "interpolate": "{n} gaps interpolated" if is_numeric(dtype) else "{n} gaps <- mode, as the column is no number"}
            _done(entry, text[strategy])
        return
    kind = impute.effective_strategy(strategy, dtype)
    if kind in impute.GLOBAL_STATISTICS:
        value = impute.fit(state.df, {name: kind})[name]
        value = params.get("value") if value is None else value
        state.df = impute.fill_values(state.df, {name: value})
        if value is not None:
            state.complete.add(name)
        _done(entry, _fill_text(kind, value))
    else:
        value = params.get("value")
        state.df = impute.fill_constant(state.df, name, value)
        _done(entry, f"{{n}} gaps <- constant '{impute.FILL_TEXT if value is None else value}'")


def _rows(change, text: str, shuffles: bool = False):
    """Handler of a step that removes rows: counted by the difference of two table counts."""
    def handler(state: Run, entry: Entry, params: dict, stage: bool) -> None:
        if entry.operation == "remove_outliers":
            if entry.column not in state.df.columns or not is_numeric(state.df.schema[entry.column].dataType):
                entry.result = f"no number column {entry.column}"
                return
        if state.flags or state.rows is None:
            state.settle()
        rows = state.rows
        changed = change(state, entry, params)
        if shuffles and stage:
            changed = scale.stage(changed, "rows")
        state.df = changed
        state.settle()
        entry.affected = rows - state.rows
        _done(entry, text.format(method=params.get("method", "z-score"), n="{n}"))
    return handler


def _drop_na(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    """Rows and gaps are counted by the aggregate that settles the steps before."""
    names = [entry.column] if entry.column in state.df.columns else state.visible()
    state.mark(entry, functools.reduce(Column.__or__, [quote(n).isNull() for n in names]))
    state.settle()
    state.df = filters.drop_missing(state.df, entry.column)
    state.rows -= entry.affected
    state.complete.update(names)
    _done(entry, "{n} rows with gaps removed")


def _drop(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if entry.column not in state.df.columns or entry.column == ROW_ID:
        entry.result = f"no column {entry.column}, or no longer"
        return
    width = len([c for c in state.visible() if c != ROW_ID])
    state.df = columns.drop_column(state.df, entry.column)
    _done(entry, f"{entry.column} removed; {width - 1} of {width} columns stay")


def _split(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if not _known(state, entry):
        return
    delimiter, wanted = params.get("delimiter", ","), params.get("new_columns", [])
    if state.flags:
        state.settle()
    width = columns.split_width(state.df, entry.column, delimiter)
    state.df = columns.split_column(state.df, entry.column, delimiter, wanted, n_parts=width)
    _done(entry, f"{entry.column} -> {', '.join(columns.split_names(entry.column, width, wanted))}")


def _rename(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    new_name = params.get("new_name")
    if entry.column not in state.df.columns or not new_name or ROW_ID in (entry.column, new_name):
        entry.result = f"no column {entry.column}, or no new name"
        return
    state.df = columns.rename(state.df, entry.column, new_name)
    _done(entry, f"{entry.column} is now {new_name}")


def _strip(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if entry.column in (None, "ALL_OBJECT"):
        count = len(columns.text_columns(state.df))
        state.df = columns.strip_whitespace(state.df)
        _done(entry, f"{count} text columns stripped")
    elif _known(state, entry):
        state.df = columns.strip_whitespace(state.df, entry.column)
        _done(entry, f"{entry.column} stripped")


def _extract(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    pattern = params.get("pattern")
    if entry.column not in state.df.columns or not pattern:
        entry.result = f"no column {entry.column}, or no pattern"
        return
    try:
        state.df = columns.extract_pattern(state.df, entry.column, pattern)
    except Exception as error:
        entry.status, entry.result = "failed", f"bad pattern: {str(error).splitlines()[0]}"
        return
    _done(entry, f"{entry.column} reduced to what {pattern} matches")


def _clean(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if _known(state, entry):
        chars, case = params.get("remove_chars", ""), params.get("case")
        state.df = columns.clean_text(state.df, entry.column, chars, case)
        _done(entry, f"{entry.column} without any of '{chars}', case {case}")


def _cast(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if _known(state, entry):
        dtype = params.get("dtype")
        times = dtype == "datetime" and columns.holds_times(state.df, entry.column, state.order_by)
        if times:
            state.df = columns.standardize_time(state.df, entry.column)
            _done(entry, f"{entry.column} holds times of day: HH:MM")
        else:
            state.df = columns.cast_type(state.df, entry.column, dtype, times=False)
            _done(entry, f"{entry.column} is now {dtype}")


def _format(state: Run, entry: Entry, params: dict, stage: bool) -> None:
    if _known(state, entry):
        fmt = params.get("format", "%Y-%m-%d")
        if columns.holds_times(state.df, entry.column, state.order_by):
            state.df = columns.standardize_time(state.df, entry.column)
            _done(entry, f"{entry.column} holds times of day: HH:MM")
        else:
            state.df = columns.format_datetime(state.df, entry.column, fmt, times=False)
            _done(entry, f"{entry.column} written as {fmt}")


# Steps after which a column may have gaps again, or be another column.
MAY_LEAVE_GAPS = {"replace", "cast_type", "format_datetime", "extract_pattern", "clean_text", "split_column", "rename", "drop_column"}

HANDLERS = {
    "replace": _replace,
    "fill_na": _fill,
    "drop_na": _drop_na,
    "drop_duplicates": _rows(lambda s, e, p: dedupe.drop_duplicates(s.df, p.get("subset"), s.order_by),
                             "{n} repeated rows removed", shuffles=True),
    "drop_column": _drop,
    "split_column": _split,
    "cast_type": _cast,
    "rename": _rename,
    "remove_outliers": _rows(lambda s, e, p: filters.remove_outliers(
        s.df, e.column, p.get("method", "z-score"), p.get("threshold", 3)), "{n} outlying rows removed ({method})"),
    "strip_whitespace": _strip,
    "clean_text": _clean,
    "format_datetime": _format,
    "extract_pattern": _extract,
}


def execution_summary(log: DataFrame) -> DataFrame:
    """phase, executed, skipped, failed; a failed step also counts as skipped."""
    return log.groupBy("phase").agg(
        F.count_if(F.col("status") == "executed").alias("executed"),
        F.count_if(F.col("status") != "executed").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"))


def step_counts(log: DataFrame) -> DataFrame:
    return log.select("run_order", "step_id", "operation", "column", "status", "affected")


def step_report(log: DataFrame) -> DataFrame:
    """run_order, phase, line: one readable line per step, in the order of the run."""
    mark = F.when(F.col("status") == "executed", "+").when(F.col("status") == "failed", "!").otherwise("-")
    where = F.coalesce(F.concat(F.lit(" "), "column"), F.lit(""))
    line = F.concat(mark, F.lit(" "), F.coalesce("operation", F.lit("?")), where, F.lit(": "), F.coalesce("result", F.lit("")))
    return log.select("run_order", "phase", line.alias("line")).orderBy("run_order")
