"""Sources, plan intake, the runner, evaluation and ground-truth comparison."""

import json

import pytest
from pyspark.sql import functions as F

from limpid.operators import benchmark, columns, evaluate, filters, impute, ml, scale
from limpid.plans import cleaning, intake, runner
from limpid.sources import csv, sinks


def steps_of(spark, *steps):
    return intake.steps_table(spark, {"steps": [{"step_id": i + 1, "phase": "treat_nulls", **s} for i, s in enumerate(steps)]})


def run(spark, df, *steps):
    clean, log = runner.run(df, steps_of(spark, *steps), ["pos"])
    return clean, log.orderBy("run_order").collect()


# --- CSV ---------------------------------------------------------------------------------------

@pytest.fixture
def write(tmp_path):
    def make(text, name="t.csv", encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path)
    return make


def test_load_csv_types_and_tokens(spark, write):
    folder = write("a, b ,when,flag,code,none\n1,NA,2020-01-02,True,007, None\n2,x,2020-01-03,False,1.5, null \n,'--',nan,,1e3,NULL\n")
    df = csv.load_csv(spark, "t.csv", folder)
    assert columns.data(df).dtypes == [("a", "bigint"), ("b", "string"), ("when", "string"), ("flag", "boolean"), ("code", "double"), ("none", "string")]
    rows = [tuple(r) for r in columns.data(df.orderBy("_rid")).collect()]
    assert rows == [(1, None, "2020-01-02", True, 7.0, " None"), (2, "x", "2020-01-03", False, 1.5, " null "), (None, "'--'", None, None, 1000.0, None)]


def test_csv_row_order_and_schema(spark, write):
    folder = write("k,v\n" + "".join(f"{i},{i * 7 % 13}\n" for i in range(500)))
    df = csv.load_csv(spark, "t.csv", folder, schema=spark.createDataFrame([], "k int, v string").schema)
    assert [r["k"] for r in df.orderBy("_rid").collect()] == list(range(500))
    assert df.dtypes[:2] == [("k", "int"), ("v", "string")]


def test_duplicate_headers(spark, write):
    assert csv.clean_header(["a", "a", " a", "b.c"]) == ["a", "a_1", "a_2", "b.c"]
    assert columns.data(csv.load_csv(spark, "t.csv", write("a,a, a\n1,2,3\n"))).first().asDict() == {"a": 1, "a_1": 2, "a_2": 3}


def test_latin1_fallback(spark, write):
    df = csv.load_csv(spark, "t.csv", write("name\ncafé\n", encoding="latin-1"))
    assert df.first()["name"] == "café"


def test_paths(spark, write, tmp_path):
    folder = write("a\n1\n", "b.csv")
    write("a\n1\n", "a.csv")
    assert csv.first_csv(spark, folder) == "a.csv" and csv.first_csv(spark, str(tmp_path / "none")) is None
    assert csv.resolve(spark, "/nowhere", f"{folder}/b.csv") == f"{folder}/b.csv"
    assert csv.benchmark_path(spark, folder, "b.csv").endswith("b.csv") and csv.benchmark_path(spark, folder, "x.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        csv.load_csv(spark, "missing.csv", folder)


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert csv.validate_schema(df) and csv.validate_schema(df, ["a"]) and not csv.validate_schema(df, ["a", "b"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, ' "q", x '), (1, None), (2, "a\\b")], "pos int, v string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = csv.load_csv(spark, "out", str(tmp_path))
    assert sorted((r["pos"], r["v"]) for r in back.collect()) == [(0, ' "q", x '), (1, None), (2, "a\\b")]


# --- filters and fills -------------------------------------------------------------------------

def test_outliers_drop_nulls_unless_kept(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (100.0,)], "v double")
    assert sorted(r["v"] for r in filters.remove_outliers(df, "v").collect()) == [1, 2, 100]
    assert filters.remove_outliers(df, "v", keep_nulls=True).count() == 4
    assert sorted(r["v"] for r in filters.remove_outliers(df, "v", "iqr").collect()) == [1, 2, 100]
    assert filters.remove_outliers(df, "v", "other").count() == 4
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert filters.remove_outliers(same, "v").count() == 3


def test_mode_takes_the_smallest(column, values):
    assert values(impute.fill_na(column(["b", "a", "b", "a", None]), "v", "mode")) == ["b", "a", "b", "a", "a"]
    assert values(impute.fill_na(column([None, None]), "v", "mode", value="z")) == ["z", "z"]


def test_constants(column, values):
    assert values(impute.fill_na(column(["a", None]), "v", "median")) == ["a", "Unknown"]
    assert values(impute.fill_na(column([1, None], "int"), "v", None, value="7")) == [1, 7]
    with pytest.raises(ValueError):
        impute.fill_na(column([1, None], "int"), "v", "constant")
    with pytest.raises(ValueError):
        impute.fill_na(column([1.0, None], "double"), "v", "ffill")


def test_whole_numbers_take_fractional_fills(column, values):
    assert values(impute.fill_na(column([1, 2, None], "int"), "v", "mean")) == [1, 2, 1.5]


# --- runner ------------------------------------------------------------------------------------

def test_run_logs_every_kind_of_step(spark):
    df = spark.createDataFrame([(0, " ? ", 1.0, "a1"), (1, "x", None, "b2"), (2, "x", 3.0, None), (2, "x", 3.0, None), (3, "N/A", 5.0, "c")],
                               "pos int, s string, v double, t string")
    clean, log = run(
        spark, df, {"operation": "replace", "column": "s", "params": {"old": "?", "new": "NaN"}},
        {"operation": "fill_na", "column": "v", "params": {"strategy": "mean"}},
        {"operation": "fill_na", "column": "s", "params": {"strategy": "mode"}},
        {"operation": "drop_duplicates"}, {"operation": "extract_pattern", "column": "t", "params": {"pattern": "([a-z])([0-9])"}},
        {"operation": "extract_pattern", "column": "t", "params": {"pattern": "[0-9]"}}, {"operation": "drop_na", "column": "t"},
        {"operation": "no_action"}, {"operation": "dance"}, {"operation": "fill_na", "column": "gone", "params": {"strategy": "mean"}},
        {"operation": "cast_type", "column": "t", "params": {"dtype": "complex"}}, {"operation": "rename", "column": "t", "params": {}})
    assert [(r["status"], r["affected"]) for r in log] == [
        ("executed", 1), ("executed", 1), ("executed", 2), ("executed", 1), ("failed", None), ("executed", None), ("executed", 2),
        ("skipped", None), ("skipped", None), ("skipped", None), ("failed", None), ("skipped", None)]
    assert log[0]["result"] == "1 cells: '?' -> NULL" and log[1]["result"] == "1 gaps <- mean 3.00"
    assert log[2]["result"] == "2 gaps <- mode 'x'" and log[6]["result"] == "2 rows with gaps removed"
    assert sorted(tuple(r) for r in clean.collect()) == [(0, "x", 1.0, "1"), (1, "x", 3.0, "2")]
    summary = runner.execution_summary(spark.createDataFrame(log, runner.LOG_SCHEMA)).first()
    assert (summary["executed"], summary["skipped"], summary["failed"]) == (6, 6, 2)


def test_steps_see_the_table_as_it_is(spark):
    """The second mean is taken after the outlier is gone."""
    df = spark.createDataFrame([(i, float(i % 3), None if i == 5 else 1.0) for i in range(40)] + [(99, 1000.0, 500.0)], "pos int, v double, w double")
    clean, log = run(spark, df, {"operation": "remove_outliers", "column": "v"}, {"operation": "fill_na", "column": "w", "params": {"strategy": "mean"}})
    assert log[0]["affected"] == 1 and clean.where("pos = 5").first()["w"] == 1.0


def test_run_equals_the_fold_of_its_steps(spark):
    df = spark.createDataFrame([(i, f" {i % 5} " if i % 4 else None, float(i) if i % 3 else None) for i in range(100)], "pos int, s string, v double")
    clean, _ = run(spark, df, {"operation": "strip_whitespace", "column": "ALL_OBJECT"},
                   {"operation": "fill_na", "column": "v", "params": {"strategy": "interpolate"}},
                   {"operation": "fill_na", "column": "v", "params": {"strategy": "bfill"}},
                   {"operation": "fill_na", "column": "s", "params": {"strategy": "mode", "group_by": "pos"}},
                   {"operation": "cast_type", "column": "s", "params": {"dtype": "int"}})
    want = columns.strip_whitespace(columns.normalize_nulls(df))
    want = impute.fill_na(want, "v", "interpolate", order_by=["pos"])
    want = impute.fill_na(want, "v", "bfill", order_by=["pos"])
    want = columns.cast_type(impute.fill_na(want, "s", "mode", group_by="pos"), "s", "int")
    assert sorted(tuple(r) for r in clean.collect()) == sorted(tuple(r) for r in want.collect())


def test_grouped_fill_then_global(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", None), (2, None, None), (3, "b", None), (4, "a", 1.0), (5, "c", 9.0)], "pos int, g string, v double")
    for strategy, rest in (("mean", 3.0), ("median", 1.0), ("mode", 1.0)):
        clean, log = run(spark, df, {"operation": "fill_na", "column": "v", "params": {"strategy": strategy, "group_by": "g"}})
        assert [r["v"] for r in clean.orderBy("pos").collect()] == [1, 1, rest, rest, 1, 9]
        assert (log[0]["affected"], log[0]["result"]) == (3, f"3 gaps <- {strategy} within g")


# --- intake ------------------------------------------------------------------------------------

def test_parse_replies(spark):
    replies = ['```json {"issues": [{"column": "a", "severity": "high"}]} ```', '[{"column": "b"}]', '{"other": 1}', '{"issues": [', "sorry", None]
    df = spark.createDataFrame(list(enumerate(replies)), "n int, reply string")
    got = {r["n"]: r for r in intake.parse_issues(df).collect()}
    assert [got[i]["parsed"] for i in range(6)] == [True, True, True, False, False, False]
    assert [i["column"] for i in got[0]["issues"] + got[1]["issues"]] == ["a", "b"] and got[2]["issues"] == []
    assert all(got[i]["issues"] is None for i in (3, 4, 5))


def test_parse_steps_keeps_params_as_text(spark):
    reply = '```json\n{"steps": [{"step_id": "1", "operation": "drop_duplicates", "params": {"subset": ["a", "b"]}}]}\n```'
    step = intake.exploded(intake.parse_steps(spark.createDataFrame([(reply,)], "reply string")), "steps").first()
    assert json.loads(step["params"]) == {"subset": ["a", "b"]}
    assert [tuple(r)[:4] for r in intake.steps_table(spark, reply).collect()] == [(1, "other", None, "drop_duplicates")]


def test_lint_warns_about_patterns_that_match_nothing(column, spark):
    plan = steps_of(spark, {"operation": "extract_pattern", "column": "v", "params": {"pattern": "([0-9]4)"}},
                    {"operation": "extract_pattern", "column": "v", "params": {"pattern": "([0-9]{4})"}})
    assert intake.lint(column(["in 1960", "x"]), plan) == ["step 1: its pattern matches no row"]


# --- evaluation --------------------------------------------------------------------------------

def test_quality(spark):
    raw = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 3.0, None)], "k int, v double, gone string")
    clean = spark.createDataFrame([(1, 3.0, "n"), (2, 3.0, None)], "k int, v double, new string")
    q = evaluate.quality(raw, clean).first()
    assert (q["total_missing_raw"], q["total_missing_clean"], q["reduction_pct"]) == (3, 1, 66.67)
    assert (q["duplicates_raw"], q["duplicates_clean"], q["duplicates_removed"], q["retention_pct"]) == (1, 0, 1, 66.67)
    assert (q["completeness_raw"], q["completeness_clean"]) == (66.67, 83.33)
    assert (q["columns_dropped"], q["new_columns"]) == ("gone", "new")
    per_column = {r["column"]: (r["raw_missing"], r["clean_missing"], r["status"]) for r in evaluate.quality_nulls(raw, clean).collect()}
    assert per_column == {"k": (0, 0, "kept"), "v": (2, 0, "kept"), "gone": (1, None, "column_dropped")}


def test_a_table_equals_itself(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i / 3) for i in range(100)], "k int, s string, v double")
    row = benchmark.summary(df, df, ["k"]).first()
    assert [row[c] for c in ("overall_cell_accuracy", "row_exact_match_rate", "null_handling_accuracy", "value_match_accuracy", "schema_f1")] == [100, 100, 100, 100, 1]


def test_comparison_normalises_cells(spark):
    clean = spark.createDataFrame([(0, "1.0", " A "), (1, "2", None), (2, "3", "b")], "k int, n string, s string")
    truth = spark.createDataFrame([(0, 1, "a"), (1, 5, None)], "k int, n int, s string")
    compare = benchmark.Comparison(benchmark.align(clean, truth, ["k"]))
    got = {r["column"]: (r["matches"], r["mismatches"], r["accuracy"]) for r in benchmark.column_accuracy(compare.columns()).collect()}
    assert got == {"k": (2, 0, 100.0), "n": (1, 1, 50.0), "s": (2, 0, 100.0)}
    assert [tuple(r) for r in compare.mismatches().collect()] == [(1, "n", "2", "5")]
    assert benchmark.row_accuracy(compare.row_matches()).first()["row_exact_match_rate"] == 50.0


def test_tables_without_common_columns(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    row = benchmark.summary(a, b, ["a"], ["b"]).first()
    assert (row["schema_f1"], row["rows_compared"], row["summary"]) == (0.0, 0, "The tables share no column.")


@pytest.mark.parametrize("kind, make, task", [
    ("string", lambda i: f"c{i % 3}", "classification"), ("string", lambda i: f"id{i}", "skip"),
    ("double", lambda i: i * 1.5, "regression"), ("int", lambda i: i % 20, "classification"), ("string", lambda i: f"c{i % 90}", "classification")])
def test_task_type(spark, kind, make, task):
    df = spark.createDataFrame([(make(i),) for i in range(200)], f"t {kind}")
    assert ml.task_type(df, "t").first()["task_type"] == task


def test_codes_are_alphabetical(spark, monkeypatch):
    words = [f"w{i * 37 % 101:03d}" for i in range(300)]
    df = spark.createDataFrame([(i, w if i % 10 else None) for i, w in enumerate(words)], "pos int, v string")
    want = {w: n for n, w in enumerate(sorted({w for i, w in enumerate(words) if i % 10}))}
    got = [r["v"] for r in ml.alphabetical_codes(df, "v").orderBy("pos").collect()]
    assert got == [want[w] if i % 10 else None for i, w in enumerate(words)]


@pytest.mark.parametrize("group_rows", [50, 2_000_000])
def test_all_text_columns_are_coded_in_one_join(spark, monkeypatch, group_rows):
    rows = [(i, *[None if (i + k) % 11 == 0 else "hot" if i % 3 == 0 else f"v{(i * (k + 7)) % 61:02d}" for k in range(6)], None) for i in range(400)]
    names = [f"c{k}" for k in range(6)] + ["none"]
    df = spark.createDataFrame(rows, "pos int, " + ", ".join(f"{n} string" for n in names))
    places = [{v: i for i, v in enumerate(sorted({r[k + 1] for r in rows} - {None}))} for k in range(7)]
    want = [(r[0], *[None if v is None else float(places[k][v]) for k, v in enumerate(r[1:])]) for r in rows]
    monkeypatch.setattr(scale, "GROUP_ROWS", group_rows)

    def exchanges(columns):
        out = ml.with_codes(df, columns)
        assert out.columns == df.columns
        return out, out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert [tuple(r) for r in exchanges(names)[0].orderBy("pos").collect()] == want and exchanges(names)[1] == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for broadcast_rows in (1, 130):
            monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
            out, many = exchanges(names)
            assert [tuple(r) for r in out.orderBy("pos").collect()] == want
            assert many == exchanges(names[3:])[1] > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_model_learns_what_cleaning_adds(spark):
    clean = spark.range(600).select(F.col("id"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 7 < 3, "lo").otherwise("hi").alias("t"),
                                    F.lit("2020-01-01").alias("day"), F.lit(None).cast("double").alias("empty"))
    raw = clean.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x")))
    got = {r["metric"]: r for r in ml.evaluate(raw, clean, "t", ["id"], max_depth=4).collect()}
    assert set(got) == {"accuracy", "f1"} and got["accuracy"]["clean"] > 0.99 > got["accuracy"]["raw"]
    assert set(ml.features(clean, "t", "classification", ["id"]).columns) == {"__id", "id", "x", "label"}
    assert ml.evaluate(raw, clean, "nope", ["id"]).first()["reason"] == "no column nope"


def test_a_forest_is_trained_by_many_tasks(spark, monkeypatch):
    """A table of few bytes in one file: the tasks follow from its rows, and every row is in one of them."""
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    seen, real = [], ml.split
    monkeypatch.setattr(ml, "split", lambda table: seen.append(table) or real(table))
    df = spark.range(2000).selectExpr("id", "id % 7 as x", "cast(id % 3 as string) as t").coalesce(1)
    ml.score(df, "t", "classification", ["id"], max_depth=2)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 2000 and max(sizes) < 200


# --- everything --------------------------------------------------------------------------------

def test_clean_csv_end_to_end(spark, tmp_path):
    lines = ["city, temp ,code,note"] + [f"{'?' if i % 9 == 0 else 'Oslo' if i % 2 else 'Rome'},{'' if i % 5 == 0 else i},{i % 4}, n{i % 2} - m " for i in range(120)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "truth").mkdir()
    for folder in ("raw", "truth"):
        (tmp_path / folder / "weather.csv").write_text("\n".join(lines + lines[1:4]) + "\n")
    copies = {line.replace(" ", "") for line in lines[1:]}
    result = cleaning.clean_csv(spark, "weather.csv", str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "truth"))
    rows = columns.data(result.clean).collect()
    # Rows that differ only in a filled gap become copies and go too.
    assert len(rows) == len(set(rows)) <= 120 and result.clean.where("city is null or temp is null").count() == 0
    assert result.benchmark.first()["rows_compared"] == len(rows) and result.quality.first()["duplicates_raw"] == 123 - len(copies)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {f"{n}_weather" for n in ("profile", "issues", "plan", "execution", "clean", "evaluation", "steps", "benchmark")}
    assert "note_part1" in columns.data(csv.load_csv(spark, "clean_weather", str(tmp_path / "out"))).columns


def test_alignment_by_key_needs_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        benchmark.align(df, df, ["v"], key=["k"])


# --- CSV without loss --------------------------------------------------------------------------

def test_quoted_line_breaks(spark, write):
    df = csv.load_csv(spark, "t.csv", write('a,b\n1,"x\ny ""q"", z"\n2,\n3,"\n"\n'))
    assert columns.data(df).dtypes == [("a", "bigint"), ("b", "string")]
    assert [tuple(r)[:2] for r in df.orderBy("_rid").collect()] == [(1, 'x\ny "q", z'), (2, None), (3, "\n")]


def test_too_many_and_too_few_fields(spark, write):
    with pytest.raises(csv.BadRecords, match="EXTRA"):
        csv.load_csv(spark, "t.csv", write('a,b\n1,x,EXTRA\n2,"y,z"\n'))
    kept = csv.load_csv(spark, "t.csv", write('a,b\n1,x,EXTRA\n2,"y,z"\n'), bad_records="keep")
    assert sorted(tuple(r)[:2] for r in kept.collect()) == [(1, "x"), (2, "y,z")]
    few = csv.load_csv(spark, "t.csv", write('a,b,c\n1\n2,"y,z",w\n'))
    assert sorted(tuple(r)[:3] for r in few.collect()) == [(1, None, None), (2, "y,z", "w")]


def test_files_of_a_glob_need_one_header(spark, write):
    write("a,b\n1,2\n", "p1.csv")
    folder = write("a,b\n3,4\n", "p2.csv")
    assert sorted(tuple(r)[:2] for r in csv.load_csv(spark, "p*.csv", folder).collect()) == [(1, 2), (3, 4)]
    write("b,a\n3,4\n", "p3.csv")
    with pytest.raises(ValueError, match="different headers"):
        csv.load_csv(spark, "p*.csv", folder)


def test_csv_keeps_order_and_nested_values(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "array(id, 1) as pair", "struct(-id as n) as _rid").repartition(5)
    sinks.write_csv(df, str(tmp_path / "out"))
    back = csv.load_csv(spark, "out", str(tmp_path)).orderBy("_rid").collect()
    assert [r["id"] for r in back] == list(range(299, -1, -1)) and back[0]["pair"] == "[299,1]"


# --- nothing is lost when a part fails ---------------------------------------------------------

def orders(spark):
    return spark.createDataFrame([(f"k{i:03d}", float(i) if i % 3 else None, f"{i % 2}-{i % 5}", "ab"[i % 2]) for i in range(90)], "k string, v double, p string, t string")


def test_a_plan_may_remove_the_order(spark):
    df = orders(spark).repartition(4)
    steps = intake.steps_table(spark, [
        {"step_id": 1, "phase": "treat_nulls", "column": "k", "operation": "drop_column"},
        {"step_id": 2, "phase": "treat_nulls", "column": "v", "operation": "fill_na", "params": {"strategy": "interpolate"}},
        {"step_id": 3, "phase": "treat_nulls", "column": "_rid", "operation": "drop_column"}])
    truth = orders(spark).drop("v").withColumn("v", F.substring("k", 2, 3).cast("double"))
    result = cleaning.clean(df, ["k"], steps=steps, target="t", truth=truth)
    assert "k" not in result.clean.columns and "_rid" not in result.clean.columns and result.errors == ()
    values = sorted((r["v"] for r in result.clean.collect() if r["v"] is not None))
    assert values == [float(i) for i in range(1, 90)]
    assert {r["column"]: r["matches"] for r in result.per_column.collect()} == {"p": 90, "t": 90, "v": 89}
    assert result.model.count() == 2 and result.mismatches.where("column = 'v'").count() == 1
    assert {r["section"] for r in cleaning.report(result).collect()} >= {"benchmark_columns", "benchmark_mismatches", "benchmark_schema"}


def test_a_failing_comparison_keeps_the_clean_table(spark):
    df = orders(spark)
    result = cleaning.clean(df, ["k"], target="t", truth=df.drop("k"), truth_order=["k"])
    assert result.clean.count() > 0 and result.benchmark is None and [part for part, _ in result.errors] == ["benchmark_accuracy"]
    assert "errors" in {r["section"] for r in cleaning.report(result).collect()}


def test_a_lazy_failure_is_blamed_on_its_step(spark, monkeypatch):
    def explode(state, entry, params, stage):
        state.df = state.df.withColumn("v", F.when(F.col("v") > 50, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("v")))
        entry.status, entry.result = "executed", "lazily"

    monkeypatch.setitem(runner.HANDLERS, "rename", explode)
    steps = intake.steps_table(spark, [
        {"step_id": 1, "phase": "treat_nulls", "column": "p", "operation": "replace", "params": {"old": "1-1", "new": "x"}},
        {"step_id": 2, "phase": "treat_nulls", "column": "v", "operation": "rename"},
        {"step_id": 3, "phase": "treat_nulls", "column": "v", "operation": "fill_na", "params": {"strategy": "median"}},
        {"step_id": 4, "phase": "treat_nulls", "column": None, "operation": "drop_duplicates"}])
    clean, log = runner.run(orders(spark), steps, ["k"])
    got = log.orderBy("run_order").collect()
    assert [(r["step_id"], r["status"]) for r in got] == [(1, "executed"), (2, "failed"), (3, "executed"), (4, "executed")]
    assert "boom" in got[1]["result"] and got[2]["affected"] == 30 and clean.count() == 90
    lines = [r["line"] for r in runner.step_report(log).collect()]
    assert lines[1].startswith("! rename v: ") and lines[2] == "+ fill_na v: 30 gaps <- median 45.00"


def test_comparison_by_key_counts_lonely_rows(spark):
    clean = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    truth = spark.createDataFrame([(1, "a"), (3, "b"), (4, None), (None, "c")], "k int, v string")
    compare = benchmark.Comparison(benchmark.align(clean, truth, ["k"], key=["k"]))
    assert tuple(compare.sides().first()) == (6, 1, 2, 3)
    assert tuple(compare.row_matches().first()) == (6, 1)
    assert {r["column"]: (r["matches"], r["total"], r["null_matches"]) for r in compare.columns().collect()} == {"k": (1, 6, 1), "v": (1, 6, 1)}


def test_replace_with_json_numbers(spark):
    df = spark.createDataFrame([(-999, -999.0, 9007199254740993), (5, 1.5, 9007199254740992)], "i int, d double, b bigint")
    for name, old in (("i", -999.0), ("i", "-999"), ("d", -999)):
        assert columns.replace(df, name, old, "NaN").where(f"{name} is null").count() == 1
    assert columns.replace(df, "b", 9007199254740993, 1.0).orderBy("b").first()["b"] == 1
    assert columns.replace(df, "b", 9007199254740993, "NaN").where("b is null").count() == 1


def test_a_cleaned_table_is_computed_once(spark):
    """Its readers do not replay the lazy steps."""
    df = spark.range(50).selectExpr("id", "concat(id % 28 + 1, ' May 1990') as d")
    steps = spark.createDataFrame([(1, "standardize", "d", "format_datetime", "{}", "r")], "step_id int, phase string, column string, operation string, params string, reason string")
    clean, _ = runner.run(df, steps, ["id"])
    assert clean.inputFiles() and all("/cleaned-" in f for f in clean.inputFiles())
    assert clean.where("d = '1990-05-03'").count() == 2
    result = cleaning.clean(df, ["id"], steps=steps, truth=df)
    assert all("/cleaned-" in f for f in result.clean.inputFiles()) and result.errors == ()


def test_rare_mismatches_behind_the_first_rows(spark):
    truth = spark.range(5000).selectExpr("id", "id as a", "'x' as b", "id as c")
    clean = truth.selectExpr("id", "a + 1 as a", "case when id in (1, 4000, 4500, 4900) then 'y' else b end as b", "c")
    compare = benchmark.Comparison(scale.stage(benchmark.align(clean, truth, ["id"])))
    got = sorted((r["column"], r["pos"], r["cleaned_value"], r["benchmark_value"]) for r in compare.mismatches().collect())
    assert got == [("a", p, str(p + 1), str(p)) for p in range(3)] + [("b", p, "y", "x") for p in (1, 4000, 4500)]
    assert compare.columns() is compare.columns()
