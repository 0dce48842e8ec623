"""Profile pieces and the whole profile against hand-computed answers and pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.operators import profile, snapshot
from limpid.plans import issues, planner


@pytest.fixture(scope="module")
def dirty(spark):
    rows = []
    for i in range(200):
        rows.append((i, f"SKU-{i}", None if i % 4 == 0 else float(i % 7), " ? " if i % 10 == 1 else ("NA" if i % 10 == 2 else "red"),
                     f"a{i % 3} - b", ["low", "mid", "high"][i % 3], i % 3, "same", None if i else "x", f"2020-01-{i % 28 + 1:02d}#{i}"))
    return spark.createDataFrame(rows, "id int, sku string, v double, `the.color` string, pair string, level string, level_id int,"
                                       " fixed string, empty string, made_date string")


@pytest.fixture(scope="module")
def profiled(dirty):
    columns, table = profile.profile(dirty, ["id"])
    return columns, table, {r["column"]: r for r in columns.collect()}


def test_counts(profiled):
    rows = profiled[2]
    assert (rows["v"]["null_count"], rows["v"]["missing_ratio"], rows["v"]["unique_count"]) == (50, 0.25, 7)
    color = rows["the.color"]
    assert [tuple(p) for p in color["detected_placeholders"]] == [("?", 20), ("NA", 20)]
    assert (color["null_count"], color["placeholder_count"], color["missing_count"]) == (0, 40, 40)
    assert [tuple(v) for v in color["top_values"]] == [("red", 160), (" ? ", 20), ("NA", 20)]
    assert color["is_categorical"] and not rows["sku"]["is_categorical"]
    assert len(rows["sku"]["sample_values"]) == 5 and len(rows["fixed"]["sample_values"]) == 1


def test_numeric_facts_match_pandas(dirty, profiled):
    row, v = profiled[2]["v"], dirty.toPandas().v
    got = [row[k] for k in ("mean", "std", "min", "max", "median", "skewness", "q1", "q3")]
    want = [v.mean(), v.std(), v.min(), v.max(), v.median(), v.skew(), v.quantile(0.25), v.quantile(0.75)]
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert (row["zeros_count"], row["potential_outliers"], row["iqr_outliers"]) == ((v == 0).sum(), 0, 0)


def test_flags(profiled):
    rows = profiled[2]
    assert rows["fixed"]["drop_reasons"] == ["constant_value"]
    assert rows["empty"]["drop_reasons"] == ["constant_value", "almost_all_missing"]
    assert rows["sku"]["drop_reasons"] == ["likely_unique_id"]
    assert rows["made_date"]["drop_reasons"] == []
    assert rows["level_id"]["redundant_with"] == ["level"]
    assert (rows["pair"]["suggested_delimiter"], rows["pair"]["occurrence_ratio"]) == (" - ", 1.0)
    assert [c for c in rows if rows[c]["splittable"]] == ["pair"]


def test_pieces_agree_with_the_whole(dirty, profiled):
    rows = profiled[2]
    freq = profile.value_freq(dirty)
    for r in profile.column_flags(dirty, freq).collect():
        whole = rows[r["column"]]
        for k in ("unique_count", "is_categorical", "high_duplication", "duplication_ratio", "drop_reasons"):
            assert r[k] == whole[k], (r["column"], k)
    for r in profile.numeric_stats(dirty).collect():
        for k in ("mean", "std", "min", "max", "skewness", "zeros_count"):
            assert r[k] == pytest.approx(rows[r["column"]][k], rel=1e-9)
    for r in profile.outlier_counts(dirty).collect():
        assert (r["potential_outliers"], r["iqr_outliers"]) == tuple(rows[r["column"]][k] for k in ("potential_outliers", "iqr_outliers"))


@pytest.mark.parametrize("partitions", [1, 17])
def test_profile_does_not_depend_on_partitioning(dirty, profiled, partitions):
    again = profile.profile_columns(dirty.repartition(partitions, "sku"), ["id"]).collect()
    for a, b in zip(sorted(again, key=lambda r: r["ordinal"]), sorted(profiled[2].values(), key=lambda r: r["ordinal"])):
        for k in profile.PROFILE_FIELDS:
            assert a[k] == (pytest.approx(b[k], rel=1e-9) if isinstance(b[k], float) else b[k])


def test_health(profiled):
    table = profiled[1].first()
    assert (table["rows"], table["columns"], table["total_cells"]) == (200, 10, 2000)
    assert table["total_missing_cells"] == 50 + 40 + 199 and table["duplicate_rows"] == 0
    assert (table["droppable_columns_count"], table["splittable_columns_count"]) == (4, 1)
    assert table["completeness_score"] == round(1 - 289 / 2000, 4)


@pytest.mark.parametrize("values, skewness", [([1, 2, 2, 3, 10], 2.0286991), ([1, 1, 1], 0.0), ([1, 2], None), ([], None)])
def test_skewness(spark, values, skewness):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    whole = profile.profile_columns(df.withColumn("k", F.monotonically_increasing_id()), ["k"]).where("column = 'v'").first()
    assert whole["skewness"] == (pytest.approx(skewness) if skewness is not None else None)
    if values:
        assert profile.numeric_stats(df).first()["skewness"] == whole["skewness"] or skewness


def test_single_value_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, None)], "k int, one double, nothing string")
    rows = {r["column"]: r for r in profile.profile_columns(df, ["k"]).collect()}
    assert (rows["one"]["mean"], rows["one"]["std"], rows["one"]["median"], rows["one"]["potential_outliers"]) == (5.0, None, 5.0, 0)
    assert (rows["nothing"]["null_count"], rows["nothing"]["unique_count"], rows["nothing"]["top_values"]) == (2, 0, [])


def test_first_values_reach_past_sparse_columns(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 1000 == 999, F.lit("a,b")).alias("rare"), F.lit("x").alias("common"))
    got = profile.first_values(df, ["rare", "common"], ["id"], 100)
    assert {r["ordinal"]: r["n"] for r in got.groupBy("ordinal").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 100}


def test_no_copy_of_the_table_per_column(dirty):
    plan = profile.distinct_counts(profile.value_freq(dirty))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "BatchEvalPython" not in plan


def test_redundant_pairs_need_one_code_per_label(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3), (None, 9, 9)], "kind string, kind_num int, kind_id int")
    assert [tuple(r) for r in profile.redundant_pairs(df).collect()] == [("kind_num", "kind")]


def test_snapshot(dirty, profiled):
    text = snapshot.snapshot_text(snapshot.snapshot_lines(dirty, profiled[0], profiled[1], ["id"], "level")).first()[0]
    lines = text.split("\n")
    assert lines[:4] == ["Table", "  200 rows, 10 columns", "  target: level", "  its values: 'low' 67, 'mid' 67, 'high' 66"]
    assert "  the.color: object, 3 distinct, 40 gaps; often 'red' 160, ' ? ' 20, 'NA' 20; hidden gaps '?' 20, 'NA' 20" in lines
    assert "  level_id: redundant_encoding_of_level, says the same as level" in lines
    assert "  pair: by ' - ' in 100% of the cells" in lines


# --- rules -------------------------------------------------------------------------------------

def test_issues(profiled):
    found = {(r["column"], r["issue_type"]): r for r in issues.all_issues(profiled[0], profiled[1]).collect()}
    assert found["v", "null_treatment"]["recommended_action"].startswith("fill_na, mean: skew ")
    assert found["empty", "null_treatment"]["severity"] == "high"
    assert found["the.color", "placeholder"]["description"].startswith("'")
    assert found["level_id", "drop_column"]["description"] == "profile says: redundant_encoding_of_level"
    assert ("ALL", "duplicate") not in found
    summary = {r["category"]: r["issues"] for r in issues.issue_summary(issues.all_issues(profiled[0], profiled[1])).collect()}
    assert summary == {"treat_nulls": 4, "drop_columns": 5, "split_columns": 1}


def test_plan(profiled):
    steps = planner.plan(profiled[0], profiled[1]).orderBy("step_id").collect()
    assert [s["step_id"] for s in steps] == list(range(1, len(steps) + 1))
    assert [(s["operation"], s["column"]) for s in steps] == [
        ("replace", "the.color"), ("replace", "the.color"), ("fill_na", "v"), ("fill_na", "the.color"), ("drop_na", "empty"),
        ("no_action", None), ("fill_na", "v"), ("drop_column", "sku"), ("drop_column", "fixed"), ("drop_column", "empty"),
        ("drop_column", "level_id"), ("split_column", "pair"), ("strip_whitespace", "ALL_OBJECT")]
    checked = planner.validate(planner.plan(profiled[0], profiled[1])).orderBy("step_id").collect()
    assert [(s["step_id"], s["phase"], s["operation"]) for s in checked[len(steps):]] == [(len(steps) + 1, "standardize", "no_action")]


def test_execution_order(spark):
    rows = [(5, "standardize"), (None, "treat_nulls"), (2, "treat_nulls"), (1, "nonsense"), (3, "split_columns")]
    steps = spark.createDataFrame([(i, p, None, "no_action", "{}", "") for i, p in rows], planner.STEPS_SCHEMA)
    got = planner.execution_order(steps).orderBy("run_order").collect()
    assert [(r["step_id"], r["phase"]) for r in got] == [
        (2, "treat_nulls"), (None, "treat_nulls"), (3, "split_columns"), (5, "standardize"), (1, "nonsense")]


def test_clean_table_gets_fillers(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(30)], "k int, v double")
    columns, table = profile.profile(df, ["k"])
    steps = planner.plan(columns, table).collect()
    assert sorted(s["phase"] for s in steps if s["operation"] == "no_action") == [
        "drop_columns", "populate_missing", "split_columns", "treat_duplicates", "treat_nulls"]




def test_long_text_is_counted_by_digest(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(i, long + "abc"[i % 3], "s") for i in range(30)] + [(30, None, None)], "id int, t string, s string")
    keys = [r["value"] for r in profile.value_freq(df, ["t"], short=True).collect()]
    assert len(keys) == 3 and all(profile.is_short_key(k) and len(k) < 200 for k in keys)
    row = profile.profile(df, ["id"])[0].where("column = 't'").first()
    assert row["unique_count"] == 3 and sorted(v["value"][-1] for v in row["top_values"]) == ["a", "b", "c"]
    assert all(v["value"].startswith(long) and v["count"] == 10 for v in row["top_values"]) and len(row["sample_values"][0]) == 5001


def test_sparse_columns_share_one_scan(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(3000).select("id", *[F.when(F.col("id") == 2000 + i, F.lit(n)).alias(n) for i, n in enumerate(names)])
    found = profile.first_values(df, names, ["id"], 20)
    assert sorted(r["value"] for r in found.collect()) == sorted(names)
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") <= 2


def test_samples_sort_only_marks_that_can_be_first(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id % 700 as string) as s", "cast(null as string) as n")
    freq = profile.value_freq(df)
    want = sorted(tuple(r) for r in profile.sample_values(df, freq).collect())
    unique = {r["ordinal"]: r["unique_count"] for r in profile.distinct_counts(freq).collect()}
    for pool in (1000, 20, 1):  # with too few the columns are sampled again in full
        monkeypatch.setattr(profile, "SAMPLE_POOL", pool)
        assert sorted(tuple(r) for r in profile.sample_values(df, freq, unique=unique).collect()) == want
