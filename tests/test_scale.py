"""Ordered, grouped and quantile operators with their scale paths forced, against brute force in pandas."""

import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid.operators import dedupe, impute, ordered, scale


@pytest.fixture(scope="module")
def frame():
    """5000 rows: one group holds 40 %, long gaps cover whole buckets, some keys are null."""
    rng = np.random.default_rng(7)
    n = 5000
    group = np.where(rng.random(n) < 0.4, "hot", np.char.add("g", rng.integers(0, 300, n).astype(str)))
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": group, "v": rng.integers(0, 50, n).astype(float),
                        "s": rng.choice(list("abc"), n)})
    pdf.loc[rng.random(n) < 0.4, "v"] = np.nan
    pdf.loc[(pdf.id > 1000) & (pdf.id < 2500), "v"] = np.nan
    pdf.loc[(pdf.id < 7) | (pdf.id > 4980), "v"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "s"] = None
    pdf.loc[rng.random(n) < 0.05, "g"] = None
    return pdf


@pytest.fixture
def table(spark, frame):
    records = [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
    return spark.createDataFrame(records, "id long, g string, v double, s string")


def by_id(df, name="v"):
    return [r[name] for r in df.select("id", name).orderBy("id").collect()]


def listed(series):
    return [None if pd.isna(x) else x for x in series]


@pytest.mark.parametrize("buckets", [1, 2, 17, 64])
@pytest.mark.parametrize("forward", [True, False])
def test_carry(table, frame, buckets, forward):
    want = frame.sort_values("id").v
    want = want.ffill() if forward else want.bfill()
    assert by_id(ordered.carry(table, "v", ["id"], forward=forward, buckets=buckets)) == listed(want)


@pytest.mark.parametrize("buckets", [1, 17])
def test_carry_text(table, frame, buckets):
    assert by_id(ordered.carry(table, "s", ["id"], buckets=buckets), "s") == listed(frame.sort_values("id").s.ffill())


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_composite_order_key(table, frame, partitions):
    df = table.repartition(partitions).withColumn("day", (F.col("id") / 700).cast("int")).withColumn("key", F.struct("day", "id"))
    want = listed(frame.sort_values("id").v.ffill())
    assert by_id(ordered.carry(df, "v", ["day", "id"], buckets=9)) == want
    assert by_id(ordered.carry(df, "v", ["key"], buckets=9)) == want


@pytest.mark.parametrize("group_rows", [100, 10_000])
@pytest.mark.parametrize("forward", [True, False])
def test_grouped_carry(table, frame, group_rows, forward):
    p = frame.sort_values("id")
    filled = p.groupby("g").v.transform(lambda x: x.ffill() if forward else x.bfill())
    want = filled.where(p.g.notna(), p.v)
    assert by_id(ordered.carry(table, "v", ["id"], "g", forward=forward, group_rows=group_rows)) == listed(want)


def test_hot_pieces_too_many_to_broadcast(table, frame, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    p = frame.sort_values("id")
    want = p.groupby("g").v.transform(lambda x: x.ffill()).where(p.g.notna(), p.v)
    assert by_id(ordered.carry(table, "v", ["id"], "g", group_rows=100)) == listed(want)


@pytest.mark.parametrize("buckets", [1, 2, 17, 64])
def test_interpolate(table, frame, buckets):
    want = frame.sort_values("id").v.reset_index(drop=True).interpolate(method="linear")
    got = by_id(ordered.interpolate(table, "v", ["id"], buckets=buckets))
    assert [g is None for g in got] == want.isna().tolist()
    np.testing.assert_allclose(pd.Series(got, dtype=float), want)


@pytest.mark.parametrize("values, want", [
    ([None, 1.0, None, None, 4.0, None], [None, 1, 2, 3, 4, 4]),
    ([1.0, None, None, 4.0, None, 10.0, None], [1, 2, 3, 4, 7, 10, 10]),
    ([None, None], [None, None])])
def test_interpolate_fixture(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    assert by_id(ordered.interpolate(df, "v", ["id"])) == want


def test_positions_are_dense(table):
    df = scale.with_position(table.where("id % 3 <> 1"), ["id"], "pos", scale.range_buckets(table, ["id"], buckets=13))
    got = [r["pos"] for r in df.orderBy("id").select("pos").collect()]
    assert got == list(range(len(got)))


def test_buckets_are_even(table):
    ranges = scale.range_buckets(table, ["id"], buckets=10)
    sizes = [r["n"] for r in table.groupBy(ranges.bucket().alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 5000 / 10


# --- groups ------------------------------------------------------------------------------------

def test_group_sizes_finds_hot_groups(table, frame):
    facts = scale.group_sizes(table, F.col("g"), 100)
    counts = frame.g.value_counts()
    assert (facts.rows, facts.count) == (frame.g.notna().sum(), frame.g.nunique())
    hashes = {r["h"]: r["g"] for r in table.selectExpr("g", "xxhash64(g) as h").distinct().collect()}
    assert {hashes[h]: n for h, n in facts.hot.items()} == counts[counts > 100].to_dict()


@pytest.mark.parametrize("broadcast_rows, group_rows", [(0, 100), (0, 10_000), (1000, 100)])
@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_grouped_fill(table, frame, monkeypatch, broadcast_rows, group_rows, strategy):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(scale, "QUANTILE_VALUES", 200)
    statistic = {"mean": lambda x: x.mean(), "median": lambda x: x.median(),
                 "mode": lambda x: x.mode()[0] if x.notna().any() else np.nan}[strategy]
    p = frame.sort_values("id")
    filled = p.v.fillna(p.groupby("g").v.transform(statistic))
    got = by_id(impute.fill_group(table, "v", "g", strategy, group_rows=group_rows))
    np.testing.assert_allclose(pd.Series(got, dtype=float), filled)


def test_grouped_mean_keeps_rows_without_group(spark):
    rows = [(0, "x", 1.0), (1, "x", None), (2, None, 7.0), (3, "y", None)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    assert by_id(impute.fill_group(df, "v", "g", "mean")) == [1, 1, 7, None]
    assert by_id(impute.fill_na(df, "v", "mean", group_by="g")) == [1, 1, 7, 3]


def test_no_single_partition_over_rows(table):
    """Only the one-row-per-bucket summary may go to one task."""
    for df in (ordered.carry(table, "v", ["id"], buckets=8), ordered.interpolate(table, "v", ["id"], buckets=8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for above, line in zip(plan.split("\n"), plan.split("\n")[1:]):
            if "SinglePartition" in above:
                assert "HashAggregate" in line or "SortAggregate" in line or "Project" in line, plan
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


# --- quantiles ---------------------------------------------------------------------------------

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("max_values", [10, 200, 10_000])
def test_exact_quantiles(spark, max_values):
    rng = np.random.default_rng(3)
    parts = {"normal": rng.normal(size=4000), "few": rng.integers(0, 5, 3000).astype(float),
             "tail": np.exp(rng.normal(size=2500) * 6), "constant": np.full(900, 4.0), "small": rng.random(5),
             "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["__group"]: r for r in scale.exact_quantiles(df, F.col("g"), F.col("v"), PROBS, max_values).collect()}
    assert set(got) == set(parts)
    for g, vs in parts.items():
        assert got[g]["n"] == len(vs)
        np.testing.assert_allclose(got[g]["q"], np.quantile(vs, PROBS), rtol=1e-12)


def test_quantile_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert scale.exact_quantiles_of(df, "v", [0.5]) is None


# --- duplicates --------------------------------------------------------------------------------

def test_duplicates_count_nulls_as_equal(spark):
    row = dedupe.duplicate_count(spark.createDataFrame([(None, 1)] * 3 + [("a", 1)], "a string, b int")).first()
    assert (row["rows"], row["total_duplicates"], row["duplicate_ratio"]) == (4, 2, 0.5)


@pytest.mark.parametrize("partitions", [1, 5])
def test_subset_keeps_the_first_row(table, frame, partitions):
    df = dedupe.drop_duplicates(table.repartition(partitions), ["g", "s"], ["id"])
    want = frame.sort_values("id").drop_duplicates(["g", "s"]).id.tolist()
    assert sorted(r["id"] for r in df.collect()) == sorted(want)
    again = dedupe.drop_duplicates(df, ["g", "s"], ["id"])
    assert again.count() == df.count()


def test_full_duplicates_ignore_the_row_id(spark):
    rows = [("a", {"n": 3}), ("a", {"n": 1}), ("b", {"n": 2})]
    df = spark.createDataFrame(rows, "x string, _rid struct<n:int>")
    assert sorted((r["x"], r["_rid"]["n"]) for r in dedupe.drop_duplicates(df).collect()) == [("a", 1), ("b", 2)]
    assert dedupe.duplicate_count(df).first()["total_duplicates"] == 1


# --- staging -----------------------------------------------------------------------------------

def test_stage_uses_the_shared_folder_and_can_be_released(spark, table):
    staged = scale.stage(table)
    assert staged.schema.simpleString() == table.schema.simpleString() and staged.count() == 5000
    folder = scale.shared_dir(spark).replace("file:", "")
    assert all(folder in f for f in staged.inputFiles())


def test_release_removes_only_this_application(spark, table):
    root = pathlib.Path(scale.shared_dir(spark).replace("file:", ""))
    other = root / "limpid-other"
    other.mkdir(exist_ok=True)
    scale.stage(table)
    assert (root / f"limpid-{spark.sparkContext.applicationId}").exists()
    scale.release(spark)
    assert not (root / f"limpid-{spark.sparkContext.applicationId}").exists() and other.exists()


@pytest.mark.parametrize("group_rows", [10, 1000, None])
def test_groups_that_share_order_values(spark, group_rows):
    """A panel: every group has the same days."""
    rows = [(f"g{g}", day, float(day) if (day + g) % 4 == 0 else None) for g in range(5) for day in range(100)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(7)
    got = {(r["g"], r["day"]): r["v"] for r in ordered.carry(df, "v", ["day"], "g", group_rows=group_rows).collect()}
    want = {}
    for g in range(5):
        last = None
        for day in range(100):
            last = float(day) if (day + g) % 4 == 0 else last
            want[f"g{g}", day] = last
    assert got == want


@pytest.mark.parametrize("buckets", [1, 9])
def test_ties_and_null_keys_have_one_order(spark, buckets, monkeypatch):
    monkeypatch.setattr(scale, "SMALL_ROWS", 0)
    rows = [(None if i % 3 == 0 else i % 5, i, float(i) if i % 4 else None) for i in range(600)]
    tables = [spark.createDataFrame(rows, "k int, i int, v double").repartition(n) for n in (1, 6)]
    a, b = (sorted((r["i"], r["v"]) for r in ordered.carry(t, "v", ["k"], buckets=buckets).collect() if r["v"] is not None) for t in tables)
    assert a == b and len(a) >= 599
    ranges = scale.range_buckets(scale.with_tie(tables[0]), ["k", scale.TIE], buckets=20)
    sizes = scale.with_tie(tables[0]).groupBy(ranges.bucket().alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 120


def test_bounds_of_long_text_are_short(spark):
    df = spark.range(500).selectExpr("concat(md5(cast(id as string)), repeat('x', 5000)) as t")
    ranges = scale.range_buckets(df, ["t"], buckets=8)
    assert ranges.count > 4 and all(len(b) <= scale.BOUND_TEXT for b in ranges.bounds)


def test_long_text_is_not_broadcast(table, frame, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    joined = impute.fill_group(table, "s", "g", "mode")
    assert "__salt" in joined._jdf.queryExecution().executedPlan().toString()
    modes = frame.groupby("g").s.agg(lambda x: x.mode()[0] if x.notna().any() else None)
    p = frame.sort_values("id")
    assert by_id(joined, "s") == listed(p.s.fillna(p.g.map(modes)))


# --- bracketed quantiles ---------------------------------------------------------------------------

def expected_quantiles(values, probs):
    import numpy as np
    return [float(np.quantile(np.sort(np.array(values)), p)) for p in probs]


@pytest.mark.parametrize("max_values", [None, 5])
def test_bracketed_quantiles_are_exact(spark, max_values):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    shapes = {0: "id * 7919 % 100003 / 8", 1: "cast(id % 5 as double)", 2: "-pow(id, 3)", 3: "case when id < 3 then id end", 4: "3.5"}
    df = spark.range(0, 60_000, 1, 7).select("id", F.inline(F.array(*[F.struct(F.lit(g).alias("g"), F.expr(v).cast("double").alias("v")) for g, v in shapes.items()])))
    got = scale.fitted_quantiles(df, F.col("g"), F.col("v"), probs, max_values)
    for g in shapes:
        values = [r["v"] for r in df.where(F.col("g") == g).where("v is not null").select("v").collect()]
        assert got[g] == pytest.approx(expected_quantiles(values, probs), rel=1e-12)


def test_few_values_leave_their_tasks(spark, monkeypatch):
    seen = []
    stage = scale.stage
    monkeypatch.setattr(scale, "stage", lambda df, label="stage": seen.append((label, stage(df, label))) or seen[-1][1])
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    scale.exact_quantiles_of(df, "v", [0.25, 0.5, 0.75])
    counts = dict(seen)["bracket-counts"]
    assert counts.where("v is not null").count() < n / 100


def test_a_bracket_that_misses_falls_back(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(scale, "_bracket", lambda n, k, last, marks: (2000.0, 3000.0))
    assert scale.exact_quantiles_of(df, "v", [0.5]) == [499.5]


def test_ranks_in_one_slice_share_their_cuts(spark, monkeypatch):
    """Three quartiles of a large group start in one slice: its values are cut and counted once, and the cut of a value is
    found by halving, not by comparison with all cuts."""
    sizes, real = [], scale._only
    monkeypatch.setattr(scale, "_only", lambda inside, keys, *rest: sizes.append(len(keys)) or real(inside, keys, *rest))
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.normal(0, 1, 1500), rng.normal(1e9, 1, 500), [-np.inf, 0.0]]))
    weights = rng.integers(1, 9, len(values))
    rows = [(7, float(v), int(c)) for v, c in zip(values, weights)]
    found = scale.quantiles_of_counts(spark.createDataFrame(rows, "__group int, v double, c long"), [0.25, 0.5, 0.75], max_values=100).collect()
    assert sizes[:2] == [1, 1]
    assert np.allclose(found[0]["q"], np.quantile(np.repeat(values, weights), [0.25, 0.5, 0.75]))
    cuts = sorted({float(x) for x in rng.integers(0, 99, 300)})[:255]
    for size in (0, 1, 2, len(cuts)):
        got = spark.range(100).select("id", scale._slice_of(F.col("id").cast("double"), F.array(*[F.lit(c) for c in cuts[:size]]).cast("array<double>")).alias("s"))
        assert [r["s"] for r in got.orderBy("id").collect()] == [sum(c <= i for c in cuts[:size]) for i in range(100)]
