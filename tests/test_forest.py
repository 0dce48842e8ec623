"""The random forest behind the model scores."""

import math

import numpy as np
import pytest

from limpid.operators import forest, impute, ml


def plain_forest(x, y, keys, cuts, classes, trees, depth):
    """Predictions of a forest as plain Python grows it: every cut is tried on the rows themselves."""
    def impurity(w, y):
        if classes:
            shares = np.bincount(y.astype(int), w, classes) / w.sum()
            return 1 - (shares**2).sum()
        return (w * (y - (w * y).sum() / w.sum())**2).sum() / w.sum()

    def leaf(w, y):
        return np.bincount(y.astype(int), w, classes) / w.sum() if classes else (w * y).sum() / w.sum()

    def grow(w, rows, asked, level):
        """Value for each of the rows asked for, from the rows drawn."""
        best = None
        for f in range(x.shape[1] if level < depth else 0):
            for c in cuts[f]:
                sides = [rows[x[rows, f] <= c], rows[x[rows, f] > c]]
                if all(len(s) for s in sides):
                    gain = impurity(w[rows], y[rows]) - sum(w[s].sum() * impurity(w[s], y[s]) for s in sides) / w[rows].sum()
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, c, sides
        if best is None:
            return {i: leaf(w[rows], y[rows]) for i in asked}
        _, f, c, (low, high) = best
        return grow(w, low, [i for i in asked if x[i, f] <= c], level + 1) | grow(w, high, [i for i in asked if x[i, f] > c], level + 1)

    votes = 0
    for drawn in forest.draws(keys.astype(np.uint64), 7, list(range(trees))):
        found = grow(drawn.astype(float), np.flatnonzero(drawn), range(len(x)), 0)
        votes = votes + np.array([found[i] for i in range(len(x))])
    return votes.argmax(axis=1) if classes else votes / trees


@pytest.mark.parametrize("classes", [0, 3])
def test_a_forest_does_not_depend_on_tasks_and_passes(spark, monkeypatch, classes):
    """It is as plain Python grows it, whatever the tasks, blocks, pieces and passes are."""
    random = np.random.default_rng(5)
    x = np.stack([random.integers(0, 9, 400), random.integers(0, 50, 400), random.normal(size=400).round(2)], axis=1).astype(float)
    keys = random.integers(0, 1 << 60, 400)
    y = (random.integers(0, 3, 400) if classes else random.normal(size=400) + x[:, 0] + 1e6).astype(float)
    df = spark.createDataFrame([(int(i), row.tolist(), float(t)) for i, row, t in zip(keys, x, y)], "__id long, features array<double>, label double")
    for tasks, block, sums, piece in ((1, 1 << 17, 1 << 30, 1 << 20), (7, 9, 6000, 100)):
        for name, value in (("_BLOCK", block), ("_SUMS", sums), ("_PIECE", piece)):
            monkeypatch.setattr(forest, name, value)
        model = forest.fit(df.repartition(tasks, "__id"), df, classes=bool(classes), trees=6, depth=3, per_node="all", seed=7)
        assert [len(c) for c in model.cuts] == [8, 31, 31]
        want = plain_forest(x, y, keys, model.cuts, classes, 6, 3)
        found = model.predictions(np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(model.cuts)]))
        assert np.allclose(found, want, rtol=0, atol=1e-6)
        assert sorted((r["label"], round(r["prediction"], 5)) for r in model.predict(df).collect()) == sorted((t, round(float(p), 5)) for t, p in zip(y, found))


def test_a_forest_has_bounded_tasks(spark, monkeypatch):
    """Each task sends sums of all nodes, so rows alone do not decide how many there are."""
    monkeypatch.setattr(ml, "TASK_ROWS", 1)
    table = ml.spread(spark.range(1000).withColumnRenamed("id", "__id"))
    assert table.rdd.getNumPartitions() == ml.CORE_TASKS * spark.sparkContext.defaultParallelism and table.count() == 1000


def test_nodes_choose_among_some_features(spark):
    """A choice of ceil(sqrt(5)) of 5 features for every node, so the roots differ; with all features the one that tells most wins."""
    df = spark.range(600).selectExpr("xxhash64(id) as __id", "array(id % 2, id % 3, id % 5, id % 7, id) as features", "cast(id < 300 as double) as label") \
        .selectExpr("__id", "cast(features as array<double>) as features", "label")
    some, every = (forest.fit(df, df, classes=True, trees=20, depth=2, per_node=p, seed=7) for p in ("sqrt", "all"))
    assert len(set(some.feature[:, 0])) > 2 and set(every.feature[:, 0]) == {4}
    assert {(r["label"], r["prediction"]) for r in every.predict(df).collect()} == {(0.0, 0.0), (1.0, 1.0)}


def test_samples_of_a_tree():
    """Counts of a draw with replacement, other ones for every tree, the same whatever rows stand beside a row."""
    keys = np.arange(200_000, dtype=np.uint64) << np.uint64(20)
    first, *others = list(forest.draws(keys, 42, [0, 1, 5]))
    shares = np.bincount(first, minlength=5)[:5] / len(keys)
    assert np.allclose(shares, [math.exp(-1) / math.factorial(i) for i in range(5)], atol=0.005) and abs(first.mean() - 1) < 0.01
    assert all(abs(np.corrcoef(first, o)[0, 1]) < 0.01 for o in others)
    assert [next(forest.draws(keys[i : i + 1], 42, [0]))[0] for i in range(50)] == first[:50].tolist()


def test_bins_do_not_depend_on_tasks(spark, monkeypatch):
    """Their bounds come from the same rows, however the table is cut; copies of one row do not get lost."""
    monkeypatch.setattr(forest, "_SAMPLE", 100)
    df = spark.range(5000).selectExpr("xxhash64(id) as __id", "array(double(id), double(id % 3)) as features", "double(id) as label")
    found = [[c.tolist() for c in forest._facts(df.repartition(n))[2]] for n in (1, 5)]
    assert found[0] == found[1] and [len(c) for c in found[0]] == [31, 2] and 100 < np.mean(np.diff(found[0][0])) < 220
    copies = spark.range(5000).selectExpr("0L as __id", "array(1.0D) as features", "0.0D as label")
    assert all(len(forest._facts(copies.withColumn("label", copies.label + i))[2][0]) == 0 for i in range(3))


def test_rows_of_one_key_are_drawn_apart(spark):
    """Copies stand together, so each has a key of its own, wherever a batch or a block ends."""
    ids = np.array([-5, 1, 1, 1, 2, 7, 7, 7, 7], dtype=np.int64)
    whole, last = forest.numbered(ids, None)
    assert len(set(whole.tolist())) == 9 and whole[[0, 1, 4, 5]].view(np.int64).tolist() == [-5, 1, 2, 7] and last == (7, 4)
    for cut in range(1, 9):
        first, kept = forest.numbered(ids[:cut], None)
        rest, end = forest.numbered(ids[cut:], kept)
        assert [*first, *rest] == whole.tolist() and end == last
    table = spark.range(300).selectExpr("id % 100 as __id", "array(double(id % 2)) as features", "0.0D as label")
    keys = [b"".join(r["keys"] for r in forest._blocks(ml.spread(table), [np.array([0.5])], 0.0).collect())]
    assert len(set(np.frombuffer(keys[0], np.int64).tolist())) == 300


def test_one_class_and_constant_numbers(spark):
    df = spark.range(30).selectExpr("id as __id", "array(double(id)) as features", "0.0D as label")
    assert {r["prediction"] for classes in (True, False) for r in forest.fit(df, df, classes=classes, trees=3, depth=3, per_node="all", seed=1).predict(df).collect()} == {0.0}


@pytest.mark.parametrize("rows, columns, label", [(5, "array()", "0.0"), (5, "array(1.0D)", "null"), (0, "array(1.0D)", "1.0")])
def test_a_forest_without_rows_features_or_labels_is_an_error(spark, rows, columns, label):
    df = spark.range(rows).selectExpr("id as __id", f"cast({columns} as array<double>) as features", f"cast({label} as double) as label")
    with pytest.raises(ValueError, match="features and a label"):
        forest.fit(df, df, classes=False, trees=2, depth=2, per_node="all", seed=1)


def test_only_columns_with_gaps_need_a_mode(spark, monkeypatch):
    fitted, real = [], impute.fit
    monkeypatch.setattr(impute, "fit", lambda df, wanted: fitted.append(wanted) or real(df, wanted))
    df = spark.range(50).selectExpr("id", "if(id % 3 = 0, null, id % 4) as gap", "cast(null as double) as none", "id * 2.0D as y", "concat('c', id % 3) as t")
    out = ml.features(df, "y", "regression", ["id"])
    assert fitted == [{"gap": "mode"}] and out.columns == ["__id", "id", "gap", "t", "label"]
    assert {r["id"]: r["gap"] for r in out.collect()} == {i: float(i % 4 if i % 3 else 1) for i in range(50)}
