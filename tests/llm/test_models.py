import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from limpid.llm import mixing, quality_gam, queries, toxicity
from limpid.llm.common import table
from limpid.operators import scale

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


# --- mixing ------------------------------------------------------------------------------------

def size_of(text):
    return len((text or "").encode().split())


def targets_brute(sizes, cycle=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in open_) or 1)
        above = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


def check_mix(rows, documents, draws, block):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    want = targets_brute(sizes)
    got = mixing.taken_words(documents, draws).collect()
    assert Counter(r["id"] for r in got) == Counter(d for d, _, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= block
    placed = draws.collect()
    assert len({(r["__row"], r["block"], r["repeat"]) for r in placed}) == len(placed)
    return placed


MIXED = [(i, "w " * (i % 300), "abcde"[i % 5] if i % 3 else "a") for i in range(400)] + [(1000, None, None), (None, "a b c", None), (1001, "", "empty"), (1002, "x y " * 4000, "a"),
                                                                                       (7, "w w", "b"), (7, "w w", "b"), (1003, "tiny", "zz")]


def test_mix_reaches_targets(spark):
    df = spark.createDataFrame(MIXED, DOCS).withColumn("size", F.lit("clash"))
    documents, draws = mixing.mix(df, block_words=64, shard_words=2000)
    placed = check_mix(MIXED, documents, draws, 64)
    shards = Counter(r["shard"] for r in placed)
    assert len(shards) > 10 and max(shards.values()) - min(shards.values()) <= 1


def test_mix_is_the_same_on_reruns(spark):
    def run(df):
        documents, draws = mixing.mix(df, block_words=64)
        return sorted((str(r["id"]), r["size"], r["taken"]) for r in mixing.taken_words(documents, draws).collect())

    df = spark.createDataFrame(MIXED, DOCS)
    assert run(df) == run(df.repartition(7))


def test_mix_on_documents_and_edges(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents", "doc_id", "text", "source").collect()]
    check_mix(rows, *mixing.mix(table(spark, SF, "documents", "doc_id", "text", "source")), 256)
    for few in ([], [(1, None, "a")], [(1, "a b", None)]):
        check_mix(few, *mixing.mix(spark.createDataFrame(few, DOCS)), 256)
    assert mixing.mixed_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_of_the_query_follow_the_tree(spark):
    documents, draws = mixing.mix(table(spark, SF, "documents", "doc_id", "text", "source"), least_shards=queries.MIX_SHARDS)
    placed = draws.select("shard", "source", "id").collect()
    sources = sorted({r["source"] for r in placed}, key=lambda s: (s is None, s or ""))
    counts = np.zeros((queries.MIX_SHARDS, len(sources)), np.int64)
    for r in placed:
        counts[r["shard"], sources.index(r["source"])] += 1
    assert (counts == mixing.split_quotas(counts.sum(axis=0), queries.MIX_SHARDS, 0)).all() and np.ptp(counts.sum(axis=1)) <= 1
    held = {}
    for r in placed:
        held.setdefault(r["id"], set()).add(r["shard"])
    rows = queries.op10_mixing(spark, SF).collect()
    assert {r["doc_id"]: r["shards"] for r in rows} == {r["doc_id"]: " ".join(map(str, sorted(held.get(r["doc_id"], ())))) for r in rows}


def test_mixed_documents_repeat_whole_rows(spark):
    df = spark.createDataFrame([(i, f"t {i}", s, 5) for i, s in enumerate("aaaaaaaaab")] + [(3, "t 3", "a", 5)], DOCS + ", place int")
    out = mixing.mixed_documents(df)
    rows = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == df.columns and rows[9] == 3 and sum(rows.values()) == 11


def test_columns_named_like_row_numbers_pass_through(spark):
    df = spark.createDataFrame([(i, f"w{i} x y", "a" if i % 2 else None, 7, i % 3) for i in range(12)], DOCS + ", __row int, __number int")
    documents, draws = mixing.mix(df)
    assert documents.select("__row").distinct().count() == 12
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {(r["__row"], r["__number"] == r["doc_id"] % 3) for r in out.collect()} == {(7, True)}


def test_splitting_tree_draws_hypergeometric_counts():
    quotas = np.array([1000, 10, 0, 300])
    out = np.array([mixing.split_quotas(quotas, 4, seed) for seed in range(400)])
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all()
    assert set(out.sum(axis=2).ravel()) <= {327, 328}
    share = quotas[3] / quotas.sum()
    spread = 327.5 * share * (1 - share) * (1310 - 327.5) / 1309
    assert out[:, 0, 3].mean() == pytest.approx(327.5 * share, rel=0.02) and out[:, 0, 3].var() == pytest.approx(spread, rel=0.25)
    large = mixing.split_quotas(np.array([3 * 10**10, 10**10 + 7]), 8, 0)
    assert (large.sum(axis=0) == [3 * 10**10, 10**10 + 7]).all()


def test_draws_of_large_totals_are_hypergeometric():
    counts = np.array([1000, 10, 0, 300])
    out = np.array([mixing.draw_part(counts, 500, np.random.default_rng(seed), largest=0) for seed in range(3000)])
    assert (out.sum(axis=1) == 500).all() and (out >= 0).all() and (out <= counts).all()
    plain = np.array([np.random.default_rng(seed).multivariate_hypergeometric(counts, 500) for seed in range(3000)])
    assert out.mean(axis=0) == pytest.approx(plain.mean(axis=0), rel=0.03)
    assert np.cov(out.T)[0, 3] == pytest.approx(-500 * (1000 / 1310) * (300 / 1310) * (1310 - 500) / 1309, rel=0.12)
    assert out[:, 1].var() == pytest.approx(500 * (10 / 1310) * (1300 / 1310) * (1310 - 500) / 1309, rel=0.12)
    assert (mixing.draw_part(counts, 0, np.random.default_rng(1), largest=0) == 0).all()
    assert (mixing.draw_part(counts, 1310, np.random.default_rng(1), largest=0) == counts).all()


# --- toxicity ----------------------------------------------------------------------------------

def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    dense = rng.random((700, 50)) * (rng.random((700, 50)) < 0.1)
    dense[5:9] = dense[4]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = toxicity.BlockMaxIndex([(np.flatnonzero(r), r[r > 0]) for r in dense], 50)
    for q in range(120):
        docs, cosines = index.nearest(np.flatnonzero(dense[q]), dense[q][dense[q] > 0], 10, without=q)
        all_cosines = dense @ dense[q]
        all_cosines[q] = 0
        want = np.lexsort((np.arange(700), -all_cosines.round(12)))[:10]
        want = want[all_cosines[want] > 0]
        np.testing.assert_allclose(cosines, all_cosines[want], atol=1e-12)
    empty = toxicity.BlockMaxIndex([], 50)
    assert len(empty.nearest(np.array([1]), np.array([1.0]), 3)[0]) == 0 and len(index.nearest(np.zeros(0, int), np.zeros(0), 3)[0]) == 0


def test_isotonic_levels_rise():
    x = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    steps, levels = toxicity.isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert (np.diff(levels) > 0).all() and ((levels > 0) & (levels < 1)).all() and (np.diff(steps) > 0).all()


def toxic_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        words = [f"w{rng.integers(300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.integers(60)] = ("Nastyword,", "vileness", "Scoundrel!")[rng.integers(3)]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t, 1.5) for i, t, _ in rows] + [(5000, None, 1.0), (5001, "", 1.0), (5002, "vileness " * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (5, 0), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for i, _, y in rows:
        assert got[i]["predicted"] == y, i
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    evidence = got[0]["evidence"]
    assert evidence[0]["label"] == 1 and [e["cosine"] for e in evidence] == sorted((e["cosine"] for e in evidence), reverse=True)
    assert {e["doc_id"] for r in got.values() for e in r["evidence"]}.isdisjoint({i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1})
    kept = toxicity.drop_flagged(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 5002").count() == 0 and kept.where("doc_id = 5000").first()["score"] == 1.0


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_gam, "quality")])
def test_models_without_labels_or_documents(spark, module, label):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    one = spark.createDataFrame([(2, 1), (3, 1)], f"doc_id long, {label} int")
    for labels in (none, one):
        assert all(0 <= r["score"] <= 1 for r in module.score(df, module.fit(df, labels)).collect())
        assert module.score(df.limit(0), module.fit(df.limit(0), labels)).collect() == []


def test_labels_outside_training_do_not_matter(spark):
    documents, labels = table(spark, SF, "documents", "doc_id", "text"), table(spark, SF, "labels", "doc_id", "quality", "toxic")
    turned = labels.withColumns({c: F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for module in (toxicity, quality_gam):
        a, b = ({r["doc_id"]: r["score"] for r in module.score(documents, module.fit(documents, x)).collect()} for x in (labels, turned))
        assert a == b


def held_out_accuracy(spark, name, label):
    labels = {r["doc_id"]: r[label] for r in table(spark, SF, "labels", "doc_id", label).collect()}
    rows = [r for r in queries.QUERIES[name](spark, SF).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    own = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == labels[r["doc_id"]] for r in own) / len(own)


def test_held_out_accuracy(spark):
    assert held_out_accuracy(spark, "op5_toxicity", "toxic") >= 0.95
    assert held_out_accuracy(spark, "op9_quality", "quality") >= 0.97


# --- quality -----------------------------------------------------------------------------------

def test_additive_model_learns_steps_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) != (x[:, 2] > 0.5))).astype(float)
    model = quality_gam.train(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert (1, 2) in model.pairs


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "A", "!!!", "a " * 200_000, "日本 語\n" * 3])
def test_features_are_finite(text):
    assert np.isfinite(quality_gam.features(text)).all() and len(quality_gam.features(text)) == len(quality_gam.FEATURES)


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine"))
    before = docs
    for name, step in corpus_pipeline.STAGES:
        out = scale.stage(step(spark, before, SF), name)
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(before, out.columns, "left_anti").count() == 0  # rows pass through unchanged
        if name == "exact_dedup":
            assert out.selectExpr("regexp_replace(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]', '') as t").distinct().count() == out.count()
        if name != "mixing":
            assert out.count() <= before.count()
        before = out
    assert before.count() > 0 and set(before.columns) >= {"doc_id", "ids", "n_tokens"}


def test_pipeline_accepts_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = scale.stage(step(spark, docs, SF), name)
    assert docs.count() == 0
