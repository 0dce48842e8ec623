import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from limpid.llm import components, exact_dedup, jaccard, line_dedup, queries, rp_forest, simhash
from limpid.llm.common import table

SF = "/root/testdata/sf0.01"
WHITE = b" \t\n\x0b\x0c\r"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def least_reachable(ids, links):
    """Smallest reachable id of every position, from pairs of positions."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    best = {}
    for i, x in enumerate(ids):
        if x is not None and (best.get(root(i)) is None or x < best[root(i)]):
            best[root(i)] = x
    return [best.get(root(i)) for i in range(len(ids))]


# --- components --------------------------------------------------------------------------------

@pytest.mark.parametrize("links", [
    [], [(5, 5)], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
    [(random.Random(k).randrange(120), random.Random(-k).randrange(120)) for k in range(1, 90)],
])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components.components(frame(spark, links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(nodes)}
    want = least_reachable(nodes, [(place[a], place[b]) for a, b in links if a != b])
    assert got == dict(zip(nodes, want))


# --- exact -------------------------------------------------------------------------------------

def exact_brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        norm = (text or "").encode().translate(None, WHITE)
        groups.setdefault(norm, []).append((-len(text or ""), doc is None, doc, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        for k, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm).hexdigest()))
    return sorted(out, key=repr)


EDGE = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \r\n\x0b\x0c"), (None, "ab"), (None, None), (7, "a\xa0b"), (8, "AB"),
        (9, "x" * 300_000), (10, "x" * 150_000 + " " + "x" * 150_000), (2, "ab"), (11, "é è"), (12, "éè")]


@pytest.mark.parametrize("smallest", [1000, 1])
def test_exact_matches_brute_force(spark, monkeypatch, smallest):
    monkeypatch.setattr("limpid.llm.common.hot_limit", lambda spark, rows, least=1: smallest)
    rows = EDGE + [(100 + i, "same  text" if i % 2 else "same text") for i in range(40)]
    got = exact_dedup.mark_copies(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == exact_brute(rows)


def test_exact_keeps_other_columns_and_empty_tables(spark):
    df = frame(spark, [(1, "a", 7, "x"), (2, "a ", 8, "y")], "doc_id long, text string, keep_id int, __own string")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "a ", 8, "y")]
    assert exact_dedup.mark_copies(df.limit(0)).collect() == []


def test_exact_needs_one_exchange_and_no_python(spark):
    plan = exact_dedup.mark_copies(frame(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- simhash -----------------------------------------------------------------------------------

def print_brute(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().translate(bytes.maketrans(WHITE, b" " * 6)).split(b" ") if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


TEXTS = [None, "", " \n", "one", "ONE", "a b c", "a b c d", "a b c d e", "Éa É b c d", "a\xa0b c d e f", "w " * 5000, "\x1ca b\x85c d e"]


def test_fingerprints(spark):
    for text in TEXTS:
        assert simhash.fingerprint(text) == print_brute(text)
    spark_hash = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert spark_hash % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


def near_brute(rows):
    prints = [print_brute(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, least_reachable([d for d, _ in rows], links))), key=repr)


def near_rows(n):
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(None, "a b"), (3, "A  b"), (3, "a b"), *enumerate(TEXTS, 1000)]
    for i in range(n):
        own = words.copy()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [4096, 12])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.math, "ceil", lambda x: int(-(-x // 1)))
    rows = near_rows(150)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(rows)


def test_grid_finds_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near])).view(np.int64)
    links = simhash.near_links(spark.createDataFrame([(int(p),) for p in prints], "fp long"))
    found = {tuple(sorted(r)) for r in links.collect()}
    joined = least_reachable(prints.tolist(), [(prints.tolist().index(a), prints.tolist().index(b)) for a, b in found])
    root = dict(zip(prints.tolist(), joined))
    assert all(root[a] == root[b] for a, b in zip(base.view(np.int64).tolist(), near.view(np.int64).tolist()))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)


def test_near_duplicates_on_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents", "doc_id", "text").collect()]
    got = queries.op2_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(rows)


def test_near_copies_stage(spark):
    df = frame(spark, [(2, "a b c d", "x"), (1, "A b c d", "y"), (1, "a B c d", "z"), (None, "q", "n"), (None, "Q", "m")], "doc_id long, text string, component_id string")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, None]
    assert simhash.drop_near_copies(df.limit(0)).collect() == []


def jaccard_brute(rows, least=0.8):
    """Row numbers that stay, and the pairs linked."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least]
    group = least_reachable(list(range(len(rows))), links)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[group[i]] = min(best.get(group[i], (True, 0, i)), (doc is None, doc or 0, i))
    return {b[2] for b in best.values()}, links


def test_stage_drops_near_copies_at_index_08(spark):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(5000, None), (5001, " "), (5002, "a b"), (None, "A  b"), (5003, "a b c d e f")]
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 100, 300]))]
        for c in range(4):
            own = words.copy()
            for _ in range(rng.randrange(1 + len(own) // 40)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((4 * k + c, " ".join(own)))
    base = [f"h{i}" for i in range(200)]
    rows += [(900 + i, " ".join(base[: 190 - i] + [f"t{i}"] + base[191 - i :])) for i in range(150)]  # one large group
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int")
    kept, links = jaccard_brute(rows)
    assert {r["place"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()} == kept
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert any((prints[i] ^ prints[j]).bit_count() > 4 for i, j in links) and len(kept) < len(rows) - 150


def test_members_far_from_the_least_of_their_bucket(spark, monkeypatch):
    """All in one bucket: 1 and 2 are near copies, and so are 3 and 4, but 0 is near to none."""
    monkeypatch.setattr(jaccard, "band_keys", lambda hashes: [7])
    a, b = ([f"{x}{i}" for i in range(100)] for x in "ab")
    texts = ["z " * 50, " ".join(a), " ".join([*a[:-1], "y"]), " ".join(b), " ".join([*b[:-1], "y"])]
    df = frame(spark, list(enumerate(texts)), "row long, text string")
    assert {tuple(r) for r in jaccard.near_groups(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    """No two texts share a band: what is linked comes from SimHash, and the index is still checked."""
    monkeypatch.setattr(jaccard, "band_keys", lambda hashes: [int(hashes.view(np.int64).sum() & 0x7FFFFFFFFFFF)])
    a, b = ([f"{x}{i}" for i in range(4000)] for x in "ab")
    texts = [" ".join(a), " ".join([*a[:-1], "y"]), " ".join([*a[:-2], "x", "y"]), " ".join(b), " ".join([*b[:-1], "y"]), "c d"]
    df = frame(spark, list(enumerate(texts)), "row long, text string")
    assert {tuple(r) for r in jaccard.near_groups(df).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}
    assert jaccard.near_groups(df, least=0.9999).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_strays_meet_members_of_all_blocks(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    sets = {i: np.unique(np.where(rng.random(60) < (0.02, 0.1, 0.4)[i % 3], rng.integers(0, 2**63, 60, dtype=np.int64), base)) for i in range(90)}
    index = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in sets for j in sets}
    own = {i: 0 if index[i, 0] >= 0.8 else i for i in sets}
    placed = frame(spark, [(k, i, len(sets[i]), own[i], 0) for i in sets if i for k in (7, 8)], "key long, row long, n int, own long, of_center long")
    stored = frame(spark, [(i, s.tolist()) for i, s in sets.items()], "row long, hashes array<long>")
    found = {tuple(r) for r in jaccard._cross_links(placed, stored, 0.8, block).collect()}
    assert all(index[a, b] >= 0.8 and own[a] != own[b] for a, b in found) and len(found) < 2 * 90 * (1 if block > 300 else 40)
    stars = [(i, 0) for i in sets if own[i] == 0]
    every = [(i, j) for i in sets for j in sets if j < i and index[i, j] >= 0.8]
    assert least_reachable(list(sets), [*stars, *found]) == least_reachable(list(sets), every)


# --- vectors -----------------------------------------------------------------------------------

def vector_brute(rows, least=0.9):
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]

    def close(i, j):
        if not (good[i] and good[j]) or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least

    links = [(i, j) for i in range(len(rows)) for j in range(i) if close(i, j)]
    degree = np.bincount(np.array(links, int).reshape(-1), minlength=len(rows))
    return sorted(((d, int(n), c) for (d, _), n, c in zip(rows, degree, least_reachable([d for d, _ in rows], links))), key=repr)


ODD_VECTORS = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
               (8, [2.0, 0.0]), (None, [1.0, 0.1]), (9, [1.0]), (10, [-1.0]), (11, [1e-300, 1e-300]), (12, [1e300, 1e300]), (13, [-0.0, 0.0])]


def test_vectors_with_odd_values(spark):
    rows = ODD_VECTORS
    got = rp_forest.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == vector_brute(rows)
    none = frame(spark, [], "vec_id long, embedding array<float>")
    assert rp_forest.near_vectors(none).collect() == []


@pytest.mark.parametrize("block", [4096, 40])
def test_forest_recall(spark, monkeypatch, block):
    """Pairs at cosines from 0.9 up, a dense cluster and copies, over many leaves."""
    monkeypatch.setattr(rp_forest, "LEAF", 60)
    monkeypatch.setattr(rp_forest, "BLOCK", block)
    rng = np.random.default_rng(11)

    def towards(v, cosine):
        w = rng.standard_normal(len(v))
        w -= (w @ v) * v / (v @ v)
        return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)

    vectors = [rng.standard_normal(32) for _ in range(900)]
    vectors += [towards(v, c) for v, c in zip(vectors[:300], np.linspace(0.901, 0.999, 300))]
    vectors += [towards(vectors[500], 0.97) for _ in range(150)] + [vectors[600]] * 40
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = {r[0]: tuple(r)[1:] for r in rp_forest.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>")).collect()}
    want = {r[0]: r[1:] for r in vector_brute(rows)}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_vectors_on_embeddings(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings", "vec_id", "embedding").collect()]
    got = queries.op1_rp_forest(spark, SF).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == vector_brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


# --- lines -------------------------------------------------------------------------------------

def passages_brute(rows, least=50):
    """(text, lines removed) per row of distinct ids: every line in a run over `least` words that occurs before."""
    lines = {doc: [(i, x) for i, x in enumerate((text or "").split("\n")) if x.encode().translate(None, WHITE)] for doc, text in rows}
    first, spans = {}, []
    for doc in sorted(lines):
        own = lines[doc]
        for a in range(len(own)):
            words = 0
            for b in range(a, min(len(own), a + least + 12)):
                words += len(own[b][1].split())
                if words > least:
                    run = tuple(x for _, x in own[a : b + 1])
                    spans.append((doc, own[a][0], own[b][0], first.setdefault(run, (doc, own[b][0]))))
    gone = {doc: set() for doc in lines}
    for doc, a, b, (first_doc, first_end) in spans:
        if doc != first_doc or a > first_end:
            gone[doc].update(range(a, b + 1))
    return {doc: ("\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone[doc]), len(gone[doc])) for doc, text in rows}


def test_passages_of_one_to_ten_lines(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    planted = [[words(60 // n + 1) for _ in range(n)] for n in range(1, 11)]
    rows = [(k, "\n".join([words(9), *p, words(9)])) for k, p in enumerate(planted)]
    rows += [(20 + k, "\n".join([words(9), words(3), *p, words(9)])) for k, p in enumerate(planted)]
    out = {r["doc_id"]: r for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    for k, p in enumerate(planted):
        assert out[k]["removed_lines"] == 0 and out[k]["text"] == rows[k][1]
        assert [tuple(x) for x in out[20 + k]["removed"]] == [(2, len(p))] and out[20 + k]["removed_lines"] == len(p)


def test_lines_match_brute_force(spark):
    rng = random.Random(2)
    shared = [[f"line {rng.randrange(10**6)} of a passage" for _ in range(rng.choice([9, 14]))] for _ in range(4)]
    rows = [(-1, "\n".join(shared[0])), (0, None), (1, ""), (2, "\n\n\n"), (3, "\n\n\n"), (4, "one line")]
    for i in range(5, 60):
        own = [f"own {i} {k}" for k in range(rng.randrange(5))]
        rows.append((i, "\n".join(own + rng.choice(shared) + [f"end {i}"])))
    rows.append((99, "\n".join(f"{k}" for k in range(20_000))))
    rows.append((100, "\n".join(f"{k}" for k in range(5_000, 6_000))))
    out = {r["doc_id"]: r for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert {k: (r["text"], r["removed_lines"]) for k, r in out.items()} == passages_brute(rows)
    assert all(r["removed_lines"] == sum(x["n_lines"] for x in r["removed"]) for r in out.values())
    assert [tuple(x) for x in out[100]["removed"]] == [(0, 1000)]


def test_a_run_of_few_words_stays(spark):
    rows = [(i, "\n".join([f"own {i}", *[f"menu entry {k}" for k in range(16)], f"end {i}"])) for i in range(4)]
    out = line_dedup.remove_repeats(frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == dict(rows)
    assert sorted(r["removed_lines"] for r in line_dedup.remove_repeats(frame(spark, rows), least_words=47).collect()) == [0, 16, 16, 16]


def test_passages_match_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 12, 25, 51, 70]))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "\n".join(["again " * 20] * 9)), (4, "\n".join(["again " * 20] * 5)), (5, "\n" * 3000)]
    for i in range(6, 90):
        at = rng.randrange(20)
        rows.append((i, "\n".join([f"own {i}", *pool[at : at + rng.randrange(7)], *rng.sample(pool, 2), f"end {i}"])))
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == passages_brute(rows) and any(n for _, n in got.values())
    twice = line_dedup.remove_repeats(frame(spark, [(None, "x " * 60), (1, "x " * 60), (1, "x " * 60)])).collect()
    assert sorted((r["doc_id"] is None, r["removed_lines"]) for r in twice) == [(False, 1), (False, 1), (True, 0)]
    assert line_dedup.remove_repeats(frame(spark, [])).collect() == []
    extra = frame(spark, [(1, "a", 5)], "doc_id long, text string, removed int")
    assert line_dedup.remove_repeats(extra).first()["removed"] == []
    plan = queries.op7_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_native_operators_run_no_python(spark):
    for name in ("op6_exact_dedup", "op7_line_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
