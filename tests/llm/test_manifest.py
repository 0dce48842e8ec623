"""Merkle manifest, filter audit and chat formatting against plain Python."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limpid.llm import chat, common, filter_audit, merkle
from limpid.llm.templates import Controls, Template, TemplateError


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# --- merkle --------------------------------------------------------------------------------------

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, path string, idx int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(row: dict) -> str:
    values = [None if row[f] is None else str(row[f]) for f in FIELDS]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(digests: list[str], fanout: int) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        start = at - at % fanout
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        at //= fanout
    return out


def plain_manifest(rows: list[dict], fanout: int) -> tuple[str, Counter]:
    """(root, counted (leaf, subroot, path))."""
    groups = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for g in groups:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)) for r in rows if r["source"] == g))
        trees[g] = levels([x[2] for x in own], fanout)
    top = levels([trees[g][-1][0] for g in groups], fanout) if groups else [[sha("")]]
    found = Counter()
    for i, g in enumerate(groups):
        for at, leaf in enumerate(trees[g][0]):
            found[leaf, trees[g][-1][0], tuple(siblings(trees[g], at, fanout) + siblings(top, i, fanout))] += 1
    return top[-1][0], found


def documents(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in ("doc_id", "text", "lang", "source", "n_chars")) + ("p", 1) for r in rows], DOCUMENT)


ODD = [{"doc_id": None, "text": None, "source": None}, {"doc_id": None, "text": "", "source": ""}, {"doc_id": 1, "text": "é" * 3000, "source": "é"},
       {"doc_id": 1, "text": "A", "source": "z", "n_chars": 1}, {"doc_id": 1, "text": "A", "source": "z", "n_chars": 1}, {"doc_id": 1, "text": "B", "source": "z"}]


@pytest.mark.parametrize("fanout, size", [(2, 40), (3, 40), (16, 40), (16, 0), (16, 1)])
def test_manifest_equals_a_plain_tree(spark, fanout, size):
    rows = [{"doc_id": i * 7 % 300, "text": f"T{i}", "lang": "en", "source": "hot" if i % 3 else f"s{i % 21}", "n_chars": i} for i in range(size * size // 8)] + (ODD if size else [])
    rows = [dict.fromkeys(FIELDS) | r for r in (rows if size != 1 else ODD[:1])]
    m = merkle.manifest(documents(spark, rows), FIELDS, fanout=fanout)
    root, want = plain_manifest(rows, fanout)
    assert m.root == root
    proven = merkle.proofs(m).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    got = Counter((r["leaf"], r["subroot"], tuple((p["left"], p["right"]) for p in r["path"])) for r in proven)
    assert got == want
    assert all(r["folded"] == root for r in proven)
    assert all(r["proof"] == sha(*[p[side] for p in r["path"] for side in ("left", "right")]) for r in proven)


def test_tampering_is_seen(spark):
    rows = [dict.fromkeys(FIELDS) | {"doc_id": i, "text": f"Text {i}", "source": "s"} for i in range(50)]
    m = merkle.manifest(documents(spark, rows), FIELDS)
    leaf = F.when(F.col("id") == 7, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf"))
    bad = merkle.proofs(m).where(merkle.fold(leaf, F.col("path")) != m.root)
    assert [r["id"] for r in bad.collect()] == [7]
    with pytest.raises(ValueError):
        merkle.manifest(documents(spark, rows), FIELDS, fanout=1)


def test_rank_of_a_hot_group(spark):
    df = spark.range(4000).select((F.col("id") * 37 % 4001).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("g")).alias("g"))
    got = sorted((r["g"] or "", r["k"], r["idx"], r["n"]) for r in common.ranked(df.repartition(7), "g", ["k"]).collect())
    want = []
    for g in ("", "g"):
        own = sorted(i * 37 % 4001 for i in range(4000) if (i % 3 == 0) == (g == ""))
        want += [(g, k, i, len(own)) for i, k in enumerate(own)]
    assert got == sorted(want)


# --- filter audit --------------------------------------------------------------------------------

def plain_mask(text: str) -> int:
    words = text.encode().split()  # bytes know ASCII white space only
    capitals = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
    return (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * capitals > 5 * len(text)) + 8 * any(c in text for c in "#$%&*|")


def plain_audit(rows: list[tuple], labels: list[tuple]) -> dict:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        text = text or ""
        copy = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        docs.append((source or "", plain_mask(text) + 16 * copy, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[1] & bit]
                before = [d for d in own if d not in left]
                failed_before = sum(1 for d in own if d[1] & bit) - len(gone)
                left = [d for d in left if not d[1] & bit]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failed_before, sum(d[1] == bit for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), letter]
                assert len(before) + len(left) + len(gone) <= len(own) + len(before)
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


FIFTY = " ".join(f"w{i}" for i in range(50))
AUDITED = [(1, FIFTY, "s"), (2, FIFTY, "t"), (3, FIFTY, "s"), (3, FIFTY, "s"), (4, "", None), (5, None, ""), (6, "A b", "s"), (7, " \t\n", "t"), (8, "\x0b" + FIFTY + " ", "t"),
           (9, "word " * 60, "s"), (10, FIFTY + " A|", "t"), (11, FIFTY + " #", "s"), (None, FIFTY, "s"), (None, "x", "t"), (12, "x", "t"), (13, "a" * 100_000 + " A", "s"),
           (14, "ÀÉ " + FIFTY, "t"), (15, "A" * 3 + FIFTY, "s"), (16, "w " * 39 + FIFTY[:60], "t")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 1, None), (5, None, 1), (6, 0, 0), (6, 1, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0), (10, 1, 1)]


def test_audit_equals_a_plain_run(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in AUDITED], "doc_id long, text string, source string, mask int, n int")
    labels = spark.createDataFrame([(*r, "s") for r in LABELS], "doc_id long, quality int, toxic int, source string")
    got = filter_audit.audit(df, labels).collect()
    want = plain_audit(AUDITED, LABELS)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    assert len(got) == len(want) == 3 * 600


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    alone = filter_audit.audit(spark.createDataFrame([(1, FIFTY, "s")], empty.schema), labels).collect()
    assert len(alone) == 600 and {r["kept"] for r in alone} == {1} and {r["shapley"] for r in alone} == {0}


def test_fields_do_not_overflow():
    import pandas as pd

    most = 2**62
    table = filter_audit.part_table(pd.DataFrame({"part": "p", "mask": [31, 1], "good": [True, False], "toxic": [False, True], "n": [most, 5]}), "ABCDE")
    first = table[(table["filter_order"] == "ABCDE") & (table["step"] == 1)].iloc[0]
    assert first[["removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]].tolist() == [most + 5, 0, 5, most, 5]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 2**40)), max_size=8))
def test_sums_of_outcomes_unpack(classes):
    total = sum(filter_audit.outcomes(mask, "ABC") * n for mask, n in classes)
    counts = filter_audit.unpack(total, "ABC")
    for o, order in enumerate(filter_audit.orders("ABC")):
        gone = 0
        for s, f in enumerate(order):
            failing = [(m, n) for m, n in classes if m >> f & 1]
            assert counts[o, s].tolist() == [sum(n for m, n in failing if not m & gone), sum(n for m, n in failing if m & gone), sum(n for m, n in failing if m == 1 << f)]
            gone |= 1 << f


# --- templates -----------------------------------------------------------------------------------

NONE = Controls(("<a>", "<b>"))


@pytest.mark.parametrize("source, values, want", [
    ("a {{ x }} b", {"x": "1"}, "a 1 b"),
    ("a {{- x -}} b", {"x": "1"}, "a1b"),
    ("{{ 'a' + 'b' }}{# no #}{{ 1 + 2 }}", {}, "ab3"),
    ("{{ x['k'].j | upper | trim }}", {"x": {"k": {"j": " é "}}}, "É"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a, 2b"),
    ("{% if x == 'a' %}A{% elif x in 'bc' %}B{% else %}C{% endif %}", {"x": "c"}, "B"),
    ("{% set y = x + '!' %}{{ y }}{% if true and x != 'q' or false %}{{ y }}{% endif %}", {"x": "p"}, "p!p!"),
    ("{{ '\\n' }}{{ \"it's\" }}", {}, "\nit's"),
    ("{{ x | default('d') }}", {"x": ""}, "d"),
    ("{{ x | escape }}", {"x": "<a>\\<b>"}, "<\\a>\\\\<\\b>"),
])
def test_rendering(source, values, want):
    assert Template(source, NONE).render(**values).text == want


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x.upper }}", "{{ open('f') }}", "{{ y }}", "{% for c in x %}{% endfor %}", "{{ x + 1 }}", "{{ none }}", "{% if %}a{% endif %}",
                                    "{% for x in y %}", "{% import os %}", "{{ 'a }}", "{{ x | format }}", "{{ 1 1 }}", "{% generation %}{% generation %}a{% endgeneration %}{% endgeneration %}"])
def test_sandbox_and_errors(source):
    with pytest.raises(TemplateError):
        Template(source, NONE).render(x="text")


def test_constants_fold():
    tree = Template("{% if 'a' in 'abc' and not false %}x{{ '<a>' | escape }}{% else %}{{ y }}{% endif %}{{ 1 + 1 }}{% if y == 1 or true %}{% endif %}", NONE).tree
    assert tree[0] == ("text", "x<\\a>2")


def test_control_strings_must_not_overlap():
    for strings in [("ab", "bc"), ("aba",), ("a",), ("a\\b",)]:
        with pytest.raises(TemplateError):
            Controls(strings)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]),
                          st.lists(st.sampled_from([*chat.INSTRUCT.controls, "\\", " ", "\n", "<", "[", "/", "s>", "é🙂", "<<", "]", "text"])).map("".join)), max_size=6))
def test_any_conversation_is_read_back(messages):
    out = chat.render(chat.INSTRUCT, messages)
    assert chat.read_turns(chat.INSTRUCT, out.text) == messages
    controls = Controls(chat.INSTRUCT.controls)
    assert [controls.unescape(out.text[a:b]) for a, b in out.spans] == [t for r, t in messages if r == "assistant" and t]


# --- conversations -------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, block int, n int"


def plain_digests(rows: list[tuple]) -> set:
    out = set()
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        learn = "".join(t for r, t in own if r == "assistant")
        out.add((conv, len(own), sha(*[f"{r}\n{t}\n" for r, t in own]), len(learn), sha(learn), len(chat.render(chat.INSTRUCT, own).text)))
    return out


TALKS = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (2, 1, "assistant", "late"), (2, None, "system", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "user", "[INST]"),
         (None, 2, "tool", "\\"), (3, 0, "assistant", ""), (4, 0, "assistant", "é" * 200_000), (4, 1, "user", "u" * 5)] + [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]


@pytest.mark.parametrize("piece, hot", [(chat.PIECE, False), (50, False), (1000, True)])
def test_conversations_equal_plain_python(spark, monkeypatch, piece, hot):
    if hot:
        monkeypatch.setattr(chat, "hot_groups", lambda keys, rows, smallest: ({r["key"]: 300 for r in keys.groupBy("key").count().where("count > 100").collect()}, 70))
    df = spark.createDataFrame([(*r, 9, 9) for r in reversed(TALKS)], TALK).repartition(5)
    formatted = chat.formatted_table(df, piece_chars=piece)
    got = {tuple(r) for r in chat.digests(formatted).collect()}
    assert got == plain_digests(TALKS)
    rows = formatted.where("id = 5").orderBy("block", "piece").collect()
    assert len(rows) == 1 if piece == chat.PIECE else len(rows) > 3
    assert "".join(r["formatted"] for r in rows) == chat.render(chat.INSTRUCT, [(r, t) for c, _, r, t in TALKS if c == 5]).text


def test_no_conversations(spark):
    assert chat.digests(chat.formatted_table(spark.createDataFrame([], TALK))).count() == 0


def test_pieces_carry_what_is_around_the_loop(spark):
    frame = chat.ChatFormat("{% set who = 'x' %}BEGIN{% for m in messages %}<{{ who }}{{ loop.index0 }}>{% endfor %}END{{ who }}", ("[INST]",), "")
    df = spark.createDataFrame([(1, i, "user", "t", 0, 0) for i in range(9)], TALK)
    rows = chat.format_conversations(df, frame, piece_chars=12).orderBy("piece").collect()
    assert "".join(r["formatted"] for r in rows) == "BEGIN" + "".join(f"<x{i}>" for i in range(9)) + "ENDx"
    assert [(r["first"], r["turns"], r["n"]) for r in rows] == [(0, 2, 9), (2, 3, 9), (5, 3, 9), (8, 1, 9)]
    with pytest.raises(TemplateError):
        chat.format_conversations(df, chat.ChatFormat("{% for m in messages %}{{ messages | length }}{% endfor %}", ("[INST]",), ""))


def test_crc_of_ids(spark):
    got = spark.range(100).select(F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert [r["c"] for r in got] == [zlib.crc32(str(i).encode()) for i in range(100)]
