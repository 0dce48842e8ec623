import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from limpid.llm import bpe, queries, token_files, url_filter
from limpid.llm.common import table
from limpid.llm.units import Encoder

SF = "/root/testdata/sf0.01"
PATTERN = public_tokenizers.PATTERN
with open(queries.RANKS, "rb") as f:
    CONTENT = f.read()
MERGES = bpe.Merges(CONTENT, PATTERN)
OWN = Encoder(MERGES.encode_parts, "<u4")
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})
TOKENIZER = Tokenizer.from_file(queries.TOKENIZER)
with open(queries.TOKENIZER, "rb") as f:
    LIBRARY = token_files._encoder(f.read())

TEXTS = [None, "", " ", "\n", "  \n ", "a", " a", "a  b", "a \n b\n\nc ", "don't  we'll 'S 123 4,5", "\x1c!\x1d a", "é\u00a0\u2003x \u3000", "<|endoftext|> <|endoftext|>",
         "aaaa" * 3000, " " * 5000, "日本語 テキスト 🙂🙂", "\t\ta\t b", "x" * 50 + " \x85\n" + "y", "\r\n\r\na\r\n b", "a\x00b c.\x00", "Yes, no. it's, 12. é, ß. ,. x.. end."]


def ids(encoder, texts) -> list[list[int]]:
    found, starts = encoder.encode(pa.array(texts, pa.string()))
    return [found[a:b].tolist() for a, b in zip(starts, starts[1:])]


# --- tokens ------------------------------------------------------------------------------------

@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_ids_equal_the_libraries(text):
    assert ids(OWN, [text]) == [REFERENCE.encode_ordinary(text)]
    assert ids(LIBRARY, [text]) == [TOKENIZER.encode(text, add_special_tokens=False).ids]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdtlr a1!.,.,$_\x00\x1c\x85\xa0")), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    assert ids(OWN, texts) == [REFERENCE.encode_ordinary(t) for t in texts]
    assert ids(LIBRARY, texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", " b.", "$$$", "\x00"])).map("".join), min_size=1, max_size=5))
def test_added_tokens_as_the_library_has_them(texts):
    assert ids(LIBRARY, texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens():
    end = "<|endoftext|>"
    assert ids(LIBRARY, [f"a {end} b", end, f"{end}{end} x{end}"]) == [[64, 220, 50256, 275], [50256], [50256, 50256, 2124, 50256]]
    assert ids(OWN, [end])[0] == REFERENCE.encode_ordinary(end)


def test_replay_equals_the_plain_rule():
    words = [b"abcabcabc", b"aaaaaaa", b"lowerlowest", b"\xff\xfe", b"the", b"zzzzthezzz", b"0" * 37]
    assert [np.frombuffer(x, "<u4").tolist() for x in MERGES.replay(words)] == [[MERGES.ranks[w]] if w in MERGES.ranks else MERGES.one_by_one(w) for w in words]
    assert MERGES.replay([]) == []


def test_memory_is_bounded():
    small = Encoder(MERGES.encode_parts, "<u4", memory=4000)
    for k in range(20):
        text = " ".join(f"word{k}{i} common." for i in range(10))
        assert ids(small, [text]) == [REFERENCE.encode_ordinary(text)]
    assert len(small.known) + len(small.older) < 60


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'mine' as n", "1 as ids")
    encoded = bpe.encode(df, queries.RANKS, PATTERN)
    assert encoded.columns == ["doc_id", "text", "n", "ids"]
    rows = bpe.with_digests(bpe.decode(encoded, queries.RANKS, PATTERN)).collect()
    for r in rows:
        want = REFERENCE.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(df.limit(0), queries.RANKS, PATTERN).collect() == []
    both = bpe.round_trip(df, queries.RANKS, PATTERN)
    assert both.columns == ["doc_id", "text", "n", "ids", "decoded"]
    assert sorted(map(tuple, bpe.with_digests(both).collect())) == sorted(map(tuple, rows))
    with pytest.raises(Exception, match="without a token"):
        bpe.decode(spark.createDataFrame([(1, [50_256])], "id int, ids array<int>"), queries.RANKS, PATTERN).collect()
    missing = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(missing, queries.RANKS, PATTERN).orderBy("id").collect()] == [None, bytearray()]


def test_bpe_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents", "doc_id", "text").collect()}
    for r in queries.op4_bpe(spark, SF).collect():
        want = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# --- files -------------------------------------------------------------------------------------

def files_brute(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_token_files_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents", "doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op8_token_files(spark, SF).collect())) == files_brute(rows)


def test_token_files_hold_equal_sequences(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as start")
    manifest = token_files.write(df, queries.TOKENIZER, folder=str(tmp_path / "files"), length=16, batch_sequences=4)
    got = sorted((tuple(r) for r in token_files.read_documents(manifest).collect()), key=lambda r: r[1])
    assert got == files_brute(rows)
    stream = []
    for shard in manifest.orderBy("shard").collect():
        file = token_files.TokenFile(shard["sequences"])
        own = []
        for k in range(len(file)):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            own += ids[np.array(mask)].tolist()
            assert k == len(file) - 1 or mask.true_count == 16
        assert len(own) == shard["n_tokens"]
        stream += own
    assert stream == [i for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]]
    assert pa.ipc.open_stream(shard["sequences"]).schema == token_files.sequence_schema(16, LIBRARY.kind)
    nothing = token_files.write(df.limit(0), queries.TOKENIZER, folder=str(tmp_path / "none"))
    assert token_files.read_documents(nothing).collect() == []


# --- URLs --------------------------------------------------------------------------------------

def judge_brute(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no url", "http://", "http:///p", "HTTP://Www.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/1",
        "http://xexample.com/en/", "http://b.net/es/x", "http://net/fr/", "http://c.net/ES/", "http://d.com", "http://d.com?q=/", "http://d.com/#/en/", "x://y://z.com/a",
        "http://é.com/ü/x", "http://e.com:80/en/", "http://..com/", "http://" + "a." * 500 + "com/" + "p" * 3000]


def test_long_hosts(spark):
    urls = ["http://" + "a." * 500_000 + "example.com/en/x", "http://" + "b" * 1_000_000 + "/en/", "http://" + "." * 100_000 + "net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge_urls(df, url_filter.build_index(spark, queries.URL_RULES)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [("example.com/en/", "block"), (None, "allow"), ("net/es/", "block")]


def test_urls_match_brute_force(spark):
    rules = [*queries.URL_RULES, ("é.com", "/ü/", "block"), ("q.org", "", "block"), ("q.org", "", "allow")]
    urls = [*URLS, "http://q.org", "http://r.q.org/x"]
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = url_filter.judge_urls(df, url_filter.build_index(spark, rules)).orderBy("page_id").collect()
    kept = [r for r in rules if r != ("q.org", "", "block")]  # of repeated rules the last counts
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [judge_brute(u, kept) for u in urls]
    assert url_filter.judge_urls(df.limit(0), url_filter.build_index(spark, rules)).collect() == []
    none = url_filter.judge_urls(df, url_filter.build_index(spark, []), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "block")}


def test_equal_keys_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    keys, strings, lengths = url_filter.build_files(queries.URL_RULES)
    (tmp_path / "k.npy").write_bytes(keys)
    (tmp_path / "s").write_bytes(strings)
    prober = url_filter.Prober(str(tmp_path / "k.npy"), str(tmp_path / "s"), lengths)
    assert prober.judge(URLS, "allow") == [judge_brute(u, queries.URL_RULES) for u in URLS]
