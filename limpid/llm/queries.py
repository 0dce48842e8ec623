"""The registered query of every operator, at production parameters over whole tables, and its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm import bpe, chat, exact_dedup, filter_audit, line_dedup, merkle, mixing, quality_gam, rp_forest, simhash, token_files, toxicity, url_filter
from limpid.llm.common import words_pattern, stage, table
from limpid.operators import scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary files; both hold the same tokens.
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

#: The URL rules that op3 applies: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp_forest.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = url_filter.build_index(spark, URL_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), index).drop("url")


ORACLE["op3_url_filter"] = f"""
WITH rules(h, p, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.verdict, length(r.h || r.p) AS n, length(r.h) AS hn
  FROM split s JOIN rules r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND starts_with(s.path, r.p)),
best AS (
  SELECT page_id, host, path, arg_max(rule, n * 1000 + hn) AS rule, arg_max(verdict, n * 1000 + hn) AS verdict FROM fits GROUP BY page_id, host, path)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.page_id IS NOT DISTINCT FROM b.page_id AND s.host = b.host AND s.path = b.path"""


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    return bpe.with_digests(decoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


ORACLE["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER g = 1 AS kept
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE["op7_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
w AS (SELECT * FROM (SELECT *, len(regexp_extract_all(line, '{words_pattern()}')) AS words FROM l) WHERE words > 0),
c AS (
  SELECT doc_id, pos, sha256(line) AS digest, row_number() OVER o AS k, sum(words) OVER o AS upto, sum(words) OVER o - words AS before
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT a.doc_id, a.k AS first, b.k AS last, a.pos AS start, b.pos AS stop
  FROM c AS a ASOF JOIN c AS b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.before + {line_dedup.PASSAGE_WORDS} < b.upto
  UNION
  SELECT a.doc_id, b.k, a.k, b.pos, a.pos
  FROM c AS a ASOF JOIN c AS b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.upto - {line_dedup.PASSAGE_WORDS} > b.before),
t AS (SELECT doc_id, list(digest ORDER BY k) AS digests FROM c GROUP BY doc_id),
f AS (
  SELECT r.doc_id, start, stop, row_number() OVER p AS nth, first_value(r.doc_id) OVER p AS first_doc, first_value(stop) OVER p AS first_stop
  FROM r JOIN t ON r.doc_id IS NOT DISTINCT FROM t.doc_id
  WINDOW p AS (PARTITION BY sha256(array_to_string(digests[first:last], ' ')) ORDER BY r.doc_id NULLS FIRST, start, stop)),
g AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos
  FROM f WHERE nth > 1 AND NOT (doc_id IS NOT DISTINCT FROM first_doc AND start <= first_stop)),
k AS (
  SELECT l.doc_id, count(g.pos) AS gone, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS clean
  FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS removed_lines, length(clean) AS n_chars, sha256(clean) AS text_sha256
FROM d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id"""


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    return token_files.read_documents(manifest).withColumnRenamed("id", "doc_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_gam.fit(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_gam.score(documents, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: Output shards that op10 mixes into, at least.
MIX_SHARDS = 16


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, draws = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), least_shards=MIX_SHARDS)
    return mixing.taken_words(documents, draws).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_join("shards", " ").alias("shards"))


#: The columns that a leaf of op11 commits to.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", *LEAF)
    leaf = merkle.digest_of([F.col(c) for c in LEAF])
    lower = merkle.digest_of([F.translate("text", CAPITALS, SMALL) if c == "text" else F.col(c) for c in LEAF])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(leaf)
    hashed = stage(documents.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf.alias("leaf"), tampered.alias("tampered")), "merkle-hashed")
    m = merkle.manifest_of_leaves(hashed)
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    return merkle.proofs(m).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(m.root).alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == m.root)


#: CRC-32 of a decimal number in DuckDB: a step for each byte, eight for its bits.
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _leaf_sql(text: str) -> str:
    values = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLE["op11_merkle"] = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE {_leaf_sql("text")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM h),
nodes AS (
  SELECT 0 AS level, source, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY level, source, idx // 16, n),
sub AS (SELECT source, level, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, n, digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16, n),
beside AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1
  GROUP BY a.source, a.level, a.idx),
beside_top AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.level, a.idx),
climb AS (
  SELECT 0 AS level, row_number() OVER () AS k, doc_id, source, leaf, idx, changed AS own, '' AS proof FROM leaves
  UNION ALL
  SELECT c.level + 1, k, doc_id, c.source, leaf, c.idx // 16, sha256(l || own || r), proof || l || r
  FROM climb c JOIN beside b ON c.source IS NOT DISTINCT FROM b.source AND c.level = b.level AND c.idx = b.idx),
peak AS (
  SELECT 0 AS level, k, doc_id, c.source, leaf, s.digest AS subroot, s.idx, own, proof
  FROM climb c JOIN sub s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level
  UNION ALL
  SELECT p.level + 1, k, doc_id, source, leaf, subroot, p.idx // 16, sha256(l || own || r), proof || l || r
  FROM peak p JOIN beside_top b ON p.level = b.level AND p.idx = b.idx)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = t.digest AS verified
FROM peak p JOIN top t ON p.level = t.level AND t.n = 1"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY part, good, toxic, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, range(1, 6) r(step)),
r AS (
  SELECT c.part, s.filter_order, CAST(s.step AS INTEGER) AS step, s.bit,
    CAST(sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""


#: A conversation of control strings, which op13 formats besides the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    formatted = chat.formatted_table(rows.unionByName(scale.local_table(spark, CONTROL_CHAT, rows.schema)))
    return chat.digests(formatted).withColumnRenamed("id", "conv_id")


ORACLE["op13_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(\[(?:/INST\]|INST\])|</?s>|<</?(?:SYS|ROLE)>>|<</TURN>>|\\)', chr(1) || '\1', 'g') AS marked FROM c),
s AS (SELECT *, length(marked) AS escaped FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 26 + length(role) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""
