"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs.  All
but the last keep the columns of `documents`; other columns of that table pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from limpid.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from limpid.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below the threshold.  The labels are a table of `sf_dir`."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.drop_flagged(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that is equal but for white space: the longest, then the one with the least id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard index of 0.8 or more over 5-word shingles: the one with the
    least id.  Candidates come from SimHash fingerprints, linked as in op2 (here of 5-word shingles), and also from MinHash
    bands, as fingerprints alone miss most of these pairs at any radius that their grid can serve (figures in the README)."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources draws them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (ids, n_tokens) and digests, after decoding the ids."""
    decoded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.with_digests(decoded).drop("text", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Models, fingerprints and token ids have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
