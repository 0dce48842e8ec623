"""How filters interact: what each filter would remove in every order of applying them.

A document's mask has a bit for each filter that it fails.  Every mask is mapped to one big integer whose fields hold
the outcomes of all steps of all orders (five filters: 120 orders of five steps, 600 steps); adding such integers
counts all outcomes at once.  Documents are first counted by (part, mask, labels), so a part adds at most 2^filters x 4
products of an integer and a count.  A field is as wide as a count can be, so no sum carries into its neighbour.
"""

from __future__ import annotations

import functools
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.text import quote
from limpid.llm.common import SPACE, python_stages, stage

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "#$%&*|"

#: Width of a field.  A count of rows is a signed 64-bit number, so a sum of fields stays below 2^63.
FIELD = 64
#: What is counted at a step: removed here, failed but removed before, failed nothing else.
REMOVED, REDUNDANT, UNIQUE = range(3)
COUNTS = 3


def content_filters(text: Column) -> dict[str, Column]:
    """Letter -> does a text fail?  A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % of the code
    points are capitals A-Z; D: holds one of `#$%&*|`.  Words are runs of anything but ASCII white space."""
    # Splitting leaves an empty text before white space at the start and after white space at the end.
    pieces = F.split(text, f"[{SPACE}]+")
    head, tail = (F.get(pieces, 0) == "").cast("int"), ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    words = F.size(pieces) - head - tail
    distinct = F.size(F.array_distinct(pieces)) - F.greatest(head, tail)
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": words < LEAST_WORDS,
        "B": distinct.cast("long") * 100 < words.cast("long") * LEAST_DISTINCT,
        "C": capitals * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def mask_of(failures: list[Column]) -> Column:
    """Bit k is set if the k-th column is true; null counts as not failed."""
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failures)]
    return functools.reduce(lambda a, b: a + b, bits)


@functools.cache
def orders(letters: str) -> list[tuple[int, ...]]:
    return list(permutations(range(len(letters))))


@functools.cache
def outcomes(mask: int, letters: str) -> int:
    """The big integer of a mask: for each order and step the fields REMOVED, REDUNDANT and UNIQUE, each 0 or 1."""
    packed, at = 0, 0
    for order in orders(letters):
        gone = False
        for f in order:
            if mask >> f & 1:
                packed |= 1 << FIELD * (at + (REDUNDANT if gone else REMOVED))
                if mask == 1 << f:
                    packed |= 1 << FIELD * (at + UNIQUE)
                gone = True
            at += COUNTS
    return packed


def unpack(packed: int, letters: str) -> np.ndarray:
    """(orders, steps, COUNTS) counts of a sum of outcome integers."""
    shape = (len(orders(letters)), len(letters), COUNTS)
    return np.frombuffer(packed.to_bytes(int(np.prod(shape)) * FIELD // 8, "little"), "<u8").reshape(shape).astype(np.int64)


SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def part_table(classes: pd.DataFrame, letters: str) -> pd.DataFrame:
    """All steps of one part, from its classes (part, mask, good, toxic, n)."""
    every = good = toxic = 0
    for c in classes.itertuples():
        product = outcomes(int(c.mask), letters) * int(c.n)
        every += product
        good += product if c.good else 0
        toxic += product if c.toxic else 0
    counts, good_counts, toxic_counts = (unpack(x, letters) for x in (every, good, toxic))
    names = orders(letters)
    filters = np.array(names)
    removed = counts[:, :, REMOVED]
    shapley = np.zeros(len(letters), np.int64)
    np.add.at(shapley, filters, removed)
    return pd.DataFrame({
        "part": classes["part"].iloc[0],
        "filter_order": np.repeat(["".join(letters[f] for f in order) for order in names], len(letters)),
        "step": np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(names)),
        "kept": (int(classes["n"].sum()) - np.cumsum(removed, axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": counts[:, :, REDUNDANT].ravel(),
        "unique_fails": counts[:, :, UNIQUE].ravel(),
        "good_lost": good_counts[:, :, REMOVED].ravel(),
        "toxic_lost": toxic_counts[:, :, REMOVED].ravel(),
        "shapley": shapley[filters].ravel(),
    })


def audit_classes(classes: DataFrame, letters: str) -> DataFrame:
    """Every part's steps (SCHEMA) from classes (part string, mask, good boolean, toxic boolean, n long), each class once
    per part.  A group has 2^filters x 4 rows at most."""
    python_stages(classes.sparkSession)
    return classes.groupBy("part").applyInPandas(lambda rows: part_table(rows, letters), SCHEMA)


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good, toxic), one row per id: any row with quality = 1, any with toxic = 1.  Null ids are left out."""
    any_of = [F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where(quote(id_col).isNotNull()).groupBy(quote(id_col).alias("label_id")).agg(*any_of)


def document_classes(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters A to D and E, which a text fails that is identical to that
    of any smaller id in the whole table, whether that one is removed or not.

    Null texts and parts are empty ones.  A null id is not smaller than any id nor has it smaller ones; rows with equal
    ids are not smaller than each other.  Texts are compared by SHA-256.  Copies collapse in each task: those of a text
    that agree in part and labels are a count and a smallest id, so the copies of a frequent text never meet as rows.
    Other columns, whatever their names, are ignored."""
    text = F.coalesce(quote(text_col).cast("string"), F.lit(""))
    rows = df.select(quote(id_col).alias("id"), F.coalesce(quote(part_col).cast("string"), F.lit("")).alias("part"),
                     F.unhex(F.sha2(text, 256)).alias("digest"), mask_of(list(content_filters(text).values())).alias("mask"))
    # The texts are read once; what follows has one short row per document.
    rows = stage(rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-masks")
    flags = label_flags(labels, id_col)
    known = rows.where("id is not null").join(flags, F.col("id") == F.col("label_id"), "left").drop("label_id")
    unknown = rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    labelled = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(unknown)
    copies = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    copies = stage(copies, "audit-copies")
    # One row per part and labels at most meets here for a text.
    first = copies.groupBy(F.col("digest").alias("text")).agg(F.min("least.id").alias("first"))
    found = copies.join(first, F.col("digest") == F.col("text"))
    passing = F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n"))))
    classes = found.select("part", "good", "toxic", split.alias("class")).where("class.n > 0")
    return classes.groupBy("part", F.col("class.mask").alias("mask"), "good", "toxic").agg(F.sum("class.n").alias("n"))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What filters A to E remove of each part in each of their 120 orders, step by step: SCHEMA, one row per part,
    order and step.  kept: left after this step; removed: by it; redundant: fail it, but were removed earlier;
    unique_fails: fail this filter only; good_lost and toxic_lost: removed here with quality 1 and with toxic 1;
    shapley: removed by its filter, summed over all orders.  An empty table has no parts and no rows."""
    return audit_classes(document_classes(df, labels, id_col, text_col, part_col), "ABCDE")
