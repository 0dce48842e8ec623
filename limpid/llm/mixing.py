"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every text is cut into blocks of words and every source gets an exact quota of blocks.  A binary tree over the output
shards splits the quotas: at each node the share of the left half is a multivariate-hypergeometric draw, as if the
mix had been shuffled as a whole.  A leaf knows how many blocks of each source it holds, so the shards draw disjoint
runs from each source's permutation and only shuffle locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.text import quote
from limpid.llm.common import python_stages, stage, words_pattern

#: No source gives more than this many times its size.
MOST_REPEATS = 3
#: Rows that one bucket of a source's permutation should hold.
BUCKET_ROWS = 1000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `cycle` again and again and share the sum of all sizes.  No target
    exceeds `repeats` times its source's size; what is above goes to the others by weight until none is above.  That
    fixed point is min(cap, level x weight) with one common level, found from running sums over the sources sorted by
    cap / weight.  The window without a partition sees one row per source.  An empty source has target 0."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighted = sizes.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle))) \
        .withColumn("cap", F.col("source_size").cast("double") * repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, in order of cap / weight, whose cap is not reached fixes the level for all after it.
    fixed = weighted.withColumns({"level": level, "place": F.row_number().over(by_level)}) \
        .withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    shared = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)
    return fixed.select("source", "source_size", F.least("cap", shared["level"] * F.col("weight")).alias("target"))


def draw_part(counts: np.ndarray, size: int, rng: np.random.Generator, largest: int = 10**9) -> np.ndarray:
    """Multivariate-hypergeometric draw of `size` out of `counts`, exact for totals of any size.

    The generator draws totals below 10^9 itself.  Above, every block joins by a coin, which makes a binomial count per
    source and a uniform subset for each total; the few blocks too many or too few, about the square root of the
    total, are then moved one by one, chosen uniformly without replacement."""
    if int(counts.sum()) < largest:
        return rng.multivariate_hypergeometric(counts, size, method="marginals")
    part = rng.binomial(counts, size / int(counts.sum()))
    excess = int(part.sum()) - size
    ends = np.cumsum(part if excess > 0 else counts - part)
    moved = np.empty(0, np.int64)
    while len(moved) < abs(excess):
        moved = np.unique(np.concatenate([moved, rng.integers(0, ends[-1], abs(excess) - len(moved))]))
    by_source = np.bincount(np.searchsorted(ends, moved, side="right"), minlength=len(counts))
    return part - by_source if excess > 0 else part + by_source


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) numbers of blocks.  Columns add up to `quotas`; shard sizes differ by one at most.

    Node draws depend on the seed and the node's first and last shard alone, so every rerun gives the same tree."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle, total = (low + high) // 2, int(own.sum())
        left_size = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = draw_part(own, left_size, rng)
        todo += [(low, middle, left), (middle, high, own - left)]
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block_words: int | None = 256,
        shard_words: int = 50_000_000, least_shards: int = 1, row_col: str | None = None, cycle: tuple[float, ...] = (1, 2, 3), repeats: int = MOST_REPEATS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: one row per input row: __row (long, unique; the column `row_col` if it is given), id, source, size (words; null text: 0), source_size,
    target.  draws: one row per drawn block and repeat: __row, id, source, block (from 0), words, repeat (from 0),
    shard, place (order within the shard).

    There are `least_shards` shards, or as many as hold `shard_words` words each.  A block has at most `block_words` words of one text (None: the whole text).  A source is taken whole as often as
    its target allows, then once more in a permuted order until the block that comes nearest to the target, so its
    words are within one block of the target and no document is taken more than `repeats` times.  Texts without words
    have no block.  Equal rows are separate documents.  The same input gives the same draws, however it is
    partitioned: all choices hash the id, the text and the seed; only rows equal in all of them are told apart by
    where they stand, and those are interchangeable.

    Permutations are ranked in buckets of about BUCKET_ROWS rows by hash range, so a source with a third of all rows
    is many buckets.  The driver sees one row per source and the tree's shards x sources counts.
    """
    spark = df.sparkSession
    row = quote(row_col) if row_col else F.monotonically_increasing_id()
    docs = stage(df.select(row.alias("__row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                           word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("__key")), "mix-documents")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(targets(sources, cycle, repeats), "mix-targets")
    by_source = {r["source"]: r for r in plan.collect()}
    names = sorted(by_source, key=lambda s: (s is None, s or ""))

    length = F.lit(block_words).cast("long") if block_words else F.col("size")
    cut = docs.where("size > 0").select("id", "__row", "__key", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / length) - 1)).alias("block"))
    cut = cut.withColumn("words", F.least(length, F.col("size") - F.col("block") * length)).drop("size")
    # Whole turns of a source need no order among its blocks; the last, partial turn takes the front of a permutation.
    fractions = {}
    for name, r in by_source.items():
        size = int(r["source_size"] or 0)
        turns = min(repeats, math.floor(r["target"] / size + 1e-12)) if size else 0
        fractions[name] = (turns, max(0.0, r["target"] - turns * size) if turns < repeats else 0.0, size)
    table = spark.createDataFrame([(i, n, *fractions[n]) for i, n in enumerate(names)], "number int, source string, turns int, rest double, source_words long")
    ranked = stage(_ranked(cut.join(F.broadcast(table), cut["source"].eqNullSafe(table["source"])).drop(table["source"])), "mix-blocks")
    taken = ranked.withColumn("drawn_turns", F.col("turns") + F.col("last").cast("int"))
    counts = {r["number"]: (r["whole"], r["extra"]) for r in
              taken.groupBy("number").agg(F.count(F.lit(1)).alias("whole"), F.sum(F.col("last").cast("long")).alias("extra")).collect()}
    quotas = np.array([fractions[n][0] * counts.get(i, (0, 0))[0] + counts.get(i, (0, 0))[1] for i, n in enumerate(names)], dtype=np.int64)
    words = sum(r["target"] for r in by_source.values()) if by_source else 0
    shards = max(least_shards, math.ceil(words / shard_words))
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if len(names) else np.zeros((shards, 0), np.int64)
    whole = {i: counts.get(i, (0, 0))[0] for i in range(len(names))}

    draws = taken.select("id", "__row", "__key", "source", "number", "block", "words", "rank", F.explode(F.sequence(F.lit(0), F.col("drawn_turns") - 1)).alias("repeat"),
                         "drawn_turns").where("drawn_turns > 0")
    shared = spark.sparkContext.broadcast((ends, whole))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, whole = shared.value
        for batch in batches:
            position = batch["repeat"].to_numpy(np.int64) * batch["number"].map(whole).to_numpy(np.int64) + batch["rank"].to_numpy(np.int64)
            number, shard = batch["number"].to_numpy(), np.zeros(len(batch), np.int32)
            for k in np.unique(number):
                shard[number == k] = np.searchsorted(ends[:, k], position[number == k], side="right")
            yield batch.drop(columns=["drawn_turns", "rank", "number"]).assign(shard=shard)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in draws.drop("drawn_turns", "rank", "number").schema)
    python_stages(spark)
    placed = draws.where("drawn_turns > 0").mapInPandas(place, f"{kind}, shard int") \
        .withColumn("place", F.xxhash64("__key", "block", "repeat", F.lit(seed + 1)))
    documents = docs.join(F.broadcast(plan), docs["source"].eqNullSafe(plan["source"])).select("__row", "__key", "id", docs["source"], "size", "source_size", "target")
    return documents, placed


def _ranked(cut: DataFrame) -> DataFrame:
    """Blocks with `rank` (0-based place in the source's permutation) and `last` (taken in the partial turn)."""
    # 2^20 fine hash cells hold about equally many blocks; a bucket is a run of cells with BUCKET_ROWS blocks.
    hashed = cut.withColumn("__h", F.xxhash64("__key", "block"))
    cells = F.shiftrightunsigned(F.col("__h"), 44)
    counts = cut.groupBy("number").agg(F.count(F.lit(1)).alias("__n"))
    buckets = F.least(F.lit(1 << 20), F.greatest(F.lit(1), F.ceil(F.col("__n") / BUCKET_ROWS)))
    rows = hashed.join(F.broadcast(counts), "number").withColumn("bucket", F.shiftright(cells * buckets, 20)).drop("__n")
    sums = rows.groupBy("number", "bucket").agg(F.count(F.lit(1)).alias("__rows"), F.sum("words").alias("__words"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__r0"),
                         F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__w0"))
    inside = Window.partitionBy("number", "bucket").orderBy("__h", "__key", "block", "__row")
    ordered = rows.withColumns({"__i": F.row_number().over(inside), "__w": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    joined = ordered.join(starts, ["number", "bucket"])
    # A block is in if its middle lies before the target, which leaves at most half a block too much or too little.
    start = F.col("__w0") + F.coalesce("__w", F.lit(0))
    return joined.select("id", "__row", "__key", "source", "number", "block", "words", "turns", (F.col("__r0") + F.col("__i") - 1).alias("rank"),
                         (start + F.col("words") / 2 <= F.col("rest")).alias("last"))


def taken_words(documents: DataFrame, draws: DataFrame) -> DataFrame:
    """`documents` with taken (long): words of the document that the mix holds, repeats counted; and shards (array of
    int): the output shards that hold them, ascending."""
    words = draws.groupBy("__row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    none = F.array().cast("array<int>")
    return documents.join(words, "__row", "left").withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "shards": F.coalesce("shards", none)})


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of `df`: every whole document as often as it was drawn (a block is a text), shuffled by shard."""
    own, row = df.columns, "__number"
    while row in own:
        row += "_"
    rows = stage(df.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    draws = mix(rows, id_col, text_col, source_col, block_words=None, row_col=row, **options)[1]
    times = draws.groupBy(F.col("__row").alias(row)).agg(F.collect_list(F.struct("shard", "place")).alias("__copies"))
    return rows.join(times, row).withColumn("__copy", F.explode("__copies")) \
        .repartition("__copy.shard", F.pmod(F.col("__copy.place"), F.lit(64))).sortWithinPartitions("__copy.shard", "__copy.place").select(*own)
