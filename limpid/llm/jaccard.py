"""Near copies by the exact Jaccard index of word shingles.

Candidates are documents whose SimHash fingerprints are connected over simhash.RADIUS bits (grid of segment counts), and
documents that agree in one of BANDS bands of MinHash values: within a radius that the grid can serve, fingerprints alone
miss most pairs at an index of 0.8 (README), bands miss one with a chance of (1 - 0.8^4)^16 = 0.0002.  Every candidate is
linked only if the shingle sets themselves reach the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm import simhash
from limpid.llm.common import python_stages, stage
from limpid.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS, BAND_ROWS = 16, 4
#: Shingles (8 bytes each) of the members of a bucket that a task holds in one block, about.
BLOCK_SHINGLES = 2 << 20
#: Row numbers that are broadcast at most; beyond that the join is shuffled.
BROADCAST_ROWS = 200_000

_MASKS, _FACTORS = np.random.default_rng(8).integers(0, 2**64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct xxHash64 values (uint64, ascending) of the text's runs of `shingle` words, in ASCII lower case.  A
    shorter text is one shingle; null and blank texts have the empty one."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words]) if words else np.ones(1, np.int64)
    last = (ends[min(shingle, len(ends)) - 1 :] - 1).tolist()
    first = [0, *ends.tolist()]
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(first, last)]), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key of every band of MinHash values."""
    least = np.full(len(_MASKS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[at : at + (1 << 12)] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def _keys(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, n, fp, keys) of (row, text): n shingles, the SimHash fingerprint as a signed long, and a key per band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            prints = np.array([simhash.fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "fp", "keys"])

    return texts.mapInArrow(run, "row long, n int, fp long, keys array<long>")


def _print_keys(keys: DataFrame) -> DataFrame:
    """(row, n, key) of (row, n, fp): one key for all fingerprints that are connected over links of at most simhash.RADIUS
    bits."""
    distinct = stage(keys.select("fp").distinct(), "near-fingerprints")
    groups = stage(components(simhash.near_links(distinct)), "near-fingerprint-groups")
    return keys.join(some(groups), keys["fp"] == groups["node"], "left") \
        .select("row", "n", F.xxhash64(F.coalesce("component", "fp"), F.lit("simhash")).alias("key"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, hashes) of (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "hashes"])

    return texts.mapInArrow(run, "row long, hashes array<long>")


def some(rows: DataFrame) -> DataFrame:
    """The rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the index."""
    pairs = stage(pairs, "near-candidates")
    involved = stage(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "near-involved")
    sets = stage(_sets(texts.join(some(involved), "row", "left_semi").select("row", "text"), shingle), "near-sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a") \
        .join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b"), "near-links")


def near_groups(texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(node, component): connected components over pairs of (row long, text string) with a Jaccard index of `least` or
    more, for rows that have such a pair; rows are unique.

    A bucket holds the rows of one group of connected fingerprints, or of one band key.  Members of a bucket are first compared with its least one.  What that joins is a component; then members outside the
    component of their bucket's least one are compared with all members of other components, block by block inside
    tasks.  Every two members of a bucket are so compared or known to be connected, and no pairs are made into rows."""
    python_stages(texts.sparkSession)
    found = stage(_keys(texts.select("row", "text"), shingle), "near-keys")
    keys = stage(_print_keys(found.select("row", "n", "fp")), "near-print-keys").unionByName(found.select("row", "n", F.explode("keys").alias("key")))
    buckets = keys.groupBy("key").agg(F.min("row").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = stage(keys.join(buckets, "key").where("row <> center"), "near-members")
    links = _verified(texts, members.select(F.col("center").alias("a"), F.col("row").alias("b")).distinct(), shingle, least)
    groups = stage(components(links), "near-components")
    own = groups.select(F.col("node").alias("row"), F.col("component").alias("own"))
    of_center = groups.select(F.col("node").alias("center"), F.col("component").alias("of_center"))
    placed = stage(members.join(own, "row", "left").join(of_center, "center", "left")
                   .select("key", "row", "n", F.coalesce("own", "row").alias("own"), F.coalesce("of_center", "center").alias("of_center")), "near-placed")
    strays = placed.where("own <> of_center")
    if strays.isEmpty():
        return groups
    # Every row of `placed` has a document with a partner, so the sets are those of the members of buckets.
    involved = stage(placed.select("row").distinct(), "near-involved")
    sets = stage(_sets(texts.join(some(involved), "row", "left_semi").select("row", "text"), shingle), "near-sets")
    return stage(components(links.unionByName(_cross_links(placed, sets, least))), "near-components")


def _cross_links(placed: DataFrame, sets: DataFrame, least: float, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links that join the strays of every bucket with members of other components, by comparison of each with
    all of them inside a task.  Only links that join something new are emitted, never pairs.

    A bucket whose sets are above `block` is dealt to pairs of a block of strays and a block of members."""
    stray = F.col("own") != F.col("of_center")
    sizes = placed.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.when(stray, F.col("n"))).alias("stray")).where("stray is not null") \
        .select("key", F.ceil(F.col("all") / block).cast("int").alias("wide"), F.ceil(F.col("stray") / block).cast("int").alias("high"))
    rows = placed.select("key", "row", "n", "own", stray.alias("is_stray")).join(sizes, "key")
    spread = F.xxhash64("row")
    column, line = F.pmod(spread, F.col("wide")).cast("int"), F.pmod(spread, F.col("high")).cast("int")
    members = rows.select("key", "row", "own", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), column.alias("j"), "wide")
    strays = rows.where("is_stray").select("key", "row", "own", F.lit(1).alias("side"), line.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), "wide")
    filed = members.unionByName(strays).select("key", (F.col("i") * F.col("wide") + F.col("j")).alias("part"), "side", "row", "own").join(sets, "row") \
        .select("key", "part", "side", "row", "own", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            key, part, side, row, own = (c.to_numpy() for c in batch.columns[:5])
            lists = batch.column("hashes")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i in range(len(row)):
                if (key[i], part[i]) != at:
                    yield from _joined(group, least)
                    at, group = (key[i], part[i]), []
                group.append((int(side[i]), int(row[i]), int(own[i]), values[offsets[i] : offsets[i + 1]]))
        yield from _joined(group, least)

    return filed.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def _joined(group: list[tuple], least: float) -> Iterator[pa.RecordBatch]:
    """Links of one group of (side, row, component, hashes) between strays (side 1) and members (side 0)."""
    members, strays = [g for g in group if not g[0]], [g for g in group if g[0]]
    if not strays or not members:
        return
    row, own, size = (np.array([x(m) for m in members]) for x in (lambda m: m[1], lambda m: m[2], lambda m: len(m[3])))
    ends = np.cumsum(size)
    flat, first = np.concatenate([m[3] for m in members]), ends - size
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            x = p
        return x

    links = []
    for _, s_row, s_own, hashes in strays:
        # Sizes alone rule out an index below min / max.
        n = len(hashes)
        near = np.flatnonzero((own != s_own) & (np.minimum(size, n) >= least * np.maximum(size, n) - 1e-6))
        if not len(near):
            continue
        some = flat if len(near) == len(row) else np.concatenate([flat[first[k] : ends[k]] for k in near])
        found = hashes[np.minimum(np.searchsorted(hashes, some), n - 1)] == some
        common = np.add.reduceat(found, np.cumsum(size[near]) - size[near], dtype=np.int64)
        for k in near[common / (size[near] + n - common) >= least].tolist():
            a, b = root(s_own), root(int(own[k]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((s_row, int(row[k])))
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links]), pa.array([b for _, b in links])], names=["a", "b"])


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of `df` whose id is the least of their component (null last), with their own columns.  Of rows with that
    id one stays, and of a component of null ids one.  Null, empty and blank texts are copies of each other."""
    own = df.columns
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    groups = near_groups(rows.select(F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text")), shingle, least)
    # A component's least id decides, then its first row; both come from one aggregate, combined before the shuffle.
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row")))["__row"]
    grouped = groups.withColumnRenamed("node", "__row").withColumnRenamed("component", "__component")
    ids = rows.select("__row", id_col).join(some(grouped.select("__row", F.col("__component").alias("__group"))), "__row")
    keep = ids.groupBy("__group").agg(first.alias("__row")).select("__row")
    gone = stage(grouped.select("__row").join(keep, "__row", "left_anti"), "near-gone")
    return rows.join(some(gone), "__row", "left_anti").select(own)
