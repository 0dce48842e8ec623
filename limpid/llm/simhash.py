"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its 2-bit segments.  Flipping a bit moves that vector by one
step, so the Manhattan distance of two vectors is a lower bound of the Hamming distance of the fingerprints.  Two
fingerprints within RADIUS bits agree, in one half of the vector, up to RADIUS // 2 = 2 steps, and then some grid
point lies within one step of both.  Each fingerprint is therefore filed under the grid points within one step of each
of its halves, and fingerprints that meet at a point are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import partitions, python_stages, stage
from limpid.llm.components import components

#: Fingerprints with at most this many differing bits are linked.  The grid is built for it.
RADIUS = 4
SHINGLE = 4
SEED = 42
SEGMENT, HALF = 2, 32
#: Members of one grid point that are compared in one piece; larger points are split into pairs of blocks.
BLOCK = 4096


# --- fingerprints ------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included.  Null and blank texts give zero."""
    words = (text or "").encode().lower().split()  # bytes.lower() and split() know A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends.tolist()]
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(first, last)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long, one row per input row."""
    python_stages(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    kind = df.schema[id_col].dataType
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))


# --- grid --------------------------------------------------------------------------------------

def half_vectors(fp: np.ndarray) -> np.ndarray:
    """(n, 2) base-4 packed bit counts of the 16 segments of each half."""
    fp = fp.view(np.uint64)
    pairs = (fp & np.uint64(0x5555555555555555)) + ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return np.stack([pairs >> np.uint64(HALF), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, cell) of every grid point within one step of a half; bit 32 of a cell tells the half."""
    halves, index, out = half_vectors(fp), [], []
    everyone = np.arange(len(fp))
    for h in range(2):
        own, side = halves[:, h], np.int64(h) << np.int64(HALF)
        index.append(everyone)
        out.append(own | side)
        for segment in range(HALF // SEGMENT):
            shift = np.int64(2 * segment)
            count = (own >> shift) & 3
            for step, allowed in ((1, count < SEGMENT), (-1, count > 0)):
                index.append(everyone[allowed])
                out.append((own[allowed] + (np.int64(step) << shift)) | side)
    return np.concatenate(index), np.concatenate(out)


def _file_cells(distinct: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(cell, part, side, fp).  A cell in `blocks` has that many blocks; its members go to every pair of blocks that
    contains their own.  side 0 and 1 tell the two blocks of a pair apart, 2 marks a single block."""
    shared = distinct.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = shared.value
        hot = np.array(sorted(split), dtype=np.int64)
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            index, cell = cells(fp)
            is_hot = np.isin(cell, hot)
            yield pd.DataFrame({"cell": cell[~is_hot], "part": 0, "side": 2, "fp": fp[index[~is_hot]]})
            own_cells, own_fp = cell[is_hot], fp[index[is_hot]]
            for c in np.unique(own_cells):
                members, count = own_fp[own_cells == c], split[c]
                block = (members.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count
                for other in range(count):
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    yield pd.DataFrame({"cell": c, "part": low * count + high, "side": np.where(low == high, 2, (block == high).astype(int)), "fp": members})

    return distinct.select("fp").mapInPandas(run, "cell long, part long, side int, fp long")


def _hot_cells(distinct: DataFrame, n: int) -> dict[int, int]:
    """{cell: blocks} for the grid points to split.  A full point lies next to a half vector that many fingerprints
    share; there are at most 16 x shuffle partitions such vectors, with 33 points each, and only these are counted."""
    spark = distinct.sparkSession
    limit = max(BLOCK // 33, math.ceil(n / (8 * partitions(spark))))
    if n <= BLOCK:
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            halves = half_vectors(batch["fp"].to_numpy(np.int64))
            yield pd.DataFrame({"cell": np.concatenate([halves[:, 0], halves[:, 1] | (1 << HALF)])})

    full = distinct.select("fp").mapInPandas(run, "cell long").groupBy("cell").count().where(F.col("count") > limit).collect()
    if not full:
        return {}
    # Only points within one step of a full half vector can be hot; count those exactly.
    bases = np.array([r["cell"] for r in full], dtype=np.int64)
    near = set()
    for base in bases.tolist():
        near.add(base)
        for segment in range(HALF // SEGMENT):
            count = base >> (2 * segment) & 3
            near |= {base + (s << (2 * segment)) for s, ok in ((1, count < SEGMENT), (-1, count > 0)) if ok}
    shared = spark.sparkContext.broadcast(np.array(sorted(near), dtype=np.int64))

    def count_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = cells(batch["fp"].to_numpy(np.int64))[1]
            yield pd.DataFrame({"cell": cell[np.isin(cell, shared.value)]})

    found = distinct.select("fp").mapInPandas(count_near, "cell long").groupBy("cell").count().where(F.col("count") > BLOCK).collect()
    return {r["cell"]: math.ceil(r["count"] / BLOCK) for r in found}


# --- exact comparison --------------------------------------------------------------------------

class Forest:
    """Union-find over the fingerprints that a task meets; remembers only links that join something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connect(fp: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect all fingerprints within RADIUS, by breadth-first search: a member that has been reached is
    compared with those not reached yet, so a dense group costs little more than its size.  With two sides, members
    of the same side are compared by their own part."""
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(fp[left] ^ fp[at]) <= RADIUS
            if side[at] != 2:
                close &= side[left] != side[at]
            found, left = left[close], left[~close]
            queue.extend(found.tolist())
            yield from ((int(fp[at]), int(x)) for x in fp[found])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (cell, part, side, fp) rows; a group of rows with one (cell, part) may span batches."""
    forest, rest = Forest(), None

    def links(cell, part, side, fp):
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        first, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(cell)]]))
        # Small groups: compare rows k apart, all groups at once.
        group = np.repeat(np.arange(len(first)), size)
        small = np.repeat(size <= 32, size)
        index = np.flatnonzero(small)
        for k in range(1, int(size[size <= 32].max(initial=1))):
            a, b = index[:-k], index[k:]
            ok = (group[a] == group[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS)
            yield from zip(fp[a[ok]].tolist(), fp[b[ok]].tolist(), strict=True)
        for at, n in zip(first[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            yield from connect(fp[at : at + n], side[at : at + n])

    def batch_of(found) -> pa.RecordBatch:
        new = [(a, b) for a, b in found if forest.join(a, b)]
        pairs = np.array(new, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[3] = now[3].view(np.uint64)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        open_from = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])).max(initial=-1)) + 1
        rest = [x[open_from:] for x in now]
        if open_from:
            yield batch_of(links(*[x[:open_from] for x in now]))
    if rest is not None and len(rest[0]):
        yield batch_of(links(*rest))


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between fingerprints at most RADIUS bits apart to connect all that are linked.

    `distinct` has each fingerprint (column fp, signed long) once.  A grid point with more than BLOCK members, next to
    a half vector that more than 1 / (8 x shuffle partitions) of the fingerprints share, is split into pairs of blocks
    that are compared apart, so no pair is missed.  Any other point holds at most BLOCK members or 33 / (8 x shuffle
    partitions) of all fingerprints."""
    n = distinct.count()
    filed = _file_cells(distinct, _hot_cells(distinct, n))
    count = partitions(distinct.sparkSession)
    return filed.repartition(count, "cell", "part").sortWithinPartitions("cell", "part", "fp").mapInArrow(_link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    fingerprint: 16 lowercase hex digits.  component_id: the smallest id reachable over links of at most RADIUS
    differing bits, the row's own included; null ids are passed over, and a component of null ids alone has null.
    Null, empty and blank texts have fingerprint zero and link like all others.  Fingerprints are computed once and
    written to the shared folder; equal ones are collapsed with map-side aggregation before any comparison."""
    prints = stage(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    groups = stage(components(near_links(distinct)), "simhash-components")
    grouped = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id is the least of their component, with their own columns.  Of rows with that id one
    stays, and of a component of null ids one."""
    own = df.columns
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    ids = near_duplicates(rows.select(F.col("__row").alias("r"), F.col(text_col).alias("t")), "r", "t") \
        .select(F.col("id").alias("__row"), F.col("component_id").alias("__component"))
    # A component's least id decides, then its first row; both come from one aggregate, combined before the shuffle.
    least = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row")))["__row"]
    keep = rows.select("__row", id_col).join(ids, "__row").groupBy("__component").agg(least.alias("__row")).select("__row")
    return rows.join(keep, "__row", "left_semi").select(own)
