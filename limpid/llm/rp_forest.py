"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits recursively by random projections; vectors near a threshold go to both sides.  The
thresholds are fitted on a bounded sample, so a vector's leaves are a pure function of the vector and every task can
recompute them.  Vectors are compared exactly within leaves, and a pair that shares several leaves is counted in the
first one only; so link counts are exact sums and no pair is ever emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import partitions, python_stages, stage
from limpid.llm.components import components
from limpid.llm.simhash import Forest as Links

#: Vectors that fit the thresholds, chosen by hash: at most this many, and at most this many bytes of floats.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
TREES, LEAF = 6, 512
#: The spill margin, in standard deviations of the projected difference of two vectors at the threshold.
MARGIN = 0.6
#: Where a node may be split, and the largest share of it that one side may get.
QUANTILES, LARGEST_SIDE = np.arange(0.1, 0.91, 0.1), 0.85
#: Members of a leaf that are compared in one piece; larger leaves are split into pairs of blocks.
BLOCK = 4096
#: A node's own threshold needs this many sample vectors; deeper nodes use the threshold of their level.
NODE_SAMPLE = 16
TREE_SHIFT = 44


@dataclass
class Level:
    """Thresholds and margins of a level's nodes; one entry means the same for all nodes."""

    threshold: np.ndarray
    margin: np.ndarray

    def of(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = path if len(self.threshold) > 1 else np.zeros_like(path)
        return self.threshold[at], self.margin[at]


class Tree:
    """Random directions, one for each level, and the levels' thresholds."""

    def __init__(self, dim: int, seed: list[int], margin: float):
        self.dim, self.seed, self.margin, self.levels = dim, seed, margin, []

    def directions(self) -> np.ndarray:
        d = np.random.default_rng(self.seed).standard_normal((max(1, len(self.levels)), self.dim))
        return d / np.linalg.norm(d, axis=1, keepdims=True)

    def fit(self, sample: np.ndarray, rows: int, depth: int | None = None) -> Tree:
        """Add levels until a leaf is expected to hold LEAF of `rows` vectors, or up to `depth`."""
        rng = np.random.default_rng(self.seed)
        index, path = np.arange(len(sample)), np.zeros(len(sample), np.int64)
        while len(self.levels) < depth if depth is not None else self._expected(index, sample, rows) > LEAF and len(self.levels) < 36:
            d = rng.standard_normal(self.dim)
            p = sample[index] @ (d / np.linalg.norm(d))
            level = self._level(p, path, 1 << len(self.levels))
            self.levels.append(level)
            index, path = _step(index, path, p, level)
        return self

    def _expected(self, index: np.ndarray, sample: np.ndarray, rows: int) -> float:
        copies = len(index) / len(sample) if len(sample) else 1.3 ** len(self.levels)
        return rows * copies / (1 << len(self.levels))

    def _level(self, p: np.ndarray, path: np.ndarray, nodes: int) -> Level:
        def cut(values):
            """The threshold, of nine quantiles, whose larger side is smallest; none where that side keeps nearly all,
            as in a node that is one dense cluster: all its vectors then stay together."""
            if not len(values):
                return 0.0, self.margin
            v = np.sort(values)
            at = np.quantile(v, QUANTILES)
            larger = np.maximum(np.searchsorted(v, at + self.margin), len(v) - np.searchsorted(v, at - self.margin)) / len(v)
            best = int(larger.argmin())
            return (at[best], self.margin) if larger[best] <= LARGEST_SIDE else (np.inf, 0.0)

        if nodes * NODE_SAMPLE > 2 * len(p) or nodes == 1:
            return Level(*[np.array([x]) for x in cut(p)])
        default = cut(p)
        order = np.argsort(path, kind="stable")
        starts = np.searchsorted(path[order], np.arange(nodes + 1))
        found = [cut(p[order[a:b]]) if b - a >= NODE_SAMPLE else default for a, b in zip(starts, starts[1:])]
        return Level(np.array([x for x, _ in found]), np.array([x for _, x in found]))

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of all rows."""
        p = unit @ self.directions().T
        index, path = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for k, level in enumerate(self.levels):
            index, path = _step(index, path, p[index, k], level)
        return index, path


def _step(index, path, p, level: Level):
    threshold, margin = level.of(path)
    left, right = p < threshold + margin, p >= threshold - margin
    return np.concatenate([index[left], index[right]]), np.concatenate([2 * path[left], 2 * path[right] + 1])


def fit_forest(sample: np.ndarray, dim: int, rows: int, min_cosine: float, seed: int = 7) -> list[Tree]:
    """Trees over unit vectors.  A table that fits one leaf gets one tree without levels, which compares all pairs."""
    margin = MARGIN * math.sqrt(2 - 2 * min_cosine) / math.sqrt(dim)
    first = Tree(dim, [seed, 0, dim], margin).fit(sample, rows)
    depth = len(first.levels)
    return [first, *(Tree(dim, [seed, t, dim], margin).fit(sample, rows, depth) for t in range(1, TREES))] if depth else [first]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, as squares of very large or small components leave the range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- filing ------------------------------------------------------------------------------------

def _each_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    if len(np.unique(lengths)) <= 1:
        if len(lengths):
            yield batch
        return
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def _cells(trees: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = unit(vectors)
    routed = [(t, *tree.route(u)) for t, tree in enumerate(trees)]
    return np.concatenate([i for _, i, _ in routed]), np.concatenate([(t << TREE_SHIFT) + leaf for t, _, leaf in routed])


def _file(distinct: DataFrame, forests, hot: dict[tuple[int, int], int]) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(hot)
    kind = distinct.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = shared.value
        for whole in batches:
            for batch in _each_length(whole, "vec"):
                vectors = matrix(batch.column("vec"))
                dim = vectors.shape[1]
                index, cell = _cells(forests.value[dim], vectors)
                part, side = np.zeros(len(cell), np.int64), np.full(len(cell), 2)
                for (d, c), count in split.items():
                    if d != dim or not (members := np.flatnonzero(cell == c)).size:
                        continue
                    block = batch.column("node").to_numpy()[index[members]] % count
                    other = np.tile(np.arange(count), len(members))
                    block, at = np.repeat(block, count), np.repeat(members, count)
                    low, high = np.minimum(block, other), np.maximum(block, other)
                    keep = np.ones(len(cell), bool)
                    keep[members] = False
                    index, cell = np.concatenate([index[keep], index[at]]), np.concatenate([cell[keep], cell[at]])
                    part = np.concatenate([part[keep], low * count + high])
                    side = np.concatenate([side[keep], np.where(low == high, 2, (block == high).astype(int))])
                for at in range(0, len(index), 1 << 14):
                    some = slice(at, at + (1 << 14))
                    rows = batch.take(pa.array(index[some]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.num_rows, dim)), pa.array(cell[some]), pa.array(part[some]), pa.array(side[some].astype(np.int32)),
                         rows.column("node"), rows.column("n"), rows.column("vec")], names=["dim", "cell", "part", "side", "node", "n", "vec"])

    return distinct.select("node", "n", "vec").mapInArrow(run, f"dim long, cell long, part long, side int, node long, n long, vec {kind}")


def _hot_leaves(distinct: DataFrame, forests, rows: int) -> dict[tuple[int, int], int]:
    """{(dim, cell): blocks} of the leaves above BLOCK members and 1 / (8 x shuffle partitions) of all memberships, so
    at most 8 x shuffle partitions of them."""
    if rows <= BLOCK:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _each_length(whole, "vec"):
                vectors = matrix(batch.column("vec"))
                cell, n = np.unique(_cells(forests.value[vectors.shape[1]], vectors)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), vectors.shape[1])), pa.array(cell), pa.array(n)], names=["dim", "cell", "n"])

    counts = stage(distinct.select("vec").mapInArrow(run, "dim long, cell long, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")), "leaf-sizes")
    members = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(BLOCK, members // (8 * partitions(distinct.sparkSession)))
    return {(r["dim"], r["cell"]): math.ceil(r["n"] / limit) for r in counts.where(F.col("n") > limit).collect()}


# --- comparison --------------------------------------------------------------------------------

def _close(v, norm, side, rows: slice, min_cosine: float) -> np.ndarray:
    """(rows, all): linked, without a row's link to itself."""
    close = (v[rows] @ v.T) / (norm[rows, None] * norm[None, :]) >= min_cosine
    if side[0] != 2:
        close &= side[rows, None] != side[None, :]
    close[np.arange(len(close)), np.arange(len(v))[rows]] = False
    return close


def _leaves_before(trees: list[Tree], u: np.ndarray, cell: int) -> list[list[np.ndarray]]:
    """Sorted members of every leaf of earlier trees, and of every earlier leaf of the cell's own tree."""
    tree, leaf = cell >> TREE_SHIFT, cell & ((1 << TREE_SHIFT) - 1)
    out = []
    for t in range(tree + 1):
        index, path = trees[t].route(u)
        if t == tree:
            index, path = index[path < leaf], path[path < leaf]
        order = np.lexsort((index, path))
        out += np.split(index[order], np.flatnonzero(np.diff(path[order])) + 1)
    return [m for m in out if len(m) > 1]


def compare_leaf(trees: list[Tree], cell: int, side: np.ndarray, weight: np.ndarray, vectors: np.ndarray, min_cosine: float) -> tuple[np.ndarray, list]:
    """(links that each row gets here, pairs of rows that connect all that are linked here).

    A link is counted in the first leaf that both rows share; it connects them in every leaf.  Memory grows with the
    members, not with their links."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1)
    chunks = [slice(at, at + 512) for at in range(0, len(v), 512)]
    linked = np.flatnonzero(np.concatenate([_close(v, norm, side, rows, min_cosine).any(axis=1) for rows in chunks]))
    counts = np.zeros(len(v), np.int64)
    if not len(linked):
        return counts, []
    v, norm, side, weight = v[linked], norm[linked], side[linked], weight[linked].astype(np.float64)
    earlier = _leaves_before(trees, unit(v), cell)
    for at in range(0, len(v), 512):
        new = _close(v, norm, side, slice(at, at + 512), min_cosine)
        for members in earlier:
            low, high = np.searchsorted(members, [at, at + 512])
            if low < high:
                new[np.ix_(members[low:high] - at, members)] = False
        counts[linked[at : at + 512]] = (new @ weight).astype(np.int64)
    pairs, left = [], np.arange(len(v))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            close = (v[left] @ v[one]) / (norm[left] * norm[one]) >= min_cosine
            if side[0] != 2:
                close &= side[left] != side[one]
            found, left = left[close], left[~close]
            queue.extend(found.tolist())
            pairs.extend((int(linked[one]), int(x)) for x in linked[found])
    return counts, pairs


def _compare(forests, min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, rest = Links(), None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            now = table.to_batches()[0]
            key = np.stack([now.column(c).to_numpy() for c in ("dim", "cell", "part")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], cut])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield from one(links, now.slice(a, b - a))
            rest = now.slice(int(starts[-1]))
        if rest is not None and rest.num_rows:
            yield from one(links, rest)

    def one(links: Links, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        vectors, node = matrix(rows.column("vec")), rows.column("node").to_numpy()
        counts, pairs = compare_leaf(forests.value[vectors.shape[1]], rows.column("cell")[0].as_py(), rows.column("side").to_numpy(), rows.column("n").to_numpy(), vectors, min_cosine)
        some = np.flatnonzero(counts)
        new = [(a, b) for a, b in ((int(node[i]), int(node[j])) for i, j in pairs) if links.join(a, b)]
        a = np.concatenate([node[some], [x for x, _ in new]]).astype(np.int64)
        b = pa.array([None] * len(some) + [x for _, x in new], pa.int64())
        w = np.concatenate([counts[some], np.zeros(len(new), np.int64)]).astype(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(w)], names=["a", "b", "links"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id), one row per input row.

    n_links: other rows with cosine >= `min_cosine` (in double precision) that the forest finds.  component_id: the
    smallest id reachable over links, the row's own included.  Vectors that are null, empty or zero or that hold a null
    or non-finite component link with nothing, and vectors of different lengths do not link.  Equal vectors are
    compared once and counted as often as they occur.  Null ids are passed over in component_id; a component of null
    ids alone has null.  Rows with equal ids are separate vectors.

    The trees are fitted on at most SAMPLE vectors chosen by hash; every vector is filed in every tree.  A leaf with too
    many members is split into pairs of blocks, so no task holds more than two blocks and no pair of the leaf is
    missed."""
    spark = df.sparkSession
    python_stages(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = rows.where(good)
    distinct = stage(valid.groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
                     .withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = {r["d"]: r["n"] for r in distinct.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return _alone(rows)
    many = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(lengths))))
    sample: dict[int, list] = {d: [] for d in lengths}
    for r in distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(many).collect():
        sample[len(r["vec"])].append(r["vec"])
    forests = spark.sparkContext.broadcast({d: fit_forest(unit(np.array(sample[d]).reshape(-1, d)) if sample[d] else np.zeros((0, d)), d, n, min_cosine)
                                            for d, n in lengths.items()})
    filed = _file(distinct, forests, _hot_leaves(distinct, forests, max(lengths.values())))
    count = partitions(spark)
    found = stage(filed.repartition(count, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
                  .mapInArrow(_compare(forests, min_cosine), "a long, b long, links long"), "vector-links")
    groups = stage(components(found.where("b is not null").select("a", "b")), "vector-components")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    result = distinct.join(links, distinct["node"] == links["a"], "left").join(groups, "node", "left") \
        .select("vec", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    least = result.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = result.join(least, "root").select("vec", "n_links", "component_id")
    return valid.join(by_vector, "vec").select("id", "n_links", "component_id").unionByName(_alone(rows.where(~good)))


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
