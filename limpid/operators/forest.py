"""Random forest on rows dealt to tasks, grown level by level for all trees at once.

Every feature is cut into at most 32 bins.  A pass over the rows sums, in each task, what falls into every (node, feature,
bin); the sums meet by node, and only the chosen splits reach the driver.  A task walks its rows tree by tree, so that the
sums it adds to are those of one tree and stay in the processor's cache.  How often a row is in a tree's sample follows
from a hash of its key and the tree: no way of cutting the table into tasks changes the forest, but for the last bits of sums.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.operators import scale

# Workers get what this module defines with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
# Rows, chosen by hash, that the bounds of the bins come from; MLlib takes 10,000.  All rows are then binned.
_SAMPLE = 20_000
# Rows that are walked at once, and bytes of sums that a task holds: nodes beyond them take another pass over the rows.
_BLOCK, _SUMS = 1 << 17, 192 << 20
# Bytes of sums in one row of a shuffle.
_PIECE = 256 << 10
# A cut that no bin is above: all rows go left.
_LEAF = 255
# A gain below this share of what it is a difference of is rounding.
_ROUNDING = 1e-12


def poisson_table() -> np.ndarray:
    """Draws of a Poisson distribution with mean 1 for every value of 16 random bits."""
    mass = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(mass, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_POISSON = poisson_table()


def draws(keys: np.ndarray, seed: int, trees: list[int]) -> Iterator[np.ndarray]:
    """How often the rows of some keys (uint64) are in the sample of each tree: a draw with replacement of as many rows
    as there are.  Four trees share one hash (splitmix64) of a key."""
    drawn, z = None, None
    for tree in trees:
        if tree // 4 != drawn:
            drawn = tree // 4
            z = keys + np.uint64((seed * 0x632BE59BD9B4E019 + (drawn + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = (z ^ (z >> np.uint64(31))).view(np.uint16)
        yield _POISSON.take(z[tree % 4::4])


def cuts_of(sample: np.ndarray) -> np.ndarray:
    """Up to BINS - 1 cuts halfway between neighbouring values, so that the bins hold about equally many; a cut between
    any two values if there are few."""
    values, n = np.unique(sample[~np.isnan(sample)], return_counts=True)
    middle = values[:-1] / 2 + values[1:] / 2
    if len(values) > BINS:
        stride, upto, target, chosen = n.sum() / BINS, np.cumsum(n), n.sum() / BINS, []
        for i in range(1, len(values)):
            if abs(upto[i - 1] - target) < abs(upto[i] - target):
                chosen.append(i - 1)
                target += stride
        middle = middle[chosen[:BINS - 1]]
    return middle[~np.isnan(middle)]


def binned(cuts: list[np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    """(feature, row) -> bin; a value at a cut belongs below it."""
    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
    return np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])


def _walk(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place on its level, from the left, of the node that some rows reach in a tree."""
    flat, width = bins.reshape(-1), bins.shape[1]
    node = np.zeros(len(rows), np.intp)
    for level in range(levels):
        own = slice((1 << level) - 1, (2 << level) - 1)
        here = flat.take((feature[own] * width).take(node) + rows)
        node = 2 * node + (here > cut[own].take(node))
    return node


# --- one level ---------------------------------------------------------------------------------

@dataclass
class Level:
    """Nodes of one level that look for a split, in the order of trees.  A unit is a node's place among them."""

    level: int
    classes: int  # 0: the labels are numbers
    seed: int
    trees: np.ndarray  # of each unit
    nodes: np.ndarray  # place on the level
    features: np.ndarray  # (unit, k): features that may split it
    feature: np.ndarray  # (tree, node): the splits of the levels above
    cut: np.ndarray

    @property
    def spans(self) -> list[tuple[int, int, int]]:
        """(tree, first unit, end)"""
        trees, first = np.unique(self.trees, return_index=True)
        return list(zip(trees.tolist(), first.tolist(), [*first[1:].tolist(), len(self.trees)]))

    @property
    def shape(self) -> tuple[int, int, int]:
        """Sums of a unit: per feature, bin and either class or (rows, labels)."""
        return self.features.shape[1], BINS, self.classes or 2

    def part(self, first: int, end: int) -> Level:
        return Level(self.level, self.classes, self.seed, self.trees[first:end], self.nodes[first:end], self.features[first:end], self.feature, self.cut)


def _add_tree(sums: np.ndarray, at: Level, tree: int, first: int, end: int, drawn: np.ndarray, labels: np.ndarray, bins: np.ndarray) -> None:
    """Adds some rows to the sums of a tree's units: (k, unit and bin and class), or (k, rows or labels, unit and bin)."""
    rows = np.flatnonzero(drawn)
    units = np.full(1 << at.level, -1, np.intp)
    units[at.nodes[first:end]] = np.arange(end - first)
    unit = units.take(_walk(bins, rows, at.feature[tree], at.cut[tree], at.level))
    if end - first < 1 << at.level:
        seeking = np.flatnonzero(unit >= 0)
        rows, unit = rows.take(seeking), unit.take(seeking)
    n, y = drawn.take(rows).astype(np.float64), labels.take(rows)
    flat, width, size, start = bins.reshape(-1), bins.shape[1], (end - first) * BINS, unit * BINS
    other = y.astype(np.intp) if at.classes else n * y
    for k, into in enumerate(sums):
        own = at.features[first:end, k]
        cell = start + (bins[own[0]].take(rows) if (own == own[0]).all() else flat.take((own * width).take(unit) + rows))
        if at.classes:
            into += np.bincount(cell * at.classes + other, n, size * at.classes)
        else:
            into[0] += np.bincount(cell, n, size)
            into[1] += np.bincount(cell, other, size)


def level_sums(at: Level, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, sums: what this task has to add to the sums of the units from that one on."""
    spans, sums = at.spans, {}
    k, _, kinds = at.shape
    for batch in batches:
        for keys, labels, bins in zip(*(batch.column(name) for name in ("keys", "labels", "bins"))):
            keys, labels = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(labels.as_buffer(), np.float64)
            bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(keys))
            for (tree, first, end), drawn in zip(spans, draws(keys, at.seed, [s[0] for s in spans])):
                if tree not in sums:
                    size = (end - first) * BINS
                    sums[tree] = np.zeros((k, size * kinds) if at.classes else (k, kinds, size))
                _add_tree(sums[tree], at, tree, first, end, drawn, labels, bins)
    step = max(1, _PIECE // (math.prod(at.shape) * 8))
    for tree, first, end in spans:
        if tree in sums:
            found = sums.pop(tree)
            found = (found.reshape(k, end - first, BINS, kinds).transpose(1, 0, 2, 3) if at.classes else
                     found.reshape(k, kinds, end - first, BINS).transpose(2, 0, 3, 1))
            places = range(0, end - first, step)
            yield pa.RecordBatch.from_arrays([pa.array([first + p for p in places], pa.int64()),
                                              pa.array([found[p : p + step].tobytes() for p in places], pa.binary())], names=["unit", "sums"])


def best_splits(shape: tuple[int, int, int], classes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, k, cut, below, above: the split that gains most (Gini impurity or variance; the first of equals), and the
    sums of its sides; a unit that no split helps has cut 255 and all rows below it."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for unit, part in zip(batch.column("unit").to_pylist(), batch.column("sums")):
            part = np.frombuffer(part.as_buffer(), np.float64)
            sums[unit] = sums[unit] + part if unit in sums else part
    for unit, found in sums.items():
        found = found.reshape(-1, *shape)
        below = found.cumsum(axis=2)
        total = below[:, :, -1:]
        above = total - below

        def worth(side):
            n = side.sum(axis=-1) if classes else side[..., 0]
            squares = (side * side).sum(axis=-1) if classes else side[..., 1] ** 2
            return np.divide(squares, n, out=np.zeros_like(n), where=n > 0), n

        (low, n_low), (high, n_high), (whole, _) = worth(below), worth(above), worth(total)
        gain = np.where((n_low > 0) & (n_high > 0), low + high - whole, -np.inf).reshape(len(found), -1)
        chosen = gain.argmax(axis=1)
        every = np.arange(len(found))
        splits = gain[every, chosen] > _ROUNDING * (low + high).reshape(len(found), -1)[every, chosen]
        k, cut = np.divmod(chosen, shape[1])
        cut = np.where(splits, cut, _LEAF)
        sides = (np.where(splits[:, None], below[every, k, cut * splits], total[:, 0, 0]), np.where(splits[:, None], above[every, k, cut * splits], 0.0))
        yield pa.RecordBatch.from_arrays([pa.array(unit + every), pa.array(k.astype(np.int32)), pa.array(cut.astype(np.int32)),
                                          *[pa.array([row.tobytes() for row in side], pa.binary()) for side in sides]], names=["unit", "k", "cut", "below", "above"])


# --- the forest --------------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees as full binary trees of one depth; what would be below a leaf goes left and has its values."""

    cuts: list[np.ndarray]  # of each feature
    feature: np.ndarray  # (tree, node)
    cut: np.ndarray
    leaves: np.ndarray  # (tree, place on the lowest level, class): shares of the classes, or one number

    def predictions(self, bins: np.ndarray) -> np.ndarray:
        depth = self.leaves.shape[1].bit_length() - 1
        rows, votes = np.arange(bins.shape[1]), np.zeros((bins.shape[1], self.leaves.shape[2]))
        for feature, cut, leaves in zip(self.feature, self.cut, self.leaves):
            votes += leaves.take(_walk(bins, rows, feature, cut, depth), axis=0)
        return votes.argmax(axis=1).astype(np.float64) if votes.shape[1] > 1 else votes[:, 0] / len(self.feature)

    def predict(self, rows: DataFrame) -> DataFrame:
        """label, prediction: the class with most votes, a tree's vote being the shares in its leaf, or the mean of the trees."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = self.predictions(binned(self.cuts, batch))
                    yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found)], names=["label", "prediction"])

        return rows.select("features", "label").mapInArrow(run, "label double, prediction double")


def _facts(rows: DataFrame) -> tuple[float, float, list[np.ndarray]]:
    """Mean and greatest label, and the cuts of every feature."""
    widths = rows.agg(F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"),
                      F.count(F.lit(1)).alias("rows"), F.count("label").alias("labels"), F.avg("label").alias("mean"), F.max("label").alias("top")).first()
    if not widths["rows"] or not widths["most"] or widths["least"] != widths["most"] or widths["labels"] != widths["rows"]:
        raise ValueError("a forest needs rows with features and a label each")
    # The same rows whatever the tasks are.  Only a table of very few different rows can have none with that hash.
    mark, every = F.xxhash64("__id", "label", "features"), max(1, widths["rows"] // (2 * _SAMPLE))
    for some in (rows.where(F.pmod(mark, F.lit(every)) == 0), rows):
        x = some.orderBy(mark, "__id", "label").limit(_SAMPLE).select("features").toArrow().column("features").combine_chunks().flatten()
        if len(x):
            break
    x = x.to_numpy(zero_copy_only=False).reshape(-1, widths["most"])
    return widths["mean"], widths["top"], [cuts_of(x[:, f]) for f in range(widths["most"])]


def numbered(ids: np.ndarray, last: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
    """Keys of rows in the order of their ids: rows of one id have keys of their own.  `last` is the id that stood before
    and the number of its rows so far; it is given back for the rows that follow."""
    place = np.arange(len(ids))
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    number = place - np.maximum.accumulate(np.where(first, place, 0))
    if last and ids[0] == last[0]:
        number[ids == ids[0]] += last[1]
    return ids.view(np.uint64) ^ (number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), (int(ids[-1]), int(number[-1]) + 1)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], center: float) -> DataFrame:
    """keys, labels, bins: as bytes, up to _BLOCK rows of a task in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            keys, labels, bins = (np.concatenate(x, axis=-1) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, labels, bins)], names=["keys", "labels", "bins"])

        held, count, last = [], 0, None
        for batch in batches:
            if batch.num_rows:
                keys, last = numbered(batch.column("__id").to_numpy(), last)
                held.append((keys, batch.column("label").to_numpy() - center, binned(cuts, batch)))
                count += batch.num_rows
            if count >= _BLOCK:
                yield block()
                held, count = [], 0
        if held:
            yield block()

    return scale.stage(rows.select("__id", "features", "label").mapInArrow(run, "keys binary, labels binary, bins binary"), "binned")


def _splits(blocks: DataFrame, at: Level) -> pa.Table:
    """best_splits of all units."""
    shape, per_pass = at.shape, max(1, _SUMS // (math.prod(at.shape) * 8))
    parts = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    out = []
    for first in range(0, len(at.trees), per_pass):
        part, classes = at.part(first, first + per_pass), at.classes
        sums = blocks.mapInArrow(lambda batches, part=part: level_sums(part, batches), "unit long, sums binary")
        found = sums.repartition(parts, "unit").mapInArrow(lambda batches: best_splits(shape, classes, batches), "unit long, k int, cut int, below binary, above binary").toArrow()
        out.append(found.set_column(0, "unit", pa.array(found.column("unit").to_numpy() + first)))
    return pa.concat_tables(out)


def fit(dealt: DataFrame, rows: DataFrame, *, classes: bool, trees: int, depth: int, per_node: str, seed: int) -> Forest:
    """A forest on rows with __id (key), features (array) and label; `rows` holds them as they are, `dealt` dealt to tasks by
    key and sorted, so that rows of one key, which are drawn apart from each other, stand together.

    `per_node` is "all" features or "sqrt", a random choice of that many (rounded up) for every node.  Nodes end at
    `depth`, and where no split gains.  The driver holds the trees.
    """
    mean, top, cuts = _facts(rows)
    center = 0.0 if classes else mean
    count = max(2, int(top) + 1) if classes else 0
    width = len(cuts)
    k = width if per_node == "all" else math.ceil(math.sqrt(width))
    blocks = _blocks(dealt, cuts, center)
    feature = np.zeros((trees, (1 << depth) - 1), np.intp)
    cut = np.full((trees, (1 << depth) - 1), _LEAF, np.uint8)
    stats = np.zeros((trees, (2 << depth) - 1, count or 2))
    tree, node = np.arange(trees), np.zeros(trees, np.intp)
    for level in range(depth):
        if not len(tree):
            break
        every = np.tile(np.arange(width), (len(tree), 1))
        chosen = every if k == width else np.random.default_rng([seed, level]).permuted(every, axis=1)[:, :k]
        above = slice(0, (1 << level) - 1)
        found = _splits(blocks, Level(level, count, seed, tree, node, chosen, feature[:, above], cut[:, above]))
        unit, at = found.column("unit").to_numpy(), (1 << level) - 1
        below, over = (np.frombuffer(b"".join(found.column(side).to_pylist()), np.float64).reshape(len(unit), count or 2) for side in ("below", "above"))
        place, t, n = found.column("cut").to_numpy(), tree[unit], node[unit]
        feature[t, at + n], cut[t, at + n] = chosen[unit, found.column("k").to_numpy()], place
        stats[t, at + n] = below + over
        splits = np.flatnonzero(place != _LEAF)
        t, n, sides = t[splits], n[splits], np.stack([below[splits], over[splits]], axis=1)
        for side in (0, 1):
            stats[t, 2 * (at + n) + 1 + side] = sides[:, side]
        rows_of = sides.sum(axis=2) if classes else sides[:, :, 0]
        seeking = (rows_of > 1) & (sides.max(axis=2) < rows_of) if classes else rows_of > 1
        tree, node = np.repeat(t, 2)[seeking.reshape(-1)], np.stack([2 * n, 2 * n + 1], axis=1)[seeking]
        order = np.lexsort((node, tree))
        tree, node = tree[order], node[order]
    for at in range((1 << depth) - 1):  # what is below a leaf has its values
        ends = cut[:, at] == _LEAF
        stats[ends, 2 * at + 1] = stats[ends, at]
    leaves = stats[:, (1 << depth) - 1:]
    n = leaves.sum(axis=2, keepdims=True) if classes else leaves[:, :, :1]
    values = np.divide(leaves if classes else leaves[:, :, 1:], n, out=np.zeros_like(leaves if classes else leaves[:, :, 1:]), where=n > 0)
    return Forest(cuts, feature, cut, values if classes else values + center)
