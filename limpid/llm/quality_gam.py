"""Text quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by boosting shallow trees on one feature at a time, round after
round; the strongest pairs of features then get tables of their own.  A score is the sum of the looked-up values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import python_stages, stage
from limpid.llm.toxicity import held_out

#: Labelled documents that the model is fitted on at most, chosen by hash.
EXAMPLES = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS, SMOOTHING = 200, 60, 0.1, 10, 1.0
THRESHOLD = 0.5
ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

FEATURES = (
    "log_points", "log_words", "log_lines", "word_length", "line_words", "upper", "digits", "sentence_marks", "symbols", "bars", "other_bytes",
    "distinct_words", "distinct_pairs", "distinct_lines", "most_frequent_word", "words_end_in_symbol", "upper_words", "short_words", "full_stops",
)
_SENTENCE = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SYMBOL = np.array([b for b in range(33, 127) if not chr(b).isalnum() and b not in _SENTENCE.tolist() and chr(b) != "|"])


def features(text: str | None) -> list[float]:
    """Numbers that describe the whole text; an empty or null text has its own, without division by zero."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(counts.sum()) - int(counts[32]) - int(counts[10]))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    tally = Counter(words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n, len(words) / len(lines),
        upper / max(1, upper + lower), counts[48:58].sum() / total, counts[_SENTENCE].sum() / total, counts[_SYMBOL].sum() / total,
        counts[124] / total, counts[128:].sum() / total, len(tally) / n, len(set(zip(words, words[1:]))) / n, len(set(lines)) / len(lines),
        max(tally.values(), default=0) / n, sum(1 for w in words if w[-1] in "!#$%&*@~^|<>") / n, sum(map(str.isupper, words)) / n,
        sum(1 for w in words if len(w) <= 3) / n, counts[46] / n,
    ]


# --- model -------------------------------------------------------------------------------------

@dataclass
class Model:
    cuts: list[np.ndarray]  # upper bounds of all bins of a feature but the last
    coarse: list[np.ndarray]  # coarse bin of each bin
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _gain(g, h):
    return g * g / (h + SMOOTHING)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, bins to the left) of the best cut of a run of bins."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_n < LEAST_ROWS) | (n.sum() - left_n < LEAST_ROWS)] = -1
    best = int(gain.argmax()) if len(gain) else -1
    return (float(gain[best]), best + 1) if best >= 0 else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps of a tree with at most three leaves over a run of bins."""
    spans = [(0, len(g))]
    for _ in range(2):
        gain, k, cut = max((*(_best_cut(g[a:b], h[a:b], n[a:b])[:1]), k, a + _best_cut(g[a:b], h[a:b], n[a:b])[1]) for k, (a, b) in enumerate(spans))
        if gain <= 0:
            break
        a, b = spans[k]
        spans[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTHING)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps and gain of a tree of depth two over a grid: one cut, then a cut of either side along either axis.

    The first cut is the one whose whole tree gains most: where only both features together tell the labels apart, no
    single cut gains anything."""
    def leaf(box):
        return g[box].sum(), h[box].sum()

    def split(box):
        """(gain, leaves) of the best cut of a part of the grid, or of none."""
        best = max((*_best_cut(*(x[box].sum(axis=1 - axis) for x in (g, h, n))), axis) for axis in (0, 1))
        return (best[0], halves(box, best[1], best[2])) if best[0] > 0 else (0.0, [box])

    def halves(box, at: int, axis: int):
        span = box[axis]
        sides = slice(span.start, span.start + at), slice(span.start + at, span.stop)
        return [(side, box[1]) if axis == 0 else (box[0], side) for side in sides]

    whole = slice(0, g.shape[0]), slice(0, g.shape[1])
    best, leaves = 0.0, [whole]
    for axis in (0, 1):
        for at in range(1, g.shape[axis]):
            sides = halves(whole, at, axis)
            if min(n[side].sum() for side in sides) < LEAST_ROWS:
                continue
            parts = [split(side) for side in sides]
            gain = sum(_gain(*leaf(side)) for side in sides) - _gain(*leaf(whole)) + sum(more for more, _ in parts)
            if gain > best:
                best, leaves = gain, [x for _, found in parts for x in found]
    out = np.zeros(g.shape)
    for box in leaves:
        out[box] = g[box].sum() / (h[box].sum() + SMOOTHING)
    return out, best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to features and labels 0 and 1.  Without rows of both labels the score is their share (no rows: 0.5)."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    coarse = [np.arange(len(c) + 1) * PAIR_BINS // (len(c) + 1) for c in cuts]
    model = Model(cuts, coarse, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            size = len(table)
            step = RATE * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), np.bincount(b[:, f], minlength=size))
            table += step
            total += step[b[:, f]]
    c = np.stack([coarse[f][b[:, f]] for f in range(len(FEATURES))], axis=1)

    def grids(pair, g, h):
        at = c[:, pair[0]] * PAIR_BINS + c[:, pair[1]]
        return (np.bincount(at, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (g, h, np.ones(len(y))))

    g, h = slopes()
    gains = sorted(((_pair_tree(*grids(p, g, h))[1], p) for p in combinations(range(len(FEATURES)), 2)), reverse=True)
    model.pairs = [p for gain, p in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables):
            step = RATE * _pair_tree(*grids(pair, *slopes()))[0]
            table += step
            total += step[c[:, pair[0]], c[:, pair[1]]]
    return model


# --- Spark -------------------------------------------------------------------------------------

def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of `label_col` from at most EXAMPLES labelled documents outside the held-out third, chosen by hash.  A
    document labelled twice counts as 0 if it is 0 once.  Ids are whole numbers.  The driver holds the examples' features only."""
    spark = documents.sparkSession
    python_stages(spark)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("label")) \
        .orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
    chosen = stage(chosen, "quality-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(map(float, features(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["id", "label", "x"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id") \
        .select("id", "label", "text").mapInArrow(run, "id long, label int, x array<double>").toPandas()
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["id", "key"])
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return train(x, rows["label"].to_numpy(float))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with score (0 to 1, probability of label 1) and predicted (1 if the score reaches the threshold).  Null
    texts count as empty and have a score too.  Columns of these names are replaced."""
    spark = df.sparkSession
    python_stages(spark)
    df = df.drop(*ADDED.names)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text_col)], dtype=float).reshape(-1, len(FEATURES))
            p = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, *ADDED.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *ADDED.fields]))
