"""Toxicity from the nearest labelled examples.

Texts become TF-IDF vectors over words and the character grams inside them.  The labelled examples lie in an inverted
index whose posting lists are cut into blocks with their largest weight; a query visits blocks by the bound that
these give and stops when no block can hold a nearer example, so the neighbours are exact.  Neighbours vote with a
weight that falls with distance, and the vote is calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import python_stages, stage

#: Labelled examples of either label at most, chosen by hash; what is fitted depends on them alone.
EXAMPLES = 5000
#: Terms that the vectors use: those that tell the labels apart best, among terms in MIN_EXAMPLES examples or more that
#: are LEAST_RATIO times as frequent under one label as under the other.
TERMS, MIN_EXAMPLES, LEAST_G, LEAST_RATIO = 4000, 5, 10.0, 5.0
GRAMS = (4, 5)
NEIGHBOURS, BLOCK = 15, 64
_BETWEEN = re.compile(r"\W+")
THRESHOLD = 0.7
ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                      T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])))])


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- terms -------------------------------------------------------------------------------------

def marked(text: str | None) -> str:
    """The words in lower case, without what stands between them; < and > mark the ends of each."""
    return f"<{_BETWEEN.sub('><', (text or '').lower())}>"


def terms_of(text: str | None) -> set[str]:
    """The words of a text and the character grams inside them, with the marks of their ends."""
    words = {f"<{w}>" for w in marked(text)[1:-1].split("><") if w}
    return words | {w[i : i + n] for w in words for n in GRAMS for i in range(len(w) - n + 1)}


class Terms:
    """Counts of known terms in texts: one pass of an automaton over the text finds them all."""

    def __init__(self, vocabulary: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        for term, number in vocabulary.items():
            self.automaton.add_word(term, number)
        if vocabulary:
            self.automaton.make_automaton()

    def count(self, text: str | None) -> Counter:
        return Counter(number for _, number in self.automaton.iter(marked(text))) if len(self.automaton) else Counter()


def vector(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of length 1; empty without known terms."""
    terms = np.array(sorted(counts), dtype=np.int64)
    weights = (1 + np.log([counts[t] for t in terms.tolist()])) * idf[terms] if len(terms) else np.zeros(0)
    norm = np.linalg.norm(weights)
    return (terms, weights / norm) if norm else (terms[:0], weights[:0])


# --- index -------------------------------------------------------------------------------------

class BlockMaxIndex:
    """Posting lists by term, in blocks of BLOCK examples with the largest weight of each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.blocks = len(vectors) // BLOCK + 1
        run = term * self.blocks + self.doc // BLOCK
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        self.run_start = np.append(starts, len(run))  # of each (term, block) that has postings
        self.run_block = (run[starts] % self.blocks).astype(np.int64)
        self.run_max = np.maximum.reduceat(self.weight, starts) if len(run) else np.zeros(0)
        self.term_runs = np.searchsorted(run[starts] // self.blocks, np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, nearest first; ties by example number."""
        spans = [(self.term_runs[t], self.term_runs[t + 1], w) for t, w in zip(terms.tolist(), weights.tolist())]
        runs = np.concatenate([np.arange(a, b) for a, b, _ in spans]) if spans else np.zeros(0, np.int64)
        if not len(runs):
            return np.zeros(0, np.int64), np.zeros(0)
        factor = np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans])
        bound = np.bincount(self.run_block[runs], factor * self.run_max[runs], minlength=self.blocks)
        by_block = np.argsort(self.run_block[runs], kind="stable")
        runs, factor = runs[by_block], factor[by_block]
        first = np.searchsorted(self.run_block[runs], np.arange(self.blocks + 1))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        docs, scores, worst, step, at = np.zeros(0, np.int64), np.zeros(0), 0.0, 4, 0
        while at < len(order) and (len(docs) < k or bound[order[at]] >= worst - 1e-12):
            some, at, step = order[at : at + step], at + step, step * 2
            chosen = np.concatenate([np.arange(first[b], first[b + 1]) for b in some.tolist()])
            lengths = self.run_start[runs[chosen] + 1] - self.run_start[runs[chosen]]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(self.run_start[runs[chosen]] - (ends - lengths), lengths)
            found, inverse = np.unique(self.doc[places], return_inverse=True)
            cosine = np.bincount(inverse, self.weight[places] * np.repeat(factor[chosen], lengths))
            keep = found != without
            docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, cosine[keep]])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            worst = scores[-1] if len(docs) == k else 0.0
        return docs, scores


# --- model -------------------------------------------------------------------------------------

@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    importance: np.ndarray  # labelled rows that an example of each label stands for
    steps: np.ndarray  # upper vote of each calibration step
    levels: np.ndarray

    def vote(self, docs: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours by squared cosine; far neighbours leave room for the overall share."""
        prior = self.importance[1] * (self.labels == 1).sum() / max(1e-9, sum(self.importance[y] * (self.labels == y).sum() for y in (0, 1)))
        weight = cosines**2 * self.importance[self.labels[docs]]
        rest = 0.05 * self.importance.mean()
        return float(((weight * self.labels[docs]).sum() + rest * prior) / (weight.sum() + rest))

    def calibrated(self, vote: float) -> float:
        return float(self.levels[min(int(np.searchsorted(self.steps, vote)), len(self.levels) - 1)])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through weighted labels, by pooling neighbours that fall: (last x of each step, level).  A level
    is drawn to the mean by the weight of one row, so it lies between 0 and 1."""
    if not len(x):
        return np.array([np.inf]), np.array([0.5])
    mean, one = float(np.average(y, weights=weight)), float(weight.mean())
    pools: list[list[float]] = []
    values, group = np.unique(x, return_inverse=True)
    sums, totals = np.bincount(group, y * weight), np.bincount(group, weight)
    for value, s, t in zip(values, sums, totals):
        pools.append([value, s, t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last, s2, t2 = pools.pop()
            pools[-1] = [last, pools[-1][1] + s2, pools[-1][2] + t2]
    steps = np.array([p[0] for p in pools])
    return steps, np.array([(s + mean * one) / (t + one) for _, s, t in pools])


def _chosen(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of at most EXAMPLES rows of either label; a document labelled twice counts as 1 if it is 1 once."""
    once = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    order = F.xxhash64("id"), F.col("id")
    return once.where("label = 0").orderBy(*order).limit(EXAMPLES).unionByName(once.where("label = 1").orderBy(*order).limit(EXAMPLES))


def _vocabulary(examples: DataFrame) -> list[str]:
    """The terms with the largest G statistic of (term present, label)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                seen[label].update(terms_of(text))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from rows(seen)
        yield from rows(seen)

    def rows(seen) -> Iterator[pd.DataFrame]:
        for label, counts in enumerate(seen):
            if counts:
                yield pd.DataFrame({"term": list(counts.keys()), "ones": [n * label for n in counts.values()], "zeros": [n * (1 - label) for n in counts.values()]})
            counts.clear()

    size = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return []
    counts = examples.select("text", "label").mapInPandas(run, "term string, ones long, zeros long") \
        .groupBy("term").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).where(F.col("a") + F.col("b") >= MIN_EXAMPLES)
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (part(F.col("a"), share * n1) + part(F.col("b"), share * n0) + part(n1 - F.col("a"), (1 - share) * n1) + part(n0 - F.col("b"), (1 - share) * n0))
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    best = counts.withColumn("g", g).where((F.col("g") >= LEAST_G) & (F.abs(ratio) >= F.log(F.lit(LEAST_RATIO)))).orderBy(F.desc("g"), "term").limit(TERMS)
    return sorted(r["term"] for r in best.collect())


def _counts(df: DataFrame, shared) -> DataFrame:
    """(term, n) of the documents that hold each known term, summed in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(terms.count(text.as_py()).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return df.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of `label_col`, from labels outside the held-out third.  Ids are whole numbers.

    Terms and examples come from at most EXAMPLES documents of either label, chosen by hash.  Document frequencies
    are counted over all documents.  The driver holds the examples' vectors: at most 2 x EXAMPLES x TERMS weights."""
    spark = documents.sparkSession
    python_stages(spark)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = stage(_chosen(labels, id_col, label_col), "example-ids")
    examples = stage(texts.join(F.broadcast(chosen), "id"), "examples")
    vocabulary = {t: i for i, t in enumerate(_vocabulary(examples))}
    shared = spark.sparkContext.broadcast(vocabulary)
    n = documents.count()
    frequency = np.zeros(len(vocabulary))
    for r in _counts(texts, shared).collect() if vocabulary else []:
        frequency[r["term"]] = r["n"]
    idf = np.log((1 + n) / (1 + frequency)) + 0.05

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        for batch in batches:
            found = [vector(terms.count(t), idf) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "terms": [t for t, _ in found], "weights": [w for _, w in found]})

    rows = examples.mapInPandas(vectors, "id long, label int, terms array<long>, weights array<double>").toPandas() \
        if examples.head(1) else pd.DataFrame({"id": [], "label": [], "terms": [], "weights": []})
    # Examples that share their heaviest term stand together, which keeps the bounds of blocks low.
    rows["top"] = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in zip(rows["terms"], rows["weights"])]
    rows = rows.sort_values(["label", "top", "id"]).reset_index(drop=True)
    found = [(np.asarray(t, np.int64), np.asarray(w, float)) for t, w in zip(rows["terms"], rows["weights"])]
    label = rows["label"].to_numpy(np.int64)
    sizes = {r["y"]: r["n"] for r in labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy((F.col(label_col) > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    importance = np.array([sizes.get(y, 0) / max(1, (label == y).sum()) for y in (0, 1)], dtype=float)
    model = Model(vocabulary, idf, BlockMaxIndex(found, len(vocabulary)), rows["id"].to_numpy(np.int64), label, importance, np.array([np.inf]), np.array([0.5]))
    votes = np.array([model.vote(*model.index.nearest(t, w, NEIGHBOURS, without=i)) for i, (t, w) in enumerate(found)])
    model.steps, model.levels = isotonic(votes, label.astype(float), importance[label] if len(label) else np.zeros(0))
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with score (0 to 1, calibrated share of label 1), predicted (1 if the score reaches the threshold) and
    evidence (the nearest examples, nearest first: doc_id, cosine, label).  Null and empty texts, and texts without a
    known term, get the share of label 1 among such examples.  Columns of these names are replaced."""
    spark = df.sparkSession
    python_stages(spark)
    df = df.drop(*ADDED.names)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = Terms(m.vocabulary)
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(text_col):
                docs, cosines = m.index.nearest(*vector(terms.count(text.as_py()), m.idf), NEIGHBOURS)
                scores.append(m.calibrated(m.vote(docs, cosines)))
                evidence.append([{"doc_id": i, "cosine": c, "label": y} for i, c, y in zip(m.ids[docs].tolist(), cosines.tolist(), m.labels[docs].tolist())])
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                     pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *ADDED.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *ADDED.fields]))


def drop_flagged(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` whose score stays below the threshold, with their own columns."""
    own = df.columns
    clash = {c: f"__own_{c}" for c in own if c in ADDED.names}
    scored = score(df.withColumnsRenamed(clash), model, clash.get(text_col, text_col), threshold)
    return scored.where("predicted = 0").drop(*ADDED.names).withColumnsRenamed({v: k for k, v in clash.items()}).select(own)
