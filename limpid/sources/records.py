"""Records of CSV files whose quoted fields hold line breaks, read by many tasks.

A block of a file (what one task reads of it) cannot know whether its first line stands inside a quoted field.  So every
block is first reduced to where it ends for either way to start; composing these from the start of a file gives the
state at every block.  Then each block cuts its own records, and only a record that runs over the end of a block is
joined from its pieces.  Besides the forests of a model this is the one place of the cleaning engine with Python workers;
files without such line breaks never come here.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.operators import scale

# Workers get what this module defines with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a row of cut records is: a whole record, the start of one that the block does not end, or what a block goes on with.
WHOLE, START, REST = 0, 1, 2


class LineStates:
    """Whether a line ends inside a quoted field (1) or not (0), given that it starts so.

    A field is quoted if a quote is its first character; it ends at the first single quote, doubled ones being text, and
    what stands between that and the separator belongs to it.  A quote inside an unquoted field means nothing."""

    def __init__(self, sep: str, quote: str):
        s, q = re.escape(sep), re.escape(quote)
        inside = rf"(?:[^{q}]|{q}{q})*+"
        field = rf"(?:{q}{inside}{q}[^{s}]*+|(?!{q})[^{s}]*+)"
        self.quote = quote
        self.opens = re.compile(rf"(?:{field}{s})*{q}{inside}\Z")
        self.goes_on = re.compile(rf"{inside}(?:\Z|{q}[^{s}]*+{s}(?:{field}{s})*{q}{inside}\Z)")

    def after(self, line: str, state: int) -> int:
        return int(bool((self.goes_on if state else self.opens).match(line)))

    def marked(self, lines: pa.Array) -> np.ndarray:
        """Places of the lines that have a quote; all others keep the state."""
        return np.flatnonzero(pc.match_substring(lines, self.quote).to_numpy(zero_copy_only=False))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, block), lines) of the stretches of a batch that come from one block."""
    blocks = batch.column("block").to_numpy()
    files = batch.column("file").dictionary_encode()
    number = files.indices.to_numpy()
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (number[1:] != number[:-1])) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(blocks)]):
        if b > a:
            yield (files.dictionary[number[a]].as_py(), int(blocks[a])), batch.column("value").slice(a, b - a)


def block_ends(states: LineStates, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: the state at its end if it starts outside a quoted field, and if it starts inside one."""
    def row(at, ends) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([ends[0]], pa.int32()), pa.array([ends[1]], pa.int32())], names=["file", "block", "from_0", "from_1"])

    at, ends = None, [0, 1]
    for batch in batches:
        for here, lines in _runs(batch):
            if here != at:
                if at is not None:
                    yield row(at, ends)
                at, ends = here, [0, 1]
            for line in lines.take(pa.array(states.marked(lines))).to_pylist():
                after = {s: states.after(line, s) for s in set(ends)}
                ends = [after[e] for e in ends]
    if at is not None:
        yield row(at, ends)


def cut_records(states: LineStates, starts: dict[str, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, row, part, text) of the records and pieces of every block; `starts` has the state of the blocks of
    each file, by the number of their first byte.  Blank lines between records are left out."""
    names = ["file", "block", "row", "part", "text"]

    def rows(at, first: int, part: int, texts) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array(np.arange(first, first + n)), pa.array([part] * n, pa.int32()),
                                           texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], names=names)

    at, state, count, held, part = None, 0, 0, [], START

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            yield rows(at, count, part, ["\n".join(held)])

    for batch in batches:
        for here, lines in _runs(batch):
            if here != at:
                yield from close()
                blocks, before = starts[here[0]]
                at, count, held = here, 0, []
                state = int(before[np.searchsorted(blocks, here[1])])
                part = REST if state else START
            done = 0
            for k in [*states.marked(lines).tolist(), len(lines)]:
                # Lines up to k have no quote.
                if k > done:
                    calm = lines.slice(done, k - done)
                    if state:
                        held.extend(calm.to_pylist())
                    else:
                        calm = calm.filter(pc.not_equal(pc.utf8_trim_whitespace(calm), ""))
                        if len(calm):
                            yield rows(at, count, WHOLE, calm)
                            count += len(calm)
                if k == len(lines):
                    break
                line, done = lines[k].as_py(), k + 1
                after = states.after(line, state)
                held.append(line)
                if not after:
                    yield rows(at, count, part if part == REST else WHOLE, ["\n".join(held)])
                    count += part != REST
                    held, part = [], START
                state = after
    yield from close()


def _starts(ends: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """file -> (blocks, state at the start of each), from the ends of all blocks."""
    out = {}
    for file, own in itertools.groupby(sorted(ends, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        blocks, states, state = [], [], 0
        for r in own:
            blocks.append(r["block"])
            states.append(state)
            state = r["from_1"] if state else r["from_0"]
        out[file] = np.array(blocks, np.int64), np.array(states, np.int8)
    return out


def lines_of(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """file, block, value: the lines of the files, in order inside a task.  Carriage returns stay."""
    text = spark.read.option("lineSep", "\n").text(files)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), decoded(F.col("value"), encoding).alias("value"))


def decoded(line: Column, encoding: str) -> Column:
    """Text of a line as the text source gives it, which is its bytes unchanged."""
    return line if encoding.upper() in ("UTF-8", "UTF8") else F.decode(line.cast("binary"), encoding)


def read_records(spark: SparkSession, files: list[str], encoding: str, sep: str, quote: str) -> DataFrame:
    """file, block, row, text: one row per record, the header's included; (file, block, row) is the order of the records.

    The lines are read twice.  Between the passes the driver holds 9 bytes for each block, which is 128 MB of a file by
    default.  The cut records are written once; joining the pieces moves at most one record per block."""
    states = LineStates(sep, quote)
    lines = lines_of(spark, files, encoding)
    ends = lines.mapInArrow(lambda b: block_ends(states, b), "file string, block long, from_0 int, from_1 int")
    starts = spark.sparkContext.broadcast(_starts(ends.collect()))
    cut = scale.stage(lines.mapInArrow(lambda b: cut_records(states, starts.value, b), "file string, block long, row long, part int, text string"), "csv-records")
    # A rest belongs to the last record that was started before it.
    seen = Window.partitionBy("file").orderBy("block", F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("part") == START, F.struct("block", "row")), ignorenulls=True).over(seen)
    pieces = cut.where(F.col("part") != WHOLE).withColumn("owner", owner)
    joined = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))
    # A line break stood at the end of every piece but the last.
    whole = joined.select("file", F.col("owner.block").alias("block"), F.col("owner.row").alias("row"), F.array_join("pieces.text", "\n").alias("text"))
    return cut.where(F.col("part") == WHOLE).select("file", "block", "row", "text").unionByName(whole)
