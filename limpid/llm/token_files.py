"""Token ids in Arrow stream files of equal-length sequences.

A shard is a run of documents in ascending id order.  Its ids, each document's followed by an end id, are one stream
cut into sequences: batches of two fixed-size-list columns, ids (uint16 if the vocabulary allows, else uint32) and mask
(a bit, false on the padding of the last sequence).  A memory-mapped file gives any sequence without copying.  A second file beside it holds the documents of
the shard with their places in the stream.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.llm.common import held, python_stages, stage
from limpid.llm.units import Encoder
from limpid.operators import scale

END_ID = 0
SEQUENCE = 2048
#: Sequences in a batch; a writer holds about one batch.
BATCH_SEQUENCES = 256
MANIFEST = "shard int, sequences string, documents string, n_tokens long, n_documents long"

#: Bytes of remembered parts; a worker of this operator does nothing else.
MEMORY = 224 << 20

def _encoder(content: bytes) -> Encoder:
    """One tokenizer, with the parts it remembers, for all tasks of a worker."""
    return held(hashlib.sha1(b"tokens" + content).digest(), lambda: _load(content))


def _load(content: bytes) -> Encoder:
    # A task has one core; the library's own threads would only take it from other tasks.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    kind = np.dtype("<u2" if max(tokenizer.get_vocab().values()) < 1 << 16 else "<u4")

    def encode_parts(parts: list[str]) -> list[bytes]:
        return [array(kind.char, e.ids).tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    # As the library does, a text is cut at the strings of added tokens before anything else.
    tokens = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
        raise ValueError("added tokens that look at what stands beside them are not supported")
    return Encoder(encode_parts, kind, MEMORY, {token.content: i for i, token in tokens.items()})


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes a stream of ids as sequences, holding one batch at most (and one document)."""

    def __init__(self, path: str, length: int, batch_sequences: int, kind: np.dtype):
        system, inner = _file_system(path)
        self.sink = system.open_output_stream(inner)
        self.schema, self.kind = sequence_schema(length, kind), kind
        self.file = pa.ipc.new_stream(self.sink, self.schema)
        self.length, self.batch_bytes = length, kind.itemsize * length * batch_sequences
        self.parts, self.held, self.n_tokens = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids) // self.kind.itemsize
        if self.held >= self.batch_bytes:
            data = b"".join(self.parts)
            cut = len(data) - len(data) % self.batch_bytes
            for at in range(0, cut, self.batch_bytes):
                self._batch(data[at : at + self.batch_bytes])
            self.parts, self.held = [data[cut:]], len(data) - cut

    def _batch(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.kind)
        padding = -len(ids) % self.length
        mask = np.arange(len(ids) + padding) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (np.concatenate([ids, np.zeros(padding, self.kind)]), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(b"".join(self.parts))
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of a memory-mapped file."""

    def __init__(self, path: str):
        system, inner = _file_system(path)
        self.source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, both views of the file."""
        batch, row = self.batches[k // self.per_batch], k % self.per_batch
        ids, mask = (column.flatten().slice(row * column.type.list_size, column.type.list_size) for column in batch.columns)
        return ids.to_numpy(), mask


def write(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, *,
          length: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES, end_id: int = END_ID) -> DataFrame:
    """Encode every text (null: empty), append `end_id`, write in ascending id order (null first; equal ids by text
    hash); the manifest, one row per shard: shard, sequences and documents (paths), n_tokens, n_documents.

    `tokenizer` is a tokenizers JSON file on the driver, which is broadcast.  `folder` must be reachable by all
    executors; the default lies in the shared folder.  Every attempt of a task writes files of its own, and only those
    of the attempt that succeeded are in the manifest, so lost executors and speculative tasks leave no trace in it."""
    spark = df.sparkSession
    python_stages(spark)
    folder = folder or scale.stage_path(spark, "token-files")
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        kind = encoder.kind
        writer = index = None
        shard, documents = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
                system, inner = _file_system(folder)
                system.create_dir(inner, recursive=True)
                writer = ShardWriter(f"{name}.sequences.arrows", length, batch_sequences, kind)
                index_sink = system.open_output_stream(_file_system(f"{name}.documents.arrows")[1])
                schema = pa.schema([("id", batch.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_stream(index_sink, schema)
            ids, ends = encoder.encode(batch.column("text"))
            # One more place for the end id of every document.
            base, own = writer.n_tokens, np.diff(ends) + 1
            starts, sizes = base + np.cumsum(own) - own, own
            writer.add(np.insert(ids, ends[1:], end_id).tobytes())
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            documents += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([f"{name}.sequences.arrows"]), pa.array([f"{name}.documents.arrows"]), pa.array([writer.n_tokens]), pa.array([documents])],
                names=["shard", "sequences", "documents", "n_tokens", "n_documents"])

    return stage(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents
    before it, ids_crc32 is the unsigned CRC-32 of its ids as little-endian 32-bit integers.  A task reads its shards
    one batch at a time."""
    python_stages(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _read_shard(shard["sequences"], shard["documents"], shard["base"])

    return placed.repartition(max(1, manifest.count())).mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def _read_shard(sequences: str, documents: str, base: int) -> Iterator[pa.RecordBatch]:
    def opened(path):
        system, inner = _file_system(path)
        return pa.ipc.open_stream(pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner))

    stream = iter(opened(sequences))
    held, at = np.zeros(0, "<u4"), 0
    for batch in opened(documents):
        sums = []
        for n in batch.column("n_tokens").to_pylist():
            crc = 0
            while n:
                if at == len(held):
                    part = next(stream)
                    # Only the last sequence ends in padding.
                    held, at = part.column("ids").flatten().to_numpy().astype("<u4")[: part.column("mask").flatten().true_count], 0
                took = held[at : at + n]
                crc, at, n = zlib.crc32(took, crc), at + len(took), n - len(took)
            sums.append(crc)
        starts = pa.array(batch.column("start").to_numpy() + base)
        yield pa.RecordBatch.from_arrays([batch.column("id"), starts, batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
