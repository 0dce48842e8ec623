"""Byte-level BPE by corpus-level merge replay.

All distinct words that a batch of texts adds are merged together.  An inverted index leads from a token pair to the
places where it stands; merges are applied in rank order, each to all its places at once, and only the pairs with the
touched neighbours are filed anew.  What has been merged is remembered by the worker, within a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import held, python_stages
from limpid.llm.units import Encoder


#: Above all ranks.
NONE = 1 << 31


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: a token for each line, in base 64, with its rank, which is also its id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Merges:
    """The merges of a rank file."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.split = regex.compile(pattern).findall
        pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair_keys, self.pair_values = np.array(pairs, dtype=np.int64).reshape(-1, 2).T.copy() if pairs else np.array([[-1], [NONE]])

    def one_by_one(self, word: bytes) -> list[int]:
        """The plain rule: merge the leftmost pair of least rank until no pair has one."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if the two together are no token."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers.  A word that is a token is that token; all others are
        merged together, in rank order."""
        todo = [w for w in words if w not in self.ranks]
        starts = np.cumsum([0, *map(len, todo)])
        ids = self.bytes[np.frombuffer(b"".join(todo), np.uint8)]
        place = np.arange(len(ids))
        after, before = place + 1, place - 1
        after[starts[1:] - 1], before[starts[:-1]] = -1, -1  # words are not empty
        ranks = np.full(len(ids), NONE)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> np.ndarray:
            """Look the pairs at these places up and file them; the ranks found."""
            at = at[after[at] >= 0]
            ranks[at] = found = self.pair_ranks(ids[at], ids[after[at]])
            at, found = at[found < NONE], found[found < NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, some in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(at, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(some)
            return at[found < now]

        now, late = -1, []
        file(place)
        while queue:
            now = heapq.heappop(queue)
            filed = index.pop(now)
            at = filed[0] if len(filed) == 1 else np.unique(np.concatenate(filed))
            at = at[ranks[at] == now]  # others were touched since they were filed
            if not len(at):
                continue
            # In a run of overlapping pairs, as in aaaa, every second one is merged, from the left.
            overlap = after[at[:-1]] == at[1:]
            if overlap.any():
                first = np.flatnonzero(np.concatenate([[True], ~overlap]))
                in_run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[in_run % 2 == 0]
            gone = after[at]
            follow = after[gone]
            ids[at], after[at], ranks[at], ranks[gone], ids[gone] = now, follow, NONE, NONE, -1
            before[follow[follow >= 0]] = at[follow >= 0]
            left = before[at]
            touched = np.concatenate([left[left >= 0], at])
            late.append(file(np.unique(touched) if overlap.any() else touched))
        merged = ids >= 0
        flat, ends = ids[merged].astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(merged)])[starts]).tolist()
        found = [flat[a:b] for a, b in zip(ends, ends[1:])]
        # Where a lower rank came up late, a word's own order is not the order of the corpus.
        for k in np.unique(np.searchsorted(starts, np.concatenate([*late, place[:0]]), side="right") - 1).tolist():
            found[k] = np.array(self.one_by_one(todo[k]), "<u4").tobytes()
        rest = iter(found)
        return [np.array([self.ranks[w]], "<u4").tobytes() if w in self.ranks else next(rest) for w in words]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        words = [self.split(p) for p in parts]
        distinct = list({w for own in words for w in own})
        known = dict(zip(distinct, self.replay([w.encode() for w in distinct]), strict=True))
        return [known[own[0]] if len(own) == 1 else b"".join([known[w] for w in own]) for own in words]


class Tokens:
    """Bytes of token ids: all tokens one after the other, and where each lies."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.full(max(ranks.values(), default=-1) + 1, -1)
        tokens = [b""] * len(self.sizes)
        for token, rank in ranks.items():
            tokens[rank], self.sizes[rank] = token, len(token)
        self.starts = np.cumsum([0, *map(len, tokens)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text's bytes start, and the end); an id that no token has is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("there is an id without a token")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends[starts]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, content: bytes, pattern: str):
        merges = Merges(content, pattern)
        self.encoder, self.tokens = Encoder(merges.encode_parts, "<u4"), Tokens(merges.ranks)


def _codec(content: bytes, pattern: str) -> Codec:
    """One vocabulary, with what its encoder remembers, for all tasks of a worker."""
    return held(hashlib.sha1(b"bpe" + content + pattern.encode()).digest(), lambda: Codec(content, pattern))


def _binary(data: np.ndarray, starts: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype("<i4")), pa.py_buffer(data)])
    return found if valid is None else pc.if_else(valid, found, None)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`df` with the token ids of the whole text (array<int>), as ordinary text without special tokens.  A null text
    counts as empty and has no ids.  `vocabulary` is a rank file on the driver (a megabyte or so), which is broadcast.
    A column of that name is replaced."""
    spark = df.sparkSession
    python_stages(spark)
    df = df.drop(ids_col)
    shared = spark.sparkContext.broadcast((_read(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _codec(*shared.value).encoder
        for batch in batches:
            found, starts = encoder.encode(batch.column(text_col).cast(pa.string()))
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.view("<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`df` with the bytes of the token ids; null ids have null bytes, and an id that no token has is an error.  A
    column of that name is replaced."""
    spark = df.sparkSession
    python_stages(spark)
    df = df.drop(bytes_col)
    shared = spark.sparkContext.broadcast((_read(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _codec(*shared.value).tokens
        for batch in batches:
            column = batch.column(ids_col)
            offsets = column.offsets.to_numpy()
            ids = column.flatten() if column.null_count else column.values.slice(offsets[0], offsets[-1] - offsets[0])
            starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            decoded = _binary(*tokens.decode(ids.to_numpy(zero_copy_only=False), starts), column.is_valid())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encode, then decode of those ids, in one Python stage: a task has one worker with one vocabulary."""
    spark = df.sparkSession
    python_stages(spark)
    df = df.drop(ids_col, bytes_col)
    shared = spark.sparkContext.broadcast((_read(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            found, starts = codec.encoder.encode(batch.column(text_col).cast(pa.string()))
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.view("<i4")))
            decoded = _binary(*codec.tokens.decode(found, starts))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], names=[*batch.schema.names, ids_col, bytes_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())]))


def with_digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """`df` with n_tokens, ids_sha256 (of the decimal ids, joined by a space) and decoded_sha256."""
    return df.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2(bytes_col, 256),
    })
