"""URL rules in a sorted array of 64-bit digests.

The index is two files: the sorted xxHash64 keys of the rules with a verdict each, and the rules' own strings in the
same order.  Spark hands both to every executor, which memory-maps them.  Each URL gives a key for every parent domain
and every rule path length; all keys of a batch are looked up by one vectorised binary search, and a hit counts only
if the stored string equals the probed one.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limpid.llm.common import python_stages, shared_file

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")
RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


@dataclass(frozen=True)
class RuleIndex:
    """Names of the files that Spark distributes, the rule path lengths (in code points) that occur, and the labels of
    the longest rule host."""

    keys: str
    strings: str
    path_lengths: tuple[int, ...]
    labels: int


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or without ://."""
    found = SPLIT.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def build_files(rules: Iterable[tuple[str, str, str]]) -> tuple[bytes, bytes, tuple[int, ...]]:
    """Key file, string file and path lengths of rules (host, path, allow or block).  Of repeated rules the last
    one counts."""
    last = {(h.translate(LOWER) + "\0" + p): v for h, p, v in rules}
    order = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in last.items())
    keys = np.array([k for k, _, _ in order], dtype=np.uint64)
    texts = [s.encode() for _, s, _ in order]
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    block = np.array([v == "block" for _, _, v in order], dtype=np.int64)
    head = io.BytesIO()
    np.save(head, np.stack([keys.view(np.int64), ends[:-1], ends[1:], block]) if order else np.zeros((4, 0), np.int64))
    return head.getvalue(), b"".join(texts) or b"\0", tuple(sorted({len(s.split("\0")[1]) for s in last}))


def build_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> RuleIndex:
    """Write both files to the shared folder and hand them to all executors, those that join later too.  The rule
    list must fit the disk of one machine, 24 bytes and its text for each rule."""
    rules = list(rules)
    keys, strings, lengths = build_files(rules)
    names = []
    for content, end in ((keys, "npy"), (strings, "bin")):
        names.append(f"url-rules-{uuid.uuid4().hex}.{end}")
        spark.sparkContext.addFile(shared_file(spark, names[-1], content))
    return RuleIndex(*names, lengths, max((h.count(".") + 1 for h, _, _ in rules), default=0))


class Prober:
    """The memory-mapped index inside one Python worker."""

    def __init__(self, keys_path: str, strings_path: str, path_lengths: tuple[int, ...], labels: int = 1 << 20):
        table = np.load(keys_path, mmap_mode="r")
        self.keys, self.start, self.end, self.block = table[0].view(np.uint64), table[1], table[2], table[3]
        self.strings = np.memmap(strings_path, dtype=np.uint8, mode="r")
        self.lengths, self.most_labels = path_lengths, labels

    def probes(self, host: str, path: str) -> Iterator[str]:
        """What a rule that fits may look like, longest rule first; of equally long ones the longer host first.  A host
        has as many endings here as the longest rule host has labels, however many it has itself."""
        if not host:
            return
        labels = host.rsplit(".", self.most_labels)
        hosts = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.most_labels), len(labels))]
        pairs = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]
        yield from (f"{h}\0{p}" for h, p in sorted(pairs, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0]))))

    def confirmed(self, slot: int, probe: bytes) -> bool:
        return self.strings[self.start[slot] : self.end[slot]].tobytes() == probe

    def judge(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        split = [parts(u) for u in urls]
        tried = [[p.encode("utf-8", "surrogatepass") for p in self.probes(*s)] for s in split]
        flat = np.array([xxhash.xxh64_intdigest(p) for t in tried for p in t], dtype=np.uint64)
        low, high = np.searchsorted(self.keys, flat, "left"), np.searchsorted(self.keys, flat, "right")
        out, at = [], 0
        for (host, path), probes in zip(split, tried, strict=True):
            rule, verdict = None, default
            for k, probe in enumerate(probes, at):
                slot = next((s for s in range(low[k], high[k]) if self.confirmed(s, probe)), None)
                if slot is not None:
                    rule, verdict = probe.replace(b"\0", b"").decode(), "block" if self.block[slot] else "allow"
                    break
            at += len(probes)
            out.append((host, path, rule, verdict))
        return out


def judge_urls(df: DataFrame, index: RuleIndex, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule (host and path of the longest rule that fits, else null) and verdict (allow or
    block; `default` where no rule fits).

    A rule fits its host and all subdomains if the URL's path starts with the rule's path.  A null or malformed URL
    has an empty host and fits no rule.  Input columns named like the added ones are replaced."""
    df = df.drop(*RESULT.names)
    python_stages(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(SparkFiles.get(index.keys), SparkFiles.get(index.strings), index.path_lengths, index.labels)
        for batch in batches:
            rows = prober.judge(batch.column(url_col).to_pylist(), default)
            added = pd.DataFrame(rows, columns=RESULT.names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(added[n].tolist(), pa.string()) for n in RESULT.names)], names=[*batch.schema.names, *RESULT.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *RESULT.fields]))
