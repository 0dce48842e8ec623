"""Splitting a text where a byte-level tokenizer always splits, so that each distinct part is encoded only once.

The pre-tokenizer's pattern never lets a token run from a character that is not white space into a space or a line
feed, nor from a letter into punctuation, and what it matches from such a place on does not depend on what
came before.  Encoding the parts on their own and joining the ids therefore gives the ids of the whole text.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a space or line feed: then neither of them need be a place to split.  The class holds all that
#: any of the libraries calls white space, which only makes a part longer.  \0 marks the start of a text below.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNUSUAL = rf"[{_WHITE}][ \n]|\x00"
MARKS = frozenset(string.punctuation)
PLACES = re.compile(r"(?<=\S)(?=[ \n])")
#: Bytes that a worker may spend on parts it remembers, about, and what an entry takes besides its characters.
MEMORY, ENTRY = 96 << 20, 140


def _together(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids), np.cumsum([0, *map(len, ids)])


def _tail(name: str) -> str:
    """The punctuation that a name ends in, if a letter stands before it."""
    word = name.rstrip(string.punctuation)
    return name[len(word) :] if word[-1:].isalpha() and word[-1] < "ɐ" else ""


class Encoder:
    """Ids of texts.  `encode_parts` maps a list of distinct parts to the bytes of their ids, each of type `kind`.

    `added` has the strings that are one id wherever they stand; what lies between them are texts of their own."""

    def __init__(self, encode_parts: Callable[[list[str]], list[bytes]], kind: np.dtype, memory: int = MEMORY, added: dict[str, int] | None = None):
        self.encode_parts, self.kind, self.memory = encode_parts, np.dtype(kind), memory
        self.added = {s: np.array([i], self.kind) for s, i in (added or {}).items()}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")
        # Parts by name: \0 and a whole part, or a part without its leading space, or one that starts with a line feed.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start, and the end)."""
        texts = pc.fill_null(texts, "")
        if self.added:
            split = np.logical_or.reduce([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.added])
            if split.any():
                pieces = [self.between.split(t) for t in texts.filter(pa.array(split)).to_pylist()]
                inner = iter(self._each(pa.array([p for own in pieces for p in own[::2]], pa.string())))
                joined = iter([np.concatenate([self.added[p] if k % 2 else next(inner) for k, p in enumerate(own)]) for own in pieces])
                plain = iter(self._each(texts.filter(pa.array(~split))))
                return _together([next(joined if s else plain) for s in split.tolist()])
        return self._plain(texts)

    def _each(self, texts: pa.Array) -> list[np.ndarray]:
        ids, starts = self._plain(texts)
        return np.split(ids, starts[1:-1]) if len(texts) else []

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unusual = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
        if not unusual.any():
            return self._encode(pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0"), texts, ""), "\n", " \n"), " "))
        usual = iter(self._each(texts.filter(pa.array(~unusual))))
        parts = [["\0" + p for p in PLACES.split(t)] for t in texts.filter(pa.array(unusual)).to_pylist()]
        odd_ids, odd_starts = self._encode(pa.array(parts, pa.list_(pa.string())))
        odd = iter(np.split(odd_ids, odd_starts[1:-1]))
        return _together([next(odd if u else usual) for u in unusual.tolist()])

    def _encode(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        coded = parts.flatten().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = self._learn(names)
        size = np.array([len(x) for x in found], dtype=np.int64) // self.kind.itemsize
        start = np.cumsum(size) - size
        lengths = size[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(start[index] - ends[:-1], lengths) + np.arange(ends[-1])
        return np.frombuffer(b"".join(found), self.kind)[gather], ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]

    def _learn(self, names: list[str]) -> list[bytes]:
        """Ids of distinct names, from memory or encoded."""
        if self.held > self.memory / 2:
            # What is used from now on stays; the rest goes the next time.
            self.older, self.known, self.held = self.known, {}, 0
        known, older, start = self.known, self.older, len(self.known)
        new = [n for n in names if n not in known]
        known.update((n, older[n]) for n in new if n in older)
        unknown = [n for n in new if n not in known]
        # ASCII punctuation after a letter, of an alphabet that all versions of Unicode agree on, is a part itself.
        marked = {n: (n[: -len(tail)], "\0" + tail) for n in unknown if n[-1:] in MARKS and (tail := _tail(n))}
        todo = set(unknown).difference(marked)
        todo = list(todo.union(*marked.values()).difference(known))
        known.update(zip(todo, self.encode_parts([n[1:] if n[:1] == "\0" else n if n[:1] == "\n" else " " + n for n in todo]), strict=True))
        for n, (word, tail) in marked.items():
            known[n] = known[word] + known[tail]
        self.held += sum(map(len, new)) + ENTRY * (len(known) - start)
        return [known[n] for n in names]
