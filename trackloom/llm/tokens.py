"""Byte-level BPE over a whole corpus with a public vocabulary: a backtracking encoder and an offset-table decoder.

A piece of text is cut into tokens from the left, the longest token first. All tokens that occur in a piece come from one pass
of an Aho-Corasick automaton. A token may follow another only if merging by rank would keep the border between
them, which a table of compatible pairs, filled on demand, answers. Where no token fits, the last one is taken back and
its next shorter prefix is tried; a border given up is never tried again, so a piece takes linear time.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published split of texts into pieces for byte-level BPE.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, the pair each was merged from, and the automaton. Ids must grow in the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_of()
        spelled = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        self.merged = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
        made = {i: pair for pair, i in self.merged.items()}
        self.token = {b: i for b, i in spelled.items() if len(b) == 1 or i in made}
        size = max(self.token.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        for i, (a, b) in made.items():
            self.left[i], self.right[i] = a, b
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.token.items():
            self.bytes[i] = b
        self.length = [len(b) for b in self.bytes]
        self.prefix = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for b, i in self.token.items():
            self.automaton.add_word(b.decode("latin-1"), i)
            self.prefix[i] = next((self.token[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.token), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens ``a`` and ``b``."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            known = self.fits[key] = self._keeps_border(a, b)
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        """Undo the merges on both sides, latest first; a pair over the border that merges earlier than those breaks it."""
        bound = len(self.bytes)
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (a > b and not whole_a):
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.token.get(piece)
        if whole is not None:
            return (whole,)
        n, length = len(piece), self.length
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[longest[start]] < length[i]:
                longest[start] = i
        open_ = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            while token >= 0:
                end = pos + length[token]
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos]
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= length[token]
        return tuple(out)

    def decode(self, ids: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all lists together, and where each list's bytes begin; ``lists`` are the offsets into ``ids``."""
        size = np.diff(self.offsets)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends[:-1], size)
        return self.spelling[at], ends[lists]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Pieces(dict):
    """Ids of every piece met so far; emptied when it holds very many."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        got = self[piece] = self.v.encode(piece.encode())
        return got


def _encoder(path: str, text: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = _Pieces(vocabulary(path)), regex.compile(PIECES).findall
        for b in batches:
            off, flat = np.zeros(b.num_rows + 1, np.int32), []
            for i, t in enumerate(b.column(text).to_pylist()):
                if t:
                    flat.extend(chain.from_iterable(map(pieces.__getitem__, split(t))))
                off[i + 1] = len(flat)
            rest = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if i != text]
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), ids], names=[*(n for n, _ in rest), "ids"])

    return run


def encode(df: DataFrame, keep: list[str], text: str, path: str) -> DataFrame:
    """Token ids of every row's whole text: the columns ``keep`` and ``ids`` (array<int>), without special tokens.

    NULL and empty texts give an empty list; strings that spell special tokens are ordinary text. Repeated rows are kept.
    ``path`` names a byte-level BPE file (JSON with vocabulary and merges) that every executor can read. Nothing is shuffled.
    """
    if "ids" in keep:
        raise ValueError("keep may not hold ids")
    d = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(_encoder(path, len(keep)), f"{schema}{', ' if schema else ''}ids array<int>")


def decode(df: DataFrame, keep: list[str], ids: str, path: str) -> DataFrame:
    """The text of every row's ids: the columns ``keep`` and ``text``. NULL and empty lists give ''; broken UTF-8 becomes U+FFFD."""
    d = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            lists = b.column(at)
            size = np.asarray(lists.value_lengths())
            raw, starts = v.decode(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)]))
            raw = raw.tobytes()
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(texts, pa.string())], names=[*keep, "text"])

    return d.mapInArrow(run, f"{schema}{', ' if schema else ''}text string")
