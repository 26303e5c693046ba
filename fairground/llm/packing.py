"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's whole windows become sequences by themselves. The rests are gathered in
blocks whose total is just under a number of windows; the largest differencing method
merges partial partitions, the fullest window of one with the emptiest of the other, to
near-equal windows. Where one exceeds the capacity, the block gets another window.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import codec

#: Windows in a block, and the part of a window's tokens that a block leaves free so that windows can be uneven.
BLOCK_WINDOWS, SLACK = 32, 4
#: Rests of a block's windows that are cut into ever smaller pieces, which level the windows, and the
#: part of a window that such a piece has at least (but for what is left of a rest).
LEVELLERS, LEAST = 16, 64


def partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` windows with near-equal sums (multiway differencing).

    No sizes give ``k`` empty windows. Ties are broken by order, so the result is always
    the same.
    """
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [0] * (k - 1) + [size], [[] for _ in range(k - 1)] + [[i]]))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(k)]
    n = len(sizes)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, others, more = heap[0]
        merged = sorted(((s + o, j) for j, (s, o) in enumerate(zip(sums, reversed(others)))))
        least = merged[0][0]  # only differences matter
        joined = [members[j] + more[k - 1 - j] if members[j] or more[k - 1 - j] else members[j] for _, j in merged]
        heapq.heapreplace(heap, (least - merged[-1][0], n, [s - least for s, _ in merged], joined))
        n += 1
    return heap[0][3]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """``partition`` into as few windows as hold all; one more as long as any exceeds ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = partition(sizes, k)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        k += 1


def level(pieces: list[tuple], cut: int, at_least: int = 1) -> list[tuple]:
    """``pieces`` (doc, start, length) with the ``cut`` longest halved again and again, down to ``at_least``."""
    order = sorted(range(len(pieces)), key=lambda i: -pieces[i][2])
    out = [pieces[i] for i in sorted(order[cut:])]
    for doc, start, length in (pieces[i] for i in order[:cut]):
        while length > max(1, 2 * at_least - 1):
            half = (length + 1) // 2
            out.append((doc, start, half))
            start, length = start + half, length - half
        if length:
            out.append((doc, start, length))
    return out


def powers(n: int) -> list[int]:
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


class Packer:
    """Packs (doc, length) in order; yields sequences as lists of (doc, start, length)."""

    def __init__(self, capacity: int = 1024, windows: int = BLOCK_WINDOWS, levellers: int = LEVELLERS) -> None:
        self.capacity, self.levellers, self.least = capacity, levellers, max(1, capacity // LEAST)
        self.room = windows * capacity - capacity // SLACK
        self.block: list[tuple] = []
        self.held = 0

    def add(self, doc, length: int) -> Iterator[list[tuple]]:
        whole = length // self.capacity
        for i in range(whole):
            yield [(doc, i * self.capacity, self.capacity)]
        start, rest = whole * self.capacity, length % self.capacity
        while rest:
            part = min(rest, self.room - self.held)
            self.block.append((doc, start, part))
            self.held, start, rest = self.held + part, start + part, rest - part
            if self.held == self.room:
                yield from self.packed()

    def packed(self) -> Iterator[list[tuple]]:
        pieces = level(self.block, self.levellers, self.least)
        self.block, self.held = [], 0
        for w in windows_of([p[2] for p in pieces], self.capacity):
            yield [pieces[i] for i in sorted(w)]

    def rest(self) -> Iterator[list[tuple]]:
        """The last block: whole windows by differencing, what is over as powers of two; pieces may be short."""
        over, kept = self.held % self.capacity, []
        sizes, tail = powers(over), []
        for doc, start, length in self.block:
            while length and sizes:
                part = min(length, sizes[0])
                tail.append((doc, start, part))
                start, length = start + part, length - part
                sizes[0] -= part
                if not sizes[0]:
                    sizes.pop(0)
                    yield tail
                    tail = []
            if length:
                kept.append((doc, start, length))
        self.block, self.held = kept, self.held - over
        if kept:
            pieces = level(kept, max(self.levellers, 1))
            for w in windows_of([p[2] for p in pieces], self.capacity):
                yield [pieces[i] for i in sorted(w)]
        self.block, self.held = [], 0


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}
_tokenizers: dict[str, tuple[Tokenizer, list[str]]] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def tokenizer(path: str) -> tuple[Tokenizer, list[str]]:
    """The tokenizer of a file, and the strings of its added tokens."""
    if path not in _tokenizers:
        found = Tokenizer.from_file(path)
        _tokenizers[path] = found, [t.content for t in found.get_added_tokens_decoder().values()]
    return _tokenizers[path]


def ids_of(text: str, ranks_path: str, pattern: str, tokenizer_path: str | None = None) -> np.ndarray:
    """The ids that the tokenizer of the file gives, without tokens added around the text.

    They are taken from the same vocabulary's ranks, which is faster, unless the text holds
    the string of an added token. The pattern's backtracking runs out of stack on about a million
    blanks in a row; the tokenizer of the file, or this library's own codec, then takes its place.
    """
    full, added = tokenizer(tokenizer_path) if tokenizer_path else (None, [])
    if not any(a in text for a in added):
        try:
            return encoding(ranks_path, pattern).encode_to_numpy(text)
        except ValueError:
            if full is None:
                return np.array(codec(ranks_path, pattern).encode(text), np.uint32)
    return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece of each document, with the sequence and the offset it stands at.

    Each scan partition packs its own rows block by block: no shuffle, and a worker holds
    one block. Columns: the id, ``start``, ``length``, ``ids_crc32`` (little-endian unsigned
    32-bit ids), ``doc_tokens`` (with the end id), ``sequence_id`` (unique; the partition's
    number and a count, so a task that runs again gives the same), ``offset`` and, if
    ``with_ids``, ``ids``. Each row is a document, also if ids repeat or are null; null text
    is empty and has only the end id. Other columns are not read. An empty table has no
    pieces. With ``tokenizer_path``, strings of that tokenizer's added tokens in a text have its
    ids; without, they are ordinary text. Only a sequence shorter than ``capacity`` that is no power of two needs padding.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity)
        count, base = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        out: list[tuple] = []

        def placed(sequences: Iterator[list[tuple]]) -> None:
            nonlocal count
            for seq in sequences:
                offset = 0
                for (doc, ids, total, moved), start, length in seq:
                    part = ids[start - moved : start - moved + length]
                    row = (doc, start, length, zlib.crc32(part.tobytes()), total, base + count, offset)
                    out.append((*row, part.astype(np.int64)) if with_ids else row)
                    offset += length
                count += 1

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for b in batches:
            for doc, text in zip(b.id.tolist(), b.text.tolist()):
                ids = np.append(ids_of(text, ranks_path, pattern, tokenizer_path), np.uint32(end_id)).astype("<u4")
                placed(packer.add((None if pd.isna(doc) else doc, ids, len(ids), 0), len(ids)))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        placed(packer.rest())
        if out:
            yield pd.DataFrame(out, columns=names)

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return cols.mapInPandas(pieces, schema).withColumnRenamed("id", id_col)
