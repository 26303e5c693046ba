"""Byte-level BPE by longest matches and memoised compatibility of neighbours.

A sequence of tokens is what the merges give exactly if each token is what its own bytes
merge to and each two neighbours are what their joined bytes merge to. So a piece is
encoded from its start with the longest token that fits its left neighbour, and stepped
back from where no token fits. Places that were found to lead nowhere are not tried
again, so the work is linear in the piece. Bytes are mapped to Latin-1 for pyahocorasick,
which finds all tokens in a piece in one pass.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and neighbour pairs that a worker remembers, for each of two generations.
REMEMBERED = 200_000

NEVER = 1 << 60

#: Bytes up to which a piece is worked on in lists, which are faster, and characters up to which it is remembered.
SHORT = 1 << 10


class Memory:
    """A bounded memo: what was used in the last two generations stays."""

    def __init__(self, size: int = REMEMBERED) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Characters from which on a text is split piece by piece.
LONG = 1 << 20
#: Ids that are written out at a time.
WRITTEN = 1 << 16


class BpeCodec:
    """Encodes and decodes by a rank table. ``pattern`` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pairs, self.pieces, self.edges = Memory(), Memory(), {1: Memory(), 2: Memory()}

    def merged(self, data: bytes) -> list[tuple[bytes, bytes, bytes]]:
        """The plain merges, lowest rank first: each part that is left with its two halves."""
        parts = [(data[i : i + 1], b"", b"") for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = min((rank(parts[i][0] + parts[i + 1][0], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            left, right = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(left + right, left, right)]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The parts that stood at a token's right (2) or left (1) end, each with the rank that ends it.

        None if its bytes don't merge to the token.
        """
        if (found := self.edges[side].get(token)) is None:
            found, part, until = [], token, NEVER
            while part:
                now = self.merged(part)
                if len(now) > 1:
                    found = []
                    break
                found.append((part, until))
                until, part = self.ranks[part], now[0][side]
            self.edges[side].put(token, found)
        return found or None

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the joined bytes merge to these two tokens.

        They don't if a part at the left one's end and one at the right one's start, both there
        at a time, merge before either is merged into its own token. Of equal merges the first
        in the text comes first.
        """
        if (found := self.pairs.get((left, right))) is None:
            rank, stops, starts = self.ranks.get, self.edge(left, 2), self.edge(right, 1)
            found = bool(stops and starts) and not any((m := rank(x + y)) is not None and m < ends and m <= ends_too for x, ends in stops for y, ends_too in starts)
            self.pairs.put((left, right), found)
        return found

    def encode_piece(self, data: bytes) -> Sequence[int]:
        """The ids of one piece. A piece that is itself a token is that token.

        Of all matches only the end of the longest from each place is held: 8 bytes for each
        byte of a long piece, and 4 for each id.
        """
        if (token := self.ranks.get(data)) is not None:
            return [token]
        n, rank, known = len(data), self.ranks, self.pairs.new.get
        longest, ids = ([0] * n, []) if n <= SHORT else (array("Q", bytes(8 * n)), array("I"))
        for end, size in self.automaton.iter(data.decode("latin-1")):  # in order of their ends: the longest comes last
            longest[end + 1 - size] = end + 1
        if not (at := longest[0]):
            raise ValueError("the rank table lacks bytes, so this piece has no ids")
        left = data[:at]
        ids.append(rank[left])
        while at < n:
            token = data[at : longest[at]]
            if not ((fits := known((left, token))) or fits is None and self.compatible(left, token)):
                return self.stepped_back(data, longest, ids)
            ids.append(rank[token])
            left, at = token, longest[at]
        return ids if self.edge(left, 1) is not None else self.stepped_back(data, longest, ids)

    def shorter(self, data: bytes, at: int, end: int) -> int:
        """The end of the next shorter token from ``at``, or ``at`` if there is none."""
        ranks = self.ranks
        for e in range(end - 1, at, -1):
            if data[at:e] in ranks:
                return e
        return at

    def stepped_back(self, data: bytes, longest: Sequence[int], begun: Sequence[int] = ()) -> Sequence[int]:
        """``encode_piece`` where the longest matches don't all fit; shorter ones are looked up where they are tried.

        ``begun`` are the ids of the longest matches up to where the next one doesn't fit.
        """
        n, known = len(data), self.pairs.new.get
        # Where tokens begin, and the end that is tried from each place.
        places, size = array("Q", [0]), self.bytes_of
        if begun and self.edge(size[begun[0]], 1) is not None:
            for i in begun:
                places.append(places[-1] + len(size[i]))
        at = places[-1]
        tries = places[1:]
        tries.append(longest[at] if at < n else 0)
        lost: set[tuple[int, int]] = set()
        left = data[places[-2] : at] if at else None
        while (at := places[-1]) < n:
            end = tries[-1]
            while end > at:
                token = data[at:end]
                if (at, end) not in lost:
                    if left is None:
                        if self.edge(token, 1) is not None:
                            break
                    elif (fits := known((left, token))) or fits is None and self.compatible(left, token):
                        break
                end = self.shorter(data, at, end)
            if end > at:
                tries[-1] = end
                places.append(end)
                tries.append(longest[end] if end < n else 0)
                left = token
                continue
            if len(places) == 1:
                raise ValueError("the rank table lacks bytes, so this piece has no ids")
            lost.add((places[-2], at))  # no token goes on from this one
            places.pop()
            tries.pop()
            tries[-1] = self.shorter(data, places[-1], tries[-1])
            left = data[places[-2] : places[-1]] if len(places) > 1 else None
        return array("I", (self.ranks[data[a:b]] for a, b in zip(places, islice(places, 1, None))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def piece(self, piece: str) -> tuple[str, bytes]:
        """A piece's ids as decimals joined by blanks, and the bytes that they decode to."""
        if (found := self.pieces.get(piece)) is None:
            ids = self.encode_piece(piece.encode())
            found = " ".join(" ".join(map(str, ids[i : i + WRITTEN])) for i in range(0, len(ids), WRITTEN)), self.decode(ids)
            if len(piece) <= SHORT:
                self.pieces.put(piece, found)
        return found

    def runs(self, text: str, run: int) -> Iterator[list[str]]:
        """The pieces of a text, some thousand at a time; those of a long text are not all held."""
        if len(text) <= LONG:
            pieces = self.pattern.findall(text)
            yield from (pieces[i : i + run] for i in range(0, len(pieces), run))
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, run)]:
            yield part

    def digest(self, text: str, run: int = 8192) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by blanks, SHA-256 of the decoded bytes."""
        n, ids_hash, byte_hash = 0, hashlib.sha256(), hashlib.sha256()
        recent = self.pieces.new.get
        for pieces in self.runs(text, run):
            decimals, decoded = zip(*[recent(p) or self.piece(p) for p in pieces])
            line = (" " if n else "") + " ".join(decimals)
            n += line.count(" ") + (not n)
            ids_hash.update(line.encode())
            byte_hash.update(b"".join(decoded))
            recent = self.pieces.new.get
        return n, ids_hash.hexdigest(), byte_hash.hexdigest()


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(path: str, pattern: str) -> BpeCodec:
    """One codec for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BpeCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>); null texts have no ids. A column of that name is replaced."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(ranks_path, pattern)
        return texts.map(lambda t: c.encode(t or ""))

    return docs.withColumn("token_ids", encode(F.col(f"`{text_col}`")))


def decode_ids(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary), the bytes of the ids; a column of that name is replaced."""

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(ranks_path, pattern)
        return ids.map(lambda x: c.decode([] if x is None else list(x)))

    return docs.withColumn("decoded", decode(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each whole text's ids and of what they decode to.

    One row for each row, repeated ones included; null text is empty: no ids, the digests
    of nothing. An id may be null. Columns other than the two named are not read. A text is
    worked on in runs of pieces; a piece is held whole, at some tens of bytes for each of its own.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks_path, pattern)
        for b in batches:
            rows = [c.digest(t or "") for t in b.text]
            yield pd.DataFrame({"id": b.id, "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return cols.mapInPandas(digests, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
