"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

Every window of ``length`` bytes is owned by the smallest of the fingerprints of its
``seed``-byte substrings, which equal windows have at the same place. So windows that follow
each other with one owner form a run, and equal windows lie in runs with equal owners: only
there suffixes need sorting. Runs equal as a whole are counted by 128-bit digests; of the rest, each
kind is taken once, and what stands to the right of the owner, and mirrored to the left of it,
is sorted: multikey quicksort to a shallow depth, then blind tries for groups with longer common
prefixes. Two windows are equal if both neighbours' prefixes reach over the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked


@dataclass(frozen=True)
class Settings:
    length: int = 400  #: bytes of a repeated string
    seed: int = 128  #: bytes of the owner, at most half of ``length``
    shallow: int = 32  #: bytes that are sorted before blind tries begin
    block: int = 4_096  #: kinds of a hot owner that are sorted together
    chunk: int = 16_384  #: rows that are sorted at a time


PLACE = 20
RUN_WINDOWS = 1 << 19  #: windows of a text that are looked at together


def _inverse(odd: int) -> int:
    y = 1
    for _ in range(7):
        y = y * (2 - odd * y) % (1 << 64)
    return y


class Fingerprints:
    """Polynomial hashes of all substrings of a text, by prefix sums modulo 2^64.

    They choose owners only. Different substrings may share one, which costs time and no
    right result: runs are told apart by digests of their bytes.
    """

    _tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray) -> None:
        if Fingerprints._tables is None:
            rng = np.random.default_rng(1)
            values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
            odd = int(rng.integers(0, 1 << 62)) * 2 + 1
            n = RUN_WINDOWS + (1 << 16)
            with np.errstate(over="ignore"):
                powers = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (odd, _inverse(odd))]
            Fingerprints._tables = values, *powers
        values, powers, self.undo = Fingerprints._tables
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.undo[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def runs(data: bytes, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner's fingerprint, two halves of a digest of the run's bytes and its owner's place, owner's place, first and last window) of a text's runs."""
    x = np.frombuffer(data, np.uint8)
    width = s.length - s.seed + 1
    for begin in range(0, len(x) - s.length + 1, RUN_WINDOWS):
        part = x[begin : begin + RUN_WINDOWS + s.length - 1]
        at = np.arange(len(part) - s.seed + 1)
        owners = Fingerprints(part)(at, at + s.seed)
        keys = owners >> np.uint64(PLACE) << np.uint64(PLACE) | at.astype(np.uint64)
        blocks = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
        up, down = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n = len(part) - s.length + 1
        own = (np.minimum(down[:n], up[width - 1 : width - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        digest = hashlib.blake2b
        spans = zip((begin + first).tolist(), (begin + last + s.length).tolist(), (own[first] - first).tolist())
        both = b"".join([digest(data[a:b], digest_size=16, salt=place.to_bytes(8, "little")).digest() for a, b, place in spans])
        digests = np.frombuffer(both, "<u8").reshape(-1, 2)
        yield owners[own[first]], digests[:, 0], digests[:, 1], begin + own[first], begin + first, begin + last


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class _Branch:
    __slots__ = ("depth", "kids", "any")

    def __init__(self, depth: int, kids: dict, any_: int) -> None:
        self.depth, self.kids, self.any = depth, kids, any_


def trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings, by a blind trie: it holds only the bytes where strings part.

    Going down looks at those bytes alone; one comparison with the leaf that is met tells where
    the new string leaves the trie.
    """
    at = lambda s, i: s[i] if i < len(s) else -1
    root: _Branch | list[int] = [members[0]]
    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node, _Branch):
            node = node.kids.get(at(s, node.depth)) or [node.any]
        other = strings[node[0]]
        shared = common_prefix(s, other)
        node, parent, key = root, None, None
        while isinstance(node, _Branch) and node.depth < shared:
            parent, key = node, at(s, node.depth)
            node = node.kids[key]
        if isinstance(node, _Branch) and node.depth == shared:
            node.kids.setdefault(at(s, shared), []).append(m)  # there already only if the strings are equal
        elif isinstance(node, list) and len(s) == len(other) == shared:
            node.append(m)
        else:
            fork = _Branch(shared, {at(other, shared): node, at(s, shared): [m]}, m)
            if parent is None:
                root = fork
            else:
                parent.kids[key] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out += node
        else:
            stack += [node.kids[k] for k in sorted(node.kids, reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], group: np.ndarray, known: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` by (group, bytes) and each one's common prefix with the one before (-1 at a group's start).

    All strings of a group have their first ``known`` bytes in common. Eight bytes are the
    character of the quicksort; after ``shallow`` bytes blind tries sort what is still together.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in strings])
    width = -(-int(max(sizes.max(), known + shallow, 8)) // 8) * 8
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(n, width)
    words = np.ascontiguousarray(table).view(">u8")
    order = np.argsort(group, kind="stable")
    bucket = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])])
    start = known // 8
    for w in range(start, min(width // 8, start + max(1, shallow // 8))):
        counts = np.bincount(bucket)
        open_ = counts[bucket] > 1
        if not open_.any():
            break
        rows, b = order[open_], bucket[open_]
        key, end = words[rows, w].astype(np.uint64), np.minimum(sizes[rows], 8 * w + 8)
        by = np.lexsort((end, key, b))
        order[open_] = rows[by]
        parted = np.zeros(n, bool)
        b, key, end = b[by], key[by], end[by]
        parted[np.flatnonzero(open_)[1:]] = (b[1:] == b[:-1]) & ((key[1:] != key[:-1]) | (end[1:] != end[:-1]))
        new = np.concatenate([[False], bucket[1:] != bucket[:-1]]) | parted
        bucket = np.cumsum(new)
    counts = np.bincount(bucket)
    for k in np.flatnonzero(counts > 1):
        lo = np.searchsorted(bucket, k)
        part = slice(lo, lo + counts[k])
        order[part] = trie_order(strings, order[part].tolist())
    lcp = np.full(n, -1, np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    for i in range(0, len(same), 4096):
        k = same[i : i + 4096]
        differ = table[order[k]] != table[order[k - 1]]
        lcp[k] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(sizes[order[k]], sizes[order[k - 1]]))
    return order, lcp


def repeated_windows(frame: pd.DataFrame, s: Settings) -> list[np.ndarray]:
    """For each row (one kind of run): which of its windows other rows of its group have, too.

    Columns: group, own (the owner's place in ``bytes``), bytes. A window that lies ``r`` bytes
    left of the owner is one class by its left ``r`` and right ``length - r`` bytes.
    """
    n = len(frame)
    own, data = frame.own.to_numpy(), frame.bytes.tolist()
    group = pd.factorize(frame.group)[0]
    right = [d[o:] for d, o in zip(data, own)]
    left = [d[:o][::-1] for d, o in zip(data, own)]
    r_order, r_lcp = deep_shallow_sort(right, group, s.seed, s.shallow)
    l_order, l_lcp = deep_shallow_sort(left, group, 0, s.shallow)
    count = np.array([len(d) for d in data]) - s.length + 1
    far, near = own, own - count + 1  # largest and smallest r
    hit = [np.zeros(c, bool) for c in count]
    for r in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
        on = (near <= r) & (r <= far)
        classes = np.empty((2, n), np.int64)
        classes[0, l_order], classes[1, r_order] = np.cumsum(l_lcp < r), np.cumsum(r_lcp < s.length - r)
        rows = np.flatnonzero(on)
        if len(rows) < 2:
            continue
        key = classes[0, rows] * (n + 1) + classes[1, rows]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        both = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        for i in rows[by[both]]:
            hit[i][far[i] - r] = True
    return hit


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def merged(pairs: list) -> list[tuple[int, int]]:
    """Maximal byte runs [lo, hi) of overlapping or touching ones."""
    out: list[list[int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _squeezed(docs: DataFrame, kind: str) -> DataFrame:
    """id, text_hash and the compressed text, so that less is shuffled."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pd.DataFrame({"id": b.id, "text_hash": b.text_hash, "text": [c(t.encode()) for t in b.text]})

    return docs.mapInPandas(squeeze, f"id {kind}, text_hash long, text binary")


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For (id, text_hash, text) the places where windows repeat: (id, text_hash, spans).

    ``spans`` are structs (lo, hi) of bytes, in any order; only texts that have some are returned.
    """
    s = settings
    kind = docs.schema["id"].dataType.simpleString()
    by_row = ["id", "text_hash"]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in enumerate(b.text):
                data = text.encode()
                out += [(np.full(len(r[0]), i), *r) for r in runs(data, s)]
            if out:
                row, owner, f1, f2, at, first, last = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"id": b.id.to_numpy()[row], "text_hash": b.text_hash.to_numpy()[row], "owner": owner.view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64), "at": at, "first": first, "last": last})

    long_enough = docs.where(F.octet_length("text") >= s.length)
    all_runs = long_enough.mapInPandas(found, f"id {kind}, text_hash long, owner long, f1 long, f2 long, at long, first long, last long")
    # Stored, as it is read twice and texts would be fingerprinted for each.
    counted = stored(all_runs.groupBy("owner", "f1", "f2").agg(F.count("*").alias("n")), "run-counts")
    owners = counted.groupBy("owner").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("total > 1")
    marks = counted.join(owners, "owner").select("owner", "f1", "f2", "n", F.when((F.col("kinds") > 1) & (F.col("single") > 0), F.col("kinds")).otherwise(0).alias("kinds")).where("n > 1 or kinds > 0")
    known = stored(all_runs.join(marks, ["owner", "f1", "f2"]), "runs")
    whole = known.where("n > 1").select(*by_row, F.col("first").alias("lo"), (F.col("last") + s.length).alias("hi"))

    # One run of each kind goes on, with its bytes.
    once = known.where("kinds > 0 and n = 1").unionByName(known.where("kinds > 0 and n > 1").dropDuplicates(["owner", "f1", "f2"]))
    asked = once.groupBy(*by_row).agg(F.collect_set(F.struct("owner", "at", "first", "last", "n", "kinds", F.pmod(F.col("f1"), F.ceil(F.col("kinds") / s.block)).alias("part"))).alias("runs"))
    texts = _squeezed(long_enough, kind).withColumnRenamed("id", "id_").withColumnRenamed("text_hash", "hash_")
    held = asked.join(texts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))).dropDuplicates(["id", "text_hash"]).select(*by_row, "runs", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, h, rs, text in zip(b.id, b.text_hash, b.runs, b.text):
                data = zstandard.decompress(text)
                out += [(id_, h, r["owner"], r["part"], r["kinds"], r["n"], r["first"], r["at"] - r["first"], data[r["first"] : r["last"] + s.length]) for r in rs]
            yield pd.DataFrame(out, columns=["id", "text_hash", "owner", "part", "kinds", "n", "first", "own", "bytes"])

    pieces = held.mapInPandas(cut, f"id {kind}, text_hash long, owner long, part long, kinds long, n long, first long, own long, bytes binary")
    dealt = pieces.repartition("owner", "part").sortWithinPartitions("owner", "part")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come one after the other; whole groups are sorted together, some thousand rows at a time."""
        rest: pd.DataFrame | None = None

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.assign(group=list(zip(frame.owner, frame.part))).reset_index(drop=True)
            out = []
            for row, hit in zip(frame.itertuples(index=False), repeated_windows(frame, s)):
                if row.n == 1:
                    out += [(row.id, row.text_hash, row.first + a, row.first + b + s.length, None) for a, b in spans_of(hit)]
                if row.kinds > s.block:  # its owner has other blocks
                    left = np.flatnonzero(~hit) if row.n == 1 else []
                    out += [(row.id, row.text_hash, row.first + w, row.first + w + s.length, hashlib.blake2b(row.bytes[w : w + s.length], digest_size=16).digest()) for w in left]
                    told = np.flatnonzero(hit) if row.n == 1 else range(len(hit))
                    out += [(None, None, None, None, hashlib.blake2b(row.bytes[w : w + s.length], digest_size=16).digest()) for w in told]
            names = ("id", "text_hash", "lo", "hi", "window")  # object columns: 64-bit hashes beside nulls stay exact
            return pd.DataFrame({k: pd.Series([r[i] for r in out], dtype=object) for i, k in enumerate(names)}).drop_duplicates()

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest) >= s.chunk:
                same = (rest.owner == rest.owner.iloc[-1]) & (rest.part == rest.part.iloc[-1])
                if not same.all():
                    yield done(rest[~same])
                    rest = rest[same]
        if rest is not None and len(rest):
            yield done(rest)

    partial = stored(dealt.mapInPandas(compared, f"id {kind}, text_hash long, lo long, hi long, window binary"), "windows")
    sure = partial.where("window is null").select(*by_row, "lo", "hi")
    # Windows of owners with several blocks that their own block doesn't repeat: another may.
    unsure = partial.where("window is not null")
    twice = unsure.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    others = unsure.where("lo is not null").join(twice, "window").select(*by_row, "lo", "hi")
    spans = whole.unionByName(sure).unionByName(others)
    return spans.groupBy(*by_row).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the bytes of strings of ``length`` bytes that start anywhere else, too.

    Texts are UTF-8 bytes, null text is empty; matches never cross documents. Each byte
    covered by such a string goes, from every copy: strings are judged on the input. Rows that
    repeat are copies of each other, so long texts among them become empty. Added columns:
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary, the rest
    joined). ``text`` is ``kept`` as text; bytes of characters that were cut through are left
    out of it. Null ids are ids; other columns pass unchanged; empty tables stay empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = packed(docs, id=F.col(f"`{id_col}`"), text_hash=F.xxhash64(text), text=text)
    spans = repeated_spans(rows.select("id", "text_hash", "text"), settings).select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "spans")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")

    @F.pandas_udf("removed long, spans long, kept binary, text string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, cuts in batches:
            out = []
            for t, c in zip(texts, cuts):
                data, pieces, at, removed = t.encode(), [], 0, 0
                found = merged(list(c)) if c is not None else []
                for lo, hi in found:
                    pieces.append(data[at:lo])
                    removed, at = removed + hi - lo, hi
                kept = b"".join(pieces) + data[at:]
                out.append((removed, len(found), kept, kept.decode(errors="ignore")))
            yield pd.DataFrame(out, columns=["removed", "spans", "kept", "text"])

    full = joined.withColumn("rest", rest("text", "spans"))
    named = {text_col: F.col("rest.text"), "n_bytes": F.octet_length("text").cast("long"), "n_removed": F.col("rest.removed"), "n_spans": F.col("rest.spans"), "kept": F.col("rest.kept")}
    return unpacked(full, docs, **named)


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row for each of ``docs``: the id, n_bytes, n_removed, n_spans and kept_sha256; cases as ``dedup_spans``.

    Texts without repeats are digested where they are scanned; only those with repeats are
    brought to their spans, compressed.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = repeated_spans(base, settings).select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "spans")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & (F.col("text_hash") == F.col("hash_"))
    cut = _squeezed(base.where(F.octet_length("text") >= settings.length), kind).join(spans, same("id", "id_")).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", "text", "spans")

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, h, t, c in zip(b.id, b.text_hash, b.text, b.spans):
                data, digest, at, removed = zstandard.decompress(t), hashlib.sha256(), 0, 0
                found = merged(list(c))
                for lo, hi in found:
                    digest.update(data[at:lo])
                    removed, at = removed + hi - lo, hi
                digest.update(data[at:])
                out.append((id_, h, removed, len(found), digest.hexdigest()))
            yield pd.DataFrame(out, columns=["id_", "hash_", "removed", "spans", "sha"])

    done = cut.mapInPandas(rest, f"id_ {kind}, hash_ long, removed long, spans long, sha string")
    plain = base.select("id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("full"))
    out = plain.join(done, same("id", "id_"), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "full").alias("kept_sha256"))
