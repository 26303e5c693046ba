"""Jaccard self-join on word n-grams with Bayesian pruning of candidates.

Texts with equal n-gram sets are one class. Classes that agree in a band of MinHash values
are candidates; what is connected by such bands is compared in blocks, each block in one
task. There, MinHash values are compared a part at a time and a pair is dropped once the
posterior probability that its similarity reaches the threshold is under a tolerance; the
pairs that are left are verified on their whole n-gram sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked
from .graph import components

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5  #: MinHash values in a band; at similarity 0.8 no band agrees with probability 3e-6
    tolerance: float = 1e-6  #: posterior probability under which a pair is dropped
    step: int = 40  #: MinHash values compared at a time
    block: int = 1_024  #: classes of a block
    block_bytes: int = 32 << 20  #: bytes of text of a block, unless one text is longer
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word n-grams.

    Words are runs of letters, digits and underscores in lower case. A text of fewer words
    than ``words``, but with one at least, is one n-gram.
    """
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
            out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray, s: Settings) -> np.ndarray:
    """16 bits of each of the MinHash values."""
    rng = np.random.default_rng(s.seed)
    a, b = rng.integers(0, 1 << 32, (2, s.hashes), dtype=np.uint64).astype(np.uint32)
    a |= np.uint32(1)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(s.hashes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i : i + 2048, None] * a + b).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def band_keys(signatures: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = signatures.reshape(len(signatures), s.bands, s.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, s.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for j in range(s.rows):
            key = (key ^ parts[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key


def fewest_matches(s: Settings) -> list[tuple[int, int]]:
    """For each number n of values compared, the fewest that must agree.

    From a uniform prior, after k of n agree, P(similarity >= t) is the chance that a binomial
    variable with n + 1 trials of probability t is at most k.
    """
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        total, k = 0.0, -1
        while True:
            total += math.comb(n + 1, k + 1) * s.threshold ** (k + 1) * (1 - s.threshold) ** (n - k)
            if total >= s.tolerance:
                break
            k += 1
        out.append((n, k + 1))
    return out


def candidate_pairs(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, same: bool, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that share a band and that the Bayesian test keeps."""
    keys_a, keys_b = band_keys(a, s), band_keys(b, s)
    shared = np.zeros((len(a), len(b)), bool)
    for j in range(s.bands):
        shared |= keys_a[:, j, None] == keys_b[None, :, j]
    if same:
        shared = np.triu(shared, 1)
    # Sets whose sizes differ too much can't be similar.
    small, large = np.minimum(sizes_a[:, None], sizes_b[None, :]), np.maximum(sizes_a[:, None], sizes_b[None, :])
    i, j = np.nonzero(shared & (small >= s.threshold * large - 1e-9))
    agreed, last = np.zeros(len(i), np.int32), 0
    for n, least in fewest_matches(s):
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            agreed[part] += (a[i[part], last:n] == b[j[part], last:n]).sum(1)
        keep = agreed >= least
        i, j, agreed, last = i[keep], j[keep], agreed[keep], n
    return i, j


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs, exactly."""
    out = np.zeros(len(i), np.int64)
    if len(i) < 2_000:
        for p, (x, y) in enumerate(zip(i, j)):
            u, v = sets_a[x], sets_b[y]
            at = np.searchsorted(v, u)
            out[p] = (v[np.minimum(at, len(v) - 1)] == u).sum()
        return out
    rows_a, rows_b = np.unique(i), np.unique(j)
    ia, jb = np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)
    flat_a, flat_b = np.concatenate([sets_a[r] for r in rows_a]), np.concatenate([sets_b[r] for r in rows_b])
    both = np.intersect1d(flat_a, flat_b)
    place = lambda flat, sets, rows: (np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows]), np.searchsorted(both, flat))
    (ra, ca), (rb, cb) = place(flat_a, sets_a, rows_a), place(flat_b, sets_b, rows_b)
    fine = lambda r, c, flat: (k := both[np.minimum(c, len(both) - 1)] == flat, r[k], c[k])[1:] if len(both) else (r[:0], c[:0])
    (ra, ca), (rb, cb) = fine(ra, ca, flat_a), fine(rb, cb, flat_b)
    product = np.zeros((len(rows_a), len(rows_b)), np.float32)
    order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[order_a], ra[order_a], cb[order_b], rb[order_b]
    for start in range(0, len(both), 2048):
        ends = [np.searchsorted(c, [start, start + 2048]) for c in (ca, cb)]
        m = [np.zeros((n, 2048), np.float32) for n in (len(rows_a), len(rows_b))]
        for x, c, r, (lo, hi) in zip(m, (ca, cb), (ra, rb), ends):
            x[r[lo:hi], c[lo:hi] - start] = 1
        product += m[0] @ m[1].T  # counts under 2^24 are exact
    return product[ia, jb].astype(np.int64)


def compare_blocks(a: pd.DataFrame, b: pd.DataFrame | None, s: Settings) -> pd.DataFrame:
    """Links within ``a``, or between ``a`` and ``b``: for each class, linked documents and classes, and one edge.

    Columns of both: c, copies, n, sig, text (compressed). The edges span what is linked.
    """
    same = b is None
    b = a if same else b
    sig = [np.frombuffer(b"".join(x.sig), "<u2").reshape(len(x), s.hashes) for x in (a, b)]
    i, j = candidate_pairs(sig[0], sig[1], a.n.to_numpy(), b.n.to_numpy(), same, s)
    cache: list[dict[int, np.ndarray]] = [{}, {}]
    for side, (frame, rows) in enumerate(((a, i), (b, j))):
        texts = frame.text.to_numpy()
        for r in np.unique(rows):
            cache[side][r] = shingles(zstandard.decompress(texts[r]).decode(), s.words)
    if same:
        cache[0].update(cache[1])
        cache[1] = cache[0]
    common = overlaps(cache[0], cache[1], i, j)
    either = a.n.to_numpy()[i] + b.n.to_numpy()[j] - common
    linked = common >= s.threshold * either - 1e-9
    i, j = i[linked], j[linked]

    names = np.concatenate([a.c.to_numpy(), [] if same else b.c.to_numpy()]).astype(object)
    copies = np.concatenate([a.copies.to_numpy(), [] if same else b.copies.to_numpy()]).astype(np.int64)
    j = j if same else j + len(a)
    m = len(names)
    docs = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
    sets = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
    root = np.arange(m)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i, j):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    on = np.flatnonzero(sets)
    return pd.DataFrame({"c": names[on], "docs": docs[on].astype(np.int64), "sets": sets[on].astype(np.int64), "other": names[[top(x) for x in on]]})


@dataclass
class Links:
    rows: DataFrame  #: row (the input's), id, c (class, null without words), n
    classes: DataFrame  #: c, rep (smallest id), copies
    links: DataFrame  #: c, docs, sets (linked documents and classes), root (class of the group)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Links:
    s = settings
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b.text:
                g = shingles(text, s.words)
                rows.append((hashlib.blake2b(g.tobytes(), digest_size=16).digest(), len(g), len(text), signature(g, s).tobytes()) if len(g) else (None, 0, 0, None))
            yield pd.DataFrame({"id": b.id, "text_hash": b.text_hash, "c": [r[0] for r in rows], "n": [r[1] for r in rows], "bytes": [r[2] for r in rows], "sig": [r[3] for r in rows]})

    signs = stored(base.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(signed, f"id {kind}, text_hash long, c binary, n long, bytes long, sig binary"), "signatures")
    worded = signs.where("c is not null")
    classes = worded.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("id", "text_hash")).alias("of"), F.first("n").alias("n"), F.max("bytes").alias("bytes"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = band_keys(np.frombuffer(b"".join(b.sig), "<u2").reshape(len(b), s.hashes), s)
                yield pd.DataFrame({"band": keys.view(np.int64).ravel(), "c": np.repeat(b.c.to_numpy(), s.bands)})

    bands = classes.select("c", "sig").mapInPandas(banded, "band long, c binary")
    shared = bands.groupBy("band").agg(F.min("c").alias("least"), F.count("*").alias("m")).where("m > 1").select("band", "least")
    edges = bands.join(shared, "band").where(F.col("c") != F.col("least")).select(F.col("c").alias("u"), F.col("least").alias("v"))
    near = components(edges)

    # Blocks are bounded in classes and in bytes of text.
    weighed = near.join(classes.select(F.col("c").alias("node"), "bytes"), "node")
    sizes = weighed.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / s.block, F.sum("bytes") / s.block_bytes)).cast("int").alias("blocks"))
    sized = near.join(sizes, "root").select(F.col("node").alias("c"), F.col("root").alias("near"), "blocks")
    wanted = classes.join(sized, "c")

    def compressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pd.DataFrame({"id": b.id, "text_hash": b.text_hash, "text": [squeeze((t or "").encode()) for t in b.text]})

    squeezed = base.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(compressed, f"id {kind}, text_hash long, text binary")
    # One row of each class; rows that repeat it are dropped after the join.
    same_row = F.col("of.id").eqNullSafe(F.col("id")) & (F.col("of.text_hash") == F.col("text_hash"))
    texts = wanted.join(squeezed, same_row).groupBy("c").agg(F.first("near").alias("near"), F.first("blocks").alias("blocks"), F.first("copies").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("text").alias("text"))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = texts.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("near", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "c", "copies", "n", "sig", "text")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame.lo.iloc[0], frame.hi.iloc[0]
        frame = frame.sort_values("c")
        first, second = frame[frame.mine == lo], None if lo == hi else frame[frame.mine == hi]
        if not len(first) or second is not None and not len(second):
            return pd.DataFrame({"c": [], "docs": [], "sets": [], "other": []})
        return compare_blocks(first, second, s)

    found = stored(dealt.groupBy("near", "lo", "hi").applyInPandas(compared, "c binary, docs long, sets long, other binary"), "links")
    groups = components(found.select(F.col("c").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("c").agg(F.sum("docs").alias("docs"), F.sum("sets").alias("sets"))
    links = groups.select(F.col("node").alias("c"), "root").join(counts, "c", "left")
    return Links(signs.select("id", "text_hash", "c", "n"), classes.select("c", "rep", "copies"), links)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row for each row of ``docs``: the id, ``class_id``, ``copy_id``, ``n_links`` and ``n_linked_sets``.

    ``copy_id`` is the smallest id among texts with the same n-gram set, ``class_id`` the
    smallest among all that links connect. ``n_links`` counts the other documents with
    similarity of the threshold or more, copies among them; ``n_linked_sets`` the different
    n-gram sets. Documents without words (null and empty texts too) link with none and are
    their own class. Rows that repeat are copies of each other. A null id is given null
    classes only if all its copies' ids are null. Other columns are not read; an empty table
    gives an empty table.
    """
    found = link(docs, id_col, text_col, settings)
    of_group = found.links.join(found.classes, "c").groupBy("root").agg(F.min("rep").alias("class_id"))
    by_class = found.classes.join(found.links.join(of_group, "root"), "c", "left").select("c", "rep", "copies", "docs", "sets", "class_id")
    full = found.rows.join(by_class, "c", "left")
    zero = F.lit(0).cast("long")
    return full.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("copy_id"),
        (F.coalesce(F.col("copies") - 1, zero) + F.coalesce("docs", zero)).alias("n_links"),
        F.coalesce("sets", zero).alias("n_linked_sets"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents of each group but that with the smallest id; columns as they are.

    Rows that repeat the smallest id and its text are one document: one of them stays. Rows
    that repeat it with another text go like others. Documents without words all stay.
    """
    found = link(docs, id_col, text_col, settings)
    first = found.rows.where("c is not null").join(found.links, "c", "left").groupBy(F.coalesce("root", "c").alias("g")).agg(F.min(F.struct("id", "text_hash")).alias("first"))
    wordless = found.rows.where("c is null").select("id", "text_hash").distinct()
    keys = first.select(F.col("first.id").alias("k"), F.col("first.text_hash").alias("h"), F.lit(True).alias("worded")).unionByName(wordless.select(F.col("id").alias("k"), F.col("text_hash").alias("h"), F.lit(False).alias("worded")))
    rows = packed(docs, id=F.col(f"`{id_col}`"), text_hash=F.xxhash64(F.col(f"`{text_col}`")), place=F.monotonically_increasing_id())
    kept = rows.join(keys, F.col("id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    one = kept.withColumn("place", F.when(F.col("worded"), -1).otherwise(F.col("place"))).dropDuplicates(["id", "text_hash", "place"])
    return unpacked(one.select("row"), docs)
