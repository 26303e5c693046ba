"""Copies among images by local descriptors.

Corners are found at several scales; around each, intensity comparisons turned to the patch's
own orientation give 256 bits. Equal 40-bit parts of descriptors (Hamming tables) are counted for
each pair of images; pairs that share enough are compared block by block, where descriptors are
matched and a similarity transform must agree on enough of them. That holds for crops and edits.
Images are 8-bit grey PGM (P5) bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components


@dataclass(frozen=True)
class Settings:
    scales: tuple[float, ...] = (1.0, 0.5)
    corners: int = 32  #: strongest corners at a scale
    radius: int = 14  #: of a patch
    shared_parts: int = 6  #: parts that a pair of images shares
    distance: int = 48  #: bits in which matched descriptors may differ
    agreeing: int = 7  #: matches that one transform must explain
    block: int = 512
    seed: int = 3


PARTS, PART_BYTES, BITS, ANGLES = 8, 5, 256, 32


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels, or None for what is no 8-bit binary PGM."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", bytes(data or b""))
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    x = np.frombuffer(data, np.uint8, offset=m.end())
    return x[: w * h].reshape(h, w) if w * h and len(x) >= w * h else None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r+1, edges repeated."""
    p = np.pad(x, r + 1, mode="edge")[:-1, :-1].astype(np.float64).cumsum(0).cumsum(1)
    k = 2 * r + 1
    s = p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]
    return (s / k**2)[: x.shape[0], : x.shape[1]] if s.shape[0] >= x.shape[0] else np.pad(s / k**2, ((0, x.shape[0] - s.shape[0]), (0, x.shape[1] - s.shape[1])), mode="edge")


def _pattern(s: Settings) -> np.ndarray:
    """Pairs of points for each bit, turned to each of the angles: angle x bit x 2 x (dy, dx)."""
    rng = np.random.default_rng(s.seed)
    points = np.clip(rng.normal(0, s.radius / 2, (BITS, 2, 2)), -s.radius * 0.7, s.radius * 0.7)
    turn = 2 * np.pi * np.arange(ANGLES) / ANGLES
    y, x = points[..., 0], points[..., 1]
    c, d = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    return np.round(np.stack([x * d + y * c, x * c - y * d], -1)).astype(np.int64)


_patterns: dict[Settings, np.ndarray] = {}


def describe(pixels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Corners (y, x, scale, angle number), in the image's own pixels, and their descriptors (4 x 64 bits each)."""
    if s not in _patterns:
        _patterns[s] = _pattern(s)
    pattern, r = _patterns[s], s.radius
    places, bits = [], []
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    disc = dy**2 + dx**2 <= r * r
    for scale in s.scales:
        step = round(1 / scale)
        h, w = pixels.shape[0] // step, pixels.shape[1] // step
        if min(h, w) < 2 * r + 4:
            continue
        image = pixels[: h * step, : w * step].reshape(h, step, w, step).mean((1, 3)) if step > 1 else pixels.astype(np.float64)
        gy, gx = np.gradient(_box(image, 1))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = np.full_like(response, -np.inf)
        m = r + 1
        inner[m:-m, m:-m] = response[m:-m, m:-m]
        top = inner.copy()
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                top = np.maximum(top, np.roll(np.roll(inner, sy, 0), sx, 1))
        ys, xs = np.nonzero((inner == top) & (inner > 1.0))
        best = np.lexsort((xs, ys, -np.round(inner[ys, xs], 6)))[: s.corners]
        ys, xs = ys[best], xs[best]
        if not len(ys):
            continue
        smooth = _box(image, 1)
        patch = image[ys[:, None, None] + dy, xs[:, None, None] + dx] * disc
        angle = np.round(np.arctan2((patch * dy).sum((1, 2)), (patch * dx).sum((1, 2))) / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        at = pattern[angle]
        values = smooth[ys[:, None, None] + at[..., 0], xs[:, None, None] + at[..., 1]]
        bits.append(np.packbits(values[:, :, 0] < values[:, :, 1], axis=1).view("<u8"))
        places.append(np.stack([ys * step, xs * step, np.full(len(ys), step), angle], 1))
    if not places:
        return np.zeros((0, 4), np.int64), np.zeros((0, 4), np.uint64)
    return np.concatenate(places), np.concatenate(bits)


def parts_of(bits: np.ndarray) -> np.ndarray:
    """A key for each of the overlapping 40-bit parts of descriptors, other for each table."""
    octets = np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), BITS // 8)
    at = (np.arange(PARTS)[:, None] * (BITS // 8 // PARTS) + np.arange(PART_BYTES)) % (BITS // 8)
    x = np.zeros((len(bits), PARTS, 8), np.uint8)
    x[:, :, :PART_BYTES] = octets[:, at]
    with np.errstate(over="ignore"):
        y = (x.view(np.uint64)[:, :, 0] ^ np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (y ^ y >> np.uint64(31)).view(np.int64)


def agreeing(pa: np.ndarray, ba: np.ndarray, pb: np.ndarray, bb: np.ndarray, s: Settings) -> int:
    """How many matched corners one turn, scale and shift explain."""
    if not len(pa) or not len(pb):
        return 0
    d = np.bitwise_count(ba[:, None, :] ^ bb[None, :, :]).sum(2)
    i = np.arange(len(pa))
    j = d.argmin(1)
    keep = (d[i, j] <= s.distance) & (d.argmin(0)[j] == i)
    i, j = i[keep], j[keep]
    if len(i) < s.agreeing:
        return 0
    turn = (pb[j, 3] - pa[i, 3]) % ANGLES
    ratio = np.log2(pb[j, 2] / pa[i, 2])
    best = 0
    for t, q in {(t, q) for t, q in zip(turn.tolist(), ratio.tolist())}:
        # Neighbouring angles are one turn, since each angle is rounded.
        on = (np.minimum((turn - t) % ANGLES, (t - turn) % ANGLES) <= 1) & (ratio == q)
        phi, k = 2 * np.pi * t / ANGLES, 2.0**q
        y, x = pa[i[on], 0], pa[i[on], 1]
        oy, ox = pb[j[on], 0] - k * (y * np.cos(phi) + x * np.sin(phi)), pb[j[on], 1] - k * (x * np.cos(phi) - y * np.sin(phi))
        near = (np.abs(oy[:, None] - oy) <= 6) & (np.abs(ox[:, None] - ox) <= 6)
        best = max(best, int(near.sum(1).max(initial=0)))
    return best


def compare(a: pd.DataFrame, b: pd.DataFrame | None, s: Settings) -> pd.DataFrame:
    """Links within a block, or between two: for each image class, linked images and one edge."""
    same = b is None
    b = a if same else b
    unpack = lambda f: [(np.frombuffer(p, "<i8").reshape(-1, 4), np.frombuffer(x, "<u8").reshape(-1, 4)) for p, x in zip(f.places, f.bits)]
    da = unpack(a)
    db = da if same else unpack(b)
    keys = [[np.unique(parts_of(x[1])) for x in d] for d in (da, db)]
    common = np.intersect1d(np.concatenate(keys[0]), np.concatenate(keys[1]))
    shared = np.zeros((len(a), len(b)), np.float32)
    where = [[np.searchsorted(common, k[np.isin(k, common)]) for k in ks] for ks in keys]
    for start in range(0, len(common), 4096):
        m = [np.zeros((len(w), 4096), np.float32) for w in where]
        for x, ws in zip(m, where):
            for row, w in enumerate(ws):
                x[row, w[(w >= start) & (w < start + 4096)] - start] = 1
        shared += m[0] @ m[1].T
    if same:
        shared = np.triu(shared, 1)
    pairs = [(i, j) for i, j in zip(*np.nonzero(shared >= s.shared_parts)) if agreeing(*da[i], *db[j], s) >= s.agreeing]
    names = a.c.tolist() + ([] if same else b.c.tolist())
    copies = a.copies.tolist() + ([] if same else b.copies.tolist())
    links, root = [0] * len(names), list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        j += 0 if same else len(a)
        links[i] += copies[j]
        links[j] += copies[i]
        x, y = top(i), top(j)
        root[max(x, y)] = min(x, y)
    on = [i for i, n in enumerate(links) if n]
    return pd.DataFrame({"c": [names[i] for i in on], "links": [links[i] for i in on], "other": [names[top(i)] for i in on]})


def sharing_pairs(parts: DataFrame, least: int, block: int) -> DataFrame:
    """Pairs (u < v) of images that have at least ``least`` parts in common, counted for each pair.

    ``parts`` has ``part`` and ``no``, each once. An entry of over ``block`` images is split, and
    its blocks meet one another in tasks of their own.
    """
    entries = parts.groupBy("part").agg(F.count("*").alias("m")).where("m > 1").select("part", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    dealt = parts.join(entries, "part").withColumn("mine", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    one = dealt.select("part", F.col("mine").alias("lo"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("hi"), F.col("no").alias("a"))
    two = dealt.select("part", F.explode(F.sequence(F.lit(0), "mine")).alias("lo"), F.col("mine").alias("hi"), F.col("no").alias("b"))
    met = one.join(two, ["part", "lo", "hi"]).where("lo < hi or a < b")
    return met.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("u", "v")


def find_copies(images: DataFrame, id_col: str, image: Column, settings: Settings = Settings()) -> DataFrame:
    """A row for each row: the id, ``class_id``, ``copy_id``, ``n_corners`` and ``n_links``.

    ``image`` gives PGM bytes. ``copy_id`` is the smallest id with equal pixels, ``class_id`` the
    smallest among all that links connect; ``n_links`` counts other images that are copies or
    linked. Null, broken or featureless images have no corners; broken ones are their own
    class, and equal featureless ones copies. Repeated rows are copies; other columns are not
    read; an empty table gives an empty table.
    """
    s = settings
    kind = images.schema[id_col].dataType.simpleString()

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data in b.image:
                x = read_pgm(data)
                if x is None:
                    rows.append((None, 0, None, None))
                    continue
                places, bits = describe(x, s)
                rows.append((hashlib.blake2b(repr(x.shape).encode() + x.tobytes(), digest_size=16).digest(), len(places), places.astype("<i8").tobytes(), bits.astype("<u8").tobytes()))
            yield pd.DataFrame({"id": b.id, "c": [r[0] for r in rows], "n": [r[1] for r in rows], "places": [r[2] for r in rows], "bits": [r[3] for r in rows]})

    seen = stored(images.select(F.col(f"`{id_col}`").alias("id"), image.alias("image")).mapInPandas(described, f"id {kind}, c binary, n long, places binary, bits binary"), "corners")
    classes = stored(seen.where("c is not null").groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("places").alias("places"), F.first("bits").alias("bits")).withColumn("no", F.monotonically_increasing_id()), "images")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [np.unique(parts_of(np.frombuffer(x, "<u8").reshape(-1, 4))) for x in b.bits]
            yield pd.DataFrame({"part": np.concatenate(keys) if keys else [], "no": np.repeat(b.no.to_numpy(), [len(k) for k in keys])})

    parts = stored(classes.where("n > 0").select("no", "bits").mapInPandas(tables, "part long, no long"), "image-parts")
    near = components(sharing_pairs(parts, s.shared_parts, s.block))
    sized = near.join(near.groupBy("root").agg(F.count("*").alias("m")), "root").select(F.col("node").alias("no"), F.col("root").alias("near"), F.ceil(F.col("m") / s.block).cast("int").alias("blocks"))
    dealt = classes.join(sized, "no").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("near", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "c", "copies", "places", "bits")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame.lo.iloc[0], frame.hi.iloc[0]
        frame = frame.sort_values("c")
        one, two = frame[frame.mine == lo], None if lo == hi else frame[frame.mine == hi]
        if not len(one) or two is not None and not len(two):
            return pd.DataFrame({"c": [], "links": [], "other": []})
        return compare(one, two, s)

    found = stored(dealt.groupBy("near", "lo", "hi").applyInPandas(compared, "c binary, links long, other binary"), "image-links")
    groups = components(found.select(F.col("c").alias("u"), F.col("other").alias("v")))
    linked = groups.select(F.col("node").alias("c"), "root").join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left")
    of_group = linked.join(classes.select("c", "rep"), "c").groupBy("root").agg(F.min("rep").alias("class_id"))
    by_class = classes.select("c", "rep", "copies").join(linked.join(of_group, "root"), "c", "left")
    zero = F.lit(0).cast("long")
    return seen.select("id", "c", "n").join(by_class, "c", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("copy_id"),
        F.col("n").alias("n_corners"),
        (F.coalesce(F.col("copies") - 1, zero) + F.coalesce("links", zero)).alias("n_links"),
    )


#: Edits that ``drawn`` can make.
EDITS = ("crop", "turn", "light", "blot", "noise")


def texture(vector, cells: int = 20, cell: int = 4) -> np.ndarray | None:
    """Grey squares whose values follow from a vector's bytes: other vectors give unrelated images; None for none."""
    if vector is None:
        return None
    x = np.asarray([np.nan if v is None else v for v in vector], np.float64)
    grey = np.random.default_rng(zlib.crc32(x.tobytes())).integers(0, 256, (cells, cells))
    return np.kron(grey, np.ones((cell, cell), np.int64))


def edited(pixels: np.ndarray, edit: str) -> np.ndarray:
    """An edited copy: an eighth less on each side, a quarter turn, paler, a grey corner, or with noise."""
    h, w = pixels.shape
    rng = np.random.default_rng(zlib.crc32(pixels.astype(np.uint8).tobytes()))
    if edit == "crop":
        return pixels[h // 10 : h - h // 10, w // 10 : w - w // 10]
    if edit == "turn":
        return np.rot90(pixels)
    if edit == "light":
        return pixels * 0.75 + 40
    if edit == "blot":
        out = pixels.copy()
        out[: h // 3, : w // 3] = 128
        return out
    if edit == "noise":
        return np.clip(pixels + rng.normal(0, 8, pixels.shape), 0, 255)
    raise ValueError(f"no edit {edit!r}")


def drawn(vectors: Column, edits: Column) -> Column:
    """``texture`` images of vectors, edited where ``edits`` names one of EDITS; null for null vectors."""

    @F.pandas_udf("binary")
    def draw(v: pd.Series, e: pd.Series) -> pd.Series:
        def one(vector, edit) -> bytes | None:
            pixels = texture(vector)
            return None if pixels is None else pgm(edited(pixels, edit) if edit in EDITS else pixels)

        return pd.Series([one(x, y) for x, y in zip(v, e)], dtype=object)

    return draw(vectors, edits)
