"""URL rules and an exact block list held as a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 the unlisted keys of the corpus that level 1
lets pass; level 3 the listed keys that level 2 lets pass; and so on until no key is
wrong. Over the key universe that built it the cascade is exact, so judging a url needs
no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest cascade that is sent to the executors, in bytes.
MAX_BYTES = 64 << 20
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and the domains above it: ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + np.uint64(2 * i + 1) * h2.view(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


class TooLarge(ValueError):
    """A cascade would take more memory than it may."""


class Cascade:
    """Bitmaps of the levels, each with its number of bits and hash functions."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def size(self) -> int:
        return sum(words.nbytes for words, _, _ in self.levels)

    def passed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels, from the first, each key passes."""
        n, alive = np.zeros(len(h1), np.int32), np.ones(len(h1), bool)
        for level, (words, bits, hashes) in enumerate(self.levels):
            for i in range(hashes):
                at = _mixed(h1, h2, level, i) % np.uint64(bits)
                alive &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            n += alive
        return n

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key is listed if it first fails at an even level (or passes an odd number of levels in all)."""
        return self.passed(h1, h2) % 2 == 1


def _bits(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def build_cascade(keys: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade for ``keys`` (h1 long, h2 long, listed boolean): the complete key universe, each key once.

    The first level's rate is listed / (1.41 x others) and later ones' is a half, so its bits
    are about 1.44 x listed x log2(others / listed) plus a few for each listed key. It grows
    with the listed keys that occur; beyond ``max_bytes`` TooLarge is raised before a bitmap
    is gathered.
    """
    cascade = Cascade()
    n = {bool(r["listed"]): r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = n.get(True, 0), n.get(False, 0)
    if not listed:
        return cascade
    while True:
        level = len(cascade.levels)
        if level >= MAX_LEVELS:
            raise ValueError("two keys have equal hashes; the cascade has no end")
        turn = level % 2 == 0  # even index: listed keys go in
        left = keys.where(F.col("listed") == turn)
        if level:
            def still(batches: Iterator[pd.DataFrame], cascade=cascade, level=level) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield b[cascade.passed(b.h1.to_numpy(), b.h2.to_numpy()) == level]

            left = left.select("h1", "h2").mapInPandas(still, "h1 long, h2 long")
            count = left.count()
        else:
            left, count = left.select("h1", "h2"), listed
        if not count:
            return cascade
        bits, hashes = _bits(count, min(0.5, listed / (1.41 * max(others, 1))) if level == 0 else 0.5)
        if cascade.size() + bits / 8 > max_bytes:
            raise TooLarge(f"the cascade would take over {max_bytes} bytes")

        def positions(batches: Iterator[pd.DataFrame], level=level, bits=bits, hashes=hashes) -> Iterator[pd.DataFrame]:
            for b in batches:
                h1, h2 = b.h1.to_numpy(), b.h2.to_numpy()
                at = np.unique(np.concatenate([_mixed(h1, h2, level, i) % np.uint64(bits) for i in range(hashes)])) if len(b) else np.zeros(0, np.uint64)
                yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        set_words = left.mapInPandas(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
        words = np.zeros((bits + 63) // 64, np.uint64)
        for r in set_words.toLocalIterator():
            words[r["word"]] = np.int64(r["bits"]).view(np.uint64)
        cascade.levels.append((words, bits, hashes))


def parse_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def judge_urls(urls: DataFrame, listed: DataFrame, rules: dict[str, str], url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``urls`` as ``row``, with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` maps ``host/path`` to allow or block: a rule fits its host and all subdomains if
    the path starts with the rule's, and the longest wins. Without a rule, a url is blocked if
    its host or a domain above it is among ``listed`` (column ``key``; nulls and repeats are
    ignored), else allowed. A cascade of over ``max_bytes`` isn't built; the list is then joined, with
    the same result. Null urls and urls without ``://`` have empty host and path, which
    no rule fits. Rows that repeat stay; an empty table gives an empty table.
    """
    spark = urls.sparkSession
    url = F.col(f"`{url_col}`")
    rows = packed(urls, host=url_host(url), path=url_path(url))
    key = F.col("key")
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))

    hosts = rows.select("host").distinct()
    names = listed.select(F.translate(key, UPPER, LOWER).alias("key"), F.lit(True).alias("listed")).where("key is not null and key <> ''").distinct()
    universe = hosts.select(F.explode(host_keys(F.col("host"))).alias("key")).where("key <> ''").distinct()
    marked = universe.join(names, "key", "left")
    marked = stored(marked.select(pair(key).alias("p"), F.coalesce("listed", F.lit(False)).alias("listed")).select("p.*", "listed"), "url-keys")
    # The empty key is not in the universe, so the cascade must not be asked for it.
    asked = F.filter(host_keys(F.col("host")), lambda k: k != "")
    try:
        cascade = spark.sparkContext.broadcast(build_cascade(marked, max_bytes))
    except TooLarge:
        blocked = hosts.select("host", F.explode(host_keys(F.col("host"))).alias("key")).join(names, "key", "left_semi").select("host", F.lit(True).alias("is_listed")).distinct()
        rows, is_listed = rows.join(blocked, "host", "left"), F.col("is_listed")
    else:

        @F.pandas_udf("boolean")
        def any_listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
            sizes = h1.map(len).to_numpy()
            flat = [np.concatenate([np.zeros(0, np.int64), *h]).astype(np.int64) for h in (h1, h2)]
            of = np.repeat(np.arange(len(sizes)), sizes)
            return pd.Series(np.bincount(of, weights=cascade.value.holds(*flat), minlength=len(sizes)) > 0)

        is_listed = any_listed(F.transform(asked, lambda k: F.xxhash64(k)), F.transform(asked, lambda k: F.xxhash64(F.lit(1), k)))

    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=len):  # later ones, the longer, come first
        at, path = parse_rule(text)
        fits = ((F.col("host") == at) | F.endswith("host", F.lit("." + at))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    by_list = F.when(is_listed, "block").otherwise("allow")
    return rows.select("row", "host", "path", rule.alias("rule"), verdict.alias("ruled"), by_list.alias("listing")).select("row", "host", "path", "rule", F.coalesce("ruled", "listing").alias("verdict"))
