"""Phrase mining over vertical positional inverted lists.

Texts are cut into blocks, and each block keeps a list of positions for every word of it. A
phrase's list is made from that of its first words: its end positions are merge-joined with the
postings that stand one position further. The lengths of a phrase's lists, summed over the
blocks, are its exact frequency, and only frequent phrases are extended.

What blocks and counts tell each other travels in segments: a block's entries for one hash
partition of the phrases, as one row. A partition adds up segments and answers each with the
numbers of its frequent phrases. So no phrase, however frequent, has more than one entry for
each block.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, stored


@dataclass(frozen=True)
class Settings:
    most_words: int = 3  #: words of the longest phrase
    min_count: int = 10  #: occurrences of a frequent phrase
    covered: int = 50  #: percent of a phrase's occurrences within one longer phrase that drop it
    top: int = 2_000  #: phrases that are reported for each language
    block_bytes: int = 8 << 20  #: text of a block (more, if one text is longer)
    part_entries: int = 1 << 20  #: entries that a hash partition adds up


UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Bytes that end a piece, and those that only end a word.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Marks the end of a piece among words; no word can be it.
END = b"."
SLICE = 1 << 20
_TABLE = bytes.maketrans(UPPER + ENDS + BLANKS, LOWER + b"\n" * len(ENDS) + b" " * len(BLANKS))
_GAP = re.compile(rb"[ \n]")
#: An odd number: multiplying by it modulo 2^64 mixes keys and loses none.
_MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = np.uint64(32)


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, some 100,000 at a time, with ``END`` after each piece."""
    data = text.encode().translate(_TABLE)
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + SLICE)
        end = gap.start() if gap else len(data)
        yield data[start:end].replace(b"\n", b" . ").split()
        start = end


def packed_array(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpacked_array(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Lists:
    """Positional inverted lists of one block under construction."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.ids[END]
        self.stream: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        for words in words_of(text):
            self.stream.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.stream.append(np.zeros(1, np.int32))  # no phrase goes from one text to the next
        self.size += len(text)

    def row(self, lang: str, block: int) -> tuple | None:
        stream = np.concatenate(self.stream)
        places = np.flatnonzero(stream)
        if not len(places):
            return None
        words = stream[places]
        order = np.argsort(words, kind="stable")
        counts = np.bincount(words, minlength=len(self.ids))[1:]
        names = list(self.ids)[1:]
        return lang, block, len(places), len(names), b" ".join(names), packed_array(counts.astype(np.int32)), packed_array(places[order].astype(np.int32))


BLOCKS = "lang string, block long, n long, n_words long, words binary, counts binary, places binary"


def inverted_blocks(docs: DataFrame, text: Column, lang: Column, settings: Settings) -> DataFrame:
    """Rows of ``BLOCKS``: for each block and language its words, their counts and the positions of each, word by word."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, count()
        open_lists: dict[str, Lists] = defaultdict(Lists)
        held = 0

        def closed() -> Iterator[pd.DataFrame]:
            for name, lists in open_lists.items():
                if row := lists.row(name, base + next(made)):
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])
            open_lists.clear()

        for b in batches:
            for name, t in zip(b.lang, b.text):
                open_lists[name].add(t)
                held += len(t) + 1
                if held >= settings.block_bytes:
                    yield from closed()
                    held = 0
        yield from closed()

    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(blocks, BLOCKS)


COUNTED = "part long, block long, lang string, phrase string, first long, word long, f long, id long, keys binary, ids binary"
_COUNTED = [c.split()[0] for c in COUNTED.split(", ")]


def _told(part: int, items: pd.DataFrame, answers: list[tuple]) -> pd.DataFrame:
    """Frequent phrases and the answers to blocks, as rows of ``COUNTED``."""
    back = pd.DataFrame(answers, columns=["block", "keys", "ids"])
    out = pd.concat([items, back], ignore_index=True).reindex(columns=_COUNTED)
    out["part"] = part
    for c in ("block", "first", "word", "f", "id"):
        out[c] = out[c].astype("Int64")
    for c in ("lang", "phrase", "keys", "ids"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def _checked(last: int) -> int:
    if last >= 1 << 32:
        raise OverflowError("a level has over 2^32 frequent phrases; raise min_count or part_entries")
    return last


def counted_words(blocks: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """Rows of ``COUNTED`` for words: those that are frequent, and for each block the numbers of its frequent words."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, block, words, counts in zip(b.lang, b.block, b.words, b.counts):
                names, n = words.split(b" "), unpacked_array(counts, "i4")
                part = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % parts
                order = np.argsort(part, kind="stable")
                bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
                rows = [(int(part[at[0]]), lang, block, b" ".join([names[i] for i in at.tolist()]), packed_array(n[at]), packed_array(at.astype(np.int32))) for at in np.split(order, bounds[1:-1])]
                yield pd.DataFrame(rows, columns=["part", "lang", "block", "names", "n", "at"])

    def added_up(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group.part.iloc[0])
        totals: dict[str, dict[bytes, int]] = defaultdict(dict)
        group = group.sort_values("block")
        for lang, names, n in zip(group.lang, group.names, group.n):
            total = totals[lang]
            for name, more in zip(names.split(b" "), unpacked_array(n, "i4").tolist()):
                total[name] = total.get(name, 0) + more
        numbers, rows, next_id = defaultdict(dict), [], count()
        for lang in sorted(totals):
            for name, f in totals[lang].items():
                if f >= settings.min_count:
                    numbers[lang][name] = i = part + parts * next(next_id)
                    rows.append((lang, name.decode(), f, i))
        _checked(part + parts * len(rows))
        answers = []
        for lang, block, names, at in zip(group.lang, group.block, group.names, group["at"]):
            ids = np.array([numbers[lang].get(name, -1) for name in names.split(b" ")], np.int64)
            known = ids >= 0
            if known.any():
                answers.append((block, packed_array(unpacked_array(at, "i4")[known]), packed_array(ids[known].astype(np.uint32))))
        return _told(part, pd.DataFrame(rows, columns=["lang", "phrase", "f", "id"]), answers)

    sent = blocks.select("lang", "block", "words", "counts").mapInPandas(segments, "part long, lang string, block long, names binary, n binary, at binary")
    return sent.groupBy("part").applyInPandas(added_up, COUNTED)


STATE = "lang string, block long, n long, places binary, words binary, ends binary, phrases binary"


def frequent_postings(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows of ``STATE`` after the first level: each block's postings of frequent words, merged by position."""

    def merged(lists: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if lists.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in STATE.split(", ")])
        row = lists.iloc[0]
        counts, places = unpacked_array(row.counts, "i4"), unpacked_array(row.places, "i4")
        ids = np.full(len(counts), -1, np.int64)
        for at, numbers in zip(answers["keys"], answers.ids):
            ids[unpacked_array(at, "i4")] = unpacked_array(numbers, "u4")
        words = np.repeat(ids, counts)
        places, words = places[words >= 0], words[words >= 0]
        order = np.argsort(places, kind="stable")
        return pd.DataFrame({"lang": [row.lang], "block": [row.block], "n": [len(places)], "places": [packed_array(places[order])], "words": [packed_array(words[order].astype(np.uint32))], "ends": [None], "phrases": [None]})

    back = counted.where("keys is not null").select("block", "keys", "ids")
    return blocks.select("lang", "block", "counts", "places").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(merged, STATE)


def extended(ends: np.ndarray, phrases: np.ndarray, places: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of phrases' end positions with the postings one further: the new ends, and keys of phrase and word.

    Both inputs are sorted by position.
    """
    at = np.searchsorted(places, ends + 1)
    at[at == len(places)] = 0
    hit = places[at] == ends + 1 if len(places) else np.zeros(len(ends), bool)
    return (ends + 1)[hit], phrases[hit].astype(np.uint64) << BITS | words[at[hit]].astype(np.uint64)


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    places, words = unpacked_array(row.places, "i4"), unpacked_array(row.words, "u4")
    if row.ends is None:
        return places, words, places, words
    return unpacked_array(row.ends, "i4"), unpacked_array(row.phrases, "u4"), places, words


def counted_extensions(state: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """Rows of ``COUNTED`` for the phrases of ``state`` with one more word; keys of answers are those of ``extended``."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                keys = extended(*_arrays(row))[1]
                mixed, n = np.unique(keys * _MIX, return_counts=True)
                part = (mixed >> BITS) * np.uint64(parts) >> BITS
                bounds = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
                rows = [(int(part[a]), row.block, packed_array(mixed[a:z]), packed_array(n[a:z].astype(np.int32))) for a, z in zip(bounds, [*bounds[1:], len(part)])]
                yield pd.DataFrame(rows, columns=["part", "block", "mixed", "n"])

    unmix = np.uint64(pow(int(_MIX), -1, 1 << 64))

    def added_up(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group.part.iloc[0])
        group = group.sort_values("block")
        each = [unpacked_array(m, "u8") for m in group.mixed]
        mixed = np.concatenate(each)
        order = np.argsort(mixed, kind="stable")
        sums = np.concatenate([unpacked_array(n, "i4") for n in group.n])[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(mixed[order], prepend=~mixed[order[:1]]))
        f, kinds = np.add.reduceat(sums, starts), mixed[order][starts]
        kinds, f = kinds[f >= settings.min_count], f[f >= settings.min_count]
        ids = part + parts * np.arange(len(kinds), dtype=np.int64)
        _checked(part + parts * len(kinds))
        keys = kinds * unmix
        items = pd.DataFrame({"first": (keys >> BITS).astype(np.int64), "word": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), "f": f, "id": ids})
        answers = []
        for block, own in zip(group.block, each):
            if len(kinds):
                at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
                known = kinds[at] == own
                if known.any():
                    answers.append((block, packed_array(own[known] * unmix), packed_array(ids[at[known]].astype(np.uint32))))
        return _told(part, items, answers)

    return state.mapInPandas(segments, "part long, block long, mixed binary, n binary").groupBy("part").applyInPandas(added_up, COUNTED)


def advanced(state: DataFrame, counted: DataFrame) -> DataFrame:
    """``state`` with the lists of the frequent phrases that are one word longer.

    A phrase is frequent only if its last words are, too, so ends that no frequent phrase of
    the same length follows can't be extended; the next join leaves them out by itself.
    """

    def lists(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or answers.empty:
            return rows.iloc[:0]
        row = rows.iloc[0].copy()
        ends, keys = extended(*_arrays(row))
        known = np.concatenate([unpacked_array(k, "u8") for k in answers["keys"]])
        ids = np.concatenate([unpacked_array(i, "u4") for i in answers.ids])
        order = np.argsort(known, kind="stable")
        known, ids = known[order], ids[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        row["ends"], row["phrases"] = packed_array(ends[hit]), packed_array(ids[at[hit]])
        # Only what stands right after an end can extend it.
        places, words = unpacked_array(row.places, "i4"), unpacked_array(row.words, "u4")
        needed = np.isin(places, ends[hit] + 1, assume_unique=True)
        row["places"], row["words"] = packed_array(places[needed]), packed_array(words[needed])
        return pd.DataFrame([row])

    back = counted.where("keys is not null").select("block", "keys", "ids")
    return state.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(lists, STATE)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """(lang, phrase, words, f, n): every frequent phrase of up to ``most_words`` words; n counts all words of its language.

    A-Z are lower-cased; ``ENDS`` end pieces, ``ENDS`` and ``BLANKS`` words; phrases lie within a
    piece, and overlapping occurrences all count. Null text is empty, null language ``und``.
    Every row counts, repeated ones too. An empty table has no phrases. Other columns are not read.
    """
    blocks = stored(inverted_blocks(spread(docs.select(text_col, lang_col)), F.col(text_col), F.col(lang_col), settings), "word-lists")
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n").alias("n")).first()
    least = docs.sparkSession.sparkContext.defaultParallelism
    parts = lambda entries: max(least, -(-(entries or 0) // settings.part_entries))
    per_lang = blocks.groupBy("lang").agg(F.sum("n").alias("n"))

    counted = stored(counted_words(blocks, parts(size.words), settings), "words")
    found = counted.where("phrase is not null").select("lang", "phrase", F.lit(1).alias("words"), "f", "id")
    words, shorter, every = found.select(F.col("id").alias("word"), F.col("phrase").alias("last")), found, [found]
    state = stored(frequent_postings(blocks, counted), "postings") if settings.most_words > 1 else None
    for k in range(2, settings.most_words + 1):
        counted = stored(counted_extensions(state, parts(size.n), settings), "extensions")
        longer = counted.where("f is not null").select("first", "word", "f", "id").join(shorter.select("lang", "phrase", F.col("id").alias("first")), "first").join(words, "word")
        shorter = stored(longer.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(k).alias("words"), "f", "id"), "phrases")
        every.append(shorter)
        if k < settings.most_words:
            state = advanced(state, counted)
    rows = every[0].drop("id")
    for more in every[1:]:
        rows = rows.unionByName(more.drop("id"))
    return rows.join(per_lang, "lang")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two words or more with frequency a is cut after its first k words into parts of
    frequencies l and r; the cut with the lowest floor(1000000 * a * a / (l * r)) counts, of equal
    ones the one with the smallest k. Phrases that lie inside a longer frequent one with at least
    ``covered`` percent of their occurrences go. Order: score, then a, falling, then the phrase's
    bytes. See ``frequent_phrases`` for nulls, repeats and empty tables.
    """
    found = stored(frequent_phrases(docs, text_col, lang_col, settings), "frequent-phrases")
    candidates = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")

    starts_and_lengths = [(s, m) for m in range(2, settings.most_words) for s in range(1, settings.most_words - m + 2)]
    inside = F.array_compact(F.array(*[F.when((F.col("words") > m) & (F.col("words") >= s + m - 1), part(s, m)) for s, m in starts_and_lengths])) if starts_and_lengths else F.array().cast("array<string>")
    longest = candidates.select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within"), F.lit(0)) < settings.covered * F.col("f"))

    cuts = kept.select("lang", "phrase", "n", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left_part", part(F.lit(1), F.col("k"))).withColumn("right_part", part(F.col("k") + 1, F.col("words") - F.col("k")))
    known = lambda phrase, f: found.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    both = cuts.join(known("left_part", "l"), ["lang", "left_part"]).join(known("right_part", "r"), ["lang", "right_part"])
    score = F.expr("(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # What is not among the first of its salt is not among the first of its language.
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    rows = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= settings.top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= settings.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
