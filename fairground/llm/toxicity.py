"""Toxicity scores by a convolutional text classifier in numpy.

Words are looked up by hashes (the word and a few of its beginnings) in an embedding table;
filters of several widths run over the words of a whole text, and the largest response of each
filter feeds a logistic output. The classifier is fitted on a bounded sample of labelled
rows; its thresholds are calibrated for each language, which is told from the text itself
by common words, and the score is shifted so that one cut holds for all.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

WORD = re.compile(r"\w+")
#: Words by which a text's language is told.
COMMON = {
    "de": ("der", "die", "und", "das", "von", "zu", "den", "mit", "ist", "nicht", "ein", "eine"),
    "en": ("the", "of", "and", "to", "in", "is", "for", "that", "with", "on", "are", "this"),
    "es": ("el", "los", "las", "que", "y", "por", "una", "del", "con", "para", "es", "en"),
    "fr": ("le", "la", "les", "et", "des", "du", "est", "une", "pour", "qui", "dans", "sur"),
}
LANGUAGES = tuple(COMMON)
COMMON_SETS = {k: frozenset(v) for k, v in COMMON.items()}
PREFIXES = (3, 4, 5, 6)
#: Words that are convolved at a time; a longer text is taken in overlapping runs.
RUN = 65_536


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 6_000  #: labelled rows that the fit sees, at most
    sample_words: int = 20_000_000  #: words of those rows in all, at most
    buckets: int = 1 << 16
    dims: int = 12
    filters: int = 8  #: of each width
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    positive_weight: float = 3.0
    validation: float = 0.25
    cut: float = 0.3
    seed: int = 11


def word_hashes(word: str, buckets: int) -> list[int]:
    """Buckets of a word and of its beginnings (of a word that is longer)."""
    return [zlib.crc32(word.encode()) % buckets] + [zlib.crc32(f"{word[:n]}*".encode()) % buckets if len(word) > n else zlib.crc32(word.encode()) % buckets for n in PREFIXES]


def language(words: list[str]) -> int:
    """Index into LANGUAGES of the language whose common words stand most often; -1 if none does."""
    seen = Counter(words)
    counts = [sum(seen[w] for w in COMMON[k]) for k in LANGUAGES]
    best = max(range(len(counts)), key=counts.__getitem__)
    return best if counts[best] else -1


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  #: buckets x dims
    kernels: list[np.ndarray]  #: for each width: width x dims x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[int, float] = field(default_factory=dict)  #: of the logit, by language

    def embed(self, hashes: np.ndarray) -> np.ndarray:
        out = self.table[hashes[:, 0]]
        for j in range(1, hashes.shape[1]):
            out += self.table[hashes[:, j]]
        return out

    def projected(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to each filter, for each width and place in the filter."""
        return [[vectors @ kernel[j] for j in range(len(kernel))] for kernel in self.kernels]

    def pooled(self, words: np.ndarray, projections: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over a text (not under 0) and where it stands (-1: nowhere).

        ``words`` indexes the rows of the projections.
        """
        values, places = [], []
        for projected, bias in zip(projections, self.bias):
            width, n = len(projected), len(bias)
            best, at = np.zeros(n, np.float32), np.full(n, -1)
            for start in range(0, max(0, len(words) - width + 1), RUN):
                part = words[start : start + RUN + width - 1]
                m = len(part) - width + 1
                r = projected[0][part[:m]]
                for j in range(1, width):
                    r = r + projected[j][part[j : j + m]]
                top = r.argmax(0)
                value = r[top, np.arange(n)] + bias
                better = value > best
                best, at = np.where(better, value, best), np.where(better, start + top, at)
            values.append(best)
            places.append(at)
        return np.concatenate(values), np.concatenate(places)

    def logit(self, features: np.ndarray) -> np.ndarray:
        return features @ self.out + self.out_bias

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """0 to 1; the settings' cut stands at the language's threshold."""
        s, default = self.settings, self.thresholds.get(-1, 0.0)
        at = np.array([self.thresholds.get(int(k), default) for k in languages])
        z = np.clip(logits - at + np.log(s.cut / (1 - s.cut)), -60, 60)
        return 1 / (1 + np.exp(-z))


class Reader:
    """Scores texts with a model; remembers what words add to the filters, up to a number of words."""

    def __init__(self, model: Model, remembered: int = 150_000) -> None:
        self.model, self.remembered = model, remembered
        self.widths = [len(k) for k in model.kernels]
        self.forget()

    def forget(self) -> None:
        n = self.model.settings.filters
        self.numbers: dict[str, int] = {}
        self.adds = [np.zeros((1024, n), np.float32) for w in self.widths for _ in range(w)]
        self.common = np.zeros((1024, len(LANGUAGES)), np.int32)

    def codes(self, words: list[str]) -> np.ndarray:
        found = list(map(self.numbers.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, k in zip(words, found) if k is None))
            first, need = len(self.numbers), len(self.numbers) + len(new)
            if need > len(self.common):
                grown = lambda a: np.concatenate([a, np.zeros((max(need, 2 * len(a)) - len(a), a.shape[1]), a.dtype)])
                self.adds, self.common = [grown(a) for a in self.adds], grown(self.common)
            vectors = self.model.embed(np.array([word_hashes(w, self.model.settings.buckets) for w in new], np.int64))
            rows = [x for projected in self.model.projected(vectors) for x in projected]
            for a, x in zip(self.adds, rows):
                a[first:need] = x
            self.common[first:need] = [[w in COMMON_SETS[k] for k in LANGUAGES] for w in new]
            self.numbers.update(zip(new, range(first, need)))
            found = list(map(self.numbers.__getitem__, words))
        return np.array(found, np.int64)

    def score(self, text: str) -> float:
        words = WORD.findall(text.lower())
        best = [np.zeros(self.model.settings.filters, np.float32) for _ in self.widths]
        counts, overlap = np.zeros(len(LANGUAGES), np.int64), max(self.widths) - 1
        for start in range(0, len(words), RUN):
            if len(self.numbers) > self.remembered:
                self.forget()
            codes = self.codes(words[start : start + RUN + overlap])
            counts += self.common[codes[:RUN]].sum(0)
            at = 0
            for k, width in enumerate(self.widths):
                m = len(codes) - width + 1
                if m > 0:
                    r = self.adds[at][codes[:m]]
                    for j in range(1, width):
                        r += self.adds[at + j][codes[j : j + m]]
                    best[k] = np.maximum(best[k], r.max(0) + self.model.bias[k])
                at += width
        told = int(counts.argmax()) if counts.any() else -1
        return float(self.model.score(self.model.logit(np.concatenate(best)[None, :]), np.array([told]))[0])


class Lexicon:
    """Gives words numbers; keeps each number's hashes."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.numbers, self.hashes = buckets, {}, array("i")

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int32)
        for i, w in enumerate(words):
            if (k := self.numbers.get(w)) is None:
                k = self.numbers[w] = len(self.numbers)
                self.hashes.extend(word_hashes(w, self.buckets))
            out[i] = k
        return out

    def table(self) -> np.ndarray:
        return np.array(self.hashes, np.int32).reshape(-1, 1 + len(PREFIXES))


def _first_table(texts: list[np.ndarray], hashes: np.ndarray, y: np.ndarray, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """Small random vectors; the first component is how much oftener texts with label 1 hold the bucket."""
    table = rng.normal(0, 0.05, (s.buckets, s.dims)).astype(np.float32)
    held = np.zeros((2, s.buckets))
    for words, label in zip(texts, y):
        held[int(label), np.unique(hashes[words])] += 1
    n = np.bincount(y.astype(int), minlength=2) + 1.0
    odds = np.log((held[1] + 0.5) / n[1]) - np.log((held[0] + 0.5) / n[0])
    sure = np.clip((held[1] - 2) / 4, 0, 1)
    table[:, 0] = 0.25 * np.clip(odds, -1, 4) * np.where(odds > 0, sure, 1)
    return table


def fit_model(texts: Iterable[str], labels: Iterable[int], settings: Settings = Settings()) -> Model:
    """Fits on texts and labels of 0 or 1. Without texts, or with one label only, scores are constant.

    Texts are taken one by one and kept as word numbers, four bytes a word; one that would bring
    them over ``sample_words`` is passed over.
    """
    s = settings
    rng = np.random.default_rng(s.seed)
    lexicon = Lexicon(s.buckets)
    rows, kept, languages, held = [], [], [], 0
    for t, label in zip(texts, labels):
        words = WORD.findall((t or "").lower())
        if held + len(words) > s.sample_words:
            continue
        held += len(words)
        languages.append(language(words))
        rows.append(lexicon(words))
        kept.append(label)
    hashes, y, languages = lexicon.table(), np.array(kept, np.float64), np.array(languages)
    held_back = rng.random(len(rows)) < s.validation
    train = np.flatnonzero(~held_back)
    table = _first_table([rows[i] for i in train], hashes, y[train], s, rng) if len(train) else np.zeros((s.buckets, s.dims), np.float32)
    kernels = [rng.normal(0, 0.2, (w, s.dims, s.filters)).astype(np.float32) for w in s.widths]
    for k in kernels:
        k[:, 0] = np.abs(k[:, 0]) + 1.0 / len(k)
    m = Model(s, table, kernels, [np.zeros(s.filters, np.float32) for _ in s.widths], rng.normal(0.3, 0.1, s.filters * len(s.widths)), -2.0)
    rate_of_ones = y[train].mean() if len(train) else 0.0
    if not 0 < rate_of_ones < 1:
        m.out[:], m.out_bias = 0, 4.0 if rate_of_ones == 1 else -4.0
        return m

    moments: dict[str, list[np.ndarray]] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, step: int, rows_: np.ndarray | None = None) -> None:
        a, b = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        at = slice(None) if rows_ is None else rows_
        a[at] = 0.9 * a[at] + 0.1 * grad
        b[at] = 0.99 * b[at] + 0.01 * grad**2
        value[at] -= s.rate * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.99**step)) + 1e-7)

    step, out_bias = 0, np.array([m.out_bias])
    for _ in range(s.epochs):
        order = rng.permutation(train)
        for start in range(0, len(order), s.batch):
            step += 1
            batch = order[start : start + s.batch]
            used, index = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            parts = np.split(index, np.cumsum([len(rows[i]) for i in batch])[:-1])
            vectors = m.embed(hashes[used]) if len(used) else np.zeros((1, s.dims), np.float32)
            projections = m.projected(vectors)
            pooled = [m.pooled(p, projections) for p in parts]
            x = np.stack([p[0] for p in pooled])
            z = x @ m.out + out_bias[0]
            weight = np.where(y[batch] == 1, s.positive_weight, 1.0)
            dz = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) / len(batch)
            dx = dz[:, None] * m.out[None, :]
            grads = [np.zeros_like(k) for k in m.kernels]
            bias_grads = [np.zeros_like(b) for b in m.bias]
            dv = np.zeros_like(vectors)
            for p, (_, at), d in zip(parts, pooled, dx):
                for w, kernel in enumerate(m.kernels):
                    f = slice(w * s.filters, (w + 1) * s.filters)
                    on = np.flatnonzero(at[f] >= 0)
                    g = d[f][on].astype(np.float32)
                    bias_grads[w][on] += g
                    for j in range(len(kernel)):
                        v = p[at[f][on] + j]
                        grads[w][j][:, on] += vectors[v].T * g
                        np.add.at(dv, v, (kernel[j][:, on] * g).T)
            adam("out", m.out, x.T @ dz + 1e-4 * m.out, step)
            adam("out_bias", out_bias, np.array([dz.sum()]), step)
            for w in range(len(m.kernels)):
                adam(f"k{w}", m.kernels[w], grads[w], step)
                adam(f"b{w}", m.bias[w], bias_grads[w], step)
            touched = np.flatnonzero(np.abs(dv).sum(1))
            if len(touched):
                buckets, back = np.unique(hashes[used[touched]], return_inverse=True)
                grad = np.zeros((len(buckets), s.dims), np.float32)
                np.add.at(grad, back.reshape(len(touched), -1), dv[touched][:, None, :])
                adam("table", m.table, grad, step, buckets)
    m.out_bias = float(out_bias[0])

    logits = np.empty(len(rows))
    for start in range(0, len(rows), 64):  # the words of some texts at a time
        part = rows[start : start + 64]
        used, index = np.unique(np.concatenate(part), return_inverse=True)
        projections = m.projected(m.embed(hashes[used]) if len(used) else np.zeros((1, s.dims), np.float32))
        for i, words in enumerate(np.split(index, np.cumsum([len(r) for r in part])[:-1])):
            logits[start + i] = m.logit(m.pooled(words, projections)[0])
    check = held_back if 8 <= y[held_back].sum() < held_back.sum() else np.ones(len(y), bool)
    m.thresholds[-1] = best_threshold(logits[check], y[check])
    for k in range(len(LANGUAGES)):
        own = check & (languages == k)
        if 8 <= y[own].sum() < own.sum():
            m.thresholds[k] = best_threshold(logits[own], y[own])
    return m


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1, in the middle of the gap where it stands."""
    order = np.argsort(-logits, kind="stable")
    z, hits = logits[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fits on at most ``settings.sample_rows`` labelled rows, those whose id has the smallest hash.

    Ids and hashes only choose rows. Null labels and ids take no part. The rows are read by one
    task, which fits; only the model comes to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = known.join(docs.select(F.col(f"`{id_col}`").alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(settings.sample_rows)
    rows = texts.join(chosen, "id").orderBy(F.xxhash64("id"), "id", "text").limit(settings.sample_rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels_: list[int] = []

        def texts_() -> Iterator[str]:
            for b in batches:
                for i in range(b.num_rows):
                    labels_.append(b.column("label")[i].as_py())
                    yield b.column("text")[i].as_py()

        model = fit_model(texts_(), (labels_[-1] for _ in count()), settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.select("text", "label").coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else fit_model([], [], settings)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least the cut).

    Each whole text is scored. Null and empty texts have the score of a text without words.
    Only the text is read; other columns pass unchanged, repeated rows each get their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for texts in batches:
            yield pd.Series([reader.score(t or "") for t in texts], dtype="float64")

    score = packed(docs, text=F.col(f"`{text_col}`")).withColumn("score", scores("text"))
    predicted = F.when(F.col("score") >= model.settings.cut, 1).otherwise(0)
    return unpacked(score, docs, score=F.col("score"), predicted=predicted)
