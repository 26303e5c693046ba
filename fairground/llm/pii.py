"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. Tokens with a digit or an @ are then labelled by a field whose
base spans are given: neighbours share chain potentials, and tokens that are repeated or
similar, however far apart in the document, share skip potentials. Loopy sum-product messages
carry a label from where it is sure to where it is not: a number without its plus, an address
without its dots. Each occurrence is linked to the one before it, so links grow with the text.

The field is trained here, by pseudo-likelihood. Training texts are the corpus's own: to each
sampled one, degraded copies of some of its base spans are added (labelled), and degraded
strangers with other digits (not labelled), so shape alone doesn't make personal data.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
LABELS = len(KINDS) + 1


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 4_000  #: texts with a digit or @ that the field is trained on at most, those with the smallest hashes
    sample_tokens: int = 200_000  #: tokens of them at most; texts that would exceed it are passed over
    steps: int = 400  #: steps of training
    rounds: int = 20  #: rounds of messages
    sure: float = 0.75  #: marginal from which on a token is added


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9A-Za-z._%+@-]++")
_NEAR = re.compile(r"[ ().-]{1,3}")


def luhn(digits: str) -> bool:
    """Whether ASCII digits pass the Luhn sum; empty ones do."""
    own = [ord(c) - 48 for c in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Scanning from each @ to both sides gives what the pattern gives from the left, in linear time.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, start + size
            start += size + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of what the patterns find, by label, then start; code points, end exclusive."""
    if not _ANY.search(text):
        return []
    return [(k, a, z) for k, find in enumerate((_emails, _ips, _cards, _phones), 1) for a, z in find(text)]


FEATURES = 26


class Tokens:
    """The tokens of texts that hold a digit or an @, with features, evidence and edges; others never have a label."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # text number, start, end
        self.features: list[list[int]] = []
        self.given: list[int] = []  # label of the base span, 0 if none
        self.chain: list[tuple[int, int]] = []
        self.same: list[tuple[int, int]] = []
        self.similar: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[tuple[int, int, int]]) -> None:
        edges = sorted((a, z, k) for k, a, z in base)
        seen_same: dict[str, int] = {}
        seen_like: dict[str, int] = {}
        next_base, before = 0, None
        for m in _TOKEN.finditer(text):
            token = m.group()
            start = m.start() + len(token) - len(token.lstrip("._%-"))
            token = token.strip("._%-")
            if not _ANY.search(token):
                continue
            end, me = start + len(token), len(self.spans)
            while next_base < len(edges) and edges[next_base][1] <= start and (next_base + 1 >= len(edges) or edges[next_base + 1][0] <= start):
                next_base += 1
            near = [k for a, z, k in edges[max(0, next_base - 3) : next_base + 4] if a < end and z > start]
            adjacent = before is not None and start - before <= 3 and bool(_NEAR.fullmatch(text, before, start))
            self.spans.append((number, start, end))
            self.given.append(near[0] if near else 0)
            self.features.append(features(text, token, start, end))
            if adjacent:
                self.chain.append((me - 1, me))
            before = end
            same, like = keys(token)
            if same and (was := seen_same.get(same)) is not None:
                self.same.append((was, me))
            if like and (was := seen_like.get(like)) is not None and (not same or seen_same.get(same) != was):
                self.similar.append((was, me))
            if same:
                seen_same[same] = me
            if like:
                seen_like[like] = me


def keys(token: str) -> tuple[str, str]:
    """What repeated tokens and similar ones have in common; empty if too short to tell."""
    same = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in token if c.isdigit())
    local = token.lower().partition("@")[0]
    like = digits[-7:] if len(digits) >= 7 else local if len(local) >= 5 and any(c.isalpha() for c in local) else ""
    return same if len(same) >= 5 else "", like


def features(text: str, token: str, start: int, end: int) -> list[int]:
    """Indexes of the features that hold. None of them tells a repeated token from a single one."""
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    size = min(7, (0, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 5)[digits] if digits < 13 else 6 if digits < 20 else 7)
    out = [0, 1 + size]
    out += [9] * ("@" in token) + [10] * ("@" in token and "." in token.partition("@")[2]) + [11] * token.startswith("+")
    out += [12 + min(3, token.count("."))] + [16 + min(2, token.count("-"))]
    out += [19] * (letters == 0) + [20] * (digits > 0 and letters > 0 and "@" not in token) + [21] * (letters > digits)
    out += [22] * (letters == 0 and 13 <= digits <= 19 and luhn("".join(c for c in token if c.isdigit())))
    out += [23] * (start > 0 and text[start - 1] in "=\"'") + [24] * (end < len(text) and text[end] in "\"'") + [25] * (start > 0 and text[start - 1] == "(")
    return out


@dataclass(frozen=True)
class Field:
    """Potentials as logarithms: features by label, chain (left label by right label), repeated and similar tokens (symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    similar: np.ndarray


def _one_hot(labels: np.ndarray) -> np.ndarray:
    return np.eye(LABELS)[labels]


def _feature_matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES))
    for i, found in enumerate(rows):
        out[i, found] = 1
    return out


def _neighbours(n: int, edges: list[tuple[int, int]], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed labels of the tokens before and after along ``edges``."""
    before, after = np.zeros((n, LABELS)), np.zeros((n, LABELS))
    if edges:
        a, z = np.array(edges).T
        np.add.at(before, z, hot[a])
        np.add.at(after, a, hot[z])
    return before, after


def train(tokens: Tokens, labels: np.ndarray, steps: int) -> Field:
    """Potentials that maximise the tokens' pseudo-likelihood (Adam, weights held small).

    Each token is seen twice, once without its chain neighbours: with them alone, whose labels
    are known in training, skip potentials would have nothing left to explain.
    """
    n = len(labels)
    x, hot = _feature_matrix(tokens.features), _one_hot(labels)
    left, right = _neighbours(n, tokens.chain, hot)
    same, similar = sum(_neighbours(n, tokens.same, hot)), sum(_neighbours(n, tokens.similar, hot))
    left, right = np.concatenate([left, 0 * left]), np.concatenate([right, 0 * right])
    x, hot, same, similar = (np.concatenate([a, a]) for a in (x, hot, same, similar))
    weights = [np.zeros((FEATURES, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        unary, chain, rep, like = weights
        logits = x @ unary + left @ chain + right @ chain.T + same @ rep + similar @ like
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        g = (p / p.sum(axis=1, keepdims=True) - hot) / max(1, n)
        up, down = same.T @ g, similar.T @ g
        slopes = [x.T @ g, left.T @ g + g.T @ right, (up + up.T) / 2, (down + down.T) / 2]
        for i, slope in enumerate(slopes):
            slope = slope + 1e-4 * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            weights[i] = weights[i] - 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


#: Logarithm that stands for impossible.
NEVER = -60.0


def marginals(tokens: Tokens, field: Field, rounds: int) -> np.ndarray:
    """Label probabilities of each token by ``rounds`` of damped loopy sum-product messages, base spans given.

    A text's result doesn't depend on what other texts are worked on with it. On trees with
    paths shorter than ``rounds``, it comes close to the exact marginals.
    """
    n = len(tokens.given)
    given = np.array(tokens.given, dtype=int)
    own = _feature_matrix(tokens.features) @ field.unary
    own[given > 0] = NEVER
    own[np.flatnonzero(given), given[given > 0]] = 0.0
    parts = [(e, w) for e, w in ((tokens.chain, field.chain), (tokens.same, field.same), (tokens.similar, field.similar)) if e]
    if parts:
        ends = np.concatenate([np.array(e) for e, _ in parts])
        forth = np.concatenate([np.broadcast_to(w, (len(e), LABELS, LABELS)) for e, w in parts])
        a, z, m = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), len(ends)
        weights = np.concatenate([forth, forth.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        sent = np.zeros((2 * m, LABELS))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, z, sent)
            out = (belief[a] - sent[back])[:, :, None] + weights
            top = out.max(axis=1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            sent = 0.5 * sent + 0.5 * (out - out.max(axis=1, keepdims=True))
        own = own.copy()
        np.add.at(own, z, sent)
    own -= own.max(axis=1, keepdims=True, initial=NEVER)
    p = np.exp(own)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(tokens: Tokens, p: np.ndarray, sure: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text number, label, start, end, least probability) of neighbours with one sure label that no base span covers."""
    chained, open_span = {z for _, z in tokens.chain}, None
    for i, (number, start, end) in enumerate(tokens.spans):
        label = int(p[i, 1:].argmax()) + 1
        sure_of = not tokens.given[i] and p[i, label] >= sure
        if open_span and sure_of and i in chained and open_span[1] == label and open_span[5] == i - 1:
            open_span = (number, label, open_span[2], end, min(open_span[4], float(p[i, label])), i)
            continue
        if open_span:
            yield open_span[:5]
        open_span = (number, label, start, end, float(p[i, label]), i) if sure_of else None
    if open_span:
        yield open_span[:5]


def degraded(kind: int, value: str, way: int) -> str:
    """A base span's text as it may stand elsewhere, no longer matched by its pattern."""
    if kind == EMAIL:
        local, _, domain = value.partition("@")
        return f"{local}@{domain.split('.')[0]}"
    if kind == IP:
        return value.replace(".", "-") if way % 2 else value.replace(".", "_")
    if kind == CARD:
        digits = value.replace(" ", "").replace("-", "")
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if way % 2 else digits[4:]
    return value.lstrip("+") if way % 2 else value[value.find(" ") + 1 :] if " " in value else value.lstrip("+")


def stranger(value: str, rng: np.random.Generator) -> str:
    """``value`` with other digits and letters."""
    digit, letter = lambda m: str(rng.integers(10)), lambda m: chr(97 + rng.integers(26))
    local, at, domain = value.partition("@")
    return re.sub("[0-9]", digit, re.sub("[a-z]", letter, local) if at else local) + at + domain


def training_set(texts: Iterator[str], settings: Settings) -> tuple[Tokens, np.ndarray]:
    """Tokens and labels of texts with degraded copies of some of their spans (labelled) and of strangers to them (not labelled)."""
    tokens, labels, pool = Tokens(), [], []
    for number, text in enumerate(texts):
        base = base_spans(text)
        rng = np.random.default_rng(number)
        at, more = len(text), []
        for way, (kind, a, z) in enumerate(base[:8]):
            if (way + number) % 3:
                more.append((kind, degraded(kind, text[a:z], int(rng.integers(2)))))
            if (way + number) % 2:
                more.append((0, degraded(kind, stranger(text[a:z], rng), int(rng.integers(2)))))
            pool.append((kind, text[a:z]))
        if not base and pool:
            kind, value = pool[int(rng.integers(len(pool)))]
            more.append((0, degraded(kind, stranger(value, rng), int(rng.integers(2)))))
        del pool[:-500]
        longer, told = text, []
        for kind, copy in more:
            longer += " and "
            told.append((kind, len(longer), len(longer) + len(copy)))
            longer += copy
        before = len(tokens.spans)
        if before + len(longer) // 4 > settings.sample_tokens:
            continue
        tokens.add(number, longer, base_spans(longer))
        for (_, start, end), given in zip(tokens.spans[before:], tokens.given[before:]):
            own = next((k for k, a, z in told if a < end and z > start), 0) if start >= at else 0
            labels.append(given or own)
    return tokens, np.array(labels, dtype=int)


def fit(docs: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> Field:
    """A field trained in one task on a bounded sample of ``docs`` (see ``Settings``); only its potentials come to the driver.

    Texts that repeat count once. Without any text with a digit or @ the potentials are zero.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    smallest = texts.select("h").distinct().orderBy("h").limit(settings.sample_rows).agg(F.max("h").alias("h")).first().h
    sample = texts.where(F.col("h") <= F.lit(smallest)).dropDuplicates(["h"]).repartition(1).sortWithinPartitions("h").select("text")

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, labels = training_set((t for b in batches for t in b.text), settings)
        yield pd.DataFrame({"field": [pickle.dumps(train(tokens, labels, settings.steps))]})

    found = sample.mapInPandas(trained, "field binary").collect() if smallest is not None else []
    if not found:
        return train(Tokens(), np.zeros(0, int), 0)
    return pickle.loads(bytes(found[0].field))


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean, score: double>>"


def find(docs: DataFrame, field: Field, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` as the struct ``row``, with ``spans``: by kind, then start.

    Base spans all stay, with score 1; added ones never overlap them and have their least
    token's probability. Null text is empty and has none. Each row is judged by its own text
    alone; whole texts are read, in time linear in their length. Other columns pass in ``row``.
    """

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        base, tokens = [], Tokens()
        for i, t in enumerate(texts):
            found = base_spans(t) if t else []
            base.append([(k, a, z, True, 1.0) for k, a, z in found])
            if t and _ANY.search(t):
                tokens.add(i, t, found)
        if 0 in tokens.given:
            for number, k, a, z, score in added_spans(tokens, marginals(tokens, field, settings.rounds), settings.sure):
                base[number].append((k, a, z, False, score))
        return pd.Series([[dict(kind=KINDS[k - 1], start=a, end=z, base=b, score=s) for k, a, z, b, s in sorted(found)] for found in base], dtype=object)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return packed(docs, spans=spans(text))


def redact(docs: DataFrame, field: Field, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; where spans overlap, they are replaced together."""

    @F.pandas_udf("string")
    def covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def of(text: str | None, found) -> str | None:
            out, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [text[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            return None if text is None else "".join([*out, text[at:]])

        return pd.Series([of(t, s) for t, s in zip(texts, spans)], dtype=object)

    found = find(docs, field, text_col, settings)
    others = [F.col("row").getField(c).alias(c) if c != text_col else covered(F.col("row").getField(c), F.col("spans")).alias(c) for c in docs.columns]
    return found.select(*others)


def span_report(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row for each row of ``docs``: id, base spans of each kind counted, ``base_sha256``, ``spans`` and ``n_added``.

    ``spans`` has kind:start:end of all spans, by kind, then start, joined by commas;
    ``base_sha256`` is the SHA-256 of the same text of the base spans alone. Rows that repeat
    an id each have a row; ids may be null.
    """
    found = find(docs, field, text_col, settings).select(F.col("row").getField(id_col).alias(id_col), "spans")
    base = F.filter("spans", lambda s: s.base)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of_kind = lambda k: F.filter(base, lambda s: s.kind == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
