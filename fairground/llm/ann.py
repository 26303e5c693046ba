"""Approximate nearest neighbours over balanced posting lists.

Balanced k-means over a bounded sample, in two levels, gives the lists' centroids: about as
many as the square root of the number of vectors. A vector goes into its nearest list and, near
a boundary, into others whose centroid is hardly farther. A graph over the centroids, searched in
memory, finds the lists of a vector or a query; the ratio of distances prunes a query's lists.
How large that ratio is, follows from the data: some vectors' nearest are found among all rows, and
the ratio is set so that their lists would be read. Long lists are split into blocks. A block is read once and its queries are streamed past it; the
best of each block meet in a last top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Vectors, and numbers in them, that the centroids are fitted on, at most; every vector is indexed.
SAMPLE, SAMPLE_VALUES = 32_768, 4_000_000
#: Numbers that a block's vectors hold, at most.
BLOCK_VALUES = 4_000_000


@dataclass(frozen=True)
class Settings:
    n_lists: int | None = None  #: if none, the square root of the number of vectors
    per_centroid: int = 16  #: vectors of the sample for each list, at least
    copies: int = 4  #: lists that hold a vector, at most
    copy_ratio: float = 1.2  #: a further list's distance against the nearest one's
    calibration: int = 128  #: vectors whose nearest are found among all rows, to set what a query reads
    coverage: float = 0.985  #: part of those nearest that the ratio, and the number of lists, each must reach
    block_rows: int = 8_192  #: vectors of a list that one task holds
    links: int = 16
    seed: int = 7


def usable(v: Column, dims: int) -> Column:
    """Not null, of the table's width, without null or non-finite components, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """k-means in which a list that is too long is made to look farther away."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    penalty = np.zeros(k)
    for _ in range(rounds):
        d = squared(x, c)
        at = (d + penalty).argmin(1)
        sizes = np.bincount(at, minlength=k)
        penalty += 0.1 * d[np.arange(len(x)), at].mean() * (sizes * k / len(x) - 1)
        penalty -= penalty.min()
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def centroids_of(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``balanced_centroids``; of many, some are fitted first and each of their parts is then split by itself."""
    if k <= 64:
        return balanced_centroids(x, k, seed)
    top = balanced_centroids(x, round(k**0.5), seed)
    at = np.concatenate([squared(x[i : i + 4096], top).argmin(1) for i in range(0, len(x), 4096)])
    parts = [x[at == i] for i in range(len(top))]
    return np.concatenate([balanced_centroids(p, max(1, round(k * len(p) / len(x))), seed + i) for i, p in enumerate(parts) if len(p)])


class CentroidGraph:
    """Each centroid linked with its nearest ones, both ways, and with a ring through all."""

    def __init__(self, centroids: np.ndarray, links: int) -> None:
        self.c = centroids
        k = len(centroids)
        d = squared(centroids, centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : links + 1]
        linked: list[set[int]] = [set(near[i].tolist()) for i in range(k)]
        for i in range(k):
            for j in near[i]:
                linked[j].add(i)
        # A centroid that is near to very many keeps the nearest of them.
        kept = [[(i + 1) % k, (i - 1) % k, *sorted(s, key=lambda j, i=i: d[i, j])[: links * 3 // 2]] for i, s in enumerate(linked)]
        width = max(map(len, kept))
        self.links = np.array([s + [i] * (width - len(s)) for i, s in enumerate(kept)], np.int64).reshape(k, width)
        #: Where a search may begin: spread over all, and few.
        self.entries = np.unique(np.linspace(0, k - 1, max(1, round(k**0.5))).astype(np.int64))

    def search(self, x: np.ndarray, n: int, rows: int = 2_048) -> tuple[np.ndarray, np.ndarray]:
        """``_search``, some rows at a time."""
        found = [self._search(x[i : i + rows], n) for i in range(0, len(x), rows)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` its ``n`` nearest centroids that a best-first search finds, and their distances."""
        m, k = len(x), len(self.c)
        n = min(n, k)
        beam = min(k, max(2 * n, 16))
        rows = np.arange(m)
        entry = self.entries[squared(x, self.c[self.entries]).argmin(1)]
        seen = np.zeros((m, k), bool)
        seen[rows, entry] = True
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf)
        done = np.ones((m, beam), bool)
        ids[:, 0], done[:, 0] = entry, False
        dist[:, 0] = np.sqrt(((x - self.c[entry]) ** 2).sum(1))
        xx, cc = (x * x).sum(1), (self.c * self.c).sum(1)
        while not done.all():
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(1)
            going = np.isfinite(open_[rows, at])
            done[rows, at] = True
            r = rows[going]
            if not len(r):
                break
            new = self.links[ids[r, at[going]]]
            fresh = ~seen[r[:, None], new]
            seen[r[:, None], new] = True
            d = np.sqrt(np.maximum(xx[r][:, None] + cc[new] - 2 * np.einsum("ij,ikj->ik", x[r], self.c[new]), 0))
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[r], d], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            take = lambda old, more: np.take_along_axis(np.concatenate([old, more], 1), best, 1)
            ids[r], done[r], dist[r] = take(ids[r], new), take(done[r], ~np.isfinite(d)), np.take_along_axis(all_d, best, 1)
        return ids[:, :n], dist[:, :n]


def nearest(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of the vectors ``x`` for each query ``q``, exactly; ties to the smaller id."""
    repeats = len(np.unique(ids)) < len(ids)
    out = []
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        d = squared(part, x)
        d[own[at : at + 64, None] == ids[None, :]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * (1 + (part * part).sum(1) + (x * x).sum(1).max())
        for i in range(len(part)):
            near = np.flatnonzero(np.isfinite(d[i]) & ((d[i] <= kth[i] + slack[i]) | repeats | ~np.isfinite(kth[i])))
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))
            if repeats:
                order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
            order = order[:k]
            out.append(pd.DataFrame({"query_id": own[at + i], "vec_id": ids[near][order], "score": exact[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def true_neighbours(index: DataFrame, ids: list, x: np.ndarray, k: int, kind: str) -> DataFrame:
    """(q, id, d, lists): the ``k`` nearest rows of ``index`` for each vector of ``x``, but those with its own id. A task keeps ``k`` rows for each."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.array(ids)
        held: list[tuple] = []
        d = np.zeros((len(x), 0))
        for b in batches:
            if not len(b):
                continue
            new = squared(x, matrix(b.vector, x.shape[1]))
            new[own[:, None] == b.id.to_numpy()[None, :]] = np.inf
            rows, d = [*held, *zip(b.id, b.lists)], np.concatenate([d, new], 1)
            near = np.unique(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k])
            held, d = [rows[i] for i in near], d[:, near]
        if held:
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            q, j = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            fine = np.isfinite(d[q, j])
            q, j = q[fine], j[fine]
            if len(q):
                yield pd.DataFrame({"q": q.astype(np.int32), "id": [held[i][0] for i in j], "d": d[q, j], "lists": [held[i][1] for i in j]})

    found = index.select("id", "vector", "lists").mapInPandas(best, f"q int, id {kind}, d double, lists array<int>")
    order = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("place", order).where(F.col("place") <= k)


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, dims))


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For each row that ``queries`` holds for, its ``k`` nearest other rows: query_id, rank, vec_id, score.

    Euclidean distance in double precision on the vectors as given; ties to the smaller id.
    Vectors that are null, zero, of another width than most, or hold null or non-finite
    components take no part, nor do null ids. Rows that repeat an id count as one candidate,
    at the nearest of their vectors. A query gets all candidates if they are fewer than ``k``:
    it reads further lists as long as those that it has might hold too few. Extra columns are
    not read; an empty table has no rows.
    """
    spark, s = vectors.sparkSession, settings
    kind = vectors.schema[id_col].dataType.simpleString()
    raw = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("id is not null and vector is not null and size(vector) > 0")
    element = raw.schema["vector"].dataType.elementType.simpleString()
    if element not in ("float", "double"):
        raw, element = raw.withColumn("vector", F.col("vector").cast("array<double>")), "double"
    widths = raw.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if not widths:
        return empty
    dims, n = widths[0]["w"], widths[0]["n"]
    valid = raw.where(usable(F.col("vector"), dims))
    chosen = valid.orderBy(F.xxhash64("id"), "id").limit(max(1_024, min(SAMPLE, SAMPLE_VALUES // dims))).select("id", "vector").toArrow()
    sample = chosen.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    if not len(sample):
        return empty
    n_lists = max(1, min(s.n_lists or round(n**0.5), len(sample) // s.per_centroid, n // 64))
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids_of(sample, n_lists, s.seed), s.links))
    n_centroids, block_rows = len(graph.value.c), max(1, min(s.block_rows, BLOCK_VALUES // dims))

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ids, d = graph.value.search(matrix(b.vector, dims), s.copies)
                keep = (d <= s.copy_ratio * d[:, :1]) & (ids >= 0)
                yield b.assign(lists=[i[k] for i, k in zip(ids.astype(np.int32), keep)])

    # Stored, so that vectors are filed once: their lists are counted, then read.
    index = stored(valid.mapInPandas(filed, f"id {kind}, vector array<{element}>, is_query boolean, lists array<int>"), "postings")
    lengths_of = np.zeros(n_centroids, np.int64)
    for r in index.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect():
        lengths_of[r["list"]] = r["n"]
    lengths = spark.sparkContext.broadcast(lengths_of)

    # What a query must read: in which of its lists, nearest first, do true neighbours stand?
    asked_ids, asked_x = chosen.column("id").to_pylist()[: s.calibration], sample[: s.calibration]
    order, far = graph.value.search(asked_x, n_centroids)
    places, ratios = [0], [1.0]
    for r in true_neighbours(index, asked_ids, asked_x, k, kind).select("q", "lists").collect():
        at = np.flatnonzero(np.isin(order[r["q"]], r["lists"]))
        first = int(at[0]) if len(at) else n_centroids - 1
        places.append(first)
        ratios.append(far[r["q"], first] / max(far[r["q"], 0], 1e-300))
    probes = int(np.quantile(places, s.coverage, method="higher")) + 1
    probe_ratio = float(np.quantile(ratios, s.coverage, method="higher")) * (1 + 1e-9)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ids, d = graph.value.search(matrix(b.vector, dims), min(n_centroids, 2 * probes + 8))
            keep = (d <= probe_ratio * d[:, :1]) & (np.arange(ids.shape[1]) < probes) & (ids >= 0)
            length = np.where(ids >= 0, lengths.value[ids], 0)
            keep |= (ids >= 0) & (np.cumsum(length, 1) - length < s.copies * (k + 1))
            r, c = np.nonzero(keep)
            times = -(-lengths.value[ids[r, c]] // block_rows)
            again = np.repeat(np.arange(len(r)), times)
            block = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"list": ids[r, c][again].astype(np.int32), "block": block.astype(np.int32), "id": b.id.to_numpy()[r][again], "vector": b.vector.to_numpy()[r][again]})

    asked = index.where("is_query").select("id", "vector").mapInPandas(probed, f"list int, block int, id {kind}, vector array<{element}>")
    many = F.create_map(*[F.lit(int(x)) for i in np.flatnonzero(lengths_of > block_rows) for x in (i, -(-lengths_of[i] // block_rows))]) if (lengths_of > block_rows).any() else None
    n_blocks = F.coalesce(F.try_element_at(many, F.col("list")), F.lit(1)) if many is not None else F.lit(1)
    held = index.select(F.explode("lists").alias("list"), "id", "vector").withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    both = held.select("list", "block", F.lit(0).alias("asks"), "id", "vector").unionByName(asked.withColumn("asks", F.lit(1)))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's vectors come first, then its queries, batch after batch."""
        at, parts, block = None, [], None
        for b in batches:
            for key, rows in b.groupby(["list", "block", "asks"], sort=False):
                if key[:2] != at:
                    at, parts, block = key[:2], [], None
                if key[2] == 0:
                    parts.append((rows.id.to_numpy(), matrix(rows.vector, dims)))
                elif parts:
                    if block is None:
                        block = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    yield nearest(*block, rows.id.to_numpy(), matrix(rows.vector, dims), k)

    dealt = both.repartition("list", "block").sortWithinPartitions("list", "block", "asks")
    found = dealt.mapInPandas(compared, f"query_id {kind}, vec_id {kind}, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
