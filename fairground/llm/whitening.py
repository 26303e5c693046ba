"""Whitening of embeddings by MLlib's singular values of centred rows.

Vectors are brought to fixed point, so that sums and deviations are exact whole numbers. The
model is fitted on each distinct vector once: RowMatrix.computeSVD runs over the centred rows,
and its singular values become variances by the divisor n. The total variance is computed apart
from them, from the exact deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

#: Singular values under this part of the largest are rounding noise: such components are not given.
NOISE = 1e-7
#: Sums of deviations are added up in two parts, so that they stay exact beyond 38 digits.
PART = 10**18


def fixed_point(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as long; null for vectors that are null, empty or hold null or non-finite entries.

    Entries beyond the range of a long are held at its ends.
    """
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.when((F.size(vector) > 0) & sound, whole)


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 for each row, in whole numbers of any size."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    kind = np.int64 if largest**2 * max(1, x.shape[1]) < 1 << 63 else object
    off = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [int(v) for v in (off * off).sum(axis=1)]


@dataclass(frozen=True)
class Whitening:
    """A fitted model: n distinct vectors with exact sums, components (a row each) and variances, both by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    scale: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean) @ self.components.T / np.sqrt(self.variances)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def fit_list(df: DataFrame, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each distinct fixed-point vector (``x``) once, of the length that most rows have (of equally frequent ones, the largest)."""
    x = df.select(fixed_point(F.col(f"`{vector_col}`"), scale).alias("x")).where("x is not null")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored(x.where(F.size("x") == (lengths.d if lengths else 0)).distinct(), "fit-list")


def fit(vectors: DataFrame, k: int, scale: int = 256) -> Whitening | None:
    """A model with up to ``k`` components from a ``fit_list``; None if it is empty.

    Components whose singular value is under ``NOISE`` of the largest are left out, so there
    are fewer for vectors that span fewer dimensions, and none if all are equal.
    """
    exact = vectors.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not exact:
        return None
    d, n = len(exact), exact[0].n
    sums = [int(r.s) for r in sorted(exact, key=lambda r: r.i)]

    def spread_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(sum(exact_deviations(_matrix(b.x), n, sums)) for b in batches)
        yield pd.DataFrame({"whole": [str(total // PART)], "rest": [str(total % PART)]})

    parts = vectors.mapInPandas(spread_of, "whole string, rest string").select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in ("whole", "rest")]).agg(F.sum("whole").alias("w"), F.sum("rest").alias("r")).first()
    squares = int(parts.w) * PART + int(parts.r)
    if not squares:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, scale)
    model = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), float(Fraction(squares, n**3)), scale)
    rows = vectors.select(array_to_vector(F.zip_with(F.col("x").cast("array<double>"), F.lit(model.mean), lambda a, b: a - b)).alias("row"))
    # With more than half of the dimensions asked for, MLlib decomposes the Gram matrix of the rows by LAPACK, to double precision.
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row")).computeSVD(min(d, max(k, d // 2 + 1)), computeU=False, rCond=NOISE)
    values, across = found.s.toArray(), found.V.toArray().T
    values, across = values[:k], across[:k]
    across = across * np.sign(across[np.arange(len(across)), np.abs(across).argmax(axis=1)])[:, None]
    return Whitening(n, sums, across, values**2 / n, model.total, scale)


def _with_scores(kept: DataFrame, model: Whitening) -> DataFrame:
    """``kept`` (with ``x``) and its columns ``whitened`` and ``deviation``."""

    @F.pandas_udf("struct<whitened: array<double>, deviation: string>")
    def told(x: pd.Series) -> pd.DataFrame:
        rows = _matrix(x)
        apart = exact_deviations(rows, model.n, model.sums) if len(rows) else []
        values = model.project(rows) if len(rows) else np.zeros((0, 0))
        return pd.DataFrame({"whitened": list(values), "deviation": [str(v) for v in apart]})

    told_of = kept.withColumn("told", told("x"))
    return told_of.withColumn("whitened", F.col("told.whitened")).withColumn("deviation", F.col("told.deviation").try_cast("decimal(38,0)")).drop("told")


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """Rows of ``df`` as the struct ``row``, with ``whitened`` (array<double>, a number for each component) and ``deviation``.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2 as decimal(38,0), null if it
    has more digits. Rows without a vector of the model's length, or with null or non-finite
    entries, are left out; repeated rows each stay; other columns pass in ``row``.
    """
    kept = packed(df, x=fixed_point(F.col(f"`{vector_col}`"), model.scale)).where(F.size("x") == len(model.sums))
    return _with_scores(kept, model).select("row", "whitened", "deviation")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.variances)
    if not k:
        return 0.0
    rows = _with_scores(vectors, model)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """A row for each row of ``df`` with a sound vector and each component: id, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` (part of the total variance) and ``identity_error``.

    Vectors that are null, empty, of another length than most, or hold null or non-finite entries
    take no part. Repeated rows each have their rows, and count once in the fit. An empty table,
    or one of equal vectors, gives no rows. Ids may be null.
    """
    vectors = fit_list(df, vector_col, scale)
    model = fit(vectors, k, scale)
    kind = df.schema[id_col].dataType.simpleString()
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(vectors, model)
    each = whiten(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), model, "v").select(F.col("row.id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    part = F.get(F.lit(model.variances / model.total), F.col("at"))
    return each.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", part.alias("explained"), F.lit(error).alias("identity_error"))
