"""Hashes, and the few text functions that Spark lacks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over a text's code points."""
    points = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * 16777619 % 4294967296)


def coordinate_offset(x: Column, axis: int) -> Column:
    """A fixed offset in degrees, from the FNV-1a hash of every second character, the first ones for latitude (axis 0)."""
    points = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    own = F.filter(points, lambda c, i: i % 2 == axis)
    h = F.aggregate(own, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * 16777619 % 4294967296)
    return (h / F.lit(4294967295.0) - 0.5) * (0.012 if axis == 0 else 0.018)


def nfc(x: Column) -> Column:
    """Unicode NFC, by the normaliser that Spark has on its class path for collations; null stays null."""
    given = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(False))
    return F.when(x.isNotNull(), given)


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the matching blocks over both lengths, rounded to six places."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else round(difflib.SequenceMatcher(None, u, v, autojunk=False).ratio(), 6) for u, v in zip(x, y)], dtype="float64")

    return ratio(a, b)
