"""Inserts, upserts, updates and deletes over whole tables.

Parquet tables have no row updates; each function returns the table's next state, to be
written whole. A full rewrite moves each row once, whatever the number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignoring(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those of ``new`` whose keys it lacks; repeats within ``new`` count once."""
    fresh = new.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(fresh)


def upsert_coalescing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win where they are not null; one shuffle on the keys brings both sides together."""
    others = [c for c in target.columns if c not in keys]
    both = target.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(0)))
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("side"))).alias(c)
    return both.groupBy(*keys).agg(*map(pick, others))


def upsert_where(target: DataFrame, new: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Adds to a counter of the keys, but not beyond ``limit``; new keys are inserted as they are."""
    both = target.join(new.withColumnRenamed(value, "added"), keys, "full")
    more = F.coalesce("added", F.lit(0))
    return both.select(*keys, F.when(F.col(value).isNull(), more).when(F.col(value) + more <= limit, F.col(value) + more).otherwise(F.col(value)).alias(value))


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` from ``changes`` where the keys are among them."""
    marked = changes.select(*keys, F.col(column).alias("changed"), F.lit(True).alias("hit"))
    out = target.join(marked, keys, "left")
    return out.select(*[F.when(F.col("hit"), F.col("changed")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns])


def delete_matching(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")
