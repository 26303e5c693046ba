"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, workspace


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each node of ``edges`` (u, v: any ordered type) that has an edge to another, its component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of
    them; the number of rounds grows with the logarithm of the longest path. Rounds are kept
    in the shared folder, so what is lost is read again and not computed from the start.
    Nulls and loops are ignored. Returns (node, root); roots stand for themselves too.
    """
    spark, old, mark = edges.sparkSession, None, None

    def written(df: DataFrame) -> DataFrame:
        nonlocal old
        path = workspace(spark, "edges")
        df.write.parquet(path)
        if old:  # the round before was only read to write this one
            dropped(spark, old)
        old = path
        return spark.read.schema(df.schema).parquet(path)

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct())
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
