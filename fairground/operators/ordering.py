"""Positions and running counters that need an order over many rows, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_position(rows: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``position``, from 1, in the order of ``bucket`` and then of ``order``.

    Rows are numbered within their bucket; what stands in earlier buckets is added. Only the
    buckets' counts meet in one task, so there should be few of them against the rows.
    """
    placed = rows.withColumn("bucket_", bucket)
    before = F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("bucket_").agg(F.count("*").alias("n_")).select(F.col("bucket_").alias("b_"), before.alias("before_"))
    numbered = placed.withColumn("place_", F.row_number().over(Window.partitionBy("bucket_").orderBy(*order)))
    return numbered.join(starts, F.col("bucket_").eqNullSafe(F.col("b_"))).withColumn("position", F.col("before_") + F.col("place_")).drop("bucket_", "b_", "before_", "place_")


def clamped_counters(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """(key, net, counter): the sum of ``delta`` in order of time, and the same when each step stops at 0.

    The clamped counter is the sum less the lowest point that the running sum reaches under 0. Days
    are worked through by themselves, then each key's days, so that no task holds all rows of a key.
    """
    running = Window.partitionBy(key, "day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    steps = changes.withColumn("day", F.to_date(at)).withColumn("sum_", F.sum("delta").over(running))
    days = steps.groupBy(key, "day").agg(F.sum("delta").alias("net"), F.min("sum_").alias("low"))
    earlier = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    lows = days.withColumn("low", F.coalesce(F.sum("net").over(earlier), F.lit(0)) + F.col("low"))
    return lows.groupBy(key).agg(F.sum("net").alias("net"), (F.sum("net") - F.least(F.lit(0), F.min("low"))).alias("counter"))
