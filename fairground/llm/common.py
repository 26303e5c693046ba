"""Helpers that the operators share: table access, shared folders, row packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table for work that is heavy for each row: dealt to all cores if its files are fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a new temporary folder; on a cluster,
    whose executors don't share one, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage is cut."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``workspace`` that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside new columns.

    What an operator adds can then not clash with the columns that came in.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[v.alias(k) for k, v in named.items()])


def unpacked(df: DataFrame, like: DataFrame, **named: Column) -> DataFrame:
    """The columns of ``like`` from ``row``, those in ``named`` replaced or added."""
    lower = {k.lower(): k for k in named}
    kept = [named[lower[c.lower()]].alias(c) if c.lower() in lower else F.col("row").getField(c).alias(c) for c in like.columns]
    have = {c.lower() for c in like.columns}
    return df.select(*kept, *[v.alias(k) for k, v in named.items() if k.lower() not in have])
