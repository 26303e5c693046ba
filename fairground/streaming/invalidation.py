"""Translations that go stale as what they tell of changes: a stream of changes beside the tables of events and translations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: What a change must touch to make a translation stale, by kind of record (fixed values); a change of any other kind, a child of the event, always does.
WATCHED = {
    "event": ("title", "short_description", "description", "age_restriction", "language", "venue_id", "organizer_id"),
    "venue": ("name", "description"),
    "organizer": ("name", "description"),
    "performer": ("name", "type", "bio"),
}


def touching() -> Column:
    """Whether a change (kind, before, after: maps of texts) touches what is translated; a missing field is null."""
    differs = lambda c: ~F.try_element_at("before", F.lit(c)).eqNullSafe(F.try_element_at("after", F.lit(c)))
    out = F.lit(True)
    for kind, columns in WATCHED.items():
        out = F.when(F.col("kind") == kind, F.exists(F.array(*[differs(c) for c in columns]), lambda x: x)).otherwise(out)
    return out


def links(events: DataFrame, performers: DataFrame) -> DataFrame:
    """(kind, id, event_id): the events of venues and organizers (columns of ``events``) and of performers (performer_id, event_id)."""
    of = lambda rows, kind: rows.where(f"{kind}_id is not null").select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("long").alias("id"), "event_id")
    return of(events, "venue").unionByName(of(events, "organizer")).unionByName(of(performers, "performer"))


def marks(changes: DataFrame, linked: DataFrame, translations: DataFrame) -> DataFrame:
    """(event_id, language, changed_at): the machine-made or reviewed translations that ``changes`` make stale, with the last change of each.

    ``changes``: kind, id, before, after, ts; the id is an event's but for kinds that ``linked`` (``links``) leads on from. ``translations``:
    event_id, language, translation_status, updated_at. A translation that was made after a change is left alone. Of a record's changes
    only the last is joined, so a venue that changes a thousand times meets its events once.
    """
    last = changes.where(touching() & F.col("id").isNotNull()).groupBy("kind", "id").agg(F.max("ts").alias("ts"))
    own = last.where(~F.col("kind").isin("venue", "organizer", "performer")).select(F.col("id").alias("event_id"), "ts")
    touched = own.unionByName(last.join(linked, ["kind", "id"]).select("event_id", "ts")).groupBy("event_id").agg(F.max("ts").alias("changed_at"))
    open_ = translations.where(F.col("translation_status").isin("machine", "reviewed")).select("event_id", "language", "updated_at")
    return open_.join(touched, "event_id").where("changed_at >= updated_at").select("event_id", "language", "changed_at")


def follow(changes: DataFrame, linked: DataFrame, translations: DataFrame) -> DataFrame:
    """``marks`` of a streaming ``changes``, batch by batch until it is used up; returns what was marked as a table.

    The tables are read anew by each batch. Nothing is kept between batches but the stream's own checkpoint; a batch that is run again
    after a failure overwrites its own marks. A translation may be marked in several batches.
    """
    spark = changes.sparkSession
    base = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"

    def batch(rows: DataFrame, n: int) -> None:
        marks(rows, linked, translations).write.mode("overwrite").parquet(f"{base}/rows/n={n}")

    changes.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    schema = marks(spark.createDataFrame([], changes.schema), linked, translations).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/rows/n=-1")  # a stream without a batch has no folder
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/rows")


def with_marks(translations: DataFrame, marked: DataFrame) -> DataFrame:
    """``translations`` as they stand after ``marked``: stale where a mark isn't older than the translation."""
    last = marked.groupBy("event_id", "language").agg(F.max("changed_at").alias("changed_at"))
    stale = F.col("translation_status").isin("machine", "reviewed") & (F.col("changed_at") >= F.col("updated_at"))
    out = translations.join(last, ["event_id", "language"], "left").withColumn("translation_status", F.when(stale, "stale").otherwise(F.col("translation_status")))
    return out.select(*translations.columns)
