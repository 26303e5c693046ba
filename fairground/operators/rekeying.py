"""Merged duplicates in all tables that point to them: one map, and for each table its own rule for conflicts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


@dataclass(frozen=True)
class Rule:
    """How a table takes the rows of merged events.

    Without ``unique`` rows are only re-keyed. With it, rows of one event that agree in ``unique`` (empty: all of the
    event's) become one, column by column: ``first`` and ``last`` value that isn't null, ``any``, ``greatest``, ``longest`` text (ties to the
    earlier) and ``union`` of arrays (sorted); other columns are the earliest row's, null or not. Its own row comes before those of duplicates,
    these by the duplicate's id, then by ``order``.
    """

    unique: tuple[str, ...] | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    order: str | None = None


def resolved(canonical: DataFrame) -> DataFrame:
    """(duplicate, event_id) with chains followed to their end; a circle raises.

    Each round doubles the steps that a row has taken, so a chain of n costs log n joins, and fewer rows move
    than in the round before unless they go round in a circle. A duplicate with several targets goes to the smallest.
    """
    now, last = stored(canonical.where("duplicate <> event_id").groupBy("duplicate").agg(F.min("event_id").alias("event_id")), "canonical"), None
    while True:
        onward = now.select(F.col("duplicate").alias("event_id"), F.col("event_id").alias("next"))
        now = stored(now.join(onward, "event_id", "left").select("duplicate", F.coalesce("next", "event_id").alias("event_id"), F.col("next").isNotNull().alias("moved")), "canonical")
        moving = now.where("moved").count()
        now = now.drop("moved")
        if not moving:
            return now
        if moving == last:
            raise ValueError("merged events point to each other in a circle")
        last = moving


def _value(column: str, how: str, rank: Column) -> Column:
    x = F.col(column)
    told = F.when(x.isNotNull(), rank)
    return {
        "own": lambda: F.min_by(x, rank),
        "first": lambda: F.min_by(x, told),
        "last": lambda: F.max_by(x, told),
        "any": lambda: F.bool_or(x),
        "greatest": lambda: F.max(x),
        "longest": lambda: F.min_by(x, F.when(x.isNotNull(), F.struct(-F.length(x), rank))),
        "union": lambda: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x)))),
    }[how]().alias(column)


def rekeyed(canonical: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """``rows`` (event_id and more) after the merge; events that nothing was merged into keep their rows as they are.

    ``canonical`` is ``resolved``. Nulls in ``unique`` agree with each other.
    """
    moved = rows.join(canonical.select(F.col("duplicate").alias("event_id"), F.col("event_id").alias("target")), "event_id", "left")
    if rule.unique is None:
        return moved.withColumn("event_id", F.coalesce("target", "event_id")).select(*rows.columns)
    rank = F.struct(F.col("target").isNotNull(), F.col("source"), F.col(rule.order) if rule.order else F.lit(0))
    keyed = moved.withColumn("source", F.col("event_id")).withColumn("event_id", F.coalesce("target", "event_id"))
    touched = canonical.select("event_id").distinct()
    rest = keyed.join(touched, "event_id", "left_anti").select(*rows.columns)
    values = [_value(c, rule.columns.get(c, "own"), rank) for c in rows.columns if c not in ("event_id", *rule.unique)]
    one = keyed.join(touched, "event_id", "left_semi").groupBy("event_id", *rule.unique)
    merged = one.agg(*values) if values else one.agg(F.lit(1).alias("one"))
    return rest.unionByName(merged.select(*rows.columns))


def merge_everywhere(canonical: DataFrame, tables: Mapping[str, DataFrame], rules: Mapping[str, Rule]) -> dict[str, DataFrame]:
    """Each of ``tables`` by its rule of the same name, all by one map, which is resolved and stored once."""
    whole = resolved(canonical)
    return {name: rekeyed(whole, rows, rules[name]) for name, rows in tables.items()}


#: The tables of an event and their rules (fixed values).
RULES = {
    "events": Rule((), {"short_description": "longest", "description": "longest", "category_slug": "first", "organizer_id": "first", "venue_id": "first", "city_id": "first", "is_free": "any", "official_url": "first", "cover_url": "first", "genres": "union", "quality": "greatest", "last_seen_at": "greatest"}),
    "occurrences": Rule(("starts_at",), {"ends_at": "last", "doors_open_at": "last", "local_end_date": "last", "capacity": "last", "latitude": "last", "longitude": "last"}),
    "performers": Rule(("performer_id",), {"is_headliner": "any"}),
    "media": Rule(),
    "offers": Rule(),
    "accessibility": Rule((), {"wheelchair": "any", "hearing_loop": "any", "sign_language": "any", "quiet_space": "any", "notes": "first"}),
    "status_history": Rule(),
    "identities": Rule(("identity_type", "source_domain", "normalized_value"), order="id"),
    "sources": Rule(("canonical_url",), order="id"),
}
