"""Scalars and lists that can be called from SQL, once ``register`` has been called in a session.

They are temporary SQL functions, so Catalyst takes their bodies into the plan of the query that
calls them: filters reach the scans, and a call beside a table (``lateral``) becomes a join. Only
``json_leaves`` runs in Python, for documents of any depth.

Null arguments: scalars give null; a list takes a null city, country or venue for "any", and has no
rows for a null date, place or radius.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .text import fold_sql

#: Kilometres, by the haversine formula on a sphere of 6371 km. ``least`` passes over nulls, so they are told apart first.
_KM = "case when {0} + {1} + {2} + {3} is not null then 2 * 6371.0D * asin(least(1.0D, sqrt(pow(sin(radians(({2} - {0}) / 2)), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians(({3} - {1}) / 2)), 2)))) end"

SCALARS = {
    "folded": ("x string", "string", fold_sql("x")),
    "slug": ("x string, size int default 100", "string", "left(trim(BOTH '-' FROM regexp_replace(folded(x), '[^a-z0-9]+', '-')), size)"),
    "distance_km": ("lat double, lon double, lat_2 double, lon_2 double", "double", _KM.format("lat", "lon", "lat_2", "lon_2")),
    "retry_seconds": ("attempts int", "int", "case when attempts is not null then cast(least(300, 5 * pow(2, greatest(0, attempts - 1))) as int) end"),
}

_EVENT = "occurrence_id bigint, event_id bigint, title string, starts_at timestamp_ntz, venue_id bigint, city_id int"
_COLUMNS = "occurrence_id, event_id, title, starts_at, venue_id, city_id"
_PUBLIC = "status in ('published', 'cancelled', 'postponed', 'sold_out')"

LISTS = {
    "events_between": (
        "since timestamp_ntz, until timestamp_ntz, city int default null, country int default null",
        _EVENT,
        f"select {_COLUMNS} from listed_points where {_PUBLIC} and starts_at between since and until and (city is null or city_id = city) and (country is null or country_id = country)",
    ),
    "events_near": (
        "lat double, lon double, km double, since timestamp_ntz, until timestamp_ntz",
        f"{_EVENT}, km_away double",
        f"select * from (select {_COLUMNS}, distance_km(lat, lon, latitude, longitude) as km_away from listed_points where {_PUBLIC} and starts_at between since and until) where km_away <= km",
    ),
    "schedule_of": (
        "venue bigint",
        _EVENT,
        f"select {_COLUMNS} from listed_points where {_PUBLIC} and venue_id = venue",
    ),
}


@udtf(returnType="path string, value string")
class JsonLeaves:
    """A row for each value of a JSON document that is no object and no array; none for what is no JSON."""

    def eval(self, document: str | None) -> Iterator[tuple[str, str | None]]:
        try:
            waiting = [("$", json.loads(document))] if document is not None else []
        except (ValueError, RecursionError):
            return
        while waiting:
            path, value = waiting.pop()
            if isinstance(value, dict):
                waiting += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                waiting += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
            else:
                yield path, value if isinstance(value, str) or value is None else json.dumps(value)


def register(spark: SparkSession, points: DataFrame) -> None:
    """Creates the functions in this session; lists are those of ``points`` (as ``discovery.points`` gives them)."""
    points.createOrReplaceTempView("listed_points")
    for name, (given, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({given}) returns {kind} return {body}")
    for name, (given, columns, body) in LISTS.items():
        spark.sql(f"create or replace temporary function {name}({given}) returns table ({columns}) return {body}")
    spark.udtf.register("json_leaves", JsonLeaves)
