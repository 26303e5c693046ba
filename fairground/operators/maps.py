"""Map projections: grid cells, rounded locations and place clusters of a viewport.

Totals are a second aggregate over the grouped rows, joined as one row, so no window runs over
all rows in one task; caps on markers are what the map shows (with ``truncated`` told).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Viewport, grid_cell, grid_zoom, place_cell
from ..plans.domain import Domain
from .discovery import Filters, filtered, needs, points, viewport_filters

MAX_CELLS, MAX_POINTS, MAX_PLACES = 8_000, 12_000, 2_500


def visible_points(d: Domain, box: Viewport, f: Filters) -> DataFrame:
    """Occurrences of the viewport; a venue that isn't public gives neither its location nor its city."""
    f = viewport_filters(f)
    rows = filtered(points(d, f, offers=needs(f)["offers"], public_venues=True), f).where(~F.col("is_demo")).where(box.holds(F.col("latitude"), F.col("longitude")))
    return rows.select("occurrence_id", "slug", "category_slug", "is_free", "latitude", "longitude", (F.col("location_precision") == "city").cast("int").alias("approximate"))


def _with_totals(markers: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    totals = markers.agg(F.sum("event_count").alias("total_count"), F.sum("free_count").alias("total_free"), (F.count("*") > cap).alias("truncated"))
    return markers.orderBy(*order).limit(cap).crossJoin(F.broadcast(totals))


def grid_markers(d: Domain, box: Viewport, f: Filters, zoom: float, cap: int = MAX_CELLS) -> DataFrame:
    z = grid_zoom(zoom)
    y, x = grid_cell(F.col("latitude"), F.col("longitude"), z)
    cells = visible_points(d, box, f).groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(
        F.count("*").alias("event_count"),
        F.count_if("is_free").alias("free_count"),
        F.round(F.avg("longitude"), 5).alias("longitude"),
        F.round(F.avg("latitude"), 5).alias("latitude"),
        F.min("category_slug").alias("category_slug"),
        F.bool_or("is_free").alias("has_free"),
        F.max("approximate").alias("approximate"),
    )
    return _with_totals(cells.withColumn("marker_id", F.concat(F.lit(f"z{z}:"), F.col("cell_y"), F.lit(":"), F.col("cell_x"))), cap, [F.col("cell_y"), F.col("cell_x")])


def location_markers(d: Domain, box: Viewport, f: Filters, cap: int = MAX_POINTS) -> DataFrame:
    """One marker for each location of five decimals: the event itself if it is alone.

    The map shows the first ``cap`` occurrences by id; the totals count all.
    """
    alone, rows = F.count("*") == 1, visible_points(d, box, f)
    totals = rows.agg(F.count("*").alias("total_count"), F.count_if("is_free").alias("total_free"), (F.count("*") > cap).alias("truncated"))
    shown = rows.orderBy("occurrence_id").limit(cap)
    places = shown.groupBy(F.round("longitude", 5).alias("longitude"), F.round("latitude", 5).alias("latitude")).agg(
        F.when(alone, "event").otherwise("cluster").alias("kind"),
        F.when(alone, F.min("occurrence_id")).alias("occurrence_id"),
        F.when(alone, F.min_by("slug", "occurrence_id")).otherwise("").alias("slug"),
        F.min("category_slug").alias("category_slug"),
        F.max("approximate").alias("approximate"),
        F.count("*").alias("event_count"),
        F.count_if("is_free").alias("free_count"),
    )
    return places.crossJoin(F.broadcast(totals))


def marker_tuples(markers: DataFrame) -> DataFrame:
    """Grid markers as compact tuples: kind, id, longitude, latitude, category, free, approximate, slug, events, free events; joined by ``|``."""
    fields = [F.lit("cluster"), "marker_id", *[F.format_number(c, 5) for c in ("longitude", "latitude")], "category_slug", F.col("has_free").cast("int").cast("string"), F.col("approximate").cast("string"), F.lit(""), F.col("event_count").cast("string"), F.col("free_count").cast("string")]
    return markers.select(F.concat_ws("|", *fields).alias("pin"))


def place_rows(d: Domain) -> DataFrame:
    """Venues and their events as places: quality, kind, fee."""
    e = d.events().groupBy(F.col("event_venue_id").alias("venue_id")).agg(F.count("*").alias("n_events"), F.min("category_slug").alias("category"), F.max("title").alias("sample_title"))
    v = d.venues().where("is_public and venue_lat is not null").join(e, "venue_id", "left")
    quality = F.least(F.lit(100), 55 + F.when(F.col("venue_capacity").isNotNull(), 10).otherwise(0) + F.coalesce("n_events", F.lit(0)) % 30)
    return v.select(F.col("venue_id").alias("place_id"), F.col("venue_name").alias("name"), "venue_city_id", F.coalesce("category", F.lit("none")).alias("category"), F.col("venue_lat").alias("latitude"), F.col("venue_lon").alias("longitude"), quality.cast("int").alias("quality"), F.when(F.col("venue_id") % 4 == 0, " Gratuit").when(F.col("venue_id") % 4 == 1, "no").when(F.col("venue_id") % 4 == 2, "12 EUR").alias("fee"), F.when(F.col("venue_id") % 3 == 0, "Limited").when(F.col("venue_id") % 3 == 1, "no").alias("wheelchair"))


#: Fees that tell a free entrance.
FREE_FEE = "^(0|false|free|gratuit|gratuito|kostenlos|no)$"
ACCESSIBLE = ("yes", "limited", "designated")


def place_filters(rows: DataFrame, free_only: bool, accessible_only: bool) -> DataFrame:
    rows = rows.where(F.lower(F.trim(F.coalesce("fee", F.lit("")))).rlike(FREE_FEE)) if free_only else rows
    return rows.where(F.lower("wheelchair").isin(*ACCESSIBLE)) if accessible_only else rows


def place_clusters(d: Domain, box: Viewport, zoom: float, cap: int = MAX_PLACES) -> DataFrame:
    y, x = place_cell(F.col("latitude"), F.col("longitude"), zoom)
    rows = place_rows(d).where(box.holds(F.col("latitude"), F.col("longitude")))
    return rows.groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(
        F.count("*").alias("place_count"),
        F.when(F.count_distinct("category") == 1, F.min("category")).otherwise("mixed").alias("category"),
        F.max("quality").alias("best_quality"),
    ).orderBy(F.desc("place_count"), "cell_y", "cell_x").limit(cap)


def places_page(d: Domain, box: Viewport, free_only: bool, accessible_only: bool, limit: int, offset: int) -> DataFrame:
    """Best places first, with the number of all and whether more follow."""
    rows = place_filters(place_rows(d).where(box.holds(F.col("latitude"), F.col("longitude"))), free_only, accessible_only)
    total = rows.agg(F.count("*").alias("total_count"))
    part = rows.orderBy(F.desc("quality"), "name", "place_id").offset(offset).limit(limit)
    return part.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_count") > offset + limit)
