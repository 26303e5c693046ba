"""List discovery: one plan, filters added only where a parameter is set."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import Viewport, haversine_km, jitter
from ..functions.text import fold, similarity, tokens
from ..plans.domain import PUBLIC_STATUSES, Domain


@dataclass(frozen=True)
class Filters:
    start: datetime = datetime(1997, 1, 1)
    end: datetime = datetime(1997, 3, 31)
    city_id: int | None = None
    country_id: int | None = None
    categories: tuple[str, ...] | None = None
    genres: tuple[str, ...] | None = None
    query: str | None = None
    free_only: bool = False
    priced_only: bool = False
    price_min: float | None = None
    price_max: float | None = None
    capacity_min: int | None = None
    capacity_max: int | None = None
    capacity_unknown: bool = False
    tickets_only: bool = False
    verified_only: bool = False
    accessible_only: bool = False
    venue_only: bool = False
    latitude: float | None = None
    longitude: float | None = None
    radius_km: float = 25
    limit: int = 40
    offset: int = 0


def offer_summary(offers: DataFrame) -> DataFrame:
    """Cheapest and dearest price and whether tickets can be had, for each event."""
    return offers.groupBy("event_id").agg(
        F.min(F.when(F.col("offer_free"), 0.0).otherwise(F.coalesce("price_min", "price_max"))).alias("offer_from"),
        F.max(F.when(F.col("offer_free"), 0.0).otherwise(F.coalesce("price_max", "price_min"))).alias("offer_to"),
        F.bool_or(F.col("offer_free") | (F.col("has_url") & ~F.col("sold_out"))).alias("offer_tickets"),
    )


def points(d: Domain, f: Filters | None = None, *, venues: bool = True, offers: bool = True, public_venues: bool = False, only: DataFrame | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """Occurrences with event, venue, city, offers and a location.

    The date range is applied to the occurrences before any join. What isn't asked for isn't
    joined: without ``venues`` there is neither venue, city nor location, without ``offers`` no
    price. ``only`` (occurrence_id, event_id) names the rows of a page; order lines of other events
    are then passed over where they are scanned. With ``public_venues``, other venues are unknown.
    ``told`` are more columns of events, computed once for each and not for each occurrence.
    """
    ids = only.select("event_id").distinct() if only is not None else None
    occurrences, events = d.occurrences(ids), d.events(ids, hosts=venues)
    if f is not None:
        occurrences = occurrences.where(F.col("starts_at").between(F.lit(f.start).cast("timestamp_ntz"), F.lit(f.end).cast("timestamp_ntz")))
        events = events.where(F.col("status").isin(*PUBLIC_STATUSES))
    if only is not None:
        occurrences = occurrences.join(F.broadcast(only.select("occurrence_id")), "occurrence_id", "left_semi")
    e = occurrences.join(events.withColumns(told or {}), "event_id")
    columns = [*(told or {}), "occurrence_id", "event_id", "slug", "title", "category_slug", "genres", "starts_at", "ends_at", "is_free", "is_verified", "is_demo", "status", F.coalesce("wheelchair", F.lit(False)).alias("wheelchair")]
    if venues:
        known = d.venues().where("is_public") if public_venues else d.venues()
        e = e.join(known, F.col("event_venue_id") == F.col("venue_id"), "left").join(d.cities(), F.coalesce("venue_city_id", "event_city_id") == F.col("city_id"), "left")
        exact, at_venue = F.col("occ_lat").isNotNull() & F.col("occ_lon").isNotNull(), F.col("venue_lat").isNotNull() & F.col("venue_lon").isNotNull()
        columns += [
            "venue_id", "venue_name", "is_public", "city_id", "city_name", "country_id",
            F.coalesce("occ_capacity", "venue_capacity").alias("capacity"),
            F.when(exact, "exact").when(at_venue, "venue").otherwise("city").alias("location_precision"),
            F.coalesce("occ_lat", "venue_lat", "city_lat").alias("plain_lat"),
            F.coalesce("occ_lon", "venue_lon", "city_lon").alias("plain_lon"),
            F.coalesce("occ_lat", "venue_lat", F.col("city_lat") + jitter(F.col("event_id"), 0, 0.012)).alias("latitude"),
            F.coalesce("occ_lon", "venue_lon", F.col("city_lon") + jitter(F.col("event_id"), 1, 0.018)).alias("longitude"),
        ]
    if offers:
        e = e.join(offer_summary(d.offers(ids)), "event_id", "left")
        free = F.when(F.col("is_free"), 0.0)
        columns += [F.coalesce("offer_from", free).alias("price_from"), F.coalesce("offer_to", free).alias("price_to"), (F.coalesce("offer_tickets", F.lit(False)) | F.col("is_free")).alias("has_tickets")]
    return e.select(*columns)


def needs(f: Filters) -> dict[str, bool]:
    """What ``filtered`` needs ``points`` to join for the filters that are set."""
    given = lambda *xs: any(x is not None and x is not False for x in xs)
    return {
        "venues": given(f.city_id, f.country_id, f.capacity_min, f.capacity_max, f.capacity_unknown, f.venue_only, f.latitude, f.longitude, f.query),
        "offers": given(f.free_only, f.priced_only, f.price_min, f.price_max, f.tickets_only),
    }


def described(d: Domain, ids: DataFrame, f: Filters) -> DataFrame:
    """The rows of a page (occurrence_id, event_id) with all that ``points`` tells of them, in order."""
    return points(d, f, only=ids).orderBy("starts_at", "occurrence_id")


def text_matches(query: str, title: Column, venue: Column) -> Column:
    """All words of the query in the title, or the query as it is in title or venue name."""
    words = F.split(F.lit(query), r"[^\p{L}\p{N}]+")
    every = F.size(F.array_except(F.filter(F.transform(words, lambda w: fold(w)), lambda w: w != ""), tokens(title))) == 0
    like = F.lit(query.lower())
    return every | F.contains(F.lower(title), like) | F.contains(F.lower(F.coalesce(venue, F.lit(""))), like)


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    """``rows`` of ``points`` under the filters that are set."""
    tests: list[tuple[object, Column]] = [
        (f.city_id, F.col("city_id") == f.city_id),
        (f.country_id, F.col("country_id") == f.country_id),
        (f.categories, F.col("category_slug").isin(*(f.categories or ()))),
        (f.genres, F.arrays_overlap("genres", F.array(*map(F.lit, f.genres or ())))),
        (f.free_only, F.col("is_free") | (F.col("price_from") == 0)),
        (f.priced_only, F.col("is_free") | F.col("price_from").isNotNull()),
        (f.price_min, F.col("price_from") >= f.price_min),
        (f.price_max, F.col("price_from") <= f.price_max),
        (f.capacity_unknown, F.col("capacity").isNull()),
        (f.capacity_min, F.col("capacity") >= f.capacity_min),
        (f.capacity_max, F.col("capacity") <= f.capacity_max),
        (f.tickets_only, F.col("has_tickets")),
        (f.verified_only, F.col("is_verified")),
        (f.accessible_only, F.col("wheelchair")),
        (f.venue_only, F.col("venue_id").isNotNull()),
    ]
    for value, test in tests:
        if value is not None and value is not False:
            rows = rows.where(test)
    if f.query and f.query.strip():
        rows = rows.where(text_matches(f.query.strip(), F.col("title"), F.col("venue_name")))
    if f.latitude is not None and f.longitude is not None:
        rows = rows.where(within(f))
    return rows


def within(f: Filters) -> Column:
    """Inside the radius; a band of latitude goes first, as it needs no trigonometry."""
    band = F.col("plain_lat").between(f.latitude - f.radius_km / 111.0, f.latitude + f.radius_km / 111.0)
    return band & (haversine_km(f.latitude, f.longitude, F.col("plain_lat"), F.col("plain_lon")) <= f.radius_km)


def page(rows: DataFrame, f: Filters) -> DataFrame:
    """Earliest first, ties by id; 1 to 1500 rows."""
    return rows.orderBy(F.col("starts_at").asc(), F.col("occurrence_id").asc()).offset(max(0, f.offset)).limit(max(1, min(1500, f.limit)))


def discover(d: Domain, f: Filters) -> DataFrame:
    """A page of events, with the distance where a centre is given."""
    rows = filtered(points(d, f), f)
    if f.latitude is not None and f.longitude is not None:
        rows = rows.withColumn("distance_km", F.round(haversine_km(f.latitude, f.longitude, F.col("plain_lat"), F.col("plain_lon")), 2))
    return page(rows, f)


def discover_city(d: Domain, f: Filters) -> DataFrame:
    """City path: events at a venue of the city, and those without a venue city in the city itself."""
    rows = filtered(points(d, f), replace(f, city_id=None))
    own = rows.where(F.col("venue_id").isNotNull() & (F.col("city_id") == f.city_id))
    loose = rows.where(F.col("venue_id").isNull() & (F.col("city_id") == f.city_id))
    return page(own.unionByName(loose), f)


def discover_country(d: Domain, f: Filters) -> DataFrame:
    """Country path: cities of the country first, then a semi join."""
    scoped = d.cities().where(F.col("country_id") == f.country_id).select("city_id")
    return page(filtered(points(d, f), replace(f, country_id=None)).join(scoped, "city_id", "left_semi"), f)


def viewport_filters(f: Filters) -> Filters:
    """``f`` as a viewport takes it: the box stands for radius, city and country."""
    return replace(f, latitude=None, longitude=None, city_id=None, country_id=None)


def discover_viewport(d: Domain, box: Viewport, f: Filters) -> DataFrame:
    """Early-limit page: ids and times are cut to the page before titles and names join in."""
    f = viewport_filters(f)
    rows = filtered(points(d, f, venues=True, offers=needs(f)["offers"]), f).where(~F.col("is_demo")).where(box.holds(F.col("latitude"), F.col("longitude")))
    narrow = page(rows.select("occurrence_id", "event_id", "starts_at", "venue_id", "city_id", "latitude", "longitude"), f)
    return narrow.join(d.events(hosts=False).select("event_id", "slug", "title"), "event_id").join(d.venues().select("venue_id", "venue_name"), "venue_id", "left").join(d.cities().select("city_id", "city_name"), "city_id", "left")


def stats(d: Domain, f: Filters) -> DataFrame:
    return filtered(points(d, f, **needs(f)), f).agg(F.count("*").alias("total_count"), F.count_if("is_free").alias("free_count"), F.count_if("is_verified").alias("verified_count"))


def home_shelves(d: Domain, f: Filters, k: int) -> DataFrame:
    """Top-k shelves from one candidate scan: (shelf, position, ...)."""
    rows = points(d, f, venues=False, offers=False).where(~F.col("is_demo"))
    shelf = F.array_compact(F.array(F.lit("top"), F.when(F.col("is_free"), "free"), F.when(F.col("category_slug").isin("small", "medium"), "nightlife"), F.when(F.col("category_slug").isin("promo", "large"), "festivals")))
    spread = rows.select("occurrence_id", "title", "starts_at", "is_verified", F.explode(shelf).alias("shelf"))
    best_top = F.when((F.col("shelf") == "top") & F.col("is_verified"), 0).otherwise(1)
    order = Window.partitionBy("shelf").orderBy(best_top, "starts_at", "occurrence_id")
    return spread.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("shelf", "position", "occurrence_id", "title", "starts_at")


def venue_schedule(d: Domain, asof: datetime, upcoming: int, past: int) -> DataFrame:
    """Each public venue's next and last occurrences as arrays, with counts and the first next date."""
    now = F.lit(asof).cast("timestamp_ntz")
    rows = d.occurrences().join(d.events().where(F.col("status").isin(*PUBLIC_STATUSES)), "event_id").select("occurrence_id", F.col("event_venue_id").alias("venue_id"), "starts_at")
    rows = rows.withColumn("later", F.col("starts_at") >= now).withColumn("gap", F.abs(F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("venue_id", "later").orderBy("gap", "occurrence_id"))).where(F.col("place") <= F.when(F.col("later"), upcoming).otherwise(past))
    side = lambda later: F.transform(F.sort_array(F.collect_list(F.when(F.col("later") == later, F.struct("place", "occurrence_id")))), lambda x: x["occurrence_id"])
    docs = ranked.groupBy("venue_id").agg(side(True).alias("upcoming"), side(False).alias("past"), F.min(F.when(F.col("later"), F.col("starts_at"))).alias("next_at"))
    return d.venues().where("is_public").join(docs, "venue_id", "left")


def country_venues(d: Domain, country_id: int, limit: int, offset: int) -> DataFrame:
    rows = d.venues().where("is_public").join(d.cities(), F.col("venue_city_id") == F.col("city_id")).where(F.col("country_id") == country_id).join(d.countries(), "country_id")
    return rows.orderBy("venue_name", "venue_id").offset(offset).limit(limit)


def search_cities(d: Domain, query: str, limit: int) -> DataFrame:
    """Accent-blind city search: equal names, then prefixes, then the rest."""
    needle, name = fold(F.lit(query)), fold(F.col("city_name"))
    rank = F.when(name == needle, 0).when(F.startswith(name, needle), 1).otherwise(2)
    return d.cities().where(F.contains(name, needle)).withColumn("match_rank", rank).orderBy("match_rank", "city_name", "city_id").limit(limit)


def search_venues(d: Domain, query: str, limit: int = 8) -> DataFrame:
    """Public venues whose name, address or city holds the query: names that begin with it first, then the most similar by trigrams, then by name; 1 to 12 rows."""
    asked = query.strip()
    v = d.venues().where("is_public").join(d.cities(), F.col("venue_city_id") == F.col("city_id"), "left")
    columns = ["venue_name", "address", "city_name"] if "address" in v.columns else ["venue_name", "city_name"]
    rows = v.where(any_column_matches(asked, columns) if asked else F.lit(False))
    prefix = F.when(F.startswith(F.lower("venue_name"), F.lit(asked.lower())), 0).otherwise(1)
    ranked = rows.withColumn("prefix", prefix).withColumn("score", F.round(similarity(F.col("venue_name"), F.lit(asked)), 6))
    return ranked.orderBy("prefix", F.desc("score"), "venue_name", "venue_id").limit(max(1, min(12, limit)))


#: Fixed values: (least, most) of the bands that users pick.
PRICE_BANDS = {"under-20": (None, 20.0), "under-40": (None, 40.0), "over-40": (40.0, None)}
CAPACITY_BANDS = {"intimate": (None, 200), "club": (201, 800), "large": (801, 5000), "festival": (5001, None)}


def from_bands(f: Filters, price: str = "all", capacity: str = "all") -> Filters:
    """``f`` with the bounds of a price and a capacity band."""
    low, high = PRICE_BANDS.get(price, (None, None))
    least, most = CAPACITY_BANDS.get(capacity, (None, None))
    return replace(f, free_only=price == "free", priced_only=price not in ("all", "free"), price_min=low, price_max=high, capacity_min=least, capacity_max=most, capacity_unknown=capacity == "unknown")


def any_column_matches(query: str, columns: list[str]) -> Column:
    """The query, in any case, as a part of one of the columns; nulls are empty."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.strip().lower()))
    return test
