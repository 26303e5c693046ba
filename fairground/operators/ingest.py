"""Raw candidates to clean events: validation, enrichment, score and the reason of a refusal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, clean_text, fold
from ..functions.times import parsed_date
from .scores import adjusted_quality, normal_status
from .taxonomy import category, event_quality, let

#: Aliases of genres, in order; the first eight genres found are kept.
GENRE_ALIASES = (
    ("afro house", "afro-house"),
    ("afrohouse", "afro-house"),
    ("techno", "techno"),
    ("house", "house"),
    ("electro", "electro"),
    ("edm", "electro"),
    ("trance", "trance"),
    ("drum and bass", "drum-and-bass"),
    ("dnb", "drum-and-bass"),
    ("hip hop", "hip-hop"),
    ("hiphop", "hip-hop"),
    ("rap", "hip-hop"),
    ("r b", "r-and-b"),
    ("rnb", "r-and-b"),
    ("soul", "soul"),
    ("reggae", "reggae"),
    ("dancehall", "dancehall"),
    ("disco", "disco"),
    ("funk", "funk"),
    ("jazz", "jazz"),
    ("blues", "blues"),
    ("rock", "rock"),
    ("metal", "metal"),
    ("punk", "punk"),
    ("indie", "indie"),
    ("pop", "pop"),
    ("classical", "classical"),
    ("classique", "classical"),
    ("opera", "opera"),
    ("latin", "latin"),
    ("latino", "latin"),
    ("reggaeton", "reggaeton"),
    ("afrobeat", "afrobeat"),
    ("afro beat", "afrobeat"),
    ("world", "world"),
    ("experimental", "experimental"),
    ("ambient", "ambient"),
    ("gospel", "gospel"),
)
NAVIGATION = r"(?i)^(home|menu|login|cart|checkout|search|contact|about)$"


def alias_genres(text: Column, most: int = 8) -> Column:
    """Genres whose aliases stand as whole words in the folded text."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    found = let(words, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(f" {a} ")), g) for a, g in GENRE_ALIASES])))
    return F.slice(F.array_distinct(found), 1, most)


def spanish_pair(country: Column, lat: Column, lon: Column) -> Column:
    """struct(latitude, longitude, swapped, valid): in Spain, a pair given in the wrong order is turned."""
    known = lat.isNotNull() & lon.isNotNull()
    inside = lambda a, b: F.coalesce(known & ((a.between(35, 44.5) & b.between(-10, 5)) | (a.between(27, 30) & b.between(-19, -13))), F.lit(False))
    spain = F.upper(F.trim(F.coalesce(country, F.lit("")))) == "ES"
    anywhere = F.coalesce(known & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    right, turned = inside(lat, lon), inside(lon, lat)
    as_is = (spain & right) | (~spain & anywhere)
    swap = spain & ~right & turned
    return F.struct(F.when(as_is, lat).when(swap, lon).alias("latitude"), F.when(as_is, lon).when(swap, lat).alias("longitude"), swap.alias("swapped"), (as_is | swap).alias("valid"))


def normalise(candidates: DataFrame, asof: datetime) -> DataFrame:
    """Candidates with clean fields, ``quality`` and ``reason`` (null for those that are taken).

    Columns: id, title, start, end, venue, city, source_city, description, url, page_url, image, tickets, category,
    status, latitude, longitude, structured.
    """
    now = F.lit(asof).cast("timestamp_ntz")
    c = candidates.withColumns({"title": clean_text(F.col("title"), 240), "begin": parsed_date(F.col("start")), "finish": parsed_date(F.col("end"))["at"], "description": clean_text(F.col("description"), 12000)})
    all_day = F.col("begin.precision") == "day"
    finish = F.when(all_day, F.coalesce(F.col("finish"), F.col("begin.at")) + F.expr("interval 1 day")).otherwise(F.col("finish"))
    host = lambda u: F.regexp_extract(u, "^[a-zA-Z]+://([^/?#]+)", 1)
    c = c.withColumns({
        "finish": F.when(finish >= F.col("begin.at"), finish),
        "url": canonical_url(F.coalesce("url", "page_url")),
        "off_domain": host(F.coalesce("url", "page_url")) != host(F.col("page_url")),
        "other_city": F.col("city").isNotNull() & F.col("source_city").isNotNull() & (fold(F.col("city")) != fold(F.col("source_city"))),
        "located": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
    })
    kind = category(F.concat_ws(" ", "category", "title", "description"), F.lit(None).cast("string"))
    base = event_quality(F.col("finish"), F.col("venue"), F.col("city"), F.col("description"), F.col("image"), F.col("tickets"), kind, F.col("located"))
    quality = adjusted_quality(base, F.col("structured"), F.col("other_city"), F.col("off_domain"))
    start = F.col("begin.at")
    late = (start < now - F.expr("interval 2 days")) | (start > now + F.expr("interval 730 days"))
    reason = (
        F.when(F.length(F.coalesce("title", F.lit(""))) < 3, "invalid_title")
        .when(F.col("title").rlike(NAVIGATION), "navigation_or_commerce")
        .when(start.isNull(), "invalid_start_date")
        .when(late, "outside_ingestion_window")
        .when(F.col("quality") < 48, F.concat(F.lit("quality_below_threshold:"), F.col("quality").cast("string")))
    )
    scored = c.withColumn("quality", quality).withColumn("category_slug", kind)
    return scored.select("id", "title", start.alias("starts_at"), F.col("finish").alias("ends_at"), "url", "category_slug", normal_status(F.coalesce("status", F.lit(""))).alias("status"), "quality", reason.alias("reason"))


def expanded_filters(selections: DataFrame, taxonomy_rows: DataFrame) -> DataFrame:
    """(user, categories, values): a chosen category's event categories, and the values of its chosen children or its own.

    ``selections``: user, category, children. ``taxonomy_rows``: category, event_categories, defaults, child, child_values.
    """
    chosen = selections.join(taxonomy_rows, "category")
    by_category = chosen.groupBy("user", "category").agg(
        F.first("event_categories").alias("slugs"),
        F.first("defaults").alias("defaults"),
        F.flatten(F.collect_list(F.when(F.array_contains("children", F.col("child")), F.col("child_values")))).alias("own"),
    )
    values = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("defaults"))
    return by_category.groupBy("user").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("slugs")))).alias("categories"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias("values"))


def stale_translations(translations: DataFrame, before: DataFrame, after: DataFrame, watched: list[str]) -> DataFrame:
    """``translations`` with those of changed events marked stale: machine-made or reviewed ones only.

    An event has changed if a watched column differs between ``before`` and ``after`` (both by event_id).
    """
    old = before.select("event_id", F.struct(*watched).alias("old"))
    changed = after.select("event_id", F.struct(*watched).alias("new")).join(old, "event_id").where(~F.col("new").eqNullSafe(F.col("old"))).select("event_id", F.lit(True).alias("changed"))
    stale = F.col("changed") & F.col("translation_status").isin("machine", "reviewed")
    return translations.join(changed, "event_id", "left").withColumn("translation_status", F.when(stale, "stale").otherwise(F.col("translation_status"))).drop("changed")
