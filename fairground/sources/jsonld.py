"""Events from the JSON-LD of pages.

Spark cuts the blocks out of the pages. A small walker takes each block apart and gives every
event in it one regular shape, whatever shape its values have; all rules (texts, prices,
addresses, performers, accessibility, duplicates) are column expressions on that shape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, html_text, let, normal_key, url_joined
from .cards import CONTEXT, first_of

TEXTS = ("name", "description", "start", "end", "zone", "venue", "venue_link", "venue_id", "address", "street", "postal", "locality", "region", "country", "latitude", "longitude", "organizer", "organizer_link", "status", "language", "age", "id", "link")
#: Names of features, without blanks, for each kind of accessibility.
ACCESS = {
    "wheelchair": ("wheelchair", "wheelchairaccess", "wheelchairaccessible", "wheelchairaccessibility"),
    "hearingLoop": ("hearingloop", "inductionloop", "audioinductionloop"),
    "signLanguage": ("signlanguage", "signlanguageinterpretation", "signlanguageinterpreter"),
    "quietSpace": ("quietspace", "sensoryfriendly", "sensoryfriendlyspace"),
}
SHAPE = (
    "array<struct<" + ", ".join(f"{c}: string" for c in TEXTS) + ", categories: array<string>, images: array<string>, notes: array<string>, free: boolean, "
    "performers: array<struct<name: string, type: string, image: string, headliner: boolean>>, ages: array<struct<range: string, least: string, most: string>>, "
    "features: array<string>, " + ", ".join(f"{c}: boolean" for c in ACCESS) + ", offers: array<struct<prices: array<string>, currency: string, link: string>>>>"
)
_TAGS = re.compile("<[^>]*>")


def documents(block: str) -> list:
    """The JSON documents of a block: one, or, where that is broken, each that can be read within it, from the left."""
    text = re.sub("-->$", "", re.sub("^<!--", "", block.strip())).strip().removesuffix(";")

    def refused(name: str):
        raise ValueError(name)

    reader = json.JSONDecoder(parse_constant=refused)
    try:
        return [reader.decode(text)]
    except (ValueError, RecursionError):
        found, at = [], 0
        while m := re.compile(r"[{\[]").search(text, at):
            try:
                document, at = reader.raw_decode(text, m.start())
                found.append(document)
            except (ValueError, RecursionError):
                at = m.start() + 1
        return found


def nodes(document) -> Iterator[dict]:
    """Every object of a document, outer ones first, in order."""
    waiting = [document]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
            waiting += reversed(list(node.values()))
        elif isinstance(node, list):
            waiting += reversed(node)


def listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def given(row: dict, *keys: str):
    """The value of the first key that has one."""
    return next((row[k] for k in keys if row.get(k) is not None), None)


def first_text(value) -> str | None:
    """A value's first text with something visible in it: of lists the first item's, of objects their name's or what stands for it."""
    if isinstance(value, str):
        return value if _TAGS.sub("", value).strip() else None
    if isinstance(value, list):
        return next(filter(None, map(first_text, value)), None)
    return first_text(given(value, "name", "value", "url", "contentUrl", "@id")) if isinstance(value, dict) else None


def number(value) -> str | None:
    return value if isinstance(value, str) else None if value is None or isinstance(value, (bool, list, dict)) else repr(value)


def row_of(value) -> dict:
    return value if isinstance(value, dict) else {}


def true_or_false(value) -> bool | None:
    value = value.get("@value") if isinstance(value, dict) else value
    return value if isinstance(value, bool) else None


def offers_of(value) -> Iterator[dict]:
    for offer in filter(lambda o: isinstance(o, dict), listed(value)):
        yield {"prices": [number(offer.get(k)) for k in ("price", "lowPrice", "highPrice", "minPrice", "maxPrice")], "currency": number(offer.get("priceCurrency")), "link": first_text(offer.get("url"))}
        yield from offers_of(offer.get("offers"))


def features_of(node: dict, place: dict) -> Iterator[str]:
    for only_true, value in ((False, node.get("accessibilityFeature")), (False, place.get("accessibilityFeature")), (True, node.get("amenityFeature")), (True, place.get("amenityFeature"))):
        for item in listed(value):
            if isinstance(item, str):
                if not only_true:
                    yield item
            elif isinstance(item, dict):
                enabled, name = true_or_false(item.get("value")), given(item, "name", "valueReference")
                if enabled is not False and (enabled or not only_true) and isinstance(name, str):
                    yield name


def shaped(node: dict) -> dict:
    """An event's values in the one shape that ``SHAPE`` names."""
    place = node.get("location")
    place = next((p for p in place if isinstance(p, (dict, list))), None) if isinstance(place, list) else place
    place = place if isinstance(place, dict) else {"name": first_text(place)}
    address, geo, organizer = row_of(place.get("address")), row_of(place.get("geo")), row_of(node.get("organizer"))
    identifier = node.get("identifier")
    people = [(p, k == "headliner") for k in ("performer", "performers", "actor", "actors", "headliner") for p in listed(node.get(k))]
    ages = [a for a in listed(node.get("audience")) if isinstance(a, dict)]
    age = lambda v: number(v.get("value") if isinstance(v, dict) else v)
    image = lambda v: given(v, "contentUrl", "url", "@id", "thumbnailUrl") if isinstance(v, dict) else v
    explicit = {k: next(filter(lambda v: v is not None, (true_or_false(p.get(key)) for p in (place, node))), None) for k, key in zip(ACCESS, ("wheelchairAccessible", "hearingLoop", "signLanguage", "quietSpace"))}
    kinds = lambda v: next((t for t in listed(v) if isinstance(t, str) and t.strip()), None)
    return explicit | {
        "name": first_text(given(node, "name", "headline")), "description": first_text(node.get("description")), "start": first_text(node.get("startDate")), "end": first_text(node.get("endDate")), "zone": first_text(row_of(node.get("eventSchedule")).get("scheduleTimezone")),
        "venue": first_text(place.get("name")), "venue_link": first_text(given(place, "url", "sameAs")), "venue_id": first_text(place.get("@id")), "address": None if address else first_text(place.get("address")), "street": first_text(address.get("streetAddress")),
        "postal": first_text(address.get("postalCode")), "locality": first_text(address.get("addressLocality")), "region": first_text(address.get("addressRegion")), "country": first_text(address.get("addressCountry")), "latitude": number(geo.get("latitude")), "longitude": number(geo.get("longitude")),
        "organizer": first_text(node.get("organizer")), "organizer_link": first_text(given(organizer, "url", "@id")), "status": first_text(node.get("eventStatus")), "language": first_text(node.get("inLanguage")), "age": first_text(given(node, "typicalAgeRange", "ageRestriction")),
        "id": first_text(given(identifier, "value") or identifier) if isinstance(identifier, dict) else first_text(given(node, "identifier", "@id")), "link": first_text(given(node, "url", "@id")),
        "categories": [t for t in map(first_text, listed(given(node, "eventType", "category"))) if t], "images": [t for t in (first_text(image(v)) for v in listed(node.get("image"))) if t], "notes": [t for t in (first_text(node.get("accessibilitySummary")), first_text(place.get("accessibilitySummary"))) if t],
        "free": node.get("isAccessibleForFree") if isinstance(node.get("isAccessibleForFree"), bool) else None,
        "performers": [{"name": first_text(row_of(p).get("name") if isinstance(p, dict) else p), "type": kinds(row_of(p).get("@type")), "image": first_text(row_of(p).get("image")), "headliner": head or row_of(p).get("isHeadliner") is True} for p, head in people],
        "ages": [{"range": first_text(a.get("typicalAgeRange")), "least": age(a.get("suggestedMinAge")), "most": age(a.get("suggestedMaxAge"))} for a in ages],
        "features": list(features_of(node, place)), "offers": list(offers_of(node.get("offers"))),
    }


def is_event(node: dict) -> bool:
    return any(isinstance(k, str) and k.lower().endswith("event") for k in listed(node.get("@type")))


def shaped_events(blocks: Column) -> Column:
    """The events of JSON-LD blocks (array of texts) in document order, nested ones too, as ``SHAPE``."""

    @F.pandas_udf(SHAPE)
    def events(found: pd.Series) -> pd.Series:
        return pd.Series([[shaped(n) for b in (() if bs is None else bs) for d in documents(b) for n in nodes(d) if is_event(n)] for bs in found], dtype=object)

    return events(blocks)


def numeric(text: Column) -> Column:
    """The first number of a text; apostrophes between digits go, a comma is a point."""
    return F.replace(F.regexp_extract(F.replace(text, F.lit("'"), F.lit("")), r"-?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def _age(row: Column) -> Column:
    """An age range in words: as it is given, or from its bounds."""
    bound = lambda c: let(numeric(c), lambda n: F.when(n.between(0, 150), n))
    shown = lambda n: F.when(n == F.floor(n), n.cast("int").cast("string")).otherwise(F.round(n, 1).cast("string"))

    def of(b: Column) -> Column:
        low, high = b["low"], b["high"]
        both = F.when(low == high, shown(low)).when(low < high, F.concat(shown(low), F.lit("-"), shown(high)))
        return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(shown(low), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("<="), shown(high)))

    return F.coalesce(first_of(F.left(F.trim(row["range"]), F.lit(80))), let(F.struct(bound(row["least"]).alias("low"), bound(row["most"]).alias("high")), of))


def _performers(rows: Column, url: Column) -> Column:
    """Performers once for each normalised name, the first 100: first name, first known type and image, headliner if any says so."""
    kind = lambda t: F.left(first_of(F.regexp_extract(t, r"^[a-zA-Z][\w+.-]*:.*#([^#]+)$", 1), F.regexp_extract(t, r"^[a-zA-Z][\w+.-]*://[^/]+/(?:[^#]*/)?([^/#?]+)/*(?:[?#].*)?$", 1), F.trim(t)), F.lit(80))
    texts = F.transform(rows, lambda p: p.withField("name", html_text(p["name"])))
    clean = F.transform(texts, lambda p: F.struct(normal_key(p["name"]).alias("key"), p["name"].alias("name"), kind(p["type"]).alias("type"), canonical_url(url_joined(p["image"], url)).alias("image_url"), p["headliner"].alias("headliner")))

    def merged(named: Column) -> Column:
        def of(key: Column) -> Column:
            known = lambda own, c: F.get(F.filter(F.transform(own, lambda p: p[c]), lambda v: v.isNotNull()), F.lit(0)).alias(c)
            own = F.filter(named, lambda p: p["key"] == key)
            return let(own, lambda o: F.struct(known(o, "name"), known(o, "type"), known(o, "image_url"), F.exists(o, lambda p: p["headliner"]).alias("is_headliner")))

        return F.transform(F.slice(F.array_distinct(F.transform(named, lambda p: p["key"])), 1, 100), of)

    return let(F.filter(clean, lambda p: p["key"] != ""), merged)


def event_candidates(pages: DataFrame) -> DataFrame:
    """One row for each event in the JSON-LD of pages (page_id, url, html), in order of ``position``.

    Of events with the same id, start and normalised title, a page's first stays; those without a
    title are none. What the source knows is in the columns ``CONTEXT``, null where they are
    missing. Blocks that can't be read, and null html, have no events.
    """
    known = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in CONTEXT]
    script = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json[^"']*["'][^>]*>(.*?)</script>"""
    cut = pages.select("page_id", "url", *known, F.regexp_extract_all("html", F.lit(script), 1).alias("blocks")).where(F.col("html").rlike("(?i)ld\\+json"))
    told = cut.withColumn("events", shaped_events(F.col("blocks"))).drop("blocks")
    place = {c: i for i, c in enumerate(TEXTS)}
    clean = F.transform(F.filter("events", lambda e: e["name"].isNotNull()), lambda e: F.struct(e.alias("e"), F.transform(F.array(*[e[c] for c in TEXTS]), lambda t: first_of(F.left(html_text(t), F.lit(6000)))).alias("t")))
    of = lambda t, c: F.get(t, F.lit(place[c]))
    key = lambda c: F.concat_ws("|", F.coalesce(of(c["t"], "id"), F.lit("")), F.coalesce(of(c["t"], "start"), F.lit("")), normal_key(of(c["t"], "name")))
    keyed = told.withColumn("events", clean).withColumn("keys", F.transform("events", key))
    first = F.filter("events", lambda c, i: F.array_position(F.col("keys"), F.get(F.col("keys"), i)) == i + 1)
    rows = keyed.select("page_id", "url", *CONTEXT, F.posexplode(first).alias("position", "c")).select("*", "c.e", "c.t")

    e, text = F.col("e"), lambda c: of(F.col("t"), c)
    links = F.concat(F.array(text("venue_link"), F.when(text("venue_id").rlike("(?i)^https?://"), text("venue_id")), text("organizer_link"), text("link")), F.transform(e["offers"], lambda o: o["link"]), e["images"])
    rows = rows.withColumn("links", F.transform(links, lambda value: canonical_url(url_joined(value, F.col("url")))))
    link = lambda i: F.get("links", F.lit(i))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    prices = F.filter(F.flatten(F.transform(e["offers"], lambda o: F.transform(o["prices"], numeric))), lambda p: p >= 0)
    currencies = F.filter(F.transform(e["offers"], lambda o: F.upper(F.left(F.trim(o["currency"]), F.lit(3)))), lambda c: c.rlike("^[A-Z]{3}$"))
    names = F.transform(e["features"], lambda f: F.replace(normal_key(f), F.lit(" "), F.lit("")))
    rows = rows.withColumn("names", names)
    flags = {k: F.coalesce(e[k], F.when(F.arrays_overlap(F.col("names"), F.array(*map(F.lit, known_as))), True)) for k, known_as in ACCESS.items()}
    notes = first_of(F.left(F.array_join(F.array_distinct(F.filter(F.transform(e["notes"], lambda n: html_text(n, 1000)), lambda n: n != "")), " · "), F.lit(1000)))
    day = F.coalesce(text("start").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    n = F.size(e["offers"])
    rows = rows.select("*", prices.alias("prices"), notes.alias("notes"), F.coalesce(*flags.values()).alias("any_flag"))
    rows = rows.withColumn("genres", F.transform(e["categories"], lambda g: html_text(g))).withColumn("performers", _performers(e["performers"], F.col("url")))
    plain = {"external_id": "id", "title": "name", "description": "description", "start_date": "start", "end_date": "end", "venue_name": "venue", "postal_code": "postal", "region": "region", "country_code": "country", "organizer_name": "organizer", "status": "status", "language": "language"}
    lowest = F.array_min("prices")
    return rows.select(
        "page_id", "position", *[text(c).alias(name) for name, c in plain.items()], F.coalesce(text("zone"), "timezone").alias("timezone"), F.when(day, "date").otherwise("exact").alias("time_precision"), day.alias("all_day"),
        F.coalesce(link(0), link(1)).alias("venue_url"), F.coalesce(first_of(F.array_join(F.array_compact(F.array(text("street"), text("postal"), text("locality"))), ", ")), text("address")).alias("address"),
        F.coalesce(text("locality"), "city").alias("city"), numeric(e["latitude"]).alias("latitude"), numeric(e["longitude"]).alias("longitude"), link(2).alias("organizer_url"), F.get("genres", F.lit(0)).alias("category"), "genres", "performers",
        F.coalesce(F.left(text("age"), F.lit(80)), F.get(some(F.transform(e["ages"], _age)), F.lit(0))).alias("age_restriction"),
        F.when(F.col("any_flag").isNotNull() | F.col("notes").isNotNull(), F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()], F.col("notes").alias("notes"))).alias("accessibility"),
        lowest.alias("price_min"), F.array_max("prices").alias("price_max"), F.get(currencies, F.lit(0)).alias("currency"), F.get(some(F.slice("links", F.lit(5), n)), F.lit(0)).alias("ticket_url"),
        some(F.slice("links", n + 5, F.size("links"))).alias("image_urls"), F.coalesce(e["free"], lowest == 0, F.lit(False)).alias("is_free"), F.coalesce(link(3), "url").alias("source_url"),
    )
