"""Normalisers, scores and lookups that ingestion applies to candidates."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .taxonomy import CURRENCIES, EURO


def normal_status(x: Column) -> Column:
    t = F.regexp_replace(fold(x), r"[^a-z0-9]+", "")
    return F.when(F.contains(t, F.lit("cancel")), "cancelled").when(F.contains(t, F.lit("postpon")) | F.contains(t, F.lit("report")), "postponed").when(F.contains(t, F.lit("soldout")) | F.contains(t, F.lit("complet")), "sold_out").otherwise("scheduled")


def currency(country: Column) -> Column:
    return F.coalesce(F.when(country.isin(*EURO), "EUR"), *[F.when(country == c, m) for c, m in CURRENCIES.items()])


#: The quoted title's marks and verb; an event; an event of a category; a place; what the page tells.
SENTENCES = {
    "fr": ("« ", " » est ", "un événement", "un événement de type {category}", " proposé à ", " Retrouvez ici les dates, horaires, tarifs et modalités de réservation disponibles."),
    "de": ("„", "“ ist ", "eine Veranstaltung", "eine Veranstaltung der Kategorie {category}", " in ", " Hier finden Sie die verfügbaren Angaben zu Datum, Uhrzeit, Preis und Reservierung."),
    "it": ("“", "” è ", "un evento", "un evento della categoria {category}", " a ", " Qui trovi le informazioni disponibili su date, orari, prezzi e prenotazioni."),
    "es": ("«", "» es ", "un evento", "un evento de la categoría {category}", " en ", " Consulta aquí la información disponible sobre fechas, horarios, precios y reservas."),
    "pt": ("“", "” é ", "um evento", "um evento da categoria {category}", " em ", " Consulte aqui as informações disponíveis sobre datas, horários, preços e reservas."),
    "en": ("“", "” is ", "an event", "an event in the {category} category", " at ", " View the available date, time, pricing and booking information here."),
}


def sentence(lang: Column, title: Column, category: Column, place: Column) -> Column:
    """A sentence in the language, or in English, that tells title, category and place; nulls are left out."""

    def say(k: str) -> Column:
        opened, verb, event, kind, at, more = SENTENCES[k]
        what = F.when(category.isNull(), event).otherwise(F.replace(F.lit(kind), F.lit("{category}"), category))
        where = F.when(place.isNull(), ".").otherwise(F.concat(F.lit(at), place, F.lit(".")))
        return F.concat(F.lit(opened), F.coalesce(title, F.lit("")), F.lit(verb), what, where, F.lit(more))

    out = say("en")
    for k in ("fr", "de", "it", "es", "pt"):
        out = F.when(lang == k, say(k)).otherwise(out)
    return out


def valid_zone(rows: DataFrame, zone: str, fallback: str) -> DataFrame:
    """``rows`` with ``valid_zone``: the zone if it is known, else the fallback if known, else UTC.

    Unknown zones make conversions fail, so they are told from the list of known ones first.
    """
    known = F.array(*map(F.lit, sorted(available_timezones())))
    fine = lambda c: F.when(F.array_contains(known, F.col(c)), F.col(c))
    distinct = rows.select(zone, fallback).distinct().withColumn("valid_zone", F.coalesce(fine(zone), fine(fallback), F.lit("UTC")))
    a, b = f"{zone}_", f"{fallback}_"
    keyed = distinct.select(F.col(zone).alias(a), F.col(fallback).alias(b), "valid_zone")
    return rows.join(keyed, F.col(zone).eqNullSafe(F.col(a)) & F.col(fallback).eqNullSafe(F.col(b))).drop(a, b)


def adjusted_quality(base: Column, structured: Column, other_city: Column, off_domain: Column) -> Column:
    total = base + F.when(structured, 3).otherwise(0) - F.when(other_city, 8).otherwise(0) - F.when(off_domain, 4).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def place_quality(site: Column, hours: Column, described: Column, pictured: Column, addressed: Column) -> Column:
    total = F.lit(55)
    for test, points in ((site, 15), (hours, 10), (described, 8), (pictured, 7), (addressed, 5)):
        total = total + F.when(test, points).otherwise(0)
    return F.least(F.lit(100), total)


def resolve_identity(asked: DataFrame, identities: DataFrame, kinds: list[str]) -> DataFrame:
    """``asked`` with the event of the first kind of identity that is known; of several, the first seen."""
    best = identities.groupBy("kind", "value").agg(F.min_by("event_id", F.struct("seen", "event_id")).alias("found"))
    for k in kinds:
        own = best.where(F.col("kind") == k).select(F.col("value").alias(k), F.col("found").alias(f"found_{k}"))
        asked = asked.join(own, k, "left")
    return asked.withColumn("event_id", F.coalesce(*[f"found_{k}" for k in kinds]))


#: Ends of local names, and addresses that aren't public.
LOCAL_NAMES = (".home", ".internal", ".invalid", ".lan", ".local", ".localhost", ".onion", ".test")
PRIVATE_V4 = r"^(0|10|127|22[4-9]|2[3-9][0-9])[.]|^100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^192[.]0[.][02][.]|^192[.]88[.]99[.]|^192[.]168[.]|^198[.]1[89][.]|^198[.]51[.]100[.]|^203[.]0[.]113[.]"
PRIVATE_V6 = r"^(::|::1|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)$"


def public_host(host: Column) -> Column:
    """Not a local name and not a private address; names need a dot, and IPv6 addresses brackets."""
    name = F.lower(F.coalesce(host, F.lit("")))
    local = (name == "") | (name == "localhost") | name.rlike("(" + "|".join(e.replace(".", "[.]") for e in LOCAL_NAMES) + ")$")
    octets = F.transform(F.split(name, "[.]"), lambda o: o.try_cast("int"))
    v4 = ~name.rlike(PRIVATE_V4) & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False)))
    inner = F.regexp_extract(name, r"^\[(.*)\]$", 1)
    v6 = ~inner.rlike(PRIVATE_V6) & inner.rlike("^[0-9a-f:]+$")
    plain = F.contains(name, F.lit(".")) & name.rlike("^[a-z0-9.-]+$") & ~F.contains(name, F.lit(".."))
    return ~local & F.when(name.rlike(r"^\[.*\]$"), v6).when(name.rlike(r"^[0-9]+([.][0-9]+){3}$"), v4).otherwise(plain)
