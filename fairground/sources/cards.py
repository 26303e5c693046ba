"""Event cards: one event from the visible text of a detail page, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, html_text, let, normal_key, normal_text, url_joined

#: Labels before a card's values, by language.
DATE_LABELS = ("Date", "Datum", "Data", "Fecha", "Dato", "Päivämäärä", "Dátum", "Tarih", "Tanggal", "Ngày", "Дата", "التاريخ", "תאריך", "Ημερομηνία", "日付", "날짜", "日期")
HOUR_LABELS = ("Horaires", "Horaire", "Hours", "Hour", "Time", "Uhrzeit", "Orario", "Horario")
PRICE_LABELS = ("Tarifs", "Tarif", "Prices", "Price", "Preise", "Preis", "Prezzi", "Prezzo", "Precios", "Precio")
VENUE_LABELS = ("Venue", "Location", "Lieu", "Ort", "Luogo", "Lugar", "Local")
ORGANIZER_LABELS = ("Organizer", "Organiser", "Organisateur", "Veranstalter", "Organizzatore", "Organizador", "Organisation")
#: Names of the months in English, French, German, Italian and Spanish, without accents.
MONTHS = {
    1: ("january", "janvier", "januar", "gennaio", "enero"), 2: ("february", "fevrier", "februar", "febbraio", "febrero"), 3: ("march", "mars", "marz", "marzo"), 4: ("april", "avril", "aprile", "abril"),
    5: ("may", "mai", "maggio", "mayo"), 6: ("june", "juin", "juni", "giugno", "junio"), 7: ("july", "juillet", "juli", "luglio", "julio"), 8: ("august", "aout", "agosto"),
    9: ("september", "septembre", "settembre", "septiembre"), 10: ("october", "octobre", "oktober", "ottobre", "octubre"), 11: ("november", "novembre", "noviembre"), 12: ("december", "decembre", "dezember", "dicembre", "diciembre"),
}
#: Entrance that costs nothing, and words that say for whom; what a link to tickets is called.
FREE = "entree gratuite|free entry|admission free|eintritt frei|ingresso gratuito|entrada gratuita"
FOR_SOME = "membre|member|mitglied|socio"
TICKETS = "ticket|billet|billetterie|reserver|reservation|booking|buy tickets"

CONTEXT = ("timezone", "city", "country_code", "category")


def first_of(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def attribute(tag: Column, name: str) -> Column:
    """An attribute's text in the text of a tag, however it is quoted; empty if there is none."""
    part = lambda t, i: F.regexp_extract(t, rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", i)
    return let(tag, lambda t: F.concat(part(t, 1), part(t, 2), part(t, 3)))


def first_tag(html: Column, tag: str, css_class: str | None = None) -> Column:
    """What stands in the first such tag."""
    of_class = rf"""(?=[^>]*\bclass\s*=\s*["'][^"']*\b{css_class}\b[^"']*["'])""" if css_class else ""
    return F.regexp_extract(html, rf"(?is)<{tag}\b{of_class}[^>]*>(.*?)</{tag}>", 1)


def cleaned(**raw: Column) -> Column:
    """struct of the visible text of each; the expression that cleans stands in the plan once."""
    texts = F.transform(F.array(*raw.values()), lambda t: html_text(t))
    return let(texts, lambda t: F.struct(*[F.get(t, F.lit(i)).alias(k) for i, k in enumerate(raw)]))


def word_date(value: Column) -> Column:
    """The date of a visible text such as "samedi 12 juillet 2026" or "July 12th 2026"; null if there is none, or none on the calendar.

    A date with its day first goes before one with its month first; years are 2000 to 2100. Dates
    of digits alone are none: their separators are blanks once the text is normalised.
    """
    names = "|".join(name for found in MONTHS.values() for name in found)
    forms = ((rf"\b(\d{{1,2}})(?:er|st|nd|rd|th)? ({names}) (\d{{4}})\b", 1, 2), (rf"\b({names}) (\d{{1,2}})(?:st|nd|rd|th)? (\d{{4}})\b", 2, 1))
    number = F.create_map(*[F.lit(x) for n, found in MONTHS.items() for name in found for x in (name, n)])

    def date(text: Column, pattern: str, day: int, month: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        year = part(3).try_cast("int")
        at = F.try_make_timestamp(year, F.try_element_at(number, part(month)), part(day).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.when(text.rlike(pattern), F.struct(F.when(year.between(2000, 2100), at).alias("at")))

    return let(normal_key(value), lambda text: F.coalesce(*[date(text, *form) for form in forms]))["at"]


def clocks(value: Column) -> Column:
    """Up to two times of a text (array of struct(hour, minute)): 19h30, 19:30, 19.30, 19 h."""
    pattern = F.lit(r"(?i)(?:^|[^\d])([01]?\d|2[0-3])\s*(?:h|:|\.)\s*([0-5]\d)?")
    both = F.arrays_zip(F.regexp_extract_all(value, pattern, 1).alias("h"), F.regexp_extract_all(value, pattern, 2).alias("m"))
    return F.slice(F.transform(both, lambda c: F.struct(c["h"].cast("int").alias("hour"), F.coalesce(c["m"].try_cast("int"), F.lit(0)).alias("minute"))), 1, 2)


def local_time(day: Column, clock: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(clock["hour"]), F.lit(":"), two(clock["minute"]), F.lit(":00"))


def amounts(value: Column) -> Column:
    """Amounts with a currency or a dash after them, 100,000 at most."""
    pattern = F.lit(r"(?i)\b(\d{1,5})(?:[.,](\d{1,2}))?\s*(?:chf|eur|€|\.-|,-)")
    both = F.arrays_zip(F.regexp_extract_all(value, pattern, 1).alias("w"), F.regexp_extract_all(value, pattern, 2).alias("f"))
    return F.filter(F.transform(both, lambda p: F.concat(p["w"], F.lit("."), F.coalesce(first_of(p["f"]), F.lit("0"))).cast("double")), lambda v: v <= 100_000)


def labelled(html: Column) -> Column:
    """What stands behind known labels: struct(l1, v1: of bold labels; l2, v2: of definition lists and tables), labels in lower case."""
    names = "|".join((*DATE_LABELS, *HOUR_LABELS, *PRICE_LABELS, *VENUE_LABELS, *ORGANIZER_LABELS))
    bold = rf"(?isu)<strong\b[^>]*>{BLANK}*({names}){BLANK}*</strong>{BLANK}*(?::|&nbsp;|&#160;)*{BLANK}*([^<]{{1,240}})"
    listed = rf"(?isu)<(?:dt|th)\b[^>]*>{BLANK}*({names}){BLANK}*</(?:dt|th)>{BLANK}*<(?:dd|td)\b[^>]*>(?=(.*?)</(?:dd|td)>)"
    found = [F.regexp_extract_all(html, F.lit(p), i) for p in (bold, listed) for i in (1, 2)]
    lower = lambda a: F.transform(a, F.lower)
    return F.struct(lower(found[0]).alias("l1"), found[1].alias("v1"), lower(found[2]).alias("l2"), found[3].alias("v2"))


def value_of(found: Column, labels: tuple[str, ...]) -> Column:
    """The value behind the first of ``labels`` that has one, bold before listed; empty if there is none."""
    at = lambda names, values, label: F.get(found[values], F.nullif(F.array_position(found[names], label), F.lit(0)).cast("int") - 1)
    every = [v for label in labels for v in (at("l1", "v1", label.lower()), F.nullif(at("l2", "v2", label.lower()), F.lit("")))]
    return F.coalesce(*every, F.lit(""))


def meta(metas: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose ``key`` is ``value`` (normalised)."""
    return F.get(F.filter(metas, lambda m: m[key] == value), F.lit(0))["content"]


def event_cards(pages: DataFrame) -> DataFrame:
    """The event of each detail page (page_id, url, html) that has a title and a full date, in one row.

    What the source knows is taken from the columns ``CONTEXT``, null where they are missing.
    Values are read inside the first article, if there is one. An end before its start, or at
    it, is on the next day. Pages with null html have no event.
    """
    known = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in CONTEXT]
    read = pages.select("page_id", "url", "html", *known).withColumn("article", F.coalesce(first_of(F.regexp_extract("html", r"(?is)<article\b.*?</article>", 0)), F.col("html")))
    article, found = F.col("article"), F.col("found")
    opening, lang = F.regexp_extract(article, r"(?i)<article\b[^>]*>", 0), F.regexp_extract("html", r"(?i)<html\b[^>]*>", 0)
    canonical = F.regexp_extract("html", r"""(?i)<link\b[^>]*\brel\s*=\s*["']canonical["'][^>]*>""", 0)
    lazy, image = (F.regexp_extract(article, rf"""(?i)<img\b[^>]*{p}\s*=\s*["'][^"']+["'][^>]*>""", 0) for p in ("(?:data-src|src)", r"\bsrc"))
    read = read.withColumn("found", labelled(article)).withColumn("opening", opening)
    read = read.withColumn(
        "c",
        cleaned(
            entry=first_tag(article, "h1", "entry-title"), heading=first_tag(article, "h1"), date=value_of(found, DATE_LABELS), hours=value_of(found, HOUR_LABELS), tariffs=value_of(found, PRICE_LABELS), venue=value_of(found, VENUE_LABELS),
            organizer=value_of(found, ORGANIZER_LABELS), css=attribute(F.col("opening"), "class"), lang=attribute(lang, "lang"), canonical=attribute(canonical, "href"), lazy=attribute(lazy, "data-src"), image=attribute(image, "src"),
        ),
    )
    tag = lambda m: cleaned(property=attribute(m, "property"), name=attribute(m, "name"), content=attribute(m, "content"))
    metas = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<meta\b[^>]*>"), 0), tag)
    read = read.withColumn("metas", F.transform(metas, lambda m: F.struct(normal_key(m["property"]).alias("property"), normal_key(m["name"]).alias("name"), m["content"].alias("content"))))
    c, page_meta = F.col("c"), lambda *keys: [meta(F.col("metas"), k, v) for k, v in keys]
    title = first_of(F.left(c["entry"], F.lit(500)), F.left(c["heading"], F.lit(500)), *page_meta(("property", "og title")))
    # Exploded and not filtered: a filter would be pushed down, with all that it is made of, and evaluate that twice.
    head = F.filter(F.array(F.struct(title.alias("title"), word_date(c["date"]).alias("day"))), lambda h: h["title"].isNotNull() & h["day"].isNotNull())
    told = read.select("*", F.explode(head).alias("head")).select("*", "head.title", "head.day")
    told = told.select("*", clocks(c["hours"]).alias("times"), amounts(F.left(c["tariffs"], F.lit(240))).alias("amounts"), normal_key(c["tariffs"]).alias("said"))
    first, second = F.get("times", F.lit(0)), F.get("times", F.lit(1))
    over = (second["hour"] < first["hour"]) | ((second["hour"] == first["hour"]) & (second["minute"] <= first["minute"]))
    genres = F.transform(F.regexp_extract_all(c["css"], F.lit(r"(?i)(?:^|\s)genre-([a-z0-9-]+)"), 1), lambda g: F.replace(g, F.lit("-"), F.lit(" ")))
    anchor = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>")
    anchors = F.arrays_zip(F.regexp_extract_all("article", anchor, 0).alias("whole"), F.regexp_extract_all("article", anchor, 2).alias("label"))
    tickets = F.transform(F.filter(anchors, lambda a: normal_text(a["label"]).rlike(TICKETS)), lambda a: url_joined(html_text(attribute(a["whole"], "href")), F.col("url")))
    return told.select(
        "page_id",
        first_of(F.regexp_extract("opening", r"""(?i)\bid\s*=\s*["']post-(\d+)["']""", 1)).alias("external_id"),
        "title",
        first_of(*page_meta(("property", "og description"), ("name", "twitter description"), ("name", "description"))).alias("description"),
        F.coalesce(local_time(F.col("day"), first), F.date_format("day", "yyyy-MM-dd")).alias("start_date"),
        local_time(F.when(over, F.date_add("day", 1)).otherwise(F.col("day")), second).alias("end_date"),
        "timezone",
        F.when(first.isNotNull(), "exact").otherwise("date").alias("time_precision"),
        first.isNull().alias("all_day"),
        first_of(F.left(c["venue"], F.lit(240))).alias("venue_name"),
        "city", "country_code",
        first_of(F.left(c["organizer"], F.lit(240))).alias("organizer_name"),
        first_of(F.left(c["lang"], F.lit(2))).alias("language"),
        "category",
        F.filter(genres, lambda g: ~g.isin("music", "event", "evenement")).alias("genres"),
        F.array_min("amounts").alias("price_min"),
        F.array_max("amounts").alias("price_max"),
        F.when(F.col("country_code") == "CH", "CHF").alias("currency"),
        F.get(F.filter(tickets, lambda u: u.isNotNull()), F.lit(0)).alias("ticket_url"),
        first_of(*page_meta(("property", "og image"), ("name", "twitter image")), c["lazy"], c["image"]).alias("image_url"),
        (F.col("said").rlike(FREE) & ~F.col("said").rlike(FOR_SOME)).alias("is_free"),
        first_of(*page_meta(("property", "og url")), c["canonical"], F.col("url")).alias("source_url"),
    )
