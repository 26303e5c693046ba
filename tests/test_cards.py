"""Event cards and JSON-LD, by literal pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fairground.plans import catalog, catalog_work  # noqa: F401  (registers its queries)
from fairground.sources import cards, jsonld

PAGE = "page_id int, url string, html string, city string, country_code string, timezone string"


def read(spark, *htmls, url="https://Site.ch/agenda/x?a=1"):
    rows = [(i, url, h, "Genève", "CH", "Europe/Zurich") for i, h in enumerate(htmls)]
    return {r.page_id: r for r in cards.event_cards(spark.createDataFrame(rows, PAGE)).collect()}


@pytest.mark.parametrize(
    "text,date",
    [
        ("samedi 12 juillet 2026", "2026-07-12"), ("1er août 2026", "2026-08-01"), ("Samstag, 3. Januar 2027", "2027-01-03"), ("7. März 2026", "2026-03-07"), ("sabato 5 dicembre 2026", "2026-12-05"), ("9 enero 2026", "2026-01-09"),
        ("July 4th, 2026", "2026-07-04"), ("March 3 2026", "2026-03-03"), ("2nd May 2026", "2026-05-02"), ("9 de enero de 2026", None), ("31 juin 2026", None), ("29 février 2027", None), ("29 février 2028", "2028-02-29"),
        ("31 juin 2026 or July 4 2026", None), ("5 mai 1999", None), ("5 mai 2101", None), ("12.05.2026", None), ("2026-05-12", None), ("may be", None), ("", None), (None, None),
    ],
)
def test_word_dates(spark, text, date):
    got = spark.range(1).select(cards.word_date(F.lit(text).cast("string")).cast("string")).first()[0]
    assert got == date


@pytest.mark.parametrize(
    "text,times",
    [("19h30 - 23h", [(19, 30), (23, 0)]), ("20:00", [(20, 0)]), ("9.15 bis 10.45 und 11.00", [(9, 15), (10, 45)]), ("dès 21 h", [(21, 0)]), ("24h00", []), ("123h", []), ("7H5", [(7, 0)]), ("", [])],
)
def test_clocks(spark, text, times):
    assert [tuple(c) for c in spark.range(1).select(cards.clocks(F.lit(text))).first()[0]] == times


@pytest.mark.parametrize("text,found", [("20.- / 15.50 CHF", [20.0, 15.5]), ("12,5 € ou 8 EUR", [12.5, 8.0]), ("30", []), ("100001 chf 99999 chf", [99999.0]), ("5,- für Kinder", [5.0])])
def test_amounts(spark, text, found):
    assert spark.range(1).select(cards.amounts(F.lit(text))).first()[0] == found


FULL = """<!DOCTYPE html><HTML lang='fr-CH'><head><meta content="https://site.ch/e/1" property="og:url"><meta name=description content="Une  soir&eacute;e &#233;t&#xE9;">
<meta property='og:image' content='https://site.ch/i.jpg'></head><body><h1>Site</h1><a href="/tickets">Tickets</a>
<article id="post-77" class="event genre-hip-hop genre-music genre-jazz"><h1>Other</h1><h1 class="big entry-title x">Nuit &amp; <b>Jour</b></h1>
<p><strong> date </strong>&nbsp;: Samedi 12 juillet 2026</p><p><strong>Horaires</strong>: 22h00 - 03h30</p>
<dl><dt>Tarif</dt><dd>Entr&#233;e <b>gratuite</b></dd><dt>Lieu</dt> <dd>La <i>Salle</i></dd><th>Organisateur</th><td> Asso </td></dl>
<a href="javascript:x()">Billetterie</a><a href='../buy me'>R&eacute;server / Billets</a><img data-src="a.png" src="b.png"></article></body></HTML>"""


def test_full_card(spark):
    r = read(spark, FULL)[0].asDict()
    assert r == {
        "page_id": 0, "external_id": "77", "title": "Nuit & Jour", "description": "Une soir&eacute;e été", "start_date": "2026-07-12T22:00:00", "end_date": "2026-07-13T03:30:00", "timezone": "Europe/Zurich", "time_precision": "exact", "all_day": False,
        "venue_name": "La Salle", "city": "Genève", "country_code": "CH", "organizer_name": "Asso", "language": "fr", "category": None, "genres": ["hip hop", "jazz"], "price_min": None, "price_max": None, "currency": "CHF",
        "ticket_url": "https://site.ch/buy%20me", "image_url": "https://site.ch/i.jpg", "is_free": True, "source_url": "https://site.ch/e/1",
    }


@pytest.mark.parametrize(
    "label,date,hours,start,end",
    [
        ("Date", "July 12 2026", "<b>Time</b>", "2026-07-12", None), ("Datum", "12. Juli 2026", "<strong>Uhrzeit</strong>: 19.30", "2026-07-12T19:30:00", None), ("Data", "12 luglio 2026", "<strong>Orario</strong>: 19:30-23:00", "2026-07-12T19:30:00", "2026-07-12T23:00:00"),
        ("Fecha", "12 julio 2026", "<strong>Horario</strong>: 23:00 a 1:00", "2026-07-12T23:00:00", "2026-07-13T01:00:00"), ("Päivämäärä", "12 july 2026", "", "2026-07-12", None), ("ДАТА", "31 december 2026", "<strong>Hours</strong> 20h00 - 20h00", "2026-12-31T20:00:00", "2027-01-01T20:00:00"), ("日付", "12 july 2026", "", "2026-07-12", None),
    ],
)
def test_languages(spark, label, date, hours, start, end):
    r = read(spark, f"<article><h1>T</h1><table><tr><th>{label}</th><td>{date}</td></tr></table>{hours}</article>")[0]
    assert (r.start_date, r.end_date, r.all_day) == (start, end, "T" not in start)


def test_pages_without_events(spark):
    got = read(spark, None, "", "<h1>T</h1>", "<strong>Date</strong>: 12 mai 2026", "<h1></h1><strong>Date</strong>: 12 mai 2026", "<h1>T</h1><strong>Date</strong>: soon", '<meta property="og:title" content="M"><strong>Date</strong> 12 mai 2026', "<article><h1>A</h1></article><strong>Date</strong>: 12 mai 2026")
    assert {k: r.title for k, r in got.items()} == {6: "M"}


def test_fallbacks(spark):
    html = "<link href='https://c.org/x' rel='canonical'><article><h1>T</h1><strong>Datum</strong>: 1 mai 2026<strong>Date</strong>: 2 mai 2026<strong>Price</strong>: Free entry for members, else 12.- or 8,50 EUR<img src=\"b.png\"></article>"
    r = read(spark, html)[0]
    assert (r.start_date, r.source_url, r.image_url, r.is_free, r.price_min, r.price_max, r.external_id, r.genres, r.ticket_url) == ("2026-05-02", "https://c.org/x", "b.png", False, 8.5, 12.0, None, [], None)


def events(spark, *blocks, url="https://site.ch/a/b?x=1"):
    html = "".join(f'<SCRIPT type="application/ld+json">{b}</SCRIPT>' for b in blocks)
    return [r.asDict(recursive=True) for r in jsonld.event_candidates(spark.createDataFrame([(1, url, html, "Genève", "CH", "Europe/Zurich")], PAGE)).orderBy("position").collect()]


EVENT = """{"@context":"https://schema.org","@type":"MusicEvent","@id":"https://site.ch/e/9#it","name":"  Nuit &amp; <b>Jour</b> ","description":["","D&#233;tails"],"startDate":"2026-07-12T22:00:00+02:00","endDate":"2026-07-13","eventSchedule":{"scheduleTimezone":"Europe/Paris"},
"location":["ignored",{"@id":"https://v.ch/#place","name":"Salle","sameAs":null,"wheelchairAccessible":{"@value":true},"amenityFeature":[{"name":"Hearing loop","value":true},{"name":"Quiet space"}],"accessibilitySummary":"Rampe","address":{"streetAddress":"1 rue","postalCode":"1200","addressLocality":"Genf","addressRegion":"GE","addressCountry":{"name":"CH"}},"geo":{"latitude":46.2,"longitude":"6,15 E"}}],
"organizer":{"name":"Asso","url":"/org?utm_medium=x"},"eventStatus":"https://schema.org/EventScheduled","inLanguage":"fr","category":["Hip hop",{"name":"Jazz"}],"performer":[{"@type":"https://schema.org/MusicGroup","name":"Élan","image":{"url":"e.png"}},{"name":"elan","@type":"Person"},"Solo",{"x":1}],
"headliner":"solo","typicalAgeRange":"18+","offers":{"@type":"AggregateOffer","lowPrice":"10","highPrice":"1'200,50","priceCurrency":"chf ","offers":[{"price":-5,"url":"tickets"},{"price":0.5}]},"image":[{"contentUrl":"/i.jpg"},"https://c.org/j.jpg#f"],"accessibilityFeature":["sign language","none"],"accessibilitySummary":"Rampe"}"""


def test_full_json_ld(spark):
    (r,) = events(spark, EVENT)
    assert r == {
        "page_id": 1, "position": 0, "external_id": "https://site.ch/e/9#it", "title": "Nuit & Jour", "description": "Détails", "start_date": "2026-07-12T22:00:00+02:00", "end_date": "2026-07-13", "timezone": "Europe/Paris", "time_precision": "exact", "all_day": False,
        "venue_name": "Salle", "venue_url": "https://v.ch/", "address": "1 rue, 1200, Genf", "postal_code": "1200", "city": "Genf", "region": "GE", "country_code": "CH", "latitude": 46.2, "longitude": 6.15, "organizer_name": "Asso", "organizer_url": "https://site.ch/org",
        "status": "https://schema.org/EventScheduled", "language": "fr", "category": "Hip hop", "genres": ["Hip hop", "Jazz"],
        "performers": [{"name": "Élan", "type": "MusicGroup", "image_url": "https://site.ch/a/e.png", "is_headliner": False}, {"name": "Solo", "type": None, "image_url": None, "is_headliner": True}],
        "age_restriction": "18+", "accessibility": {"wheelchair": True, "hearingLoop": True, "signLanguage": True, "quietSpace": False, "notes": "Rampe"}, "price_min": 0.5, "price_max": 1200.5, "currency": "CHF", "ticket_url": "https://site.ch/a/tickets",
        "image_urls": ["https://site.ch/i.jpg", "https://c.org/j.jpg"], "is_free": False, "source_url": "https://site.ch/e/9",
    }


def test_small_json_ld(spark):
    (r,) = events(spark, '{"@type":"Event","headline":"T","startDate":"2026-01-02","location":"Salle","offers":{"price":"0"}}')
    assert (r["title"], r["venue_name"], r["city"], r["timezone"], r["all_day"], r["is_free"], r["performers"], r["accessibility"], r["source_url"], r["address"]) == ("T", "Salle", "Genève", "Europe/Zurich", True, True, [], None, "https://site.ch/a/b?x=1", None)


@pytest.mark.parametrize(
    "block,titles",
    [
        ('[{"@type":"Event","name":"A"},{"@type":"Event","name":"a!"},{"@type":"Event","name":"A","startDate":"2026-01-01"}]', ["A", "A"]), ('{"@graph":[{"x":[{"@type":["Thing","DanceEVENT"],"name":"A","subEvent":{"@type":"Event","name":"B"}}]}]}', ["A", "B"]),
        ('<!-- {"@type":"Event","name":"A"}; -->', ["A"]), ('{"@type":"Event","name":"A"}{"@type":"Event","name":"B"} tail', ["A", "B"]), ('{oops {"@type":"Event","name":"A"}', ["A"]), ('{"@type":"Event","name":NaN}', []), ("", []), ('{"@type":"Event"}', []), ('{"@type":"Place","name":"A"}', []),
        ('{"@type":"Event","name":"<br>"}', []), ("[" * 3000, []),
    ],
)
def test_blocks(spark, block, titles):
    assert [r["title"] for r in events(spark, block)] == titles


@pytest.mark.parametrize("audience,age", [('{"suggestedMinAge":16}', "16+"), ('{"suggestedMaxAge":"12"}', "<=12"), ('[{"suggestedMinAge":9,"suggestedMaxAge":3},{"suggestedMinAge":6.25,"suggestedMaxAge":12}]', "6.3-12"), ('{"suggestedMinAge":7,"suggestedMaxAge":7}', "7"), ('{"suggestedMinAge":200}', None), ('{"typicalAgeRange":"all"}', "all")])
def test_ages(spark, audience, age):
    assert events(spark, f'{{"@type":"Event","name":"A","audience":{audience}}}')[0]["age_restriction"] == age


def test_pages_without_json_ld(spark):
    pages = spark.createDataFrame([(1, "https://e.org/", None, None, None, None), (2, "https://e.org/", "<p>none</p>", None, None, None)], PAGE)
    assert jsonld.event_candidates(pages).count() == 0 and jsonld.event_candidates(pages.where("1 = 0")).count() == 0


def test_headings_of_the_query_have_the_entities_that_its_sql_leaves(spark, tmp_path):
    heads = ("a &quot;b&quot; &amp; c", "&copy; &#65; &amp;lt; &AMP;", "&amp;amp;#38; &amp;#x41; & <b>d</b>", "plain")
    rows = [(i + 1, f"http://x.example/{i}", f'<html lang="en"><body><article><h1>{h}</h1></article></body></html>') for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in catalog.QUERIES["op_s12_event_cards"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(catalog.ORACLE_SQL["op_s12_event_cards"]).fetchall()
    assert got == set(want) and len(got) == len(heads) and ("a \"b\" & c" not in {r[1] for r in got})
