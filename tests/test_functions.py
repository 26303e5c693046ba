import difflib
import math
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fairground.functions import geo, hashes, text, times
from fairground.functions.geo import Viewport


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_folding_and_keys(spark):
    r = one(spark, text.fold(lit("Straße ÉTÉ œuf")), text.alnum_key(lit("L'Été, à 20h!")), text.slugify(lit("--Ça va?  Été--"), 8), text.trimmed(lit("  "), 5), text.trimmed(lit(" abcdefg"), 3))
    assert tuple(r) == ("strasse ete oeuf", "letea20h", "ca-va-et", None, "abc")


@pytest.mark.parametrize(("raw", "clean"), [("N/A", None), (" null ", None), (None, None), ("Non renseigné", None), (" ok ", "ok"), ("", None)])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(lit(raw), 100))[0] == clean


@pytest.mark.parametrize(("raw", "fine"), [("https://a.b/c?d", True), ("HTTP://a.b", False), ("https://user@a.b/", False), ("ftp://a.b", False), ("https://a b", False), ("https://", False), (None, False)])
def test_clean_url(spark, raw, fine):
    assert (one(spark, text.clean_url(lit(raw)))[0] is not None) == fine


def test_validators(spark):
    r = one(spark, text.clean_email(lit("a@b.c")), text.clean_email(lit("a@b")), text.clean_phone(lit("+41 (0)22-1")), text.clean_phone(lit("call me")))
    assert tuple(r) == ("a@b.c", None, "+41 (0)22-1", None)


@pytest.mark.parametrize(("raw", "canonical"), [
    ("HTTPS://Ex.com/A/?utm_source=x&b=1#top", "https://ex.com/A/?b=1"), ("http://e.com/a?ref=1", "http://e.com/a"), ("http://e.com", "http://e.com/"), ("http://e.com/a?b=1&fbclid=2&c=3", "http://e.com/a?b=1&c=3"),
    ("https://e.com/?GBRAID=1&wbraid=2&source=3&sources=4", "https://e.com/?sources=4"), ("https://U@E.com:443/x", "https://U@e.com/x"), ("http://e.com:443/", "http://e.com:443/"), ("mailto:a@b.c", None), ("/path", None), (" ", None), (None, None),
])
def test_canonical_url(spark, raw, canonical):
    assert one(spark, text.canonical_url(lit(raw)))[0] == canonical


def test_similarities(spark):
    r = one(spark, text.similarity(lit("word"), lit("two words")), text.similarity(lit(""), lit("")), text.bigram_dice(lit("night"), lit("nacht")), text.bigram_dice(lit("aaaa"), lit("aa")), text.bigram_dice(lit("a"), lit("b")))
    assert r[0] == pytest.approx(4 / 11) and r[1] == 0 and r[2] == 0.25 and r[3] == pytest.approx(2 * 1 / 4) and r[4] == 0


def test_tags_excerpts_html(spark):
    r = one(spark, text.hashtags(lit("#Été and #b_1 #b_1 ##xy-z #q"), 3), text.excerpt(lit("<p>a</p>  b\n" * 60), 20), text.html_text(lit("<p>a&amp;lt; <script>x</script><b>b</b>&nbsp;c</p>")))
    assert r[0] == ["été", "b_1", "xy-z"] and len(r[1]) <= 20 and r[1].endswith("…") and r[2] == "a b c"


@pytest.mark.parametrize(
    "raw,plain",
    [("Łódź", "lodz"), ("Brașov", "brasov"), ("Plzeň", "plzen"), ("Győr", "gyor"), ("Rīga", "riga"), ("Þingvellir", "thingvellir"), ("İstanbul", "istanbul"), ("Đà Nẵng", "da nang"), ("Αθήνα", "αθηνα"), ("Straße Ærø Œuvre", "strasse aero oeuvre"), ("Орёл", "орел"), ("e\u0301te\u0301", "ete"), ("plain", "plain"), (None, None)],
)
def test_folding(spark, raw, plain):
    assert one(spark, text.fold(lit(raw).cast("string")))[0] == plain


@pytest.mark.parametrize(
    "raw,plain",
    [
        ("caf&#233; &#x1F3B5;&#X41;", "café 🎵A"), ("&amp;#233;&amp;lt;", "é<"), ("&#39;&apos;&quot;&#34;", "''\"\""), ("&#1114112;&#xD800;&#99999999999;", "&#1114112;&#xD800;&#99999999999;"),
        ("&nbsp;a&#160;\u00a0 b\u2003c&#10;&#9;d ", "a b c d"), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("<STYLE>p</STYLE><p\n>t</p >", "t"), ("", ""), (None, None),
    ],
)
def test_entities(spark, raw, plain):
    assert one(spark, text.html_text(lit(raw).cast("string")))[0] == plain


@pytest.mark.parametrize(
    "href,url",
    [
        ("b", "https://e.org/a/b"), ("/b?q#f", "https://e.org/b?q#f"), ("../x/./y", "https://e.org/x/y"), ("..", "https://e.org/"), ("../../..", "https://e.org/"), ("//H.com", "https://h.com/"), ("HTTP://H.com:80/A b", "http://h.com/A%20b"), ("?z=1", "https://e.org/a/i?z=1"),
        ("#top", "https://e.org/a/i?p=2#top"), ("", "https://e.org/a/i?p=2"), ("mailto:a@b.c", None), ("javascript:x()", None), ("x/", "https://e.org/a/x/"), ("x/..", "https://e.org/a/"), ("x/.", "https://e.org/a/x/"),
    ],
)
def test_urls_on_a_page(spark, href, url):
    assert one(spark, text.url_joined(lit(href), lit("https://E.org:443/a/i?p=2#s").cast("string")))[0] == url


def test_distance_and_jitter(spark):
    r = one(spark, geo.haversine_km(46.2, 6.15, 48.85, 2.35), geo.haversine_km(0, 0, 0, 180), geo.jitter(F.lit(5), 0, 0.012))
    assert r[0] == pytest.approx(411, abs=2) and r[1] == pytest.approx(math.pi * 6371) and abs(r[2]) <= 0.006


def test_viewports(spark):
    around = Viewport(170, -10, -170, 10)
    rows = spark.createDataFrame([(0.0, 175.0), (0.0, -175.0), (0.0, 0.0), (20.0, 175.0), (None, None)], "lat double, lon double")
    assert [r[0] for r in rows.select(around.holds(F.col("lat"), F.col("lon"))).collect()] == [True, True, False, False, None]
    assert not Viewport(10, 20, 5, 10).valid() and rows.where(Viewport(1, 5, 2, 5).holds(F.col("lat"), F.col("lon"))).count() == 0
    assert rows.where(Viewport(-180, -90, 180, 90).holds(F.col("lat"), F.col("lon"))).count() == 4
    assert around.contains(Viewport(172, -5, 179, 5)) and not around.contains(Viewport(-10, -5, 10, 5)) and Viewport(-180, -90, 180, 90).contains(around)
    box = Viewport(1.1, 2.2, 3.3, 4.4).snapped(6)
    assert box.contains(Viewport(1.1, 2.2, 3.3, 4.4)) and box.west % (360 / 64) == 0
    assert geo.wrap_longitude(190) == -170 and geo.grid_zoom(0.5) == 0 and geo.grid_zoom(7.6) == 6


def test_dates(spark):
    r = one(spark, *[times.parsed_date(lit(x)) for x in ("1998-02-03", "1998-02-03T04:05", "1998-02-03T04:05:06+02:00", "soon", "1998-13-01", None)])
    assert [x.at for x in r] == [datetime(1998, 2, 3), datetime(1998, 2, 3, 4, 5), datetime(1998, 2, 3, 2, 5, 6), None, None, None]
    assert [x.precision for x in r] == ["day", "local", "instant", None, None, None]


def test_ranges():
    at = datetime(2024, 5, 15, 20, 0)  # a Wednesday
    r = times.quick_range
    assert r("now", at) == (at, datetime(2024, 5, 15, 22)) and r("today", at) == (at, datetime(2024, 5, 16))
    assert r("tonight", at) == (at, datetime(2024, 5, 16, 6)) and r("tonight", datetime(2024, 5, 15, 7)) == (datetime(2024, 5, 15, 18), datetime(2024, 5, 16, 6))
    assert r("tonight", datetime(2024, 5, 15, 3)) == (datetime(2024, 5, 14, 18), datetime(2024, 5, 16, 6))
    assert r("tomorrow", at) == (datetime(2024, 5, 16), datetime(2024, 5, 17))
    assert [(y - x).days for x, y in (r(k, at) for k in ("week", "month", "year"))] == [7, 30, 365]
    with pytest.raises(ValueError):
        r("someday", at)


@pytest.mark.parametrize(("day", "friday"), [(13, 17), (14, 17), (15, 17), (16, 17), (17, 17), (18, 24), (19, 24)])
def test_weekend_is_that_of_the_next_friday(day, friday):
    """From Monday to Sunday; on Saturday and Sunday it is the next week's."""
    assert times.quick_range("weekend", datetime(2024, 5, day, 21)) == (datetime(2024, 5, friday, 18), datetime(2024, 5, friday + 2, 23, 59))


@pytest.mark.parametrize(("error", "daily", "weekly"), [
    ("direct_http_404", 24, 168), ("x direct_http_410 y", 24, 168), ("direct_http_4040", 0.5, 6), ("DIRECT_OFF_DOMAIN_URL", 24, 168), ("invalid peer certificate: expired", 24, 168),
    ("failed to lookup address information", 24, 168), ("direct_timeout", 2, 24), ("direct_http_429", 2, 24), ("direct_http_503", 2, 24), ("error sending request for url", 2, 24), ("other", 0.5, 6),
])
def test_retry_delays(spark, error, daily, weekly):
    r = one(spark, *[times.retry_minutes(F.lit(error), F.lit(w)) for w in (False, True, None)])
    assert tuple(r) == (daily * 60, weekly * 60, daily * 60)


def test_radius_by_population(spark):
    got = one(spark, *[geo.radius_for_population(F.lit(n).cast("long")) for n in (None, 0, 49_999, 50_000, 250_000, 1_000_000, 4_999_999, 5_000_000)])
    assert tuple(got) == (8, 8, 8, 10, 12, 15, 15, 18)


def test_json_limits(spark):
    from fairground.functions import documents

    texts = ["{}", '{"a": [1, {"b": "x, [{"}], "c": null}', "3", "[" * 21 + "]" * 21, "[" + ",".join("1" * 10_001) + "]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(documents.json_shape(F.col("t")).alias("s"), documents.within_limits(F.col("t")).alias("fine")).collect()
    assert [(r.s.depth, r.s.nodes) for r in got[:5]] == [(1, 1), (3, 6), (0, 1), (21, 21), (1, 10_002)]
    assert got[1].s.chars == 8 and [r.fine for r in got] == [True, True, True, False, False, False]


def test_backoff(spark):
    r = one(spark, *[times.backoff_seconds(F.lit(n)) for n in (0, 1, 2, 7, 40)])
    assert tuple(r) == (5, 5, 10, 300, 300)


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    words = ["", "a", "foobar", "Supplier#1", "été"]
    df = spark.createDataFrame([(w, "foo bar") for w in words], "w string, v string")
    got = df.select(hashes.fnv1a(F.col("w")), hashes.nfc(F.col("w")), hashes.block_ratio(F.col("w"), F.col("v"))).collect()
    assert [r[0] for r in got] == [fnv(w) for w in words]
    assert [r[2] for r in got] == [round(difflib.SequenceMatcher(None, w, "foo bar", autojunk=False).ratio(), 6) for w in words]
    assert one(spark, hashes.nfc(F.lit("e\u0301")))[0] == "\u00e9"


def test_nfc_is_that_of_unicode(spark):
    texts = ["", "plain", "e\u0301", "\u212b", "\u1112\u1161\u11ab", "q\u0307\u0323", "\ufb01", "\u0958", "\u65e5\u672c\U0001f600", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(hashes.nfc(F.col("t"))).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
