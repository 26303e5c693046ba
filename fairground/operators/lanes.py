"""Searches that are planned for each city, in one of its languages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import fnv1a
from ..functions.times import week_number

#: Families of the monthly searches, in the order in which they take turns.
FAMILIES = ("culture", "family", "outdoor", "music", "sports", "gastronomy", "learning", "wellness", "community", "business", "nightlife")

#: What is searched for by language and family; the day's label is "general".
PHRASES = {
    "fr": {"nightlife": "Agenda soirées {place} {day} {month} {year}", "family": "Agenda sorties en famille à {place} {month} {year}", "outdoor": "Activités de plein air à {place} {month} {year}", "culture": "Agenda culturel {place} {month} {year}", "general": "Agenda événements"},
    "en": {"nightlife": "Nightlife events {place} {month} {day} {year}", "family": "Family events {place} {month} {year}", "outdoor": "Outdoor activities {place} {month} {year}", "culture": "Cultural events {place} {month} {year}", "general": "Events calendar"},
    "de": {"nightlife": "Veranstaltungskalender Nachtleben {place} {day}. {month} {year}", "family": "Familienveranstaltungen {place} {month} {year}", "outdoor": "Outdoor-Aktivitäten {place} {month} {year}", "culture": "Kulturveranstaltungen {place} {month} {year}", "general": "Veranstaltungskalender"},
    "es": {"nightlife": "Agenda nocturna {place} {day} {month} {year}", "family": "Agenda familiar {place} {month} {year}", "outdoor": "Actividades al aire libre {place} {month} {year}", "culture": "Agenda cultural {place} {month} {year}", "general": "Agenda de eventos"},
    "it": {"nightlife": "Agenda serate {place} {day} {month} {year}", "family": "Eventi per famiglie {place} {month} {year}", "outdoor": "Attività all'aperto {place} {month} {year}", "culture": "Agenda culturale {place} {month} {year}", "general": "Calendario eventi"},
    "pt": {"nightlife": "Agenda noturna {place} {day} {month} {year}", "family": "Eventos para famílias {place} {month} {year}", "outdoor": "Atividades ao ar livre {place} {month} {year}", "culture": "Agenda cultural {place} {month} {year}", "general": "Agenda de eventos"},
    "nl": {"nightlife": "Uitgaansagenda {place} {day} {month} {year}", "family": "Familie-uitjes {place} {month} {year}", "outdoor": "Buitenactiviteiten {place} {month} {year}", "culture": "Culturele agenda {place} {month} {year}", "general": "Evenementenkalender"},
    "pl": {"nightlife": "Kalendarz imprez {place} {day} {month} {year}", "family": "Wydarzenia rodzinne {place} {month} {year}", "outdoor": "Atrakcje na świeżym powietrzu {place} {month} {year}", "culture": "Kalendarz kulturalny {place} {month} {year}", "general": "Kalendarz wydarzeń"},
    "ru": {"nightlife": "Афиша вечеринок {place} {day} {month} {year}", "family": "Семейные мероприятия {place} {month} {year}", "outdoor": "Активный отдых {place} {month} {year}", "culture": "Культурная афиша {place} {month} {year}", "general": "Афиша событий"},
    "tr": {"nightlife": "{place} gece hayatı etkinlikleri {day} {month} {year}", "family": "{place} aile etkinlikleri {month} {year}", "outdoor": "{place} açık hava etkinlikleri {month} {year}", "culture": "{place} kültür sanat etkinlikleri {month} {year}", "general": "Etkinlik takvimi"},
    "id": {"nightlife": "Agenda hiburan malam {place} {day} {month} {year}", "family": "Acara keluarga {place} {month} {year}", "outdoor": "Aktivitas luar ruangan {place} {month} {year}", "culture": "Agenda budaya {place} {month} {year}", "general": "Kalender acara"},
    "ar": {"nightlife": "فعاليات ليلية {place} {day} {month} {year}", "family": "فعاليات عائلية {place} {month} {year}", "outdoor": "أنشطة في الهواء الطلق {place} {month} {year}", "culture": "الأجندة الثقافية {place} {month} {year}", "general": "دليل الفعاليات"},
    "hi": {"nightlife": "{place} नाइटलाइफ कार्यक्रम {day} {month} {year}", "family": "{place} पारिवारिक कार्यक्रम {month} {year}", "outdoor": "{place} आउटडोर गतिविधियाँ {month} {year}", "culture": "{place} सांस्कृतिक कार्यक्रम {month} {year}", "general": "कार्यक्रम कैलेंडर"},
    "ja": {"nightlife": "{place} ナイトライフ イベント {year}年{month}{day}日", "family": "{place} 家族向けイベント {year}年{month}", "outdoor": "{place} アウトドア イベント {year}年{month}", "culture": "{place} 文化イベント {year}年{month}", "general": "イベントカレンダー"},
    "ko": {"nightlife": "{place} 나이트라이프 행사 {year}년 {month} {day}일", "family": "{place} 가족 행사 {year}년 {month}", "outdoor": "{place} 야외 활동 {year}년 {month}", "culture": "{place} 문화 행사 {year}년 {month}", "general": "이벤트 일정"},
    "zh": {"nightlife": "{place} 夜生活活动 {year}年{month}{day}日", "family": "{place} 亲子活动 {year}年{month}", "outdoor": "{place} 户外活动 {year}年{month}", "culture": "{place} 文化活动 {year}年{month}", "general": "活动日历"},
}

#: Labels of the families without a phrase; languages that lack them take English ones.
LABELS = {
    "en": {"music": "Live music and concerts", "sports": "Sports events", "gastronomy": "Food and drink events", "learning": "Classes workshops and conferences", "wellness": "Health and wellness events", "community": "Community and local events", "business": "Business and networking events", "festivals": "Festivals and annual events"},
    "fr": {"music": "Concerts et musique live", "sports": "Événements sportifs", "gastronomy": "Événements gastronomie et boissons", "learning": "Cours ateliers et conférences", "wellness": "Événements santé et bien-être", "community": "Manifestations locales et vie de quartier", "business": "Événements professionnels et réseautage", "festivals": "Festivals et événements annuels"},
    "de": {"music": "Konzerte und Live-Musik", "sports": "Sportveranstaltungen", "gastronomy": "Essen und Trinken Veranstaltungen", "learning": "Kurse Workshops und Konferenzen", "wellness": "Gesundheit und Wellness Veranstaltungen", "community": "Lokale und Gemeinschaftsveranstaltungen", "business": "Business und Networking Veranstaltungen", "festivals": "Festivals und jährliche Veranstaltungen"},
    "es": {"music": "Conciertos y música en vivo", "sports": "Eventos deportivos", "gastronomy": "Eventos de gastronomía y bebidas", "learning": "Cursos talleres y conferencias", "wellness": "Eventos de salud y bienestar", "community": "Eventos locales y comunitarios", "business": "Eventos profesionales y networking", "festivals": "Festivales y eventos anuales"},
    "it": {"music": "Concerti e musica dal vivo", "sports": "Eventi sportivi", "gastronomy": "Eventi enogastronomici", "learning": "Corsi laboratori e conferenze", "wellness": "Eventi salute e benessere", "community": "Eventi locali e di comunità", "business": "Eventi professionali e networking", "festivals": "Festival ed eventi annuali"},
    "pt": {"music": "Concertos e música ao vivo", "sports": "Eventos esportivos", "gastronomy": "Eventos de gastronomia e bebidas", "learning": "Cursos oficinas e conferências", "wellness": "Eventos de saúde e bem-estar", "community": "Eventos locais e comunitários", "business": "Eventos profissionais e networking", "festivals": "Festivais e eventos anuais"},
}


def phrase_rows() -> list[tuple[str, str, str]]:
    """(language, family, phrase) for each language and each family that is searched for."""
    rows = []
    for language, own in PHRASES.items():
        rows += [(language, "general", own["general"] + " {place} {day} {month} {year}")]
        for family in (*FAMILIES, "festivals"):
            label = LABELS.get(language, LABELS["en"]).get(family)
            when = "{place} {year}" if family == "festivals" else "{place} {month} {year}"
            rows.append((language, family, own.get(family) or f"{label} {when}"))
    return rows


def search_lanes(cities: DataFrame, day: date, days: int = 7, monthly: int = 8) -> DataFrame:
    """(city_id, locale, scope, family, query): each city's searches from ``day`` on.

    Daily searches for some days, the monthly families whose turn it is, and festivals of the
    year. The turn moves on by the city's hash and the week, and so does the city's language
    among ``locales``. ``cities``: city_id, city_name, country_name, locales. An unknown language
    is English; no locales are English, too.
    """
    when, place = F.lit(day), F.concat_ws(", ", "city_name", F.nullif("country_name", F.lit("")))
    week = week_number(when)
    locales = F.when(F.size("locales") > 0, F.col("locales")).otherwise(F.array(F.lit("en")))
    told = cities.select("city_id", place.alias("place"), F.element_at(locales, (F.pmod(fnv1a(F.col("city_name")) + week, F.size(locales)) + 1).cast("int")).alias("locale"))
    known = F.split_part("locale", F.lit("-"), F.lit(1))
    told = told.withColumn("language", F.when(known.isin(*PHRASES), known).otherwise("en")).withColumn("locale", F.when(known.isin(*PHRASES), F.col("locale")).otherwise("en"))

    names = F.array(*map(F.lit, FAMILIES))
    turn = fnv1a(F.col("place")) + week * 8
    in_turn = F.transform(F.sequence(F.lit(0), F.lit(monthly - 1)), lambda i: F.struct(F.lit("month").alias("scope"), F.element_at(names, (F.pmod(turn + i, len(FAMILIES)) + 1).cast("int")).alias("family"), when.alias("at")))
    each_day = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.struct(F.lit("day").alias("scope"), F.lit("general").alias("family"), F.date_add(when, i).alias("at")))
    once = F.array(F.struct(F.lit("year").alias("scope"), F.lit("festivals").alias("family"), when.alias("at")))
    lanes = told.withColumn("lane", F.explode(F.concat(each_day, in_turn, once))).select("city_id", "place", "locale", "language", "lane.*")
    phrases = cities.sparkSession.createDataFrame(phrase_rows(), "language string, family string, phrase string")
    months = F.lit(None).cast("string")
    for language in PHRASES:  # the month's name alone, as the language has it
        months = F.when(F.col("language") == language, F.to_csv(F.struct("at"), {"dateFormat": "LLLL", "locale": language, "quote": ""})).otherwise(months)
    worded = lanes.join(F.broadcast(phrases), ["language", "family"]).withColumn("month", months)
    query = F.col("phrase")
    for name, value in (("{place}", F.col("place")), ("{day}", F.dayofmonth("at").cast("string")), ("{month}", F.col("month")), ("{year}", F.year("at").cast("string"))):
        query = F.replace(query, F.lit(name), value)
    return worded.select("city_id", "locale", "scope", "family", query.alias("query"))
