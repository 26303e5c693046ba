"""Genres, facets, categories, licences and scores, inferred from text by rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold

#: Genres and their patterns, in order of priority.
GENRES = (
    ("afro-house", "(afro[ -]?house)"),
    ("techno", "(^|[^a-z])techno([^a-z]|$)"),
    ("house", "(house music|musique house|deep house|tech house|progressive house|house dj|house set|house night)"),
    ("electro", "(electro|electronica|electronic music|musique electronique|musique électronique)"),
    ("trance", "(psytrance|goa trance|(^|[^a-z])trance([^a-z]|$))"),
    ("drum-and-bass", "(drum.?and.?bass|drum.?n.?bass|(^|[^a-z])dnb([^a-z]|$)|jungle music|jungle dnb)"),
    ("hip-hop", "(hip.?hop|(^|[^a-z])rap([^a-z]|$)|(^|[^a-z])trap([^a-z]|$))"),
    ("r-and-b", "(r&b|(^|[^a-z])rnb([^a-z]|$)|rhythm and blues)"),
    ("soul", "(^|[^a-z])soul([^a-z]|$)"),
    ("reggae", "(reggae|(^|[^a-z])dub([^a-z]|$)|(^|[^a-z])ska([^a-z]|$))"),
    ("dancehall", "dancehall"),
    ("disco", "(^|[^a-z])disco([^a-z]|$)"),
    ("funk", "(^|[^a-z])funk([^a-z]|$)"),
    ("jazz", "(^|[^a-z])jazz([^a-z]|$)"),
    ("blues", "(^|[^a-z])blues([^a-z]|$)"),
    ("rock", "(^|[^a-z])rock([^a-z]|$)"),
    ("metal", "(^|[^a-z])metal([^a-z]|$)"),
    ("punk", "(^|[^a-z])punk([^a-z]|$)"),
    ("indie", "(^|[^a-z])indie([^a-z]|$)"),
    ("pop", "(^|[^a-z])pop([^a-z]|$)"),
    ("classical", "(classique|classical|symphon|philharmon|orchestr|musique de chambre|quatuor|sonate)"),
    ("opera", "(^|[^a-z])(opera|opéra)([^a-z]|$)"),
    ("latin", "(latin|salsa|bachata|cumbia|merengue)"),
    ("reggaeton", "reggaeton"),
    ("afrobeat", "(afrobeat|afrobeats)"),
    ("world", "(world music|musiques? du monde)"),
    ("experimental", "(experimental music|musique expérimentale|experimental electronic)"),
    ("ambient", "(ambient music|ambient techno|ambient electronic|ambient set)"),
    ("gospel", "(^|[^a-z])gospel([^a-z]|$)"),
)

#: Facets of a category.
CATEGORY_FACETS = {
    "concerts": ("music",),
    "festivals": ("festival", "community"),
    "expositions": ("culture", "exhibitions"),
    "soirees": ("nightlife",),
    "theatre": ("culture", "theatre-shows"),
    "famille": ("family",),
    "sports-outdoor": ("sport",),
    "heritage": ("culture", "heritage-tours"),
    "gastronomy": ("food",),
    "activities": ("learning",),
    "conferences": ("learning", "conferences"),
    "cinema": ("culture", "cinema-screenings"),
    "leisure": ("leisure",),
    "other": ("other",),
}

#: Facets and their patterns, over folded text.
FACETS = (
    ("family", "famille|familial|family|children|kids|enfant|bambin|bambini|niñ|dzieci|kinder"),
    ("family-cinema", "cinema|movie|family film|film famille|kinderkino|cine familiar|film per famiglie"),
    ("amusement-parks", "amusement park|theme park|parc d attraction|fete foraine|funfair|lunapark|parque de atracciones"),
    ("parks-leisure", "(^|[^a-z])(parc|park|jardin|garden)([^a-z]|$)|aire de loisirs|recreation area"),
    ("family-events", "famille|familial|family|children|kids|enfant|bambin|bambini|niñ|dzieci|kinder"),
    ("water-play", "jeux d.?eau|water play|splash|aquapark|water park|piscine|pool|bad wodny"),
    ("zoo-aquarium", "zoo|aquarium|aquario|tierpark|zoolog"),
    ("kids-shows", "spectacle enfant|children.s show|kids show|teatro infantil|kindertheater|spettacolo per bambini"),
    ("family-workshops", "atelier famille|atelier creatif|family workshop|kids workshop|atelier enfant|laboratorio per bambini"),
    ("educational-activities", "educatif|educational|pedagog|apprendre|learning activity"),
    ("circus", "cirque|circus|circo|zirkus|cyrk"),
    ("farms-animals", "ferme|farm|animaux|animals|fattoria|granja|bauernhof"),
    ("playgrounds", "aire de jeux|playground|spielplatz|parco giochi|plac zabaw"),
    ("family-science", "science for kids|science enfant|planeta|observatoire|discovery centre"),
    ("museums", "musee|museum|museo|muzeum|galerie permanente"),
    ("historical-sites", "site historique|historic site|monument|chateau|castle|palais|palace|ruines|archaeolog"),
    ("art", "(^|[^a-z])art([^a-z]|$)|beaux.arts|fine art|art contemporain|contemporary art|arts visuels|visual arts|galerie d art"),
    ("exhibitions", "exposition|exhibition|mostra|ausstellung|wystawa|exposicion"),
    ("theatre-shows", "theatre|theater|teatro|spectacle|performance sceni|spektakl"),
    ("dance", "danse|dance|tanz|danza|taniec|ballet"),
    ("cinema-screenings", "cinema|screening|projection|movie|film festival|kino|cine"),
    ("literature", "litterature|literature|livre|book|lecture|reading|poesie|poetry|author"),
    ("architecture", "architecture|architect|urbanisme|urbanism|baukunst"),
    ("photography", "photograph|fotograf|photo exhibition|expo photo"),
    ("heritage-tours", "patrimoine|heritage|guided tour|visite guidee|stadtfuhrung|visita guidata"),
    ("opera-lyric", "opera|lyrique|lyric|operette|operetta"),
    ("football", "football|soccer|futsal|calcio|fussball|pilka nozna"),
    ("running", "running|course a pied|marathon|semi.marathon|trail run|jogging"),
    ("cycling", "cycling|cyclisme|velo|bike|bicycle|ciclismo|fahrrad"),
    ("hiking", "randonnee|hiking|trek|walk|balade|wanderung|senderismo"),
    ("water-sports", "surf|kayak|canoe|voile|sailing|paddle|natation|swimming|diving"),
    ("winter-sports", "ski|snowboard|raquette|winter sport|sports d hiver|patinage"),
    ("fitness", "fitness|gym|crossfit|workout|musculation"),
    ("yoga", "yoga|pilates"),
    ("racket-sports", "tennis|badminton|squash|padel|pickleball|table tennis"),
    ("combat-sports", "boxe|boxing|judo|karate|martial art|mma|wrestling|taekwondo"),
    ("motorsports", "motorsport|rally|racing|grand prix|automobile|motorcycle|moto"),
    ("team-sports", "basket|volley|handball|rugby|hockey|team sport"),
    ("golf", "golf"),
    ("nature-excursions", "nature|outdoor|plein air|forest|foret|mountain|montagne|lac|lake"),
    ("markets", "marche|market|mercato|markt|targ|feria gastronom"),
    ("gastronomy", "gastronom|culinaire|culinary|cuisine|restaurant|chef"),
    ("tastings", "degustation|tasting|verkostung|cata de|assaggio"),
    ("wine", "(^|[^a-z])(vin|wine|wein|vino)([^a-z]|$)|oenolog|winery|vignoble"),
    ("beer", "biere|beer|bier|cerveza|birra|brewery|brasserie"),
    ("brunch", "brunch"),
    ("cooking-workshops", "atelier cuisine|cooking class|cours de cuisine|laboratorio di cucina"),
    ("street-food", "street food|food truck"),
    ("food-festivals", "food festival|festival gourmand|fete gastronom|sagra"),
    ("coffee-tea", "(^|[^a-z])(coffee|cafe|tea)([^a-z]|$)|salon de the|degustation de the|ceremonie du the|barista|roastery"),
    ("workshops", "atelier|workshop|masterclass|laboratorio|warsztat"),
    ("conferences", "conference|congress|symposium|talk|lecture|colloque|convegno"),
    ("networking", "networking|meetup|business meeting|rencontre pro"),
    ("technology", r"technology|technologie|tech |digital|numerique|coding|developer|intelligence artificielle|\bai\b"),
    ("career", "career|carriere|emploi|job fair|recrutement|recruitment"),
    ("science", "science|scientific|scientifique|research|recherche"),
    ("languages", "language class|cours de langue|conversation club|linguist"),
    ("entrepreneurship", "entrepreneur|startup|start-up|founder|innovation"),
    ("crafts", "artisanat|craft|handmade|ceramique|pottery|couture"),
    ("board-games", "board game|jeu de societe|jeux de societe|planszow"),
    ("video-games", "video game|jeu video|gaming|esport|e-sport"),
    ("escape-games", "escape game|escape room"),
    ("bowling", "bowling"),
    ("comedy", "humour|comedy|stand.up|cabaret comique"),
    ("fairs", "foire|fair|funfair|fete foraine|salon grand public"),
    ("creative-hobbies", r"loisir creatif|creative hobby|do it yourself|\bdiy\b"),
    ("shopping", "shopping|boutique|fashion market|mode et createurs"),
    ("karaoke", "karaoke"),
    ("wellness", "bien.etre|wellness|relaxation|self.care|benessere|bienestar"),
    ("meditation", "meditation|mindfulness|pleine conscience"),
    ("spa", "(^|[^a-z])spa([^a-z]|$)|sauna|hammam|thermal"),
    ("mental-health", "mental health|sante mentale|psycholog|burn.out|stress"),
    ("holistic", "holistic|holistique|reiki|naturopath|sonotherapie"),
    ("dance-fitness", "zumba|dance fitness|fitness dance"),
    ("nature-retreats", "retreat|retraite nature|wellness weekend|sejour bien.etre"),
    ("music", "concert|live music|music festival|festival de musique|festival musical"),
    ("music-festivals", "music festival|festival de musique|festival musical"),
    ("cultural-festivals", "cultural festival|festival culturel|arts festival"),
    ("family-festivals", "family festival|festival famille|festival familial"),
    ("local-fairs", "fete locale|local fair|village festival|fete de village"),
    ("community-events", "community event|manifestation locale|quartier|neighbourhood|neighborhood"),
    ("charity", "charity|caritatif|solidarite|benefit|fundraiser|collecte"),
    ("traditions", "tradition|folklore|folk festival|carnaval|carnival"),
    ("civic-spiritual", "citoyen|civic|spiritual|spirituel|religious|religieux|messe|worship"),
    ("clubbing", "clubbing|nightclub|discotheque|dancefloor|club night"),
    ("dj-sets", "dj set|disc jockey|deejay"),
    ("bars-cocktails", "cocktail|bar night|bar crawl|mixology"),
    ("afterwork", "afterwork|after work"),
    ("rooftops", "rooftop|roof top|terrasse panoramique"),
    ("student-parties", "student party|soiree etudiante|university party|campus party"),
    ("lgbtq-nightlife", "lgbt|lgbtq|queer|pride party"),
    ("themed-parties", "themed party|soiree a theme|costume party|fancy dress"),
    ("boat-parties", "boat party|soiree bateau|party cruise"),
    ("late-night", "late night|afterparty|after party|jusqu.a l.aube"),
    ("pets", "(^|[^a-z])(pet|chien|dog|chat)([^a-z]|$)|cat show|animal de compagnie"),
    ("open-days", "portes ouvertes|open day|open house"),
    ("public-services", "information day|journee information|service public"),
)

#: Categories by the first pattern that matches.
CATEGORIES = (
    ("soirees", r"(^|[^a-z])(club|clubbing|rave|party|soiree|night|dj\s*set|afterwork|techno|house|disco)([^a-z]|$)"),
    ("festivals", r"(^|[^a-z])(festival|open[\s-]*air|festiwal)([^a-z]|$)"),
    ("concerts", r"(^|[^a-z])(concert|live\s*music|gig|konzert|concerto|concierto|orchestre|orchestra|recital)([^a-z]|$)"),
    ("theatre", r"(^|[^a-z])(theatre|theater|teatro|ballet|spectacle|opera|musical|stand[\s-]*up|comedy|comedie|humour)([^a-z]|$)"),
    ("expositions", r"(^|[^a-z])(expo|exhibition|vernissage|gallery|galerie|museum|musee|ausstellung|mostra|wystawa)([^a-z]|$)"),
    ("famille", r"(^|[^a-z])(famille|family|enfant|children|kids|jeune\s*public)([^a-z]|$)"),
)

#: Keywords of the categories that are told by points, in order of priority.
CATEGORY_KEYWORDS = {
    "soirees": ("nightclub", "night club", "club night", "clubbing", "rave", "party", "soiree", "fiesta", "afterwork", "boat party", "silent disco", "dj set", "discoteca", "boite de nuit", "klub nocny", "nachtclub"),
    "festivals": ("festival", "music festival", "festival de musique", "musikfestival", "open air festival", "festival open air", "festiwal"),
    "concerts": ("concert", "live music", "live show", "konzert", "concerto", "concierto", "gig", "orchestra", "orchestre", "recital"),
    "expositions": ("exhibition", "exposition", "vernissage", "gallery", "galerie", "museum", "musee", "ausstellung", "mostra", "wystawa", "art fair"),
    "theatre": ("theatre", "theater", "teatro", "teatr", "ballet", "dance performance", "spectacle", "opera", "musical", "stand up", "standup", "comedy", "comedie", "humour"),
    "famille": ("family", "famille", "children", "enfant", "kids", "jeune public"),
    "sports-outdoor": ("sports-outdoor", "sport", "sports", "outdoor activity", "outdoor activities", "plein air", "hiking", "randonnee", "trail", "running", "cycling", "bike", "yoga", "fitness", "ski", "swimming"),
    "heritage": ("heritage", "patrimoine", "guided tour", "visite guidee", "historic monument", "architecture tour", "walking tour"),
    "gastronomy": ("gastronomy", "gastronomie", "food market", "marche gourmand", "tasting", "degustation", "wine event", "culinary"),
    "activities": ("activities", "activity", "workshop", "atelier", "masterclass", "course", "creative class", "participatory"),
    "conferences": ("conferences", "conference", "talk", "lecture", "meetup", "seminar", "panel", "debate", "rencontre"),
    "cinema": ("cinema", "film", "movie", "screening", "projection"),
    "leisure": ("leisure", "loisir", "game", "gaming", "escape room", "quiz", "bowling", "arcade"),
    "other": (),
}

#: Licences; a restriction wins over all, then dedications, then attribution.
NON_COMMERCIAL = r"(non[\s_-]*commercial|no[\s_-]+commercial[\s_-]+use|by[\s_-]*nc|(^|[^a-z0-9])nc([^a-z0-9]|$))"
DEDICATED = r"(cc[\s_-]*0|creative[\s_-]+commons[\s_-]+zero|public[\s_-]+domain|creativecommons[.]org/publicdomain)"
ATTRIBUTED = r"(cc[\s_-]*by|creative[\s_-]+commons[\s_-]+(attribution|by)|creativecommons[.]org/licenses/by(-sa)?/|licen[cs]e[\s_-]+ouverte|open[\s_-]+licen[cs]e|(^|[^a-z0-9])odbl([^a-z0-9]|$))"

#: Money of a country; others have none.
EURO = ("AD", "AT", "BE", "CY", "DE", "EE", "ES", "FI", "FR", "GR", "HR", "IE", "IT", "LT", "LU", "LV", "MC", "ME", "MT", "NL", "PT", "SI", "SK", "SM", "VA", "XK")
CURRENCIES = {"CH": "CHF", "GB": "GBP", "US": "USD", "CA": "CAD", "AU": "AUD", "NZ": "NZD", "JP": "JPY", "PL": "PLN", "CZ": "CZK", "HU": "HUF", "SE": "SEK", "NO": "NOK", "DK": "DKK", "MX": "MXN", "KR": "KRW", "SG": "SGD", "AE": "AED", "ZA": "ZAR", "MA": "MAD"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


_WORD_OF = re.compile(r"\(\^\|\[\^a-z\]\)\(?([^()]*)\)?\(\[\^a-z\]\|\$\)")


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    if pattern.startswith("(") and pattern.endswith(")") and "(" not in pattern[1:-1]:
        pattern = pattern[1:-1]
    out, depth, part = [], 0, ""
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _needed(alternative: str) -> list[str]:
    """Literals of which a text that matches holds one at least; none if they can't be told."""
    if m := _WORD_OF.fullmatch(alternative):
        return [x for x in m[1].split("|") if x] if not re.search(r"[.?*+\\]", m[1]) else []
    if re.search(r"[()\[\]|*+^$]", alternative):
        return []
    pieces = re.split(r"\\b|.\?|\.", alternative.replace(".?", "."))
    longest = max(pieces, key=len)
    return [longest] if len(longest) > 1 else []


def holds(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``: literals are looked for as such, and other parts of the pattern only where a literal of theirs stands."""
    tests = []
    for alternative in _alternatives(pattern):
        if re.fullmatch(r"[^\\.^$*+?{}\[\]()|]+", alternative):
            tests.append(F.contains(text, F.lit(alternative)))
        else:
            needed = _needed(alternative)
            guard = reduce(or_, [F.contains(text, F.lit(x)) for x in needed]) if needed else F.lit(True)
            tests.append(guard & text.rlike(alternative))
    return reduce(or_, tests)


def rules_held(texts: pa.Array, rules: tuple[tuple[str, str], ...]) -> pa.Array:
    """For each text the names of the rules whose patterns it matches, in their order; none for null.

    All patterns are looked for at once, a tenth of them where one stands, and each of a tenth where one of these stands: a text is read once if
    it matches none, and not once for each pattern. Arrow's regular expressions are RE2's, as the SQL's are: their time is linear in the text.
    """
    held = np.zeros((len(texts), len(rules)), bool)

    def look(own: pa.Array, rows: np.ndarray, first: int, end: int) -> None:
        hit = pc.fill_null(pc.match_substring_regex(own, "|".join(f"(?:{p})" for _, p in rules[first:end])), False)
        rows = rows[hit.to_numpy(zero_copy_only=False)]
        if end - first == 1:
            held[rows, first] = True
        elif len(rows):
            own, step = own.filter(hit), -(-(end - first) // 10)
            for k in range(first, end, step):
                look(own, rows, k, min(k + step, end))

    look(texts, np.arange(len(texts)), 0, len(rules))
    names = pa.array([n for n, _ in rules], pa.string()).take(pa.array(np.nonzero(held)[1]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, held.sum(1).cumsum()).astype("int32")), names)


def _matches(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return rules_held(texts, rules)

    return found(text)


def genres(text: Column) -> Column:
    """Genres of a text in order of priority."""
    return _matches(F.lower(text), GENRES)


def facets(text: Column, category: Column, has_genres: Column) -> Column:
    """Sorted distinct facets: the category's own, music where there are genres, and what the text tells."""
    own = F.coalesce(*[F.when(category == c, F.array(*map(F.lit, v))) for c, v in CATEGORY_FACETS.items()], F.array().cast("array<string>"))
    own = F.when(has_genres, F.array_append(own, F.lit("music"))).otherwise(own)
    return F.array_sort(F.array_distinct(F.concat(own, _matches(fold(text), FACETS))))


def category(text: Column, default: Column) -> Column:
    """The first category whose pattern the folded text matches."""
    return F.coalesce(let(fold(text), lambda t: F.coalesce(*[F.when(t.rlike(p), c) for c, p in CATEGORIES])), default)


def weighted_category(title: Column, supplied: Column, text: Column, source: Column, least: int = 2) -> Column:
    """The category with most points, each keyword 3 in the title, 4 in what was supplied and 1 in the text; ties to the first.

    Under ``least`` points it is the supplied one, if that is a category's name, else the source's, else "other".
    """
    words = lambda c: F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))

    def best(t: Column) -> Column:
        found = []
        for i, (name, keywords) in enumerate(CATEGORY_KEYWORDS.items()):
            listed = F.array(*[F.lit(f" {k.replace('-', ' ')} ") for k in keywords]) if keywords else F.array().cast("array<string>")
            held = lambda c: F.size(F.filter(listed, lambda k: F.contains(c, k)))  # noqa: B023, E731
            found.append(F.struct((-(3 * held(t["title"]) + 4 * held(t["supplied"]) + held(t["text"]))).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("name")))
        return F.array_min(F.array(*found))

    texts = F.struct(words(title).alias("title"), words(supplied).alias("supplied"), words(text).alias("text"))
    slug = F.lower(F.trim(supplied))
    given = F.coalesce(F.when(slug.isin(*CATEGORY_KEYWORDS), slug), source, F.lit("other"))
    return let(let(texts, best), lambda b: F.when(b["minus"] <= -least, b["name"]).otherwise(given))


def reusable(licence: Column, attribution: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(licence, F.lit(""))))
    return F.when(value.rlike(NON_COMMERCIAL), False).when(value.rlike(DEDICATED), True).when(value.rlike(ATTRIBUTED), F.nullif(F.trim(attribution), F.lit("")).isNotNull()).otherwise(False)


def status_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("cancel"), "cancelled").when(t.rlike("postpon|reschedul"), "postponed").when(t.rlike("sold.?out"), "sold_out").otherwise("published")


def event_quality(end: Column, place: Column, city: Column, text: Column, image: Column, tickets: Column, category_: Column, located: Column) -> Column:
    """22 for title and 22 for start, and points for what else is there; 100 at most, 65 to be published."""
    parts = ((end.isNotNull(), 10), (place.isNotNull(), 12), (city.isNotNull(), 8), (F.length(F.coalesce(text, F.lit(""))) >= 40, 8), (image.isNotNull(), 6), (tickets.isNotNull(), 5), (category_.isNotNull(), 4), (located, 3))
    total = F.lit(44)
    for test, points in parts:
        total = total + F.when(test, points).otherwise(0)
    return F.least(total, F.lit(100))
