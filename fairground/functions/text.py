"""Text cleaning, folding and similarity as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which stands in the plan once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _plain_letters() -> dict[str, str]:
    """Small Latin and Greek letters with marks, and the letter that Unicode builds each on."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and ("a" <= base <= "z" or "α" <= base <= "ω"):
            out[letter] = base
    return out


#: Letters that Unicode doesn't build on others, and those that become two.
UNMARKED = {"ł": "l", "đ": "d", "ø": "o", "ħ": "h", "ı": "i", "ŧ": "t", "ð": "d", "ſ": "s", "ŋ": "n", "ё": "е"}
DOUBLES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ĳ", "ij"), ("þ", "th"), ("ŉ", "'n"))
#: Letters that fold() replaces one by one; marks, which follow them, have no counterpart and go.
MARKS = "".join(map(chr, range(0x300, 0x370)))
_LETTERS = _plain_letters() | UNMARKED
ACCENTED, PLAIN = "".join(_LETTERS) + MARKS, "".join(_LETTERS.values())


def fold(x: Column) -> Column:
    """Lower case without accents, for Latin and Greek letters."""
    out = F.translate(F.lower(x), ACCENTED, PLAIN)
    for a, b in DOUBLES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_sql(x: str) -> str:
    """``fold`` in SQL."""
    out = f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"
    for a, b in DOUBLES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return out


def tokens(x: Column) -> Column:
    """Distinct folded words: runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def alnum_key(x: Column) -> Column:
    return F.regexp_replace(fold(x), "[^a-z0-9]+", "")


def slugify(x: Column, size: int = 100) -> Column:
    return F.left(F.btrim(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(size))


def trimmed(x: Column, size: int) -> Column:
    """Trimmed and cut; null if nothing is left."""
    return F.left(F.nullif(F.trim(x), F.lit("")), F.lit(size))


#: Texts that stand for "no value".
NULL_TOKENS = ("", "nan", "none", "null", "undefined", "unknown", "n/a", "na", "non renseigné", "not provided", "not available")


def clean_text(x: Column, size: int) -> Column:
    value = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(value).isin(*NULL_TOKENS) | F.lit(size <= 0), None).otherwise(F.left(value, F.lit(min(size, 20000))))


def clean_url(x: Column) -> Column:
    """An http(s) URL without blanks and without user names, else null."""
    value = clean_text(x, 2000)
    host = F.regexp_extract(value, "^https?://([^/?#]+)", 1)
    return F.when(value.rlike(r"(?i)^https?://\S+$") & (host != "") & ~F.contains(host, F.lit("@")), value)


def clean_email(x: Column) -> Column:
    value = clean_text(x, 320)
    return F.when(value.rlike(r"^[^\s@]+@[^\s@]+[.][^\s@]+$"), value)


def clean_phone(x: Column) -> Column:
    value = clean_text(x, 64)
    return F.when(value.rlike("^[+0-9(). /-]{3,64}$"), value)


def url_host(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(x, "^[a-zA-Z]+://([^/?#:]+)", 1)), "^www[.]", "")


#: Query parameters that only track, beside those that begin with utm_.
TRACKING = ("fbclid", "gclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "ref", "source")
ABSOLUTE = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def canonical_url(x: Column) -> Column:
    """An absolute http or https url without fragment and tracking parameters; null for others.

    Scheme and host are in lower case, a port that the scheme has anyway goes, an empty path is a slash.
    """
    part = lambda i: F.regexp_extract(F.trim(x), ABSOLUTE, i)
    scheme, path, query = F.lower(part(1)), part(3), part(4)
    host = F.concat(F.regexp_extract(part(2), "^(.*@)?", 0), F.lower(F.regexp_replace(part(2), "^.*@", "")))
    host = F.regexp_replace(host, F.when(scheme == "http", ":80$").otherwise(":443$"), F.lit(""))
    key = lambda q: F.lower(F.split_part(q, F.lit("="), F.lit(1)))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda q: ~F.startswith(key(q), F.lit("utm_")) & ~key(q).isin(*TRACKING)), "&")
    url = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme != "", url)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / all_)


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigrams of two texts, each bigram as often as it stands."""
    grams = lambda t: F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2))))
    x, y = grams(a), grams(b)
    times = lambda arr, g: F.size(F.filter(arr, lambda h: h == g))
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * shared / total)


def hashtags(x: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"#([\p{L}\p{N}_-]{2,40})"), 1), F.lower)), 1, most)


def excerpt(x: Column, size: int = 180) -> Column:
    """The text without tags, blanks joined, cut to ``size`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(max(1, size - 1)))), F.lit("…")))


#: Named entities and what they stand for, in the order in which they are decoded.
ENTITIES = (("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))
#: What counts as a blank: ASCII ones, and Unicode's separators.
BLANK = r"[\s\x{00A0}\x{FEFF}\p{Z}]"


def decoded(x: Column) -> Column:
    """Named entities, then decimal and hexadecimal ones, as characters; numbers that are none stay."""
    out = x
    for pattern, value in ENTITIES:
        out = F.regexp_replace(out, f"(?i){pattern}", value)
    number = lambda e: F.regexp_extract(e, "(?i)([0-9a-f]+);$", 1)
    code = lambda e: F.when(F.startswith(F.lower(e), F.lit("&#x")), F.conv(number(e), 16, 10)).otherwise(number(e)).cast("long")
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")

    def numbers(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#(?:[0-9]{1,10}|x[0-9a-f]{1,8});"), 0))
        pairs = F.filter(F.transform(found, lambda e: F.struct(e.alias("e"), code(e).alias("c"))), lambda p: (p["c"] <= 0x10FFFF) & ~p["c"].between(0xD800, 0xDFFF))
        return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["e"], letter(p["c"])))

    return let(out, numbers)


def html_text(x: Column, size: int | None = None) -> Column:
    """Visible text: entities are decoded, then scripts, styles and tags go, and blanks are joined."""
    out = F.regexp_replace(decoded(x), r"[\x00-\x1f\x7f]", " ")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(F.regexp_replace(out, f"{BLANK}+", " "), "^ | $", "")
    return out if size is None else F.left(out, F.lit(size))


def normal_text(x: Column) -> Column:
    """Visible text in lower case without accents; all but ASCII letters and digits are blanks."""
    plain = F.translate(F.lower(html_text(x, 6000)), ACCENTED, PLAIN)
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normal_key(x: Column) -> Column:
    """``normal_text`` of what is visible text already."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def url_joined(href: Column, base: Column) -> Column:
    """The http or https url that ``href`` names on the page ``base``; null if there is none.

    Scheme and host are in lower case, a port that the scheme has anyway goes, ``.`` and ``..``
    are resolved, blanks are escaped, and an empty path is a slash.
    """
    scheme, host = F.lower(F.regexp_extract(base, ABSOLUTE, 1)), F.regexp_extract(base, ABSOLUTE, 2)
    path, query = F.regexp_extract(base, ABSOLUTE, 3), F.regexp_extract(base, r"^[^#?]*(\?[^#]*)?", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.when(F.contains(path, F.lit("/")), "").otherwise("/"))
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    def whole(link: Column) -> Column:
        return (
            F.when(link.rlike("(?i)^https?://[^/?#]"), link)
            .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
            .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
            .when(F.startswith(link, F.lit("#")) | (link == ""), F.concat(origin, path, query, link))
            .otherwise(F.concat(origin, folder, link))
        )

    def tidy(url: Column) -> Column:
        own = lambda i: F.regexp_extract(url, r"(?is)^(https?)://([^/?#]+)([^?#]*)(.*)$", i)
        place = F.concat(F.regexp_extract(own(2), "^(.*@)?", 0), F.lower(F.regexp_replace(own(2), "^.*@", "")))
        place = F.regexp_replace(place, F.when(F.lower(own(1)) == "http", ":80$").otherwise(":443$"), F.lit(""))
        names = F.split(F.regexp_replace(own(3), "^/", ""), "/")
        dot = F.element_at(names, -1).isin(".", "..")
        clear = let(F.aggregate(names, F.array().cast("array<string>"), step), lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dot & (F.size(kept) > 0), "/").otherwise("")))
        return F.when((scheme != "") & (own(1) != ""), F.replace(F.concat(F.lower(own(1)), F.lit("://"), place, clear, own(4)), F.lit(" "), F.lit("%20")))

    return let(let(F.btrim(href, F.lit(" \t\n\r\f")), whole), tidy)


