"""Rows from web pages, search results, robots files and geographic tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, slugify, url_host
from ..operators.scores import place_quality


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of each page's anchors, in order."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href\s*=\s*"([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


SEARCH_SCHEMA = "struct<results: array<struct<url: string, title: string, score: double>>>"


def ranked_domains(responses: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank, domain, url): first result of each domain, in order, ten at most.

    ``responses`` has query_id and ``body``, the JSON of a search.
    """
    rows = responses.select("query_id", F.posexplode(F.from_json("body", SEARCH_SCHEMA)["results"]).alias("position", "r")).select("query_id", "position", "r.url", url_host(F.col("r.url")).alias("domain")).where("domain <> ''")
    first = rows.groupBy("query_id", "domain").agg(F.min("position").alias("position"), F.min_by("url", "position").alias("url"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "domain", "url")


def robots_octets(x: Column) -> Column:
    """A robots path with other than ASCII characters percent-encoded, unreserved ones decoded, and hex digits in capitals."""
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    encoded = F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[^\x00-\x7f]"), 0)), x, lambda t, c: F.replace(t, c, escaped(c)))

    def plain(text: Column) -> Column:
        letter = lambda e: F.decode(F.unhex(F.substr(e, F.lit(2))), "ISO-8859-1")
        # One pass over the pieces, so that what a code stands for is not read as the start of another.
        pieces = F.regexp_extract_all(text, F.lit("(?s)%[0-9a-fA-F]{2}|[^%]+|%"), 0)
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9a-fA-F]{2}$"), F.when(letter(p).rlike("^[A-Za-z0-9._~-]$"), letter(p)).otherwise(F.upper(p))).otherwise(p)), "")

    return let(encoded, plain)


def robots_groups(files: DataFrame) -> DataFrame:
    """(domain, group, n, field, value) of the lines of robots files (domain, body) that belong to a group of agents.

    An agent line opens a group, or joins it if no rule or delay came between. What comes before
    the first group, unknown fields and agents without a name are passed over.
    """
    lines = files.select("domain", F.posexplode(F.split(F.regexp_replace("body", "^\ufeff", ""), r"\r?\n")).alias("n", "line"))
    clean = lines.select("domain", "n", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where(F.contains("line", F.lit(":")))
    parts = clean.select("domain", "n", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    parts = parts.where("field in ('allow', 'disallow', 'crawl-delay') or field = 'user-agent' and value <> ''")
    in_order = Window.partitionBy("domain").orderBy("n")
    opens = (F.col("field") == "user-agent") & ~F.coalesce(F.lag("field").over(in_order) == "user-agent", F.lit(False))
    return parts.withColumn("group", F.sum(F.when(opens, 1).otherwise(0)).over(in_order)).where("group > 0")


def robots_rules(files: DataFrame) -> DataFrame:
    """(domain, group, agent, allow, path) of robots files (domain, body); agents without rules have one row with null ``path``."""
    lines = robots_groups(files)
    agents = lines.where("field = 'user-agent'").select("domain", "group", F.lower("value").alias("agent")).distinct()
    rules = lines.where("field in ('allow', 'disallow') and value <> ''").select("domain", "group", (F.col("field") == "allow").alias("allow"), robots_octets(F.col("value")).alias("path"))
    return agents.join(rules, ["domain", "group"], "left").select("domain", "group", "agent", "allow", "path")


def robots_delays(files: DataFrame) -> DataFrame:
    """(domain, agent, delay_s): the last crawl delay of an agent's groups that is from 0 to a day."""
    lines = robots_groups(files)
    agents = lines.where("field = 'user-agent'").select("domain", "group", F.lower("value").alias("agent")).distinct()
    number = F.regexp_extract("value", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")
    delays = lines.where("field = 'crawl-delay'").withColumn("s", number).where("s between 0 and 86400").groupBy("domain", "group").agg(F.max_by("s", "n").alias("s"))
    return agents.join(delays, ["domain", "group"]).groupBy("domain", "agent").agg(F.max_by("s", "group").alias("delay_s"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(domain, url) of the sitemaps that robots files name, each once."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*([^#\r\n]*[^#\s])"), 1)
    return files.select("domain", F.explode(found).alias("url")).distinct()


def robots_verdicts(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url_id, domain, path) with ``allowed``: of all groups with the longest name that stands in ``agent``, the most specific rule wins, allow on ties.

    A rule's specificity is its octets without wildcards. Where no group fits, all is allowed.
    """
    fits = rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent"))).withColumn("weight", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")))
    best_agent = fits.groupBy("domain").agg(F.max("weight").alias("weight"))
    own = fits.join(best_agent, ["domain", "weight"]).where("path is not null").select("domain", "allow", F.col("path").alias("rule"))
    # A rule's * stands for anything, $ at its end for the end of the path.
    body = F.regexp_replace("rule", r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.\\+?^${}()|\[\]])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("(?s)^"), quoted, F.when(F.endswith("rule", F.lit("$")), r"\z").otherwise(""))
    octets = F.length(F.regexp_replace(F.regexp_replace(body, r"\*", ""), "%[0-9a-fA-F]{2}", "x"))
    hits = urls.withColumn("target", robots_octets(F.col("path"))).join(own.withColumn("pattern", pattern).withColumn("octets", octets), "domain").where(F.regexp(F.col("target"), F.col("pattern")))
    strongest = hits.groupBy("url_id").agg(F.max_by("allow", F.struct("octets", "allow")).alias("allow"))
    return urls.join(strongest, "url_id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


CITY_COLUMNS = "geonames_id long, name string, ascii_name string, alternate_names string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation string, dem string, timezone string, modified string"


def parse_countries(lines: DataFrame) -> DataFrame:
    """Countries of the lines (``value``) of a tab-separated file; lines that begin with # are comments, short ones are passed over."""
    cells = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 17)
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    languages = F.filter(F.split(cell(15), ","), lambda x: x != "")
    return cells.select(cell(0).alias("code"), cell(1).alias("iso3"), cell(4).alias("name"), cell(7).try_cast("bigint").alias("population"), cell(6).try_cast("double").alias("area"), languages.alias("languages"), cell(16).try_cast("bigint").alias("geonames_id"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return parse_countries(spark.read.text(path))


def unzipped_lines(archives: DataFrame) -> DataFrame:
    """The lines (``value``) of the text files in zip archives (``content``, binary), some thousand at a time."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as f:
                            rows = (line.rstrip(b"\r\n").decode() for line in f)
                            while part := list(islice(rows, 10_000)):
                                yield pd.DataFrame({"value": part})

    return archives.select("content").mapInPandas(lines, "value string")


def parse_cities(lines: DataFrame) -> DataFrame:
    """Populated places of the lines (``value``) of a tab-separated city file."""
    rows = lines.select(F.from_csv("value", F.lit(CITY_COLUMNS), {"sep": "\t", "quote": ""}).alias("r")).select("r.*")
    return rows.where("feature_class = 'P'").select("geonames_id", "name", "ascii_name", F.split("alternate_names", ",").alias("alternate_names"), "latitude", "longitude", "feature_code", "country_code", "admin1_code", "population", "timezone", (F.col("feature_code") == "PPLC").alias("is_capital"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """Cities of a tab-separated file, or of the files in a zip archive."""
    if path.endswith(".zip"):
        return parse_cities(unzipped_lines(spark.read.format("binaryFile").load(path)))
    return parse_cities(spark.read.text(path))


def map_feature_place(features: DataFrame) -> DataFrame:
    """Places of map features (id, type, lat, lon, center_lat, center_lon, tags: JSON object of texts).

    Those without a name, a type or a location are none. Empty tags count as absent.
    """
    tags = F.from_json("tags", "map<string,string>")
    tag = lambda k: F.nullif(F.trim(F.col("t")[k]), F.lit(""))
    first = lambda *keys: F.coalesce(*[tag(k) for k in keys])
    one_of = lambda k, *values: F.col("t")[k].isin(*values)
    kind, given = lambda a, b: F.struct(F.lit(a).alias("category"), b.alias("subcategory")), lambda k: F.col("t")[k]
    kinds = (
        F.when(given("leisure") == "skate_park", kind("sports-outdoors", F.lit("skate-park")))
        .when(one_of("leisure", "park", "garden", "nature_reserve"), kind("nature", given("leisure")))
        .when(tag("natural").isNotNull() | (given("waterway") == "waterfall"), kind("nature", F.coalesce(given("natural"), given("waterway"))))
        .when(one_of("tourism", "museum", "gallery"), kind("culture", given("tourism")))
        .when(tag("historic").isNotNull(), kind("culture", F.concat(F.lit("historic-"), given("historic"))))
        .when(one_of("amenity", "theatre", "cinema", "arts_centre", "library"), kind("culture", given("amenity")))
        .when(one_of("tourism", "zoo", "aquarium", "theme_park"), kind("family", given("tourism")))
        .when(one_of("leisure", "playground", "water_park"), kind("family", given("leisure")))
        .when(one_of("leisure", "sports_centre", "stadium", "pitch"), kind("sports-outdoors", given("leisure")))
        .when(given("amenity") == "marketplace", kind("food-drink", F.lit("market")))
        .when(given("amenity") == "place_of_worship", kind("culture", F.lit("religious-site")))
        .otherwise(kind("attraction", F.coalesce(given("tourism"), given("man_made"))))
    )
    street = F.nullif(F.concat_ws(" ", *[F.nullif(given(k), F.lit("")) for k in ("addr:housenumber", "addr:street", "addr:postcode", "addr:city")]), F.lit(""))
    lat, lon, key = F.coalesce("lat", "center_lat"), F.coalesce("lon", "center_lon"), F.col("id").cast("string")
    has = lambda *keys: first(*keys).isNotNull()
    quality = place_quality(has("website", "contact:website", "wikipedia", "wikidata"), has("opening_hours"), has("description", "description:fr", "description:en"), has("image", "wikimedia_commons"), has("addr:street", "addr:full"))
    rows = features.withColumn("t", tags).withColumn("name", first("name", "name:fr", "name:en", "official_name")).withColumn("kind", kinds)
    rows = rows.where(F.col("name").isNotNull() & F.col("type").isNotNull() & F.col("id").isNotNull() & lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    return rows.select(
        F.col("type").alias("source_type"), F.col("id").alias("source_id"), F.concat(F.lit("https://www.openstreetmap.org/"), "type", F.lit("/"), key).alias("source_url"), "name",
        F.concat(slugify(F.col("name"), 100), F.lit("-"), F.col("type"), F.lit("-"), key).alias("slug"), "kind.category", "kind.subcategory",
        first("description:fr", "description", "description:en").alias("description"), F.coalesce(first("addr:full"), street).alias("address"), first("website", "contact:website").alias("website"),
        first("phone", "contact:phone").alias("phone"), first("image").alias("image_url"), first("opening_hours").alias("opening_hours"), first("fee").alias("fee"), first("wheelchair").alias("wheelchair"),
        lat.alias("latitude"), lon.alias("longitude"), quality.alias("quality_score"), F.col("t").alias("tags"),
    )
