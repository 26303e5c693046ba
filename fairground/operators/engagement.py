"""Campaigns, audiences, feeds and personal ranking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that tell a free or an evening event.
FREE_WORDS = r"(?i)\b(gratuit|gratuite|free|entrée libre|senza costo|gratis|bezpłatn)\b"
TONIGHT_WORDS = r"(?i)\b(ce soir|tonight|stasera|esta noche|сегодня вечером|dziś wieczorem)\b"

#: Why an event is proposed.
REASONS = {"genres": "Tes goûts : ", "category": "Une catégorie que tu apprécies", "search": ("Inspiré par ta recherche « ", " »"), "budget": "Dans ton budget", "verified": "Événement vérifié", "none": "Populaire près de toi"}

#: Campaigns that are sent to every executor, at most.
MAX_BROADCAST = 10_000


def eligible(profiles: DataFrame, campaigns: DataFrame, asof: datetime) -> DataFrame:
    """(user_id, campaign_id) of profiles that a campaign may address.

    A profile must fit a campaign by several open-ended tests, so this is no equi join. Campaigns
    are broadcast if they are counted to be at most MAX_BROADCAST; more of them are met by Spark's
    partitioned nested loop. Empty arrays and nulls don't restrict.
    """
    few = campaigns.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    today = F.lit(asof).cast("timestamp_ntz")
    age = F.year(today) - F.col("birth_year")
    open_array = lambda c: F.cardinality(F.col(c)) == 0
    tests = [
        F.col("consent"),
        (F.col("starts_on") <= today) & (F.col("ends_on").isNull() | (F.col("ends_on") >= today)),
        F.array_contains("placements", "feed"),
        open_array("city_ids") | F.array_contains("city_ids", F.col("city_id")),
        F.col("min_age").isNull() | (age >= F.col("min_age")),
        F.col("max_age").isNull() | (age <= F.col("max_age")),
        open_array("interests") | F.arrays_overlap("interests", "likes"),
    ]
    joined = profiles.crossJoin(F.broadcast(campaigns) if few else campaigns)
    for t in tests:
        joined = joined.where(t)
    return joined.select("user_id", "campaign_id")


def audience_estimate(members: DataFrame) -> DataFrame:
    """Audience of each campaign: under 20 is told as 0, else rounded to tens."""
    n = F.count_distinct("user_id")
    return members.groupBy("campaign_id").agg(F.when(n < 20, 0).otherwise((F.round(n / 10) * 10).cast("int")).alias("audience"))


def campaign_performance(deliveries: DataFrame) -> DataFrame:
    """Impressions, clicks, people reached and the click rate in per cent."""
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    out = deliveries.groupBy("campaign_id").agg(F.count_if(view).alias("impressions"), F.count_if(click).alias("clicks"), F.count_distinct(F.when(view, F.col("user_id"))).alias("reached"))
    return out.withColumn("ctr", F.when(F.col("impressions") == 0, 0.0).otherwise(F.round(F.lit(100.0) * F.col("clicks") / F.col("impressions"), 2)))


def daily_deliveries(deliveries: DataFrame) -> DataFrame:
    """One row for each campaign, user, kind, value class and day, as the delivery key has it: the first."""
    keys = ["campaign_id", "user_id", "event_type", "day"]
    first = deliveries.withColumn("day", F.to_date("ts")).groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    return first


def engagement(views: DataFrame, likes: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """views + 3 x likes + 4 x comments; each child is counted before the join, so none multiplies another."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = count(views, "views").join(count(likes, "likes"), key, "full").join(count(comments, "comments"), key, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(key, zero("views").alias("views"), zero("likes").alias("likes"), zero("comments").alias("comments"), (zero("views") + 3 * zero("likes") + 4 * zero("comments")).alias("score"))


def feed_score(age_hours: Column, likes: Column, comments: Column, saves: Column, text: Column, intent: str, has_event: Column, verified: Column, located: Column, event_free: Column | None = None, event_today: Column | None = None) -> Column:
    """Freshness, activity and what the reader looks for: a free or an evening event is told by the event itself or by the text."""
    told = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    fresh = F.greatest(F.lit(0.0), 36 - F.greatest(age_hours, F.lit(0.0))) / 6
    busy = F.log2(1.0 + likes * 2 + comments * 3 + saves * 2)
    boost = {"free": F.when(told(event_free) | text.rlike(FREE_WORDS), 14.0).otherwise(0.0), "nearby": F.when(located, 10.0).otherwise(0.0), "popular": busy * 2, "tonight": F.when(told(event_today) | text.rlike(TONIGHT_WORDS), 14.0).otherwise(0.0)}.get(intent, F.lit(0.0))
    return fresh + busy + boost + F.when(has_event, 2).otherwise(0) + F.when(verified, 1).otherwise(0)


def briefing(posts: DataFrame) -> DataFrame:
    """Posts, free ones (by their event or text), comments, and the commonest place and tag; ties go to the smaller value.

    Columns: text, event_free, comments, place, tags.
    """
    top = lambda rows, name: rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))
    free = F.coalesce("event_free", F.lit(False)) | F.coalesce(F.col("text").rlike(FREE_WORDS), F.lit(False))
    totals = posts.agg(F.count("*").alias("n_posts"), F.count_if(free).alias("n_free"), F.coalesce(F.sum("comments"), F.lit(0)).alias("n_comments"))
    places, tags = top(posts.select(F.col("place").alias("v")), "top_place"), top(posts.select(F.explode("tags").alias("v")), "top_tag")
    return totals.crossJoin(F.broadcast(places)).crossJoin(F.broadcast(tags))


def feed_page(posts: DataFrame, before: datetime, size: int) -> DataFrame:
    """Posts older than a cursor, newest first; one more than the page tells that others follow."""
    older = posts.where(F.col("at") < F.lit(before).cast("timestamp_ntz")).orderBy(F.desc("at"), F.desc("post_id")).limit(size + 1)
    return older


def followed(posts: DataFrame, authors: DataFrame, places: DataFrame) -> DataFrame:
    """Posts of followed authors or places: two semi joins, united without repeats."""
    return posts.join(authors, "author_id", "left_semi").unionByName(posts.join(places, "place", "left_semi")).distinct()


def personal_matches(profiles: DataFrame, favorites: DataFrame, searches: DataFrame, candidates: DataFrame, k: int = 8) -> DataFrame:
    """Each user's ``k`` best events among the next ones of the home city (of any, without one): user_id, event, score, reasons, place.

    min(99, 55 + 13 x liked genres + 16 for a liked category + 10 if the text holds one of the last 12
    searches). Genres and categories of up to 50 favourites are liked, too. Ties go to the earlier event.
    The next 24 events (3 x ``k``, if more) are taken for each city once, then users are joined to them.
    ``profiles``: user_id, genres, categories, home_city_id, preferred_price; ``favorites``: user_id, event_id, genres,
    category_slug; ``searches``: user_id, value, at; ``candidates``: occurrence_id, title, genres, category_slug, city_id, is_free, is_verified, starts_at.
    """
    numbered = lambda df, order, n: df.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("place") <= n)
    liked = numbered(favorites, ["event_id"], 50).groupBy("user_id").agg(F.flatten(F.collect_list("genres")).alias("more_genres"), F.collect_set("category_slug").alias("more_categories"))
    recent = numbered(searches, [F.desc("at"), "value"], 12).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("terms"))
    none = F.array().cast("array<string>")
    people = profiles.join(liked, "user_id", "left").join(recent, "user_id", "left").select(
        "user_id", "home_city_id", F.coalesce(F.col("preferred_price") == "free", F.lit(False)).alias("free_only"), F.coalesce("preferred_price", F.lit("")).alias("price"),
        F.array_union(F.coalesce("genres", none), F.coalesce("more_genres", none)).alias("likes"),
        F.array_union(F.coalesce("categories", none), F.coalesce("more_categories", none)).alias("kinds"), F.coalesce("terms", none).alias("terms"),
    )
    anywhere = candidates.withColumn("home", F.explode(F.array(F.col("city_id").cast("long"), F.lit(-1).cast("long")))).where("home is not null")
    both = anywhere.withColumn("free_only", F.explode(F.when(F.col("is_free"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    next_ = Window.partitionBy("home", "free_only").orderBy("starts_at", "occurrence_id")
    soon = both.withColumn("turn", F.row_number().over(next_)).where(F.col("turn") <= max(24, 3 * k))
    met = people.withColumn("home", F.coalesce(F.col("home_city_id").cast("long"), F.lit(-1).cast("long"))).join(soon, ["home", "free_only"])
    shared = F.filter("genres", lambda g: F.array_contains("likes", g))
    text = F.lower("title")
    term = F.get(F.filter("terms", lambda t: F.contains(text, t)), F.lit(0))
    kind = F.coalesce(F.array_contains("kinds", F.col("category_slug")), F.lit(False))
    scored = met.withColumns({"shared": shared, "term": term, "kind": kind})
    score = F.least(F.lit(99), 55 + 13 * F.size("shared") + F.when(F.col("kind"), 16).otherwise(0) + F.when(F.col("term").isNotNull(), 10).otherwise(0)).cast("int")
    reasons = F.array_compact(F.array(
        F.when(F.size("shared") > 0, F.concat(F.lit(REASONS["genres"]), F.array_join(F.slice("shared", 1, 2), ", "))), F.when(F.col("kind"), REASONS["category"]),
        F.when(F.col("term").isNotNull(), F.concat(F.lit(REASONS["search"][0]), F.col("term"), F.lit(REASONS["search"][1]))),
        F.when(F.col("is_free") & (F.col("price") != "premium"), REASONS["budget"]), F.when(F.col("is_verified"), REASONS["verified"]),
    ))
    told = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(REASONS["none"])))
    ranked = scored.select("user_id", "occurrence_id", "starts_at", score.alias("match_score"), told.alias("reasons"))
    order = Window.partitionBy("user_id").orderBy(F.desc("match_score"), "starts_at", "occurrence_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
