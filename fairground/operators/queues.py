"""Work queues in batch form: claiming, fairness, leases, breakers, budgets and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import backoff_seconds


def _at(asof: datetime) -> Column:
    return F.lit(asof).cast("timestamp_ntz")


def claimable(asof: datetime) -> Column:
    """Due, not tried too often, and queued or leased with a lease that ran out."""
    free = (F.col("status") == "queued") | ((F.col("status") == "leased") & (F.col("lease_until") <= _at(asof)))
    return free & (F.col("available_at") <= _at(asof)) & (F.col("attempts") < F.col("max_attempts"))


def live(asof: datetime) -> Column:
    return (F.col("status") == "leased") & (F.col("lease_until") > _at(asof))


def fair_claim(jobs: DataFrame, campaigns: DataFrame, asof: datetime, n: int) -> DataFrame:
    """The next 1 to 50 jobs of running campaigns, round robin over countries and kinds; equals in the order of a hash."""
    running = campaigns.where(F.col("campaign_status").isin("queued", "running")).select("campaign_id")
    rank = F.row_number().over(Window.partitionBy("country_id", "kind").orderBy(F.desc("priority"), "available_at", "job_id"))
    mixed = F.md5(F.concat_ws("|", F.col("city_id").cast("string"), "kind", F.col("job_id").cast("string")).cast("binary"))
    return jobs.where(claimable(asof)).join(running, "campaign_id", "left_semi").withColumn("turn", rank).orderBy("turn", mixed, "job_id").limit(max(1, min(50, n)))


def one_per_domain(jobs: DataFrame, open_circuits: DataFrame, asof: datetime, total: int = 2, at_once: int = 1) -> DataFrame:
    """The next jobs of domains without a live lease and without an open circuit: at most ``at_once``, and ``total`` live leases in all."""
    leased = jobs.where(live(asof))
    busy = leased.select(F.lower("domain").alias("busy"))
    blocked = open_circuits.where(F.col("open_until") > _at(asof)).select(F.lower("domain").alias("busy"))
    slots = leased.agg(F.least(F.lit(at_once), F.greatest(F.lit(0), total - F.count("*"))).alias("slots"))
    due = jobs.where(claimable(asof)).withColumn("busy", F.lower("domain")).join(busy.unionByName(blocked), "busy", "left_anti").drop("busy")
    next_ = due.orderBy("available_at", "job_id").limit(at_once).withColumn("turn", F.row_number().over(Window.orderBy("available_at", "job_id")))
    return next_.crossJoin(F.broadcast(slots)).where(F.col("turn") <= F.col("slots")).drop("turn", "slots")


def rebalanced(jobs: DataFrame, asof: datetime, keep: int = 25, step_hours: int = 6, cap_hours: int = 720, batch: int = 10_000) -> DataFrame:
    """Due jobs past a domain's first ``keep`` with the time and the priority that they are put off to, the last ones first, ``batch`` at most.

    Each further ``keep`` waits ``step_hours`` longer. Search results go before events, those before other pages.
    """
    rank = F.when(F.col("kind") == "search_result", 0).when(F.col("kind") == "event", 1).otherwise(2)
    order = Window.partitionBy("domain").orderBy(rank, "depth", F.desc("priority"), "available_at", "job_id")
    late = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= _at(asof))).withColumn("turn", F.row_number().over(order)).where(F.col("turn") > keep)
    hours = F.least(F.lit(cap_hours), step_hours * F.floor((F.col("turn") - 1) / keep)).cast("int")
    depth = F.least("depth", F.lit(20)) * 10
    base = F.when(F.col("kind") == "search_result", 900).when(F.col("kind") == "event", 700 - depth).otherwise(300 - depth)
    priority = F.greatest(F.lit(-32000), F.least(F.lit(32000), base + F.greatest(F.lit(-99), F.least(F.lit(99), "priority"))))
    moved = late.orderBy(F.desc("turn"), "job_id").limit(batch)
    return moved.select("job_id", "turn", F.greatest("available_at", _at(asof) + F.make_dt_interval(hours=hours)).alias("available_at"), priority.cast("int").alias("priority"))


def reaped(jobs: DataFrame, asof: datetime, max_attempts: int) -> DataFrame:
    """Leases that ran out: failed for good after ``max_attempts``, else queued again after a growing delay."""
    out = jobs.where((F.col("status") == "leased") & (F.col("lease_until") < _at(asof)))
    done = F.col("attempts") >= max_attempts
    delay = backoff_seconds(F.col("attempts"))
    return out.select("job_id", "kind", F.when(done, "failed").otherwise("queued").alias("status"), F.when(~done, _at(asof) + F.make_dt_interval(secs=delay)).alias("available_at"))


def backlog(jobs: DataFrame, asof: datetime, queues: tuple[str, ...]) -> DataFrame:
    """One row with the work of each queue: jobs that are queued and due, and those with a live lease."""
    busy = ((F.col("status") == "queued") & (F.col("available_at") <= _at(asof))) | live(asof)
    return jobs.agg(*[F.count_if(busy & (F.col("queue") == q)).alias(q) for q in queues])


def admission(jobs: DataFrame, asof: datetime, limit: int) -> DataFrame:
    """Searches that may begin: floor((limit - backlog of crawls - 10 x searches at work) / 10), not under 0."""
    crawls = ((F.col("status") == "queued") & (F.col("available_at") <= _at(asof))) | live(asof)
    counts = jobs.agg(F.count_if(crawls & (F.col("queue") == "crawl")).alias("crawls"), F.count_if(live(asof) & (F.col("queue") == "search")).alias("searches"))
    return counts.select(F.greatest(F.lit(0), F.floor((limit - F.col("crawls") - 10 * F.col("searches")) / 10)).cast("int").alias("capacity"))


def health(created: DataFrame, jobs: DataFrame, asof: datetime, minutes: int = 90, alert_from: int = 100) -> DataFrame:
    """Last creation and creations of the last minutes, jobs completed in them by what they did, and whether many were completed but none created anything.

    ``created``: created_at; ``jobs``: status, action, finished_at.
    """
    since = _at(asof) - F.make_dt_interval(mins=F.lit(minutes))
    events = created.agg(F.max("created_at").alias("last_created_at"), F.count_if(F.col("created_at") >= since).alias("events_created"))
    done = (F.col("status") == "completed") & (F.col("finished_at") >= since)
    work = jobs.agg(F.count_if(done).alias("completed"), F.count_if(done & (F.col("action") == "created")).alias("created"), F.count_if(done & (F.col("action") == "updated")).alias("updated"))
    return events.crossJoin(F.broadcast(work)).withColumn("alert", (F.col("completed") >= alert_from) & (F.col("created") == 0))


def sliding_health(events: DataFrame) -> DataFrame:
    """The same over sliding windows of 90 minutes that begin each 15."""
    return events.groupBy(F.window("ts", "90 minutes", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("window_start"), "n", "errors")


def campaign_status(campaigns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Roll-up of each campaign's jobs, and its status: failed and cancelled ones stay, others run while work is pending and are complete after any."""
    n = lambda s: F.count_if(F.col("status") == s)
    rolled = jobs.groupBy("campaign_id").agg(F.count("*").alias("total"), n("queued").alias("queued"), n("leased").alias("leased"), n("done").alias("done"), n("failed").alias("failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("available_at", "job_id"))).alias("last_error"))
    out = campaigns.join(rolled, "campaign_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "queued", "leased", "done", "failed")}
    pending = zero["queued"] + zero["leased"] > 0
    status = F.when(F.col("campaign_status").isin("failed", "cancelled"), F.col("campaign_status")).when(pending, "running").when(zero["total"] > 0, "completed").otherwise(F.col("campaign_status"))
    return out.withColumns({**zero, "campaign_status": status})


def first_of_day(jobs: DataFrame) -> DataFrame:
    """The first job of each day, kind and key does the work; others are repeats."""
    order = Window.partitionBy("work_date", "kind", "domain").orderBy("available_at", "job_id")
    return jobs.withColumn("work_date", F.to_date("available_at")).withColumn("turn", F.row_number().over(order)).where("turn = 1")


def quota_rows(events: DataFrame, per_hour: int) -> DataFrame:
    """Requests of each client and hour in order; those past the limit are refused."""
    hour = F.date_trunc("hour", "ts")
    order = Window.partitionBy("user_id", "window_start").orderBy("ts", "event_id")
    return events.withColumn("window_start", hour).withColumn("used", F.row_number().over(order)).withColumn("accepted", F.col("used") <= per_hour)


def due_cities(cities: DataFrame, asof: datetime, seed: int, n: int) -> DataFrame:
    """Cities whose next look is due (or never was), round robin over countries, equals by a seeded hash."""
    mixed = F.md5(F.concat_ws("-", F.col("city_id").cast("string"), F.lit(str(seed))).cast("binary"))
    due = cities.where(F.col("next_at").isNull() | (F.col("next_at") <= _at(asof)))
    turn = F.row_number().over(Window.partitionBy("country_id").orderBy(F.col("next_at").asc_nulls_first(), F.col("population").desc_nulls_last(), mixed, "city_id"))
    return due.withColumn("turn", turn).orderBy("turn", mixed, "city_id").limit(n)


def largest_by_country(cities: DataFrame) -> DataFrame:
    """Each country's largest cities; how many depends on the country's people."""
    people = cities.groupBy("country_id").agg(F.sum("population").alias("people"))
    p = F.col("people")
    n = F.when(p >= 100_000_000, 50).when(p >= 50_000_000, 40).when(p >= 20_000_000, 25).when(p >= 5_000_000, 15).when(p >= 1_000_000, 8).when(p >= 100_000, 3).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("country_id").orderBy(F.desc("population"), "city_id"))
    return cities.join(people.withColumn("city_limit", n), "country_id").withColumn("population_rank", rank).where(F.col("population_rank") <= F.col("city_limit"))


def expired(rows: DataFrame, asof: datetime, days: int) -> DataFrame:
    return rows.where(F.col("ts") < _at(asof) - F.make_dt_interval(F.lit(days)))


def cache_state(rows: DataFrame, asof: datetime, reopen_hours: int = 24) -> DataFrame:
    """Jobs with ``cached`` (their result still holds), those that ended a day ago queued again from the start."""
    ended = F.col("status").isin("completed", "failed", "skipped") & (F.coalesce("finished_at", "updated_at") <= _at(asof) - F.make_dt_interval(hours=F.lit(reopen_hours)))
    again = F.coalesce(ended, F.lit(False))
    return rows.withColumns({
        "cached": F.coalesce(F.col("expires_at") > _at(asof), F.lit(False)), "status": F.when(again, "queued").otherwise(F.col("status")),
        "attempts": F.when(again, 0).otherwise(F.col("attempts")), "available_at": F.when(again, _at(asof)).otherwise(F.col("available_at")),
    })
