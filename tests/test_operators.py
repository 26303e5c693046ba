import re
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairground.functions import text
from fairground.operators import engagement, identity, merging, pairing, queues, scores, taxonomy, writes
from fairground.plans import catalog, catalog_more  # noqa: F401  (registers its queries)
from fairground.sources import web
from fairground.streaming import runs


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_taxonomy_cases(spark):
    rows = spark.createDataFrame([("Afro-house and jazz night", "concerts"), ("plain", "x"), ("Café & musée, marché", None)], "t string, c string")
    got = rows.select(taxonomy.genres(F.col("t")), taxonomy.facets(F.col("t"), F.col("c"), F.lit(False)), taxonomy.category(F.col("t"), F.col("c"))).collect()
    assert got[0][0] == ["afro-house", "jazz"] and got[0][1] == ["music"] and got[0][2] == "soirees"
    assert tuple(got[1]) == ([], [], "x")
    assert got[2][1] == ["coffee-tea", "markets", "museums"] and got[2][2] == "expositions"


def test_texts_are_read_once_where_no_rule_holds(monkeypatch):
    read, match = [], taxonomy.pc.match_substring_regex
    monkeypatch.setattr(taxonomy.pc, "match_substring_regex", lambda own, p: read.append(len(own)) or match(own, p))
    texts = ["nothing here"] * 1000 + ["jazz & house music", "hip\rhop", "", None]
    got = taxonomy.rules_held(pa.array(texts), taxonomy.GENRES).to_pylist()
    # The SQL's expressions let a dot be a carriage return, too; Java's, which stood here before, don't.
    assert got[:1000] == [[]] * 1000 and got[1000:] == [["house", "jazz"], ["hip-hop"], [], []]
    assert sum(read) < 1100  # 29 patterns over each text before
    words = [*[w for _, p in taxonomy.FACETS for w in p.split("|")], " art ", "zoo kino spa", "", None]
    each = [[n for n, p in taxonomy.FACETS if re.search(p, t or "")] for t in words]
    assert taxonomy.rules_held(pa.array(words), taxonomy.FACETS).to_pylist() == each
    assert taxonomy.rules_held(pa.array([], pa.string()), taxonomy.FACETS).to_pylist() == []


def test_genres_follow_the_sql_on_carriage_returns(spark):
    rows = spark.createDataFrame([("HIP\rHOP",), (None,)], "t string")
    assert [r[0] for r in rows.select(taxonomy.genres(F.col("t"))).collect()] == [["hip-hop"], []]


@pytest.mark.parametrize(("licence", "who", "fine"), [("CC BY-NC 4.0", "me", False), ("CC0", None, True), ("CC BY", "me", True), ("CC BY", " ", False), ("Creative Commons", "me", False), (None, "me", False), ("Public Domain", "", True)])
def test_licences(spark, licence, who, fine):
    assert spark.range(1).select(taxonomy.reusable(F.lit(licence).cast("string"), F.lit(who).cast("string"))).first()[0] is fine


def test_nearby_pairs_at_bucket_edges(spark):
    t = lambda m, s=0: datetime(2024, 1, 1, 10 + m // 60, m % 60, s)
    rows = spark.createDataFrame([(1, "a", t(14, 59)), (2, "a", t(29, 59)), (3, "a", t(30)), (4, "b", t(15)), (5, "a", None)], "id int, k string, `at` timestamp_ntz")
    got = identity.nearby_pairs(rows, rows, ["k"], 15).where("id < id_2")
    assert pairs(got, "id", "id_2", "gap_s") == [(1, 2, 900), (2, 3, 1)]


def test_pairs_of_ids_equal_pairs_of_rows_and_are_dealt_out(spark):
    t = lambda m, s=0: datetime(2024, 1, 1, 10 + m // 60, m % 60, s)
    edges = [(1, "a", t(14, 59)), (2, "a", t(29, 59)), (3, "a", t(30)), (4, "b", t(15)), (5, "a", None), (None, "a", t(30)), (6, None, t(30)), (7, None, t(30)), (3, "a", t(30)), (0, "a", t(31))]
    rows = spark.createDataFrame([*edges, *[(1000 + i * 7 % 60, "c", t(40 + i % 3 * 14)) for i in range(60)]], "id int, k string, `at` timestamp_ntz")
    expected = pairs(identity.nearby_pairs(rows, rows, ["k"], 15).where("id < id_2"), "id", "id_2", "gap_s")
    for most in (1, 3, 256):
        assert pairs(identity.nearby_id_pairs(rows, ["k"], 15, most), "id", "id_2", "gap_s") == expected
    hot = spark.range(3000).select("id", F.lit("a").alias("k"), F.lit(t(0)).cast("timestamp_ntz").alias("at"))
    own = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    made = own(identity.nearby_id_pairs(hot, ["k"], 15))
    assert sum(made) == 3000 * 2999 // 2 and max(made) < 0.6 * sum(made)


def test_lists_of_ids_are_not_shuffled_two_by_two(spark):
    rows = spark.range(60_000).select(F.abs(F.xxhash64("id")).alias("id"), (F.col("id") % 10).alias("k"), F.lit(datetime(2024, 1, 1, 8)).cast("timestamp_ntz").alias("at"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert identity.nearby_id_pairs(rows, ["k"], 15).agg(F.count("*"), F.max("gap_s")).first() == (10 * 6000 * 5999 // 2, 0)
    assert written() - before < 4_500_000  # 7,411,746 when two lists that meet were shuffled, 3,032,820 now


def test_fingerprints_tell_titles_and_places_before_occurrences_are_joined(spark):
    found = catalog.QUERIES["op_r01_r02_r03_r04_m06_fingerprints"](spark, "/root/testdata/sf0.001")
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "Normalizer" not in above and "Normalizer" in below and "sha2" in above


def test_duplicate_verdicts(spark):
    rows = [("Jazz Night", "Jazz night!", "Hall", "hall", 0), ("Jazz Night", "Jazz night", None, "hall", 60), ("Jazz Night", "Rock Day", "Hall", "Club", 0), ("Jazz Night", "Jazz night", "Hall", "Hall", 3600)]
    got = identity.duplicate_score(spark.createDataFrame(rows, "title string, title_2 string, venue string, venue_2 string, gap_s long")).select("verdict").collect()
    assert [r[0] for r in got] == ["merge", "merge", "distinct", "review"]


def test_duplicate_candidates_equal_all_pairs(spark):
    names = ["Jazz Night", "Jazz nights!", "jazz by night", "Rock Day", "Rock days", "aaaa", "aaa", "x", "X", "", "!", None, "Night of Jazz", "Jazz Knight", "Rock a day"]
    rows = [(i, names[i * 7 % len(names)], None if i % 4 == 0 else ["Hall", "hall 2"][i % 2], datetime(2024, 1, 1, i * 5 % 24, i * 11 % 60)) for i in range(90)]
    df = spark.createDataFrame([*rows, (90, "Jazz Night", None, datetime(2024, 2, 1, 8)), (91, "Jazz Night", None, datetime(2024, 2, 1, 12)), (93, "Jazz night", None, datetime(2024, 2, 1, 8, 5)), (92, "Jazz Night", None, None)], "id int, title string, venue string, `at` timestamp_ntz")
    both = df.crossJoin(df.select(*[F.col(c).alias(f"{c}_2") for c in df.columns])).where("id < id_2")
    both = both.withColumn("gap_s", F.abs(F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("at_2").cast("timestamp"))))
    near = both.where("gap_s <= 14400").where(text.bigram_dice(text.alnum_key(F.col("title")), text.alnum_key(F.col("title_2"))) >= 0.7)
    columns = ("id", "id_2", "score", "verdict")
    got = pairs(identity.duplicate_score(identity.duplicate_candidates(df)), *columns)
    assert got == pairs(identity.duplicate_score(near), *columns)
    assert {"review", "merge", "distinct"} == {r[3] for r in got} and any(r[:2] == (90, 91) for r in got)


def test_copies_are_paired_with_their_representative_only(spark):
    at = datetime(2024, 1, 1, 8)
    rows = [(i, ["Jazz Night", "jazz night!"][i % 2], "Hall", at) for i in range(40)] + [(100 + i, "Jazz nights", "Hall", at) for i in range(40)] + [(200, "Jazz Night", None, at), (201, "Jazz Night", None, at), (300, None, "Hall", at), (301, None, "Hall", at)]
    df = spark.createDataFrame(rows, "id int, title string, venue string, `at` timestamp_ntz")
    every = {(r[0], r[1]): tuple(r) for r in pairs(identity.duplicate_score(identity.duplicate_candidates(df)), "id", "id_2", "score", "verdict")}
    got = pairs(identity.duplicate_score(identity.duplicate_classes(df)), "id", "id_2", "score", "verdict", "copy")
    assert len(got) == 39 + 39 + 1 + 3 and all(every[r[:2]] == r[:4] for r in got)
    # Every pair follows from its representatives.
    head = {r[1]: r[0] for r in got if r[4]}
    between = {r[:2]: r[2:4] for r in got if not r[4]}
    for (a, b), row in every.items():
        x, y = head.get(a, a), head.get(b, b)
        assert row[2:] == ((1.0, "merge") if x == y else between[min(x, y), max(x, y)])


def test_venues_and_names_of_copies_are_matched_once(spark):
    asked = spark.createDataFrame([(i, 1, ["Grand Hall", "grand hall x"][i % 2]) for i in range(60)] + [(100, 2, "Grand Hall"), (101, None, "Grand Hall"), (102, 1, None)], "id int, city_id int, name string")
    venues = spark.createDataFrame([(i, 1, "Grand Hall") for i in range(7, 67)] + [(3, 1, "Other")], "venue_id int, venue_city_id int, venue_name string")
    found = identity.match_venues(asked, venues, 0.6)
    assert {(r.id, r.venue_id) for r in found.collect()} == {(i, 7) for i in range(60)}
    assert most_rows(found) <= 200


def most_rows(df):
    """The most rows that a step of the plan, which has run, put out."""
    text = df._jdf.queryExecution().executedPlan()
    found, open_ = 0, [text]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            open_.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found = max(found, metric.get().value())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_greedy_keeps_the_better_and_chains_apart(spark):
    rows = [("CH", "x", 1, 10.0, 46.0, 6.0), ("CH", "x", 2, 9.0, 46.04, 6.0), ("CH", "x", 3, 8.0, 46.08, 6.0), ("CH", "y", 4, 1.0, 46.0, 6.0)]
    df = spark.createDataFrame(rows, "country string, key string, id int, quality double, lat double, lon double")
    assert pairs(identity.greedy_distinct(df, "country"), "id") == [(1,), (3,), (4,)]


def test_merge_prefers_rank_and_longest(spark):
    rows = [("k", 2, 1, "longer text", 7, 5, False, ["b"]), ("k", 1, 2, "short", None, 9, True, ["a", "b"]), ("k", 3, 3, None, 8, None, None, ["c"])]
    got = identity.merge_records(spark.createDataFrame(rows, "k string, rank int, id int, text string, venue_id int, capacity int, verified boolean, tags array<string>"), "k").first()
    assert (got.n_records, got.text, got.venue_id, got.capacity, got.verified, got.tags) == (3, "longer text", 7, 9, True, ["a", "b", "c"])


def test_identity_order(spark):
    ident = spark.createDataFrame([("a", "1", 10, 5), ("a", "1", 11, 2), ("b", "2", 20, 1)], "kind string, value string, event_id int, seen int")
    asked = spark.createDataFrame([(1, "1", "2"), (2, "x", "2"), (3, None, None)], "id int, a string, b string")
    assert pairs(scores.resolve_identity(asked, ident, ["a", "b"]), "id", "event_id") == [(1, 11), (2, 20), (3, None)]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3), (3, "c", 3)], "k int, v string, n int")
    assert pairs(writes.insert_ignoring(t, new, ["k"]), "k", "n") == [(1, 1), (2, 2), (3, 3)]
    assert pairs(writes.upsert_coalescing(t, new, ["k"]), "k", "v", "n") == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert pairs(writes.update_from(t, new.where("k = 2"), ["k"], "v"), "k", "v") == [(1, "a"), (2, None)]
    assert pairs(writes.delete_matching(t, new, ["k"]), "k") == [(1,)]
    assert pairs(writes.upsert_where(t.select("k", "n"), new.dropDuplicates().select("k", "n"), ["k"], "n", 10), "k", "n") == [(1, 1), (2, 2), (3, 3)]


JOBS = "job_id int, domain string, kind string, status string, priority int, available_at timestamp_ntz, lease_until timestamp_ntz, attempts int, max_attempts int, depth int, campaign_id int, city_id int, country_id int, queue string"


def job(i, domain="a", kind="event", status="queued", priority=0, at=datetime(2024, 1, 1), lease=None, attempts=0, depth=0, campaign=1, city=1, country=1, queue="crawl"):
    return i, domain, kind, status, priority, at, lease, attempts, 5, depth, campaign, city, country, queue


def test_claims_and_leases(spark):
    asof, past, future = datetime(2024, 1, 2), datetime(2024, 1, 1), datetime(2024, 1, 3)
    rows = [job(1, priority=1), job(2, priority=5, country=2), job(3, status="leased", lease=past), job(4, "C", status="leased", lease=future), job(5, "c"), job(6, at=future), job(7, attempts=5), job(8, campaign=2), job(9, "Open", at=datetime(2023, 1, 1))]
    jobs = spark.createDataFrame(rows, JOBS)
    campaigns = spark.createDataFrame([(1, "running"), (2, "cancelled")], "campaign_id int, campaign_status string")
    turns = {r.job_id: r.turn for r in queues.fair_claim(jobs, campaigns, asof, 99).collect()}
    assert turns == {1: 1, 2: 1, 9: 2, 3: 3, 5: 4} and queues.fair_claim(jobs, campaigns, asof, 0).count() == 1
    circuits = spark.createDataFrame([("open", future), ("a", past)], "domain string, open_until timestamp_ntz")
    # One live lease (4): one more may be given; 9 waits for its circuit, 5 for its domain.
    assert pairs(queues.one_per_domain(jobs, circuits, asof), "job_id") == [(1,)]
    assert pairs(queues.one_per_domain(jobs, circuits, asof, total=1), "job_id") == []
    assert queues.admission(jobs.withColumn("queue", F.when(F.col("job_id") == 4, "search").otherwise("crawl")), asof, 107).first().capacity == (107 - 6 - 10) // 10
    assert tuple(queues.backlog(jobs, asof, ("crawl", "search")).first()) == (7, 0)


def test_rebalanced_queue(spark):
    asof = datetime(2024, 1, 2)
    rows = [job(i, kind="list", priority=i % 3, depth=30) for i in range(7)] + [job(10, kind="search_result", priority=500), job(11, "b"), job(12, at=datetime(2024, 1, 3))]
    got = {r.job_id: (r.turn, (r.available_at - asof).total_seconds() / 3600, r.priority) for r in queues.rebalanced(spark.createDataFrame(rows, JOBS), asof, keep=3).collect()}
    assert got == {1: (4, 6.0, 101), 4: (5, 6.0, 101), 0: (6, 6.0, 100), 3: (7, 12.0, 100), 6: (8, 12.0, 100)}


def test_campaign_states_and_health(spark):
    campaigns = spark.createDataFrame([(1, "running"), (2, "running"), (3, "queued"), (4, "cancelled")], "campaign_id int, campaign_status string")
    jobs = spark.createDataFrame([job(1, campaign=1), job(2, campaign=2, status="failed"), job(3, campaign=4)], JOBS).withColumn("error", F.lit(None).cast("string"))
    assert pairs(queues.campaign_status(campaigns, jobs), "campaign_id", "campaign_status", "total") == [(1, "running", 1), (2, "completed", 1), (3, "queued", 0), (4, "cancelled", 1)]
    asof = datetime(2024, 1, 2)
    done = spark.createDataFrame([("completed", "updated", datetime(2024, 1, 1, 23))] * 100 + [("completed", "created", datetime(2024, 1, 1, 22))], "status string, action string, finished_at timestamp_ntz")
    made = spark.createDataFrame([(datetime(2024, 1, 1, 22, 30),), (datetime(2024, 1, 1, 22),)], "created_at timestamp_ntz")
    r = queues.health(made, done, asof).first()
    assert (r.events_created, r.completed, r.created, r.updated, r.alert) == (1, 100, 0, 100, True)


def test_weighted_quota(spark):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [("a", at(1, 0), 1, 20), ("a", at(1, 1), 2, 20), ("a", at(1, 2), 3, 15), ("a", at(1, 3), 4, 10), ("a", at(1, 4), 5, 5), ("a", at(1, 5), 6, 21), ("a", at(2, 0), 7, 20), ("b", at(1, 0), 8, -1), ("b", at(1, 1), 9, 0)]
    got = runs.weighted_quota(spark.createDataFrame(rows, "client string, ts timestamp, request_id int, amount int").repartition(3), hourly=50)
    assert pairs(got, "request_id", "accepted") == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True), (8, False), (9, True)]


def test_audience_is_never_told_exactly(spark):
    rows = [(1, u) for u in range(19)] + [(2, u) for u in range(24)] + [(3, u) for u in range(25)]
    got = engagement.audience_estimate(spark.createDataFrame(rows, "campaign_id int, user_id int"))
    assert pairs(got, "campaign_id", "audience") == [(1, 0), (2, 20), (3, 30)]


def test_engagement_counts_each_child_once(spark):
    v = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    got = engagement.engagement(v, v.where("k = 1"), spark.createDataFrame([(1,), (3,)], "k int"), "k")
    assert pairs(got, "k", "views", "likes", "comments", "score") == [(1, 2, 2, 1, 12), (2, 1, 0, 0, 1), (3, 0, 0, 1, 4)]


def test_robots(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /p\nAllow: /p/x # c\n\nUser-agent: Fairbot\nDisallow: /*.pdf$\n"), ("b", "nonsense\nDisallow: /\n"), ("c", "User-agent: *\nUser-agent: y\nDisallow: /")], "domain string, body string")
    urls = spark.createDataFrame([(1, "a", "/p"), (2, "a", "/d/f.pdf"), (3, "a", "/d/f.pdfx"), (4, "b", "/"), (5, "c", "/z"), (6, "none", "/")], "url_id int, domain string, path string")
    rules = web.robots_rules(files)
    assert pairs(web.robots_verdicts(urls, rules, "fairbot"), "url_id", "allowed") == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True)]
    assert pairs(web.robots_verdicts(urls.where("domain = 'a'"), rules, "other"), "url_id", "allowed") == [(1, False), (2, True), (3, True)]


@pytest.mark.parametrize(
    "body,path,allowed",
    [
        ("User-agent: fair\nCrawl-delay: 5\nUser-agent: b\nDisallow: /", "/x", True), ("User-agent: fair\nUser-agent: b\nCrawl-delay: 5\nDisallow: /", "/x", False), ("User-agent: fair\nSitemap: https://s/\nUser-agent: b\nDisallow: /", "/x", False), ("User-agent: fair\nDisallow:\nUser-agent: *\nDisallow: /", "/x", True),
        ("User-agent: airbot\nDisallow: /", "/x", False), ("User-agent: fairbot/2\nDisallow: /", "/x", True), ("User-agent: *\nDisallow: /caf\u00e9", "/caf%c3%a9/1", False), ("User-agent: *\nDisallow: /%7euser", "/~user", False), ("User-agent: *\nDisallow: /a%2fb", "/a/b", True), ("User-agent: *\nDisallow: /a%2fb", "/a%2Fb", False),
        ("User-agent: *\nDisallow: /%2541", "/%2541x", False), ("User-agent: *\nDisallow: /a*****\nAllow: /ab", "/abc", True), ("User-agent: *\nDisallow: /%c3%a9\nAllow: /\u00e9*", "/%C3%A9", True), ("User-agent: *\nDisallow: /x$\nAllow: /x", "/x", True), ("\ufeffUser-agent: *\nDisallow: /*.php$", "/a.php?x", True),
        ("User-agent: *\nDisallow: /*.php$", "/a/b.php", False), ("Disallow: /\nUser-agent: *", "/x", True), ("User-agent: *\nDisallow: /a\nUser-agent: z\nDisallow: /c\nUser-agent: *\nDisallow: /b", "/b", False), ("User-agent: \nDisallow: /", "/x", True), ("User-agent: *\nDisallow: /a.c", "/abc", True),
    ],
)
def test_robots_rules(spark, body, path, allowed):
    files = spark.createDataFrame([("d", body)], "domain string, body string")
    urls = spark.createDataFrame([(1, "d", path)], "url_id int, domain string, path string")
    assert web.robots_verdicts(urls, web.robots_rules(files), "Fairbot").first().allowed is allowed


def test_robots_delays_and_sitemaps(spark):
    files = spark.createDataFrame([("d", "Sitemap: https://s/1 # first\nUser-agent: A\nUser-agent: b\ncrawl-delay: 2.5s\nCrawl-Delay: 1e9\nUser-agent: c\nCrawl-delay: -1\n sitemap:https://s/2\nSitemap: https://s/1")], "domain string, body string")
    assert pairs(web.robots_delays(files), "agent", "delay_s") == [("a", 2.5), ("b", 2.5)]
    assert pairs(web.robots_sitemaps(files), "url") == [("https://s/1",), ("https://s/2",)]


def test_tab_separated_files(spark, tmp_path):
    fields = lambda *v: "\t".join(map(str, v))
    city = fields(1, "Genève", "Geneve", "Genf,Ginevra", 46.2, 6.15, "P", "PPLA", "CH", "", "GE", "", "", "", 200000, "", 375, "Europe/Zurich", "2024-01-01")
    (tmp_path / "cities.txt").write_text(city + "\n" + city.replace("\tP\t", "\tH\t") + "\n")
    r = web.read_cities(spark, str(tmp_path / "cities.txt")).collect()
    assert len(r) == 1 and r[0].alternate_names == ["Genf", "Ginevra"] and r[0].population == 200000 and not r[0].is_capital
    country = fields("CH", "CHE", 756, "SZ", "Switzerland", "Bern", 41290, 8484100, "EU", ".ch", "CHF", "Franc", 41, "", "", "de-CH,fr-CH", 2658434)
    (tmp_path / "countries.txt").write_text("# comment\n" + country + "\n")
    r = web.read_countries(spark, str(tmp_path / "countries.txt")).collect()
    assert len(r) == 1 and (r[0].code, r[0].population, r[0].languages, r[0].geonames_id) == ("CH", 8484100, ["de-CH", "fr-CH"], 2658434)


def test_breaker_steps():
    state, told = (0, -1.0, -1.0, 0), []
    for at, failed in ((0, True), (600, True), (2000, True), (2300, True), (2400, True), (2500, False), (9700, True), (16901, False), (17000, False)):
        state, name = runs.breaker_step(state, at, failed)
        told.append((name, state[3]))
    assert told == [("closed", 0), ("closed", 0), ("closed", 0), ("closed", 0), ("open", 1), ("open", 1), ("open", 2), ("closed", 2), ("closed", 2)]


def _events(spark, n=400):
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, datetime(2024, 1, 1 + i // 200, i // 10 % 20, 6 * (i % 10)), i % 7, kinds[i * 7 % 5 if i % 3 else 4]) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")


def test_streams_agree_with_batches(spark, tmp_path):
    failing = spark.createDataFrame([(1000 + i, datetime(2024, 1, 1, 5, 5 * i), 99, "error") for i in range(3)], _events(spark).schema)
    e = _events(spark).union(failing)
    for i in range(3):  # files in order of time: several batches of one stream
        e.where((F.col("event_id") >= 140 * i) & (F.col("event_id") < (140 * (i + 1) if i < 2 else 2000))).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = lambda: runs.source(spark, f"{tmp_path}/in", e)
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    told = runs.drain(runs.circuit_breaker(runs.with_end(stream(), f"{tmp_path}/events.parquet"), delay="2 days"), "append").where("user_id >= 0")
    assert pairs(told.where("event_id is not null"), "event_id", "state", "opened") == pairs(runs.breaker_batch(e), "event_id", "state", "opened")
    assert [tuple(r) for r in told.where("event_id is null").select("user_id", "state", "opened", "at_ms").collect()] == [(99, "half_open", 1, 1704093000000)]
    assert pairs(runs.latest(runs.drain(runs.signed_counter(stream(), "user_id"), "complete"), ["user_id"]), "user_id", "net") == pairs(runs.signed_counter(e, "user_id"), "user_id", "net")
    first = runs.drain(runs.distinct_deliveries(stream()), "append")
    assert first.count() == e.select("user_id", "event_type", F.to_date("ts")).distinct().count()


class Handle:
    """Stands for a key's state: values, maps and timers in memory."""

    def __init__(self):
        self.timers, self.value, self.map = set(), None, {}

    def registerTimer(self, at):
        self.timers.add(at)


def _told(processor, events):
    """What a processor gives for (us, id, kind, amount), all timers run in order."""
    processor.handle, state, waiting, out = Handle(), None, {}, []
    for e in events:
        waiting.setdefault(e[0] // 1000, []).append(e)
        processor.handle.registerTimer(e[0] // 1000)
    while processor.handle.timers:
        due = min(processor.handle.timers)
        processor.handle.timers.discard(due)
        if due in waiting:
            for e in sorted(waiting.pop(due)):
                state, rows = processor.event(state, e)
                out += rows
        else:
            state, rows = processor.alarm(state, due)
            out += rows
    return out, state


MINUTE = 60_000_000


def test_breaker_turns_half_open_without_an_event():
    failures = [(i * MINUTE, i, "error", 0.0) for i in (0, 5, 10)]
    out, state = _told(runs.Breaker(86_400), failures)
    assert out == [(0, "closed", 0, 0), (5, "closed", 0, 300_000), (10, "open", 1, 600_000), (None, "half_open", 1, 7_800_000)] and state is None
    again, _ = _told(runs.Breaker(86_400), [*failures, (131 * MINUTE, 11, "error", 0.0)])
    assert [(r[0], r[1]) for r in again[3:]] == [(None, "half_open"), (11, "open"), (None, "half_open")]
    late, _ = _told(runs.Breaker(86_400), [*failures, (11 * MINUTE, 12, "purchase", 0.0), (130 * MINUTE, 13, "purchase", 0.0)])
    assert [(r[0], r[1]) for r in late[3:]] == [(12, "open"), (None, "half_open"), (13, "closed")]
    closed, state = _told(runs.Breaker(86_400), [(0, 1, "error", 0.0), (MINUTE, 2, "purchase", 0.0)])
    assert [r[1] for r in closed] == ["closed", "closed"] and state is None


def test_quota_is_dropped_with_its_hour():
    out, state = _told(runs.Quota(60, 20), [(i * MINUTE, i, "", a) for i, a in enumerate((20, 20, 21, -1, 15, 6, 5))])
    assert [r[1] for r in out] == [True, True, False, False, True, False, True] and state is None


def test_lease_runs_out_without_an_event():
    out, _ = _told(runs.Lease(60), [(0, 1, "lease", 0.0), (30 * 1_000_000, 2, "lease", 0.0), (120 * 1_000_000, 3, "lease", 0.0), (130 * 1_000_000, 4, "done", 0.0), (140 * 1_000_000, 5, "done", 0.0)])
    assert out == [(1, "requeued", 60_000, 65_000), (2, "done", 130_000, None)]


class Store(Handle):
    """A key's state with one value and one list, in memory; counts the timers that are set."""

    def __init__(self):
        super().__init__()
        self.kept, self.rows, self.set = None, [], 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.kept, update=lambda v: setattr(self, "kept", v), clear=lambda: setattr(self, "kept", None))

    def getListState(self, name, schema):
        return SimpleNamespace(get=lambda: iter(list(self.rows)), appendList=self.rows.extend, put=lambda v: setattr(self, "rows", list(v)), clear=lambda: setattr(self, "rows", []))

    def getMapState(self, name, key, value):
        held = self.map
        return SimpleNamespace(getValue=lambda k: held.get(k), updateValue=held.__setitem__, removeKey=held.pop)

    def registerTimer(self, at):
        self.set += 1
        super().registerTimer(at)


def test_a_key_costs_few_timers_however_many_events_it_has():
    store, processor, out = Store(), runs.Lease(60), []
    processor.init(store)
    events = [(i * 40 * 1_000_000, i, "lease", 0.0) for i in range(500)]
    for part in (events[300:], events[:300]):  # the earlier ones come late
        frame = pd.DataFrame(part, columns=["us", "id", "kind", "amount"]).assign(ts=lambda f: pd.to_datetime(f.us, unit="us", utc=True))
        list(processor.handleInputRows((7,), iter([frame]), None))
    for watermark in (10_000_000, 10_000_000 + 40_000, 40_000_000):
        while store.timers and min(store.timers) < watermark:
            due = min(store.timers)
            store.timers.discard(due)
            given = processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: due))
            out += [tuple(r) for f in given for r in f[["attempts", "outcome", "at_ms"]].itertuples(index=False)]
    assert out == [(i + 1, "requeued", 80_000 * i + 60_000) for i in range(250)]
    assert store.set < 20 and not store.rows


def test_stream_quota_equals_the_batch(spark, tmp_path):
    e = _events(spark)
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["op_t03_stream_quota"](spark, str(tmp_path))
    asked = e.select("ts", (F.col("user_id") % 20).alias("client"), F.col("event_id").alias("request_id"), (F.col("event_id") % 30).alias("amount"))
    want = pairs(runs.weighted_quota(asked), "request_id", "accepted")
    assert pairs(got, "request_id", "accepted") == want and {w[1] for w in want} == {True, False}


def test_stream_sessions_include_the_last(spark, tmp_path):
    e = _events(spark)
    for i in (1, 0, 2):  # the first file comes late: sessions of an earlier batch are joined
        e.where((F.col("event_id") >= 140 * i) & (F.col("event_id") < 140 * (i + 1))).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    batch = pairs(runs.user_sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), delay=None), "user_id", "start", "n")
    stream = runs.source(spark, f"{tmp_path}/in", e)
    assert pairs(runs.last_batch(runs.drain(runs.user_sessions(stream, delay=None), "complete")), "user_id", "start", "n") == batch
    assert pairs(catalog.QUERIES["op_t17_stream_sessions"](spark, str(tmp_path)), "user_id", "start", "n") == batch


def test_spacing_equals_the_sequential_rule(spark):
    e = _events(spark, 120)
    got = {r.event_id: r.slot_s for r in runs.spaced_requests(e, 900).collect()}
    last = {}
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        at = int(pd.Timestamp(r.ts).timestamp())
        slot = max(at, last.get(r.user_id, at - 900) + 900)
        last[r.user_id] = slot
        assert got[r.event_id] == slot


def test_pairs_are_scored_from_bigrams_told_once_for_each_row(spark):
    texts = ["", "a", "ab", "aaaa", "Aa aa!", "Jazz night", "jazz-night 2", "日本 祭 jazz", "Été nuit", None]
    rows = spark.createDataFrame([(i, t, texts[-1 - i % 7], 60 * i) for i, t in enumerate(texts[:-1])], "id long, title string, venue string, s long")
    two = lambda r: r.crossJoin(r.select(*[F.col(c).alias(f"{c}_2") for c in r.columns])).withColumn("gap_s", F.abs(F.col("s") - F.col("s_2")))
    plain, told = identity.duplicate_score(two(rows)), identity.duplicate_score(two(identity.with_bigrams(rows)))
    assert pairs(told, "id", "id_2", "score", "verdict") == pairs(plain, "id", "id_2", "score", "verdict") and plain.count() == 81
    plan = told._jdf.queryExecution().analyzed().toString()
    assert "title_grams_2" in plan and "aggregate(" not in plan  # nothing is counted again for a pair


def test_pairs_scored_in_lists_equal_pairs_of_rows(spark):
    texts = ["", "a", "ab", "aaaa", "Aa aa!", "Jazz night", "jazz-night 2", "日本 祭 jazz", "Été nuit", None]
    t = lambda i: datetime(2024, 1, 1, 10) + timedelta(seconds=i * 37 % 4000)
    rows = [(i * 7 % 90, texts[i % 10], texts[i * 3 % 7 - 1], None if i % 13 == 0 else t(i), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, "a", "a", t(1), "a"), (200, "a", "a", t(1), None), (5, "a", "a", t(2), "a")], "id int, title string, venue string, `at` timestamp_ntz, k string")
    told = identity.with_bigrams(df)
    columns = ("id", "id_2", "score", "verdict")
    expected = pairs(identity.duplicate_score(identity.nearby_pairs(told, told, ["k"], 15).where("id < id_2")), *columns)
    assert pairs(identity.duplicate_score(identity.alike_pairs(df, ["k"], 15)), *columns) == expected and len(expected) > 300
    keyed = df.select("k", "id", F.unix_timestamp(F.col("at").cast("timestamp")).alias("second"), *[text.alnum_key(F.col(c)).alias(c) for c in ("title", "venue")])
    for most in (1, 3):  # lists of several parts, and of several shares
        assert pairs(identity.duplicate_score(pairing.similar_pairs(keyed, ["k"], 15, None, most)), *columns) == expected


def test_candidates_of_many_similar_titles_shuffle_neither_pairs_nor_rows_for_each(spark):
    rows = spark.createDataFrame([(i, f"A long night of jazz {i % 60}", f"Hall {i % 7}", datetime(2024, 1, 1 + i % 10, 8, i % 40)) for i in range(3000)], "id int, title string, venue string, `at` timestamp_ntz")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables are not broadcast
    try:
        before = written()
        assert identity.duplicate_candidates(rows).agg(F.count("*"), F.sum("titles")).first()[0] == 448_500
        assert written() - before < 1_500_000  # 7,407,954 when a row stood once for each similar title
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duplicate_pairs_compare_no_two_rows_by_lists_of_bigrams(spark):
    found = catalog.QUERIES["op_r07_f11_duplicate_pairs"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "MapInArrow" in plan


def test_a_matrix_of_texts_holds_a_bounded_number(spark):
    texts = ["", "a", "aa", "aaaa", "aabaa", "jazz night", "jazz nights", "night jazz", *[f"title {i}" for i in range(30)]]
    held = pairing.Matrix(most=12, step=3)
    for low in (0, 4, 2, 20, 26, 0):
        own = texts[low : low + 10]
        n = held.numbers(pa.array([*own, None]))
        assert [[held.flat[a * held.width + b] for b in n[:-1]] for a in n[:-1]] == [[merging.dice(a, b) if a != b else 1.0 for b in own] for a in own]
        assert n[-1] == 0 and np.isnan(held.flat[n]).all() and len(held.codes) <= 12


def test_copies_of_records_are_resolved_once(spark):
    at = datetime(2024, 1, 1, 8)
    columns = "title string, `at` timestamp_ntz, city_id int, venue_id int"
    asked = spark.createDataFrame([(i, "s", "x", f"none {i}", "Jazz Night", at, None, i % 2) for i in range(60)] + [(60, "s", "y", "none", "Jazz Night", at, None, 0)], "id int, source string, external_id string, fingerprint string, " + columns)
    known = spark.createDataFrame([(100 + i, 7 + i, "print", "Jazz Night", at, None, i % 2) for i in range(60)], "id int, event_id int, fingerprint string, " + columns)
    records = spark.createDataFrame([("s", "y", 7 + i, datetime(2023, 1, 1 + i % 2)) for i in range(60)], "source string, external_id string, event_id int, seen timestamp_ntz")
    found = identity.resolve_events(asked, known, records)
    assert set(pairs(found, "id", "event_id", "matched_by")) == {(i, 7 + i % 2, "title") for i in range(60)} | {(60, 8, "id")}
    found.collect()
    assert most_rows(found) <= 500


def test_copies_join_the_first_of_their_class(spark):
    at = datetime(2024, 1, 1, 8)
    rows = spark.createDataFrame([(i, f"k{i}", "Jazz Night", "Hall", at) for i in range(60)] + [(60 + i, f"l{i}", "Rock day", None, None) for i in range(2)], "id int, key string, title string, venue string, `at` timestamp_ntz")
    found = identity.ratio_duplicates(rows)
    assert {r.id: r.kept for r in found.collect()} == {i: 0 for i in range(60)} | {60: 60, 61: 61}
    assert most_rows(found) <= 500


def test_best_earlier_records_are_told_without_a_row_for_each_pair(spark):
    start = datetime(2024, 1, 1, 8)
    rows = spark.createDataFrame([(i, f"k{i}", f"A long night of jazz {i * 7 % 50}", f"Hall {i % 9}", start + timedelta(minutes=i * 11 % 400)) for i in range(400)], "id int, key string, title string, venue string, `at` timestamp_ntz")
    found = identity.ratio_duplicates(rows)
    assert len({r.kept for r in found.collect()}) < 400 and most_rows(found) <= 4000  # 67,080 when a pair was a row
    own = rows.select("id", F.lower("title").alias("name"), F.lower("venue").alias("place"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("second"), F.lit(1).alias("block"))
    for most in (3, 40):  # lists of several parts and shares tell the same in the end
        best = lambda most: pairs(pairing.best_earlier_rows(own, ["block"], 240, 0.92, most).groupBy("id").agg(F.max(F.struct("score", -F.col("id_2"), "gap_s")).alias("best")), "id", "best")  # noqa: B023, E731
        assert best(most) == best(1024)
